"""Result sets that are replaced as a whole.

A set is a folder of numbered versions. A writer computes into a working folder and publishes it by one rename to
the next number, which fails if another writer took that number meanwhile; it then merges anew with what that one
published. Readers take the highest number, so they see a whole version before, during and after a write, and a
failed write leaves the last one in place. The rename is atomic where the file system's is, as on HDFS; object
stores need a committer of their own.

Rows: a set that is missing is empty; new rows replace earlier ones of their key; earlier rows with a null key
stay, as no key equals null; an empty write publishes what was there; columns are those of the rows written.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .tables import stored

_VERSION, _WORK = "version-", "_work-"


class Conflict(RuntimeError):
    """Other writers published first at every try."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _folders(spark: SparkSession, root: str) -> list[tuple[str, float]]:
    """Names and times of change (seconds) of what stands in a set's folder."""
    p = _path(spark, root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(p)] if fs.exists(p) else []


def _delete(spark: SparkSession, path: str) -> None:
    p = _path(spark, path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published versions, ascending."""
    return sorted(int(n.removeprefix(_VERSION)) for n, _ in _folders(spark, root) if n.startswith(_VERSION))


def _place(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/{_VERSION}{number:012d}"


def read_results(spark: SparkSession, root: str, schema: T.StructType, number: int | None = None) -> DataFrame:
    """The last version, or a numbered one; no rows where nothing was published."""
    known = versions(spark, root)
    if number is not None and number not in known:
        raise FileNotFoundError(f"no version {number} in {root}")
    return spark.read.schema(schema).parquet(_place(root, number or known[-1])) if known else spark.createDataFrame([], schema)


def _publish(spark: SparkSession, work: str, root: str, number: int) -> bool:
    """Renames a working folder to a version; False if that number is taken."""
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, root).toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(_path(spark, work), _path(spark, _place(root, number)), none)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def replace_results(rows: DataFrame, root: str, before: int | None = None) -> int:
    """Publishes rows as the whole set and returns the version's number. before: the number that the rows were made
    from (0 for none); Conflict if another version was published since."""
    spark = rows.sparkSession
    number = (([0] + versions(spark, root))[-1] if before is None else before) + 1
    work = f"{root.rstrip('/')}/{_WORK}{uuid.uuid4().hex}"
    try:
        rows.write.parquet(work)
        if _publish(spark, work, root, number):
            return number
    except BaseException:
        _delete(spark, work)
        raise
    _delete(spark, work)
    raise Conflict(f"version {number} of {root} is taken")


def merge_results(rows: DataFrame, root: str, key: str, tries: int = 10) -> int:
    """Earlier rows whose key is not among the new ones, and the new rows, as the next version; returns its number.
    The new rows are computed once, and merged again where another writer came first."""
    spark, rows = rows.sparkSession, stored(rows)
    for _ in range(tries):
        last = ([0] + versions(spark, root))[-1]
        old = read_results(spark, root, rows.schema, last) if last else None
        try:
            return replace_results(rows if old is None else old.join(rows.select(key), key, "left_anti").select(rows.columns).unionByName(rows), root, last)
        except Conflict:
            continue
    raise Conflict(f"{tries} tries to add to {root}")


def clean_results(spark: SparkSession, root: str, keep: int = 2, work_seconds: float = 86_400) -> None:
    """Deletes all but the last `keep` versions, and working folders that have not changed for `work_seconds`."""
    for number in versions(spark, root)[: -max(1, keep)]:
        _delete(spark, _place(root, number))
    for name, changed in _folders(spark, root):
        if name.startswith(_WORK) and changed < time.time() - work_seconds:
            _delete(spark, f"{root.rstrip('/')}/{name}")
