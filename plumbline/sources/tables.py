"""Sources and sinks: metadata, splits, reports in several formats, annotations, scored claims, result sets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocabulary as V


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; where that is unset, a temporary one in local sessions and an error in others."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """The rows, written once as Parquet and read again, so that several uses do not compute them anew."""
    path = scratch(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt by a key of many values to as many tasks as shuffles have, since a table in one row group is read by one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), key)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: Parts of column names and what they become; the first column that fits is taken.
ALIASES = {"patient_id": ("patient", "subject"), "study_id": ("study",), "path": ("path",), "sex": ("sex", "gender")}


def standard_columns(rows: DataFrame) -> DataFrame:
    """Renames the first column that contains an alias; patient_id is the first part of path where no column gives it."""
    taken: set[str] = set()
    for name, parts in ALIASES.items():
        if name in rows.columns:
            continue
        hit = next((c for c in rows.columns if c not in taken and any(p in c.lower() for p in parts)), None)
        if hit:
            rows = rows.withColumnRenamed(hit, name)
            taken.add(name)
    if "patient_id" not in rows.columns and "path" in rows.columns:
        rows = rows.withColumn("patient_id", F.split("path", "/")[0])
    return rows


def read_metadata(spark: SparkSession, root: str, schema: T.StructType, names: tuple[str, ...] = ("metadata.csv", "reports.csv", "train.csv", "data.csv")) -> DataFrame:
    """The first of the named files that exists, with standard column names."""
    for n in names:
        if exists(spark, f"{root}/{n}"):
            return standard_columns(spark.read.schema(schema).option("header", True).option("multiLine", True).csv(f"{root}/{n}"))
    raise FileNotFoundError(f"none of {names} in {root}")


def write_splits(splits: DataFrame, seed: int, path: str | None = None) -> str:
    """Ids by split, partitioned by split, with the seed; returns the path."""
    path = path or scratch(splits.sparkSession)
    splits.withColumn("seed", F.lit(seed)).write.partitionBy("split").mode("overwrite").parquet(path)
    return path


def read_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if split is None else rows.where(F.col("split") == split)


def adapt_schema(rows: DataFrame) -> DataFrame:
    """(patient_id, text) from either of two layouts: sections by patient, or one report text by study."""
    if {"deid_patient_id", "section_findings"} <= set(rows.columns):
        return rows.select(F.col("deid_patient_id").alias("patient_id"), F.concat_ws(" ", "section_findings", "section_impression").alias("text"))
    if {"patient_id", "report"} <= set(rows.columns):
        return rows.select("patient_id", F.col("report").alias("text"))
    raise ValueError(f"no known layout in {rows.columns}")


def null_texts(rows: DataFrame, *columns: str) -> DataFrame:
    """Empty strings and the text nan become null."""
    return rows.withColumns({c: F.when(~F.lower(F.trim(c)).isin("", "nan", "none"), F.col(c)) for c in columns})


def term_labels(rows: DataFrame, terms: Column, mapping: list[tuple[str, str]], labels: tuple[str, ...], key: str = "report_id") -> DataFrame:
    """(key, one 0/1 column per label): each term's first mapping whose part it contains; none or normal means No Finding."""
    part = F.coalesce(*(F.when(F.contains(F.lower(F.col("t")), F.lit(p)), l) for p, l in mapping))
    flat = rows.select(key, F.explode_outer(F.when(F.size(terms) > 0, terms)).alias("t")).select(key, F.when(F.col("t").isNull() | (F.lower(F.trim("t")) == "normal"), V.NO_FINDING).otherwise(part).alias("label"))
    return flat.groupBy(key).agg(*(F.max(F.when(F.col("label") == l, 1).otherwise(0)).alias(l) for l in labels))


def read_xml_reports(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """(uid, findings, impression, terms) of report files, one report for each file (or line, if not whole); those without either section go, XXXX becomes redacted, terms are cut at /."""
    schema = T.StructType().add("uId", T.StructType().add("_id", "string")).add("MedlineCitation", T.StructType().add("Article", T.StructType().add("Abstract", T.StructType().add("AbstractText", T.ArrayType(T.StructType().add("_Label", "string").add("_VALUE", "string")))))).add("MeSH", T.StructType().add("major", T.ArrayType(T.StringType())))
    rows = spark.read.text(path, wholetext=whole).select(F.from_xml("value", schema).alias("x")).select("x.*")
    sections = F.col("MedlineCitation.Article.Abstract.AbstractText")
    of = lambda n: F.regexp_replace(F.get(F.filter(sections, lambda x: x["_Label"] == n), F.lit(0))["_VALUE"], "XXXX", "redacted")
    out = rows.select(F.col("uId._id").alias("uid"), of("FINDINGS").alias("findings"), of("IMPRESSION").alias("impression"), F.transform(F.coalesce("MeSH.major", F.array().cast("array<string>")), lambda t: F.trim(F.split(t, "/")[0])).alias("terms"))
    return null_texts(out, "findings", "impression").where("findings is not null or impression is not null")


_REPORT = "struct<text:string,entities:map<string,struct<tokens:string,label:string,start_ix:int,end_ix:int,relations:array<array<string>>>>>"


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities (report_id, entity_id, tokens, label, start_ix, end_ix) and relations (report_id, source_id, kind, target_id) of nested JSON files, each an object by report, read by ranges."""
    from .records import read_json_objects

    raw = read_json_objects(spark, path).select(F.col("key").alias("report_id"), F.from_json("value", _REPORT).alias("r"))
    entities = raw.select("report_id", F.explode("r.entities").alias("entity_id", "e")).select("report_id", "entity_id", "e.*")
    relations = entities.select("report_id", F.col("entity_id").alias("source_id"), F.explode("relations").alias("x")).select("report_id", "source_id", F.get("x", F.lit(0)).alias("kind"), F.get("x", F.lit(1)).alias("target_id"))
    return entities.drop("relations"), relations


def read_scored_claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims of JSON files that are a list or hold one under `claims`, read by ranges; a missing required field is an error."""
    from .records import read_json_objects

    one = "struct<claim:string,pathology:string,patient_id:string,label:int,score:double>"
    rows = read_json_objects(spark, path, 1, 2).select(F.from_json("value", one).alias("c")).select("c.*")
    missing = F.lit(False)
    for c in rows.columns:
        missing = missing | F.col(c).isNull()
    return rows.withColumn("score", F.when(missing, F.raise_error(F.lit("a claim lacks a required field")).cast("double")).otherwise(F.col("score")))


def read_reports(spark: SparkSession, path: str, n: int | None = None, fields: tuple[str, ...] = ("report", "text", "section_findings")) -> DataFrame:
    """(text) from CSV, JSON lines or a JSON list, by the first field that is there; the first n in text order if asked."""
    if path.endswith(".csv"):
        rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    elif path.endswith(".jsonl"):
        rows = spark.read.json(path)
    else:
        rows = spark.read.option("multiLine", True).json(path)
    have = [F.col(f) for f in fields if f in rows.columns]
    if not have:
        raise ValueError(f"none of {fields} in {path}")
    out = rows.select(F.coalesce(*have).alias("text")).where("text is not null")
    return out if n is None else out.orderBy("text").limit(n)


def resolve_text(rows: DataFrame, files: DataFrame, inline: tuple[str, ...]) -> DataFrame:
    """Adds text: the first inline column that is not null, else the file's contents. files: path, contents."""
    return rows.join(files.select("path", F.col("contents").alias("_c")), "path", "left").withColumn("text", F.coalesce(*map(F.col, inline), F.col("_c"))).drop("_c")


def write_flat(rows: DataFrame, path: str, arrays: tuple[str, ...] = ()) -> None:
    """A CSV sink with arrays joined by semicolons."""
    flat = rows.withColumns({c: F.array_join(c, ";") for c in arrays})
    flat.write.mode("overwrite").option("header", True).csv(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Earlier results, or none where the path does not exist; files that cannot be read count as none, and stay where they are."""
    return spark.read.option("ignoreCorruptFiles", "true").schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def add_results(rows: DataFrame, path: str, key: str) -> str:
    """Earlier results and new rows, new ones winning, to a new place beside the old; returns it. Old files stay until the new ones are whole."""
    spark = rows.sparkSession
    old = read_or_empty(spark, path, rows.schema)
    new = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    old.join(rows.select(key), key, "left_anti").unionByName(rows).write.parquet(new)
    return new
