"""Versioned result sets: failed writes, two writers, cleaning."""

import pytest
from pyspark.sql import functions as F

from plumbline.sources import results as R

SCHEMA = "id string, v int"


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/set"


def rows(spark, *values):
    return spark.createDataFrame([*values], SCHEMA)


def held(spark, root, number=None):
    return sorted(map(tuple, R.read_results(spark, root, rows(spark).schema, number).collect()), key=str)


def test_missing_first_and_later_versions(spark, root):
    assert held(spark, root) == []
    assert R.merge_results(rows(spark, ("a", 1), ("b", 1), (None, 1)), root, "id") == 1
    assert R.merge_results(rows(spark, ("b", 2), ("c", 2), ("c", 2), (None, 2)), root, "id") == 2
    new = [("a", 1), ("b", 2), ("c", 2), ("c", 2), (None, 1), (None, 2)]
    assert held(spark, root) == sorted(new, key=str)
    assert held(spark, root, 1) == sorted([("a", 1), ("b", 1), (None, 1)], key=str)
    assert R.merge_results(rows(spark), root, "id") == 3 and held(spark, root) == sorted(new, key=str)
    with pytest.raises(FileNotFoundError):
        R.read_results(spark, root, rows(spark).schema, 9)


def test_a_failed_write_leaves_the_last_version(spark, root, tmp_path):
    R.replace_results(rows(spark, ("a", 1)), root)
    broken = rows(spark, ("b", 2)).withColumn("v", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        R.replace_results(broken, root)
    assert held(spark, root) == [("a", 1)] and [p.name for p in (tmp_path / "set").iterdir()] == ["version-000000000001"]


def test_a_writer_that_comes_second_loses_nothing(spark, root, monkeypatch):
    R.merge_results(rows(spark, ("a", 1)), root, "id")
    publish, met = R._publish, []

    def late(spark_, work, root_, number):
        if not met:  # another writer publishes between this one's read and its rename
            met.append(number)
            R.merge_results(rows(spark, ("b", 2)), root, "id")
        return publish(spark_, work, root_, number)

    monkeypatch.setattr(R, "_publish", late)
    assert R.merge_results(rows(spark, ("c", 3)), root, "id") == 3
    assert met == [2] and held(spark, root) == [("a", 1), ("b", 2), ("c", 3)]
    with pytest.raises(R.Conflict):
        R.replace_results(rows(spark, ("z", 0)), root, 1)
    assert held(spark, root) == [("a", 1), ("b", 2), ("c", 3)]


def test_cleaning(spark, root, tmp_path):
    for k in range(4):
        R.replace_results(rows(spark, ("a", k)), root)
    (tmp_path / "set" / "_work-left").mkdir()
    R.clean_results(spark, root, keep=2)
    assert R.versions(spark, root) == [3, 4] and (tmp_path / "set" / "_work-left").exists()
    R.clean_results(spark, root, keep=0, work_seconds=-5)
    assert R.versions(spark, root) == [4] and not (tmp_path / "set" / "_work-left").exists()
    assert R.replace_results(rows(spark, ("b", 9)), root) == 5 and held(spark, root) == [("b", 9)]
