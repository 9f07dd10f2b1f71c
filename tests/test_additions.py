"""Retrieval hooks, fits, studies and result sets on small rows."""

import math
import os

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import retrieval as R
from plumbline.operators import selection as X
from plumbline.operators import studies as D
from plumbline.sources import tables as S


def test_dense_with_text_ids(spark):
    items = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0])], "id string, vector array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "id long, vector array<double>")
    got = R.dense(items, asked, 2).orderBy("rank").collect()
    assert [(r.query_id, r.passage_id, r.score) for r in got] == [(7, "a", 1.0), (7, "b", 1.0)]
    none = R.dense(items, asked.limit(0), 2)
    assert none.count() == 0 and dict(none.dtypes)["passage_id"] == "string"


def test_hashed_vector_counts_words(spark):
    row = spark.createDataFrame([("a b a",), ("",), (None,)], "text string").select(R.hashed_vector(T.alnum_tokens(F.col("text")), 16).alias("v")).collect()
    assert sum(row[0].v) == 3 and max(row[0].v) in (2.0, 3.0) and sum(row[1].v) == 0 and len(row[1].v) == 16


def test_pair_scorer_loads_once_a_task_and_takes_nulls(spark):
    rows = spark.createDataFrame([("a b", "b c"), (None, "b"), ("a", None), ("", "x")], "q string, t string")
    scorer = R.pair_scorer(R.load_word_overlap)
    assert [r[0] for r in rows.select(scorer("q", "t")).collect()] == [0.5, 0.0, 0.0, 0.0]


def test_fusing_nothing_is_an_error():
    with pytest.raises(ValueError):
        R.union_of_lists()


def test_temperature_is_the_least_loss(spark):
    pairs = [(2.0, 1)] * 8 + [(2.0, 0)] * 2 + [(-2.0, 0)] * 8 + [(-2.0, 1)] * 2
    rows = spark.createDataFrame(pairs, "z double, y int")
    got = X.fit_temperature(rows, "z", "y", tolerance=1e-4).first()
    assert abs(got.temperature - 2.0 / math.log(4)) < 1e-3  # sigmoid(2 / T) = 0.8
    assert X.fit_temperature(rows.limit(0), "z", "y").count() == 0


def test_distances(spark):
    rows = [("i", 0, 0.9, 3, ["a"], "p q"), ("i", 1, 0.9, 3, ["a"], "p q"), ("i", 2, 0.9, 3, ["b"], "x y")]
    c = spark.createDataFrame(rows, "image string, idx int, faithfulness double, coverage int, items array<string>, text string")
    for name in X.DISTANCES:
        assert X.least_risk(c, distance=name).first().idx == 0
    with pytest.raises(ValueError):
        X.least_risk(c, distance="other")


def test_ablations_by_name(spark):
    rows = spark.createDataFrame([(f"c{i}", i // 4, i % 4 + 1, "p", i % 2, 0.1 if i % 2 else 0.9, i % 8 < 4) for i in range(80)], "claim_id string, report_id int, line int, pathology string, label int, score double, cal boolean")
    got = {r.condition: r for r in D.run_ablations(rows, ["base", "best_of_4", "global_threshold"], F.col("cal"), 0.2).collect()}
    assert got["base"].n == 40 and got["base"].n_green == 20 and got["base"].fdr == 0
    assert got["best_of_4"].n == 10 and got["global_threshold"].delta_fdr == 0
    with pytest.raises(ValueError):
        D.run_ablations(rows, ["none"], F.col("cal"))


def test_unreadable_results_count_as_none(spark, tmp_path):
    path = tmp_path / "results"
    os.makedirs(path)
    (path / "part-0.parquet").write_bytes(b"not parquet at all")
    new = S.add_results(spark.createDataFrame([("a", 1)], "claim_id string, v int"), f"file://{path}", "claim_id")
    assert [tuple(r) for r in spark.read.parquet(new).collect()] == [("a", 1)]
    assert (path / "part-0.parquet").exists()
