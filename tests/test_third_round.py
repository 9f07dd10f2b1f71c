"""Structured perturbations, files and report ids, exact quantiles, small pools: cases by hand and against plain versions."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from plumbline import vocabulary as V
from plumbline.functions import structured as S
from plumbline.functions.text import alnum_tokens
from plumbline.operators import agreement, joins, ranks, selection
from plumbline.sources import tables

SCHEMA = f"claim_id string, report_id int, claim {S.CLAIM}"


def claim(text, category="Consolidation", entities=(), negated=False, laterality=None, severity=None, anatomy=None):
    return text, category, entities and list(entities), negated, laterality, severity, anatomy


def made(spark, kind, *claims, seed=3):
    rows = spark.createDataFrame([(f"c{i}", 1, c) for i, c in enumerate(claims)], SCHEMA)
    got = {r.claim_id: r for r in S.structured_negatives(rows, (kind,), 1, seed).collect()}
    return [got.get(f"c{i}") and got[f"c{i}"].claim for i in range(len(claims))]


def test_sides(spark):
    got = made(spark, "laterality_swap", claim("Left-sided effusion at left base", laterality="left"), claim("Opacity in the RLL", laterality="right"), claim("Bilateral left", laterality="bilateral"), claim("left lung"), claim("no side word", laterality="left"), claim(None, laterality="left"), claim(" ", laterality="left"))
    assert [g and (g.text, g.laterality) for g in got] == [("right-sided effusion at left base", "right"), ("Opacity in the LLL", "left"), None, None, None, None, None]


def test_negation(spark):
    got = made(spark, "negation", claim("No evidence of pneumonia", negated=True), claim("Heart without edema", negated=True), claim("no signs of edema", negated=True), claim("Edema absent", negated=True), claim("Tube with tip high"), claim("Pneumonia"), claim(""))
    assert [g and (g.text, g.negated) for g in got] == [("Pneumonia", False), ("Heart with edema", False), ("Edema", False), None, ("Tube without tip high", True), ("No evidence of pneumonia", True), None]


def test_findings_keep_the_region_and_are_new(spark):
    texts = [claim(f"Small pleural effusion {i}", "Pleural Effusion", [("lobe", False), ("pleural effusion", True)]) for i in range(30)]
    got = made(spark, "finding_substitution", *texts, claim("Clear", "No Finding"), claim("odd words", "Fracture", [("rib", True)]))
    for g in got[:30]:
        new = g.text.removeprefix("Small ").rsplit(" ", 1)[0]
        assert new in V.REGION_FINDINGS["pleura"] and new != "pleural effusion"
    assert len({g.text.rsplit(" ", 1)[0] for g in got[:30]}) > 2
    assert got[30] is None
    assert got[31].text.endswith(" noted") and "rib" not in got[31].text and got[31].text.removesuffix(" noted") in V.REGION_FINDINGS["bone"]


def test_regions_tiers_times_devices(spark):
    assert [made(spark, "region_swap", claim("Mass in the mediastinum", anatomy="mediastinum"))[0].anatomy != "mediastinum", made(spark, "region_swap", claim("Mass"))[0].text.startswith("Mass in the ")] == [True, True]
    mild = made(spark, "severity_swap", *(claim(f"small mass {i}", severity="mild") for i in range(20)), claim("small mass"), claim("mass", severity="mild"))
    assert all(g.severity in ("moderate", "severe") and g.text.rsplit(" mass", 1)[0] in V.SEVERITY_TIERS[g.severity] for g in mild[:20])
    assert {g.severity for g in mild[:20]} == {"moderate", "severe"} and mild[20:] == [None, None]
    time = made(spark, "temporal_error", claim("Stable NEW mass"), claim("mass"))
    assert time[0].text.removeprefix("Stable ").removesuffix(" mass") in V.TEMPORAL_OPPOSITES["new"] and time[1] is None
    device = made(spark, "device_error", claim("Line in good position", "Support Devices"), claim("ETT is malpositioned", "Support Devices"), claim("ett high", "Support Devices"), claim("Line in good position"), claim("wire", "Support Devices"))
    assert device[0].text.removeprefix("Line ") in V.BADLY_PLACED and device[1].text.removeprefix("ETT is ") in V.WELL_PLACED
    assert device[2].text.removesuffix(" high") in V.DEVICE_TYPES and not device[2].text.lower().startswith("ett ") and device[3:] == [None, None]


def test_omission_stands_nowhere_in_the_report(spark):
    """A report of most findings, one of all, and one whose claim's own region is used up."""
    names = sorted({f for f, _ in S.CATALOGUE})
    bone = V.REGION_FINDINGS["bone"]
    rows = [("a", 1, claim("Rib fracture", "Fracture"))] + [(f"a{i}", 1, claim(f"There is {n}", "Other")) for i, n in enumerate(names) if n != "hilar mass"]
    rows += [("b", 2, claim("words", "Fracture"))] + [(f"b{i}", 2, claim("words", "Fracture", [(n.upper(), True)])) for i, n in enumerate(names)]
    rows += [("c", 3, claim("Rib fracture", "Fracture", [(n, True) for n in bone]))]
    rows += [(f"d{i}", 4, claim("Clavicle fracture", "Fracture", None)) for i in range(20)]
    got = {r.claim_id: r for r in S.structured_negatives(spark.createDataFrame(rows, SCHEMA), ("omission",), 1, 5).collect()}
    assert got["a"].claim.text == "Hilar mass at the hilum" and got["a"].claim.anatomy == "hilum" and got["a"].label == 2
    assert not any(k.startswith("b") for k in got)
    assert not any(n in got["c"].claim.text.lower() for n in bone)
    for i in range(20):
        found = got[f"d{i}"].claim.text.lower().removesuffix(" involving the osseous structures")
        assert found in bone and found != "clavicle fracture"


def test_dispatcher(spark):
    rows = [(f"c{i}", i, claim("Stable small left effusion without fluid", "Pleural Effusion", [("effusion", True)], True, "left", "mild", None)) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = S.structured_negatives(df, tuple(S.LABELS), 3, 9).collect()
    again = S.structured_negatives(df.repartition(3), tuple(S.LABELS), 3, 9).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    per = {}
    for r in got:
        per.setdefault(r.claim_id, []).append(r)
    assert all(len(v) == 3 and len({x.claim.text.lower() for x in v}) == 3 for v in per.values()) and len(per) == 40
    assert {r.kind for r in got} == set(S.LABELS) - {"device_error"}
    assert all(r.label == (2 if r.kind == "omission" else 1) for r in got)
    with pytest.raises(ValueError, match="no structured"):
        S.structured_negatives(df, ("other",), 3, 9)


def test_files_meet_report_ids_that_contain_them(spark):
    rng = random.Random(6)
    ids = ["CXR1", "study-CXR1-x", "study-CXR12", "p", "ab", *("".join(rng.choices("abp12-", k=rng.randint(1, 9))) for _ in range(300)), None]
    files = ["CXR1_2.png", "CXR12_1.png", "CXR123.png", "p_1.png", "_1.png", *("".join(rng.choices("abp12", k=rng.randint(1, 6))) + "_x.png" for _ in range(200))]
    got = {r.image_file: r.report_id for r in joins.match_files(spark.createDataFrame([(f,) for f in files], "image_file string"), spark.createDataFrame([(i,) for i in ids], "report_id string")).collect()}
    known = [i for i in ids if i]

    def plain(f):
        prefix = f.removesuffix(".png").split("_")[0]
        return None if not prefix else prefix if prefix in known else min((i for i in known if prefix in i), default=None)

    assert got == {f: plain(f) for f in files}
    assert got["CXR1_2.png"] == "CXR1" and got["CXR12_1.png"] == "study-CXR12" and got["CXR123.png"] is None


def test_quantiles(spark):
    rng = random.Random(7)
    rows = [(g, rng.choice([rng.random(), 0.5, None])) for g in "abc" for _ in range(rng.randint(1, 400))] + [("one", 0.25)]
    df = spark.createDataFrame(rows, "g string, score double")
    got = {r.g: (r.quantile, r.n) for r in ranks.quantile(df, "score", 0.25, ["g"]).collect()}
    want = {r.g: (r.q, r.n) for r in df.groupBy("g").agg(F.percentile("score", 0.25).alias("q"), F.count("score").alias("n")).collect()}
    assert set(got) == set(want) and all(got[g][1] == want[g][1] and abs(got[g][0] - want[g][0]) < 1e-12 for g in want)


def test_running_plans_its_input_once(spark):
    from plumbline.catalog import queries

    plan = queries()["C08_canonical_triage"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and plan.count("parquet") <= 40
    assert "percentile(" not in plan


def test_small_pools_lose_no_claims(spark):
    claims = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(["alpha beta", "nothing shared", "zzz", "qqq"])], "claim_id string, claim string")
    pool = spark.createDataFrame([("p1", "alpha one"), ("p2", "two three"), ("p3", "four five")], "passage_id string, text string")
    got = {r.claim_id: r.evidence for r in joins.pooled_evidence(claims, pool, alnum_tokens, 5).collect()}
    assert set(got) == {"c0", "c1", "c2", "c3"} and got["c0"] == ["alpha one"]
    assert all(len(set(got[c])) == 2 for c in ("c1", "c2", "c3"))
    assert joins.pooled_evidence(claims, pool.where("false"), alnum_tokens, 5).collect() == []


def test_short_vectors(spark):
    rng = random.Random(1)
    rows = lambda n, at: spark.createDataFrame([([rng.gauss(at, 1) for _ in range(3)],) for _ in range(n)], "vector array<double>")
    out = selection.density_ratio(rows(60, 0.0), rows(60, 2.0)).collect()
    mean = lambda test: statistics.mean(r.weight for r in out if r.is_test == test)
    assert len(out) == 120 and mean(True) > mean(False)
    with pytest.raises(ValueError, match="no rows"):
        selection.density_ratio(rows(1, 0.0).where("false"), rows(1, 0.0).where("false"))


def test_one_coder_is_an_error(spark):
    from pyspark.errors import PySparkException

    one = spark.createDataFrame([(1, "a", 1.0), (2, "a", 0.0)], "unit_id int, coder string, value double")
    with pytest.raises(PySparkException, match="no unit has two codings"):
        agreement.krippendorff(one).collect()


def test_scratch_needs_a_shared_folder_on_clusters(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.scratch(Session())
