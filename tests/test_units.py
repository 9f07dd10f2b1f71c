"""Published values, truth tables and edge cases on small frames."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import perturb as H
from plumbline.functions import provenance as P
from plumbline.functions import text as T
from plumbline.operators import agreement as G
from plumbline.operators import conformal as C
from plumbline.operators import joins as J
from plumbline.operators import retrieval as R

#: Four coders, twelve units: a published example with alpha .743, .815, .849 and .797.
CODERS = [
    [1, 2, 3, 3, 2, 1, 4, 1, 2, None, None, None],
    [1, 2, 3, 3, 2, 2, 4, 1, 2, 5, None, 3],
    [None, 3, 3, 3, 2, 3, 4, 2, 2, 5, 1, None],
    [1, 2, 3, 3, 2, 4, 4, 1, 2, 5, 1, None],
]


@pytest.mark.parametrize(("level", "value"), [("nominal", 0.743), ("ordinal", 0.815), ("interval", 0.849), ("ratio", 0.797)])
def test_krippendorff_published(spark, level, value):
    rows = [(u, str(c), float(v)) for c, vs in enumerate(CODERS) for u, v in enumerate(vs) if v is not None]
    df = spark.createDataFrame(rows, "unit_id int, coder string, value double")
    assert G.krippendorff(df, level).first().alpha == pytest.approx(value, abs=0.001)


def test_gate_table(spark):
    rows = [(l, t) for l in ("green", "yellow", "red", "other") for t in P.TIERS]
    got = {(r.l, r.t): r.f for r in spark.createDataFrame(rows, "l string, t string").select("l", "t", P.gate(F.col("l"), F.col("t")).alias("f")).collect()}
    assert got["green", "trusted"] == got["green", "independent"] == "supported_trusted"
    assert got["green", "same_model"] == got["green", "unknown"] == "supported_uncertified"
    assert {got["yellow", t] for t in P.TIERS} == {"review_required"}
    assert {got[l, t] for l in ("red", "other") for t in P.TIERS} == {"contradicted"}


def test_tier_needs_both_ids(spark):
    rows = [("generator_output", None, "a"), ("generator_output", "a", "a"), ("generator_output", "a", "b"), ("x", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "s string, c string, e string")
    assert [r[0] for r in df.select(P.trust_tier(F.col("s"), F.col("c"), F.col("e"))).collect()] == ["same_model", "same_model", "independent", "unknown", "unknown"]


def test_p_values_with_ties_and_empty_pool(spark):
    cal = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("a", 0.1)], "g string, score double")
    test = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.6), (3, "a", 0.0), (4, "b", 0.9)], "i int, g string, score double")
    got = {r.i: r.p for r in C.p_values(cal, test, "g").collect()}
    assert got == {1: 0.75, 2: 0.25, 3: 1.0, 4: 1.0}


def test_step_up_is_the_largest_passing_rank(spark):
    ps = [0.01, 0.02, 0.045, 0.05, 0.9]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")
    assert {r.i for r in C.step_up(df, 0.0625).where("accepted").collect()} == {0, 1, 2, 3}
    assert C.step_up(df, 0.001).where("accepted").count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [("There is a 3 mm nodule.", ["fabricated_measurement"]), ("Worse compared to the prior study.", ["fabricated_prior"]), ("Seen on 03/04/2021.", ["fabricated_date"]), ("Seen 3 days ago.", ["fabricated_relative_time"]), ("No change.", [])],
)
def test_flags(spark, text, want):
    assert spark.range(1).select(T.flags(F.lit(text))).first()[0] == want


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (H.negation, "There is no edema.", "There is edema."),
        (H.negation, "Lungs are without edema.", "Lungs are with edema."),
        (H.negation, "The line is fine.", "The line is no fine."),
        (H.negation, "Edema seen", "No edema seen"),
        (H.laterality_swap, "Left pleural effusion on the left.", "right pleural effusion on the left."),
        (H.laterality_swap, "Cardiomegaly on the left.", None),
        (H.severity_swap, "Small nodule", "large nodule"),
        (H.region_swap, "nothing", None),
    ],
)
def test_perturbations(spark, f, text, want):
    assert spark.range(1).select(f(F.lit(text))).first()[0] == want


def test_merging_is_pairwise_and_chaining_is_not(spark):
    text = "There is no edema here. Or any large effusion. And no fracture seen."
    pair, chain = spark.range(1).select(T.merged_sentences(F.lit(text)), T.chained_claims(F.lit(text))).first()
    assert pair == ["There is no edema here, or any large effusion.", "And no fracture seen."]
    assert chain == ["There is no edema here, or any large effusion, and no fracture seen."]


def test_fusion_ties_go_to_the_first_list(spark):
    rows = [(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "b"), (1, 2, 2, "a"), (1, 2, 3, "c")]
    got = R.fuse(spark.createDataFrame(rows, "query_id int, list_no int, rank int, doc_id string")).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        R.fuse(spark.createDataFrame(rows, "query_id int, list_no int, rank int, doc_id string"), 0)


def test_leaks_raise(spark):
    df = spark.createDataFrame([("p", "train"), ("p", "test"), ("q", "train")], "patient_id string, split string")
    with pytest.raises(ValueError, match="p"):
        J.check_disjoint(df)


def test_partitioning_does_not_matter(spark):
    from plumbline import catalog

    q, old, seen = catalog.queries()["C08_canonical_triage"], spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, q(spark, "/root/testdata/sf0.001").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1]


def test_scored_claims_are_stored_by_report(spark, tmp_path, monkeypatch):
    from plumbline.queries import pipelines as Q

    names = iter(["claims", *(f"other{i}" for i in range(9))])  # the claims' file is the first path asked for, the reader's own tables follow
    monkeypatch.setattr(Q.S, "scratch", lambda _: f"file://{tmp_path}/{next(names)}")
    n = Q.s07(spark, "/root/testdata/sf0.001").first().n
    stored = spark.read.text(f"{tmp_path}/claims").select(F.size(F.from_json("value", "struct<claims:array<struct<claim:string>>>")["claims"]).alias("k"))
    reports = Q.claims(spark, "/root/testdata/sf0.001").groupBy("report_id").count()
    assert sorted(r.k for r in stored.collect()) == sorted(r[1] for r in reports.collect())
    assert stored.agg(F.sum("k")).first()[0] == n


def test_extractor_query_extracts(spark, monkeypatch):
    from plumbline.queries import pipelines as Q

    monkeypatch.setattr(Q.T, "claims_of", lambda c: F.when(c.startswith("FINDINGS"), F.array(c)))
    rows = Q.reports(spark, "/root/testdata/sf0.001")
    assert Q.u02(spark, "/root/testdata/sf0.001").first().n == rows.where("text like 'FINDINGS%'").count() < rows.count()


def test_mismatched_evidence_with_a_hot_patient(spark):
    rows = [(f"a{i}", "hot" if i % 3 else f"p{i}", "a") for i in range(60)] + [(f"b{i}", "hot" if i else "q", "b") for i in range(40)] + [(f"c{i}", "hot", "c") for i in range(20)] + [("d0", "hot", "d")]
    got = J.mismatched_evidence(spark.createDataFrame(rows, "claim_id string, patient_id string, g string"), "g", 9).collect()
    of = {c: (p, g) for c, p, g in rows}
    assert sorted(r.claim_id for r in got) == sorted(of)
    assert all(of[r.claim_id][0] != of[r.other_id][0] and of[r.claim_id][1] != of[r.other_id][1] for r in got)
    alone = [("x", "p", "a"), ("y", "p", "b"), ("z", "q", "a")]
    got = J.mismatched_evidence(spark.createDataFrame(alone, "claim_id string, patient_id string, g string"), "g", 9).collect()
    assert {(r.claim_id, r.other_id) for r in got} == {("y", "z"), ("z", "y")}


def test_long_texts_keep_their_end(spark):
    tail = F.concat(F.repeat(F.lit("x"), 1_200_000), F.lit(" END"))
    first = "There is no edema here. "
    rows = spark.range(1).select(tail.alias("t"))
    got = rows.select(T.merged_sentences(F.concat(F.lit(first + "Or any "), "t"))[0], T.chained_claims(F.concat(F.lit(first + "Or any "), "t"))[0], T.without_prompt(F.concat(F.lit("ask: "), "t"), "ask: "), H.negation(F.col("t"))).first()
    assert all(x.endswith(" END") and len(x) > 1_200_000 for x in got)
