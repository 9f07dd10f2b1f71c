"""What the third review found of memory and time in B01, J08, T08, T09, T16, T28, T33, H02, H05, H12, H13 and H16."""

import hashlib
import math
from collections import defaultdict

from plumbline import catalog
from plumbline.functions import perturb as H
from plumbline.functions import spans as P
from plumbline.functions import structured as S
from plumbline.functions import text as T
from plumbline.operators import joins as J
from plumbline.operators import resample as R
from pyspark.sql import functions as F

from .test_review_r03 import shuffled


def test_sizes_of_slots_do_not_stand_on_each_cluster(spark):
    """the sizes of all slots were copied to every cluster, so a task's memory grew with clusters times slots."""
    rows = spark.range(8000).select("id", (F.col("id") % 20).cast("double").alias("v"))
    run = lambda: R.fixed_bootstrap(rows, "id", {"v": F.col("v"), "n": F.lit(1)}, F.col("v") / F.col("n"), 2, 3, slot=20).first()
    got = []
    assert shuffled(spark, lambda: got.append(run())) < 2**22
    assert math.isclose(got[0]["mean"], 9.5, abs_tol=0.3)


def planned(spark, rows):
    """The optimized plan as text, whole."""
    for key in ("spark.sql.debug.maxToStringFields", "spark.sql.maxPlanStringLength"):
        spark.conf.set(key, "100000000")
    return rows._jdf.queryExecution().optimizedPlan().toString()


def claims_of_one(spark, *texts):
    return spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "claim_id string, claim string")


def test_distances_try_a_narrow_band_first(spark):
    """the whole table was filled for every pair; the distances are the same ones in every band."""
    pairs = [("abc", "abc"), ("left lung", "right lung"), ("", "abc"), ("a" * 10, "b" * 10), ("kitten" * 9, "sitting" * 9), (None, "a"), ("äöü", "aou")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = rows.select(T.edit_distance(F.col("a"), F.col("b")).alias("d"), F.levenshtein("a", "b").alias("e")).collect()
    assert [r.d for r in got] == [r.e for r in got] and max(r.d or 0 for r in got) > 16


def test_scores_of_rules_are_worked_out_once(spark):
    """the score stood three times in the plan of T33."""
    assert planned(spark, catalog.queries()["T33_rule_based_score"](spark, "/root/testdata/sf0.001")).count("exists(") == 2  # one in the other
    rows = spark.createDataFrame([("left effusion seen", "no effusion on the left"), ("left effusion", "mild effusion"), (None, "no"), ("a", None)], "c string, e string")
    assert [r.s for r in rows.select(T.contradiction_score(F.col("c"), F.col("e")).alias("s")).collect()] == [1, 0, 0, None]


def test_categories_lower_a_text_once(spark):
    """the text was lower-cased for every keyword, and the best category looked for twice."""
    rows = claims_of_one(spark, "Pleural EFFUSION", "rib fracture and normal", "nothing", None)
    out = rows.select(T.category_by_count(F.col("claim")).alias("c"))
    assert planned(spark, out).count("lower(") == 1
    assert [r.c for r in out.collect()] == ["Pleural Effusion", "Fracture", "Rare/Other", "Rare/Other"]


def test_changes_of_claims_are_worked_out_once(spark):
    """the new text of a structured claim stood three times in the plan, with its draws."""
    claim = F.lit(None).cast(S.CLAIM)
    rows = spark.range(1).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") >= 0, F.struct(F.lit("A mild edema.").alias("text"), F.lit("Edema").alias("category"), F.array().cast(f"array<{S.ENTITY}>").alias("entities"), F.lit(False).alias("negated"), F.lit("left").alias("laterality"), F.lit("mild").alias("severity"), F.lit("").alias("anatomy"))).otherwise(claim).alias("claim"))
    out = rows.repartition(2).select(S.apply("severity_swap", F.col("claim"), F.col("k"), 1).alias("x"))
    assert planned(spark, out).count("regexp_replace(") == 1
    assert out.first().x.severity in ("moderate", "severe")


def test_draws_of_kinds_are_sorted_as_digits(spark):
    """each of the ten draws was made a number before they were sorted."""
    rows = claims_of_one(spark, "There is a mild left pneumothorax.")
    drawn = planned(spark, H.compound(rows, 2, 33)).count("conv(")
    assert drawn < 20  # those that choose sizes and phrases


def test_only_words_that_a_rule_names_are_taken_apart(spark):
    """a pattern and a hash were tried on every word for every rule."""
    rows = spark.createDataFrame([(1, "There is a Left, mild new. thing left")], "report_id long, text string")
    out = H.rewrite_report(rows, [{"left": "right"}, {"right": "left", "new": "old"}], 1.0, 3)
    assert " IN (" in planned(spark, out)
    assert out.first().new_text == "There is a left, mild old. thing left"


def test_low_confidences_merge_without_windows(spark):
    """F32: three sorts of all claims, by windows and a grouping, stood in one task."""
    rows = spark.createDataFrame([(1, 1, "a", "v", 0.1), (1, 2, "b", "x", 0.2), (1, 3, "c", "y", 0.9), (1, 4, "d", "v", None), (1, 5, "e", "v", 0.3), (2, 1, "f", None, 0.4)], "report_id long, pos int, claim string, category string, confidence double")
    out = P.merge_low_confidence(rows, 0.5, "v")
    assert "Window" not in planned(spark, out)
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 1, "a b", "x", 0.2), (1, 2, "c", "y", 0.9), (1, 3, "d", "v", None), (1, 4, "e", "v", 0.3), (2, 1, "f", "v", 0.4)]


def test_the_first_finding_is_looked_for_once(spark):
    """the grader looked for the claim's first finding once for each of the findings."""
    rows = spark.createDataFrame([("c", "no effusion", "effusion and edema. No effusion")], "claim_id string, claim string, report string")
    out = P.grade_by_vectors(rows)
    assert planned(spark, out).count("cardiac enlargement") < 10
    assert tuple(out.first()) == ("c", "SUPPORTED", "high")


def most_read(spark, run):
    """The rows that the largest task of a run read from shuffles."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    one = gateway.new_array(gateway.jvm.double, 1)
    one[0] = 1.0

    def tasks():
        sc.listenerBus().waitUntilEmpty()
        every = gateway.jvm.java.util.ArrayList()
        found = sc.statusStore().stageList(every, False, False, gateway.new_array(gateway.jvm.double, 0), every)
        return {(x.stageId(), x.attemptId()) for x in (found.apply(i) for i in range(found.size())) if x.numCompleteTasks()}

    before = tasks()
    run()
    read = (sc.statusStore().taskSummary(*x, one) for x in tasks() - before)
    return max(x.get().shuffleReadMetrics().readRecords().apply(0) for x in read if x.isDefined())


def mismatched(rows, seed):
    """(claim_id, other_id) by whole sorted categories."""
    of = defaultdict(list)
    for c, p, g in sorted(rows, key=lambda r: (hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest()[:8], r[0])):
        of[g].append((c, p))
    names, out = sorted(of), set()
    for j, g in enumerate(names):
        for k, (c, p) in enumerate(of[g]):
            served = (of[names[(j + d) % len(names)]] for d in range(1, len(names)))
            other = next((o for o in served if any(q != p for _, q in o)), [])
            turn = [other[(k + d) % len(other)] for d in range(len(other))]
            out |= {(c, next(o for o, q in turn if q != p))} if other else set()
    return out


def test_no_task_ranks_a_whole_category(spark, monkeypatch):
    """a window held each category as a whole; slots of it give the same rows, and a small category has no hot rows."""
    monkeypatch.setattr(J, "SLOT", 500, raising=False)
    monkeypatch.setattr(J, "TASK", 1000, raising=False)
    rows = [(f"c{i}", f"p{i % 900}" if i % 5 else "hot", "ab"[i % 2]) for i in range(8000)] + [(f"d{i}", f"p{i}", "c") for i in range(3)]
    claims, got = spark.createDataFrame(rows, "claim_id string, patient_id string, g string"), []
    assert most_read(spark, lambda: got.extend(J.mismatched_evidence(claims, "g", 9).collect())) < 3900
    assert len(got) == len(rows) and set(map(tuple, got)) == mismatched(rows, 9)


def test_runs_of_one_patient_cross_slots(spark, monkeypatch):
    """the next patient may stand several slots on, or before the first one; whole categories may be one patient's."""
    rows = [(f"{g}{i}", "hot" if i % 29 else f"p{i}", g) for g, n in (("a", 90), ("b", 60)) for i in range(n)]
    rows += [(f"{g}{i}", p, g) for g, p, n in (("c", "hot", 40), ("d", "hot", 3), ("e", "q", 20)) for i in range(n)]
    claims = spark.createDataFrame(rows, "claim_id string, patient_id string, g string")
    for slot, task in ((1, 10**6), (4, 20)):
        monkeypatch.setattr(J, "SLOT", slot, raising=False)
        monkeypatch.setattr(J, "TASK", task, raising=False)
        got = J.mismatched_evidence(claims, "g", 9).collect()
        assert len(got) == len(rows) and set(map(tuple, got)) == mismatched(rows, 9)
