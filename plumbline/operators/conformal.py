"""Conformal p-values, step-up selection and triage of scored claims.

Nothing here sorts a whole table or a large group in one task: ranks are running sums over ranges of
distinct values (ranks.running).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import uniform
from ..functions import provenance as P
from ..sources.tables import stored
from .ranks import quantile, ranges, running

RARE = "Rare/Other"


def one_per(rows: DataFrame, key: str, seed: int, *tie: str) -> DataFrame:
    """One row for each key, drawn by a seeded hash of the tie columns."""
    order = Window.partitionBy(key).orderBy(uniform(seed, *(F.col(t).cast("string") for t in tie)), *tie)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def p_values(cal: DataFrame, test: DataFrame, group: str | None = None, score: str = "score", weight: str | None = None) -> DataFrame:
    """Adds p to test: (calibration weight at or above the score + 1) / (all of the group's weight + 1).

    Rows of both sides are ranked together once; a group without calibration gives p = 1."""
    g = F.col(group) if group else F.lit("")
    w = F.col(weight) if weight else F.lit(1.0)
    both = cal.select(g.alias("_g"), F.col(score).alias("_s"), w.cast("double").alias("w"), F.lit(0).alias("n"))
    both = both.unionByName(test.select(g.alias("_g"), F.col(score).alias("_s"), F.lit(0.0).alias("w"), F.lit(1).alias("n")))
    table = ranked_p(both, ["_g"], "_s").where("n = 1").groupBy("_g", "_s").agg(F.first("p").alias("p"))
    return test.withColumn("_g", g).withColumn("_s", F.col(score)).join(table, ["_g", "_s"], "left").withColumn("p", F.coalesce("p", F.lit(1.0))).drop("_g", "_s")


def step_up(rows: DataFrame, alpha: float | Column, by: list[str] | None = None, p: str = "p", small: bool = False) -> DataFrame:
    """Adds accepted: the largest k with p(k) <= k alpha / n sets the threshold, over all rows or within each value of by.

    small: the values of by are many and their groups small, as reports are; else they are few and may be large."""
    by = by or []
    alpha = F.lit(alpha) if isinstance(alpha, (int, float)) else alpha
    counts = rows.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("n"), F.first(alpha).alias("_alpha"))
    if small:
        one = Window.partitionBy(*by)
        ranked = counts.withColumn("n_cum", F.sum("n").over(one.orderBy(p))).withColumn("n_all", F.sum("n").over(one))
    else:
        ranked = running(counts, p, ["n"], by)
    cut = ranked.where(F.col(p) <= F.col("n_cum") / F.col("n_all") * F.col("_alpha")).groupBy(*by).agg(F.max(p).alias("_cut"))
    cut = cut if small else F.broadcast(cut)
    joined = rows.join(cut, by, "left") if by else rows.join(cut, F.lit(True), "left")
    return joined.withColumn("accepted", F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))).drop("_cut")


def ranked_p(rows: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """Adds p, n_cum and n_all to rows (by, value, w, n and further columns): (w at or above the value + 1) / (all w + 1), and test rows so far.

    w is the weight of a calibration row, n is 1 for a test row. Within a group p falls with the value, so one pass by falling
    values gives the p-values and the ranks that step-up selection compares them with; rows are neither counted nor joined first."""
    ranked = running(rows, value, ["w", "n"], by, descending=True)
    return ranked.withColumn("p", (F.col("w_cum") + 1.0) / (F.col("w_all") + 1.0)).drop("w_cum", "w_all")


def step_up_sums(rows: DataFrame, alpha: float, by: list[str], sums: list[str], value: str = "score") -> DataFrame:
    """(by, n, n_green, and for each of sums its sum over the accepted rows) of step-up selection within each group; groups without test rows give none.

    rows as in ranked_p. Sums of the accepted rows are running sums where the last p-value that passes stands; as a row
    without n adds nothing to them, it cannot change them either. None of w, n and sums is negative.

    Sums of ranges of values tell where that may be: behind the last range whose end passes, in ranges where even the weight
    before them and all their test rows would. Only rows of such ranges, which are few, are sorted."""
    every = ["w", "n", *sums]
    placed, known = ranges(rows, value, every, by, descending=True)
    known = stored(known.where("n_all > 0"))  # a row for each range
    passes = lambda w, n: (w + 1.0) / (F.col("w_all") + 1.0) <= n / F.col("n_all") * F.lit(alpha)
    end = {s: F.col(f"_{s}") + F.col(f"{s}_own") for s in every}
    whole = passes(end["w"], end["n"])
    names = (("n", "n_green"), *((s, s) for s in sums))
    coarse = known.groupBy(*by).agg(F.first("n_all").alias("_n_all"), F.min(F.when(whole, F.col("_part"))).alias("_last"), *(F.coalesce(F.max(F.when(whole, end[s])), F.lit(0)).alias(f"_green_{s}") for s, _ in names))
    behind = known.join(F.broadcast(coarse.select(*by, "_last")), by).where(passes(F.col("_w"), end["n"]) & (F.col("_last").isNull() | (F.col("_part") < F.col("_last"))))
    within = Window.partitionBy(*by, "_part").orderBy(F.desc(value))
    sorted_ = placed.select(*by, "_part", value, *every).join(F.broadcast(behind.select(*by, "_part")), [*by, "_part"], "left_semi")
    ranked = sorted_.select(*by, "_part", *(F.sum(s).over(within).alias(f"{s}_cum") for s in every)).join(F.broadcast(behind.drop("_last")), [*by, "_part"])
    cum = {s: F.col(f"{s}_cum") + F.col(f"_{s}") for s in every}
    fine = ranked.where(passes(cum["w"], cum["n"])).groupBy(*by).agg(*(F.max(cum[s]).alias(a) for s, a in names))
    # what passes behind is never less
    return coarse.join(F.broadcast(fine), by, "left").select(*by, F.col("_n_all").alias("n"), *(F.coalesce(F.col(a), F.col(f"_green_{s}")).alias(a) for s, a in names))


def triage_label(accepted: Column, score: Column, tau: Column) -> Column:
    return F.when(accepted, "green").when(score > tau, "yellow").otherwise("red")


def pooled_groups(cal: DataFrame, group: str, least: int, only: Column | None = None) -> DataFrame:
    """(group, effective): groups with fewer than `least` calibration rows (of those that fulfil `only`) share one pool."""
    n = F.count_if(only) if only is not None else F.count("*")
    return cal.groupBy(group).agg(n.alias("_n")).select(group, F.when(F.col("_n") >= least, F.col(group)).otherwise(RARE).alias("effective"))


def _effective(rows: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    return rows.join(F.broadcast(groups), group, "left").withColumn("effective", F.coalesce("effective", F.lit(RARE)))


def calibrate(cal: DataFrame, group: str = "pathology", least: int = 50, low: float = 0.25, null_label: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups with pooling of small ones, and tau per effective group: a quantile of its scores.

    null_label None: tau of all rows, as in group triage; else tau of the rows of that label only."""
    only = None if null_label is None else F.col("label") == null_label
    groups = pooled_groups(cal, group, least, only)
    rows = _effective(cal, groups, group)
    rows = rows if only is None else rows.where(only)
    return groups, quantile(rows, "score", low, ["effective"]).select("effective", F.col("quantile").alias("tau"), F.col("n").alias("n_cal"))


def triage(cal: DataFrame, test: DataFrame, alpha: float = 0.05, group: str = "pathology", least: int = 50, low: float = 0.25, null_label: int = 0, scope: str = "group") -> DataFrame:
    """Adds effective, p, accepted, tau, triage to test.

    null_label: calibration rows of this label give the p-values (0: faithful; 1: contradicted, the canonical way).
    scope: step-up within each effective group, or over all test rows ("global").
    Scores are written once; p-values, ranks and cuts come from them, and test rows meet them in one join."""
    canonical = scope == "global"
    both = stored(cal.select(group, "score", "label", F.lit(True).alias("_cal")).unionByName(test.select(group, "score", F.lit(None).cast("int").alias("label"), F.lit(False).alias("_cal"))))
    groups, taus = calibrate(both.where("_cal"), group, least, low, null_label if canonical else None)
    used = _effective(both.where(~F.col("_cal") | (F.col("label") == null_label)), groups, group)
    used = used.select("effective", "score", F.col("_cal").cast("int").alias("w"), (~F.col("_cal")).cast("int").alias("n"))
    ranked = ranked_p(used, ["effective"]).where("n = 1").groupBy("effective", "score").agg(F.first("p").alias("p"), F.first("n_cum").alias("n_cum"), F.first("n_all").alias("n_all"), F.count("*").alias("n"))
    ranked = stored(ranked)  # for the cuts and for the rows
    by = [] if canonical else ["effective"]
    if canonical:  # over all groups the order of p is another one
        counts = running(ranked.groupBy("p").agg(F.sum("n").alias("n")), "p", ["n"])
    else:
        counts = ranked
    cut = F.broadcast(counts.where(F.col("p") <= F.col("n_cum") / F.col("n_all") * F.lit(alpha)).groupBy(*by).agg(F.max("p").alias("_cut")))
    rows = _effective(test, groups, group).join(ranked.select("effective", "score", "p"), ["effective", "score"], "left").withColumn("p", F.coalesce("p", F.lit(1.0)))
    rows = rows.join(cut, by, "left") if by else rows.join(cut, F.lit(True), "left")
    rows = rows.withColumn("accepted", F.coalesce(F.col("p") <= F.col("_cut"), F.lit(False))).drop("_cut")
    rows = rows.join(F.broadcast(taus.select("effective", "tau")), "effective", "left").withColumn("tau", F.coalesce("tau", F.lit(0.5)))
    return rows.withColumn("triage", triage_label(F.col("accepted"), F.col("score"), F.col("tau")))


def canonical(rows: DataFrame, is_cal: Column, alpha: float = 0.05, group: str = "pathology", least: int = 50, seed: int = 42) -> DataFrame:
    """The canonical triage: one calibration row for each patient, contradicted calibration, global step-up, provenance gate."""
    cal = one_per(rows.where(is_cal), "patient_id", seed, "claim_id")
    out = P.with_provenance(triage(cal, rows.where(~is_cal), alpha, group, least, null_label=1, scope="global"))
    return out.withColumn("final_label", P.gate(F.col("triage"), F.col("evidence_trust_tier")))


def sweep(rows: DataFrame, alphas: list[float], p: str = "p", null_label: int = 1) -> DataFrame:
    """Per alpha, with the same p-values: n_green, coverage, fdr, power. Rows are counted by p and label once."""
    counts = stored(rows.groupBy(p).agg(F.count("*").alias("n"), F.count_if(F.col("label") == null_label).alias("bad")))
    ranked = running(counts, p, ["n"]).withColumn("alpha", F.explode(F.array(*map(F.lit, alphas))))
    cuts = ranked.groupBy("alpha").agg(F.max(F.when(F.col(p) <= F.col("n_cum") / F.col("n_all") * F.col("alpha"), F.col(p))).alias("cut"))
    per = counts.crossJoin(F.broadcast(cuts))  # one row for each alpha
    ok = F.coalesce(F.col(p) <= F.col("cut"), F.lit(False))
    agg = per.groupBy("alpha").agg(F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("n_green"), F.sum(F.when(ok, F.col("bad")).otherwise(0)).alias("false_green"), F.sum("n").alias("n"), F.sum("bad").alias("n_bad"))
    good = F.col("n") - F.col("n_bad")
    return agg.select("alpha", "n_green", (F.col("n_green") / F.col("n")).alias("coverage"), F.when(F.col("n_green") > 0, F.col("false_green") / F.col("n_green")).otherwise(0.0).alias("fdr"), F.when(good > 0, (F.col("n_green") - F.col("false_green")) / good).otherwise(0.0).alias("power"))


def report_triage(cal: DataFrame, test: DataFrame, alpha: float = 0.05, tau: float = 0.3) -> DataFrame:
    """Triage of each report by itself: p-values from the pooled contradicted scores, step-up within the report."""
    rows = step_up(p_values(cal.where("label = 1"), test), alpha, ["report_id"], small=True)
    return rows.withColumn("triage", triage_label(F.col("accepted"), F.col("score"), F.lit(tau)))


def upper_quantiles(cal: DataFrame, group: str, level_alpha: float, least: int, score: str = "suspicion") -> tuple[DataFrame, DataFrame]:
    """Split-conformal thresholds: the score of rank ceil(level (n - 1)) + 1 with level min((n + 1)(1 - alpha) / n, 1), per large group and pooled.

    Ranks come from counts by distinct score, so ties do not matter."""

    def pick(keys):
        ranked = running(cal.groupBy(*keys, score).agg(F.count("*").alias("n")), score, ["n"], keys)
        level = F.least((F.col("n_all") + 1) * F.lit(1 - level_alpha) / F.col("n_all"), F.lit(1.0))
        return ranked.where(F.col("n_cum") >= F.ceil(level * (F.col("n_all") - 1)) + 1).groupBy(*keys).agg(F.min(score).alias("q"), F.first("n_all").alias("n_cal"))

    return pick([group]).where(F.col("n_cal") >= least), pick([])


def stratified_reject(cal: DataFrame, test: DataFrame, group: str, alpha: float, least: int = 30, score: str = "suspicion") -> DataFrame:
    """Adds q and rejected (score >= q): the group's threshold, or the pooled one for small and unseen groups."""
    own, pool = upper_quantiles(cal, group, alpha, least, score)
    rows = test.join(F.broadcast(own.select(group, F.col("q").alias("_own"))), group, "left").join(F.broadcast(pool.select(F.col("q").alias("_pool"))), F.lit(True), "left")
    return rows.withColumn("q", F.coalesce("_own", "_pool")).withColumn("rejected", F.col(score) >= F.col("q")).drop("_own", "_pool")


def threshold_lookup(rows: DataFrame, own: DataFrame, pool: DataFrame, group: str) -> DataFrame:
    """Adds q to rows: own(group, q) where the group is known, else the one row of pool(q)."""
    return rows.join(F.broadcast(own.select(group, F.col("q").alias("_own"))), group, "left").join(F.broadcast(pool.select(F.col("q").alias("_pool"))), F.lit(True), "left").withColumn("q", F.coalesce("_own", "_pool")).drop("_own", "_pool")


def blocks(rows: DataFrame, accepted: Column, keys: list[str], group: str = "pathology", null_label: int = 1) -> DataFrame:
    """FDR and power, over all rows and for each group: keys, group (ALL for the whole), n, n_green, fdr, power."""
    marked = rows.withColumn("_ok", accepted)
    both = marked.withColumn("_group", F.explode(F.array(F.lit("ALL"), F.col(group))))
    agg = both.groupBy(*keys, F.col("_group").alias("stratum")).agg(F.count("*").alias("n"), F.count_if("_ok").alias("n_green"), F.count_if(F.col("_ok") & (F.col("label") == null_label)).alias("_bad"), F.count_if(F.col("label") != null_label).alias("_good"))
    return agg.select(*keys, "stratum", "n", "n_green", F.when(F.col("n_green") > 0, F.col("_bad") / F.col("n_green")).otherwise(0.0).alias("fdr"), F.when(F.col("_good") > 0, (F.col("n_green") - F.col("_bad")) / F.col("_good")).otherwise(0.0).alias("power"))


def sweep_blocks(cal: DataFrame, test: DataFrame, alphas: list[float], group: str = "pathology", least: int = 50, null_label: int = 0) -> DataFrame:
    """The blocks of group triage for each alpha: alpha, stratum, n, n_green, fdr, power.

    p-values do not depend on alpha: test rows are counted by them once, and only counts meet the alphas. cal and test are
    read once; a row's rank and its p-value come from the same pass."""
    both = cal.select(group, "score", "label", F.lit(True).alias("_cal")).unionByName(test.select(group, "score", "label", F.lit(False).alias("_cal")))
    both = stored(both)
    groups = pooled_groups(both.where("_cal"), group, least)
    both = _effective(both.where(~F.col("_cal") | (F.col("label") == null_label)), groups, group)
    marked = both.select("effective", group, "score", F.col("_cal").cast("int").alias("w"), (~F.col("_cal")).cast("int").alias("n"), (F.col("label") == 1).cast("int").alias("bad"))
    ranked = ranked_p(marked, ["effective"]).where("n = 1")
    counts = stored(ranked.groupBy("effective", group, "p").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.max("n_cum").alias("n_cum"), F.first("n_all").alias("n_all")))
    cuts = counts.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas)))).groupBy("alpha", "effective").agg(F.max(F.when(F.col("p") <= F.col("n_cum") / F.col("n_all") * F.col("alpha"), F.col("p"))).alias("cut"))
    ok = F.coalesce(F.col("p") <= F.col("cut"), F.lit(False))
    per = counts.join(F.broadcast(cuts), "effective").withColumn("stratum", F.explode(F.array(F.lit("ALL"), F.col(group))))  # a row for each alpha and group
    agg = per.groupBy("alpha", "stratum").agg(F.sum("n").alias("n"), F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("n_green"), F.sum(F.when(ok, F.col("bad")).otherwise(0)).alias("_bad"), F.sum(F.col("n") - F.col("bad")).alias("_good"))
    return agg.select("alpha", "stratum", "n", "n_green", F.when(F.col("n_green") > 0, F.col("_bad") / F.col("n_green")).otherwise(0.0).alias("fdr"), F.when(F.col("_good") > 0, (F.col("n_green") - F.col("_bad")) / F.col("_good")).otherwise(0.0).alias("power"))


def temporal_shift(rows: DataFrame, early: str, late: str, alpha: float = 0.05, group: str = "pathology", least: int = 50) -> DataFrame:
    """Calibrates on rows before `early`, triages them and the rows from `late` on: cohort, n, n_green, fdr, degraded.

    Both cohorts are ranked in one pass over rows that are read once; thresholds of scores, which nothing here shows, are not computed."""
    before, after = rows.where(F.col("study_date") < F.lit(early).cast("timestamp")), rows.where(F.col("study_date") >= F.lit(late).cast("timestamp"))
    part = lambda rows, is_cal, *names: rows.select(group, "score", "label", F.lit(is_cal).alias("_cal"), F.array(*(F.lit(n) for n in names)).alias("cohorts"))
    both = stored(part(before, True, "early").unionByName(part(after, False, "late")))
    both = _effective(both, pooled_groups(both.where("_cal"), group, least), group)
    # rows before are test rows of their own cohort, and calibrate both cohorts where their label is 0
    each = F.filter(F.array(*(F.struct(F.lit(name).alias("cohort"), (F.col("_cal") & (F.col("label") == 0)).cast("int").alias("w"), (F.array_contains("cohorts", name)).cast("int").alias("n")) for name in ("early", "late"))), lambda x: (x["w"] > 0) | (x["n"] > 0))
    marked = both.withColumn("x", F.explode(each)).select("x.*", "effective", "score", F.when(F.col("x.n") == 1, (F.col("label") == 1).cast("int")).otherwise(0).alias("_bad"))
    done = step_up_sums(marked, alpha, ["cohort", "effective"], ["_bad"])
    names = rows.sparkSession.createDataFrame([("early",), ("late",)], "cohort string")
    out = names.join(done.groupBy("cohort").agg(*(F.sum(c).alias(c) for c in ("n", "n_green", "_bad"))), "cohort", "left").na.fill(0)
    checked = out.withColumn("n", F.when(F.col("n") == 0, F.raise_error(F.concat(F.lit("no rows on the side "), "cohort")).cast("bigint")).otherwise(F.col("n")))
    fdr = F.when(F.col("n_green") > 0, F.col("_bad") / F.col("n_green")).otherwise(0.0)
    return checked.select("cohort", "n", "n_green", fdr.alias("fdr"), ((F.col("cohort") == "late") & (fdr > alpha)).alias("degraded"))


def split_by_patient(rows: DataFrame, fraction: float, seed: int, key: str = "patient_id") -> DataFrame:
    """Adds is_cal: true for the first round(n fraction) patients in seeded order. Only distinct patients are ranked."""
    ids = rows.select(key).distinct().withColumn("_u", uniform(seed, F.col(key).cast("string"))).withColumn("n", F.lit(1))
    ranked = running(ids, "_u", ["n"], then=[key])
    return rows.join(ranked.select(key, (F.col("n_cum") <= F.round(F.col("n_all") * fraction)).alias("is_cal")), key)


def hold_out(rows: DataFrame, share: float, seed: int, key: str = "patient_id", row_key: str = "claim_id") -> DataFrame:
    """Adds is_val: true for the rows of the first floor(n share) patients in seeded order, at least one.

    A row without a patient counts as a patient of its own, named by its row_key. Only distinct patients are ranked."""
    own = F.coalesce(F.concat(F.lit("p"), F.col(key).cast("string")), F.concat(F.lit("r"), F.col(row_key).cast("string")), F.lit("r"))
    named = rows.withColumn("_who", own)
    ids = named.select("_who").distinct().withColumn("_u", uniform(seed, F.col("_who"))).withColumn("n", F.lit(1))
    first = F.greatest(F.floor(F.col("n_all") * F.lit(share)), F.lit(1))
    ranked = running(ids, "_u", ["n"], then=["_who"]).select("_who", (F.col("n_cum") <= first).alias("is_val"))
    return named.join(ranked, "_who").drop("_who")
