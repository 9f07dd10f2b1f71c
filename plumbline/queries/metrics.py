"""Measures: A01 to A05, A09 to A16, A18 to A25, A27, A29, A30, C17, C18."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import GRADES, claims, table, workbook
from ..operators import metrics as M
from ..operators.studies import BASELINES
from .registry import query

_GRADERS = ["grader_a_label", "grader_b_label", "grader_c_label"]


@query("A01_patient_rollup", "SELECT patient_id, count(DISTINCT report_id) AS n_studies, min_by(sex, study_date) AS sex FROM claims GROUP BY 1", "claims")
def a01(spark, sf):
    return claims(spark, sf).groupBy("patient_id").agg(F.countDistinct("report_id").alias("n_studies"), F.min_by("sex", "study_date").alias("sex"))


def _binary_sql(pred, act, src, keys=""):
    k = f"{keys}, " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    return f"SELECT {k}n, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0e0 END AS f1, (n - fp - fn) / n AS accuracy FROM (SELECT {k}count(*) AS n, count(*) FILTER ({pred} AND {act}) AS tp, count(*) FILTER ({pred} AND NOT ({act})) AS fp, count(*) FILTER (NOT ({pred}) AND {act}) AS fn FROM {src}{g})"


_HARD, _TRUE = "score < 0.4e0", "label = 1"


@query("A02_hallucination_metrics", _binary_sql(_HARD, "label <> 0", "claims"), "claims")
def a02(spark, sf):
    return M.binary_metrics(claims(spark, sf), F.col("score") < 0.4, F.col("label") != 0)


@query("A15_group_metrics", _binary_sql(_HARD, _TRUE, "claims", "pathology"), "claims")
def a15(spark, sf):
    return M.binary_metrics(claims(spark, sf), F.col("score") < 0.4, F.col("label") == 1, ["pathology"]).where("n >= 50")


@query("A03_laterality_errors", r"SELECT count(*) AS n, count(*) FILTER (label = 1) / count(*) AS rate FROM claims WHERE regexp_matches(claim, '(?i)\b(left|right)\b')", "claims")
def a03(spark, sf):
    return M.laterality_error_rate(claims(spark, sf))


@query("A04_fdr_among_green", "SELECT n_green, n_false, n_green - n_false AS n_true, n_false / n_green AS fdr, n_green / n AS green_share FROM (SELECT count(*) AS n, count(*) FILTER (score >= 0.5e0) AS n_green, count(*) FILTER (score >= 0.5e0 AND label = 1) AS n_false FROM claims)", "claims")
def a04(spark, sf):
    return M.discoveries(claims(spark, sf), F.col("score") >= 0.5)


@query("A05_green_share", "SELECT pathology, avg((score >= 0.5e0)::DOUBLE) AS share FROM claims GROUP BY 1", "claims")
def a05(spark, sf):
    return M.discoveries(claims(spark, sf), F.col("score") >= 0.5, ["pathology"]).select("pathology", F.col("green_share").alias("share"))


_AX = ", l AS (SELECT 'sex' AS axis, sex AS value, label, score >= 0.5e0 AS g FROM claims UNION ALL SELECT 'priority', priority, label, score >= 0.5e0 FROM claims), p AS (SELECT axis, value, count(*) AS n, count(*) FILTER (g) AS n_green, CASE WHEN count(*) FILTER (g) > 0 THEN count(*) FILTER (g AND label = 1) / count(*) FILTER (g) END AS fdr, avg((label = 1)::DOUBLE) AS hallucination_rate FROM l GROUP BY 1, 2)"


@query("A09_fairness", _AX + " SELECT * FROM p", "claims")
def a09(spark, sf):
    return M.fairness(claims(spark, sf), ["sex", "priority"], F.col("score") >= 0.5)[0]


@query("A09_fairness_disparity", _AX + " SELECT axis, CASE WHEN count(fdr) >= 2 THEN max(fdr) - min(fdr) END AS fdr_disparity, CASE WHEN count(hallucination_rate) >= 2 THEN max(hallucination_rate) - min(hallucination_rate) END AS hallucination_rate_disparity FROM p GROUP BY 1", "claims")
def a09b(spark, sf):
    return M.fairness(claims(spark, sf), ["sex", "priority"], F.col("score") >= 0.5)[1]


def _bin(s, n=10):
    return " + ".join(f"({s} >= {i / n}e0)::INT" for i in range(1, n))


def _rel(s, c):
    return f"SELECT bin, count(*) AS n, round(avg(s), 9) AS mean_score, avg(c) AS accuracy FROM (SELECT {_bin(s)} AS bin, {s} AS s, ({c})::DOUBLE AS c FROM claims) GROUP BY 1"


@query("A10_reliability", _rel("score", "label <> 1"), "claims")
def a10(spark, sf):
    return M.reliability(claims(spark, sf), F.col("score"), F.col("label") != 1).withColumn("mean_score", F.round("mean_score", 9))


def _ece(s, c):
    return f", d AS ({_rel(s, c)}) SELECT round(sum(abs(mean_score - accuracy) * n) / sum(n), 6) AS ece, round(max(abs(mean_score - accuracy)), 6) AS mce FROM d"


def _err(d):
    return M.calibration_error(d).select(F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce"))


@query("A10_calibration_error", _ece("score", "label <> 1"), "claims")
def a10b(spark, sf):
    return _err(a10(spark, sf))


_CONF = "greatest(score, 1 - score)"


@query("A11_confidence_ece", _ece(_CONF, "(score < 0.5e0) = (label = 1)"), "claims")
def a11(spark, sf):
    rows = claims(spark, sf)
    return _err(M.reliability(rows, F.greatest(F.col("score"), 1 - F.col("score")), (F.col("score") < 0.5) == (F.col("label") == 1)))


@query("A12_score_ece", _ece("score", "label = 0"), "claims")
def a12(spark, sf):
    return _err(M.reliability(claims(spark, sf), F.col("score"), F.col("label") == 0))


@query("A13_class_report", ", p AS (SELECT CASE WHEN label = 1 THEN 1 ELSE 0 END AS a, CASE WHEN score < 0.5e0 THEN 1 ELSE 0 END AS b FROM claims), c AS (SELECT c AS class, count(*) FILTER (a = c) AS support, count(*) FILTER (b = c) AS pr, count(*) FILTER (a = c AND b = c) AS h FROM p, (SELECT unnest([0, 1]) AS c) GROUP BY 1) SELECT class, support, CASE WHEN pr > 0 THEN h / pr ELSE 0e0 END AS precision, CASE WHEN support > 0 THEN h / support ELSE 0e0 END AS recall, CASE WHEN pr + support > 0 THEN 2 * h / (pr + support) ELSE 0e0 END AS f1 FROM c", "claims")
def a13(spark, sf):
    rows = claims(spark, sf).select(F.when(F.col("label") == 1, 1).otherwise(0).alias("a"), F.when(F.col("score") < 0.5, 1).otherwise(0).alias("b"))
    return M.class_report(rows, "a", "b")


@query("A13_confusion", "SELECT label, (score < 0.5e0)::INT AS predicted, count(*) AS n FROM claims GROUP BY 1, 2", "claims")
def a13b(spark, sf):
    return claims(spark, sf).groupBy("label", (F.col("score") < 0.5).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


_RANK = ", c AS (SELECT pathology, round(score, 3) AS s, count(*) FILTER (label <> 1) AS pos, count(*) FILTER (label = 1) AS neg FROM claims GROUP BY 1, 2), r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY pathology) AS p, sum(neg) OVER (PARTITION BY pathology) AS q FROM c WINDOW w AS (PARTITION BY pathology ORDER BY s DESC)) SELECT pathology, round(sum(neg * (tp - pos / 2)) / (max(p) * max(q)), 9) AS auroc, round(sum(pos / p * (tp / (tp + fp))), 9) AS average_precision FROM r GROUP BY 1"


@query("A14_ranking", _RANK, "claims")
def a14(spark, sf):
    rows = M.ranking(claims(spark, sf).withColumn("score", F.round("score", 3)), "score", F.col("label") != 1, ["pathology"])
    return rows.select("pathology", F.round("auroc", 9).alias("auroc"), F.round("average_precision", 9).alias("average_precision"))


_ICC = ", per AS (SELECT report_id, count(*) AS n, avg(score) AS m, var_pop(score) AS v FROM claims GROUP BY 1), g AS (SELECT avg(score) AS grand FROM claims), s AS (SELECT count(*) AS k, sum(n) AS t, sum(n * n) AS sq, sum(n * (m - grand) ** 2) AS b, sum(n * v) AS w FROM per, g WHERE n > 1), x AS (SELECT k, b / (k - 1) AS msb, w / (t - k) AS msw, (t - sq / t) / (k - 1) AS n0 FROM s) SELECT k AS n_groups, round(least(greatest((msb - msw) / (msb + (n0 - 1) * msw), 0), 1), 9) AS icc FROM x"


@query("A16_report_icc", _ICC, "claims")
def a16(spark, sf):
    return M.icc(claims(spark, sf), "score", "report_id").withColumn("icc", F.round("icc", 9))


def _agree(a, b, src):
    """Rate, kappa, both correlations; their p by the first 400 terms of the fraction and DuckDB's gamma functions."""
    frac = "list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(400, 0, -1), lambda k: k::DOUBLE)), lambda f, k: 1 + CASE WHEN k % 2 = 0 THEN (k / 2) * ({q} - k / 2) * {z} / (({p} + k - 1) * ({p} + k)) ELSE -({p} + (k - 1) / 2) * ({p} + {q} + (k - 1) / 2) * {z} / (({p} + k - 1) * ({p} + k)) END / f)"
    front = "exp(h * ln(x) + lgamma(h + 0.5e0) - lgamma(h) - lgamma(0.5e0)) * sqrt(1 - x)"
    tail = lambda r: f"(SELECT CASE WHEN x < (h + 1) / (h + 2.5e0) THEN {front} / h / {frac.format(p='h', q='0.5e0', z='x')} ELSE 1 - {front} / 0.5e0 / {frac.format(p='0.5e0', q='h', z='(1 - x)')} END FROM (SELECT (n - 2) / 2e0 AS h, 1 - {r} * {r} AS x FROM t))"
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0"
    return f"""WITH k AS (SELECT {a}::DOUBLE AS a, {b}::DOUBLE AS b FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL), r AS (SELECT *, {rank('a')} AS ra, {rank('b')} AS rb FROM k),
c AS (SELECT sum(x.c * y.c) AS c FROM (SELECT a, count(*)::DOUBLE AS c FROM k GROUP BY a) x JOIN (SELECT b, count(*)::DOUBLE AS c FROM k GROUP BY b) y ON a = b),
t AS (SELECT s.*, c.c / (n * n::DOUBLE) AS ch FROM (SELECT count(*) AS n, avg((a = b)::INT) AS rate, corr(a, b) AS pearson, corr(ra, rb) AS spearman FROM r) s, c)
SELECT n, rate, (rate - ch) / (1 - ch) AS kappa, round(pearson, 9) AS pearson, round({tail('pearson')}, 9) AS pearson_p, round(spearman, 9) AS spearman, round({tail('spearman')}, 9) AS spearman_p FROM t"""


def _round_agree(rows):
    return rows.withColumns({c: F.round(c, 9) for c in ("pearson", "pearson_p", "spearman", "spearman_p")})


_KAPPA = "SELECT round(kappa, 9) AS kappa FROM (" + _agree("quality", "toxic", "labels") + ")"


@query("A18_cohen_kappa", _KAPPA)
def a18(spark, sf):
    return M.agreement(table(spark, sf, "labels"), "quality", "toxic").select(F.round("kappa", 9).alias("kappa"))


_TWO = ", z AS (SELECT CASE WHEN grader_a_label = 'SUPPORTED' THEN 0 ELSE 1 END AS ga, CASE WHEN grader_b_label = 'SUPPORTED' THEN 0 ELSE 1 END AS gb, label, score, pathology FROM workbook) "


def _two(spark, sf):
    return workbook(spark, sf).withColumn("ga", F.when(F.col("grader_a_label") == "SUPPORTED", 0).otherwise(1)).withColumn("gb", F.when(F.col("grader_b_label") == "SUPPORTED", 0).otherwise(1))


@query("A19_label_agreement", _TWO + f"SELECT n, rate, round(kappa, 9) AS kappa, pearson, pearson_p, spearman, spearman_p FROM ({_agree('ga', 'gb', 'z')})", "workbook")
def a19(spark, sf):
    return _round_agree(M.agreement(_two(spark, sf), "ga", "gb")).withColumn("kappa", F.round("kappa", 9))


@query("A19_value_agreement", f"SELECT n, rate, round(kappa, 9) AS kappa, pearson, pearson_p, spearman, spearman_p FROM ({_agree('l_linenumber', 'l_tax * 100', 'lineitem')})")
def a19_values(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_linenumber", (F.col("l_tax") * 100).alias("tax"))
    return _round_agree(M.agreement(rows, "l_linenumber", "tax")).withColumn("kappa", F.round("kappa", 9))


_DOUBLE = "SELECT count(*) AS n_double, sum(a * b) AS ab, sum(a) AS a, sum(b) AS b, sum((a = b)::INT) AS same FROM (SELECT (grader_a_label = 'CONTRADICTED')::INT AS a, (grader_b_label = 'CONTRADICTED')::INT AS b FROM workbook WHERE trim(grader_b_label) <> '')"


@query("A18_double_annotated", f", d AS ({_DOUBLE}), e AS (SELECT *, (a * b + (n_double - a) * (n_double - b)) / (n_double * n_double::DOUBLE) AS ch, same / n_double AS rate FROM d) SELECT n_double, CASE WHEN n_double >= 10 THEN round((rate - ch) / (1 - ch), 9) END AS kappa, CASE WHEN n_double >= 10 THEN round(rate, 9) END AS rate, CASE WHEN n_double >= 10 THEN 'computed' ELSE 'insufficient' END AS status FROM e", "workbook")
def a18_double(spark, sf):
    got = M.double_annotated(workbook(spark, sf), "grader_a_label", "grader_b_label", ("CONTRADICTED",))
    return got.withColumns({c: F.round(c, 9) for c in ("kappa", "rate")})


_A20 = _TWO + f", a AS ({_binary_sql('score < 0.4e0', 'ga = 1', 'z')}), b AS ({_binary_sql('score < 0.4e0', 'gb = 1', 'z')}), l AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, a.{m} AS first, b.{m} AS second FROM a, b" for m in ("precision", "recall", "f1", "accuracy")) + ") SELECT metric, round(second - first, 9) AS delta, abs(second - first) > 0.05e0 AS sensitive FROM l"


@query("A20_label_sensitivity", _A20.replace("z) , a", "z), a"), "workbook")
def a20(spark, sf):
    rows, names = _two(spark, sf), ["precision", "recall", "f1", "accuracy"]
    part = lambda c, v: M.unpivot(M.binary_metrics(rows, F.col("score") < 0.4, F.col(c) == 1).withColumn("i", F.lit(1)), ["i"], names, "metric", v).drop("i")
    joined = part("ga", "first").join(part("gb", "second"), "metric")
    return joined.select("metric", F.round(F.col("second") - F.col("first"), 9).alias("delta"), (F.abs(F.col("second") - F.col("first")) > 0.05).alias("sensitive"))


_MAJ = "CASE WHEN grader_a_label IN (grader_b_label, grader_c_label) THEN grader_a_label WHEN grader_b_label = grader_c_label THEN grader_b_label ELSE 'UNCERTAIN' END"
_WB = f", m AS (SELECT *, {_MAJ} AS majority FROM workbook)"
_NAMES = "(SELECT unnest([" + ", ".join(f"'{g}'" for g in GRADES) + "]) AS majority)"


def voted(spark, sf):
    return workbook(spark, sf).withColumn("majority", M.majority(_GRADERS, GRADES))


@query("A21_majority", _WB + " SELECT claim_id, majority FROM m", "workbook")
def a21(spark, sf):
    return voted(spark, sf).select("claim_id", "majority")


_ACC = _WB + ", l AS (" + " UNION ALL ".join(f"SELECT '{g}' AS grader, {g} AS given, majority FROM m" for g in _GRADERS) + ") SELECT grader, count(*) AS n, avg((given = majority)::INT) AS accuracy FROM l GROUP BY 1"


@query("A22_grader_accuracy", _ACC, "workbook")
def a22(spark, sf):
    long = M.unpivot(voted(spark, sf), ["majority"], _GRADERS, "grader", "given")
    return long.where(F.col("given").isin(*GRADES) & F.col("majority").isin(*GRADES)).groupBy("grader").agg(F.count("*").alias("n"), F.avg((F.col("given") == F.col("majority")).cast("double")).alias("accuracy"))


@query("A23_majority_distribution", _WB + f" SELECT majority, count(claim_id) AS n FROM {_NAMES} LEFT JOIN m USING (majority) GROUP BY 1", "workbook")
def a23(spark, sf):
    return M.with_dimension(voted(spark, sf), "majority", GRADES, F.count("*").alias("n")).na.fill(0, ["n"])


@query("A24_score_blocks", _WB + f" SELECT majority, count(claim_id) AS n, coalesce(round(avg(score), 9), 0) AS mean, coalesce(round(stddev_pop(score), 9), 0) AS std, coalesce(min(score), 0) AS low, coalesce(max(score), 0) AS high FROM {_NAMES} LEFT JOIN m USING (majority) GROUP BY 1", "workbook")
def a24(spark, sf):
    return M.score_block(voted(spark, sf), "majority", GRADES, "score").withColumn("mean", F.round("mean", 9)).withColumn("std", F.round("std", 9))


@query("A25_baseline_precision", _WB + " SELECT count(*) AS n, avg((majority = 'SUPPORTED')::INT) AS precision, avg((majority = 'SUPPORTED')::INT) - 0.73e0 AS delta FROM m WHERE score >= 0.5e0", "workbook")
def a25(spark, sf):
    hit = F.avg((F.col("majority") == "SUPPORTED").cast("double"))
    return voted(spark, sf).where("score >= 0.5").agg(F.count("*").alias("n"), hit.alias("precision"), (hit - 0.73).alias("delta"))


@query("A27_reward_hacking", ", r AS (SELECT line AS n, avg(score) AS verifier, avg(1 - 0.3e0 * u) AS fluency, avg(u / line) AS recall FROM claims GROUP BY 1), e AS (SELECT min_by(verifier, n) AS v0, max_by(verifier, n) AS v1, min_by(fluency, n) AS f0, max_by(fluency, n) AS f1, min_by(recall, n) AS r0, max_by(recall, n) AS r1 FROM r), c AS (SELECT round((v1 - v0) / abs(v0), 6) AS verifier_change, round((f1 - f0) / abs(f0), 6) AS fluency_change, round((r1 - r0) / abs(r0), 6) AS recall_change FROM e) SELECT *, verifier_change > 0 AND (fluency_change < -0.02e0 OR recall_change < -0.02e0) AS flagged FROM c", "claims")
def a27(spark, sf):
    rows = claims(spark, sf).select("line", F.col("score").alias("verifier"), (1 - 0.3 * F.col("u")).alias("fluency"), (F.col("u") / F.col("line")).alias("recall"))
    out = M.shifts(rows, "line", ["verifier", "fluency", "recall"], "verifier")
    return out.select(*(F.round(c, 6).alias(c) for c in ("verifier_change", "fluency_change", "recall_change")), "flagged")


@query("A29_decision_gate", "SELECT metric, value, passed, bool_and(passed) OVER () AS all_passed FROM (SELECT 'accuracy' AS metric, accuracy AS value, accuracy >= 0.7e0 AS passed FROM (" + _binary_sql(_HARD, _TRUE, "claims") + ") UNION ALL SELECT 'f1', f1, f1 >= 0.9e0 FROM (" + _binary_sql(_HARD, _TRUE, "claims") + ") UNION ALL SELECT 'fdr', v, v <= 0.1e0 + 0.05e0 FROM (SELECT count(*) FILTER (score >= 0.5e0 AND label = 1) / count(*) FILTER (score >= 0.5e0) AS v FROM claims))", "claims")
def a29(spark, sf):
    from pyspark.sql import Window

    own = claims(spark, sf)
    rows = M.binary_metrics(own, F.col("score") < 0.4, F.col("label") == 1).crossJoin(F.broadcast(M.discoveries(own, F.col("score") >= 0.5).select("fdr"))).withColumn("i", F.lit(1))
    long = M.unpivot(rows, ["i"], ["accuracy", "f1", "fdr"])
    alpha = 0.1
    passed = F.when(F.col("metric") == "accuracy", F.col("value") >= 0.7).when(F.col("metric") == "f1", F.col("value") >= 0.9).otherwise(F.col("value") <= alpha + 0.05)
    return long.select("metric", "value", passed.alias("passed")).withColumn("all_passed", F.every("passed").over(Window.partitionBy(F.lit(0))))


@query("A30_value_counts", "SELECT label, pathology, evidence_source_type AS source, count(*) AS n FROM claims GROUP BY GROUPING SETS ((label), (pathology), (evidence_source_type))", "claims")
def a30(spark, sf):
    rows = claims(spark, sf).withColumnRenamed("evidence_source_type", "source")
    return rows.groupingSets([["label"], ["pathology"], ["source"]], "label", "pathology", "source").agg(F.count("*").alias("n"))


@query("C17_threshold_sweep", ", c AS (SELECT * FROM claims WHERE patient_id % 2 = 0), g AS (SELECT i / 199 AS tau FROM range(200) t(i)), f AS (SELECT tau, count(*) AS n, count(*) FILTER (label = 1) AS bad FROM g JOIN c ON score >= tau GROUP BY 1) SELECT max(tau) FILTER (bad / n <= 0.2e0) AS tau FROM f", "claims")
def c17(spark, sf):
    return M.threshold_sweep(claims(spark, sf).where("patient_id % 2 = 0"), 0.2)


@query("C18_baselines", "SELECT 'no_verification' AS baseline, count(*) AS n_green, count(*) FILTER (label = 1) / count(*) AS fdr FROM claims UNION ALL SELECT 'best_candidate', count(*), count(*) FILTER (label = 1) / count(*) FROM (SELECT * FROM claims QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY score DESC, claim_id) = 1)", "claims")
def c18(spark, sf):
    rows = claims(spark, sf)
    parts = [M.discoveries(accepted(rows), F.lit(True)).select(F.lit(n).alias("baseline"), "n_green", "fdr") for n, accepted in BASELINES.items()]
    return reduce(DataFrame.unionByName, parts)
