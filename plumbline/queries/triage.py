"""Conformal triage: C01 to C10, C13 to C17, C22 to C24, J17, S12."""

from pyspark.sql import functions as F

from ..fixtures import claims, uniform_sql
from ..operators import conformal as C
from ..sources.tables import stored
from .registry import query

_B = ", b AS (SELECT *, CASE WHEN label = 1 THEN 1 ELSE 0 END AS bad, patient_id % 2 = 0 AS is_cal FROM claims)"


def _binary(spark, sf):
    return claims(spark, sf).withColumn("label", F.when(F.col("label") == 1, 1).otherwise(0))


def _sides(spark, sf, *columns):
    """Calibration and test claims; where columns are named, these are written once for all passes."""
    rows = _binary(spark, sf)
    rows = stored(rows.select("patient_id", "label", "score", *columns)) if columns else rows
    return rows.where("patient_id % 2 = 0"), rows.where("patient_id % 2 <> 0")


@query("C01_one_per_report", f"SELECT claim_id, report_id FROM claims QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY {uniform_sql(42, 'claim_id')}, claim_id) = 1", "claims")
def c01(spark, sf):
    return C.one_per(claims(spark, sf), "report_id", 42, "claim_id").select("claim_id", "report_id")


@query("C01_one_per_patient", f"SELECT claim_id, patient_id FROM claims QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY {uniform_sql(42, 'claim_id')}, claim_id) = 1", "claims")
def c01b(spark, sf):
    return C.one_per(claims(spark, sf), "patient_id", 42, "claim_id").select("claim_id", "patient_id")


def _pv(group, cal="is_cal AND bad = 1", w="1.0e0"):
    return f", cal AS (SELECT {group} AS g, score AS s, {w} AS w FROM b WHERE {cal}), u2 AS (SELECT g, s, w, NULL AS claim_id FROM cal UNION ALL SELECT {group}, score, 0, claim_id FROM b WHERE NOT is_cal), pv AS (SELECT claim_id, g, (sum(w) OVER (PARTITION BY g ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1) / (sum(w) OVER (PARTITION BY g) + 1) AS p FROM u2)"


@query("C02_p_values", _B + _pv("pathology") + " SELECT claim_id, p FROM pv WHERE claim_id IS NOT NULL", "claims")
def c02(spark, sf):
    cal, test = _sides(spark, sf)
    return C.p_values(cal.where("label = 1"), test, "pathology").select("claim_id", "p")


@query("C03_weighted_p_values", _B + _pv("pathology", w="(1 + line % 3)::DOUBLE") + " SELECT claim_id, p FROM pv WHERE claim_id IS NOT NULL", "claims")
def c03(spark, sf):
    cal, test = _sides(spark, sf)
    return C.p_values(cal.where("label = 1").withColumn("w", (1 + F.col("line") % 3).cast("double")), test, "pathology", weight="w").select("claim_id", "p")


def _bh(src, alpha, part=""):
    by = f"PARTITION BY {part}" if part else ""
    return f", r AS (SELECT *, count(*) OVER ({by} ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, count(*) OVER ({by}) AS allp FROM {src}), acc AS (SELECT *, coalesce(p <= max(p) FILTER (p <= cum / allp * {alpha}) OVER ({by}), false) AS accepted FROM r)"


@query("C04_step_up", _B + _pv("pathology") + _bh("(SELECT * FROM pv WHERE claim_id IS NOT NULL)", "0.05e0") + " SELECT claim_id, accepted FROM acc", "claims")
def c04(spark, sf):
    return C.step_up(c02(spark, sf), 0.05).select("claim_id", "accepted")


@query("C05_triage_label", _B + _pv("pathology") + _bh("(SELECT * FROM pv WHERE claim_id IS NOT NULL)", "0.05e0") + " SELECT CASE WHEN accepted THEN 'green' WHEN score > 0.3e0 THEN 'yellow' ELSE 'red' END AS triage, count(*) AS n FROM acc JOIN b USING (claim_id) GROUP BY 1", "claims")
def c05(spark, sf):
    cal, test = _sides(spark, sf)
    rows = C.step_up(C.p_values(cal.where("label = 1"), test, "pathology"), 0.05)
    return rows.groupBy(C.triage_label(F.col("accepted"), F.col("score"), F.lit(0.3)).alias("triage")).agg(F.count("*").alias("n"))


_EFF = ", sizes AS (SELECT brand, CASE WHEN count(*) {only} >= {least} THEN brand ELSE 'Rare/Other' END AS eff FROM b WHERE {cal} GROUP BY brand), e AS (SELECT b.*, coalesce(eff, 'Rare/Other') AS effective FROM b LEFT JOIN sizes USING (brand))"
_EFF_ALL = _EFF.format(only="", least=1180, cal="is_cal")
_EFF_BAD = _EFF.format(only="FILTER (bad = 1)", least=400, cal="is_cal")


@query("C06_calibrate", _B + _EFF_ALL + " SELECT effective, quantile_cont(score, 0.25) AS tau, count(*) AS n_cal FROM e WHERE is_cal GROUP BY 1", "claims")
def c06(spark, sf):
    cal, _ = _sides(spark, sf)
    return C.calibrate(cal, "brand", 1180)[1]


def _pve(cal, test="NOT is_cal"):
    return f", u2 AS (SELECT effective AS g, score AS s, 1 AS w, NULL AS claim_id FROM e WHERE {cal} UNION ALL SELECT effective, score, 0, claim_id FROM e WHERE {test}), pv AS (SELECT claim_id, g, (sum(w) OVER (PARTITION BY g ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1) / (sum(w) OVER (PARTITION BY g) + 1) AS p FROM u2)"


_C07 = _B + _EFF_ALL + _pve("is_cal AND bad = 0") + _bh("(SELECT * FROM pv WHERE claim_id IS NOT NULL)", "0.1e0", "g") + ", tau AS (SELECT effective, quantile_cont(score, 0.25) AS tau FROM e WHERE is_cal GROUP BY 1)"
_TRI = "CASE WHEN accepted THEN 'green' WHEN score > coalesce(tau, 0.5e0) THEN 'yellow' ELSE 'red' END"


@query("C07_group_triage", _C07 + f" SELECT claim_id, e.effective, p, {_TRI} AS triage FROM acc JOIN e USING (claim_id) LEFT JOIN tau USING (effective)", "claims")
def c07(spark, sf):
    cal, test = _sides(spark, sf, "claim_id", "brand")
    return C.triage(cal, test, 0.1, "brand", 1180).select("claim_id", "effective", "p", "triage")


_TIER = "CASE WHEN evidence_source_type = 'oracle_report_text' THEN 'trusted' WHEN evidence_source_type = 'retrieved_report_text' THEN 'independent' WHEN evidence_source_type = 'generator_output' THEN CASE WHEN claim_generator_id <> evidence_generator_id THEN 'independent' ELSE 'same_model' END ELSE 'unknown' END"
_ONE = f", one AS (SELECT claim_id FROM b WHERE is_cal QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY {uniform_sql(42, 'claim_id')}, claim_id) = 1)"
_C08 = (
    _B + _ONE + ", b2 AS (SELECT * REPLACE (claim_id IN (SELECT claim_id FROM one) AS is_cal) FROM b WHERE NOT is_cal OR claim_id IN (SELECT claim_id FROM one))"
    + ", sizes AS (SELECT pathology, CASE WHEN count(*) FILTER (bad = 1) >= 50 THEN pathology ELSE 'Rare/Other' END AS eff FROM b2 WHERE is_cal GROUP BY 1), e AS (SELECT b2.*, coalesce(eff, 'Rare/Other') AS effective FROM b2 LEFT JOIN sizes USING (pathology))"
    + _pve("is_cal AND bad = 1") + _bh("(SELECT * FROM pv WHERE claim_id IS NOT NULL)", "0.05e0")
    + ", tau AS (SELECT effective, quantile_cont(score, 0.25) AS tau FROM e WHERE is_cal AND bad = 1 GROUP BY 1)"
    + f", t AS (SELECT claim_id, e.pathology, bad, accepted, {_TRI} AS triage, {_TIER} AS tier FROM acc JOIN e USING (claim_id) LEFT JOIN tau USING (effective))"
    + ", g AS (SELECT *, CASE triage WHEN 'green' THEN CASE WHEN tier IN ('trusted', 'independent') THEN 'supported_trusted' ELSE 'supported_uncertified' END WHEN 'yellow' THEN 'review_required' ELSE 'contradicted' END AS final_label FROM t)"
)


def _canonical(spark, sf):
    rows = _binary(spark, sf).select("claim_id", "patient_id", "pathology", "label", "score", "evidence_source_type", "claim_generator_id", "evidence_generator_id")
    return C.canonical(stored(rows), F.col("patient_id") % 2 == 0)


@query("C08_canonical_triage", _C08 + " SELECT pathology, final_label, count(*) AS n, count(*) FILTER (bad = 1) AS n_contradicted FROM g GROUP BY 1, 2", "claims")
def c08(spark, sf):
    return _canonical(spark, sf).groupBy("pathology", "final_label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_contradicted"))


@query("A07_tier_table", _C08 + " SELECT tier, count(*) AS n, count(*) FILTER (triage = 'green') AS n_green, count(*) FILTER (final_label = 'supported_trusted') AS n_trusted, CASE WHEN count(*) FILTER (triage = 'green') > 0 THEN count(*) FILTER (triage = 'green' AND bad = 1) / count(*) FILTER (triage = 'green') ELSE 0e0 END AS fdr FROM g GROUP BY 1", "claims")
def a07(spark, sf):
    green = F.col("triage") == "green"
    agg = _canonical(spark, sf).groupBy(F.col("evidence_trust_tier").alias("tier")).agg(F.count("*").alias("n"), F.count_if(green).alias("n_green"), F.count_if(F.col("final_label") == "supported_trusted").alias("n_trusted"), F.count_if(green & (F.col("label") == 1)).alias("bad"))
    return agg.select("tier", "n", "n_green", "n_trusted", F.when(F.col("n_green") > 0, F.col("bad") / F.col("n_green")).otherwise(0.0).alias("fdr"))


@query("A08_group_fdr", _C08 + " SELECT pathology, count(*) FILTER (triage = 'green') AS n_green, count(*) FILTER (triage = 'green' AND bad = 1) / count(*) FILTER (triage = 'green') AS fdr FROM g GROUP BY 1 HAVING n_green > 0", "claims")
def a08(spark, sf):
    green = F.col("triage") == "green"
    agg = _canonical(spark, sf).groupBy("pathology").agg(F.count_if(green).alias("n_green"), F.count_if(green & (F.col("label") == 1)).alias("bad")).where("n_green > 0")
    return agg.select("pathology", "n_green", (F.col("bad") / F.col("n_green")).alias("fdr"))


_ALPHAS = [0.01, 0.05, 0.1, 0.15, 0.2]
_SWEEP = _B + _pv("pathology") + f", t AS (SELECT p, bad FROM pv JOIN b USING (claim_id)), a AS (SELECT unnest({_ALPHAS})::DOUBLE AS alpha), x AS (SELECT alpha, p, bad, count(*) OVER (PARTITION BY alpha ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, count(*) OVER (PARTITION BY alpha) AS m FROM t, a), y AS (SELECT *, coalesce(p <= max(p) FILTER (p <= cum / m * alpha) OVER (PARTITION BY alpha), false) AS ok FROM x)"


@query("C09_alpha_sweep", _SWEEP + " SELECT alpha, count(*) FILTER (ok) AS n_green, count(*) FILTER (ok) / count(*) AS coverage, CASE WHEN count(*) FILTER (ok) > 0 THEN count(*) FILTER (ok AND bad = 1) / count(*) FILTER (ok) ELSE 0e0 END AS fdr, count(*) FILTER (ok AND bad = 0) / count(*) FILTER (bad = 0) AS power FROM y GROUP BY 1", "claims")
def c09(spark, sf):
    cal, test = _sides(spark, sf, "pathology")
    return C.sweep(C.p_values(cal.where("label = 1"), test, "pathology"), _ALPHAS)


@query("C10_report_triage", _B + _pv("'all'") + _bh("(SELECT pv.claim_id, p, report_id, score FROM pv JOIN b USING (claim_id))", "0.2e0", "report_id") + " SELECT claim_id, CASE WHEN accepted THEN 'green' WHEN score > 0.3e0 THEN 'yellow' ELSE 'red' END AS triage FROM acc", "claims")
def c10(spark, sf):
    return C.report_triage(*_sides(spark, sf), alpha=0.2).select("claim_id", "triage")


def _quant(keys, alpha="0.1e0"):
    return f"SELECT {keys} AS k, list_sort(list(1 - score))[(ceil(least((count(*) + 1) * (1 - {alpha}) / count(*), 1) * (count(*) - 1)) + 1)::INT] AS q, count(*) AS n_cal FROM b WHERE is_cal AND bad = 0 GROUP BY 1"


_STRAT = _B + f", own AS ({_quant('brand')} HAVING count(*) >= 800), pool AS ({_quant(chr(39) + 'x' + chr(39))}), z AS (SELECT b.*, coalesce(own.q, pool.q) AS q FROM b LEFT JOIN own ON brand = own.k CROSS JOIN pool WHERE NOT is_cal)"


def _suspicion(spark, sf):
    cal, test = _sides(spark, sf)
    s = 1 - F.col("score")
    return cal.where("label = 0").withColumn("suspicion", s), test.withColumn("suspicion", s)


@query("C13_stratified_quantiles", _B + f" SELECT k AS brand, q, n_cal FROM ({_quant('brand')} HAVING count(*) >= 800)", "claims")
def c13(spark, sf):
    return C.upper_quantiles(_suspicion(spark, sf)[0], "brand", 0.1, 800)[0].select("brand", "q", "n_cal")


@query("J17_threshold_lookup", _STRAT + " SELECT claim_id, q FROM z", "claims")
def j17(spark, sf):
    cal, test = _suspicion(spark, sf)
    return C.threshold_lookup(test, *C.upper_quantiles(cal, "brand", 0.1, 800), "brand").select("claim_id", "q")


def _strat_blocks(table):
    return f"SELECT stratum, count(*) AS n, count(*) FILTER (ok) AS n_green, CASE WHEN count(*) FILTER (ok) > 0 THEN count(*) FILTER (ok AND bad = 1) / count(*) FILTER (ok) ELSE 0e0 END AS fdr, CASE WHEN count(*) FILTER (bad = 0) > 0 THEN count(*) FILTER (ok AND bad = 0) / count(*) FILTER (bad = 0) ELSE 0e0 END AS power FROM (SELECT *, unnest(['ALL', brand]) AS stratum FROM {table}) GROUP BY 1"


@query("C14_stratified_baseline", _STRAT + ", y AS (SELECT *, NOT (1 - score >= q) AS ok FROM z) " + _strat_blocks("y"), "claims")
def c14(spark, sf):
    cal, test = _suspicion(spark, sf)
    rows = C.stratified_reject(cal, test, "brand", 0.1, 800)
    return C.blocks(rows, ~F.col("rejected"), [], "brand")


_TWO = ", methods AS (SELECT 'step_up' AS method, 0.1e0 AS alpha, s.* FROM ({a}) s UNION ALL SELECT 'stratified', 0.1e0, s.* FROM ({b}) s)"


def _step_up_blocks(spark, sf):
    return C.blocks(C.triage(*_sides(spark, sf, "brand"), 0.1, "brand", 1180), F.col("accepted"), [], "brand")


_LEVELS = [0.05, 0.1, 0.2, 0.5]
_C15 = _B + _EFF_ALL + _pve("is_cal AND bad = 0") + " " + " UNION ALL ".join(
    f"SELECT {a}e0 AS alpha, x.* FROM (WITH {_bh('(SELECT * FROM pv WHERE claim_id IS NOT NULL)', f'{a}e0', 'g')[2:]}, y AS (SELECT e.*, accepted AS ok FROM acc JOIN e USING (claim_id)) {_strat_blocks('y')}) x" for a in _LEVELS
)


@query("C15_recalibrated_blocks", _C15, "claims")
def c15(spark, sf):
    return C.sweep_blocks(*_sides(spark, sf, "brand"), _LEVELS, "brand", 1180)


@query("A06_fdr_power_blocks", _B + ", y AS (SELECT *, score >= 0.5e0 AS ok FROM b) " + _strat_blocks("y"), "claims")
def a06(spark, sf):
    return C.blocks(_binary(spark, sf), F.col("score") >= 0.5, [], "brand")


@query("S12_method_comparison", _C07 + ", y AS (SELECT e.*, accepted AS ok FROM acc JOIN e USING (claim_id))" + f", own AS ({_quant('brand')} HAVING count(*) >= 800), pool AS ({_quant(chr(39) + 'x' + chr(39))}), z AS (SELECT b.*, NOT (1 - score >= coalesce(own.q, pool.q)) AS ok FROM b LEFT JOIN own ON brand = own.k CROSS JOIN pool WHERE NOT is_cal) SELECT 'step_up' AS method, 0.1e0 AS alpha, x.* FROM ({_strat_blocks('y')}) x UNION ALL SELECT 'stratified', 0.1e0, x.* FROM ({_strat_blocks('z')}) x", "claims")
def s12(spark, sf):
    both = _step_up_blocks(spark, sf).withColumn("method", F.lit("step_up")).unionByName(c14(spark, sf).withColumn("method", F.lit("stratified")))
    return both.withColumn("alpha", F.lit(0.1)).orderBy("alpha", "stratum", "method")


def _cohort(name, test):
    return f"SELECT '{name}' AS cohort, claim_id, bad, p, pathology AS g FROM pv_{name} JOIN b USING (claim_id)"


_SHIFT = _B.replace("patient_id % 2 = 0 AS is_cal", "study_date < TIMESTAMP '1997-01-01' AS early, study_date >= TIMESTAMP '1999-01-01' AS late") + "".join(
    f", u_{n} AS (SELECT pathology AS g, score AS s, 1 AS w, NULL AS claim_id, 0 AS bad FROM b WHERE early AND bad = 0 UNION ALL SELECT pathology, score, 0, claim_id, bad FROM b WHERE {n}), q_{n} AS (SELECT claim_id, bad, g, (sum(w) OVER (PARTITION BY g ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1) / (sum(w) OVER (PARTITION BY g) + 1) AS p FROM u_{n}), r_{n} AS (SELECT *, count(*) OVER (PARTITION BY g ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, count(*) OVER (PARTITION BY g) AS m FROM q_{n} WHERE claim_id IS NOT NULL), a_{n} AS (SELECT *, coalesce(p <= max(p) FILTER (p <= cum / m * 0.2e0) OVER (PARTITION BY g), false) AS ok FROM r_{n})"
    for n in ("early", "late")
)


@query("C16_temporal_shift", _SHIFT + " SELECT cohort, n, n_green, CASE WHEN n_green > 0 THEN nb / n_green ELSE 0e0 END AS fdr, cohort = 'late' AND CASE WHEN n_green > 0 THEN nb / n_green ELSE 0e0 END > 0.2e0 AS degraded FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS cohort, count(*) AS n, count(*) FILTER (ok) AS n_green, count(*) FILTER (ok AND bad = 1) AS nb FROM a_{n}" for n in ("early", "late")) + ")", "claims")
def c16(spark, sf):
    return C.temporal_shift(_binary(spark, sf).select("study_date", "pathology", "label", "score"), "1997-01-01", "1999-01-01", 0.2)


@query("C23_patient_split", f", p AS (SELECT patient_id, row_number() OVER (ORDER BY {uniform_sql(42, 'patient_id::VARCHAR')}, patient_id) <= round(count(*) OVER () * 0.4e0) AS is_cal FROM (SELECT DISTINCT patient_id FROM claims)) SELECT is_cal, count(DISTINCT patient_id) AS n_patients, count(*) AS n_claims FROM claims JOIN p USING (patient_id) GROUP BY 1", "claims")
def c23(spark, sf):
    return C.split_by_patient(claims(spark, sf), 0.4, 42).groupBy("is_cal").agg(F.countDistinct("patient_id").alias("n_patients"), F.count("*").alias("n_claims"))


_WHO = "CASE WHEN line % 5 = 0 THEN 'r' || claim_id ELSE 'p' || patient_id::VARCHAR END"


@query("C23_hold_out", f", w AS (SELECT claim_id, {_WHO} AS who FROM claims), p AS (SELECT who, row_number() OVER (ORDER BY {uniform_sql(43, 'who')}, who) <= greatest(floor(count(*) OVER () * 0.1e0), 1) AS is_val FROM (SELECT DISTINCT who FROM w)) SELECT claim_id, is_val FROM w JOIN p USING (who)", "claims")
def c23_hold_out(spark, sf):
    rows = claims(spark, sf).select("claim_id", F.when(F.col("line") % 5 != 0, F.col("patient_id")).alias("patient_id"))
    return C.hold_out(rows, 0.1, 43).select("claim_id", "is_val")
