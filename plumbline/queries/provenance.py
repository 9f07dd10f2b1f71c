"""P01 to P08."""

from pyspark.sql import functions as F

from ..fixtures import claims
from ..functions import provenance as P
from .registry import query

_TIER = "CASE WHEN evidence_source_type = 'oracle_report_text' THEN 'trusted' WHEN evidence_source_type = 'retrieved_report_text' THEN 'independent' WHEN evidence_source_type = 'generator_output' THEN CASE WHEN claim_generator_id <> evidence_generator_id THEN 'independent' ELSE 'same_model' END ELSE 'unknown' END"
_LABEL = "CASE WHEN score >= 0.5e0 THEN 'green' WHEN score >= 0.25e0 THEN 'yellow' ELSE 'red' END"


def _gate(label, tier):
    return f"CASE {label} WHEN 'green' THEN CASE WHEN {tier} IN ('trusted', 'independent') THEN 'supported_trusted' ELSE 'supported_uncertified' END WHEN 'yellow' THEN 'review_required' ELSE 'contradicted' END"


_GATED = f", g AS (SELECT *, {_gate('label3', 'tier')} AS final_label FROM (SELECT *, {_TIER} AS tier, {_LABEL} AS label3 FROM claims))"


@query("P01_trust_tier", f"SELECT claim_id, {_TIER} AS tier FROM claims", "claims")
def p01(spark, sf):
    return claims(spark, sf).select("claim_id", P.trust_tier(F.col("evidence_source_type"), F.col("claim_generator_id"), F.col("evidence_generator_id")).alias("tier"))


@query("P02_provenance_fields", f"SELECT claim_id, evidence_source_type, claim_generator_id, evidence_generator_id, {_TIER} AS evidence_trust_tier, {_TIER} IN ('trusted', 'independent') AS evidence_is_independent FROM claims", "claims")
def p02(spark, sf):
    stale = claims(spark, sf).withColumn("evidence_trust_tier", F.lit("trusted"))
    return P.with_provenance(stale).select("claim_id", "evidence_source_type", "claim_generator_id", "evidence_generator_id", "evidence_trust_tier", "evidence_is_independent")


@query("P03_certifiable", f"SELECT {_TIER} IN ('trusted', 'independent') AS certifiable, count(*) AS n FROM claims GROUP BY 1", "claims")
def p03(spark, sf):
    return P.with_provenance(claims(spark, sf)).groupBy(P.is_certifiable(F.col("evidence_trust_tier")).alias("certifiable")).agg(F.count("*").alias("n"))


@query("P04_gate", _GATED + " SELECT claim_id, label3 AS label, tier, final_label, label3 = 'green' AND tier NOT IN ('trusted', 'independent') AS overridden FROM g", "claims")
def p04(spark, sf):
    rows = P.with_provenance(claims(spark, sf)).withColumn("label", P.label_from_score(F.col("score")))
    tier = F.col("evidence_trust_tier")
    return rows.select("claim_id", "label", tier.alias("tier"), P.gate(F.col("label"), tier).alias("final_label"), P.was_overridden(F.col("label"), tier).alias("overridden"))


@query("P05_tier_counts", f"SELECT t.tier, count(c.tier) AS n FROM (SELECT unnest(['trusted', 'independent', 'same_model', 'unknown']) AS tier) t LEFT JOIN (SELECT {_TIER} AS tier FROM claims WHERE evidence_source_type <> 'retrieved_report_text') c USING (tier) GROUP BY 1", "claims")
def p05(spark, sf):
    return P.tier_counts(P.with_provenance(claims(spark, sf).where(F.col("evidence_source_type") != P.RETRIEVED)))


_DEMO = f", d AS (SELECT *, CASE WHEN claim_generator_id <> evidence_generator_id THEN 'independent' ELSE 'same_model' END AS tier, {_LABEL} AS conformal_label, score >= 0.5e0 AS high_score, CASE WHEN line % 2 = 0 THEN 'same_run' ELSE 'cross_run' END AS condition FROM (SELECT * REPLACE (CASE WHEN line % 2 = 0 THEN claim_generator_id ELSE evidence_generator_id END AS evidence_generator_id) FROM claims)), e AS (SELECT *, {_gate('conformal_label', 'tier')} AS gate_label FROM d)"
_STATS = _DEMO + ", s AS (SELECT condition, count(*) AS n_claims, count(*) FILTER (high_score) AS n_high_score, count(*) FILTER (conformal_label = 'green') AS n_pre_gate, count(*) FILTER (gate_label = 'supported_trusted') AS n_post_gate FROM e GROUP BY 1), t AS (SELECT *, CASE WHEN n_pre_gate > 0 THEN (n_pre_gate - n_post_gate) / n_pre_gate ELSE 0.0e0 END AS downgrade_rate FROM s)"


def _demo(spark, sf):
    rows = claims(spark, sf).withColumn("condition", F.when(F.col("line") % 2 == 0, "same_run").otherwise("cross_run"))
    return P.gate_demo(rows.withColumn("evidence_generator_id", F.when(F.col("condition") == "same_run", F.col("claim_generator_id")).otherwise(F.col("evidence_generator_id"))))


@query("P06_gate_demo_rows", _DEMO + " SELECT claim_id, condition, tier, conformal_label, gate_label, high_score FROM e", "claims")
def p06(spark, sf):
    return _demo(spark, sf).select("claim_id", "condition", "tier", "conformal_label", "gate_label", "high_score")


@query("P07_gate_stats", _STATS + " SELECT * FROM t", "claims")
def p07(spark, sf):
    return P.gate_stats(_demo(spark, sf))


@query("P08_gate_case_study", _STATS + " SELECT coalesce(max(downgrade_rate) FILTER (condition = 'same_run'), 0) - coalesce(max(downgrade_rate) FILTER (condition = 'cross_run'), 0) AS downgrade_rate_diff, sum(n_claims)::BIGINT AS n_rows_total FROM t", "claims")
def p08(spark, sf):
    return P.downgrade_difference(P.gate_stats(_demo(spark, sf)))
