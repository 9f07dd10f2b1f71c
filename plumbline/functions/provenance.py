"""Trust tiers of evidence and the gate that follows a triage label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of sources, tiers and final labels.
ORACLE, RETRIEVED, GENERATED, UNKNOWN_SOURCE = "oracle_report_text", "retrieved_report_text", "generator_output", "unknown"
TIERS = ("trusted", "independent", "same_model", "unknown")
CERTIFIABLE = ("trusted", "independent")
SUPPORTED, UNCERTIFIED, REVIEW, CONTRADICTED = "supported_trusted", "supported_uncertified", "review_required", "contradicted"


def trust_tier(source: Column, claim_generator: Column, evidence_generator: Column) -> Column:
    """Generated evidence is independent only if both generators are known and differ."""
    differ = F.coalesce(claim_generator != evidence_generator, F.lit(False))
    return F.when(source == ORACLE, "trusted").when(source == RETRIEVED, "independent").when(source == GENERATED, F.when(differ, "independent").otherwise("same_model")).otherwise("unknown")


def with_provenance(rows: DataFrame) -> DataFrame:
    """Fills the five provenance fields; a stored tier is never trusted but computed anew. Missing columns count as null."""
    have = set(rows.columns)
    field = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    rows = rows.withColumns({"evidence_source_type": F.coalesce(field("evidence_source_type"), F.lit(UNKNOWN_SOURCE)), "claim_generator_id": field("claim_generator_id"), "evidence_generator_id": field("evidence_generator_id")})
    rows = rows.withColumn("evidence_trust_tier", trust_tier(F.col("evidence_source_type"), F.col("claim_generator_id"), F.col("evidence_generator_id")))
    return rows.withColumn("evidence_is_independent", is_certifiable(F.col("evidence_trust_tier")))


def is_certifiable(tier: Column) -> Column:
    return F.coalesce(tier.isin(*CERTIFIABLE), F.lit(False))


def gate(label: Column, tier: Column) -> Column:
    """The final label: green needs a certifiable tier, yellow is for review, all else is contradicted."""
    return F.when(label == "green", F.when(is_certifiable(tier), SUPPORTED).otherwise(UNCERTIFIED)).when(label == "yellow", REVIEW).otherwise(CONTRADICTED)


def was_overridden(label: Column, tier: Column) -> Column:
    return F.coalesce(label == "green", F.lit(False)) & ~is_certifiable(tier)


def tier_counts(rows: DataFrame, tier: str = "evidence_trust_tier") -> DataFrame:
    """(tier, n): every tier, with zero where it does not occur; names that are not tiers count as unknown."""
    names = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, TIERS))).alias("tier"))
    counted = rows.select(F.when(F.col(tier).isin(*TIERS), F.col(tier)).otherwise("unknown").alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))
    return F.broadcast(names).join(counted, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def label_from_score(score: Column, threshold: float = 0.5) -> Column:
    """Green from the threshold, yellow from half of it, else red."""
    return F.when(score >= threshold, "green").when(score >= 0.5 * threshold, "yellow").otherwise("red")


def gate_demo(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds tier, conformal_label, gate_label and high_score to rows (condition, score, claim_generator_id, evidence_generator_id) of generated evidence."""
    rows = rows.withColumn("tier", trust_tier(F.lit(GENERATED), F.col("claim_generator_id"), F.col("evidence_generator_id")))
    rows = rows.withColumn("conformal_label", label_from_score(F.col("score"), threshold)).withColumn("high_score", F.col("score") >= threshold)
    return rows.withColumn("gate_label", gate(F.col("conformal_label"), F.col("tier")))


def gate_stats(rows: DataFrame) -> DataFrame:
    """Per condition: counts before and after the gate, and the share that it downgrades (0 where none was green)."""
    agg = rows.groupBy("condition").agg(
        F.count("*").alias("n_claims"),
        F.count_if("high_score").alias("n_high_score"),
        F.count_if(F.col("conformal_label") == "green").alias("n_pre_gate"),
        F.count_if(F.col("gate_label") == SUPPORTED).alias("n_post_gate"),
    )
    rate = F.when(F.col("n_pre_gate") > 0, (F.col("n_pre_gate") - F.col("n_post_gate")) / F.col("n_pre_gate")).otherwise(0.0)
    return agg.withColumn("downgrade_rate", rate)


def downgrade_difference(stats: DataFrame) -> DataFrame:
    """One row: downgrade rate of same_run less that of cross_run, 0 for a missing condition."""
    of = lambda c: F.coalesce(F.max(F.when(F.col("condition") == c, F.col("downgrade_rate"))), F.lit(0.0))
    return stats.agg((of("same_run") - of("cross_run")).alias("downgrade_rate_diff"), F.coalesce(F.sum("n_claims"), F.lit(0)).alias("n_rows_total"))
