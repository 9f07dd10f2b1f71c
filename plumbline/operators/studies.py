"""Baselines and ablations by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .conformal import step_up_sums


def all_rows(rows: DataFrame) -> DataFrame:
    return rows


def best_of_report(rows: DataFrame) -> DataFrame:
    """The claim of highest score of each report; ties go to the lesser claim_id."""
    order = Window.partitionBy("report_id").orderBy(F.desc("score"), "claim_id")
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


#: Functions from scored claims to those that a method without verification accepts.
BASELINES = {"no_verification": all_rows, "best_candidate": best_of_report}


def _best_of(n: int) -> Column:
    """The score where the claim is the best of its report's first n candidates, else null. One order of a report's claims serves every n."""
    among = F.col("line") <= n
    order = Window.partitionBy("report_id").orderBy(F.desc("score"), "claim_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.when(among & (F.sum(among.cast("int")).over(order) == 1), F.col("score"))


#: Name -> (score that triage sees, null for rows outside; group of the thresholds), both made when asked for.
ABLATIONS = {
    "base": lambda: (F.col("score"), F.col("pathology")),
    "no_retrieval": lambda: (F.col("score_no_retrieval"), F.col("pathology")),
    "random_negatives": lambda: (F.col("score_random_negatives"), F.col("pathology")),
    "best_of_4": lambda: (_best_of(4), F.col("pathology")),
    "best_of_8": lambda: (_best_of(8), F.col("pathology")),
    "global_threshold": lambda: (F.col("score"), F.lit("all")),
}


def run_ablations(rows: DataFrame, names: list[str], is_cal: Column, alpha: float = 0.05, null_label: int = 1, base: str = "base") -> DataFrame:
    """condition, n, n_green, fdr, green_share, and the differences of the last two from the condition `base`.

    Each condition calibrates on the rows of is_cal with null_label (1: contradicted) and selects the others within its groups. One scan feeds
    all conditions, whose rows are written once and ranked once."""
    unknown = [n for n in names if n not in ABLATIONS]
    if unknown:
        raise ValueError(f"no ablations named {unknown}")
    made = {n: ABLATIONS[n]() for n in names}
    marked = rows.select("label", is_cal.alias("_cal"), *(F.struct(F.lit(n).alias("condition"), F.concat_ws("|", F.lit(n), g).alias("part"), s.alias("score")).alias(f"_{n}") for n, (s, g) in made.items()))
    long = marked.select("label", "_cal", F.explode(F.filter(F.array(*(f"_{n}" for n in names)), lambda x: x["score"].isNotNull())).alias("x")).select("label", "_cal", "x.*")
    is_test = ~F.col("_cal")
    part = long.where(is_test | (F.col("label") == null_label)).select("condition", "part", "score", F.col("_cal").cast("int").alias("w"), is_test.cast("int").alias("n"), (is_test & (F.col("label") == 1)).cast("int").alias("_bad"))
    agg = step_up_sums(part, alpha, ["condition", "part"], ["_bad"]).groupBy("condition").agg(*(F.sum(c).alias(c) for c in ("n", "n_green", "_bad")))
    agg = stored(agg)  # a row for each condition
    out = agg.select("condition", "n", "n_green", F.when(F.col("n_green") > 0, F.col("_bad") / F.col("n_green")).otherwise(0.0).alias("fdr"), (F.col("n_green") / F.col("n")).alias("green_share"))
    own = out.where(F.col("condition") == base).select(F.col("fdr").alias("_f"), F.col("green_share").alias("_g"))
    both = out.join(F.broadcast(own), F.lit(True), "left")  # one row
    return both.select("condition", "n", "n_green", "fdr", "green_share", (F.col("fdr") - F.col("_f")).alias("delta_fdr"), (F.col("green_share") - F.col("_g")).alias("delta_green_share"))
