"""Running sums over sorted values of any number, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored


def running(rows: DataFrame, value: str, sums: list[str], by: list[str] | None = None, descending: bool = False, then: list[str] | None = None) -> DataFrame:
    """Adds to rows, for each column s of sums, s_cum (its sum up to the row, in the order of value) and s_all (its sum over
    all rows), over the whole table or within each value of by.

    Approximate quantiles cut the values into as many ranges as there are shuffle partitions; each range is summed by its own
    window, and the ranges' totals, which are few, give what stands before it. Rows of one value count together unless the
    columns of `then` order them. For few groups: those of `by` and their ranges are broadcast. Rows whose group is null go.
    The rows are written once, since cuts, totals and sums all read them; so are the cuts, since approximate quantiles that
    are computed twice may differ, and totals of other ranges than the sums' would count rows wrongly."""
    by, then = by or [], then or []
    placed, before = ranges(rows, value, sums, by, descending)
    before = before.drop(*(f"{s}_own" for s in sums))
    within = Window.partitionBy(*by, "_part").orderBy(F.desc(value) if descending else F.col(value), *then)
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow) if then else within
    out = placed.select("*", *(F.sum(s).over(within).alias(f"{s}_cum") for s in sums)).join(F.broadcast(before), [*by, "_part"])
    return out.withColumns({f"{s}_cum": F.col(f"{s}_cum") + F.col(f"_{s}") for s in sums}).drop("_part", *(f"_{s}" for s in sums))


def ranges(rows: DataFrame, value: str, sums: list[str], by: list[str], descending: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows, written once, with _part, the number of their range; and of each range (by, _part) and each column s of sums
    _s, its sum over the ranges before it, s_own, over the range, and s_all, over all."""
    rows = stored(rows)
    parts = min(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 2), 500)
    cuts = stored(rows.groupBy(*by).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 20 * parts).alias("_cuts")))
    placed = rows.join(F.broadcast(cuts), by) if by else rows.crossJoin(F.broadcast(cuts))
    halves = F.array(*(F.lit(1 << i) for i in reversed(range(parts.bit_length()))))  # the number of cuts below the value, by halving
    below = F.aggregate(halves, F.lit(0), lambda n, step: F.when(F.get("_cuts", n + step - 1) < F.col(value), n + step).otherwise(n))
    placed = placed.withColumn("_part", below).drop("_cuts")
    totals = placed.groupBy(*by, "_part").agg(*(F.sum(s).alias(f"_{s}") for s in sums))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row for each range
    earlier = group.orderBy(F.desc("_part") if descending else F.col("_part")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, "_part", *(F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_{s}") for s in sums), *(F.col(f"_{s}").alias(f"{s}_own") for s in sums), *(F.sum(f"_{s}").over(group).alias(f"{s}_all") for s in sums))
    return placed, before


def quantile(rows: DataFrame, value: str, share: float, by: list[str]) -> DataFrame:
    """(by, quantile, n) of each group, between neighbours by linear interpolation, as percentile does.

    Rows are counted by value first; ranks are running sums, so no task holds the distinct values of a group."""
    ranked = running(rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")), value, ["n"], by)
    at = F.lit(share) * (F.col("n_all") - 1)
    # the value of rank r (from 0) is the least one with more than r rows up to it
    below, above = (F.min(F.when(F.col("n_cum") > r, F.col(value))) for r in (F.floor(at), F.ceil(at)))
    picked = ranked.groupBy(*by).agg(below.alias("_below"), above.alias("_above"), F.first("n_all").alias("n"))
    rest = F.lit(share) * (F.col("n") - 1) - F.floor(F.lit(share) * (F.col("n") - 1))
    return picked.select(*by, (F.col("_below") + (F.col("_above") - F.col("_below")) * rest).alias("quantile"), "n")
