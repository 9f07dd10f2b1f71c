"""Agreement of coders: Krippendorff's alpha from pair counts, its bootstrap and the fallback ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import uniform
from ..sources.tables import stored
from .resample import poisson


def pair_counts(ratings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Coincidences: keys, c, k, o. Each unit with m codings of two and more gives n_c (n_k - [c = k]) / (m - 1)."""
    keys = keys or []
    unit_keys = [*(k for k in keys if k != "unit_id"), "unit_id"]
    return _pairs(ratings.where(F.col("value").isNotNull()).groupBy(*unit_keys, "value").agg(F.count("*").alias("n")), keys, unit_keys, F.lit(1))


def _pairs(counts: DataFrame, keys: list[str], unit_keys: list[str], times: Column) -> DataFrame:
    """Coincidences of counts (unit_keys, value, n) of units that stand for so many alike."""
    unit = counts.withColumn("m", F.sum("n").over(Window.partitionBy(*unit_keys))).where("m > 1")
    listed = unit.withColumn("all", F.collect_list(F.struct("value", "n")).over(Window.partitionBy(*unit_keys)))
    pairs = listed.select(*unit_keys, times.alias("times"), F.col("value").alias("c"), "n", "m", F.explode("all").alias("x"))
    same = F.when(F.col("c") == F.col("x.value"), 1).otherwise(0)
    return pairs.groupBy(*keys, "c", F.col("x.value").alias("k")).agg(F.sum(F.col("times") * F.col("n") * (F.col("x.n") - same) / (F.col("m") - 1)).alias("o"))


def distance(level: str, before: Column | None = None) -> Column:
    """Squared difference of values c and k. Ordinal: by the codings between them, from the margins of c and k."""
    c, k = F.col("c"), F.col("k")
    if level == "nominal":
        return F.when(c == k, 0.0).otherwise(1.0)
    if level == "interval":
        return F.pow(c - k, 2)
    if level == "ratio":
        return F.when(c + k == 0, 0.0).otherwise(F.pow((c - k) / (c + k), 2))
    if level == "ordinal":
        between = F.abs(F.col("cum_k") - F.col("cum_c")) + F.when(c <= k, F.col("n_c")).otherwise(F.col("n_k")) - (F.col("n_c") + F.col("n_k")) / 2
        return F.when(c == k, 0.0).otherwise(F.pow(between, 2))
    raise ValueError(f"no level {level}")


def alpha_of_pairs(pairs: DataFrame, level: str, keys: list[str] | None = None) -> DataFrame:
    """keys, alpha. 1 where no disagreement is expected; pairs are a small table."""
    keys = keys or []
    one = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    margin = pairs.groupBy(*keys, "c").agg(F.sum("o").alias("n_c")).withColumn("cum_c", F.sum("n_c").over(one.orderBy("c"))).withColumn("total", F.sum("n_c").over(one))
    other = margin.select(*keys, F.col("c").alias("k"), F.col("n_c").alias("n_k"), F.col("cum_c").alias("cum_k"))
    grid = margin.join(other, keys) if keys else margin.crossJoin(F.broadcast(other))
    grid = grid.join(pairs, [*keys, "c", "k"], "left").withColumn("d", distance(level))
    agg = grid.groupBy(*keys).agg(F.sum(F.coalesce("o", F.lit(0.0)) * F.col("d")).alias("seen"), F.sum(F.col("n_c") * F.col("n_k") * F.col("d")).alias("expected"), F.first("total").alias("total"))
    return agg.select(*keys, F.when(F.col("expected") == 0, 1.0).otherwise(1 - (F.col("total") - 1) * F.col("seen") / F.col("expected")).alias("alpha"))


def krippendorff(ratings: DataFrame, level: str = "nominal", keys: list[str] | None = None) -> DataFrame:
    """ratings: unit_id, coder, value. Units with under two codings do not count; without any other unit, as with one coder, it is an error."""
    out = alpha_of_pairs(pair_counts(ratings, keys), level, keys)
    return out.withColumn("alpha", F.coalesce("alpha", F.raise_error(F.lit("no unit has two codings")).cast("double")))


def bootstrap_alpha(ratings: DataFrame, level: str, replicates: int, seed: int, confidence: float = 0.95) -> DataFrame:
    """low, high, std, n: units are drawn with replacement, by Poisson draws of a seeded hash; replicates in which all drawn agree count as 1.

    The coincidences of each unit are found once; they are copied for each replicate and summed at once, before any shuffle."""
    own = pair_counts(ratings, ["unit_id"])
    copies = own.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    times = poisson(uniform(seed, F.col("rep").cast("string"), F.col("unit_id").cast("string")))
    drawn = copies.groupBy("rep", "c", "k").agg(F.sum(F.col("o") * times).alias("o")).where("o > 0")
    alphas = alpha_of_pairs(drawn, level, ["rep"])
    tail = (1 - confidence) / 2
    return alphas.agg(F.percentile("alpha", tail).alias("low"), F.percentile("alpha", 1 - tail).alias("high"), F.stddev_samp("alpha").alias("std"), F.count("alpha").alias("n"))


def align_labels(silver: DataFrame, own: DataFrame, valid: tuple[str, ...]) -> DataFrame:
    """silver (claim_id, label) with own labels; reason is the first cause for which a row of own is dropped, or null.

    Of several silver rows of a claim the last by label counts."""
    last = silver.groupBy("claim_id").agg(F.max("label").alias("silver_label"), F.lit(True).alias("there"))
    joined = own.select("claim_id", "user_label").join(last, "claim_id", "left")
    reason = F.when(F.col("claim_id").isNull() | (F.col("claim_id") == ""), "missing_id").when(F.col("there").isNull(), "no_match").when(~F.coalesce(F.trim("user_label").isin(*valid), F.lit(False)), "invalid_label").when(~F.coalesce(F.col("silver_label").isin(*valid), F.lit(False)), "no_valid_grader")
    return joined.select("claim_id", "user_label", "silver_label", reason.alias("reason"))


def coding_patterns(ratings: DataFrame) -> DataFrame:
    """(unit_id, value, n, times): of units with the same codings, null values included, one, whose unit_id is the list of its codings. Ratings are moved once."""
    counts = ratings.select("unit_id", "value").repartition("unit_id").groupBy("unit_id", "value").agg(F.count("*").alias("n"))
    units = counts.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias("codings"))
    alike = units.groupBy("codings").agg(F.count("*").alias("times"))
    return stored(alike).select(F.col("codings").alias("unit_id"), "times", F.explode("codings").alias("x")).select("unit_id", "x.value", "x.n", "times")


def fallback_ladder(ratings: DataFrame, uncertain: float, positive: Column, passing: float = 0.8) -> DataFrame:
    """rung, alpha, passes, chosen: full ordinal scale, without the uncertain value, and two classes nominal; the first that passes is chosen.

    Units are grouped once; all rungs come from their different lists of codings."""
    counts = coding_patterns(ratings)
    full = counts.where(F.col("value").isNotNull()).withColumn("rung", F.lit(1))
    partial = counts.where(F.col("value") != uncertain).withColumn("rung", F.lit(2))
    binary = counts.withColumn("value", F.when(positive, 1.0).otherwise(0.0)).groupBy("unit_id", "value", "times").agg(F.sum("n").alias("n")).withColumn("rung", F.lit(3))
    pairs = lambda rows: _pairs(rows, ["rung"], ["rung", "unit_id"], F.col("times"))
    checked = lambda rows, level: alpha_of_pairs(pairs(rows), level, ["rung"]).withColumn("alpha", F.coalesce("alpha", F.raise_error(F.lit("no unit has two codings")).cast("double")))
    rungs = checked(full.unionByName(partial), "ordinal").unionByName(checked(binary, "nominal")).withColumn("passes", F.col("alpha") >= passing)
    first = F.min(F.when(F.col("passes"), F.col("rung"))).over(Window.partitionBy(F.lit(0)))
    return rungs.withColumn("chosen", F.coalesce(F.col("rung") == first, F.lit(False)))
