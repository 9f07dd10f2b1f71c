"""Quality measures of scored and graded claims: aggregations to small tables."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .ranks import running


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty).cast("double"))


def binary_metrics(rows: DataFrame, predicted: Column, actual: Column, keys: list[str] | None = None) -> DataFrame:
    """n, precision, recall, f1, accuracy of a positive class; 0 where a denominator is."""
    marked = rows.withColumn("_p", predicted).withColumn("_a", actual)
    agg = marked.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.count_if(F.col("_p") & F.col("_a")).alias("tp"), F.count_if(F.col("_p") & ~F.col("_a")).alias("fp"), F.count_if(~F.col("_p") & F.col("_a")).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return agg.select(*(keys or []), "n", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(F.col("n") - fp - fn, F.col("n")).alias("accuracy"))


def laterality_error_rate(rows: DataFrame, text: str = "claim") -> DataFrame:
    """Contradicted share of the claims that speak of left or right; 0 without any."""
    sided = F.col(text).rlike(r"(?i)\b(left|right)\b")
    return rows.agg(F.count_if(sided).alias("n"), ratio(F.count_if(sided & (F.col("label") == 1)), F.count_if(sided)).alias("rate"))


def discoveries(rows: DataFrame, green: Column, keys: list[str] | None = None, null_label: int = 1) -> DataFrame:
    """n_green, false and true discoveries, fdr (0 if none is green), green share."""
    marked = rows.withColumn("_g", green)
    agg = marked.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.count_if("_g").alias("n_green"), F.count_if(F.col("_g") & (F.col("label") == null_label)).alias("n_false"))
    return agg.select(*(keys or []), "n_green", "n_false", (F.col("n_green") - F.col("n_false")).alias("n_true"), ratio(F.col("n_false"), F.col("n_green")).alias("fdr"), ratio(F.col("n_green"), F.col("n")).alias("green_share"))


def bins(score: Column, n: int = 10) -> Column:
    """Number of the bin: left closed by the edges i / n, the last one closed; found by counting edges."""
    below = sum((score >= i / n).cast("int") for i in range(1, n))
    return below


def reliability(rows: DataFrame, score: Column, correct: Column, n: int = 10) -> DataFrame:
    """bin, n, mean_score, accuracy of the bins that hold rows."""
    marked = rows.select(bins(score, n).alias("bin"), score.alias("_s"), correct.cast("double").alias("_c"))
    return marked.groupBy("bin").agg(F.count("*").alias("n"), F.avg("_s").alias("mean_score"), F.avg("_c").alias("accuracy"))


def calibration_error(diagram: DataFrame) -> DataFrame:
    """ece and mce of a reliability table."""
    gap = F.abs(F.col("mean_score") - F.col("accuracy"))
    return diagram.agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def class_report(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Per class: support, precision, recall, f1 from the counts of pairs."""
    pairs = rows.groupBy(actual, predicted).agg(F.count("*").alias("n"))
    each = pairs.select(F.explode(F.array(F.struct(F.col(actual).alias("c"), F.lit(1).alias("as_a"), F.lit(0).alias("as_p")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("as_a"), F.lit(1).alias("as_p")))).alias("x"), "n", (F.col(actual) == F.col(predicted)).alias("same"))
    agg = each.groupBy(F.col("x.c").alias("class")).agg(F.sum(F.col("n") * F.col("x.as_a")).alias("support"), F.sum(F.col("n") * F.col("x.as_p")).alias("predicted"), F.sum(F.when(F.col("same"), F.col("n") * F.col("x.as_a")).otherwise(0)).alias("hit"))
    return agg.select("class", "support", ratio(F.col("hit"), F.col("predicted")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"), ratio(2 * F.col("hit"), F.col("predicted") + F.col("support")).alias("f1"))


def ranking(rows: DataFrame, score: str, positive: Column, keys: list[str] | None = None) -> DataFrame:
    """auroc (Mann-Whitney, ties half) and average precision, exact, from counts by distinct score."""
    keys = keys or []
    counts = rows.groupBy(*keys, score).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    ranked = running(counts, score, ["pos", "neg"], keys, descending=True)
    won = F.col("neg") * (F.col("pos_cum") - F.col("pos") / 2)
    precision = F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))
    agg = ranked.groupBy(*keys).agg(F.sum(won).alias("won"), F.sum(F.col("pos") / F.col("pos_all") * precision).alias("average_precision"), F.first("pos_all").alias("p"), F.first("neg_all").alias("q"))
    return agg.select(*keys, (F.col("won") / (F.col("p") * F.col("q"))).alias("auroc"), "average_precision")


def icc(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Intra-group correlation ICC(1,1) of groups of two and more rows, clamped to [0, 1].

    The grand mean is over all rows. Under two groups give 0, no variance within gives 1."""
    per = rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    grand = rows.agg(F.avg(value).alias("grand"))
    multi = per.where("n > 1").crossJoin(F.broadcast(grand))
    s = multi.agg(
        F.count("*").alias("k"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within")
    )
    msb, msw = F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("total") - F.col("k"))
    n0 = (F.col("total") - F.col("sq") / F.col("total")) / (F.col("k") - 1)
    value_ = F.least(F.greatest((msb - msw) / (msb + (n0 - 1) * msw), F.lit(0.0)), F.lit(1.0))
    return s.select(F.col("k").alias("n_groups"), F.when(F.col("k") < 2, 0.0).when(msw == 0, 1.0).otherwise(value_).alias("icc"))


def fairness(rows: DataFrame, axes: list[str], alpha_green: Column) -> tuple[DataFrame, DataFrame]:
    """Measures per value of each axis, and per axis the largest difference (null with under two values)."""
    long = rows.withColumn("_g", alpha_green).select("label", "_g", F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes))).alias("x"))
    per = long.groupBy(F.col("x.axis").alias("axis"), F.col("x.value").alias("value")).agg(F.count("*").alias("n"), F.count_if("_g").alias("n_green"), F.count_if(F.col("_g") & (F.col("label") == 1)).alias("bad"), F.avg((F.col("label") == 1).cast("double")).alias("hallucination_rate"))
    per = per.select("axis", "value", "n", "n_green", ratio(F.col("bad"), F.col("n_green"), None).alias("fdr"), "hallucination_rate")
    gap = lambda c: F.when(F.count(c) >= 2, F.max(c) - F.min(c)).alias(f"{c}_disparity")
    return per, per.groupBy("axis").agg(gap("fdr"), gap("hallucination_rate"))


def mid_ranks(counts: DataFrame, value: str, n: str = "n") -> DataFrame:
    """(value, rank) of distinct values with their counts: the mean of the ranks that a value's rows share."""
    return running(counts, value, [n]).select(value, (F.col(f"{n}_cum") - (F.col(n) - 1) / 2).alias("rank"))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs under Student's t with n - 2 degrees of freedom: the regularised incomplete
    beta function of 1 - r^2 at (n - 2) / 2 and 1/2. 0 for r of 1 or -1, 1 for two pairs, null for fewer or without r.

    Its continued fraction is evaluated from the last term; the terms grow with the root of n, as convergence asks.
    Written as F.transform over one struct, so that a and x are computed once."""
    free = (n - 2).cast("double")
    tail = F.transform(F.array(F.struct((free / 2).alias("a"), F.greatest(1 - r * r, F.lit(0.0)).alias("x"))), lambda v: _beta_half(v["a"], v["x"]))
    return F.when(n == 2, F.when(r.isNotNull(), 1.0)).when((n > 2) & (F.abs(r) >= 1), 0.0).when(n > 2, F.get(tail, F.lit(0)))


def _beta_half(a: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, 1/2)."""
    shift = a + 20  # the ratio of gamma functions by its asymptotic series, taken where that is exact to 1e-11
    series = 1 - 1 / (8 * shift) + 1 / (128 * shift**2) + 5 / (1024 * shift**3) - 21 / (32768 * shift**4) - 399 / (262144 * shift**5)
    ratio_ = F.sqrt(shift) * series * reduce(lambda p, k: p * ((a + k) / (a + k + 0.5)), range(20), F.lit(1.0))
    front = F.exp(a * F.log(x)) * F.sqrt(1 - x) * ratio_ / F.sqrt(F.lit(math.pi))
    terms = F.sequence((200 + 8 * F.sqrt(a)).cast("int"), F.lit(1), F.lit(-1))

    def fraction(p, q, z):
        def step(rest, k):
            m = F.floor(k / 2)
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            return 1 + F.when(k % 2 == 0, even).otherwise(odd) / rest

        return F.aggregate(terms, F.lit(1.0), step)

    half = F.lit(0.5)
    direct = front / a / fraction(a, half, x)
    return F.when(x < (a + 1) / (a + 2.5), direct).otherwise(1 - front / half / fraction(half, a, 1 - x))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row on two numeric columns where both are known: n, rate of equal values, kappa over all values, Pearson's and
    Spearman's correlation (mid-ranks for ties) with two-sided p-values.

    Rows are counted by pair first and written once; ranks are running sums over distinct values. Kappa is 1 where chance
    alone agrees always; correlations and their p are null where a column is constant or there are fewer than two rows."""
    known = rows.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).where("a is not null and b is not null")
    pairs = stored(known.groupBy("a", "b").agg(F.count("*").alias("n")))
    sides = {c: pairs.groupBy(c).agg(F.sum("n").alias("n")) for c in "ab"}
    n = F.col("n").cast("double")
    both = sides["a"].withColumnRenamed("n", "na").join(sides["b"].select(F.col("b").alias("a"), F.col("n").alias("nb")), "a")
    chance = both.agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("chance"))
    ranked = pairs
    for c in "ab":
        ranked = ranked.join(mid_ranks(sides[c], c).withColumnRenamed("rank", f"r{c}"), c)
    middle = pairs.agg(F.sum("n").alias("all"), F.sum(n * F.col("a")).alias("sa"), F.sum(n * F.col("b")).alias("sb"))
    centred = ranked.crossJoin(F.broadcast(middle)).select("*", (F.col("a") - F.col("sa") / F.col("all")).alias("da"), (F.col("b") - F.col("sb") / F.col("all")).alias("db"), (F.col("ra") - (F.col("all") + 1) / 2).alias("ea"), (F.col("rb") - (F.col("all") + 1) / 2).alias("eb"))
    product = lambda x, y: F.sum(n * F.col(x) * F.col(y))

    def corr(x, y):
        spread = F.sqrt(product(x, x) * product(y, y))
        return F.when(spread > 0, F.greatest(F.least(product(x, y) / spread, F.lit(1.0)), F.lit(-1.0)))

    s = centred.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.when(F.col("a") == F.col("b"), n).otherwise(0.0)).alias("same"), corr("da", "db").alias("pearson"), corr("ea", "eb").alias("spearman")).crossJoin(F.broadcast(chance))
    kappa = F.when(n * n > F.col("chance"), (F.col("same") * n - F.col("chance")) / (n * n - F.col("chance"))).when(n > 0, 1.0)
    return s.select("n", (F.col("same") / n).alias("rate"), kappa.alias("kappa"), "pearson", correlation_p(F.col("pearson"), F.col("n")).alias("pearson_p"), "spearman", correlation_p(F.col("spearman"), F.col("n")).alias("spearman_p"))


def double_annotated(rows: DataFrame, first: str, second: str, positive: tuple[str, ...], least: int = 10) -> DataFrame:
    """One row on the rows that two people labelled (second neither null nor blank): n_double, kappa, rate and status of
    positive against other labels; insufficient, without kappa and rate, below `least` rows."""
    flag = lambda c: F.coalesce(F.trim(c).isin(*positive), F.lit(False)).cast("int")
    got = agreement(rows.where(F.trim(second) != "").select(flag(first).alias("x"), flag(second).alias("y")), "x", "y")
    enough = F.col("n") >= least
    return got.select(F.col("n").alias("n_double"), F.when(enough, F.col("kappa")).alias("kappa"), F.when(enough, F.col("rate")).alias("rate"), F.when(enough, "computed").otherwise("insufficient").alias("status"))


def majority(labels: list[str], valid: tuple[str, ...], least: int = 2, default: str = "UNCERTAIN") -> Column:
    """The valid label that at least `least` of the columns give; the earlier column wins a tie."""
    given = F.filter(F.array(*map(F.col, labels)), lambda x: x.isin(*valid))
    scored = F.transform(given, lambda x, i: F.struct(F.size(F.filter(given, lambda y: y == x)).alias("n"), (-i).alias("first"), x.alias("label")))
    best = F.array_max(scored)
    return F.when(best["n"] >= least, best["label"]).otherwise(default)


def with_dimension(rows: DataFrame, column: str, values: tuple[str, ...], *aggs: Column) -> DataFrame:
    """Aggregates by a column over a fixed list of values; values without rows stay, their counts null."""
    names = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(column))
    return F.broadcast(names).join(rows.groupBy(column).agg(*aggs), column, "left")


def score_block(rows: DataFrame, column: str, values: tuple[str, ...], score: str) -> DataFrame:
    """n, mean, std (population), least and greatest score per label, zeros for labels without rows."""
    out = with_dimension(rows, column, values, F.count("*").alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("low"), F.max(score).alias("high"))
    return out.na.fill(0, ["n"]).na.fill(0.0, ["mean", "std", "low", "high"])


def shifts(rows: DataFrame, size: str, metrics: list[str], guide: str, drop: float = -0.02) -> DataFrame:
    """Relative change of mean measures from the least to the greatest size, and whether the guide rose while a quality fell."""
    per = rows.groupBy(size).agg(*(F.avg(m).alias(m) for m in metrics))
    ends = per.agg(*(F.min_by(m, size).alias(f"{m}_0") for m in metrics), *(F.max_by(m, size).alias(f"{m}_1") for m in metrics))
    change = lambda m: F.when(F.col(f"{m}_0") != 0, (F.col(f"{m}_1") - F.col(f"{m}_0")) / F.abs(F.col(f"{m}_0"))).otherwise(0.0)
    out = ends.select(*(change(m).alias(f"{m}_change") for m in metrics))
    fell = F.lit(False)
    for m in metrics:
        if m != guide:
            fell = fell | (F.col(f"{m}_change") < drop)
    return out.withColumn("flagged", (F.col(f"{guide}_change") > 0) & fell)


def threshold_sweep(cal: DataFrame, target: float, steps: int = 200) -> DataFrame:
    """One row: the highest of the grid's thresholds i / (steps - 1) whose calibration FDR is within the target (null if none)."""
    grid = cal.sparkSession.range(steps).select((F.col("id") / (steps - 1)).alias("tau"))
    counts = cal.groupBy("score").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("bad"))
    # a row counts for every grid point up to its score: count by the last such point, then sum from above
    slot = counts.select(F.floor(F.col("score") * (steps - 1) + 1e-12).alias("slot"), "score", "n", "bad")
    slot = slot.withColumn("slot", F.when(F.col("slot") / (steps - 1) > F.col("score"), F.col("slot") - 1).otherwise(F.col("slot"))).groupBy("slot").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    full = grid.withColumn("slot", F.round(F.col("tau") * (steps - 1)).cast("bigint")).join(F.broadcast(slot), "slot", "left").na.fill(0, ["n", "bad"])
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("slot"))
    cum = full.withColumn("n", F.sum("n").over(above)).withColumn("bad", F.sum("bad").over(above))
    return cum.agg(F.max(F.when((F.col("n") > 0) & (F.col("bad") / F.col("n") <= target), F.col("tau"))).alias("tau"))


def unpivot(rows: DataFrame, ids: list[str], columns: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return rows.unpivot(ids, columns, name, value)


def gram_matches(rows: DataFrame, found: str, known: str, most: int = 4) -> DataFrame:
    """(n, grams, matches) of each task, for sums over all: runs of n words (up to `most`) in the arrays of `found`, and how many
    of them stand in the `known` array of the same row, each at most as often as there. Counted within the row; no run moves."""

    def count(batches):
        from collections import Counter

        total = {}
        for batch in batches:
            for own, other in zip(batch[found], batch[known]):
                own, other = list(own) if own is not None else [], list(other) if other is not None else []
                for n in range(1, most + 1):
                    a, b = (Counter(zip(*(w[i:] for i in range(n)))) for w in (own, other))
                    if a or b:
                        was = total.get(n, (0, 0))
                        total[n] = was[0] + sum(a.values()), was[1] + sum(min(k, b[g]) for g, k in a.items() if g in b)
        yield pd.DataFrame([(n, *x) for n, x in total.items()], columns=["n", "grams", "matches"]).astype("int64")

    return rows.select(found, known).mapInPandas(count, "n long, grams long, matches long")
