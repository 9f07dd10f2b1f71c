"""Resampling by seeded hashes: cluster bootstrap and permutation test."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import uniform
from ..sources.tables import stored

#: Distribution function of the Poisson law of mean 1, up to 12.
POISSON = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(12)]


def poisson(u: Column) -> Column:
    """The draw of mean 1 that a uniform stands for: how often a cluster stands in a replicate of many."""
    return reduce(lambda a, b: a + b, ((u >= c).cast("int") for c in POISSON))


def cluster_bootstrap(rows: DataFrame, cluster: str, parts: dict[str, Column], metric: Column, replicates: int, seed: int, confidence: float = 0.95) -> DataFrame:
    """mean, low, high, std of a measure of sums under drawing clusters with replacement.

    parts: sums per cluster, by name; metric: an expression of them. Each cluster is in each replicate as often as
    its own Poisson draw says, by a hash of both, so clusters need no numbers and no join; their sums are copied
    for each replicate and summed at once, before any shuffle."""
    per = rows.groupBy(cluster).agg(*(F.sum(c).alias(n) for n, c in parts.items()))
    draws = per.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draws = draws.withColumn("times", poisson(uniform(seed, F.col("rep").cast("string"), F.col(cluster).cast("string"))))
    sums = draws.groupBy("rep").agg(*(F.sum(F.col(p) * F.col("times")).alias(p) for p in parts))
    return interval(sums.select(metric.alias("m")), "m", confidence)


def fixed_bootstrap(rows: DataFrame, cluster: str, parts: dict[str, Column], metric: Column, replicates: int, seed: int, confidence: float = 0.95, slot: int = 20_000) -> DataFrame:
    """As `cluster_bootstrap`, but every replicate draws exactly as many clusters as there are, with replacement.

    Clusters are dealt to slots of about `slot` by a hash. How many draws of a replicate fall into each slot is multinomial
    by the slots' sizes, and within a slot all clusters are equally likely, which together is the same as drawing from all.
    A slot's task repeats the first draw by the seed and the replicate, so only the sizes, one number for each slot, are
    shared, and only one row of sums for each slot and replicate is shuffled. Sums of parts are doubles. Null is a cluster."""
    per = stored(rows.groupBy(cluster).agg(*(F.sum(c).cast("double").alias(n) for n, c in parts.items())))
    slots = max(1, -(-per.count() // slot))
    placed = per.withColumn("_slot", F.pmod(F.xxhash64(cluster), F.lit(slots)).cast("int"))
    sizes = placed.groupBy("_slot").agg(F.count("*").alias("n"))
    every = sizes.agg(F.array_sort(F.collect_list(F.struct("_slot", "n"))).alias("x")).select(F.col("x._slot").alias("slots"), F.col("x.n").alias("numbers"))
    # all sizes stand once beside each slot, not on each of its clusters
    shared = sizes.select(F.col("_slot").alias("_of")).crossJoin(F.broadcast(every))
    names = list(parts)

    def sums(key, pdf, sized):
        if not len(pdf):
            return pd.DataFrame({"rep": [], **{n: [] for n in names}})
        numbers = np.asarray(sized["numbers"].iloc[0])
        mine = int(np.searchsorted(sized["slots"].iloc[0], key[0]))
        values = pdf.sort_values(cluster, kind="stable")[names].fillna(0.0).to_numpy(np.float64)
        out = np.empty((replicates, len(names)))
        for rep in range(replicates):
            draws = np.random.default_rng([seed, rep]).multinomial(numbers.sum(), numbers / numbers.sum())[mine]
            picked = np.random.default_rng([seed, rep, key[0] + 1]).integers(len(values), size=draws)
            out[rep] = np.bincount(picked, minlength=len(values)) @ values
        return pd.DataFrame({"rep": np.arange(replicates), **{n: out[:, i] for i, n in enumerate(names)}})

    schema = "rep long, " + ", ".join(f"`{n}` double" for n in names)
    drawn = placed.groupBy("_slot").cogroup(shared.groupBy("_of")).applyInPandas(sums, schema).groupBy("rep").agg(*(F.sum(n).alias(n) for n in names))
    return interval(drawn.select(metric.alias("m")), "m", confidence)


def interval(values: DataFrame, value: str, confidence: float) -> DataFrame:
    """mean, low, high, std of one value for each replicate."""
    tail = (1 - confidence) / 2
    return values.agg(F.avg(value).alias("mean"), F.percentile(value, tail).alias("low"), F.percentile(value, 1 - tail).alias("high"), F.stddev_samp(value).alias("std"))


def permutation_test(rows: DataFrame, key: str, group: str, value: str, replicates: int, seed: int, slots: int = 1000) -> DataFrame:
    """observed difference of means between group true and false, and p: share of relabelings whose difference is at least as large, without + 1."""
    sizes = rows.agg(F.count_if(group).alias("n_a"), F.count("*").alias("n"), F.sum(value).alias("total"), (F.avg(F.when(F.col(group), F.col(value))) - F.avg(F.when(~F.col(group), F.col(value)))).alias("observed"))
    copies = rows.select(key, value, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    copies = copies.withColumn("u", uniform(seed, F.col("rep").cast("string"), F.col(key).cast("string"))).withColumn("slot", F.floor(F.col("u") * slots))
    # of each replicate the n_a rows of least hash are group a: whole slots of hashes, then some of the slot where n_a falls
    by = Window.partitionBy("rep").orderBy("slot")
    counts = copies.groupBy("rep", "slot").agg(F.count("*").alias("c"), F.sum(value).alias("s")).crossJoin(F.broadcast(sizes))
    counts = counts.withColumn("upto", F.sum("c").over(by)).withColumn("below", F.sum("s").over(by))
    whole = counts.where("upto <= n_a").groupBy("rep").agg(F.max("upto").alias("taken"), F.sum("s").alias("a"))
    split = counts.where("upto > n_a and upto - c < n_a").select("rep", "slot", (F.col("n_a") - F.col("upto") + F.col("c")).alias("left"))
    ranked = copies.join(F.broadcast(split), ["rep", "slot"]).withColumn("k", F.row_number().over(Window.partitionBy("rep").orderBy("u", key)))
    some = ranked.where("k <= left").groupBy("rep").agg(F.sum(value).alias("a"))
    per = whole.select("rep", "a").unionByName(some).groupBy("rep").agg(F.sum("a").alias("a")).crossJoin(F.broadcast(sizes))
    diff = F.col("a") / F.col("n_a") - (F.col("total") - F.col("a")) / (F.col("n") - F.col("n_a"))
    return per.agg(F.first("observed").alias("observed"), F.avg((F.abs(diff) >= F.abs("observed")).cast("double")).alias("p"))
