"""Selection among candidates, splits, samples, and models of shift."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..fixtures import uniform
from .ranks import running


def best_of_n(candidates: DataFrame, tau: float = 0.85) -> DataFrame:
    """(image, idx, faithfulness, coverage, flagged): of the candidates with mean score tau and more the one of most coverage, else the most faithful, flagged.

    candidates: image, idx, faithfulness (0 without claims), coverage; ties go to the lower idx."""
    ok = F.col("faithfulness") >= tau
    order = Window.partitionBy("image").orderBy(ok.desc(), F.when(ok, F.col("coverage")).desc_nulls_last(), F.when(~ok, F.col("faithfulness")).desc_nulls_last(), "idx")
    return candidates.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("image", "idx", "faithfulness", "coverage", (~ok).alias("flagged"))


#: What two candidates are compared by: the sets of their claims, or of the words of their reports.
DISTANCES = {"jaccard": lambda: F.array_distinct("items"), "rouge": lambda: F.filter(F.array_distinct(F.split(F.lower("text"), r"\s+")), lambda w: w != "")}


def least_risk(candidates: DataFrame, tau: float = 0.85, weight: float = 0.5, distance: str = "jaccard") -> DataFrame:
    """As best_of_n, with coverage less weight times the mean distance to the image's other candidates, a name of DISTANCES.

    candidates also have `items` (array; jaccard) or `text` (rouge). Candidates of an image are few; they pair within it once."""
    if distance not in DISTANCES:
        raise ValueError(f"no distance {distance}")
    own = DISTANCES[distance]()
    a = candidates.select("image", F.col("idx").alias("i"), own.alias("x"))
    b = candidates.select("image", F.col("idx").alias("j"), own.alias("y"))
    union = F.size(F.array_union("x", "y"))
    pair = a.join(b, "image").where("i <> j").select("image", F.col("i").alias("idx"), F.when(union > 0, 1 - F.size(F.array_intersect("x", "y")) / union).otherwise(0.0).alias("d"))
    mean = pair.groupBy("image", "idx").agg(F.avg("d").alias("distance"))
    rows = candidates.join(mean, ["image", "idx"], "left").na.fill(0.0, ["distance"])
    scored = rows.withColumn("_coverage", F.col("coverage")).withColumn("coverage", F.round(F.col("coverage") - weight * F.col("distance"), 12))
    return best_of_n(scored, tau).select("image", "idx", "flagged")


def stratified_split(patients: DataFrame, shares: dict[str, float], seed: int, key: str = "patient_id") -> DataFrame:
    """(key, stratum, split): by sex and tertile of the number of studies; strata of one patient become `other`.

    patients: key, sex, n_studies. Within a stratum patients are ranked by hash and cut at cumulative shares."""
    cuts = patients.agg(F.percentile("n_studies", 1 / 3).alias("_a"), F.percentile("n_studies", 2 / 3).alias("_b"))
    rows = patients.crossJoin(F.broadcast(cuts))
    tertile = F.when(F.col("n_studies") <= F.col("_a"), 0).when(F.col("n_studies") <= F.col("_b"), 1).otherwise(2)
    rows = rows.withColumn("stratum", F.concat_ws("_", "sex", tertile.cast("string")))
    rows = rows.withColumn("stratum", F.when(F.count("*").over(Window.partitionBy("stratum")) > 1, F.col("stratum")).otherwise("other"))
    w = Window.partitionBy("stratum")
    place = (F.row_number().over(w.orderBy(uniform(seed, F.col(key).cast("string")), key)) - 1) / F.count("*").over(w)
    split, upto = None, 0.0
    for name, share in shares.items():
        upto = round(upto + share, 9)
        split = F.when(F.col("_p") < upto, name) if split is None else split.when(F.col("_p") < upto, name)
    return rows.withColumn("_p", place).select(key, "stratum", F.coalesce(split, F.lit(name)).alias("split"))


def sample_per_class(rows: DataFrame, column: str, classes: tuple[str, ...], n: int, seed: int, key: str = "claim_id") -> DataFrame:
    """Up to n rows of each known class, by seeded hash; others go. Adds position: classes in order, rows by hash."""
    known = rows.where(F.col(column).isin(*classes))
    u = uniform(seed, F.col(key))
    kept = known.withColumn("_k", F.row_number().over(Window.partitionBy(column).orderBy(u, key))).where(F.col("_k") <= n)
    order = F.coalesce(*(F.when(F.col(column) == c, i) for i, c in enumerate(classes)))
    return kept.withColumn("position", order * n + F.col("_k")).drop("_k")


def fit_temperature(rows: DataFrame, logit: str, label: str, low: float = 0.05, high: float = 10.0, points: int = 11, tolerance: float = 0.01) -> DataFrame:
    """(temperature, nll): the T of least mean negative log likelihood of binary labels by sigmoid(logit / T).

    The likelihood has one best T, so each round, one aggregate over the rows, narrows the bounds to the neighbours
    of the best of its points, until they lie closer than the tolerance. No rows give no row."""
    z, y = F.col(logit), F.col(label).cast("double")
    while True:
        grid = [low + (high - low) * i / (points - 1) for i in range(points)]
        loss = [F.avg(F.log1p(F.exp(-F.abs(z / t))) + F.greatest(z / t, F.lit(0.0)) - y * z / t) for t in (max(g, 0.01) for g in grid)]
        means = rows.agg(*(x.alias(f"t{i}") for i, x in enumerate(loss))).first()  # one row of means
        if means[0] is None:
            return rows.sparkSession.createDataFrame([], "temperature double, nll double")
        best = min(range(points), key=lambda i: (means[i], i))
        if grid[1] - grid[0] <= tolerance:
            return rows.sparkSession.createDataFrame([(grid[best], means[best])], "temperature double, nll double")
        low, high = grid[max(best - 1, 0)], grid[min(best + 1, points - 1)]


def density_ratio(cal: DataFrame, test: DataFrame, vector: str = "vector", parts: int = 16) -> DataFrame:
    """cal and test rows with weight = odds of being a test row, times n_cal / n_test, within [1e-4, 10].

    Vectors are scaled, reduced to `parts` components (fewer for shorter vectors or fewer rows) and told apart by logistic regression, all distributed."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    both = cal.withColumn("_y", F.lit(0.0)).unionByName(test.withColumn("_y", F.lit(1.0))).withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    width = both.agg(F.max(F.size(vector)), F.count("*")).first()
    if not width[1]:
        raise ValueError("no rows")
    parts = max(1, min(parts, width[0], width[1]))
    steps = [StandardScaler(inputCol="_v", outputCol="_s", withMean=True), PCA(k=parts, inputCol="_s", outputCol="_c"), LogisticRegression(featuresCol="_c", labelCol="_y", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_q", maxIter=50)]
    out = Pipeline(stages=steps).fit(both).transform(both)
    n = both.agg(F.count_if(F.col("_y") == 0).alias("_a"), F.count_if(F.col("_y") == 1).alias("_b"))
    p = vector_to_array("_p")[1]
    weight = F.least(F.greatest(F.coalesce(F.try_divide(p, 1 - p), F.lit(float("inf"))) * F.col("_a") / F.col("_b"), F.lit(1e-4)), F.lit(10.0))
    return out.crossJoin(F.broadcast(n)).withColumn("weight", weight).withColumn("is_test", F.col("_y") == 1).drop("_y", "_v", "_s", "_c", "_p", "_r", "_q", "_a", "_b")


@F.pandas_udf(DoubleType())
def ks_tail(statistic: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """The exact chance that the distribution functions of two samples of one law lie at least so far apart, for one row of sizes.

    Orders of the joint sample are paths over a grid of n by m; those that stay nearer than the statistic are counted row by row."""
    return pd.Series([path_tail(*x) for x in zip(statistic, n, m)], dtype="float64")


def path_tail(statistic: float, n: int, m: int) -> float:
    n, m = int(n), int(m)
    far = round(statistic * n * m)  # the differences are multiples of 1 / (n m)
    if far <= 0:
        return 1.0
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + m + 1)))])
    paths = lambda x, y: log_factorial[x + y] - log_factorial[x] - log_factorial[y]
    # share[y]: of all paths to (x, y), how many have stayed near
    share = np.where(np.arange(m + 1) * n < far, 1.0, 0.0)
    for x in range(1, n + 1):
        y = np.arange(max(0, (x * m - far) // n + 1), min(m, -(-(x * m + far) // n) - 1) + 1)
        # places that a path visits with less than e^-60 do not count, so that the numbers of paths stay within a float's range
        y = y[paths(x, y) + paths(n - x, m - y) - paths(n, m) > -60]
        own = np.zeros(m + 1)
        if len(y):
            size = paths(x, y)  # rising
            count = np.exp(size - (size[0] + size[-1]) / 2)
            # a path comes from the left with chance x / (x + y), else from below
            own[y] = np.cumsum(count * share[y] * x / (x + y)) / count
        share = own
    return float(min(max(1.0 - share[m], 0.0), 1.0))


#: Up to this size of the larger sample the tail is exact.
EXACT = 10_000


def two_sample_ks(rows: DataFrame, value: str, is_test: str) -> DataFrame:
    """statistic, p: largest difference of the two distribution functions, from counts by distinct value; p is exact where neither sample
    has more than EXACT rows, else by the asymptotic series; null without rows in one of them."""
    counts = rows.groupBy(F.round(value, 9).alias("x")).agg(F.count_if(~F.col(is_test)).alias("a"), F.count_if(F.col(is_test)).alias("b"))
    cum = running(counts, "x", ["a", "b"]).withColumn("ca", F.try_divide("a_cum", "a_all")).withColumn("cb", F.try_divide("b_cum", "b_all"))
    s = cum.agg(F.max(F.abs(F.col("ca") - F.col("cb"))).alias("statistic"), F.sum("a").alias("n"), F.sum("b").alias("m"))
    e = F.sqrt(F.try_divide(F.col("n") * F.col("m"), F.col("n") + F.col("m")))
    lam = (e + 0.12 + F.try_divide(F.lit(0.11), e)) * F.col("statistic")
    series = F.least(F.greatest(sum((2 * (-1) ** (k - 1) * F.exp(-2 * k * k * lam * lam) for k in range(1, 60)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    # only sizes within the bound go to the exact count
    small = F.greatest("n", "m") <= EXACT
    sized = lambda c: F.when(small, F.col(c)).otherwise(1)
    exact = ks_tail(F.coalesce("statistic", F.lit(0.0)), sized("n"), sized("m"))
    return s.select("statistic", F.when(F.col("statistic").isNull(), None).when(small, exact).otherwise(series).alias("p"))


def adaptive_triage(cal: DataFrame, test: DataFrame, alpha: float = 0.05, level: float = 0.05) -> DataFrame:
    """Triage whose p-values are weighted by the density ratio if the first component shifts between cal and test (KS test).

    cal: vector, score, label; adds p, accepted and weighted to test."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from .conformal import p_values, step_up

    both = cal.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True))).withColumn("_v", array_to_vector(F.col("vector").cast("array<double>")))
    model = Pipeline(stages=[StandardScaler(inputCol="_v", outputCol="_s", withMean=True), PCA(k=1, inputCol="_s", outputCol="_c")]).fit(both)
    first = model.transform(both).select("is_test", vector_to_array("_c")[0].alias("x"))
    shifted = two_sample_ks(first, "x", "is_test").first().p < level
    if shifted:
        rows = density_ratio(cal, test)
        cal, test = rows.where("not is_test"), rows.where("is_test").drop("is_test", "weight")
    out = p_values(cal.where("label = 1"), test, weight="weight" if shifted else None)
    return step_up(out, alpha).withColumn("weighted", F.lit(shifted))


def pair_set(reports: DataFrame, claims: Column, n: int, seed: int) -> DataFrame:
    """(report_id, text, claims): n reports of more than 20 letters by seeded hash, with their decomposed claims."""
    long = reports.where(F.length("text") > 20).orderBy(uniform(seed, F.col("report_id").cast("string")), "report_id").limit(n)
    return long.select("report_id", "text", claims.alias("claims"))
