"""Agreement and resampling: A17, B01 to B03, C27, J04, T24 codes."""

from pyspark.sql import functions as F

from ..fixtures import GRADES, claims, ratings, uniform_sql, workbook
from ..operators import agreement as G
from ..operators import resample as R
from .registry import query


def _alpha(level, src="ratings", key=None):
    k = f"{key}, " if key else ""
    p = f"PARTITION BY {key}" if key else ""
    d = {"nominal": "(c <> k)::DOUBLE", "interval": "(c - k) ** 2", "ratio": "CASE WHEN c + k = 0 THEN 0 ELSE ((c - k) / (c + k)) ** 2 END", "ordinal": "CASE WHEN c = k THEN 0 ELSE (abs(cum_k - cum_c) + CASE WHEN c <= k THEN n_c ELSE n_k END - (n_c + n_k) / 2) ** 2 END"}[level]
    using = f"{key}, " if key else ""
    cross = f"JOIN (SELECT {k}c AS k, n_c AS n_k, cum_c AS cum_k FROM mg) USING ({key})" if key else "CROSS JOIN (SELECT c AS k, n_c AS n_k, cum_c AS cum_k FROM mg)"
    group = f" GROUP BY {key}" if key else ""
    return f"""cn AS (SELECT {k}unit_id, value, count(*) AS n FROM {src} GROUP BY {k}unit_id, value), un AS (SELECT *, sum(n) OVER (PARTITION BY {k}unit_id) AS m FROM cn),
pr AS (SELECT {'a.' + k if key else ''}a.value AS c, b.value AS k, sum(a.n * (b.n - (a.value = b.value)::INT) / (a.m - 1)) AS o FROM un a JOIN un b ON a.unit_id = b.unit_id {f'AND a.{key} = b.{key}' if key else ''} WHERE a.m > 1 GROUP BY ALL),
mg AS (SELECT *, sum(n_c) OVER ({p} ORDER BY c) AS cum_c, sum(n_c) OVER ({p}) AS total FROM (SELECT {k}c, sum(o) AS n_c FROM pr GROUP BY {k}c)),
gd AS (SELECT *, {d} AS d FROM mg {cross} LEFT JOIN pr USING ({using}c, k)),
al AS (SELECT {k}CASE WHEN sum(n_c * n_k * d) = 0 THEN 1.0 ELSE 1 - (max(total) - 1) * sum(coalesce(o, 0) * d) / sum(n_c * n_k * d) END AS alpha FROM gd{group})"""


def _levels():
    parts = []
    for level in ("nominal", "ordinal", "interval", "ratio"):
        parts.append(f"SELECT '{level}' AS level, alpha FROM (WITH {_alpha(level)} SELECT alpha FROM al)")
    return " SELECT level, round(alpha, 9) AS alpha FROM (" + " UNION ALL ".join(parts) + ")"


@query("A17_krippendorff_alpha", _levels(), "ratings")
def a17(spark, sf):
    rows, out = ratings(spark, sf), None
    for level in ("nominal", "ordinal", "interval", "ratio"):
        one = G.krippendorff(rows, level).select(F.lit(level).alias("level"), F.round("alpha", 9).alias("alpha"))
        out = one if out is None else out.unionByName(one)
    return out


_ORD = ", gr AS (SELECT claim_id AS unit_id, unnest([{{'c': 'a', 'g': grader_a_label}}, {{'c': 'b', 'g': grader_b_label}}, {{'c': 'u', 'g': user_label}}]) AS x FROM workbook), orr AS (SELECT unit_id, x.c AS coder, CASE x.g {w} END::DOUBLE AS value FROM gr WHERE x.g IS NOT NULL)".format(w=" ".join(f"WHEN '{g}' THEN {i}" for i, g in enumerate(GRADES)))


def _coded(spark, sf):
    order = F.coalesce(*(F.when(F.col("g") == g, float(i)) for i, g in enumerate(GRADES)))
    return workbook(spark, sf).unpivot(["claim_id"], ["grader_a_label", "grader_b_label", "user_label"], "coder", "g").where("g is not null").select(F.col("claim_id").alias("unit_id"), "coder", order.alias("value"))


@query("C27_fallback_ladder", _ORD + ", r1 AS (SELECT * FROM orr), r2 AS (SELECT * FROM orr WHERE value <> 4), r3 AS (SELECT unit_id, coder, CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM orr), al3 AS (" + " UNION ALL ".join(f"SELECT {i} AS rung, alpha FROM (WITH {_alpha(lv, f'r{i}')} SELECT alpha FROM al)" for i, lv in ((1, "ordinal"), (2, "ordinal"), (3, "nominal"))) + ") SELECT rung, round(alpha, 9) AS alpha, alpha >= 0.35e0 AS passes, coalesce(rung = min(rung) FILTER (alpha >= 0.35e0) OVER (), false) AS chosen FROM al3", "workbook")
def c27(spark, sf):
    return G.fallback_ladder(_coded(spark, sf), 4.0, F.col("value") == 0.0, 0.35).withColumn("alpha", F.round("alpha", 9))


_REP, _SEED = 40, 3
_DRAW = ", dr AS (SELECT *, " + " + ".join(f"(u >= {c!r}e0)::INT" for c in R.POISSON) + " AS times FROM (SELECT *, {u} AS u FROM {src}, (SELECT unnest(range({r})) AS rep)))"
def _bootstrap_sql(replicates):
    return ", us AS (SELECT DISTINCT unit_id FROM ratings)" + _DRAW.format(src="us", u=uniform_sql(_SEED, "rep::VARCHAR", "unit_id::VARCHAR"), r=replicates) + f""", cn AS (SELECT rep, unit_id, value, count(*) AS n, max(times) AS w FROM dr JOIN ratings USING (unit_id) WHERE times > 0 GROUP BY 1, 2, 3), un AS (SELECT *, sum(n) OVER (PARTITION BY rep, unit_id) AS m FROM cn),
pr AS (SELECT a.rep, a.value AS c, b.value AS k, sum(a.w * a.n * (b.n - (a.value = b.value)::INT) / (a.m - 1)) AS o FROM un a JOIN un b ON a.unit_id = b.unit_id AND a.rep = b.rep WHERE a.m > 1 GROUP BY ALL),
mg AS (SELECT *, sum(n_c) OVER (PARTITION BY rep) AS total FROM (SELECT rep, c, sum(o) AS n_c FROM pr GROUP BY 1, 2)),
gd AS (SELECT mg.rep, mg.c, b.c AS k, mg.n_c, b.n_c AS n_k, mg.total, pr.o FROM mg JOIN mg b ON mg.rep = b.rep LEFT JOIN pr ON pr.rep = mg.rep AND pr.c = mg.c AND pr.k = b.c),
al AS (SELECT rep, 1 - (max(total) - 1) * sum(coalesce(o, 0)) FILTER (c <> k) / sum(n_c * n_k) FILTER (c <> k) AS alpha FROM gd GROUP BY 1)
SELECT round(quantile_cont(alpha, 0.025), 9) AS low, round(quantile_cont(alpha, 0.975), 9) AS high, round(stddev_samp(alpha), 9) AS std, count(alpha) AS n FROM al"""


@query("B02_bootstrap_alpha", _bootstrap_sql(_REP), "ratings")
def b02(spark, sf):
    out = G.bootstrap_alpha(ratings(spark, sf), "nominal", _REP, _SEED)
    return out.select(*(F.round(c, 9).alias(c) for c in ("low", "high", "std")), "n")


_B01 = ", pc AS (SELECT patient_id, count(*) FILTER (score >= 0.5e0) AS g, count(*) FILTER (score >= 0.5e0 AND label = 1) AS f FROM claims GROUP BY 1)" + _DRAW.format(src="pc", u=uniform_sql(_SEED, "rep::VARCHAR", "patient_id::VARCHAR"), r=_REP) + ", rp AS (SELECT rep, sum(f * times) / sum(g * times) AS m FROM dr GROUP BY 1) SELECT round(avg(m), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high, round(stddev_samp(m), 9) AS std FROM rp"


@query("B01_cluster_bootstrap", _B01, "claims")
def b01(spark, sf):
    green = F.col("score") >= 0.5
    out = R.cluster_bootstrap(claims(spark, sf), "patient_id", {"g": green.cast("int"), "f": (green & (F.col("label") == 1)).cast("int")}, F.col("f") / F.col("g"), _REP, _SEED)
    return out.select(*(F.round(c, 9).alias(c) for c in ("mean", "low", "high", "std")))


@query("B01_fixed_bootstrap")
def b01_fixed(spark, sf):
    """As B01, with as many patients in each replicate as there are."""
    green = F.col("score") >= 0.5
    return R.fixed_bootstrap(claims(spark, sf), "patient_id", {"g": green.cast("int"), "f": (green & (F.col("label") == 1)).cast("int")}, F.col("f") / F.col("g"), _REP, _SEED)


_B03 = f", ps AS (SELECT patient_id, patient_id % 2 = 0 AS a, round(avg(score), 6) AS v FROM claims GROUP BY 1), ob AS (SELECT count(*) FILTER (a) AS na, count(*) AS n, sum(v) AS total, avg(v) FILTER (a) - avg(v) FILTER (NOT a) AS observed FROM ps), cp AS (SELECT rep, v, row_number() OVER (PARTITION BY rep ORDER BY {uniform_sql(5, 'rep::VARCHAR', 'patient_id::VARCHAR')}, patient_id) AS k FROM ps, (SELECT unnest(range(30)) AS rep)), df AS (SELECT rep, sum(v) / max(na) - (max(total) - sum(v)) / (max(n) - max(na)) AS d, max(observed) AS observed FROM cp, ob WHERE k <= na GROUP BY 1) SELECT round(max(observed), 9) AS observed, avg((abs(d) >= abs(observed))::INT) AS p FROM df"


@query("B03_permutation_test", _B03, "claims")
def b03(spark, sf):
    rows = claims(spark, sf).groupBy("patient_id").agg(F.round(F.avg("score"), 6).alias("v")).withColumn("a", F.col("patient_id") % 2 == 0)
    return R.permutation_test(rows, "patient_id", "a", "v", 30, 5).withColumn("observed", F.round("observed", 9))


_J04 = ", sv AS (SELECT claim_id, max(CASE WHEN line % 5 = 0 THEN 'NONE' ELSE grader_a_label END) AS s FROM workbook WHERE line % 4 <> 0 GROUP BY 1), ow AS (SELECT CASE WHEN line = 7 THEN NULL ELSE claim_id END AS claim_id, user_label FROM workbook), jn AS (SELECT ow.*, sv.claim_id AS there, s FROM ow LEFT JOIN sv USING (claim_id)) SELECT CASE WHEN claim_id IS NULL THEN 'missing_id' WHEN there IS NULL THEN 'no_match' WHEN user_label IS NULL THEN 'invalid_label' WHEN s = 'NONE' THEN 'no_valid_grader' END AS reason, count(*) AS n FROM jn GROUP BY 1"


@query("J04_aligned_labels", _J04, "workbook")
def j04(spark, sf):
    rows = workbook(spark, sf)
    silver = rows.where("line % 4 <> 0").select("claim_id", F.when(F.col("line") % 5 == 0, "NONE").otherwise(F.col("grader_a_label")).alias("label"))
    own = rows.select(F.when(F.col("line") != 7, F.col("claim_id")).alias("claim_id"), "user_label")
    return G.align_labels(silver, own, GRADES).groupBy("reason").agg(F.count("*").alias("n"))
