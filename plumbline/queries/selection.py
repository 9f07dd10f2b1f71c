"""Selection, splits and shift: C11, C12, C19 to C22, C24, C28, C29, U05, S02, S10, T08, T14 to T16, T29 to T31, T34, T37, A33."""

import re

from pyspark.sql import functions as F

from .. import vocabulary as V
from ..fixtures import GRADES, claims, reports, table, uniform, uniform_sql, workbook
from ..functions import spans as S
from ..functions import text as T
from ..operators import selection as X
from ..operators.studies import ABLATIONS, run_ablations
from ..sources.tables import stored
from .registry import query
from .texts import _SENT as SENTENCES
from .texts import _count_sql as count_sql
from .texts import any_sql, q


def _candidates(spark, sf):
    return claims(spark, sf).groupBy("patient_id", (F.col("line") % 4).alias("idx")).agg(F.round(F.avg("score"), 9).alias("faithfulness"), F.countDistinct("finding").alias("coverage"), F.array_sort(F.collect_set("finding")).alias("items")).withColumnRenamed("patient_id", "image")


_CAND = ", ca AS (SELECT patient_id AS image, line % 4 AS idx, round(avg(score), 9) AS faithfulness, count(DISTINCT finding) AS coverage, list_sort(list(DISTINCT finding)) AS items FROM claims GROUP BY 1, 2)"


@query("C20_best_of_n", _CAND + " SELECT image, idx, faithfulness, coverage, faithfulness < 0.55e0 AS flagged FROM ca QUALIFY row_number() OVER (PARTITION BY image ORDER BY (faithfulness >= 0.55e0)::INT DESC, CASE WHEN faithfulness >= 0.55e0 THEN coverage END DESC NULLS LAST, CASE WHEN faithfulness < 0.55e0 THEN faithfulness END DESC NULLS LAST, idx) = 1", "claims")
def c20(spark, sf):
    return X.best_of_n(_candidates(spark, sf), 0.55)


@query("C21_least_risk", _CAND + ", d AS (SELECT a.image, a.idx, avg(1 - len(list_intersect(a.items, b.items)) / (len(a.items) + len(b.items) - len(list_intersect(a.items, b.items)))) AS d FROM ca a JOIN ca b ON a.image = b.image AND a.idx <> b.idx GROUP BY 1, 2), e AS (SELECT ca.*, round(coverage - 0.5e0 * coalesce(d, 0), 12) AS c FROM ca LEFT JOIN d USING (image, idx)) SELECT image, idx, faithfulness < 0.55e0 AS flagged FROM e QUALIFY row_number() OVER (PARTITION BY image ORDER BY (faithfulness >= 0.55e0)::INT DESC, CASE WHEN faithfulness >= 0.55e0 THEN c END DESC NULLS LAST, CASE WHEN faithfulness < 0.55e0 THEN faithfulness END DESC NULLS LAST, idx) = 1", "claims")
def c21(spark, sf):
    return X.least_risk(_candidates(spark, sf), 0.55)


_C21 = ", d AS (SELECT a.image, a.idx, avg(1 - len(list_intersect(a.items, b.items)) / (len(a.items) + len(b.items) - len(list_intersect(a.items, b.items)))) AS d FROM ca a JOIN ca b ON a.image = b.image AND a.idx <> b.idx GROUP BY 1, 2), e AS (SELECT ca.*, round(coverage - 0.1e0 * coalesce(d, 0), 12) AS c FROM ca LEFT JOIN d USING (image, idx)) SELECT image, idx, faithfulness < 0.55e0 AS flagged FROM e QUALIFY row_number() OVER (PARTITION BY image ORDER BY (faithfulness >= 0.55e0)::INT DESC, CASE WHEN faithfulness >= 0.55e0 THEN c END DESC NULLS LAST, CASE WHEN faithfulness < 0.55e0 THEN faithfulness END DESC NULLS LAST, idx) = 1"


@query("U05_word_distance", ", ca AS (SELECT patient_id AS image, line % 4 AS idx, round(avg(score), 9) AS faithfulness, count(DISTINCT finding) AS coverage, list_filter(list_distinct(string_split_regex(lower(string_agg(claim, ' ')), '\\s+')), lambda w: w <> '') AS items FROM claims GROUP BY 1, 2)" + _C21, "claims")
def u05(spark, sf):
    """Least risk by the words of the candidates' reports."""
    texts = claims(spark, sf).groupBy(F.col("patient_id").alias("image"), (F.col("line") % 4).alias("idx")).agg(F.array_join(F.collect_list("claim"), " ").alias("text"))
    return X.least_risk(_candidates(spark, sf).join(texts, ["image", "idx"]), 0.55, 0.1, "rouge")


_C22 = f", pt AS (SELECT patient_id, min(sex) AS sex, count(DISTINCT report_id) AS n FROM claims GROUP BY 1), st AS (SELECT patient_id, sex || '_' || CASE WHEN n <= (SELECT quantile_cont(n, 1 / 3) FROM pt) THEN '0' WHEN n <= (SELECT quantile_cont(n, 2 / 3) FROM pt) THEN '1' ELSE '2' END AS s FROM pt), so AS (SELECT patient_id, CASE WHEN count(*) OVER (PARTITION BY s) > 1 THEN s ELSE 'other' END AS stratum FROM st), pl AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY {uniform_sql(17, 'patient_id::VARCHAR')}, patient_id) - 1) / count(*) OVER (PARTITION BY stratum) AS p FROM so) SELECT patient_id, stratum, CASE WHEN p < 0.6e0 THEN 'train' WHEN p < 0.75e0 THEN 'cal' ELSE 'test' END AS split FROM pl"


@query("C22_stratified_split", _C22, "claims")
def c22(spark, sf):
    patients = claims(spark, sf).groupBy("patient_id").agg(F.min("sex").alias("sex"), F.countDistinct("report_id").alias("n_studies"))
    return X.stratified_split(patients, {"train": 0.6, "cal": 0.15, "test": 0.25}, 17)


@query("S02_split_counts", f", sp AS ({_C22.split(') SELECT patient_id, stratum')[0].replace(', pt AS', 'WITH pt AS', 1)}) SELECT CASE WHEN p < 0.6e0 THEN 'train' WHEN p < 0.75e0 THEN 'cal' ELSE 'test' END AS split FROM pl) SELECT split, count(*) AS n FROM sp GROUP BY 1", "claims")
def s02(spark, sf):
    from ..sources.tables import read_splits, write_splits

    path = write_splits(c22(spark, sf).select("patient_id", "split"), 17)
    return read_splits(spark, path).groupBy("split").agg(F.count("*").alias("n"))


@query("C24_sample_per_class", f"SELECT claim_id, grader_a_label, k + 20 * CASE grader_a_label " + " ".join(f"WHEN '{g}' THEN {i}" for i, g in enumerate(GRADES)) + f" END AS position FROM (SELECT *, row_number() OVER (PARTITION BY grader_a_label ORDER BY {uniform_sql(19, 'claim_id')}, claim_id) AS k FROM workbook) WHERE k <= 20", "workbook")
def c24(spark, sf):
    return X.sample_per_class(workbook(spark, sf), "grader_a_label", GRADES, 20, 19).select("claim_id", "grader_a_label", F.col("position").cast("bigint").alias("position"))


def _narrowed(rounds: int, points: int = 11) -> str:
    """The rounds of the temperature's fit as views, each from the bounds that the last one left."""
    loss = "avg(ln(1 + exp(-abs(z / t))) + greatest(z / t, 0) - y * z / t)"
    out = ", z AS (SELECT 4 * (score - 0.5e0) AS z, CASE WHEN label = 1 THEN 0 ELSE 1 END AS y FROM claims), b0 AS (SELECT 0.05e0 AS lo, 10e0 AS hi)"
    for k in range(rounds):
        last = points - 1
        out += f", g{k} AS (SELECT i, lo, hi, lo + (hi - lo) * i / {last}e0 AS t FROM b{k}, range({points}) r(i)), n{k} AS (SELECT i, any_value(lo) AS lo, any_value(hi) AS hi, t, {loss} AS nll FROM g{k}, z GROUP BY i, t)"
        out += f", m{k} AS (SELECT * FROM n{k} ORDER BY nll, i LIMIT 1), b{k + 1} AS (SELECT lo + (hi - lo) * greatest(i - 1, 0) / {last}e0 AS lo, lo + (hi - lo) * least(i + 1, {last}) / {last}e0 AS hi FROM m{k})"
    return out + f" SELECT round(t, 9) AS temperature, round(nll, 9) AS nll FROM m{rounds - 1}"


@query("C28_temperature_fit", _narrowed(4), "claims")
def c28(spark, sf):
    rows = claims(spark, sf).select((4 * (F.col("score") - 0.5)).alias("z"), F.when(F.col("label") == 1, 0).otherwise(1).alias("y"))
    return X.fit_temperature(stored(rows), "z", "y").select(F.round("temperature", 9).alias("temperature"), F.round("nll", 9).alias("nll"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("label") % 2).alias("label"), uniform(23, F.col("vec_id").cast("string")).alias("score"))


@query("C11_adaptive_triage")
def c11(spark, sf):
    rows = _vectors(spark, sf)
    return X.adaptive_triage(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), 0.1).select("id", "p", "accepted", "weighted")


@query("C12_density_ratio")
def c12(spark, sf):
    rows = _vectors(spark, sf)
    return X.density_ratio(rows.where("id % 2 = 0"), rows.where("id % 2 = 1")).select("id", "is_test", "weight")


_CONDITIONS = {
    "base": "SELECT 'base' AS condition, pathology AS part, score AS s, label, is_cal FROM b",
    "no_retrieval": "SELECT 'no_retrieval', pathology, u, label, is_cal FROM b",
    "random_negatives": "SELECT 'random_negatives', pathology, CASE WHEN label = 1 THEN 0.9e0 * u ELSE score END, label, is_cal FROM b",
    "best_of_4": "SELECT 'best_of_4', pathology, score, label, is_cal FROM (SELECT * FROM b WHERE line <= 4 QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY score DESC, claim_id) = 1)",
    "best_of_8": "SELECT 'best_of_8', pathology, score, label, is_cal FROM (SELECT * FROM b WHERE line <= 8 QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY score DESC, claim_id) = 1)",
    "global_threshold": "SELECT 'global_threshold', 'all', score, label, is_cal FROM b",
}
_C19 = (
    ", b AS (SELECT * REPLACE (CASE WHEN label = 1 THEN 1 ELSE 0 END AS label), patient_id % 2 = 0 AS is_cal FROM claims), v AS (" + " UNION ALL ".join(_CONDITIONS.values()) + ")"
    ", u2 AS (SELECT condition, part, s, 1 AS w, label FROM v WHERE is_cal AND label = 1 UNION ALL SELECT condition, part, s, 0, label FROM v WHERE NOT is_cal)"
    ", pv AS (SELECT *, (sum(w) OVER (PARTITION BY condition, part ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1) / (sum(w) OVER (PARTITION BY condition, part) + 1) AS p FROM u2)"
    ", r AS (SELECT *, count(*) OVER (PARTITION BY condition, part ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, count(*) OVER (PARTITION BY condition, part) AS m FROM pv WHERE w = 0)"
    ", k AS (SELECT *, coalesce(p <= max(p) FILTER (p <= cum / m * 0.2e0) OVER (PARTITION BY condition, part), false) AS ok FROM r)"
    ", g AS (SELECT condition, count(*) AS n, count(*) FILTER (ok) AS n_green, CASE WHEN count(*) FILTER (ok) > 0 THEN count(*) FILTER (ok AND label = 1) / count(*) FILTER (ok) ELSE 0e0 END AS fdr, count(*) FILTER (ok) / count(*) AS green_share FROM k GROUP BY 1)"
    " SELECT *, round(fdr - max(fdr) FILTER (condition = 'base') OVER (), 9) AS delta_fdr, round(green_share - max(green_share) FILTER (condition = 'base') OVER (), 9) AS delta_green_share FROM g"
)


@query("C19_ablations", _C19, "claims")
def c19(spark, sf):
    rows = claims(spark, sf).withColumn("label", F.when(F.col("label") == 1, 1).otherwise(0)).withColumn("score_no_retrieval", F.col("u")).withColumn("score_random_negatives", F.expr("CASE WHEN label = 1 THEN 0.9e0 * u ELSE score END"))
    out = run_ablations(rows, list(ABLATIONS), F.col("patient_id") % 2 == 0, 0.2)
    return out.withColumn("delta_fdr", F.round("delta_fdr", 9)).withColumn("delta_green_share", F.round("delta_green_share", 9))


_C29 = f", k AS (SELECT report_id, text FROM reports WHERE length(text) > 20 ORDER BY {uniform_sql(29, 'report_id::VARCHAR')}, report_id LIMIT 500), e AS (SELECT report_id, text, unnest({SENTENCES}) AS claim, generate_subscripts({SENTENCES}, 1) AS pos FROM k) SELECT report_id, any_value(text) AS text, list(claim || ' | ' || {count_sql('lower(claim)')} ORDER BY pos) AS claims FROM e GROUP BY 1"


@query("C29_decomposer_pairs", _C29, "reports")
def c29(spark, sf):
    parts = F.transform(T.sentences(F.col("text")), lambda s: F.struct(s.alias("claim"), T.category_by_count(s).alias("category")))
    return X.pair_set(reports(spark, sf), parts, 500, 29).withColumn("claims", F.transform("claims", lambda x: F.concat(x["claim"], F.lit(" | "), x["category"])))


@query("S10_label_sentinels", "SELECT doc_id, coalesce(quality, -2) AS quality, coalesce(toxic, -2) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def s10(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-2)).alias("quality"), F.coalesce("toxic", F.lit(-2)).alias("toxic"))


_T08 = ", e AS (SELECT report_id, claim_id, claim, finding, score, row_number() OVER (PARTITION BY report_id ORDER BY claim_id) AS pos FROM claims), b AS (SELECT *, CASE WHEN score < 0.5e0 AND lag(score) OVER (PARTITION BY report_id ORDER BY pos) < 0.5e0 THEN 0 ELSE 1 END AS cut FROM e), i AS (SELECT *, sum(cut) OVER (PARTITION BY report_id ORDER BY pos) AS island FROM b) SELECT report_id, island::BIGINT AS island, string_agg(claim, ' ' ORDER BY pos) AS claim, coalesce(min_by(finding, pos) FILTER (finding <> 'rib fracture'), 'rib fracture') AS category, max(score) AS confidence FROM i GROUP BY 1, 2"


@query("T08_merged_low_confidence", _T08, "claims")
def t08(spark, sf):
    rows = claims(spark, sf).select("report_id", F.col("claim_id").alias("pos"), F.col("claim"), F.col("finding").alias("category"), F.col("score").alias("confidence"))
    return S.merge_low_confidence(rows, 0.5, "rib fracture")


_BREAKS = "|".join(re.escape(e) for e in V.SCOPE_ENDS)


def _last_hit(w: str) -> str:
    return f"CASE WHEN contains(t, {q(w)}) THEN length(t) - length(string_split(t, {q(w)})[-1]) - {len(w) - 1} END"


_VECTORS = (
    ", vt AS (SELECT claim_id, 'c' AS side, lower(claim) AS t FROM claims UNION ALL SELECT claim_id, 'g', lower(evidence_text) FROM claims)"
    ", hx AS (SELECT claim_id, side, t, unnest([" + ", ".join(f"{{'f': {q(c)}, 'i': {i}, 'hit': list_max([{', '.join(map(_last_hit, ws))}])}}" for i, (c, ws) in enumerate(V.MENTIONED.items())) + "]) AS x FROM vt)"
    f", sc AS (SELECT claim_id, side, t, x.f AS f, x.i AS i, x.hit AS hit, regexp_replace(substr(t, greatest(x.hit - 60, 1), x.hit - greatest(x.hit - 60, 1)), {q('(?s)^.*(?:' + _BREAKS + ')')}, '') AS s FROM hx)"
    f", cd AS (SELECT claim_id, side, t, f, i, CASE WHEN hit IS NULL THEN 0 WHEN {any_sql('s', V.ABSENT_CUES)} THEN 2 WHEN {any_sql('s', V.HEDGE_CUES)} THEN 3 ELSE 1 END AS code FROM sc)"
)
_PIVOT = ", ".join(f"max(code) FILTER (f = {q(c)}) AS \"{c}\"" for c in V.MENTIONED)


@query("T14_label_vectors", _VECTORS + f" SELECT claim_id, {_PIVOT}, CASE WHEN count(*) FILTER (code = 1) = 0 AND {any_sql('any_value(t)', V.NORMAL_PHRASES)} THEN 1 ELSE 0 END AS \"{V.NO_FINDING}\" FROM cd WHERE side = 'c' GROUP BY 1", "claims")
def t14(spark, sf):
    v = S.label_vector(F.col("claim"))
    return claims(spark, sf).select("claim_id", *(v[c].alias(c) for c in v))


_T15 = _VECTORS + (
    ", fi AS (SELECT c.claim_id, arg_min(c.code, c.i) FILTER (c.code > 0) AS c, arg_min(g.code, c.i) FILTER (c.code > 0) AS g FROM cd c JOIN cd g ON c.claim_id = g.claim_id AND c.i = g.i WHERE c.side = 'c' AND g.side = 'g' GROUP BY 1)"
    " SELECT claim_id, CASE WHEN c = 3 OR g = 3 THEN 'UNCERTAIN' WHEN c = g AND c IN (1, 2) THEN 'SUPPORTED' WHEN (c = 1 AND g = 2) OR (c = 2 AND g = 1) THEN 'CONTRADICTED' WHEN c = 1 AND g = 0 THEN 'NOVEL_HALLUCINATED' WHEN c = 2 AND g = 0 THEN 'SUPPORTED' ELSE 'UNCERTAIN' END AS label, CASE WHEN c = 3 OR g = 3 THEN 'medium' WHEN c IN (1, 2) AND g IN (1, 2) THEN 'high' ELSE 'low' END AS confidence FROM fi"
)


@query("T15_label_difference", _T15, "claims")
def t15(spark, sf):
    d = S.label_difference(S.label_vector(F.col("claim")), S.label_vector(F.col("evidence_text")))
    return claims(spark, sf).select("claim_id", d.alias("d")).select("claim_id", "d.label", "d.confidence")


@query("T16_batch_grader", _T15, "claims")
def t16(spark, sf):
    return S.grade_by_vectors(claims(spark, sf).select("claim_id", "claim", F.col("evidence_text").alias("report")))


def _attribution(spark, sf):
    """Tokens of claims with their places and seeded scores."""
    place = F.aggregate(F.split("claim", " "), F.array().cast("array<struct<token:string,start:int,end:int>>"), lambda a, w: F.concat(a, F.array(F.struct(w.alias("token"), F.coalesce(F.get(a, F.size(a) - 1)["end"] + 1, F.lit(0)).alias("start"), (F.coalesce(F.get(a, F.size(a) - 1)["end"] + 1, F.lit(0)) + F.length(w)).alias("end")))))
    scored = F.transform(place, lambda x, i: F.struct(x["token"].alias("token"), x["start"].alias("start"), x["end"].alias("end"), uniform(27, F.col("claim_id"), i.cast("string")).alias("score"), i.alias("i")))
    return claims(spark, sf).select("claim_id", "claim", scored.alias("tokens"))


_SPANS = (
    ", w AS (SELECT claim_id, claim, unnest(string_split(claim, ' ')) AS token, generate_subscripts(string_split(claim, ' '), 1) - 1 AS i FROM claims), "
    f"placed AS (SELECT *, coalesce(sum(length(token) + 1) OVER (PARTITION BY claim_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, {uniform_sql(27, 'claim_id', 'i::VARCHAR')} AS score FROM w), "
    "tp AS (SELECT claim_id, claim, s AS start, s + length(token) AS \"end\", score FROM placed WHERE trim(token) <> '' AND NOT regexp_matches(token, '^(\\[.*\\]|<.*>)$') QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, i) <= 5)"
)
_MERGED = (
    _SPANS + ", g AS (SELECT *, CASE WHEN start - lag(\"end\") OVER v = 0 OR (start - lag(\"end\") OVER v = 1 AND regexp_matches(claim[start], '\\s')) THEN 0 ELSE 1 END AS cut FROM tp WINDOW v AS (PARTITION BY claim_id ORDER BY start)), "
    "h AS (SELECT *, sum(cut) OVER (PARTITION BY claim_id ORDER BY start) AS island FROM g) SELECT claim_id, min(start) AS start, max(\"end\") AS \"end\", round(sum(score), 9) AS score, substr(any_value(claim), min(start) + 1, max(\"end\") - min(start)) AS text FROM h GROUP BY claim_id, island"
)


@query("T29_top_spans", _SPANS + " SELECT claim_id, start, \"end\", score FROM tp", "claims")
def t29(spark, sf):
    return S.top_spans(_attribution(spark, sf), 5)


@query("T30_merged_spans", _MERGED, "claims")
def t30(spark, sf):
    return S.top_merged_spans(_attribution(spark, sf), 5).withColumn("score", F.round("score", 9))


@query("T31_sides", "SELECT claim_id, list_transform(range(len(w)), lambda i: CASE WHEN i < 3 THEN 'claim' ELSE 'evidence' END) AS sides FROM (SELECT claim_id, string_split(claim, ' ') AS w FROM claims)", "claims")
def t31(spark, sf):
    return claims(spark, sf).select("claim_id", S.sides(F.split("claim", " "), 3).alias("sides"))


_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(V.CONTENT_STOP_WORDS)) + "]"
_CONTENT = "list_filter(list_distinct(string_split_regex(lower({x}), '[^a-z0-9]+')), lambda w: length(w) > 2 AND NOT list_contains(" + _STOP + ", w))"
_T34 = (
    f", b AS (SELECT claim_id, {_CONTENT.format(x='claim')} AS c, {_CONTENT.format(x='evidence_text')} AS e FROM claims), v AS (SELECT *, unnest(range(1, 6)) AS v FROM b), "
    f"k AS (SELECT *, list_filter(c, lambda w: {uniform_sql(53, 'claim_id', 'v::VARCHAR', 'w')} >= 0.3e0) AS kept FROM v), "
    "o AS (SELECT claim_id, CASE WHEN len(c) > 0 THEN len(list_intersect(c, e)) / len(c) ELSE 0 END AS o, CASE WHEN len(kept) > 0 THEN len(list_intersect(kept, e)) / len(kept) ELSE 0 END AS s FROM k), "
    "a AS (SELECT claim_id, any_value(o) AS overlap, round(var_pop(s), 9) AS variance FROM o GROUP BY 1) SELECT *, (overlap < (SELECT quantile_cont(overlap, 0.5) FROM a))::INT AS predicted FROM a"
)


@query("T34_self_consistency", _T34, "claims")
def t34(spark, sf):
    return S.self_consistency(claims(spark, sf).select("claim_id", "claim", F.col("evidence_text").alias("evidence")), 5, 53).withColumn("variance", F.round("variance", 9))


def _region_sql(side: int = 8) -> str:
    parts = []
    for i, (n, box) in enumerate(V.REGIONS.items()):
        x1, y1, x2, y2 = (max(0, min(side, round(v * side / 27))) for v in box)
        cells = [y * side + x + 1 for y in range(y1, max(y2, y1 + 1)) for x in range(x1, max(x2, x1 + 1))]
        parts.append(f"{{'n': {q(n)}, 'i': {i}, 'm': (" + " + ".join(f"abs(e[{c}])::DOUBLE" for c in cells) + f") / {len(cells)}}}")
    return "[" + ", ".join(parts) + "]"


_T37 = (
    f", rg AS (SELECT vec_id AS id, unnest({_region_sql()}) AS x FROM (SELECT vec_id, embedding AS e FROM embeddings)), bs AS (SELECT id, x.n AS n, x.m AS m, row_number() OVER (PARTITION BY id ORDER BY x.m DESC, x.i) AS k FROM rg WHERE x.m >= 0.1e0)"
    f", ds AS (SELECT id, string_agg(CASE WHEN m >= {V.INTENSITIES['strong']}e0 THEN 'strong' WHEN m >= {V.INTENSITIES['moderate']}e0 THEN 'moderate' ELSE 'weak' END || ' attention on ' || n, ', ' ORDER BY k) AS d FROM bs WHERE k <= 3 GROUP BY 1) SELECT vec_id AS id, coalesce(d, '') AS description FROM embeddings LEFT JOIN ds ON id = vec_id"
)


@query("T37_heatmap_regions", _T37)
def t37(spark, sf):
    grid = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, 8), lambda x: F.abs(x).cast("double"))).alias("heat"))
    return grid.select("id", S.heat_description(F.col("heat"), 0.1, 3).alias("description"))


def _maps(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, 8), lambda x: F.abs(x).cast("double"))).alias("heat"), F.struct(F.lit(1).alias("x_min"), F.lit(1).alias("y_min"), F.lit(5).alias("x_max"), F.lit(6).alias("y_max")).alias("box"))


_CELLS = ", c AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings), m AS (SELECT vec_id, abs(v)::DOUBLE AS v, abs(v) >= 0.1e0 AS hot, k // 8 >= 1 AND k // 8 < 6 AND k % 8 >= 1 AND k % 8 < 5 AS box, k FROM c WHERE k < 64), p AS (SELECT vec_id, CASE WHEN count(*) FILTER (hot OR box) = 0 THEN 1.0 ELSE count(*) FILTER (hot AND box) / count(*) FILTER (hot OR box) END AS iou, arg_max(box, {'v': v, 'k': -k}) AS hit FROM m GROUP BY 1) SELECT round(avg(iou), 9) AS mean_iou, avg(hit::INT) AS hit_rate, count(*) AS n FROM p"


@query("A33_grounding", _CELLS)
def a33(spark, sf):
    rows = _maps(spark, sf).select(S.overlap(F.col("heat"), F.col("box"), 0.1).alias("iou"), S.peak_inside(F.col("heat"), F.col("box")).alias("hit"))
    return rows.agg(F.round(F.avg("iou"), 9).alias("mean_iou"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.count("*").alias("n"))
