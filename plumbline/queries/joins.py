"""Joins and retrieval: J01 to J16, J18, J19, A28, U04."""

from pyspark.sql import functions as F

from ..fixtures import claims, passages, table, uniform_sql, workbook
from ..functions import text as T
from ..operators import joins as J
from ..operators import retrieval as R
from ..sources.tables import stored
from .registry import query

_SPLIT = "CASE source WHEN 'src0' THEN 'test' WHEN 'src1' THEN 'cal' ELSE 'train' END"


def _splits(spark, sf):
    return table(spark, sf, "documents").select("source", F.expr(_SPLIT).alias("split")).distinct()


@query("J01_split_members", f"SELECT doc_id FROM documents WHERE source IN (SELECT source FROM (SELECT DISTINCT source, {_SPLIT} AS split FROM documents) WHERE split = 'cal')")
def j01(spark, sf):
    return J.in_split(table(spark, sf, "documents"), _splits(spark, sf), "cal", "source").select("doc_id")


@query("J02_split_leaks", f", s AS (SELECT DISTINCT source, {_SPLIT} AS split FROM documents UNION SELECT DISTINCT source, 'test' FROM documents WHERE doc_id % 100 = 1) SELECT source, list_sort(list(DISTINCT split)) AS splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1")
def j02(spark, sf):
    extra = table(spark, sf, "documents").where("doc_id % 100 = 1").select("source", F.lit("test").alias("split")).distinct()
    return J.leaks(_splits(spark, sf).union(extra), "source")


_FILES = (
    ", f AS (SELECT DISTINCT CASE WHEN patient_id % 3 = 0 THEN 'x_' || image_file ELSE image_file END AS image_file FROM workbook), n AS (SELECT image_file, string_split(replace(image_file, '.png', ''), '_')[1] AS prefix FROM f)"
    ", r AS (SELECT DISTINCT CASE WHEN patient_id % 2 = 0 THEN 'p' || patient_id::VARCHAR ELSE 'study-p' || patient_id::VARCHAR || '-' || report_id::VARCHAR END AS report_id FROM claims)"
    ", w AS (SELECT prefix, coalesce(min(report_id) FILTER (report_id = prefix), min(report_id)) AS report_id FROM (SELECT DISTINCT prefix FROM n) JOIN r ON contains(report_id, prefix) GROUP BY 1)"
)


@query("J03_match_files", _FILES + " SELECT image_file, report_id FROM n LEFT JOIN w USING (prefix)", "workbook")
def j03(spark, sf):
    files = workbook(spark, sf).select(F.when(F.col("patient_id") % 3 == 0, F.concat(F.lit("x_"), "image_file")).otherwise(F.col("image_file")).alias("image_file")).distinct()
    patient = F.concat(F.lit("p"), F.col("patient_id").cast("string"))
    ids = F.when(F.col("patient_id") % 2 == 0, patient).otherwise(F.concat(F.lit("study-"), patient, F.lit("-"), F.col("report_id").cast("string")))
    return J.match_files(files, claims(spark, sf).select(ids.alias("report_id")))


@query("J05_unlabelled", "SELECT claim_id FROM claims WHERE claim_id NOT IN (SELECT claim_id FROM workbook)", "workbook")
def j05(spark, sf):
    return J.unlabelled(claims(spark, sf), workbook(spark, sf)).select("claim_id")


_ENT = ", o AS (SELECT report_id, claim_id, finding, CASE label WHEN 0 THEN 'OBS-DP' WHEN 1 THEN 'OBS-DA' ELSE 'OBS-U' END AS kind FROM claims), l AS (SELECT report_id, claim_id, line FROM claims WHERE line % 3 <> 0 UNION ALL SELECT report_id, claim_id, line + 100 FROM claims WHERE line % 3 = 1), n AS (SELECT report_id, claim_id, string_agg(CASE WHEN line > 100 THEN 'left base' ELSE 'lower lobe' END, ' and ' ORDER BY line) AS place FROM l GROUP BY 1, 2)"


@query("J06_entity_claims", _ENT + " SELECT claim_id, CASE kind WHEN 'OBS-DA' THEN 'No ' WHEN 'OBS-U' THEN 'Possible ' ELSE '' END || finding || coalesce(' in the ' || place, '') AS text FROM o LEFT JOIN n USING (report_id, claim_id)", "claims")
def j06(spark, sf):
    rows = claims(spark, sf)
    observations = rows.select("report_id", F.col("claim_id").alias("obs_id"), F.col("finding").alias("tokens"), F.when(F.col("label") == 0, "OBS-DP").when(F.col("label") == 1, "OBS-DA").otherwise("OBS-U").alias("kind"))
    at = rows.where("line % 3 <> 0").select("report_id", F.col("claim_id").alias("obs_id"), F.explode(F.when(F.col("line") % 3 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("anat_id"))
    names = rows.select("report_id").distinct().select("report_id", F.explode(F.array(F.struct(F.lit(1).alias("anat_id"), F.lit("lower lobe").alias("name")), F.struct(F.lit(2).alias("anat_id"), F.lit("left base").alias("name")))).alias("x")).select("report_id", "x.*")
    return J.entity_claims(observations, at, names).select(F.col("obs_id").alias("claim_id"), "text")


@query("J07_sibling_evidence", ", a AS (SELECT report_id, claim, min(claim_id) AS k FROM claims GROUP BY 1, 2), b AS (SELECT c.claim_id, a.claim AS s, row_number() OVER (PARTITION BY c.claim_id ORDER BY a.k) AS n FROM claims c JOIN a ON a.report_id = c.report_id AND a.claim <> c.claim) SELECT c.claim_id, coalesce(e, '') AS evidence FROM claims c LEFT JOIN (SELECT claim_id, string_agg(s, '|' ORDER BY n) AS e FROM b WHERE n <= 3 GROUP BY 1) USING (claim_id)", "claims")
def j07(spark, sf):
    return J.sibling_evidence(claims(spark, sf)).select("claim_id", F.array_join("evidence", "|").alias("evidence"))


_MIS = f", r AS (SELECT claim_id, patient_id, pathology, row_number() OVER (PARTITION BY pathology ORDER BY {uniform_sql(9, 'claim_id')}, claim_id) - 1 AS k FROM claims), z AS (SELECT pathology, count(*) AS n, row_number() OVER (ORDER BY pathology) - 1 AS i, count(*) OVER () AS m FROM r GROUP BY 1), sh AS (SELECT a.pathology AS f, b.pathology AS t, b.n FROM z a JOIN z b ON b.i = (a.i + 1) % a.m), q AS (SELECT r.claim_id, r.patient_id, t, step, (k + step) % n AS k FROM r JOIN sh ON r.pathology = f, (SELECT unnest([0, 1]) AS step)) SELECT q.claim_id, min_by(r.claim_id, step) AS other_id FROM q JOIN r ON r.pathology = q.t AND r.k = q.k AND r.patient_id <> q.patient_id GROUP BY 1"


@query("J08_mismatched_evidence", _MIS, "claims")
def j08(spark, sf):
    return J.mismatched_evidence(claims(spark, sf), "pathology", 9)


_RUN = "CASE WHEN {m} THEN '[ERROR]' ELSE claim END"
_J09 = f", a AS (SELECT image_file, max_by({_RUN.format(m='report_id % 7 = 0')}, claim_id) AS a FROM workbook GROUP BY 1), b AS (SELECT image_file, max_by({_RUN.format(m='report_id % 50 = 10')}, claim_id) AS b FROM workbook GROUP BY 1), p AS (SELECT claim_id, a, b FROM workbook JOIN a USING (image_file) JOIN b USING (image_file) WHERE a <> '[ERROR]' AND b <> '[ERROR]') SELECT claim_id, 'same_run' AS condition, a AS evidence FROM p UNION ALL SELECT claim_id, 'cross_run', b FROM p"


@query("J09_paired_runs", _J09, "workbook")
def j09(spark, sf):
    rows = workbook(spark, sf)
    run = lambda m: rows.select("image_file", F.expr(_RUN.format(m=m)).alias("report"), F.col("claim_id").alias("seq"))
    return J.pair_runs(rows.select("claim_id", "image_file"), run("report_id % 7 = 0"), run("report_id % 50 = 10"))


@query("J19_comparison", ", a AS (SELECT pathology, avg(score) AS v FROM claims WHERE line % 2 = 0 GROUP BY 1), b AS (SELECT pathology, avg(score) AS v FROM claims WHERE line % 2 = 1 AND pathology <> 'PROMO' GROUP BY 1) SELECT pathology, round(a.v, 9) AS first, round(b.v, 9) AS second, round(b.v - a.v, 9) AS delta FROM a FULL JOIN b USING (pathology)", "claims")
def j19(spark, sf):
    rows = claims(spark, sf)
    side = lambda c: rows.where(c).groupBy("pathology").agg(F.avg("score").alias("v"))
    out = J.compare(side("line % 2 = 0"), side("line % 2 = 1 and pathology <> 'PROMO'"), "pathology", "v")
    return out.select("pathology", *(F.round(c, 9).alias(c) for c in ("first", "second", "delta")))




def _tok(x):
    return f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"


_BM = f", d AS (SELECT passage_id, {_tok('text')} AS w FROM passages), st AS (SELECT count(*) AS n, avg(len(w)) AS adl FROM d), po AS (SELECT passage_id, term, dl, count(*) AS tf FROM (SELECT passage_id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY 1, 2, 3), qt AS (SELECT DISTINCT item_id AS query_id, unnest({_tok('text')}) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1), sc AS (SELECT query_id, passage_id, round(sum(ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / adl))), 6) AS score FROM qt JOIN po USING (term) JOIN df USING (term), st GROUP BY 1, 2), tk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM sc WHERE score > 0)"


def _queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _scored(spark, sf, k):
    return R.bm25_search(passages(spark, sf), _queries(spark, sf), T.alnum_tokens, k).withColumn("score", F.round("score", 6))


@query("J11_bm25_search", _BM + " SELECT query_id, passage_id, score, rank FROM tk WHERE rank <= 10", "passages")
def j11(spark, sf):
    return R.top_k(_scored(spark, sf, 10), 10).withColumn("rank", F.col("rank").cast("bigint"))


@query("J10_best_match", _BM + " SELECT b.item_id AS query_id, coalesce(max(score), 0) AS score FROM benchmark b LEFT JOIN sc ON query_id = item_id GROUP BY 1", "passages")
def j10(spark, sf):
    return R.best_match(passages(spark, sf), _queries(spark, sf), T.alnum_tokens).withColumn("score", F.round("score", 6))


@query("A28_similarity_distribution", _BM + ", m AS (SELECT query_id, max(score) AS s FROM sc GROUP BY 1), x AS (SELECT min(s) AS lo, max(s) AS hi, avg(s) AS mean, stddev_samp(s) AS std FROM m) SELECT least(floor((s - lo) / (hi - lo) * 20), 19)::BIGINT AS bin, count(*) AS n, round(any_value(mean), 6) AS mean, round(any_value(std), 6) AS std, any_value(hi) AS max FROM m, x GROUP BY 1", "passages")
def a28(spark, sf):
    out = R.distribution(j10(spark, sf))
    return out.withColumn("bin", F.col("bin").cast("bigint")).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


_DOT = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
_DENSE = f", e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), dn AS (SELECT a.id AS query_id, b.id AS passage_id, round({_DOT}, 9) AS score FROM e a, e b WHERE a.id % 10 = 0), dk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM dn)"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query("J12_dense_search", _DENSE + " SELECT query_id, passage_id, score, rank FROM dk WHERE rank <= 10")
def j12(spark, sf):
    rows = _vectors(spark, sf)
    return R.dense(rows, rows.where("id % 10 = 0"), 10).withColumn("rank", F.col("rank").cast("bigint"))


_NEAR = f", s AS (SELECT doc_id, doc_id % 5 = 0 AS t, list_distinct({_tok('text')}) AS w FROM documents) SELECT a.doc_id AS test_id, b.doc_id AS train_id, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS jaccard FROM s a JOIN s b ON a.t AND NOT b.t AND len(a.w) > 0 AND len(b.w) >= 0.8 * len(a.w) AND len(a.w) >= 0.8 * len(b.w) AND len(list_intersect(a.w, b.w)) >= 0.8 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))"


@query("J13_near_duplicates", _NEAR)
def j13(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.near_duplicates(docs.where("id % 5 = 0"), docs.where("id % 5 <> 0"), T.alnum_tokens)


_LEAKED = (
    _NEAR.replace(", s AS", ", s0 AS", 1).replace(" SELECT a.doc_id AS test_id", ", s AS (SELECT doc_id, t, list_sort(w) AS w FROM s0), pr AS (SELECT a.doc_id AS test_id, a.w AS aw, b.w AS bw", 1) + ")"
    " SELECT test_id, (SELECT min(doc_id) FROM s WHERE t AND w = aw) AS class_id, count(DISTINCT bw) AS n_sets, count(*) AS n_train, max(jaccard) AS jaccard, arg_min(train_id, {'j': -jaccard, 'i': train_id}) AS nearest FROM pr GROUP BY test_id, aw"
)


@query("J13_leaked_documents", _LEAKED)
def j13_leaked(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.leaked_documents(docs.where("id % 5 = 0"), docs.where("id % 5 <> 0"), T.alnum_tokens)


_HALF = "list_dot_product(a.v[:16], b.v[:16]) / (sqrt(list_dot_product(a.v[:16], a.v[:16])) * sqrt(list_dot_product(b.v[:16], b.v[:16])))"
_LISTS = _DENSE + f", l2 AS (SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM (SELECT a.id AS query_id, b.id AS passage_id, round({_HALF}, 9) AS score FROM e a, e b WHERE a.id % 10 = 0)), un AS (SELECT query_id, 1 AS list_no, rank, passage_id FROM dk WHERE rank <= 10 UNION ALL SELECT query_id, 2, rank, passage_id FROM l2 WHERE rank <= 10), fu AS (SELECT query_id, passage_id AS doc_id, round(sum(1e0 / (60 + rank)), 12) AS score, min({{'l': list_no, 'r': rank}}) AS first FROM un GROUP BY 1, 2), fr AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS rank FROM fu)"


def _lists(spark, sf):
    """Two rankings: by whole vectors, and by their first sixteen dimensions."""
    rows = _vectors(spark, sf)
    both = (rows, rows.withColumn("vector", F.slice("vector", 1, 16)))
    return R.union_of_lists(*(R.dense(v, v.where("id % 10 = 0"), 10) for v in both))


@query("J14_rank_fusion", _LISTS + " SELECT * FROM fr WHERE rank <= 10")
def j14(spark, sf):
    return R.fuse(_lists(spark, sf), 60, 10).withColumn("score", F.round("score", 12)).withColumn("rank", F.col("rank").cast("bigint"))


_RR = _BM + f", ca AS (SELECT tk.query_id, passage_id, rank, len(list_intersect(list_distinct({_tok('b.text')}), {_tok('p.text')})) / len(list_distinct({_tok('b.text')})) AS s FROM tk JOIN passages p USING (passage_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 20), rr AS (SELECT query_id, passage_id, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS rank FROM ca)"


def _candidates(spark, sf):
    found = stored(R.top_k(_scored(spark, sf, 20), 20).select("query_id", "passage_id", "rank"))  # few, so texts need not move to meet them
    texts = _queries(spark, sf).withColumnRenamed("text", "query_text")
    return found.join(passages(spark, sf).select("passage_id", "text"), "passage_id").join(texts, "query_id")


@query("J15_rerank", _RR + " SELECT * FROM rr WHERE rank <= 5", "passages")
def j15(spark, sf):
    out = R.rerank(_candidates(spark, sf), R.overlap_score(F.col("query_text"), F.col("text"), T.alnum_tokens), 5)
    return out.select("query_id", "passage_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("U04_pair_scorer", _RR + " SELECT * FROM rr WHERE rank <= 5", "passages")
def u04(spark, sf):
    """The rows of J15 with a model in Python workers as the scorer."""
    scorer = R.pair_scorer(R.load_word_overlap)
    out = R.rerank(_candidates(spark, sf), scorer(F.col("query_text"), F.col("text")), 5)
    return out.select("query_id", "passage_id", "score", F.col("rank").cast("bigint").alias("rank"))


_SLOT = "('0x' || substr(md5(w), 1, 8))::BIGINT % 64"
_J16 = _BM + (
    f", hp AS (SELECT passage_id, {_SLOT} AS s, count(*) AS n FROM (SELECT passage_id, unnest(w) AS w FROM d) GROUP BY 1, 2), hq AS (SELECT query_id, {_SLOT} AS s, count(*) AS n FROM (SELECT item_id AS query_id, unnest({_tok('text')}) AS w FROM benchmark) GROUP BY 1, 2)"
    ", lp AS (SELECT passage_id, sqrt(sum(n * n)) AS l FROM hp GROUP BY 1), lq AS (SELECT query_id, sqrt(sum(n * n)) AS l FROM hq GROUP BY 1)"
    ", vd AS (SELECT query_id, passage_id, round(sum(hp.n * hq.n) / (any_value(lp.l) * any_value(lq.l)), 9) AS score FROM hp JOIN hq USING (s) JOIN lp USING (passage_id) JOIN lq USING (query_id) GROUP BY 1, 2)"
    ", li AS (SELECT query_id, 1 AS list_no, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank, passage_id FROM vd QUALIFY rank <= 20 UNION ALL SELECT query_id, 2, rank, passage_id FROM tk WHERE rank <= 20)"
    ", fu AS (SELECT query_id, passage_id, round(sum(1e0 / (60 + rank)), 12) AS score, min({'l': list_no, 'r': rank}) AS first FROM li GROUP BY 1, 2)"
    ", fr AS (SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, passage_id) AS rank FROM fu QUALIFY rank <= 20)"
    f", ra AS (SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(list_distinct({_tok('b.text')}), {_tok('p.text')})) / len(list_distinct({_tok('b.text')})) DESC, rank) AS rank FROM fr JOIN passages p USING (passage_id) JOIN benchmark b ON b.item_id = query_id)"
    ", al AS (SELECT 'dense' AS method, query_id, passage_id, rank FROM li WHERE list_no = 1 UNION ALL SELECT 'sparse', query_id, passage_id, rank FROM li WHERE list_no = 2 UNION ALL SELECT 'rrf', query_id, passage_id, rank FROM fr UNION ALL SELECT 'rrf_rerank', query_id, passage_id, rank FROM ra)"
    " SELECT method, query_id, string_agg(p.text, ' [SEP] ' ORDER BY rank) AS evidence, any_value(b.text) AS oracle_evidence, 'retrieved_report_text' AS evidence_source_type, 'independent' AS evidence_trust_tier FROM al JOIN passages p USING (passage_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 2 GROUP BY 1, 2"
)


@query("J16_retrieved_evidence", _J16, "passages")
def j16(spark, sf):
    """Evidence by four methods from the same two rankings, which are made once; the texts' own evidence is kept beside it."""
    items, asked = passages(spark, sf).select("passage_id", "text"), _queries(spark, sf)
    vectors = lambda rows, key: rows.select(F.col(key).alias("id"), R.hashed_vector(T.alnum_tokens(F.col("text"))).alias("vector"))
    near = R.dense(vectors(items, "passage_id"), vectors(asked, "query_id"), 20)
    lists = stored(R.union_of_lists(near, R.top_k(_scored(spark, sf, 20), 20)))
    fused = R.fuse(lists, 60, 20)
    alone = lists.select(F.when(F.col("list_no") == 1, "dense").otherwise("sparse").alias("method"), "query_id", "doc_id", "rank")
    every = alone.unionByName(fused.select(F.lit("rrf").alias("method"), "query_id", "doc_id", "rank")).withColumnRenamed("doc_id", "passage_id")
    texts = every.join(items, "passage_id").join(asked.withColumnRenamed("text", "query_text"), "query_id")
    again = R.rerank(texts.where("method = 'rrf'"), R.overlap_score(F.col("query_text"), F.col("text"), T.alnum_tokens), 2)
    both = texts.unionByName(again.withColumn("method", F.lit("rrf_rerank")).select(texts.columns))
    found = R.as_evidence(both, 2, "method", "query_id").join(asked.withColumnRenamed("text", "oracle_evidence"), "query_id")
    return found.select("method", "query_id", "evidence", "oracle_evidence", "evidence_source_type", "evidence_trust_tier")


_ID = "claim_id"
_J18 = (
    f", pool AS (SELECT evidence_text AS text, min(claim_id) AS passage_id FROM claims GROUP BY 1), ch AS (SELECT *, row_number() OVER (ORDER BY u, passage_id) AS k FROM (SELECT *, {uniform_sql(21, 'passage_id')} AS u FROM pool ORDER BY u, passage_id LIMIT 100))"
    f", pw AS (SELECT DISTINCT k, unnest({_tok('text')}) AS w FROM ch), cw AS (SELECT DISTINCT claim_id, unnest({_tok('claim')}) AS w FROM claims), ht AS (SELECT claim_id, list_sort(list(DISTINCT k))[1:2] AS ks FROM cw JOIN pw USING (w) GROUP BY 1)"
    f", ak AS (SELECT claim_id, unnest(ks) AS k, generate_subscripts(ks, 1) AS pos FROM (SELECT claim_id, coalesce(ks, list_transform(list_sort(list_transform(range(1, m + 1), lambda k: {{u: {uniform_sql(22, _ID, 'k::VARCHAR')}, k: k}}))[1:2], lambda x: x.k)) AS ks FROM claims LEFT JOIN ht USING (claim_id), (SELECT count(*) AS m FROM ch)))"
    " SELECT claim_id, list(text ORDER BY pos) AS evidence FROM ak JOIN ch USING (k) GROUP BY 1"
)


@query("J18_pooled_evidence", _J18, "claims")
def j18(spark, sf):
    pool = claims(spark, sf).groupBy("evidence_text").agg(F.min("claim_id").alias("passage_id")).withColumnRenamed("evidence_text", "text")
    return J.pooled_evidence(claims(spark, sf), pool, T.alnum_tokens, 21)
