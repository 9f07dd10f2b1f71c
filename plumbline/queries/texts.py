"""Text operators: S01, S03, S05, S09 to S11, T01 to T13, T15, T19 to T39, A26, A31."""

from pyspark.sql import functions as F

from .. import vocabulary as V
from ..fixtures import claims, reports, table, workbook
from ..functions import text as T
from .registry import query


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_sql(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def word_sql(x: str, w: str) -> str:
    import re

    return f"regexp_matches({x}, {q(chr(92) + 'b' + re.escape(w).replace(chr(92) + ' ', ' ') + chr(92) + 'b')})"


def first_sql(x: str, words: dict, default: str, hit=any_sql) -> str:
    return "CASE " + " ".join(f"WHEN {hit(x, ws)} THEN {q(c)}" for c, ws in words.items()) + f" ELSE {default} END"


def any_word_sql(x: str, words) -> str:
    return "(" + " OR ".join(word_sql(x, w) for w in words) + ")"


_SECTIONS = r", s AS (SELECT report_id, trim(text, ' ') AS t, trim(regexp_extract(trim(text, ' '), '(?is)FINDINGS[:\s]*\n?(.*?)(IMPRESSION|$)', 1), ' ') AS f, trim(regexp_extract(trim(text, ' '), '(?is)IMPRESSION[:\s]*\n?(.*?)$', 1), ' ') AS i FROM reports), p AS (SELECT report_id, CASE WHEN f = '' AND i = '' THEN t ELSE f END AS findings, CASE WHEN f = '' AND i = '' THEN t ELSE i END AS impression FROM s)"


@query("T01_sections", _SECTIONS + " SELECT report_id, trim(findings, ' ' || chr(10)) AS findings, impression FROM p", "reports")
def t01(spark, sf):
    s = T.sections(F.col("text"))
    return reports(spark, sf).select("report_id", F.trim(s["findings"], F.lit(" \n")).alias("findings"), s["impression"].alias("impression"))


@query("T02_combined_sections", _SECTIONS + " SELECT report_id, concat_ws(' ', CASE WHEN trim(findings) <> '' THEN 'FINDINGS: ' || trim(findings, ' ' || chr(10)) END, CASE WHEN trim(impression) <> '' THEN 'IMPRESSION: ' || trim(impression) END) AS upper_text, concat_ws(chr(10), CASE WHEN trim(findings) <> '' THEN 'Findings: ' || trim(findings, ' ' || chr(10)) END, CASE WHEN trim(impression) <> '' THEN 'Impression: ' || trim(impression) END) AS title_text FROM p", "reports")
def t02(spark, sf):
    rows = t01(spark, sf)
    f, i = F.col("findings"), F.col("impression")
    return rows.select("report_id", T.combined(f, i).alias("upper_text"), T.combined(f, i, ("Findings", "Impression"), "\n").alias("title_text"))


def _cut(x, extra=r"\n+|;\s*"):
    return rf"string_split_regex(regexp_replace({x}, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2) || '{'|' + extra if extra else ''}')"


_SENT = r"list_filter(list_transform(" + _cut(r"regexp_replace(trim(text), '\b(Dr|Mr|Mrs|Ms|vs|etc|e\.g|i\.e)\.', '\1' || chr(1), 'g')") + r", lambda s: trim(replace(s, chr(1), '.'))), lambda s: length(s) > 5)"


@query("T03_sentences", f"SELECT doc_id, {_SENT} AS sentences FROM documents")
def t03(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.sentences(F.col("text")).alias("sentences"))


@query("T04_passages", f", s AS (SELECT doc_id, source, {_SENT} AS a FROM documents WHERE length(text) >= 10), e AS (SELECT doc_id, source, unnest(a) AS text, generate_subscripts(a, 1) - 1 AS pos FROM s) SELECT source || '_s' || doc_id::VARCHAR || '_' || pos::VARCHAR AS passage_id, text FROM e WHERE length(text) >= 10")
def t04(spark, sf):
    rows = table(spark, sf, "documents").where(F.length("text") >= 10).select("doc_id", "source", F.posexplode(T.sentences(F.col("text"))).alias("pos", "text"))
    return rows.where(F.length("text") >= 10).select(F.concat("source", F.lit("_s"), F.col("doc_id").cast("string"), F.lit("_"), F.col("pos").cast("string")).alias("passage_id"), "text")


_CLAIMS_OF = ", c AS (SELECT report_id, text, CASE WHEN length(text) >= 10 THEN list_filter(list_transform(" + _cut("trim(text)", r"\n+") + ", lambda s: trim(s)), lambda s: length(s) >= 15 AND NOT starts_with(s, 'HISTORY')) ELSE [] END AS a FROM reports)"


@query("T05_claims", _CLAIMS_OF + " SELECT report_id, len(a) AS n, array_to_string(a, '|') AS claims FROM c", "reports")
def t05(spark, sf):
    c = T.claims_of(F.col("text"))
    return reports(spark, sf).select("report_id", F.size(c).cast("bigint").alias("n"), F.array_join(c, "|").alias("claims"))


@query("T06_collapsed_sentences", "SELECT doc_id, list_filter(list_transform(" + _cut(r"trim(regexp_replace(text, '\s+', ' ', 'g'))", "") + ", lambda s: trim(s)), lambda s: length(s) >= 10) AS sentences FROM documents")
def t06(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.collapsed_sentences(F.col("text"), 10).alias("sentences"))


_ANY_START = "CASE report_id % 4 WHEN 0 THEN replace(text, '. There', '. And there') WHEN 1 THEN replace(text, '. There', '. It is said that there') WHEN 2 THEN replace(text, 'There is no', 'Or no') ELSE text END"


def _varied(spark, sf):
    return reports(spark, sf).withColumn("text", F.expr(_ANY_START))


def _starts_sql(x, words):
    return "(" + " OR ".join(f"starts_with(lower({x}), {q(w)})" for w in words) + ")"


_T07 = (
    f", vr AS (SELECT report_id, {_ANY_START} AS text FROM reports), sp AS (SELECT report_id, list_filter(list_transform({_cut('trim(text)', '')}, lambda s: trim(s)), lambda s: length(s) > 10) AS a FROM vr)"
    ", se AS (SELECT report_id, unnest(a) AS s, generate_subscripts(a, 1) AS i FROM sp)"
    f", fl AS (SELECT *, i > 1 AND ({_starts_sql('s', V.CONTINUATIONS)} OR {_starts_sql('s', V.ANAPHORA)}) AS joins FROM se)"
    ", rn AS (SELECT *, sum((NOT joins)::INT) OVER (PARTITION BY report_id ORDER BY i) AS island FROM fl)"  # in a run of joining sentences every other one is merged
    ", mg AS (SELECT *, joins AND (row_number() OVER (PARTITION BY report_id, island ORDER BY i)) % 2 = 0 AS merged FROM rn)"
    ", nx AS (SELECT *, lead(s) OVER v AS n, coalesce(lead(merged) OVER v, false) AS takes FROM mg WINDOW v AS (PARTITION BY report_id ORDER BY i))"
    f", ot AS (SELECT report_id, i, CASE WHEN NOT takes THEN s WHEN {_starts_sql('n', V.CONTINUATIONS)} THEN regexp_replace(s, '\\.+$', '') || ', ' || lower(n[1]) || n[2:] ELSE regexp_replace(s, '\\.+$', '') || '; ' || n END AS s FROM nx WHERE NOT merged)"
    " SELECT r.report_id, coalesce(c, []) AS claims FROM reports r LEFT JOIN (SELECT report_id, list(s ORDER BY i)[1:20] AS c FROM ot GROUP BY 1) o ON r.report_id = o.report_id"
)


@query("T07_merged_sentences", _T07, "reports")
def t07(spark, sf):
    return _varied(spark, sf).select("report_id", T.merged_sentences(F.col("text")).alias("claims"))


_CHAIN = f", v AS (SELECT report_id, {_ANY_START} AS text FROM reports), e AS (SELECT report_id, unnest(a) AS s, generate_subscripts(a, 1) AS pos FROM (SELECT report_id, list_filter(list_transform(" + _cut("trim(text)", "") + r", lambda s: trim(s)), lambda s: length(s) > 10) AS a FROM v)), i AS (SELECT *, sum(CASE WHEN pos > 1 AND regexp_matches(lower(s), '^(or|and|nor) ') THEN 0 ELSE 1 END) OVER (PARTITION BY report_id ORDER BY pos) AS island, pos > 1 AND regexp_matches(lower(s), '^(or|and|nor) ') AS cont, row_number() OVER (PARTITION BY report_id ORDER BY pos DESC) AS back FROM e), j AS (SELECT *, lead(cont) OVER (PARTITION BY report_id ORDER BY pos) AS more FROM i), k AS (SELECT report_id, island, string_agg(CASE WHEN cont THEN ', ' || lower(s[1]) || substr(s, 2) ELSE s END, '' ORDER BY pos) AS c FROM (SELECT * REPLACE (CASE WHEN more THEN regexp_replace(s, '\.+$', '') ELSE s END AS s) FROM j) GROUP BY 1, 2) SELECT report_id, array_to_string(list(c ORDER BY island), '|') AS claims FROM k GROUP BY 1"


@query("T07b_chained_claims", _CHAIN, "reports")
def t07b(spark, sf):
    return _varied(spark, sf).select("report_id", F.array_join(T.chained_claims(F.col("text")), "|").alias("claims"))


def _hits(x, ws):
    return " + ".join(f"contains({x}, {q(w)})::INT" for w in ws)


def _count_sql(x):
    scores = ", ".join(f"{{'n': {_hits(x, ws)}, 'f': {-i}, 'c': {q(c)}}}" for i, (c, ws) in enumerate(V.COUNTED.items()))
    return f"(SELECT CASE WHEN m.n > 0 THEN m.c ELSE 'Rare/Other' END FROM (SELECT list_max([{scores}]) AS m))"


_LOW = "lower(claim)"


@query("T10a_category_by_count", f"SELECT claim_id, {_count_sql(_LOW)} AS category FROM claims", "claims")
def t10a(spark, sf):
    return claims(spark, sf).select("claim_id", T.category_by_count(F.col("claim")).alias("category"))


@query("T10b_category_first_substring", f"SELECT claim_id, {first_sql(_LOW, V.FIRST_HIT, q('Other'))} AS category FROM claims", "claims")
def t10b(spark, sf):
    return claims(spark, sf).select("claim_id", T.category_first(F.col("claim")).alias("category"))


@query("T10c_category_first_word", f"SELECT claim_id, {first_sql(_LOW, V.FIRST_HIT, q('Other'), any_word_sql)} AS category FROM claims", "claims")
def t10c(spark, sf):
    return claims(spark, sf).select("claim_id", T.category_first(F.col("claim"), whole=True).alias("category"))


@query("T10d_category_or_null", f"SELECT claim_id, {first_sql(_LOW, V.MENTIONED, 'NULL')} AS category FROM claims", "claims")
def t10d(spark, sf):
    return claims(spark, sf).select("claim_id", T.category_first(F.col("claim"), V.MENTIONED, None).alias("category"))


_ONT = "CASE " + " ".join(f"WHEN trim(lower(x)) IN ({', '.join(map(q, ws))}) THEN {q(c)}" for c, ws in V.ONTOLOGY.items()) + " ELSE " + first_sql("trim(lower(x))", V.ONTOLOGY, q(V.RARE)) + " END"


@query("T10e_ontology", f", n AS (SELECT DISTINCT finding AS x FROM claims UNION SELECT DISTINCT 'small ' || finding FROM claims UNION SELECT DISTINCT pathology FROM claims) SELECT x AS entity, {_ONT} AS category FROM n", "claims")
def t10e(spark, sf):
    rows = claims(spark, sf)
    names = rows.select("finding").union(rows.select(F.concat(F.lit("small "), "finding"))).union(rows.select("pathology")).distinct().toDF("entity")
    return names.select("entity", T.ontology(F.col("entity")).alias("category"))


_LEFT, _RIGHT = any_sql(_LOW, V.LEFT_WORDS), any_sql(_LOW, V.RIGHT_WORDS)
_SIDE = f"CASE WHEN {_LEFT} AND {_RIGHT} THEN 'bilateral' WHEN {_LEFT} THEN 'left' WHEN {_RIGHT} THEN 'right' END"
_SEV = first_sql(_LOW, V.SEVERITY_WORDS, "NULL")


@query("T11_laterality_severity", f"SELECT claim_id, {_SIDE} AS laterality, {_SEV} AS severity FROM claims", "claims")
def t11(spark, sf):
    return claims(spark, sf).select("claim_id", T.laterality(F.col("claim")).alias("laterality"), T.severity(F.col("claim")).alias("severity"))


def _mentioned_sql(x):
    found = f"list_filter([{', '.join(f'CASE WHEN {any_sql(x, ws)} THEN {q(c)} END' for c, ws in V.MENTIONED.items())}], lambda z: z IS NOT NULL)"
    return f"CASE WHEN len({found}) = 0 AND {any_sql(x, V.NORMAL_PHRASES)} THEN ['No Finding'] ELSE {found} END"


@query("T12_mentioned_findings", f"SELECT report_id, {_mentioned_sql('lower(text)')} AS findings FROM reports", "reports")
def t12(spark, sf):
    return reports(spark, sf).select("report_id", T.mentioned(F.col("text")).alias("findings"))


_FLAGS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(claim, {q('(?i)' + p)}) THEN {q(n)} END" for n, p in V.FLAGS.items()) + "], lambda z: z IS NOT NULL)"


@query("T13_structural_flags", f"SELECT claim_id, {_FLAGS} AS flags, len({_FLAGS}) > 0 AS has_any FROM claims", "claims")
def t13(spark, sf):
    f = T.flags(F.col("claim"))
    return claims(spark, sf).select("claim_id", f.alias("flags"), (F.size(f) > 0).alias("has_any"))


@query("A26_flag_counts", f", f AS (SELECT unnest({_FLAGS}) AS flag FROM claims) SELECT n.flag, count(f.flag) AS n FROM (SELECT unnest([{', '.join(map(q, V.FLAGS))}]) AS flag) n LEFT JOIN f USING (flag) GROUP BY 1", "claims")
def a26(spark, sf):
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, V.FLAGS))).alias("flag"))
    counted = claims(spark, sf).select(F.explode(T.flags(F.col("claim"))).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
    return F.broadcast(names).join(counted, "flag", "left").select("flag", F.coalesce("n", F.lit(0)).alias("n"))


@query("T19_tokenisers", r"SELECT claim_id, list_filter(string_split_regex(regexp_replace(trim(lower(claim)), '[^\w\s-]', ' ', 'g'), '\s+'), lambda w: length(w) > 1 AND w NOT IN (" + ", ".join(map(q, V.STOP_WORDS)) + r")) AS search, list_filter(string_split_regex(lower(claim), '[^a-z0-9]+'), lambda w: w <> '') AS alnum, regexp_extract_all(lower(claim), '\b([\w'']+)\b', 1) AS words FROM claims", "claims")
def t19(spark, sf):
    c = F.col("claim")
    return claims(spark, sf).select("claim_id", T.search_tokens(c).alias("search"), T.alnum_tokens(c).alias("alnum"), T.word_tokens(c).alias("words"))


_BROKEN = "CASE line % 5 WHEN 0 THEN '[ERROR: no answer]' WHEN 1 THEN '  ' WHEN 2 THEN '[Model unavailable]' ELSE claim END"


@query("T20_error_texts", f", t AS (SELECT claim_id, trim(lower({_BROKEN})) AS t FROM claims) SELECT claim_id, t = '' OR (starts_with(t, '[') AND ends_with(t, ']') AND (contains(t, 'error') OR contains(t, 'unavailable'))) AS is_error FROM t", "claims")
def t20(spark, sf):
    return claims(spark, sf).select("claim_id", T.is_error_text(F.expr(_BROKEN)).alias("is_error"))


_CONF = "CASE " + " ".join(f"WHEN contains({_LOW}, {q(a)}) THEN {q(b)} WHEN contains({_LOW}, {q(b)}) THEN {q(a)}" for a, b in V.CONFUSABLE) + " END"
_MAY = f"CASE WHEN {any_sql(_LOW, V.SIDED)} THEN true WHEN {any_sql(_LOW, V.NOT_SIDED)} THEN false ELSE {any_sql(_LOW, V.SIDE_WORDS)} END"
_NOISE = "1e0 - CASE c " + " ".join(f"WHEN {q(c)} THEN {n}e0" for c, n in V.LABEL_NOISE.items()) + " ELSE 0.15e0 END"


@query("T21_knowledge_lookups", f", t AS (SELECT *, {first_sql(_LOW, V.FIRST_HIT, q('Other'))} AS c FROM claims) SELECT claim_id, {_MAY} AS may_swap, {_CONF} AS confusable, {_NOISE} AS confidence FROM t", "claims")
def t21(spark, sf):
    c = F.col("claim")
    return claims(spark, sf).select("claim_id", T.may_swap_side(c).alias("may_swap"), T.confusable(c).alias("confusable"), T.label_confidence(T.category_first(c)).alias("confidence"))


@query("T22_swappable_fields", f"SELECT claim_id, {_SIDE} IS NOT NULL AS laterality, {_SEV} IS NOT NULL AS severity, {first_sql(_LOW, V.MENTIONED, 'NULL')} IS NOT NULL AS finding FROM claims", "claims")
def t22(spark, sf):
    c = F.col("claim")
    return claims(spark, sf).select("claim_id", T.laterality(c).isNotNull().alias("laterality"), T.severity(c).isNotNull().alias("severity"), T.category_first(c, V.MENTIONED, None).isNotNull().alias("finding"))


@query("T23_evidence_text", "SELECT report_id, array_to_string(list(evidence_text ORDER BY claim_id)[1:2], ' [SEP] ') AS evidence FROM claims GROUP BY 1", "claims")
def t23(spark, sf):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("claim_id", "evidence_text"))), lambda x: x["evidence_text"])
    return claims(spark, sf).groupBy("report_id").agg(ordered.alias("e")).select("report_id", T.evidence_text(F.col("e")).alias("evidence"))


@query("T24_coarse_labels", "SELECT claim_id, CASE WHEN grader_a_label = 'SUPPORTED' THEN 0 WHEN grader_a_label IS NOT NULL THEN 1 END AS coarse, CASE WHEN label = 1 THEN 1 ELSE 0 END AS contradicted FROM workbook", "workbook")
def t24(spark, sf):
    return workbook(spark, sf).select("claim_id", T.binary_label(F.col("grader_a_label")).alias("coarse"), F.when(F.col("label") == 1, 1).otherwise(0).alias("contradicted"))


_LETTER = "lower(trim(substr(user_label, 1, 1)))"


@query("T24_letter_codes", f"SELECT claim_id, CASE {_LETTER} WHEN 's' THEN 'SUPPORTED' WHEN 'c' THEN 'CONTRADICTED' WHEN 'p' THEN 'NOVEL_PLAUSIBLE' WHEN 'h' THEN 'NOVEL_HALLUCINATED' WHEN 'u' THEN 'UNCERTAIN' END AS label, CASE lower(substr(claim, 12, 1)) WHEN 'l' THEN 'low' WHEN 'h' THEN 'high' ELSE 'medium' END AS sureness FROM workbook", "workbook")
def t24_letters(spark, sf):
    rows = workbook(spark, sf)
    return rows.select("claim_id", T.label_of_letter(F.substring("user_label", 1, 1)).alias("label"), T.sureness_of_letter(F.substring("claim", 12, 1)).alias("sureness"))


@query("S09_chosen_sections", _SECTIONS + " SELECT report_id, trim(findings, ' ' || chr(10)) AS findings, impression, trim(concat_ws(' ', nullif(trim(findings, ' ' || chr(10)), ''), nullif(impression, '')), ' ' || chr(10)) AS both_sections, t AS whole FROM p JOIN s USING (report_id)", "reports")
def s09_sections(spark, sf):
    edge = F.lit(" \n")
    rows = reports(spark, sf).select("report_id", *(T.chosen_section(F.col("text"), w).alias(w) for w in ("findings", "impression", "both", "full")))
    # white space where sections meet differs between engines
    return rows.select("report_id", F.trim("findings", edge).alias("findings"), "impression", F.trim(F.regexp_replace("both", r"\n+ ", " "), edge).alias("both_sections"), F.col("full").alias("whole"))


@query("T25_valid_labels", "SELECT claim_id, user_label FROM workbook WHERE trim(user_label) IN ('SUPPORTED', 'CONTRADICTED', 'NOVEL_PLAUSIBLE', 'NOVEL_HALLUCINATED', 'UNCERTAIN')", "workbook")
def t25(spark, sf):
    from ..fixtures import GRADES

    return workbook(spark, sf).where(F.trim("user_label").isin(*GRADES)).select("claim_id", "user_label")


@query("T26_clean_tokens", "SELECT claim_id, list_filter(list_transform(string_split(claim, ' '), lambda t: trim(t)), lambda t: t <> '') AS raw, len(list_distinct(list_filter(list_transform(string_split(claim || ' ' || evidence_text, ' '), lambda t: trim(t)), lambda t: t <> ''))) AS n_distinct FROM claims", "claims")
def t26(spark, sf):
    words = F.split(F.concat_ws(" ", "claim", "evidence_text"), " ")
    return claims(spark, sf).select("claim_id", F.filter(F.transform(F.split("claim", " "), lambda s: F.trim(s)), lambda t: t != "").alias("raw"), F.size(T.clean_tokens(words)).cast("bigint").alias("n_distinct"))


@query("T27_missing_tokens", r"SELECT claim_id, list_filter(string_split(finding || ' left', ' '), lambda t: NOT regexp_matches(claim, '(?i)\b' || t || '\b')) AS missing FROM claims", "claims")
def t27(spark, sf):
    return claims(spark, sf).select("claim_id", T.missing_tokens(F.col("claim"), F.split(F.concat("finding", F.lit(" left")), " ")).alias("missing"))


@query("T28_edit_distance", "SELECT claim_id, levenshtein(claim, evidence_text)::INT AS distance FROM claims", "claims")
def t28(spark, sf):
    return claims(spark, sf).select("claim_id", T.edit_distance(F.col("claim"), F.col("evidence_text")).alias("distance"))


@query("T32_still_supported", "SELECT claim_id, n = b AND b >= 2 AS supported FROM (SELECT claim_id, " + " + ".join(word_sql(_LOW, w) + "::INT" for ws in [*V.FIRST_HIT.values(), ["left", "right", "bilateral"]] for w in ws) + " AS n, " + " + ".join(f"({word_sql(_LOW, w)} AND {word_sql('lower(evidence_text)', w)})::INT" for ws in [*V.FIRST_HIT.values(), ["left", "right", "bilateral"]] for w in ws) + " AS b FROM claims)", "claims")
def t32(spark, sf):
    return claims(spark, sf).select("claim_id", T.still_supported(F.col("claim"), F.col("evidence_text")).alias("supported"))


_STOPS = "[" + ", ".join(map(q, sorted(V.CONTENT_STOP_WORDS))) + "]"
_SIDES = "[" + ", ".join(map(q, V.SIDE_CONFLICT)) + "]"


def _pair_sql(pairs):
    return "(" + " OR ".join(f"(contains(lc, {q(a)}) AND contains(le, {q(b)})) OR (contains(lc, {q(b)}) AND contains(le, {q(a)}))" for a, b in pairs) + ")"


_T33 = (
    ", tk AS (SELECT claim_id, lower(claim) AS lc, lower(evidence_text) AS le, regexp_extract_all(lower(claim), '\\b([\\w'']+)\\b', 1) AS c, regexp_extract_all(lower(evidence_text), '\\b([\\w'']+)\\b', 1) AS e FROM claims)"
    f", ct AS (SELECT *, list_filter(list_distinct(c), lambda w: length(w) > 2 AND NOT list_contains({_STOPS}, w)) AS own FROM tk)"
    f", wn AS (SELECT *, list_transform(list_filter(range(len(e)), lambda i: list_contains(own, e[i + 1])), lambda i: array_to_string(e[greatest(i - 3, 1):greatest(i - 3, 1) + least(i, 4) + 4], ' ')) AS near FROM ct)"
    f", s AS (SELECT claim_id, (len(list_filter(near, lambda t: {any_sql('t', V.NEGATIONS)})) > 0)::INT + (len(list_intersect(c, {_SIDES})) > 0 AND len(list_intersect(e, {_SIDES})) > 0 AND len(list_intersect(list_intersect(c, {_SIDES}), e)) = 0)::INT + {_pair_sql(V.SEVERITY_CONFLICT)}::INT + {_pair_sql(V.TEMPORAL_CONFLICT)}::INT AS score FROM wn)"
    " SELECT claim_id, score, (score >= 1)::INT AS predicted, score / 4 AS confidence FROM s"
)


@query("T33_rule_based_score", _T33, "claims")
def t33(spark, sf):
    s = F.col("score")
    scored = claims(spark, sf).select("claim_id", T.contradiction_score(F.col("claim"), F.col("evidence_text")).alias("score"))
    return scored.select("claim_id", s, (s >= 1).cast("int").alias("predicted"), (s / 4).alias("confidence"))


@query("T35_threshold_label", "SELECT claim_id, CASE WHEN score >= 0.8e0 THEN 'green' WHEN score >= 0.4e0 THEN 'yellow' ELSE 'red' END AS label FROM claims", "claims")
def t35(spark, sf):
    from ..functions.provenance import label_from_score

    return claims(spark, sf).select("claim_id", label_from_score(F.col("score"), 0.8).alias("label"))


@query("T36_tempered_softmax", "SELECT claim_id, round(1 / (1 + exp((1 - 2 * score) / 1.5e0)), 9) AS p0 FROM claims", "claims")
def t36(spark, sf):
    return claims(spark, sf).select("claim_id", F.round(T.tempered(F.array(F.col("score"), 1 - F.col("score")), 1.5)[0], 9).alias("p0"))


@query("T38_patient_of_file", "SELECT claim_id, string_split(replace(image_file, '.png', ''), '_')[1] AS patient FROM workbook", "workbook")
def t38(spark, sf):
    return workbook(spark, sf).select("claim_id", T.patient_of_file(F.col("image_file")).alias("patient"))


@query("T39_without_prompt", "SELECT claim_id, CASE WHEN contains(claim, 'There is') THEN trim(substr(claim, strpos(claim, 'There is') + 8)) ELSE trim(claim) END AS text FROM claims", "claims")
def t39(spark, sf):
    return claims(spark, sf).select("claim_id", T.without_prompt(F.col("claim"), "There is").alias("text"))


@query("T09_sentence_decomposer", f", e AS (SELECT report_id, unnest({_SENT}) AS claim FROM reports) SELECT report_id, claim, {_count_sql(_LOW)} AS category, 0.6e0 AS confidence FROM e", "reports")
def t09(spark, sf):
    rows = reports(spark, sf).select("report_id", F.explode(T.sentences(F.col("text"))).alias("claim"))
    return rows.select("report_id", "claim", T.category_by_count(F.col("claim")).alias("category"), F.lit(0.6).alias("confidence"))


_RAW = "CASE line % 4 WHEN 0 THEN concat('x {\"label\": \"', 'contradicted', '\"} y') WHEN 1 THEN 'I say NOVEL_PLAUSIBLE' WHEN 2 THEN '{\"label\": \"maybe\"} but supported' ELSE 'nothing' END"


@query("T17_grader_json", "SELECT claim_id, CASE line % 4 WHEN 0 THEN 'CONTRADICTED' WHEN 1 THEN 'NOVEL_PLAUSIBLE' WHEN 2 THEN 'SUPPORTED' ELSE 'UNCERTAIN' END AS label FROM claims", "claims")
def t17(spark, sf):
    return claims(spark, sf).select("claim_id", T.grader_label(F.expr(_RAW)).alias("label"))


@query("T18_json_arrays", "SELECT claim_id, CASE line % 3 WHEN 2 THEN []::VARCHAR[] ELSE [claim, finding] END AS variants FROM claims", "claims")
def t18(spark, sf):
    body = F.to_json(F.array(F.col("claim"), F.lit(" "), F.col("finding")))
    raw = F.when(F.col("line") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("line") % 3 == 1, F.concat(F.lit("Here: "), body, F.lit(" done"))).otherwise("no list")
    return claims(spark, sf).select("claim_id", T.json_strings(raw).alias("variants"))


@query("A31_coverage", f", r AS (SELECT report_id, {_mentioned_sql('lower(text)')} AS found FROM reports), t AS (SELECT report_id, list_distinct(list(finding)) AS gold FROM (SELECT report_id, {first_sql('lower(finding)', V.MENTIONED, 'NULL')} AS finding FROM claims) WHERE finding IS NOT NULL GROUP BY 1) SELECT report_id, len(list_intersect(found, gold)) / len(gold) AS coverage FROM r JOIN t USING (report_id)", "reports")
def a31(spark, sf):
    gold = claims(spark, sf).select("report_id", T.category_first(F.col("finding"), V.MENTIONED, None).alias("f")).groupBy("report_id").agg(F.collect_set("f").alias("gold")).where(F.size("gold") > 0)
    rows = reports(spark, sf).select("report_id", T.mentioned(F.col("text")).alias("found")).join(gold, "report_id")
    return rows.select("report_id", (F.size(F.array_intersect("found", "gold")) / F.size("gold")).alias("coverage"))
