"""Perturbations: H01 to H18, C25, C26."""

from pyspark.sql import functions as F

from .. import vocabulary as V
from ..fixtures import claims, reports, uniform_sql
from ..functions import perturb as H
from .registry import query
from .texts import _LOW, any_sql, any_word_sql, q, word_sql


def _sub(w, to, x="claim"):
    import re

    return rf"regexp_replace({x}, '(?is)^(.*?)\b{re.escape(w).replace(chr(92) + ' ', ' ')}\b', '\1{to}')"


def _swap(swaps):
    return "CASE " + " ".join(f"WHEN {word_sql(_LOW, a)} THEN {_sub(a, b)}" for a, b in swaps.items()) + " END"


def _one(kind, f):
    def run(spark, sf):
        return claims(spark, sf).select("claim_id", F.explode(F.array(H.let(F.col("claim"), f))).alias("claim")).where("claim is not null")

    return run


_MAY = f"(CASE WHEN {any_sql(_LOW, V.SIDED)} THEN true WHEN {any_sql(_LOW, V.NOT_SIDED)} THEN false ELSE {any_sql(_LOW, V.SIDE_WORDS)} END)"
_FIRST = {"H01_laterality_swap": (H.laterality_swap, f"CASE WHEN {_MAY} THEN {_swap(V.LATERALITY_SWAP)} END"), "H04_region_swap": (H.region_swap, _swap(V.REGION_SWAP)), "H05_severity_swap": (H.severity_swap, _swap(V.SEVERITY_SWAP)), "H06_temporal_swap": (H.temporal_error, _swap(V.TEMPORAL_SWAP))}
_CONF = "CASE " + " ".join(f"WHEN contains({_LOW}, {q(a)}) THEN {q(b)} WHEN contains({_LOW}, {q(b)}) THEN {q(a)}" for a, b in V.CONFUSABLE) + " END"
_PART = "CASE " + " ".join(rf"WHEN {word_sql(_LOW, w)} THEN regexp_replace(claim, '(?is)^(.*?)\b{w}\b', '\1' || partner)" for w in V.SUBSTITUTED) + " END"
_FIRST["H02_finding_substitution"] = (H.finding_substitution, f"coalesce(CASE WHEN partner IS NOT NULL THEN {_PART} END, {_swap(V.SUBSTITUTE_FALLBACK)})")
_COP = "CASE " + " ".join(rf"WHEN {word_sql(_LOW, c)} THEN regexp_replace(claim, '(?is)^(.*?\b{c}\b)', '\1 no')" for c in ("is", "are", "was", "were")) + " ELSE 'No ' || lower(claim[1]) || substr(claim, 2) END"
_FIRST["H03_negation"] = (H.negation, rf"CASE WHEN {word_sql(_LOW, 'no')} THEN trim(regexp_replace(claim, '(?is)^(.*?)\bno\s+', '\1')) WHEN {word_sql(_LOW, 'without')} THEN {_sub('without', 'with')} WHEN {word_sql(_LOW, 'absent')} THEN {_sub('absent', 'present')} WHEN {word_sql(_LOW, 'present')} THEN {_sub('present', 'absent')} ELSE {_COP} END")
_FIRST["H07_device_error"] = (H.device_line_error, f"CASE WHEN {any_word_sql(_LOW, V.DEVICE_WORDS)} THEN coalesce({_swap(V.DEVICE_POSITIONS)}, regexp_replace(claim, '[.]+$', '') || {q(V.DEVICE_FALLBACK)}) END")
for _name, (_f, _body) in _FIRST.items():
    query(_name, f"SELECT claim_id, n AS claim FROM (SELECT claim_id, {_body} AS n FROM (SELECT *, {_CONF} AS partner FROM claims)) WHERE n IS NOT NULL", "claims")(_one(_name, _f))


def _pick(options, u):
    return f"[{', '.join(map(q, options))}][least(floor({u} * {len(options)}), {len(options) - 1})::INT + 1]"


def _u(kind):
    return uniform_sql(31, q(kind), "claim_id")


def _append(phrase):
    return f"CASE WHEN regexp_replace(rtrim(claim), '[.]+$', '') <> '' THEN regexp_replace(rtrim(claim), '[.]+$', '') || ', ' || {phrase} || '.' END"


_M, _P, _T = (f"regexp_matches(claim, {q('(?i)' + p)})" for p in (V.HAS_MEASUREMENT, V.HAS_PRIOR, V.HAS_TEMPORAL))
_NOUN = "CASE " + " ".join(rf"WHEN {word_sql(_LOW, n)} THEN regexp_replace(claim, '(?is)^(.*?)\b{n}\b', '\1' || {_pick(V.MEASUREMENTS, _u('fabricate_measurement'))} || ' {n}')" for n in H._NOUNS) + " END"
_DRAWN = {
    "H08_omission": ("omission_as_support", _pick(V.FABRICATED, _u("omission_as_support"))),
    "H09_fabricated_measurement": ("fabricate_measurement", f"CASE WHEN NOT {_M} THEN {_NOUN} END"),
    "H10_fabricated_prior": ("fabricate_prior", f"CASE WHEN NOT {_P} THEN {_append(_pick(V.PRIOR_PHRASES, _u('fabricate_prior')))} END"),
    "H11_fabricated_time": ("fabricate_temporal", f"CASE WHEN NOT {_T} AND NOT {_P} THEN {_append(_pick(V.TEMPORAL_PHRASES, _u('fabricate_temporal')))} END"),
}


def _drawn(kind):
    return lambda spark, sf: H.perturb(claims(spark, sf), (kind,), 31).select("claim_id", "claim")


for _name, (_kind, _body) in _DRAWN.items():
    query(_name, f"SELECT claim_id, n AS claim FROM (SELECT claim_id, claim, {_body} AS n FROM claims) WHERE n IS NOT NULL AND lower(n) <> lower(claim)", "claims")(_drawn(_kind))


@query("H12_compound")
def h12(spark, sf):
    return H.compound(claims(spark, sf), 2, 33)


@query("H13_hard_negatives")
def h13(spark, sf):
    return H.hard_negatives(claims(spark, sf).where("label = 0"), H.TYPES, 3, 35)


@query("H14_all_types")
def h14(spark, sf):
    return H.hard_negatives(claims(spark, sf).where("label = 0"), H.TYPES, len(H.TYPES), 36).groupBy("kind").agg(F.count("*").alias("n"))


_RULES = [V.LATERALITY_SWAP, V.SEVERITY_SWAP, V.TEMPORAL_SWAP]


def _rewritten_sql(rules, seed):
    out = ", w0 AS (SELECT report_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM reports)"
    bare = "regexp_extract(w, '^([A-Za-z-]+)([.,;:]?)$', 1)"
    for r, swaps in enumerate(rules):
        new = f"CASE lower({bare}) " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in swaps.items()) + " END"
        coin = uniform_sql(seed, f"'{r}'", "report_id::VARCHAR", "i::VARCHAR")
        out += f", w{r + 1} AS (SELECT report_id, i, CASE WHEN {new} IS NOT NULL AND {coin} < 0.5e0 THEN {new} || substr(w, length({bare}) + 1, 100) ELSE w END AS w FROM w{r})"
    return out + f" SELECT report_id, string_agg(w, ' ' ORDER BY i) AS new_text FROM w{len(rules)} GROUP BY 1"


@query("H15_rewritten_reports", _rewritten_sql(_RULES, 37), "reports")
def h15(spark, sf):
    return H.rewrite_report(reports(spark, sf), _RULES, 0.5, 37).select("report_id", "new_text")


@query("H16_dual_run")
def h16(spark, sf):
    return H.dual_run(reports(spark, sf), 37)


@query("H17_preference_pairs", ", r AS (SELECT claim_id, claim, CASE WHEN line % 2 = 0 THEN evidence_text END AS c, CASE line % 3 WHEN 0 THEN [claim, 'x ' || claim] WHEN 1 THEN [' '] END AS cs FROM claims), f AS (SELECT claim_id, claim AS chosen, unnest(list_concat([c], coalesce(cs, []))) AS rejected FROM r) SELECT * FROM f WHERE trim(coalesce(rejected, '')) <> '' AND trim(rejected) <> trim(chosen)", "claims")
def h17(spark, sf):
    rows = claims(spark, sf).select("claim_id", "claim", F.when(F.col("line") % 2 == 0, F.col("evidence_text")).alias("counterfactual"), F.when(F.col("line") % 3 == 0, F.array("claim", F.concat(F.lit("x "), "claim"))).when(F.col("line") % 3 == 1, F.array(F.lit(" "))).alias("counterfactuals"))
    return H.preference_pairs(rows)


_ABSENT = "list_filter([" + ", ".join(q(x) for x in V.SIDED) + "], lambda f: NOT contains(lower(claim), f))"
_SIDE_OF = f"CASE WHEN {uniform_sql(40, 'claim_id')} < 0.5e0 THEN 'left' ELSE 'right' END"
_H18 = f", x AS (SELECT *, {_ABSENT} AS free, {_SIDE_OF} AS side FROM claims), y AS (SELECT *, free[least(floor({uniform_sql(39, 'claim_id')} * len(free)), len(free) - 1)::INT + 1] AS f FROM x) SELECT claim_id, CASE WHEN {uniform_sql(41, 'claim_id')} < 0.5e0 THEN 'There is a ' || side || ' ' || f || '.' ELSE upper(side[1]) || side[2:] || '-sided ' || f || ' is present.' END AS claim, 2 AS label FROM y WHERE f IS NOT NULL"


@query("H18_insufficient_claims", _H18, "claims")
def h18(spark, sf):
    return H.insufficient_claims(claims(spark, sf), 39)


@query("C25_balanced_claims")
def c25(spark, sf):
    return H.balanced_claims(claims(spark, sf), 2000, 41)


@query("C26_verifier_training_set")
def c26(spark, sf):
    from ..operators.joins import pooled_evidence
    from ..functions.text import alnum_tokens

    base = claims(spark, sf).where("label = 0")
    pool = base.groupBy("evidence_text").agg(F.min("claim_id").alias("passage_id")).withColumnRenamed("evidence_text", "text")
    rows = base.select("claim_id", "claim", F.lit(0).alias("label")).unionByName(H.hard_negatives(base, H.SIMPLE, 1, 43).select("claim_id", "claim", "label")).unionByName(H.insufficient_claims(base, 45))
    return rows.join(pooled_evidence(base, pool, alnum_tokens, 47, None), "claim_id").select("claim_id", "claim", "label", F.array_join("evidence", " [SEP] ").alias("evidence"))
