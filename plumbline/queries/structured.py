"""Perturbations of structured claims: H01 to H08 and H13."""

import re

from pyspark.sql import functions as F

from .. import vocabulary as V
from ..fixtures import claims, uniform_sql
from ..functions import structured as S
from .registry import query
from .texts import _LOW, _ONT, any_sql, q, word_sql

#: Fields of a structured claim from the claims view; both engines read these.
_FIELDS = {
    "category": "CASE WHEN contains(claim, 'chest tube') THEN 'Support Devices' WHEN line = 7 THEN 'No Finding' WHEN finding = 'pleural effusion' THEN 'Pleural Effusion' WHEN finding = 'cardiomegaly' THEN 'Cardiomegaly' WHEN finding = 'rib fracture' THEN 'Fracture' ELSE 'Consolidation' END",
    "negated": "contains(claim, ' is no ')",
    "laterality": "CASE WHEN line = 6 THEN 'bilateral' WHEN contains(claim, ' left ') THEN 'left' WHEN contains(claim, ' right ') THEN 'right' END",
    "severity": "CASE WHEN contains(claim, ' mild ') THEN 'mild' WHEN contains(claim, ' moderate ') THEN 'moderate' WHEN contains(claim, ' severe ') THEN 'severe' END",
    "anatomy": "CASE WHEN line = 5 THEN 'left pleural space' WHEN contains(claim, 'lower lobe') THEN 'lower lobe' WHEN contains(claim, 'upper lobe') THEN 'upper lobe' END",
}


def structured_claims(spark, sf):
    """claim_id, report_id, claim (struct): the claims view with fields and entities; some begin with one that is no observation."""
    rows = claims(spark, sf)
    entity = lambda tokens, seen: F.struct(tokens.alias("tokens"), F.lit(seen).alias("is_observation"))
    own = entity(F.col("finding"), True)
    entities = F.when(F.col("line") % 2 == 0, F.array(entity(F.lit("lobe"), False), own)).otherwise(F.array(own))
    f = {k: F.expr(e).alias(k) for k, e in _FIELDS.items()}
    return rows.select("claim_id", "report_id", F.struct(F.col("claim").alias("text"), f["category"], entities.alias("entities"), f["negated"], f["laterality"], f["severity"], f["anatomy"]).alias("claim"))


SEED = 51


def _u(what):
    return uniform_sql(SEED, q(what), "claim_id")


def _list(values):
    return f"[{', '.join(map(q, values))}]"


def _drawn(options, what):
    return f"({options})[least(floor({_u(what)} * len({options})), len({options}) - 1)::INT + 1]"


def _sub(old, new):
    return rf"regexp_replace(claim, '(?is)^(.*?)\b{re.escape(old).replace(chr(92) + ' ', ' ')}\b', '\1{new}')"


def _put(old, new, border=r"\b"):
    return rf"regexp_replace(claim, '(?is)^(.*?){border}' || regexp_escape({old}) || '{border}', '\1' || {new})"


def _by(column, lists):
    return f"CASE {column} " + " ".join(f"WHEN {q(k)} THEN {_list(v)}" for k, v in lists.items()) + " END"


def _first(words):
    return "CASE " + " ".join(f"WHEN {word_sql(_LOW, w.lower())} THEN {q(w)}" for w in words) + " END"


def _turned(pairs):
    return "CASE " + " ".join(f"WHEN {word_sql(_LOW, a.lower())} THEN {_sub(a, b)}" for a, b in pairs) + " END"


_ANATOMY = "lower(coalesce(anatomy, ''))"
_REGION = "CASE " + " ".join(f"WHEN {any_sql(_ANATOMY, ws)} THEN {q(r)}" for r, ws in V.REGION_WORDS.items()) + " " + " ".join(f"WHEN category = {q(c)} THEN {q(r)}" for c, r in V.REGION_OF_CATEGORY.items()) + " ELSE 'lung' END"
_CATALOGUE = f"[{', '.join(f'{{f: {q(f)}, r: {q(r)}}}' for f, r in S.CATALOGUE)}]"
_NAMES = "CASE WHEN line % 2 = 0 THEN ['lobe', finding] ELSE [finding] END"
_VIEW = (
    ", st AS (SELECT *, " + ", ".join(f"{e} AS {k}" for k, e in _FIELDS.items()) + f", {_NAMES} AS names FROM claims)"
    + f", said AS (SELECT report_id, list(DISTINCT f) AS findings FROM (SELECT report_id, claim, unnest({_list(sorted({f for f, _ in S.CATALOGUE}))}) AS f FROM claims) WHERE contains(lower(claim), f) GROUP BY 1)"
    + f", sr AS (SELECT st.*, {_REGION} AS region, coalesce(findings, []) AS elsewhere FROM st LEFT JOIN said USING (report_id))"
)

_left = _turned(V.SIDE_PAIRS)
_right = _turned([(b, a) for a, b in V.SIDE_PAIRS])
_FREE = f"list_filter({_by('region', V.REGION_FINDINGS)}, lambda f: NOT contains(lower(claim), f) AND NOT list_bool_or(list_transform(names, lambda n: contains(f, n))))"
_HAS_FINDING = r"regexp_matches(lower(claim), '\b' || regexp_escape(finding) || '\b')"
_BARE = "CASE " + " ".join(rf"WHEN regexp_matches(claim, {q('(?i)' + m)}) THEN trim(regexp_replace(claim, {q('(?is)^(.*?)(?:' + m + ')')}, '\1'))" for m in V.NEGATION_MARKERS) + " END"
_TIER_OF = "CASE " + " ".join(f"WHEN old IN ({', '.join(map(q, ws))}) THEN {q(t)}" for t, ws in V.SEVERITY_TIERS.items()) + " END"
_ABSENT = f"list_filter({_CATALOGUE}, lambda x: NOT list_contains(elsewhere, x.f))"
_PHRASE = "CASE made.r " + " ".join(f"WHEN {q(r)} THEN {q(p)}" for r, p in V.REGION_PHRASES.items()) + " END"
_GOOD, _BAD = (f"old IN ({', '.join(map(q, x))})" for x in (V.WELL_PLACED, V.BADLY_PLACED))
_PLACES = f"CASE WHEN {_GOOD} THEN {_list(V.BADLY_PLACED)} WHEN {_BAD} THEN {_list(V.WELL_PLACED)} ELSE list_filter({_list(V.PLACED)}, lambda p: p <> old) END"
_PLACE = "CASE " + " ".join(f"WHEN contains(lower(claim), {q(p)}) THEN {q(p)} END" if i == len(V.PLACED) - 1 else f"WHEN contains(lower(claim), {q(p)}) THEN {q(p)}" for i, p in enumerate(V.PLACED))
#: Of each kind, selects (claim_id, claim, text, field) from sr; field is what else changes.
_MADE = {
    "laterality_swap": f"SELECT claim_id, claim, CASE laterality WHEN 'left' THEN {_left} WHEN 'right' THEN {_right} END AS text, CASE laterality WHEN 'left' THEN 'right' ELSE 'left' END AS field FROM sr",
    "finding_substitution": f"SELECT claim_id, claim, CASE WHEN {_HAS_FINDING} THEN {_put('finding', 'x')} ELSE x || ' noted' END AS text, {_ONT} AS field FROM (SELECT *, {_drawn('free', 'finding')} AS x FROM (SELECT *, {_FREE} AS free FROM sr WHERE category NOT IN ('No Finding', 'Support Devices')))",
    "negation": f"SELECT claim_id, claim, CASE WHEN negated THEN CASE WHEN {word_sql(_LOW, 'without')} THEN {_sub('without', 'with')} ELSE upper(bare[1]) || bare[2:] END WHEN {word_sql(_LOW, 'with')} THEN {_sub('with', 'without')} ELSE 'No evidence of ' || lower(claim[1]) || claim[2:] END AS text, (NOT negated)::VARCHAR AS field FROM (SELECT *, {_BARE} AS bare FROM sr)",
    "region_swap": f"SELECT claim_id, claim, CASE WHEN swapped <> claim THEN swapped ELSE claim || ' in the ' || x END AS text, x AS field FROM (SELECT *, CASE WHEN length(anatomy) > 0 THEN {_put('anatomy', 'x')} ELSE claim END AS swapped FROM (SELECT *, {_drawn('others', 'region')} AS x FROM (SELECT *, list_filter({_list(V.ANATOMY_REGIONS)}, lambda r: r IS DISTINCT FROM anatomy) AS others FROM sr)))",
    "severity_swap": f"SELECT claim_id, claim, {_put('old', 'x')} AS text, tier AS field FROM (SELECT *, {_drawn('options', 'severity')} AS x FROM (SELECT *, {_by('tier', V.SEVERITY_TIERS)} AS options FROM (SELECT *, {_drawn('tiers', 'tier')} AS tier FROM (SELECT *, list_filter({_list(V.SEVERITY_TIERS)}, lambda t: t <> {_TIER_OF}) AS tiers FROM (SELECT *, {_first([w for ws in V.SEVERITY_TIERS.values() for w in ws])} AS old FROM sr WHERE severity IS NOT NULL)))))",
    "temporal_error": f"SELECT claim_id, claim, {_put('old', 'x')} AS text, NULL::VARCHAR AS field FROM (SELECT *, {_drawn('options', 'time')} AS x FROM (SELECT *, {_by('old', V.TEMPORAL_OPPOSITES)} AS options FROM (SELECT *, {_first(V.TEMPORAL_OPPOSITES)} AS old FROM sr)))",
    "device_error": f"SELECT claim_id, claim, CASE WHEN old IS NOT NULL THEN {_put('old', 'x', '')} ELSE {_put('device', 'y')} END AS text, NULL::VARCHAR AS field FROM (SELECT *, {_drawn('places', 'place')} AS x, {_drawn('devices', 'device')} AS y FROM (SELECT *, {_PLACES} AS places, list_filter({_list(V.DEVICE_TYPES)}, lambda d: lower(d) <> lower(device)) AS devices FROM (SELECT *, {_PLACE} AS old, {_first(V.DEVICE_TYPES)} AS device FROM sr WHERE category = 'Support Devices')))",
    "omission": f"SELECT claim_id, claim, upper(made.f[1]) || made.f[2:] || ' ' || {_PHRASE} AS text, regexp_replace({_PHRASE}, '^(in|at) the ', '') AS field FROM (SELECT *, {_drawn('pool', 'omission')} AS made FROM (SELECT *, CASE WHEN len(list_filter(absent, lambda x: x.r = region)) > 0 THEN list_filter(absent, lambda x: x.r = region) ELSE absent END AS pool FROM (SELECT *, {_ABSENT} AS absent FROM sr)))",
}
#: The field that each kind changes beside the text.
_FIELD = {"laterality_swap": "laterality", "finding_substitution": "category", "negation": "negated", "region_swap": "anatomy", "severity_swap": "severity", "omission": "anatomy"}
_NAMES_OF = {"laterality_swap": "H01_structured_laterality", "finding_substitution": "H02_structured_finding", "negation": "H03_structured_negation", "region_swap": "H04_structured_region", "severity_swap": "H05_structured_severity", "temporal_error": "H06_structured_time", "device_error": "H07_structured_device", "omission": "H08_structured_omission"}


def _one(kind):
    def run(spark, sf):
        made = S.structured_negatives(structured_claims(spark, sf), (kind,), 1, SEED)
        field = F.col(f"claim.{_FIELD[kind]}").cast("string") if kind in _FIELD else F.lit(None).cast("string")
        return made.select("claim_id", "claim.text", field.alias("field"), "label")

    return run


for _kind, _name in _NAMES_OF.items():
    query(_name, _VIEW + f" SELECT claim_id, text, field, {S.LABELS[_kind]} AS label FROM ({_MADE[_kind]}) WHERE text IS NOT NULL AND lower(text) <> lower(claim)", "claims")(_one(_kind))

_ALL = " UNION ALL ".join(f"SELECT claim_id, claim, text, {q(k)} AS kind, {S.LABELS[k]} AS label, {uniform_sql(SEED, q('order'), q(k), 'claim_id')} AS u FROM ({body})" for k, body in _MADE.items())


@query("H13_structured_negatives", _VIEW + f", made AS ({_ALL}), different AS (SELECT * FROM made WHERE text IS NOT NULL AND lower(text) <> lower(claim) QUALIFY row_number() OVER (PARTITION BY claim_id, lower(text) ORDER BY u, kind) = 1) SELECT claim_id, kind, text, label FROM different QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY u, kind) <= 3", "claims")
def h13(spark, sf):
    return S.structured_negatives(structured_claims(spark, sf), tuple(S.LABELS), 3, SEED).select("claim_id", "kind", "claim.text", "label")
