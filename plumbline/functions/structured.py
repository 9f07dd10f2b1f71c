"""Perturbations of structured claims: a claim as a struct in, a changed struct out, null where a change does not apply.

A claim has text, category, entities (tokens, is_observation), negated, laterality, severity, anatomy and
findings_elsewhere, the catalogue's findings that stand anywhere in its report (report_findings). Choices
are drawn by a seeded hash of the claim's key, as those on plain texts are. All changes of a claim, their
order and the choice among them are made within its row: nothing is shuffled.

Null or blank texts are never changed; null entities and findings count as none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..fixtures import digits, uniform
from .perturb import by_kind, first_texts, word
from .text import contains_any, has_word, let, ontology, replace_first

ENTITY = "struct<tokens:string,is_observation:boolean>"
CLAIM = f"struct<text:string,category:string,entities:array<{ENTITY}>,negated:boolean,laterality:string,severity:string,anatomy:string>"
#: Kinds and the labels of what they make: 1 contradicted, 2 insufficient.
LABELS = {"laterality_swap": 1, "finding_substitution": 1, "negation": 1, "region_swap": 1, "severity_swap": 1, "temporal_error": 1, "device_error": 1, "omission": 2}
CATALOGUE = [(f, region) for region, fs in V.REGION_FINDINGS.items() for f in fs]


def changed(c: Column, **fields: Column) -> Column:
    """The claim with new fields; null where its new text is null or the old one."""

    def with_text(text):
        new = c
        for name, value in {**fields, "text": text}.items():
            new = new.withField(name, value)
        return F.when(text.isNotNull() & (text != c["text"]), new)

    return let(fields["text"], with_text)


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def drawn(options: Column, u: Column) -> Column:
    """One of an array of any size; null of an empty one."""
    return F.get(options, F.least(F.floor(u * F.size(options)), F.size(options) - 1).cast("int"))


def first_of(text: Column, words: list[str]) -> Column:
    """The first of the listed words that stands in text."""
    return let(F.lower(text), lambda low: F.coalesce(*(F.when(has_word(text, w, low), F.lit(w)) for w in words)))


def put(text: Column, old: Column, new: Column) -> Column:
    """The first place of a word given by a column, without case, replaced."""
    return F.regexp_replace(text, F.concat(F.lit(r"(?is)^(.*?)\b\Q"), old, F.lit(r"\E\b")), F.concat(F.lit("$1"), new))


def region(c: Column) -> Column:
    low = F.lower(F.coalesce(c["anatomy"], F.lit("")))
    named = let(low, lambda a: F.coalesce(*(F.when(contains_any(a, ws), r) for r, ws in V.REGION_WORDS.items())))
    return F.coalesce(named, *(F.when(c["category"] == k, r) for k, r in V.REGION_OF_CATEGORY.items()), F.lit("lung"))


def laterality_swap(c: Column, u) -> Column:
    """The longest side word of the claim's own side changes sides; claims of both sides or none do not apply."""
    text = c["text"]

    def turned(pairs):
        return let(F.lower(text), lambda low: F.coalesce(*(F.when(has_word(text, a, low), replace_first(text, word(a), b)) for a, b in pairs)))

    left = c["laterality"] == "left"
    new = F.when(left, turned(V.SIDE_PAIRS)).when(c["laterality"] == "right", turned([(b, a) for a, b in V.SIDE_PAIRS]))
    return changed(c, text=new, laterality=F.when(left, "right").otherwise("left"))


def finding_substitution(c: Column, u) -> Column:
    """A finding of the same region that neither the text nor an entity holds, in place of the first observation that stands in the text."""
    text = c["text"]
    entities = F.coalesce(c["entities"], F.array().cast(f"array<{ENTITY}>"))
    own = F.struct(F.lower(text).alias("low"), F.transform(entities, lambda e: F.lower(e["tokens"])).alias("names"))
    of_region = F.create_map(*(x for r, fs in V.REGION_FINDINGS.items() for x in (F.lit(r), strings(fs))))
    options = let(region(c), lambda r: of_region[r])
    free = let(own, lambda o: F.filter(options, lambda f: ~F.contains(o["low"], f) & ~F.exists(o["names"], lambda n: F.coalesce(F.contains(f, n), F.lit(False)))))

    def substituted(new):
        there = F.filter(entities, lambda e: e["is_observation"] & (F.length(e["tokens"]) > 0) & F.rlike(text, F.concat(F.lit(r"(?is)\b\Q"), e["tokens"], F.lit(r"\E\b"))))
        swapped = lambda old: F.when(old.isNotNull(), put(text, old, new)).when(new.isNotNull(), F.concat(new, F.lit(" noted")))
        return changed(c, text=let(F.get(there, F.lit(0))["tokens"], swapped), category=ontology(new))

    return F.when(~c["category"].isin("No Finding", "Support Devices"), let(let(free, lambda fs: drawn(fs, u("finding"))), substituted))


def negation(c: Column, u) -> Column:
    """A negated claim loses its first marker, another gains one."""
    text = c["text"]
    bare = F.coalesce(*(F.when(text.rlike("(?i)" + m), F.trim(replace_first(text, m, ""))) for m in V.NEGATION_MARKERS))
    capital = let(bare, lambda b: F.concat(F.upper(F.substring(b, 1, 1)), F.substring(b, F.lit(2), F.length(b))))
    positive = F.when(has_word(text, "without"), replace_first(text, word("without"), "with")).otherwise(capital)
    negative = F.when(has_word(text, "with"), replace_first(text, word("with"), "without")).otherwise(F.concat(F.lit("No evidence of "), F.lower(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text))))
    return changed(c, text=F.when(c["negated"], positive).otherwise(negative), negated=~F.coalesce(c["negated"], F.lit(False)))


def region_swap(c: Column, u) -> Column:
    """Another of the listed anatomies, in place of the claim's own or behind the text."""
    text, own = c["text"], c["anatomy"]
    others = F.filter(strings(V.ANATOMY_REGIONS), lambda r: ~r.eqNullSafe(own))

    def moved(new):
        swapped = F.when(F.length(own) > 0, put(text, own, new)).otherwise(text)
        return changed(c, text=let(swapped, lambda s: F.when(s != text, s).otherwise(F.concat(text, F.lit(" in the "), new))), anatomy=new)

    return let(let(others, lambda rs: drawn(rs, u("region"))), moved)


def severity_swap(c: Column, u) -> Column:
    """A word of another tier for the first one that stands in the text, the lower tiers looked for first."""
    tier_of = {w: t for t, ws in V.SEVERITY_TIERS.items() for w in ws}

    def swapped(old):
        own = F.coalesce(*(F.when(old.isin(*ws), F.lit(t)) for t, ws in V.SEVERITY_TIERS.items()))

        def of(tier):
            options = F.create_map(*(x for t, ws in V.SEVERITY_TIERS.items() for x in (F.lit(t), strings(ws))))[tier]
            return changed(c, text=put(c["text"], old, drawn(options, u("severity"))), severity=tier)

        return let(drawn(F.filter(strings(list(V.SEVERITY_TIERS)), lambda t: t != own), u("tier")), of)

    return F.when(c["severity"].isNotNull(), let(first_of(c["text"], list(tier_of)), swapped))


def temporal_error(c: Column, u) -> Column:
    """One of the opposites of the first listed word of time that stands in the text."""
    options = F.create_map(*(x for w, ws in V.TEMPORAL_OPPOSITES.items() for x in (F.lit(w), strings(ws))))
    return let(first_of(c["text"], list(V.TEMPORAL_OPPOSITES)), lambda old: changed(c, text=put(c["text"], old, drawn(options[old], u("time")))))


def device_error(c: Column, u) -> Column:
    """A good position for a bad one and the other way round, else another device; only for claims about devices."""
    text = c["text"]
    place = let(F.lower(text), lambda low: F.coalesce(*(F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in V.PLACED)))
    device = first_of(text, V.DEVICE_TYPES)

    def moved(old):
        options = F.when(old.isin(*V.WELL_PLACED), strings(V.BADLY_PLACED)).when(old.isin(*V.BADLY_PLACED), strings(V.WELL_PLACED)).otherwise(F.filter(strings(V.PLACED), lambda p: p != old))
        return changed(c, text=F.regexp_replace(text, F.concat(F.lit(r"(?is)^(.*?)\Q"), old, F.lit(r"\E")), F.concat(F.lit("$1"), drawn(options, u("place")))))

    def other(old):
        return changed(c, text=put(text, old, drawn(F.filter(strings(V.DEVICE_TYPES), lambda d: F.lower(d) != F.lower(old)), u("device"))))

    return F.when(c["category"] == "Support Devices", F.coalesce(let(place, moved), let(device, other)))


def omission(c: Column, u, elsewhere: Column) -> Column:
    """A new claim of a finding that stands nowhere in the report, of the claim's own region if there is one: insufficient evidence."""
    per_region = {r: F.array_except(strings(fs), F.coalesce(elsewhere, F.array().cast("array<string>"))) for r, fs in V.REGION_FINDINGS.items()}
    place = lambda r, fs: F.transform(fs, lambda f: F.struct(f.alias("finding"), F.lit(r).alias("region")))

    def pool(own):
        near = F.coalesce(*(F.when((own == r) & (F.size(fs) > 0), place(r, fs)) for r, fs in per_region.items()))
        return F.coalesce(near, F.concat(*(place(r, fs) for r, fs in per_region.items())))

    phrases = F.create_map(*(F.lit(x) for kv in V.REGION_PHRASES.items() for x in kv))

    def made(x):
        phrase = phrases[x["region"]]
        text = F.concat(F.upper(F.substring(x["finding"], 1, 1)), F.substring(x["finding"], F.lit(2), F.length(x["finding"])), F.lit(" "), phrase)
        none = F.lit(None).cast("string")
        return F.when(x.isNotNull(), F.struct(text.alias("text"), ontology(x["finding"]).alias("category"), F.array().cast(f"array<{ENTITY}>").alias("entities"), F.lit(False).alias("negated"), none.alias("laterality"), none.alias("severity"), F.regexp_replace(phrase, "^(in|at) the ", "").alias("anatomy")))

    return let(let(let(region(c), pool), lambda options: drawn(options, u("omission"))), made)


_MAKERS = {"laterality_swap": laterality_swap, "finding_substitution": finding_substitution, "negation": negation, "region_swap": region_swap, "severity_swap": severity_swap, "temporal_error": temporal_error, "device_error": device_error}


def report_findings(rows: DataFrame, report: str = "report_id", claim: str = "claim") -> DataFrame:
    """(report, findings): the catalogue's findings in any claim's text or as an observation of any claim of the report.

    One pass over each claim's row; only distinct pairs of report and finding, 51 a report at most, are shuffled."""
    text = F.lower(F.col(f"{claim}.text"))
    names = F.transform(F.filter(F.coalesce(f"{claim}.entities", F.array().cast(f"array<{ENTITY}>")), lambda e: e["is_observation"]), lambda e: F.lower(e["tokens"]))
    listed = strings(sorted({f for f, _ in CATALOGUE}))
    found = let(F.struct(text.alias("low"), names.alias("names")), lambda o: F.filter(listed, lambda f: F.coalesce(F.contains(o["low"], f), F.lit(False)) | F.array_contains(o["names"], f)))
    return rows.select(report, F.explode(found).alias("finding")).distinct().groupBy(report).agg(F.array_sort(F.collect_list("finding")).alias("findings"))


def apply(kind: str, claim: Column, key: Column, seed: int, elsewhere: Column | None = None) -> Column:
    """One kind of LABELS on a claim column; an unknown kind is an error."""
    if kind not in LABELS:
        raise ValueError(f"no structured perturbation {kind}")

    def u(what):
        return uniform(seed, F.lit(what), key)

    make = (lambda c: omission(c, u, elsewhere)) if kind == "omission" else (lambda c: _MAKERS[kind](c, u))
    return F.when(F.trim(claim["text"]) != "", make(claim))


def structured_negatives(rows: DataFrame, kinds: tuple[str, ...], per_claim: int, seed: int, key: str = "claim_id", report: str = "report_id") -> DataFrame:
    """(key, kind, claim, label): up to per_claim changed claims of different texts (without case, nor the claim's own), kinds in seeded order.

    rows: key, report, claim. Everything but the reports' findings is made within the row."""
    unknown = [k for k in kinds if k not in LABELS]
    if unknown:
        raise ValueError(f"no structured perturbations {unknown}")
    if "omission" in kinds:
        rows = rows.join(report_findings(rows, report).withColumnRenamed("findings", "_elsewhere"), report, "left")
    else:
        rows = rows.withColumn("_elsewhere", F.lit(None).cast("array<string>"))
    claim, old = F.col("claim"), F.lower("claim.text")
    of = {k: apply(k, claim, F.col(key), seed, F.col("_elsewhere")).cast(CLAIM) for k in kinds}
    label = by_kind({k: F.lit(LABELS[k]) for k in kinds})
    kept = first_texts(lambda kind: by_kind(of)(kind), lambda made: made["text"], lambda low: low != old, kinds, per_claim, seed, key, CLAIM)
    return rows.select(key, F.explode(kept).alias("x")).select(key, "x.kind", "x.claim", label(F.col("x.kind")).alias("label"))
