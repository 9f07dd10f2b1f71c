"""Perturbed claims (hard negatives): nullable columns, null where a change does not apply.

Every choice is drawn by a seeded hash of the claim's id, so it does not depend on partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..fixtures import digits, uniform, uniform_at_least
from ..sources.tables import spread, stored
from .text import confusable, has_word, let, may_swap_side, replace_first, still_supported

#: Types in the order in which compounds apply them, and the label of what they make (1 contradicted).
SIMPLE = ("laterality_swap", "severity_swap", "temporal_error", "finding_substitution", "region_swap", "negation", "device_line_error", "fabricate_measurement", "fabricate_prior", "fabricate_temporal")
TYPES = (*SIMPLE, "omission_as_support", "compound_2err", "compound_3err")
LABELS = dict.fromkeys(TYPES, 1)


def word(w: str) -> str:
    return rf"\b\Q{w}\E\b"


def pick(options: list[str], u: Column) -> Column:
    return F.get(F.array(*map(F.lit, options)), F.least(F.floor(u * len(options)), F.lit(len(options) - 1)).cast("int"))


def swap_first(text: Column, swaps: dict[str, str]) -> Column:
    """The first of the listed words that stands in text is replaced, at its first place; null without one."""
    return let(F.lower(text), lambda low: F.coalesce(*(F.when(has_word(text, a, low), replace_first(text, word(a), b)) for a, b in swaps.items())))


def laterality_swap(text: Column) -> Column:
    return F.when(may_swap_side(text), swap_first(text, V.LATERALITY_SWAP))


def severity_swap(text: Column) -> Column:
    return swap_first(text, V.SEVERITY_SWAP)


def temporal_error(text: Column) -> Column:
    return swap_first(text, V.TEMPORAL_SWAP)


def region_swap(text: Column) -> Column:
    return swap_first(text, V.REGION_SWAP)


def finding_substitution(text: Column) -> Column:
    """A finding becomes its confusable partner, else one of a fixed list."""

    def swapped(partner):
        cut = lambda w: F.regexp_replace(text, F.lit(rf"(?is)^(.*?){word(w)}"), F.concat(F.lit("$1"), partner))
        return F.when(partner.isNotNull(), let(F.lower(text), lambda low: F.coalesce(*(F.when(has_word(text, w, low), cut(w)) for w in V.SUBSTITUTED))))

    return F.coalesce(let(confusable(text), swapped), swap_first(text, V.SUBSTITUTE_FALLBACK))


def negation(text: Column) -> Column:
    """Drops a no, turns without, absent and present round, puts no behind a copula, else in front."""
    return let(F.lower(text), lambda low: _negated(text, low))


def _negated(text: Column, low: Column) -> Column:
    copula = F.coalesce(*(F.when(has_word(text, c, low), F.regexp_replace(text, rf"(?is)^(.*?{word(c)})", "$1 no")) for c in ("is", "are", "was", "were")))
    front = F.concat(F.lit("No "), F.lower(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))
    return (
        F.when(has_word(text, "no", low), F.trim(replace_first(text, r"\bno\s+", "")))
        .when(has_word(text, "without", low), replace_first(text, word("without"), "with"))
        .when(has_word(text, "absent", low), replace_first(text, word("absent"), "present"))
        .when(has_word(text, "present", low), replace_first(text, word("present"), "absent"))
        .otherwise(F.coalesce(copula, front))
    )


def device_line_error(text: Column) -> Column:
    device = let(F.lower(text), lambda low: reduce(lambda a, b: a | b, (has_word(text, w, low) for w in V.DEVICE_WORDS)))
    return F.when(device, F.coalesce(swap_first(text, V.DEVICE_POSITIONS), F.concat(F.regexp_replace(text, r"\.+$", ""), F.lit(V.DEVICE_FALLBACK))))


def omission(text: Column, u: Column) -> Column:
    return F.when(text.isNotNull(), pick(V.FABRICATED, u))


_NOUNS = ["nodule", "mass", "opacity", "lesion", "pleural effusion", "effusion", "pneumothorax", "consolidation", "atelectasis", "fracture"]


def fabricate_measurement(text: Column, u: Column, nouns: list[str] | None = None) -> Column:
    """A size in front of the first listed noun that stands in text, unless there is a measurement."""
    size = pick(V.MEASUREMENTS, u)
    put = lambda n: F.regexp_replace(text, F.lit(rf"(?is)^(.*?)({word(n)})"), F.concat(F.lit("$1"), size, F.lit(f" {n}")))
    return F.when(~text.rlike("(?i)" + V.HAS_MEASUREMENT), let(F.lower(text), lambda low: F.coalesce(*(F.when(has_word(text, n, low), put(n)) for n in nouns or _NOUNS))))


def _append(text: Column, phrase: Column) -> Column:
    bare = F.regexp_replace(F.rtrim(text), r"\.+$", "")
    return F.when(bare != "", F.concat(bare, F.lit(", "), phrase, F.lit(".")))


def fabricate_prior(text: Column, u: Column) -> Column:
    return F.when(~text.rlike("(?i)" + V.HAS_PRIOR), _append(text, pick(V.PRIOR_PHRASES, u)))


def fabricate_temporal(text: Column, u: Column) -> Column:
    return F.when(~text.rlike("(?i)" + V.HAS_TEMPORAL) & ~text.rlike("(?i)" + V.HAS_PRIOR), _append(text, pick(V.TEMPORAL_PHRASES, u)))


def apply(kind: str, text: Column, u: Column) -> Column:
    """One of SIMPLE or omission_as_support; an unknown type is an error."""
    plain = {"laterality_swap": laterality_swap, "severity_swap": severity_swap, "temporal_error": temporal_error, "finding_substitution": finding_substitution, "region_swap": region_swap, "negation": negation, "device_line_error": device_line_error}
    drawn = {"fabricate_measurement": fabricate_measurement, "fabricate_prior": fabricate_prior, "fabricate_temporal": fabricate_temporal, "omission_as_support": omission}
    if kind in plain:
        return plain[kind](text)
    if kind in drawn:
        return drawn[kind](text, u)
    raise ValueError(f"no perturbation {kind}")


def perturb(rows: DataFrame, kinds: tuple[str, ...], seed: int, key: str = "claim_id", text: str = "claim") -> DataFrame:
    """(key, kind, claim, label): every simple kind on every row that it changes."""
    def of(k):
        return let(F.col(text), lambda c: apply(k, c, uniform(seed, F.lit(k), F.col(key))))

    made = F.array(*(F.struct(F.lit(k).alias("kind"), of(k).alias("claim")) for k in kinds))
    out = rows.select(key, F.col(text).alias("_old"), F.explode(made).alias("x")).select(key, "_old", "x.kind", "x.claim")
    return out.where(F.col("claim").isNotNull() & (F.lower("claim") != F.lower("_old"))).select(key, "kind", "claim", F.lit(1).alias("label"))


def compounded(errors: int, seed: int, key: str, text: Column) -> Column:
    """The text after `errors` different simple kinds, the first by seeded hash, in fixed order one after another; null where a step does not apply."""
    # digits of a draw and the kind as one string sort as the pair does
    drawn = F.sort_array(F.array(*(F.concat(digits(seed, F.lit(k), F.col(key)), F.lit(f" {k} ")) for k in SIMPLE)))

    def step(k, kinds):
        def changed(c):
            after = let(apply(k, c, uniform(seed + 1, F.lit(k), F.col(key))), lambda a: F.when(F.lower(a) != F.lower(c), a))
            return F.when(F.contains(kinds, F.lit(f" {k} ")), after).otherwise(c)

        return changed

    def every(kinds):
        claim = text
        for k in SIMPLE:
            claim = let(claim, step(k, kinds))
        return claim

    return let(F.array_join(F.slice(drawn, 1, errors), ""), every)


def compound(rows: DataFrame, errors: int, seed: int, key: str = "claim_id", text: str = "claim") -> DataFrame:
    """(key, claim): `errors` different simple kinds in fixed order, one after another; rows where any step does not apply are left out."""
    claim = let(F.col(text), lambda c: compounded(errors, seed, key, c))
    return rows.select(key, F.explode(F.array(claim)).alias("claim")).where(F.col("claim").isNotNull())


def by_kind(values: dict[str, Column]):
    """A function from a column of kinds to the value of each; only the value asked for is computed."""

    def of(kind):
        out = F
        for k, v in values.items():
            out = out.when(kind == k, v)
        return out if values else F.lit(None)

    return of


def first_texts(make, text_of, differs, kinds: tuple[str, ...], most: int, seed: int, key: str, type_: str) -> Column:
    """An array of (kind, claim, low): up to `most` claims of different texts (low, in lower case), of the kinds in seeded order.

    Kinds behind the last one needed are not made. make gives the claim of a kind, null where it does not apply, text_of a claim's text,
    differs tells from a text in lower case whether it counts."""
    order = F.sort_array(F.array(*(F.concat(digits(seed, F.lit("order"), F.lit(k), F.col(key)), F.lit(f" {k}")) for k in kinds)))  # sorts by draw, then kind

    def step(kept, drawn):
        kind = F.substring(drawn, F.lit(10), F.length(drawn))

        def add(made):
            new = let(F.lower(text_of(made)), lambda low: F.when(differs(low) & ~F.exists(kept, lambda y: y["low"] == low), F.struct(kind.alias("kind"), made.alias("claim"), low.alias("low"))))
            return let(new, lambda x: F.when(x.isNotNull(), F.concat(kept, F.array(x))).otherwise(kept))

        return F.when(F.size(kept) < most, let(make(kind), add)).otherwise(kept)

    none = F.array().cast(f"array<struct<kind:string,claim:{type_},low:string>>")
    return F.aggregate(order if kinds else F.array().cast("array<string>"), none, step)


def hard_negatives(rows: DataFrame, kinds: tuple[str, ...], per_claim: int, seed: int, key: str = "claim_id", text: str = "claim", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kind, claim, label, and the columns of keep): up to per_claim different texts (without case) of each claim, kinds in seeded order.

    All within the row: kinds are tried in the order of their draws until there are enough, later ones that repeat a text go. No shuffle."""
    unknown = [k for k in kinds if k not in TYPES]
    if unknown:
        raise ValueError(f"no perturbations {unknown}")

    def made(k, c):
        if k.startswith("compound"):
            return compounded(int(k.split("_")[1][0]), seed, key, c)
        return let(apply(k, c, uniform(seed, F.lit(k), F.col(key))), lambda a: F.when(F.lower(a) != F.lower(c), a))

    of = {k: made(k, F.col(text)) for k in kinds}
    distinct = first_texts(by_kind(of), lambda c: c, lambda low: low.isNotNull(), kinds, per_claim, seed, key, "string")
    return rows.select(key, *keep, F.explode(distinct).alias("x")).select(key, "x.kind", "x.claim", F.lit(1).alias("label"), *keep)


def rewrite_report(rows: DataFrame, rules: list[dict[str, str]], share: float, seed: int, key: str = "report_id", text: str = "text") -> DataFrame:
    """Adds new_text: rules in order; each word that a rule names is rewritten with probability `share`, by a coin for (report, rule, place)."""

    tables = [F.create_map(*(F.lit(x) for kv in swaps.items() for x in kv)) for swaps in rules]
    named = [w for swaps in rules for w in swaps]

    def rewritten(w, i):
        def step(r):
            def one(x):
                new = F.get(F.array(F.element_at(tables[r], F.lower(x["bare"]))), F.lit(0))
                # the coin falls where the draw is below the share
                coin = ~uniform_at_least(share, seed, F.lit(str(r)), F.col(key).cast("string"), i.cast("string"))
                return let(new, lambda n: F.when(n.isNotNull() & coin, F.concat(n, F.substring(x["w"], F.length(x["bare"]) + 1, F.lit(100)))).otherwise(x["w"]))

            return lambda v: let(F.struct(v.alias("w"), F.regexp_extract(v, r"^([A-Za-z-]+)([.,;:]?)$", 1).alias("bare")), one)

        out = w
        for r in range(len(rules)):
            out = let(out, step(r))
        # few words are named by any rule, and only those are taken apart
        return F.when(F.lower(F.rtrim(w, F.lit(".,;:"))).isin(*named), out).otherwise(w)

    return rows.withColumn("new_text", F.array_join(F.transform(F.split(text, " "), rewritten), " "))


def dual_run(reports: DataFrame, seed: int, share: float = 0.5) -> DataFrame:
    """(report_id, run, pos, sentence, claim_generator_id, evidence_generator_id): sentences of the reports as they are (run a) and rewritten (run b)."""
    from .text import collapsed_sentences

    b = rewrite_report(reports, [V.LATERALITY_SWAP, V.SEVERITY_SWAP, V.TEMPORAL_SWAP], share, seed)
    runs = b.select("report_id", F.explode(F.array(F.struct(F.lit("a").alias("run"), F.col("text").alias("t")), F.struct(F.lit("b").alias("run"), F.col("new_text").alias("t")))).alias("x"))
    rows = runs.select("report_id", "x.run", F.posexplode(collapsed_sentences(F.col("x.t"), 10)).alias("pos", "sentence"))
    return rows.withColumn("claim_generator_id", F.concat(F.lit("run_"), "run")).withColumn("evidence_generator_id", F.col("claim_generator_id"))


def preference_pairs(rows: DataFrame) -> DataFrame:
    """(claim_id, chosen, rejected) from counterfactual (string) and counterfactuals (array): blanks and texts equal to the claim go."""
    all_ = F.concat(F.array("counterfactual"), F.coalesce("counterfactuals", F.array().cast("array<string>")))
    flat = rows.select("claim_id", F.col("claim").alias("chosen"), F.explode(all_).alias("rejected"))
    return flat.where((F.trim(F.coalesce("rejected", F.lit(""))) != "") & (F.trim("rejected") != F.trim("chosen")))


def insufficient_claims(rows: DataFrame, seed: int) -> DataFrame:
    """(claim_id, claim, label 2): a claim about a finding that the row's text does not mention, by template and side."""
    findings = F.array(*map(F.lit, V.SIDED))
    absent = F.filter(findings, lambda f: ~F.contains(F.lower(F.col("claim")), f))
    u = uniform(seed, F.col("claim_id"))
    finding = F.get(absent, F.least(F.floor(u * F.size(absent)), F.size(absent) - 1).cast("int"))
    side = pick(["left", "right"], uniform(seed + 1, F.col("claim_id")))
    template = F.when(uniform(seed + 2, F.col("claim_id")) < 0.5, F.concat(F.lit("There is a "), side, F.lit(" "), finding, F.lit("."))).otherwise(F.concat(F.initcap(side), F.lit("-sided "), finding, F.lit(" is present.")))
    return rows.select("claim_id", template.alias("claim"), F.lit(2).alias("label")).where("claim is not null")


def balanced_claims(rows: DataFrame, per_class: int, seed: int, kinds: tuple[str, ...] = TYPES, compound_share: float = 0.4) -> DataFrame:
    """(claim_id, claim, evidence_text, label, kind): supported, contradicted and mismatched claims, up to per_class of each.

    Rows have a claim_id of their own. Contradicted: every kind is tried on every supported claim, texts that the evidence still supports go,
    and each kind keeps its quota by seeded rank; what compounds do not use goes to compound_2err."""
    from ..operators.joins import mismatched_evidence

    # all parts below read the supported claims, and the texts are most of the work
    base = stored(spread(rows.where("label = 0").select("claim_id", "patient_id", "pathology", "claim", "evidence_text"), "claim_id"))
    u = uniform(seed, F.lit("base"), F.col("claim_id"))
    supported = base.orderBy(u, "claim_id").limit(per_class)
    simple = [k for k in kinds if not k.startswith("compound")]
    pairs = [k for k in kinds if k.startswith("compound")]
    quota = {k: int(per_class * (1 - compound_share if pairs else 1) / max(1, len(simple))) for k in simple} | {k: int(per_class * compound_share / max(1, len(pairs))) for k in pairs}
    if "compound_2err" in quota:
        quota["compound_2err"] += per_class - sum(quota.values())
    made = hard_negatives(base, kinds, len(kinds), seed, keep=("evidence_text",))
    made = made.where(~still_supported(F.col("claim"), F.col("evidence_text")))
    order = Window.partitionBy("kind").orderBy(uniform(seed, F.lit("quota"), F.col("kind"), F.col("claim_id")), "claim_id")
    limits = F.create_map(*(F.lit(x) for kv in quota.items() for x in kv))
    # the greatest quota as a number lets each task drop rows before they move
    made = made.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= max([0, *quota.values()])).where(F.col("_k") <= limits[F.col("kind")])
    other = mismatched_evidence(base, "pathology", seed).join(base.select("claim_id", "claim"), "claim_id").join(base.select(F.col("claim_id").alias("other_id"), "evidence_text"), "other_id")
    other = other.orderBy(uniform(seed, F.lit("other"), F.col("claim_id")), "claim_id").limit(per_class)
    parts = [
        supported.select("claim_id", "claim", "evidence_text", F.lit(0).alias("label"), F.lit("supported").alias("kind")),
        made.select("claim_id", "claim", "evidence_text", F.lit(1).alias("label"), "kind"),
        other.select("claim_id", "claim", "evidence_text", F.lit(2).alias("label"), F.lit("mismatched").alias("kind")),
    ]
    return reduce(DataFrame.unionByName, parts)
