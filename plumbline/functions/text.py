"""Column functions over report and claim texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V


def let(value: Column, f) -> Column:
    """f of a value that is computed once.

    The greatest of an array of one value is the value; unlike get, array_max keeps its type, which nested uses would work out again for every row."""
    return F.array_max(F.transform(F.array(value), f))


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def has_word(text: Column, word: str, low: Column | None = None) -> Column:
    """Whether a word stands in text, without case; the pattern is tried only where its letters do, as that takes much longer.

    low: the text in lower case, where many words are looked for."""
    return F.contains(F.lower(text) if low is None else low, F.lit(word.lower())) & text.rlike(rf"(?i)\b\Q{word}\E\b")


def replace_first(text: Column, pattern: str, to: str) -> Column:
    """The first match of a pattern, without case, replaced; the text itself where there is none."""
    return F.regexp_replace(text, rf"(?is)^(.*?)(?:{pattern})", "$1" + to.replace("$", r"\$"))


def sections(text: Column) -> dict[str, Column]:
    """findings and impression; a text without either stands for both."""
    t = F.trim(text)
    findings = F.trim(F.regexp_extract(t, r"(?is)FINDINGS[:\s]*\n?(.*?)(?=IMPRESSION|$)", 1))
    impression = F.trim(F.regexp_extract(t, r"(?is)IMPRESSION[:\s]*\n?(.*?)$", 1))
    none = (findings == "") & (impression == "")
    return {"findings": F.when(none, t).otherwise(findings), "impression": F.when(none, t).otherwise(impression)}


def chosen_section(text: Column, which: str) -> Column:
    """findings, impression, both (those that are not blank, with a space between) or full, the trimmed text; a null text has empty sections."""
    known = F.coalesce(text, F.lit(""))
    s = sections(known)
    filled = lambda c: F.when(c != "", c)
    choice = {**s, "both": F.concat_ws(" ", filled(s["findings"]), filled(s["impression"])), "full": F.trim(known)}
    if which not in choice:
        raise ValueError(f"{which} is none of {sorted(choice)}")
    return choice[which]


def combined(findings: Column, impression: Column, names: tuple[str, str] = ("FINDINGS", "IMPRESSION"), gap: str = " ") -> Column:
    """Sections with their names, blank ones left out."""
    part = lambda c, n: F.when(F.trim(c) != "", F.concat(F.lit(f"{n}: "), F.trim(c)))
    return F.concat_ws(gap, part(findings, names[0]), part(impression, names[1]))


def sentences(text: Column) -> Column:
    """Sentences of more than 5 letters; abbreviations do not end one. Splits after .!? and white space, at lines and semicolons."""
    kept = F.regexp_replace(F.trim(text), r"\b(Dr|Mr|Mrs|Ms|vs|etc|e\.g|i\.e)\.", "$1\u0001")
    cut = F.split(F.regexp_replace(kept, r"([.!?])\s+", "$1\u0002"), "\u0002|\n+|;\\s*")
    clean = F.transform(cut, lambda s: F.trim(F.regexp_replace(s, "\u0001", ".")))
    return F.filter(clean, lambda s: F.length(s) > 5)


def claims_of(text: Column) -> Column:
    """Claims by punctuation: parts of 15 letters and more that do not start with HISTORY; none in texts under 10 letters."""
    cut = F.split(F.regexp_replace(F.trim(text), r"([.!?])\s+", "$1\u0002"), "\u0002|\n+")
    found = F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: (F.length(s) >= 15) & ~F.startswith(s, F.lit("HISTORY")))
    return F.when(F.length(text) >= 10, found).otherwise(F.array().cast("array<string>"))


def collapsed_sentences(text: Column, least: int = 6) -> Column:
    """Sentences after runs of white space became one space."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.filter(F.transform(F.split(F.regexp_replace(one, r"([.!?])\s+", "$1\u0002"), "\u0002"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def merged_sentences(text: Column, most: int = 20) -> Column:
    """Greedy merging of a sentence with the next one if that continues it or refers back; pairs only."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(F.trim(text), r"([.!?])\s+", "$1\u0002"), "\u0002"), lambda s: F.trim(s)), lambda s: F.length(s) > 10)
    starts = lambda s, words: reduce(lambda a, b: a | b, (F.startswith(F.lower(s), F.lit(w)) for w in words))
    bare = lambda s: F.regexp_replace(s, r"\.+$", "")

    def step(a, s):
        last = F.element_at(a["out"], -1)
        init = F.slice(a["out"], 1, F.greatest(F.size(a["out"]) - 1, F.lit(0)))
        free = (F.size(a["out"]) > 0) & ~a["merged"]
        cont, ana = free & starts(s, V.CONTINUATIONS), free & starts(s, V.ANAPHORA)
        joined = F.when(cont, F.concat(bare(last), F.lit(", "), F.lower(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))).otherwise(F.concat(bare(last), F.lit("; "), s))
        return F.struct(F.when(cont | ana, F.concat(init, F.array(joined))).otherwise(F.concat(a["out"], F.array(s))).alias("out"), (cont | ana).alias("merged"))

    done = F.aggregate(parts, F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("merged")), step)
    return F.slice(done["out"], 1, most)


def chained_claims(text: Column) -> Column:
    """Sentences over 10 letters; those that start with or, and, nor are appended to the one before, in chains. None: the text."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(F.trim(text), r"([.!?])\s+", "$1\u0002"), "\u0002"), lambda s: F.trim(s)), lambda s: F.length(s) > 10)

    def step(a, s):
        go_on = (F.size(a) > 0) & F.lower(s).rlike("^(or|and|nor) ")
        joined = F.concat(F.regexp_replace(F.element_at(a, -1), r"\.+$", ""), F.lit(", "), F.lower(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))
        return F.when(go_on, F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(a, F.array(s)))

    found = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.trim(text)))


def category_by_count(text: Column, words: dict[str, list[str]] = V.COUNTED, default: str = V.RARE) -> Column:
    names = F.array(*map(F.lit, words))

    def best(low):
        counts = F.array(*(sum((F.contains(low, F.lit(w)).cast("int") for w in ws), F.lit(0)) for ws in words.values()))
        return let(counts, lambda ns: let(F.array_max(ns), lambda n: F.when(n > 0, F.get(names, F.array_position(ns, n).cast("int") - 1)).otherwise(default)))

    return F.when(text.isNull(), default).otherwise(let(F.lower(text), best))


def category_first(text: Column, words: dict[str, list[str]] = V.FIRST_HIT, default: str | None = V.OTHER, whole: bool = False) -> Column:
    """The first category with a hit, by substring or as whole words."""
    low = F.lower(text)
    hit = lambda ws: reduce(lambda a, b: a | b, (has_word(low, w) for w in ws)) if whole else contains_any(low, ws)
    return F.coalesce(*(F.when(hit(ws), c) for c, ws in words.items()), F.lit(default))


def ontology(entity: Column) -> Column:
    def named(low):
        exact = [F.when(low.isin(*ws), c) for c, ws in V.ONTOLOGY.items()]
        return F.coalesce(*exact, *(F.when(contains_any(low, ws), c) for c, ws in V.ONTOLOGY.items()), F.lit(V.RARE))

    return let(F.trim(F.lower(entity)), named)


def laterality(text: Column) -> Column:
    low = F.lower(text)
    left, right = contains_any(low, V.LEFT_WORDS), contains_any(low, V.RIGHT_WORDS)
    return F.when(left & right, "bilateral").when(left, "left").when(right, "right")


def severity(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*(F.when(contains_any(low, ws), s) for s, ws in V.SEVERITY_WORDS.items()))


def mentioned(text: Column) -> Column:
    """Array of findings mentioned; No Finding only where a normal phrase stands and nothing else."""
    low = F.lower(text)
    found = F.array_compact(F.array(*(F.when(contains_any(low, ws), F.lit(c)) for c, ws in V.MENTIONED.items())))
    return F.when((F.size(found) == 0) & contains_any(low, V.NORMAL_PHRASES), F.array(F.lit(V.NO_FINDING))).otherwise(found)


def flags(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike("(?i)" + p), F.lit(n)) for n, p in V.FLAGS.items())))


def search_tokens(text: Column) -> Column:
    """Lower-cased words with hyphens, without stop words and single letters."""
    words = F.split(F.regexp_replace(F.trim(F.lower(text)), r"(?U)[^\w\s-]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*V.STOP_WORDS))


def alnum_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b([\w']+)\b"), 1)


def is_error_text(text: Column) -> Column:
    """Blank, or in square brackets and speaking of an error or of something unavailable."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return (t == "") | (F.startswith(t, F.lit("[")) & F.endswith(t, F.lit("]")) & (F.contains(t, F.lit("error")) | F.contains(t, F.lit("unavailable"))))


def may_swap_side(text: Column) -> Column:
    low = F.lower(text)
    return F.when(contains_any(low, V.SIDED), True).when(contains_any(low, V.NOT_SIDED), False).otherwise(contains_any(low, V.SIDE_WORDS))


def confusable(text: Column) -> Column:
    """The partner of the first pair of which either side stands in the text."""
    low = F.lower(text)
    return F.coalesce(*(F.when(F.contains(low, F.lit(a)), b).when(F.contains(low, F.lit(b)), a) for a, b in V.CONFUSABLE))


def label_confidence(category: Column) -> Column:
    noise = F.coalesce(*(F.when(category == c, F.lit(n)) for c, n in V.LABEL_NOISE.items()), F.lit(V.NOISE_DEFAULT))
    return 1.0 - noise


def evidence_text(evidence: Column, most: int = 2) -> Column:
    return F.array_join(F.slice(evidence, 1, most), " [SEP] ")


def binary_label(label: Column) -> Column:
    return F.when(label == "SUPPORTED", 0).when(label.isin("CONTRADICTED", "NOVEL_PLAUSIBLE", "NOVEL_HALLUCINATED", "UNCERTAIN"), 1)


def _by_letter(code: Column, meaning: dict[str, str]) -> Column:
    letter = F.lower(F.regexp_replace(code, r"^\s+|\s+$", ""))
    return F.coalesce(*(F.when(letter == k, v) for k, v in meaning.items()))


def label_of_letter(code: Column) -> Column:
    """The label that a letter stands for, in either case and with white space around; null for anything else."""
    return _by_letter(code, V.LABEL_LETTERS)


def sureness_of_letter(code: Column) -> Column:
    """low, medium or high; medium for anything else and null."""
    return F.coalesce(_by_letter(code, V.SURENESS_LETTERS), F.lit("medium"))


def clean_tokens(tokens: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tokens, lambda s: F.trim(s)), lambda t: t != ""))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein's distance; a narrow band round the diagonal is tried first, which is all that texts of few differences need.

    Within a threshold the function gives the exact distance, beyond it -1; then a wider band is tried, at last the whole table."""
    within = [F.levenshtein(a, b, k) for k in (4, 16)]
    return F.when(a == b, 0).otherwise(F.coalesce(*(F.when(d >= 0, d) for d in within), F.levenshtein(a, b)))


def missing_tokens(text: Column, tokens: Column) -> Column:
    """Tokens that do not stand in text as whole words, without case."""
    return F.filter(tokens, lambda t: ~F.rlike(text, F.concat(F.lit(r"(?i)\b\Q"), t, F.lit(r"\E\b"))))


def still_supported(claim: Column, evidence: Column) -> Column:
    """All of the claim's key words, at least two, stand in the evidence as whole words (a word listed twice counts twice)."""
    keys = [w for ws in V.FIRST_HIT.values() for w in ws] + ["left", "right", "bilateral"]
    # a word that is not in the evidence weighs more than all that are
    missing = -1 - len(keys)
    known = lambda c, e: sum((F.when(~has_word(claim, w, c), 0).when(has_word(evidence, w, e), 1).otherwise(missing) for w in keys), F.lit(0)) >= 2
    any_word = lambda t, low: reduce(lambda a, b: a | b, (has_word(t, w, low) for w in keys))
    # where one of the two is null, the answer is known only if the other has no key word
    either = F.coalesce(claim, evidence)
    unknown = let(F.lower(either), lambda low: F.when(~any_word(either, low), False))
    return F.when(claim.isNull() | evidence.isNull(), unknown).otherwise(let(F.lower(claim), lambda c: let(F.lower(evidence), lambda e: known(c, e))))


def contradiction_score(claim: Column, evidence: Column, window: int = 4) -> Column:
    """0 to 4: nearby negation, side conflict, severity pair, temporal pair."""
    c, e = word_tokens(claim), word_tokens(evidence)
    content = F.filter(F.array_distinct(c), lambda t: (F.length(t) > 2) & ~t.isin(*V.CONTENT_STOP_WORDS))

    def near(words, own):
        around = F.transform(words, lambda w, i: F.when(F.array_contains(own, w), F.array_join(F.slice(words, F.greatest(i + 1 - window, F.lit(1)), F.least(i, F.lit(window)) + window + 1), " ")))
        return F.exists(around, lambda t: F.coalesce(contains_any(t, V.NEGATIONS), F.lit(False)))

    # lambda variables, so that texts are cut once
    # a window is a part of the words joined, so without a negation there none has one
    windows = F.exists(F.array(F.struct(e.alias("w"), content.alias("c"))), lambda x: near(x["w"], x["c"]))
    negated = contains_any(F.array_join(e, " "), V.NEGATIONS) & windows
    sides = F.array(*map(F.lit, V.SIDE_CONFLICT))
    cs, es = F.array_intersect(c, sides), F.array_intersect(e, sides)
    side = (F.size(cs) > 0) & (F.size(es) > 0) & ~F.arrays_overlap(cs, es)
    lc, le = F.lower(claim), F.lower(evidence)
    has = lambda t, w: F.contains(t, F.lit(w))
    pair = lambda ps: reduce(lambda x, y: x | y, ((has(lc, a) & has(le, b)) | (has(lc, b) & has(le, a)) for a, b in ps))
    return sum((x.cast("int") for x in (negated, side, pair(V.SEVERITY_CONFLICT), pair(V.TEMPORAL_CONFLICT))), F.lit(0))


def patient_of_file(name: Column) -> Column:
    return F.split(F.regexp_replace(name, r"\.png", ""), "_")[0]


def without_prompt(text: Column, prompt: str) -> Column:
    at = F.locate(prompt, text)
    return F.when(at > 0, F.trim(F.substring(text, at + len(prompt), F.length(text)))).otherwise(F.trim(text))


def grader_label(raw: Column) -> Column:
    """Label of a grader's answer: the JSON field if it is a label, else the first label named (longest first), else UNCERTAIN."""
    from ..fixtures import GRADES

    field = F.upper(F.get_json_object(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), "$.label"))
    named = [F.when(F.contains(F.upper(raw), F.lit(g)), g) for g in sorted(GRADES, key=len, reverse=True)]
    return F.coalesce(F.when(field.isin(*GRADES), field), *named, F.lit("UNCERTAIN"))


def json_strings(raw: Column, least: int = 1) -> Column:
    """Strings of a JSON array in free text: fences are taken off, else the widest bracketed part is read; blanks go."""
    bare = F.trim(F.regexp_replace(raw, r"```(?:json)?", ""))
    parsed = F.coalesce(F.from_json(bare, "array<string>"), F.from_json(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), "array<string>"))
    return F.filter(F.coalesce(parsed, F.array().cast("array<string>")), lambda s: F.length(F.trim(F.coalesce(s, F.lit("")))) >= least)


def tempered(logits: Column, temperature: float) -> Column:
    """Softmax of logits / T with T of at least 0.01."""
    t = max(temperature, 0.01)
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / t))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
