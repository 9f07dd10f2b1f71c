"""License scans by an exact set-similarity join of text blocks with notice templates.

A block is `BLOCK` consecutive words of a text, and blocks start every `BLOCK` / 2 words, so a notice of up
to half a block lies whole in one, however its lines are wrapped. A template is found in a block if at
least `threshold` of the template's different words stand there, its distinguishing words (`MUST`) all.
Template words are ordered by how many documents hold them, rarest first; a block with enough of a
template holds one of its first |T| - need + 1 words (prefix filter), has `need` words at least (length
filter), and its first hit in that order leaves room for `need` words (positional filter). What passes is
verified. Documents without a prefix word are not cut into blocks. Everything is DataFrame functions.

Base phrases are places where their words stand consecutively, whatever parts them.

Rows: null is empty: no words, no places, no labels, score 0; equal rows get equal results, one row
each; a label found twice counts once; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The phrases of the contract and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Sentences of published license notices, lower case, words only.
TEMPLATES = {
    "agpl-notice": "you should have received a copy of the gnu affero general public license along with this program",
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-disclaimer": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-notice": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-release": "released under the mit license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
#: Words of a template without which a text is another notice.
MUST = {
    "agpl-notice": "affero", "apache-2.0": "apache", "apache-disclaimer": "warranties", "bsd-notice": "redistribution", "cc-by-4.0": "commons attribution 4",
    "cc-by-nc-4.0": "cc by nc", "gpl-3.0": "gnu 3", "gpl-notice": "gnu", "lgpl-notice": "lesser", "mit-notice": "granted", "mit-release": "mit", "mpl-2.0": "mozilla",
}
THRESHOLD = (4, 5)
BLOCK = 64
#: Template words in all that the plan carries as literals; longer lists of templates go without the early filter.
MAX_LITERALS = 10_000

_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text):
    """Words, A-Z in lower case."""
    return F.array_remove(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _SEPARATOR), "")


def _places(w, phrase: str):
    p = phrase.split()
    room = F.size(w) - len(p)

    def here(i):
        test = F.get(w, i) == p[0]
        for k, x in enumerate(p[1:], 1):
            test = test & (F.get(w, i + k) == x)
        return test

    return F.when(room >= 0, F.filter(F.sequence(F.lit(0), F.greatest(room, F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def template_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(row, block, label, containment) of every block that holds a template; docs: row, text. Templates of more than BLOCK / 2 words are an error."""
    if any(len(body.split()) > BLOCK // 2 for body in templates.values()):
        raise ValueError("a template is longer than half a block")
    spark = docs.sparkSession
    up, down = threshold
    rows = [(label, sorted({*body.split()}), MUST.get(label, "").split()) for label, body in templates.items()]
    listed = F.array(*(F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, ws)).alias("own"), F.array(*map(F.lit, must)).cast("array<string>").alias("must")) for label, ws, must in rows))
    own = spark.range(1).select(F.inline(listed)).withColumn("size", F.size("own")).withColumn("need", F.ceil(F.col("size") * up / down).cast("int"))
    every = sorted({w for _, ws, _ in rows for w in ws})
    split = docs.select("row", words(F.col("text")).alias("words"))
    terms = own.select(F.explode("own").alias("term")).distinct()
    if len(every) <= MAX_LITERALS:
        held = split.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, every)))).alias("term"))
    else:
        held = split.select(F.explode(F.array_distinct("words")).alias("term")).join(terms, "term", "left_semi")
    counts = terms.join(held.groupBy("term").agg(F.count("*").alias("n")), "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))
    order = Window.partitionBy("label").orderBy("n", "term")
    prefix = own.select("label", "size", "need", "own", "must", F.explode("own").alias("term")).join(counts, "term").withColumn("pos", F.row_number().over(order) - 1).where("pos <= size - need")
    if len(every) <= MAX_LITERALS:
        first = [r.term for r in prefix.select("term").distinct().collect()]  # at most MAX_LITERALS
        split = split.where(F.arrays_overlap("words", F.array(*map(F.lit, first))))
    half = BLOCK // 2
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("words") / half) - 2, F.lit(0)).cast("int"))
    blocks = split.select("row", "words", F.explode(starts).alias("block"))
    blocks = blocks.select("row", "block", F.array_distinct(F.slice("words", F.col("block") * half + 1, F.lit(BLOCK))).alias("words"))
    if len(every) <= MAX_LITERALS:
        blocks = blocks.where(F.arrays_overlap("words", F.array(*map(F.lit, first))))
    hits = blocks.withColumn("term", F.explode("words")).join(prefix, "term").where("size(words) >= need and size - pos >= need")
    whole = F.size(F.array_except(F.first("must"), F.first("words"))) == 0
    hits = hits.groupBy("row", "block", "label").agg(F.first("size").alias("size"), F.first("need").alias("need"), F.size(F.array_intersect(F.first("words"), F.first("own"))).alias("shared"), whole.alias("whole"))
    return hits.where("shared >= need and whole").select("row", "block", "label", (F.col("shared") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of docs."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("row", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "text")))
    found = template_matches(own, templates, threshold).groupBy("row").agg(F.collect_set("label").alias("method"), F.max("containment").alias("containment"))
    may = F.col("text").rlike(r"(?i)license|cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by")
    none = F.array().cast("array<int>")
    # a lambda variable, so that a text is split once and not for each word looked at
    at = F.transform(F.array(words(F.col("text"))), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), F.when(may, F.struct(*(_places(w, p).alias(label) for p, label in PHRASES.items()))).alias("at")))
    per = own.select("doc_id", "row", F.get(at, F.lit(0)).alias("x")).select("doc_id", "row", F.col("x.n").alias("n_words"), F.col("x.at").alias("at"))
    for label in PHRASES.values():
        per = per.withColumn(f"at_{label}", F.coalesce(F.col("at").getField(label), none))
    places = F.concat(*(F.col(f"at_{x}") for x in PHRASES.values()))
    labels = F.array_compact(F.array(*(F.when(F.size(f"at_{x}") > 0, F.lit(x)) for x in PHRASES.values())))
    per = per.select("doc_id", "row", "n_words", places.alias("places"), labels.alias("base"))
    joined = per.join(found, "row", "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"),
        F.array_max("places").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("method", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def scan_sql(templates: dict[str, str] = TEMPLATES, threshold: tuple[int, int] = THRESHOLD) -> str:
    """The same rows from SQL."""
    up, down = threshold
    words_of = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    place = []
    for p in PHRASES:
        ws = p.split()
        place.append(f"list_filter(range(0, len(w) - {len(ws) - 1}), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(ws)) + ")")
    at = ", ".join(f"{x} AS a{k}" for k, x in enumerate(place))
    base = ", ".join(f"CASE WHEN len(a{k}) > 0 THEN '{x}' END" for k, x in enumerate(PHRASES.values()))
    values = ", ".join(f"('{k}', list_distinct(string_split('{v}', ' ')), {MUST.get(k, '').split()}::VARCHAR[])" for k, v in templates.items())
    return f"""
WITH t(label, own, must) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, text, {words_of.format('text')} AS w FROM documents),
blocks AS (SELECT r, w, unnest(range(0, greatest(ceil(len(w) / {BLOCK // 2}) - 1, 1)::BIGINT)) AS k FROM d),
sets AS (SELECT r, list_distinct(list_slice(w, k * {BLOCK // 2} + 1, k * {BLOCK // 2} + {BLOCK})) AS s FROM blocks),
hits AS (SELECT r, label, len(list_intersect(s, own)) / len(own) AS c FROM sets, t WHERE {down} * len(list_intersect(s, own)) >= {up} * len(own) AND len(list_intersect(s, must)) = len(must)),
best AS (SELECT r, list(DISTINCT label) AS m, max(c) AS c FROM hits GROUP BY r),
p AS (SELECT r, doc_id, len(w) AS n_words, {at} FROM d),
q AS (SELECT r, doc_id, n_words, list_concat(list_concat(a0, a1), list_concat(a2, a3)) AS places, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM p)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(m, [])))), ',') AS labels,
  CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
FROM q LEFT JOIN best USING (r)"""
