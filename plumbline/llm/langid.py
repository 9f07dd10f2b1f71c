"""Language identification: words first, then ever shorter character n-grams.

A word known from training adds its log frequency in each language. An unseen word is read through
its letters: at each place the longest known n-gram counts (4 letters down to 1), and the word adds
the mean of their log frequencies. Counts are Spark aggregations over a bounded sample of documents with a
language (`SAMPLE_DOCS`, chosen by a hash of doc_id); the model keeps the `KEEP` commonest words and
n-grams of each length. Every row is predicted from its whole text.

Rows: a null text or one without letters gives `und` and score 0; null languages are never learned;
repeated rows are predicted alike; ties go to the language that sorts first; with nothing to learn from
every row is `und`; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: Most documents that training sees.
SAMPLE_DOCS = 20_000
#: Entries of each table of the model: words, and n-grams of each length.
KEEP = 40_000
LONGEST = 4
#: Words whose scores a task remembers before it starts afresh.
MEMORY_WORDS = 300_000

_WORD = regex.compile(r"\p{L}+")


def _grams(word: str):
    padded = f" {word} "
    for n in range(1, LONGEST + 1):
        for i in range(len(padded) - n + 1):
            yield n, padded[i : i + n]


@dataclass
class Model:
    langs: list[str]
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]
    memory: dict[str, int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)
    flat_rows: np.ndarray | None = None

    def __post_init__(self):
        self.place = {g: i for i, g in enumerate(self.grams)}
        self.table = np.array([*self.grams.values()]) if self.grams else np.zeros((0, len(self.langs)))

    def unseen(self, words: list[str]) -> np.ndarray:
        """Scores of words by the longest known n-gram at each place, all words at once."""
        get, flat, counts = self.place.get, [], []
        for word in words:
            padded, before = f" {word} ", len(flat)
            n = len(padded)
            for i in range(n):
                for k in range(min(LONGEST, n - i), 0, -1):
                    j = get(padded[i : i + k])
                    if j is not None:
                        flat.append(j)
                        break
            counts.append(len(flat) - before)
        size = np.array(counts)
        out = np.zeros((len(words), len(self.langs)))
        some = np.flatnonzero(size)
        if len(some):  # each word's own sum, so that the words beside it change no digit
            out[some] = np.add.reduceat(self.table[np.array(flat, np.int64)], (np.cumsum(size) - size)[some], axis=0) / size[some][:, None]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        found = [_WORD.findall((t or "").lower()) for t in texts]
        if len(self.memory) > MEMORY_WORDS:
            self.memory, self.rows, self.flat_rows = {}, [], None
        new = [w for w in set().union(*found) if w not in self.memory]
        known = [w for w in new if w in self.words]
        other = [w for w in new if w not in self.words]
        for w in known:
            self.memory[w] = len(self.rows)
            self.rows.append(self.words[w])
        for w, v in zip(other, self.unseen(other) if other else (), strict=True):
            self.memory[w] = len(self.rows)
            self.rows.append(v)
        if self.flat_rows is None or len(self.flat_rows) < len(self.rows):
            fresh = np.array(self.rows[0 if self.flat_rows is None else len(self.flat_rows) :]).reshape(-1, len(self.langs))
            self.flat_rows = fresh if self.flat_rows is None else np.concatenate([self.flat_rows, fresh])
        table = self.flat_rows
        langs, scores = [], []
        for ws in found:
            if not ws:
                langs.append("und")
                scores.append(0.0)
                continue
            z = table[np.fromiter(map(self.memory.__getitem__, ws), np.int64, len(ws))].sum(0) / np.sqrt(len(ws))
            p = np.exp(z - z.max())
            k = int(p.argmax())
            langs.append(self.langs[k])
            scores.append(float(p[k] / p.sum()))
        return langs, scores


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, keep: int = KEEP) -> Model:
    """Learns from the rows of docs that have text and lang."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    ids = own.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = own.join(F.broadcast(ids), "doc_id").select("lang", "text")

    def count(batches):
        for batch in batches:
            tally: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                for w, n in Counter(_WORD.findall(text.as_py().lower())).items():
                    tally[lang, 0, w] += n
                    for size, g in _grams(w):
                        tally[lang, size, g] += n
            keys = [*tally]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array([*tally.values()], pa.int64())], names=["lang", "size", "gram", "n"])

    counts = materialize(sample.mapInArrow(count, "lang string, size int, gram string, n bigint").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {(r.lang, r.size): r.n for r in counts.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({k[0] for k in totals})
    sums = counts.groupBy("size", "gram").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("per")).where("n >= 2")
    sums = materialize(sums, "sums")
    parts = [sums.where(F.col("size") == k).orderBy(F.desc("n"), "gram").limit(keep) for k in range(LONGEST + 1)]
    best = reduce(DataFrame.unionByName, parts)
    words, grams = {}, {}
    for r in best.select("size", "gram", "per").collect():  # at most keep * (LONGEST + 1) rows
        v = np.array([np.log((r.per.get(x, 0) + 0.1) / (totals.get((x, r.size), 0) + 0.1 * keep)) for x in langs])
        (grams if r.size else words)[r.gram] = v
    return Model(langs, words, grams)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, lang_pred and score (which replace columns of those names)."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    fixed = docs.sparkSession.sparkContext.broadcast((model.langs, model.words, model.grams))

    def rows(batches):
        mine = Model(*fixed.value)
        for batch in batches:
            texts, lo, size = [], 0, 0
            for i, t in enumerate(batch.column("text")):
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size < 500_000 and i + 1 < batch.num_rows:
                    continue
                langs, scores = mine.predict(texts)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, len(texts)) for c in own), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*own, "lang_pred", "score"])
                texts, lo, size = [], i + 1, 0

    return docs.select(*own).mapInArrow(rows, docs.select(*own).schema.add("lang_pred", "string").add("score", "double"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learns from rows whose crc32(doc_id) mod 5 is not 0, predicts every row."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = fit(docs.where(~held))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = predict(own, model).withColumn("held_out", F.coalesce(held, F.lit(False)))
    return named.select("doc_id", "held_out", "lang_pred", "score")
