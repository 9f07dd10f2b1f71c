"""Benchmark decontamination with a distributed positional inverted index.

Documents are cut into segments; the index stores, per segment, the positions of every term that
the test items use (of all terms when the items have more than `ROUND_WORDS` words), so a posting list
never spans tasks and a frequent term is spread over all segments. Corpus-wide term counts are a
Spark aggregation over the stored index. Each window of a test item is looked up through its
corpus-rarest term; the list is shifted by the term's offset in the item, intersected with the
shifted lists of the next rarest terms, and what is left is checked against all words of the item.

Rows: null or word-free texts have no words, no hits and are clean; repeated rows are judged one by
one; items without words never match; items with equal text each count; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .textbytes import LOWER, NOT_ALNUM, ragged, text_slices, word_hashes, word_spans

WINDOW = 13
#: Items up to this many words in all are sent to every task; more are handled in several rounds.
ROUND_WORDS = 2_000_000
#: Room left between documents in a segment, so that no window crosses two of them.
GAP = 1 << 10

_INDEX = "segment string, doc_ids array<bigint>, n_words array<int>, bases array<int>, terms array<bigint>, counts array<int>, positions array<int>"
_SEGMENT = pa.schema([("segment", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("bases", pa.list_(pa.int32())), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32()))])


def _words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for lo, _, buf, offsets in text_slices(texts):
        low = LOWER[buf]
        start, end, first = word_spans(low, offsets, NOT_ALNUM)
        yield lo, first, word_hashes(low, start, end).view(np.int64)


def build_index(docs: DataFrame, vocabulary: np.ndarray | None, gap: int = GAP) -> DataFrame:
    """One row per segment: document starts, then the posting lists of its terms one after another.

    vocabulary: sorted hashes of the terms to keep (sent to every task), or None for all terms.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, first, terms in _words(batch.column("text")):
                counts = np.diff(first)
                bases = np.cumsum(counts + gap) - (counts + gap)
                row, at = ragged(counts)
                where = bases[row] + at
                if vocabulary is not None:
                    k = np.searchsorted(vocabulary, terms)
                    keep = vocabulary[np.minimum(k, len(vocabulary) - 1)] == terms if len(vocabulary) else np.zeros(len(terms), bool)
                    terms, where = terms[keep], where[keep]
                order = np.argsort(terms, kind="stable")
                own, sizes = np.unique(terms, return_counts=True)
                one = ids.slice(lo, len(counts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([uuid.uuid4().hex]),
                        pa.array([one.to_pylist()], pa.list_(pa.int64())),
                        *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.int32))) for x in (counts, bases)),
                        pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own)),
                        *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.int32))) for x in (sizes, where[order])),
                    ],
                    schema=_SEGMENT,
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(segments, _INDEX)


def term_counts(index: DataFrame) -> DataFrame:
    """How often each stored term occurs in all documents."""
    return index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("n")).withColumnRenamed("terms", "term")


def _item_words(items: DataFrame) -> DataFrame:
    def rows(batches):
        for batch in batches:
            for lo, first, terms in _words(batch.column("text")):
                out = [terms[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(lo, len(out)), pa.array(out, pa.list_(pa.int64()))], names=["item_id", "words"])

    return items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "item_id string, words array<bigint>")


class Items:
    """The words of a bounded round of test items, as flat arrays, with the rarest term of each window."""

    def __init__(self, ids: list[str], words: list[np.ndarray], window: int):
        self.ids, self.words = ids, [np.asarray(w, np.int64) for w in words]
        self.window = window
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, np.int64)
        self.vocabulary = np.unique(self.flat)

    def choose(self, counts: dict[int, int]) -> None:
        """anchors: (item, offset) of the rarest term of each window, the second rarest beside it."""
        n = np.array([counts.get(int(x), 0) for x in self.flat], np.int64)
        picked: dict[tuple[int, int], set[int]] = {}
        for k, (s, m) in enumerate(zip(self.start, self.length, strict=True)):
            size = min(self.window, m)
            for w in range(m - size + 1) if m else ():
                order = np.argsort(n[s + w : s + w + size], kind="stable") + w
                if n[s + order[0]]:
                    picked.setdefault((k, int(order[0])), set()).add(int(order[min(1, size - 1)]))
        self.anchor = np.array([(k, a, b) for (k, a), bs in sorted(picked.items()) for b in sorted(bs)], np.int64).reshape(-1, 3)
        self.rarest = []  # of each item its three rarest different terms
        for s, m in zip(self.start, self.length, strict=True):
            own, at = np.unique(self.flat[s : s + m], return_index=True)
            self.rarest.append(own[np.lexsort((at, n[s + at]))[:3]])


def _lookup(items: Items, terms, bounds, where, total, window, slop):
    """Hit flags by segment position, (item, position) of whole-window hits, and of near hits."""
    hit = np.zeros(total + 1, np.int32)
    empty = np.zeros(0, np.int64)
    if not len(terms) or not len(items.anchor):
        return hit, empty, empty, empty, empty

    def listed(wanted):
        k = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
        there = terms[k] == wanted
        return np.where(there, bounds[k], 0), np.where(there, bounds[k + 1], 0)

    span = np.int64(total + 1)
    term_no = np.repeat(np.arange(len(terms), dtype=np.int64), np.diff(bounds))
    keys = term_no * span + where  # sorted: by term, then position

    def holds(wanted, at):
        k = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
        key = k * span + at
        i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return (terms[k] == wanted) & (at >= 0) & (at < total) & (keys[i] == key)

    item, a, b = items.anchor.T
    lo, hi = listed(items.flat[items.start[item] + a])
    row, at = ragged(hi - lo)
    begin = where[lo[row] + at] - a[row]  # where the item's first word would stand
    keep = holds(items.flat[items.start[item[row]] + b[row]], begin + b[row])
    item, begin = item[row][keep], begin[keep]
    if len(item):
        pairs = np.unique(np.stack([item, begin], 1), axis=0)
        item, begin = pairs[:, 0], pairs[:, 1]
    row, at = ragged(items.length[item])
    same = holds(items.flat[items.start[item[row]] + at], begin[row] + at)
    first = np.cumsum(items.length[item]) - items.length[item]
    running = np.concatenate([[0], np.cumsum(same)])
    size = np.minimum(items.length[item], window)
    room = items.length[item] - size + 1
    row, at = ragged(room)
    whole = running[first[row] + at + size[row]] - running[first[row] + at] == size[row]
    row, at = row[whole], at[whole]
    np.add.at(hit, begin[row] + at, 1)
    np.add.at(hit, begin[row] + at + size[row], -1)
    near_item, near_at = [], []
    if slop:
        for k, rare in enumerate(items.rarest):
            if len(rare) < 3:
                continue
            lists = [where[x:y] for x, y in zip(*listed(rare), strict=True)]
            if not all(map(len, lists)):
                continue
            p = lists[0]
            ok = np.ones(len(p), bool)
            for other in lists[1:]:
                ok &= np.searchsorted(other, p + slop, side="right") > np.searchsorted(other, p - slop)
            near_item += [k] * int(ok.sum())
            near_at += p[ok].tolist()
    return hit, item[row], begin[row] + at, np.array(near_item, np.int64), np.array(near_at, np.int64)


def _match(index: DataFrame, items: Items, window: int, slop: int) -> DataFrame:
    """Per document of every segment: hit words as ranges, and the items found."""

    def match(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part = {c: batch.column(c)[k] for c in batch.schema.names}
                counts, bases, terms, sizes, where = (part[c].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_words", "bases", "terms", "counts", "positions"))
                total = int(bases[-1] + counts[-1])
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                hit, item, at, near, near_at = _lookup(items, terms, bounds, where, total, window, slop)
                flags = np.cumsum(hit[:-1]) > 0
                found = [[] for _ in counts]
                n_near = np.zeros(len(counts), np.int64)
                for k, d in np.unique(np.stack([item, np.searchsorted(bases, at, side="right") - 1], 1), axis=0) if len(item) else ():
                    found[d].append(items.ids[k])
                if len(near):
                    pairs = np.unique(np.stack([near, np.searchsorted(bases, near_at, side="right") - 1], 1), axis=0)
                    np.add.at(n_near, pairs[:, 1], 1)
                edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
                begins, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                owner = np.searchsorted(bases, begins, side="right") - 1
                spans = [[] for _ in counts]
                for d, x, y in zip(owner, begins - bases[owner], stops - bases[owner], strict=True):
                    spans[d].append((int(x), int(y)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{part['segment']}:{i}" for i in range(len(counts))]),
                        part["doc_ids"].values,
                        pa.array(counts),
                        pa.array(found, pa.list_(pa.string())),
                        pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array(n_near),
                    ],
                    names=["row", "doc_id", "n_words", "items", "hit_spans", "n_near"],
                )

    return index.mapInArrow(match, "row string, doc_id bigint, n_words bigint, items array<string>, hit_spans array<struct<start:int,end:int>>, n_near bigint")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 20, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted), hit_spans (word ranges), n_near, contaminated: one row per document row.

    n_hit counts the document's words inside an exact occurrence of `window` consecutive item words
    (of the whole item if it is shorter). n_near counts items whose three rarest terms stand within
    `slop` words of one another. A document is contaminated if n_hit > 0 and share * n_hit >= n_words.
    """
    words = _item_words(benchmark).where(F.size("words") > 0)
    total = words.agg(F.sum(F.size("words"))).first()[0] or 0
    if total > ROUND_WORDS:
        return _in_rounds(docs, words, total, window, slop, share)
    rows = words.orderBy("item_id").collect()  # at most ROUND_WORDS words
    items = Items([r.item_id for r in rows], [np.array(r.words, np.int64) for r in rows], window)
    index = materialize(build_index(docs, items.vocabulary), "postings")
    items.choose({r.term: r.n for r in term_counts(index).collect()})  # at most ROUND_WORDS terms
    return _judge(_match(index, items, window, slop), share)


def _in_rounds(docs, words, total, window, slop, share):
    """A test set of any size: an index of all terms, looked up for a bounded part of the items at a time."""
    rounds = int(total // ROUND_WORDS) + 1
    index = materialize(build_index(docs, None), "postings")
    counts = materialize(term_counts(index), "terms")
    words = materialize(words.withColumn("round", F.pmod(F.xxhash64("item_id"), F.lit(rounds))), "items")
    parts = []
    for k in range(rounds):
        own = words.where(F.col("round") == k)
        rows = own.orderBy("item_id").collect()
        items = Items([r.item_id for r in rows], [np.array(r.words, np.int64) for r in rows], window)
        used = own.select(F.explode("words").alias("term")).distinct()
        items.choose({r.term: r.n for r in counts.join(used, "term").collect()})
        parts.append(_match(index, items, window, slop))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    merged = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.sum("n_near").alias("n_near"))
    return _judge(merged, share)


def _judge(matched: DataFrame, share: int) -> DataFrame:
    covered = "aggregate(array_sort(hit_spans), named_struct('n', 0L, 'upto', 0), (a, x) -> named_struct('n', a.n + greatest(0, x.end - greatest(a.upto, x.start)), 'upto', greatest(a.upto, x.end)), a -> a.n)"
    return (
        matched.withColumn("n_hit", F.expr(covered))
        .withColumn("items", F.array_sort("items"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))
        .select("doc_id", "n_words", "n_hit", "items", "hit_spans", "n_near", "contaminated")
    )


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        "n_near",
    )
