"""Byte-pair encoding and decoding by speculate and verify.

Speculate: a word is cut greedily into the longest tokens of the vocabulary. Verify: such a cut is
what merging would give if and only if every token merges to itself and no merge crosses the border
of two adjacent tokens before both are complete; all distinct adjacent pairs of a slice of texts are
tested at once with array operations. Only words with a failing pair go through exact merging.
Encoded words are remembered by the worker within a fixed number of bytes: what was not used while
one half of the memory filled is forgotten, so common words stay.

The vocabulary's file is named by path; each task opens it once. Special tokens in a text are taken
whole, as the file says. Rows: null is the empty text, which has no tokens; repeated rows and
extra columns change nothing; memory follows the longest text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that each of the two halves of a worker's memory of words may take, and those that a word takes beside its letters and ids.
MEMORY_BYTES, ENTRY_BYTES = 24_000_000, 200
#: Bytes up to which a word's pairs are scanned for the next merge; longer words go by a heap.
SHORT_WORD = 64
#: Characters of text whose words are encoded together.
SLICE_CHARS = 400_000

# The Unicode property White_Space, which the file's `\s` stands for.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
END = "</w>"


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBPE:
    """The vocabulary with its merges as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        ids = model["vocab"]
        specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = np.empty(max([*ids.values(), *specials.values()]) + 1, object)
        for name, i in (ids | specials).items():
            self.names[i] = name
        size = len(self.names)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, z = ids[a], ids[b], ids[a + b]
            if (x, y) not in self.merge:
                self.merge[x, y] = (r, z)
                self.ranks[x, y], self.made[r] = r, z
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z] = x, y, r
        keys = np.array([x * size + y for x, y in self.merge], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merge.values()], np.int64)[order]
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for name, i in ids.items():
            body = name.removesuffix(END)
            (self.final if body != name else self.inner)[bytes(letters[c] for c in body)] = i
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.whole = np.zeros(size, np.int8)  # 1: merges to itself, -1: does not, 0: not tested yet
        self.whole[list(ids.values())] = np.where(self.rank[list(ids.values())] < 0, 1, 0)
        self.body = {i: (b, n) for n, d in ((False, self.inner), (True, self.final)) for b, i in d.items()}
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.special_ids = {k: np.array([v], "<u4").tobytes() for k, v in specials.items()}
        self.word = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE_SPACE}\p{{L}}\p{{N}}]+")
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.used = 0

    def words(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        # each character by itself: no final sigma
        return self.word.findall(text.replace("Σ", "σ").lower())

    def speculate(self, word: bytes) -> list[int]:
        out, i, n = [], 0, len(word)
        while i < n:
            t = self.final.get(word[i:]) if n - i <= self.longest else None
            j = n
            if t is None:
                for j in range(min(n - 1, i + self.longest), i, -1):
                    t = self.inner.get(word[i:j])
                    if t is not None:
                        break
            out.append(t)
            i = j
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border of tokens a and b while both are being built.

        Walks back in time: the younger of the two pieces at the border is taken apart, and each pair of
        pieces met is looked up. A crossing merge happens if it comes before the left piece's own next merge
        and not after the right piece's (equal merges are done from the left)."""
        size, never = len(self.names), np.iinfo(np.int64).max
        a, b = a.copy(), b.copy()
        next_a, next_b = np.full(len(a), never), np.full(len(a), never)
        good, active = np.ones(len(a), bool), np.arange(len(a))
        while len(active):
            x, y = a[active], b[active]
            key = x * size + y
            k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crossing = np.where(self.pair_keys[k] == key, self.pair_ranks[k], never)
            bad = (crossing < next_a[active]) & (crossing <= next_b[active]) & (crossing < never)
            good[active[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            split = ~bad & ((rx >= 0) | (ry >= 0))
            undo_a = split & (rx > ry)
            undo_b = split & ~undo_a
            at = active[undo_a]
            next_a[at], a[at] = rx[undo_a], self.right[x[undo_a]]
            at = active[undo_b]
            next_b[at], b[at] = ry[undo_b], self.left[y[undo_b]]
            active = active[split]
        return good

    def exact(self, word: bytes) -> list[int]:
        """Merges by rank, from the left among equals."""
        n = len(word)
        part = [self.inner[word[i : i + 1]] for i in range(n - 1)] + [self.final[word[-1:]]]
        if n <= SHORT_WORD:
            never = 1 << 40
            get, made = self.ranks.get, self.made
            rank = [get(p, never) for p in zip(part, part[1:], strict=False)]
            while rank:
                r = min(rank)
                if r == never:
                    break
                i = rank.index(r)
                part[i : i + 2] = [made[r]]
                del rank[i]
                if i:
                    rank[i - 1] = get((part[i - 1], part[i]), never)
                if i < len(rank):
                    rank[i] = get((part[i], part[i + 1]), never)
            return part
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*self.merge[p], i) for i, p in enumerate(zip(part, part[1:], strict=False)) if p in self.merge]
        heap = [(r, i, z, part[i], part[i + 1]) for r, z, i in heap]
        heapq.heapify(heap)
        while heap:
            _, i, z, x, y = heapq.heappop(heap)
            j = after[i]
            if part[i] != x or j < 0 or part[j] != y:
                continue
            part[i], part[j] = z, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (p := (part[k], part[after[k]])) in self.merge:
                    r, w = self.merge[p]
                    heapq.heappush(heap, (r, k, w, *p))
        return [t for t in part if t >= 0]

    def learn(self, words: list[str]) -> None:
        """Encodes new words and remembers them."""
        raw = [w.encode() for w in words]
        guess = [self.speculate(b) for b in raw]
        counts = np.array([len(g) for g in guess], np.int64)
        flat = np.array([t for g in guess for t in g], np.int64)
        owner = np.repeat(np.arange(len(words)), counts)
        for t in np.unique(flat[self.whole[flat] == 0]):
            body, last = self.body[int(t)]
            self.whole[t] = 1 if last and self.exact(body) == [t] else self._inner_whole(int(t), body) if not last else -1
        fails = np.zeros(len(words), bool)
        fails[owner[self.whole[flat] < 0]] = True
        near = owner[1:] == owner[:-1]
        a, b = flat[:-1][near], flat[1:][near]
        keys, back = np.unique(a * len(self.names) + b, return_inverse=True)
        good = self.compatible(keys // len(self.names), keys % len(self.names))
        fails[owner[1:][near][~good[back]]] = True
        for i in np.flatnonzero(fails):
            guess[i] = self.exact(raw[i])
        pack = [struct.pack(f"<{len(g)}I", *g) for g in guess]
        self.memory.update(zip(words, pack, strict=True))
        self.used += ENTRY_BYTES * len(words) + 2 * sum(map(len, raw)) + sum(map(len, pack))

    def _inner_whole(self, token: int, body: bytes) -> int:
        """Whether a token that does not end a word merges to itself when nothing follows."""
        stand_in = self.final
        try:
            self.final = self.inner
            return 1 if self.exact(body) == [token] else -1
        finally:
            self.final = stand_in

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        pieces: list[list[str | bytes]] = []
        for text in texts:
            if self.special and self.special.search(text):
                own, at = [], 0
                for m in self.special.finditer(text):
                    own += [*self.words(text[at : m.start()]), self.special_ids[m[0]]]
                    at = m.end()
                pieces.append(own + self.words(text[at:]))
            else:
                pieces.append(self.words(text))
        if self.used > MEMORY_BYTES:
            self.memory, self.older, self.used = {}, self.memory, 0
        memory, older = self.memory, self.older
        seen = {w for w in set().union(*pieces) if w not in memory}
        for w in seen & older.keys():
            memory[w] = older[w]
            self.used += ENTRY_BYTES + 2 * len(w) + len(older[w])
        if new := [w for w in seen if w not in memory and w.__class__ is str]:
            self.learn(new)
        memory.update((w, w) for w in seen if w.__class__ is bytes)  # ids of special tokens
        return [b"".join(map(memory.__getitem__, own)) for own in pieces]

    def decode(self, ids: bytes) -> str:
        """The vocabulary has no decoder: its tokens' names, parted by spaces."""
        return " ".join(self.names[np.frombuffer(ids, "<u4")].tolist())


_loaded: dict[str, WordBPE] = {}


def tokenizer(path: str) -> WordBPE:
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def _slices(texts: pa.Array):
    lo, size = 0, 0
    held: list[str] = []
    for x in texts:
        held.append(x.as_py() or "")
        size += len(held[-1])
        if size >= SLICE_CHARS:
            yield lo, held
            lo, held, size = lo + len(held), [], 0
    if held:
        yield lo, held


def encode(docs: DataFrame, path: str, decoded: str | None = None) -> DataFrame:
    """All columns of docs and ids (array of int), the tokens of text. A column ids or a clashing one is replaced.

    decoded names one more column (string), what the ids stand for: the ids are decoded where they are made, so that a
    vocabulary is held by one Python worker for each task instead of two."""
    added = ["ids"] if decoded is None else ["ids", decoded]
    own = [c for c in docs.columns if c not in added]

    def rows(batches):
        model = tokenizer(path)
        for batch in batches:
            for lo, texts in _slices(batch.column("text")):
                coded = model.encode(texts)
                new = [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in coded], pa.list_(pa.int32()))]
                if decoded is not None:
                    new.append(pa.array([model.decode(x) for x in coded], pa.string()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, len(texts)) for c in own), *new], names=[*own, *added])

    schema = docs.select(*own).schema.add("ids", T.ArrayType(T.IntegerType()))
    return docs.select(*own).mapInArrow(rows, schema if decoded is None else schema.add(decoded, "string"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """All columns of encoded and decoded (string), what its ids stand for."""
    own = [c for c in encoded.columns if c != "decoded"]

    def rows(batches):
        model = tokenizer(path)
        for batch in batches:
            text = [model.decode(np.asarray(x.values if x.is_valid else [], "<u4").tobytes()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(text, pa.string())], names=[*own, "decoded"])

    return encoded.select(*own).mapInArrow(rows, encoded.select(*own).schema.add("decoded", "string"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, then decodes the ids; one row per row of docs."""

    def rows(batches):
        model = tokenizer(path)
        for batch in batches:
            for lo, texts in _slices(batch.column("text")):
                ids = model.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, len(texts)),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(model.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(rows, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
