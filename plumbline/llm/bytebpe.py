"""Byte-level byte-pair encoding and decoding by backtracking from longest matches.

The bytes of a piece are written as Latin-1 letters, so an Aho-Corasick automaton of all tokens gives
the longest token that starts at each of them. A piece is cut into longest matches from the left; a
token is kept if it is compatible with the one before it, which holds if the bytes of both merge to
just these two. Otherwise the next shorter token is tried, and where none is left the token before
goes and its end is closed for good. A sequence whose neighbours are all compatible is what merging
by rank gives, and there is one only, so each place is closed at most once: time is linear in the
piece. Compatibility of two tokens is remembered, and so are the pieces met, both within fixed sizes.

The vocabulary's file (base64 token and rank in each line) is named by path; each task opens it once.
It has no special tokens: their names in a text are ordinary text. Rows: null is the empty text,
which has no tokens; repeated rows and extra columns change nothing; a null array of ids decodes to
no bytes; memory follows the longest text.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import WHITE_SPACE
from .bpe import _slices as text_blocks

#: Bytes that each of the two halves of a worker's memory of pieces may take, and those that a piece takes beside its letters and ids.
MEMORY_BYTES, ENTRY_BYTES = 80_000_000, 200
#: Pairs of tokens whose compatibility is remembered before all are forgotten.
MEMORY_PAIRS = 600_000


# Letters and numbers of Unicode versions later than the library's own tables, for which they are neither.
LATER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 "
    "18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 "
    "1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: Joins pieces; no token holds it.
BREAK = "\u0100"


class ByteBPE:
    """A vocabulary of ranked byte strings; pattern says what is encoded by itself."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing}")
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.sizes = [len(t) for t in self.tokens]
        self.shorter = [next((self.ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ranks), -1) for t in self.tokens]
        #: The two tokens that merge to each token in the end, and when; single bytes are there from the start.
        self.left, self.right, self.time = [-1] * size, [-1] * size, [-1] * size
        self.whole = [n == 1 for n in self.sizes]  # whether merging makes the token from its bytes
        self.in_order = all([self._trace(t) for t in range(size) if self.sizes[t] > 1])
        # the library's \s is the property White_Space
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]"))
        self.later = regex.compile("[" + "".join("-".join(chr(int(c, 16)) for c in x.split("-")) for x in LATER.split()) + "]")
        self.pairs: dict[int, bool] = {}
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.used = 0

    def merged(self, raw: bytes, until: int = 1) -> list[int]:
        """Merging by rank, from the left among equals, until so many tokens are left: for one or two tokens' bytes."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        never = len(self.tokens)
        ranks = [self.ranks.get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while len(parts) > until and (least := min(ranks)) < never:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.ranks.get(parts[i - 1] + parts[i], never)
            if i < len(ranks):
                ranks[i] = self.ranks.get(parts[i] + parts[i + 1], never)
        return [self.ranks[p] for p in parts]

    def _trace(self, token: int) -> bool:
        """Notes the last merge of a token; false if merging does not make it, or makes it from a later one."""
        parts = self.merged(self.tokens[token], 2)
        self.whole[token] = len(parts) == 2
        if not self.whole[token] or any(self.sizes[p] > 1 and p > token for p in parts):
            return False
        self.left[token], self.right[token], self.time[token] = *parts, token
        return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b stand side by side in an encoding: no merge crosses their border while they are made.

        Walks back in time: the later of the two pieces at the border is taken apart, and each pair of pieces met is looked
        up. A merge across the border happens if it comes before the left piece's own next one and not after the right's."""
        if not self.in_order:
            return self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        tokens, ranks, time = self.tokens, self.ranks, self.time
        next_a = next_b = never = len(tokens)
        while True:
            crossing = ranks.get(tokens[a] + tokens[b], never)
            if crossing < next_a and crossing <= next_b and crossing < never:
                return False
            if time[a] > time[b]:
                next_a, a = a, self.right[a]
            elif time[b] >= 0:
                next_b, b = b, self.left[b]
            else:
                return True

    def cut(self, raw: bytes, longest: list[int]) -> list[int]:
        """Tokens of raw, whose longest matches are given: backtracking."""
        sizes, shorter, whole, pairs, size, n = self.sizes, self.shorter, self.whole, self.pairs, len(self.tokens), len(raw)
        out: list[int] = []
        closed = bytearray(n + 1)
        at, token, last = 0, longest[0], -1
        while at < n:
            while token >= 0:
                if not closed[at + sizes[token]]:
                    if last < 0:
                        if whole[token]:
                            break
                        token = shorter[token]
                        continue
                    key = last * size + token
                    fits = pairs.get(key)
                    if fits is None:
                        fits = pairs[key] = self.compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += sizes[token]
                last, token = token, longest[at] if at < n else -1
            else:
                closed[at] = 1
                token = out.pop()
                at -= sizes[token]
                last, token = out[-1] if out else -1, shorter[token]
        return out

    def learn(self, pieces: list[str]) -> None:
        """Encodes new pieces and remembers them. Whole tokens are taken as they are, as the library does."""
        if len(self.pairs) > MEMORY_PAIRS:
            self.pairs.clear()
        raw = [p.encode() for p in pieces]
        ids = [self.ranks.get(b) for b in raw]
        rest = [i for i, t in enumerate(ids) if t is None]
        letters = BREAK.join(raw[i].decode("latin-1") for i in rest)
        longest, sizes = [-1] * len(letters), self.sizes
        for end, token in self.automaton.iter(letters):  # by their ends: the last one from a start is the longest
            longest[end - sizes[token] + 1] = token
        at = 0
        for i in rest:
            n = len(raw[i])
            ids[i] = self.cut(raw[i], longest[at : at + n])
            at += n + 1
        for p, b, t in zip(pieces, raw, ids, strict=True):
            self.memory[p] = packed = struct.pack("<I", t) if t.__class__ is int else struct.pack(f"<{len(t)}I", *t)
            self.used += ENTRY_BYTES + 2 * len(b) + len(packed)

    def split_again(self, text: str) -> list[str]:
        """The pieces of a text with letters that the library does not know."""
        plain = self.later.sub("\ue000", text)  # neither letter nor number, of the same length
        return [text[m.start() : m.end()] for m in self.pattern.finditer(plain)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        pieces = [self.pattern.findall(t) for t in texts]
        if self.used > MEMORY_BYTES:
            self.memory, self.older, self.used = {}, self.memory, 0
        memory, older = self.memory, self.older
        seen = {p for p in set().union(*pieces) if p not in memory}
        for p in seen & older.keys():
            memory[p] = older[p]
            self.used += ENTRY_BYTES + 2 * len(p) + len(older[p])
        new = [p for p in seen if p not in memory]
        if later := self.later.search(BREAK.join(new)):
            pieces = [self.split_again(t) if self.later.search(t) else own for t, own in zip(texts, pieces, strict=True)]
            new = [p for p in set().union(*pieces) if p not in memory]
        if new:
            self.learn(new)
        out = [b"".join(map(memory.__getitem__, own)) for own in pieces]
        if later:  # such pieces are not remembered, so that they are seen each time
            for p in new:
                if self.later.search(p):
                    del memory[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[tuple[str, str], ByteBPE] = {}


def tokenizer(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns of docs and ids (array of int), the tokens of text. A column ids is replaced."""
    own = [c for c in docs.columns if c != "ids"]

    def rows(batches):
        model = tokenizer(path, pattern)
        for batch in batches:
            for lo, texts in text_blocks(batch.column("text")):
                ids = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in model.encode(texts)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, len(texts)) for c in own), ids], names=[*own, "ids"])

    return docs.select(*own).mapInArrow(rows, docs.select(*own).schema.add("ids", T.ArrayType(T.IntegerType())))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns of encoded and decoded (binary), the bytes that its ids stand for. A column decoded is replaced."""
    own = [c for c in encoded.columns if c != "decoded"]

    def rows(batches):
        model = tokenizer(path, pattern)
        for batch in batches:
            raw = [model.decode(np.asarray(x.values if x.is_valid else [], "<u4").tobytes()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(raw, pa.binary())], names=[*own, "decoded"])

    return encoded.select(*own).mapInArrow(rows, encoded.select(*own).schema.add("decoded", "binary"))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, then decodes the ids; one row per row of docs."""

    def rows(batches):
        model = tokenizer(path, pattern)
        for batch in batches:
            for lo, texts in text_blocks(batch.column("text")):
                ids = model.encode(texts)
                columns = [
                    batch.column("doc_id").slice(lo, len(texts)),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(model.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(rows, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
