"""Secret scans by a linear-chain conditional random field.

Tokens are runs of [A-Za-z0-9+/_.-] and non-ASCII bytes, or single other characters; white space parts
them. Each is tagged as outside, begin or inside of a secret from its shape (length and kinds of
characters), its mixture of digits and letters, how often the kind changes within it (random strings change
often, words and numbers seldom), the shapes and hashed words beside it, and features of its file (how much of it is digits
and assignment signs). The field is trained here, by the log likelihood, on windows of tokens round a
bounded sample of distinct lines (`SAMPLE_LINES`; long lines in pieces) that the base patterns label, with
features of the whole document as in decoding. Half of the windows hide what stands beside tokens, half their own shapes. Viterbi decoding is exact: a token whose outside score
leads by more than any two transitions can make up is outside on every best path, so paths are
computed for the runs between such tokens, all runs of a slice of texts at once.

Base patterns (assign, access, hex) are reported as they match; decoded spans that touch none of
them are added as kind `crf`.

Rows: null is empty and has no spans; repeated rows are scanned alike; without any base match there
is nothing to learn and only base spans are reported; extra columns are ignored. Offsets are code
points, ends exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import materialize
from .textbytes import LOWER, SLICE_BYTES, text_slices, word_hashes

# The base patterns of the contract, as (kind, pattern, group that must be long, its least length).
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")

#: Lines that training sees: half with a base match, half without, and the most tokens of one.
SAMPLE_LINES, LINE_TOKENS = 2000, 48
WORD_BUCKETS = 4096
OUT, BEGIN, INSIDE = 0, 1, 2

_KIND = np.zeros(256, np.uint8)  # 0 white space, 1 token character, 2 a token by itself
_KIND[:] = 2
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_.-", *range(0x80, 0x100)]] = 1
_CLASS = np.zeros((256, 5), bool)  # digit, upper, lower, lower hex letter, other
_CLASS[0x30:0x3A, 0] = _CLASS[0x41:0x5B, 1] = _CLASS[0x61:0x7B, 2] = _CLASS[0x61:0x67, 3] = True
_CLASS[:, 4] = ~_CLASS[:, :3].any(1)

SHAPES = 6 * 16 + 1  # length range by kinds of characters; the last stands for no token
#: Starts of the feature groups: own, previous and next shape, two words before, one after, file, own mixture (length range by
#: digits among letters), own changes of kind (how many between digits, upper and lower letters, by length from 16).
GROUPS = np.cumsum([0, SHAPES, SHAPES, SHAPES, WORD_BUCKETS + 1, WORD_BUCKETS + 1, WORD_BUCKETS + 1, 16, 12])
N_FEATURES = int(GROUPS[-1]) + 12
#: Groups that training hides in some windows, their sizes, and what stands for a hidden feature of each.
HIDEABLE = {0: SHAPES - 1, 1: SHAPES, 2: SHAPES, 3: WORD_BUCKETS, 4: WORD_BUCKETS, 5: WORD_BUCKETS}
HIDDEN = {g: N_FEATURES + k for k, g in enumerate(HIDEABLE)}
#: Long tokens of four changes or more. Where the base patterns do not label them they may be secrets of other forms, so
#: windows are cut there.
_RANDOM = GROUPS[-1] + np.array([7, 9, 11])
#: What the sample is drawn from: lines, long ones in pieces. The same in both languages.
_PIECE, _PIECE_JAVA = re.compile("[^\n]{1,4000}"), "[^\n]{1,4000}"


def base_spans(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, order of kind, kind, end, start of the secret itself) by start, then kind."""
    out = []
    for k, (kind, pattern, group, least) in enumerate(BASE):
        # runs of hex digits: only long ones can pass, and a run's match is the run
        for m in (_LONG_HEX if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), k, kind, m.end(), m.start(group)))
    return sorted(out)


def tokens(buf: np.ndarray, offsets: np.ndarray):
    """Start, end, text number and feature indices (tokens by groups) over the bytes of a slice."""
    kind = _KIND[buf]
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = kind > 0
    begins = inside.copy()
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2) | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= (kind[1:] != kind[:-1]) | (kind[:-1] == 2) | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    upto = np.zeros(n + 1, np.int32)  # one kind at a time: memory stays at a few bytes for each byte of text
    found = []
    for k in range(5):
        np.cumsum(_CLASS[buf, k], out=upto[1:])
        found.append(upto[end] - upto[start])
        if k == 0:
            digits_at = upto[offsets].astype(np.int64)
    digits, upper, lower, hexes, other = found
    size = end - start
    band = np.searchsorted([2, 6, 12, 20, 32], size, side="right")
    letters = upper + lower
    form = (digits > 0) * 1 + (upper > 0) * 2 + (lower > 0) * 4 + ((other > 0) | ((letters == hexes) & (digits > 0) & (letters > 0) & (upper == 0))) * 8
    shape = band * 16 + form
    changed = np.zeros(n + 1, np.int32)
    kinds = _CLASS[buf, 0] + np.uint8(2) * _CLASS[buf, 1] + np.uint8(3) * _CLASS[buf, 2]
    np.cumsum((kinds[1:] != kinds[:-1]) & (kinds[1:] > 0) & (kinds[:-1] > 0), out=changed[2:]) if n > 1 else None
    changes = np.searchsorted([1, 2, 4, 7, 12], changed[end] - changed[np.minimum(start + 1, n)], side="right")
    change = changes * 2 + (size >= 16)
    word = (word_hashes(LOWER[buf], start, end) % np.uint64(WORD_BUCKETS)).astype(np.int64) if n else np.zeros(0, np.int64)

    def moved(x, by, fill):
        out = np.full(len(x), fill)
        src = np.arange(len(x)) + by
        ok = (src >= 0) & (src < len(x))
        ok[ok] &= text[src[ok]] == text[ok]
        out[ok] = x[src[ok]]
        return out

    m = len(offsets) - 1
    np.cumsum((buf == 0x3D) | (buf == 0x3A), out=upto[1:])
    signs = upto[offsets].astype(np.int64)
    share = (np.diff(digits_at) * 20 // np.maximum(1, np.diff(offsets))).clip(0, 3)
    file = share * 4 + (np.diff(signs) * 200 // np.maximum(1, np.diff(offsets))).clip(0, 3) if m else np.zeros(0, np.int64)
    none = SHAPES - 1
    features = np.stack([shape, moved(shape, -1, none), moved(shape, 1, none), moved(word, -1, WORD_BUCKETS), moved(word, -2, WORD_BUCKETS), moved(word, 1, WORD_BUCKETS), file[text], band * 2 + ((digits > 0) & (letters > 0)), change], 1) + GROUPS
    return start, end, text, features


@dataclass
class Field:
    weights: np.ndarray  # features by labels
    moves: np.ndarray  # label by next label

    def decode(self, features: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The best label of every token."""
        scores = self.weights[features[:, 0]]
        for g in range(1, features.shape[1]):  # group by group, so that no tokens x groups x labels array is made
            scores += self.weights[features[:, g]]
        labels = np.zeros(len(scores), np.int8)
        lead = scores[:, OUT] - scores[:, 1:].max(1)
        open_ = lead <= 2 * (self.moves.max() - self.moves.min()) + 1e-6
        at = np.flatnonzero(open_)
        if not len(at):
            return labels
        cut = np.ones(len(at), bool)
        cut[1:] = (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])
        first = at[cut]
        size = np.diff(np.concatenate([np.flatnonzero(cut), [len(at)]]))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        before = (first > 0) & (text[first - 1] == text[first])  # the token before is outside
        best = scores[first] + np.where(before[:, None], self.moves[OUT], 0)
        back = []
        for t in range(1, int(size[0])):
            live = int(np.searchsorted(-size, -t))
            step = best[:live, :, None] + self.moves
            back.append(step.argmax(1).astype(np.int8))
            best[:live] = step.max(1) + scores[first[:live] + t]
        last = first + size - 1
        after = (last + 1 < len(text)) & (text[np.minimum(last + 1, len(text) - 1)] == text[last])
        now = (best + np.where(after[:, None], self.moves[:, OUT], 0)).argmax(1)
        for t in range(int(size[0]) - 1, -1, -1):
            live = int(np.searchsorted(-size, -t))
            labels[first[:live] + t] = now[:live]
            if t:
                now[:live] = back[t - 1][np.arange(live), now[:live]]
        return labels


def minimise(loss, x: np.ndarray, steps: int, keep: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; loss gives value and gradient."""
    value, grad = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, alphas = -grad, []
        for s, y in reversed(past):
            alphas.append(s @ d / (s @ y))
            d = d - alphas[-1] * y
        d = d * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(grad).sum()))
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            d = d + s * (a - y @ d / (s @ y))
        slope, size = grad @ d, 1.0
        for _ in range(20):
            new, new_grad = loss(x + size * d)
            if new <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            return x
        s, y = size * d, new_grad - grad
        if s @ y > 1e-12:
            past = [*past[1 - keep :], (s, y)]
        x, fell, value, grad = x + s, value - new, new, new_grad
        if fell < 1e-6 * max(1.0, abs(value)):
            return x
    return x


def likelihood(lines: list[tuple[np.ndarray, np.ndarray]], decay: float):
    """The features in use, and a function from weights (features by labels, then label by next label) to the mean negative
    log likelihood of labelled lines with its squared penalty, and the gradient."""
    n, width = len(lines), max(len(y) for _, y in lines)
    x = np.zeros((n, width, len(GROUPS)), np.int64)
    y = np.zeros((n, width), np.int64)
    mask = np.zeros((n, width), bool)
    for i, (f, lab) in enumerate(lines):
        x[i, : len(lab)], y[i, : len(lab)], mask[i, : len(lab)] = f, lab, True
    used, flat = np.unique(x[mask], return_inverse=True)
    flat = flat.reshape(-1, len(GROUPS))
    gold_w, gold_m = np.zeros((len(used), 3)), np.zeros((3, 3))
    np.add.at(gold_w, flat.ravel(), np.repeat(np.eye(3)[y[mask]], len(GROUPS), 0))
    both = mask[:, 1:]
    np.add.at(gold_m, (y[:, :-1][both], y[:, 1:][both]), 1)
    gold = np.concatenate([gold_w.ravel(), gold_m.ravel()])
    def lse(a, axis):
        top = a.max(axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)

    def loss(x_):
        w, m = x_[:-9].reshape(-1, 3), x_[-9:].reshape(3, 3)
        e = np.zeros((n, width, 3))
        e[mask] = w[flat].sum(1)
        alpha, beta = np.zeros((n, width, 3)), np.zeros((n, width, 3))
        alpha[:, 0] = e[:, 0]
        for k in range(1, width):
            on = mask[:, k, None]
            alpha[:, k] = np.where(on, lse(alpha[:, k - 1, :, None] + m, 1) + e[:, k], alpha[:, k - 1])
        for k in range(width - 2, -1, -1):
            on = mask[:, k + 1, None]
            beta[:, k] = np.where(on, lse(m + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2), 0)
        z = lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None])
        grad_w = np.stack([np.bincount(flat.ravel(), np.repeat(p[mask][:, lab], len(GROUPS)), len(used)) for lab in range(3)], 1)
        pair = np.exp(alpha[:, :-1, :, None] + m + (e + beta)[:, 1:, None, :] - z[:, None, None, None])
        got = np.concatenate([grad_w.ravel(), pair[both].sum(0).ravel()])
        return (z.sum() - gold @ x_) / n + decay / 2 * (x_ @ x_), (got - gold) / n + decay * x_

    return used, loss


def train(lines: list[tuple[np.ndarray, np.ndarray]], steps: int = 80, decay: float = 1e-5) -> Field:
    """The field that maximises the penalised likelihood of labelled lines (features, labels); deterministic."""
    used, loss = likelihood(lines, decay)
    best = minimise(loss, np.zeros(3 * len(used) + 9), steps)
    w, m = best[:-9].reshape(-1, 3), best[-9:].reshape(3, 3)
    full = np.zeros((N_FEATURES + len(HIDDEN), 3))
    full[used] = w
    known = np.isin(np.arange(N_FEATURES), used)
    for g, size in HIDEABLE.items():  # what no window holds weighs as what was hidden
        own = GROUPS[g] + np.arange(size)
        full[own[~known[own]]] = full[HIDDEN[g]]
    return Field(full[:N_FEATURES], m)


def _labelled(text: str):
    """Byte places, features and labels of a document's tokens, by the base patterns."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    start, end, _, features = tokens(data, np.array([0, len(data)]))
    labels = np.zeros(len(start), np.int64)
    at_byte = _byte_places(text, raw)
    for _, _, _, e, secret in base_spans(text):
        lo, hi = np.searchsorted(start, at_byte(secret)), np.searchsorted(end, at_byte(e), side="right")
        if hi > lo:
            part = labels[lo:hi]
            part[part == OUT] = INSIDE
            if part[0] == INSIDE:
                part[0] = BEGIN
    return start, features, labels


def _byte_places(text: str, raw: bytes):
    """A function from places in code points to places in bytes."""
    if len(raw) == len(text):
        return lambda k: k
    data = np.frombuffer(raw, np.uint8)
    first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(raw))
    return lambda k: int(first[k])


def _windows(text: str, picks: list[tuple[int, int]]):
    """(hash, features, labels) of LINE_TOKENS tokens round each picked piece's hit, or a place by hash; picks: (hash, number of the piece)."""
    start, features, labels = _labelled(text)
    at_byte = _byte_places(text, text.encode())
    wanted = {}
    for h, pos in picks:
        wanted.setdefault(pos, []).append(h)
    for pos, m in enumerate(_PIECE.finditer(text)):
        for h in wanted.get(pos, ()):
            lo, hi = np.searchsorted(start, [at_byte(m.start()), at_byte(m.end())])
            if hi > lo:
                hits = lo + np.flatnonzero(labels[lo:hi] == BEGIN)
                centre = int(hits[h % len(hits)]) if len(hits) else int(lo + h % (hi - lo))
                a = max(0, centre - LINE_TOKENS // 2)
                yield h, features[a : a + LINE_TOKENS], labels[a : a + LINE_TOKENS]


def _sure_parts(features: np.ndarray, labels: np.ndarray):
    """What stands between the tokens of a window that look random but have no label."""
    doubt = np.flatnonzero((labels == OUT) & np.isin(features[:, -1], _RANDOM))
    for a, z in zip([0, *doubt + 1], [*doubt, len(labels)], strict=True):
        if z > a:
            yield features[a:z], labels[a:z]


def _hide(features: np.ndarray, k: int) -> np.ndarray:
    """In the second and fourth of every four windows the words and shapes beside each token are hidden, in the third and
    fourth its shape, so that neighbours, mixture and changes carry over to keys and shapes that training never saw."""
    out = features.copy()
    for g in (1, 2, 3, 4, 5) if k % 2 else ():
        out[:, g] = HIDDEN[g]
    if k % 4 > 1:
        out[:, 0] = HIDDEN[0]
    return out


def _least(pieces: DataFrame, cond, most: int) -> DataFrame:
    """(h, doc, pos) of the distinct pieces under cond of least hash, `most` of them or all, each at one of its places.
    Only hashes below a bound are grouped; a bound below which too few lie is raised, so little is shuffled and the result exact."""
    for bits in (10, 5, 0):
        part = pieces.where(F.col("h") < F.lit(2 ** (64 - bits) - 2**63)) if bits else pieces
        found = part.where(cond).groupBy("h").agg(F.min(F.struct("doc", "pos")).alias("at")).orderBy("h").limit(most)
        found = materialize(found.select("h", "at.doc", "at.pos"), "least")
        if bits == 0 or found.count() == most:
            return found


def training_windows(docs: DataFrame, sample_lines: int = SAMPLE_LINES) -> DataFrame:
    """(h, x, y) of a bounded sample of distinct pieces of lines, half of them with a base match: features in their whole document, and labels."""
    own = docs.select(F.col("text").cast("string").alias("text")).select("text", F.xxhash64("text").alias("doc"))
    pieces = own.select("doc", F.posexplode(F.regexp_extract_all("text", F.lit(_PIECE_JAVA), F.lit(0))).alias("pos", "line")).withColumn("h", F.xxhash64("line"))
    hint = F.col("line").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]") | F.col("line").rlike(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    halves = [_least(pieces, c, sample_lines // 2) for c in (hint, ~hint)]
    picks = halves[0].unionByName(halves[1]).groupBy("doc").agg(F.collect_list(F.struct("h", "pos")).alias("picks"))
    texts = own.join(F.broadcast(picks), "doc").dropDuplicates(["doc"]).select("text", "picks")

    def cut(batches):
        for batch in batches:
            for text, picks in zip(batch.column("text"), batch.column("picks"), strict=True):
                found = list(_windows(text.as_py(), [(p["h"], p["pos"]) for p in picks.as_py()]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([h for h, _, _ in found], pa.int64()), pa.array([x.astype(np.int32).tobytes() for _, x, _ in found], pa.binary()), pa.array([y.astype(np.int8).tobytes() for _, _, y in found], pa.binary())], names=["h", "x", "y"])

    return materialize(texts.mapInArrow(cut, "h bigint, x binary, y binary"), "windows")


def fit(docs: DataFrame, sample_lines: int = SAMPLE_LINES) -> Field | None:
    """Learns from training_windows, without their random-looking tokens that have no label; None if there is no match.
    Windows hide features as _hide says."""
    sample = training_windows(docs, sample_lines)

    def learn(batches):
        rows = []
        for batch in batches:
            for h, x, y in zip(*(batch.column(c).to_pylist() for c in ("h", "x", "y")), strict=True):
                rows.append((h, np.frombuffer(x, np.int32).reshape(-1, len(GROUPS)).astype(np.int64), np.frombuffer(y, np.int8).astype(np.int64)))
        rows.sort(key=lambda r: r[0])
        parts = [part for _, x, y in rows for part in _sure_parts(x, y)]
        hits, rest = [(x, y) for x, y in parts if y.any()], [(x, y) for x, y in parts if not y.any()]
        turns = max(1, len(rest) // max(1, len(hits)))  # as many hits as others, in all ways of hiding
        rows = [(_hide(x, k + t), y) for part, n in ((hits, turns), (rest, 1)) for t in range(n) for k, (x, y) in enumerate(part)]
        if any(y.any() for _, y in rows):
            field = train(rows)
            used = np.flatnonzero(field.weights.any(1))
            yield pa.RecordBatch.from_arrays([pa.array([used.tolist()], pa.list_(pa.int32())), pa.array([field.weights[used].ravel().tolist()], pa.list_(pa.float64())), pa.array([field.moves.ravel().tolist()], pa.list_(pa.float64()))], names=["used", "w", "m"])

    model = sample.coalesce(1).mapInArrow(learn, "used array<int>, w array<double>, m array<double>").first()
    if model is None:
        return None
    weights = np.zeros((N_FEATURES, 3))
    weights[model.used] = np.array(model.w).reshape(-1, 3)
    return Field(weights, np.array(model.m).reshape(3, 3))


_SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))


def _located(batch, field: Field | None, limit: int = SLICE_BYTES):
    """Yields (first row, row count, texts, sorted spans of each as (start, order of kind, kind, end)) of slices of a batch."""
    for lo, n, buf, offsets in text_slices(batch.column("text"), limit):
        found = []
        texts = [t.as_py() or "" for t in batch.column("text").slice(lo, n)]
        for t in texts:
            found.append([(s, k, kind, e) for s, k, kind, e, _ in base_spans(t)])
        if field is not None and len(buf):
            start, end, text, features = tokens(buf, offsets)
            labels = field.decode(features, text)
            s, e, d = _chunks(labels, start, end, text)
            points = np.zeros(len(buf) + 1, np.int32)  # code points before each byte
            np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
            first = points[offsets[d]]
            for doc, a, z in _apart(d, points[s] - first, points[e] - first, found):
                found[doc].append((a, 3, "crf", z))
        yield lo, n, texts, [sorted(x) for x in found]


def _apart(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: list[list[tuple]]):
    """Yields (doc, start, end) of the spans, given by doc, that touch no base span of their doc; base spans lie by start."""
    edges = np.searchsorted(docs, np.arange(len(base) + 1))
    for doc in np.unique(docs):
        own = slice(edges[doc], edges[doc + 1])
        a, z = starts[own], ends[own]
        if base[doc]:
            reach = np.maximum.accumulate([y for _, _, _, y in base[doc]])
            before = np.searchsorted([x for x, _, _, _ in base[doc]], z)  # base spans that start before the end
            free = (before == 0) | (reach[before - 1] <= a)
            a, z = a[free], z[free]
        yield from ((int(doc), x, y) for x, y in zip(a.tolist(), z.tolist(), strict=True))


def find(docs: DataFrame, field: Field | None, name: str = "spans") -> DataFrame:
    """All columns of docs and the spans under a name (which replaces a column of that name): base spans, and decoded ones that touch none of them."""
    own = [c for c in docs.columns if c != name]

    def rows(batches):
        for batch in batches:
            for lo, n, _, found in _located(batch, field):
                spans = [[{"kind": k, "start": s, "end": e} for s, _, k, e in x] for x in found]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, n) for c in own), pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))], names=[*own, name])

    return docs.select(*own).mapInArrow(rows, docs.select(*own).schema.add(name, _SPANS))


def _chunks(labels, start, end, text):
    """Starts and ends in bytes, and texts, of the runs begin, inside, inside ..."""
    at = np.flatnonzero(labels)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (labels[at[1:]] == BEGIN) | (text[at[1:]] != text[at[:-1]])
    k = np.flatnonzero(new)
    return start[at[k]], end[at[np.concatenate([k[1:], [len(at)]]) - 1]], text[at[k]]


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: trains and scans every row."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = find(own, fit(docs)).select("doc_id", "spans")
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"))


def redact(docs: DataFrame, field: Field | None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span of text replaced by mark; all columns stay. Spans are found and replaced by one worker, a quarter of the usual slice at once."""
    own = docs.columns

    def rows(batches):
        for batch in batches:
            for lo, n, texts, found in _located(batch, field, SLICE_BYTES // 4):
                clean = []
                for text, spans, known in zip(texts, found, batch.column("text").slice(lo, n).is_valid().to_pylist(), strict=True):
                    out, at = [], 0
                    for start, _, _, end in spans:
                        if end > at:
                            out += [text[at:start], mark] if start >= at else []
                            at = end
                    clean.append("".join([*out, text[at:]]) if known else None)
                yield pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if c == "text" else batch.column(c).slice(lo, n) for c in own], names=own)

    return docs.mapInArrow(rows, docs.schema)
