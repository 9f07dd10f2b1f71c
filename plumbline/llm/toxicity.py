"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i x_i + sum <v_i, v_j> x_i x_j) over the terms present in a text, so pairs
of terms count beyond their single weights. Terms are the lower-cased words and the pairs of adjacent
words, hashed. Training takes a bounded sample of labelled rows (`SAMPLE_ROWS`, chosen by a hash of
doc_id, both classes alike); Spark counts terms in it and keeps the `FEATURES` that tell the classes
apart best (chi-squared). Among the `CANDIDATES` commonest terms, those join them of which a pair
together tells the classes apart though its terms alone do not (`PAIRS` of them at most). One task fits the
machine on the sample. Scoring runs over all rows, whole texts, with a model of fixed size.

Rows: null and empty texts have no terms and score sigmoid(w0); repeated rows score alike; labels of
unknown documents and null labels are ignored, a document with several labels takes the greatest; with no
labelled rows, or of one class only, the score is the share of toxic labels (0 if none); extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .textbytes import LOWER, NOT_ALNUM, mix, ragged, text_slices, word_hashes, word_spans

#: Most labelled rows that training sees, half of each class where there are as many.
SAMPLE_ROWS = 12_000
#: Terms in the model and its factors for each.
FEATURES, FACTORS = 1024, 8
#: Terms below this chi-squared value are noise.
LEAST_CHI = 12.0
#: Commonest terms of the sample whose pairs are tested, pairs that bring their terms into the model, and the least
#: chi-squared value of a pair: above what the best of half a million pairs of noise reaches.
CANDIDATES, PAIRS, LEAST_PAIR_CHI = 1024, 128, 50.0
#: Terms are hashed to this many values.
BUCKETS = 1 << 22
THRESHOLD = 0.7


def hashed_terms(texts: pa.Array):
    """Yields (first row, row count, text number, term) for words and pairs of adjacent words."""
    for lo, n, buf, offsets in text_slices(texts):
        low = LOWER[buf]
        start, end, first = word_spans(low, offsets, NOT_ALNUM)
        h = word_hashes(low, start, end)
        row, at = ragged(np.diff(first))
        two = np.flatnonzero(at[1:] > 0) + 1
        pair = mix(h[two - 1] * np.uint64(0x9FB21C651E98DF25) + h[two])
        term = (np.concatenate([h, pair]) % np.uint64(BUCKETS)).astype(np.int64)
        yield lo, n, np.concatenate([row, row[two]]), term


@dataclass
class Machine:
    terms: np.ndarray  # sorted
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, n: int, row: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """feature: index into terms; each (row, feature) counts once."""
        if len(row):
            once = np.unique(row * np.int64(len(self.terms)) + feature)
            row, feature = once // len(self.terms), once % len(self.terms)
        z = np.full(n, self.bias)
        np.add.at(z, row, self.weights[feature])
        sums, squares = np.zeros((n, self.factors.shape[1])), np.zeros((n, self.factors.shape[1]))
        np.add.at(sums, row, self.factors[feature])
        np.add.at(squares, row, self.factors[feature] ** 2)
        z += 0.5 * (sums**2 - squares).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[np.ndarray], labels: np.ndarray, n_terms: int, factors: int = FACTORS, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """Full-batch Adam on the log loss, both classes weighing alike; deterministic."""
    x = np.zeros((len(rows), n_terms), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    y = (labels > 0).astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32)
    params = [np.zeros(1, np.float32), np.zeros(n_terms, np.float32), np.random.default_rng(7).normal(0, 0.02, (n_terms, factors)).astype(np.float32)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        b, w, f = params
        s = x @ f
        z = b[0] + x @ w + 0.5 * ((s**2).sum(1) - x @ (f**2).sum(1))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        xg = x.T @ g
        grads = [np.array([g.sum()], np.float32), xg + decay * w, x.T @ (g[:, None] * s) - xg[:, None] * f + decay * f]
        for i, (p, d) in enumerate(zip(params, grads, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.999 * v[i] + 0.001 * d * d
            p -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def joint_terms(rows: list[np.ndarray], labels: np.ndarray, n_terms: int, pairs: int = PAIRS, least: float = LEAST_PAIR_CHI) -> np.ndarray:
    """Terms of the pairs whose presence together, or of one without the other, tells the classes apart by chi-squared,
    twice as well as the better of both terms alone; the best pairs first, `pairs` at most."""
    y = labels > 0
    n, pos = len(y), int(y.sum())
    both, hit = np.zeros((n_terms, n_terms), np.float32), np.zeros((n_terms, n_terms), np.float32)
    for lo in range(0, n, 500):  # rows with both terms, toxic ones among them
        x = np.zeros((min(500, n - lo), n_terms), np.float32)
        for i, r in enumerate(rows[lo : lo + 500]):
            x[i, r] = 1
        both += x.T @ x
        x = x[y[lo : lo + 500]]
        hit += x.T @ x

    def chi(df, toxic):
        miss = toxic * (n - pos) - (df - toxic) * pos
        return miss**2 * n / (np.maximum(df * (n - df), 1) * pos * max(1, n - pos))

    df, toxic = np.diag(both).astype(np.float64), np.diag(hit).astype(np.float64)
    alone = chi(df, toxic)
    found = []
    for lo in range(0, n_terms, 64):
        k = slice(lo, lo + 64)
        exclusive = chi(df[k, None] + df[None, :] - 2 * both[k], toxic[k, None] + toxic[None, :] - 2 * hit[k])
        gain = np.maximum(chi(both[k].astype(np.float64), hit[k].astype(np.float64)), exclusive)
        a, b = np.nonzero((gain >= least) & (gain >= 2 * np.maximum(alone[k, None], alone[None, :])))
        found.append(np.stack([gain[a, b], a + lo, b])[:, a + lo < b])
    gain, a, b = np.concatenate(found, 1) if found else np.zeros((3, 0))
    best = np.lexsort((b, a, -gain))[:pairs]
    return np.unique(np.concatenate([a[best], b[best]])).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, factors: int = FACTORS) -> Machine:
    """Learns from the labelled rows (doc_id, toxic) given."""
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    parts = [own.where(c).orderBy(order, "doc_id").limit(sample_rows // 2) for c in ("toxic > 0", "toxic <= 0")]
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # at most sample_rows ids
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id")
    # one row of each id, that of least hash, so that the sample is bounded where an id stands on many rows
    known = known.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def terms(batches):
        for batch in batches:
            for lo, n, row, term in hashed_terms(batch.column("text")):
                once = np.unique(row * np.int64(BUCKETS) + term)
                bounds = np.searchsorted(once, np.arange(n + 1) * np.int64(BUCKETS)).astype(np.int32)
                of = pa.ListArray.from_arrays(pa.array(bounds), pa.array((once % BUCKETS).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(lo, n), of], names=["toxic", "terms"])

    rows = materialize(known.mapInArrow(terms, "toxic int, terms array<int>"), "sample")
    total = rows.agg(F.count("*").alias("n"), F.sum(F.signum("toxic").cast("int")).alias("pos")).first()
    n, pos = total.n, total.pos or 0
    if not pos or pos == n:
        p = pos / n if n else 0.0
        return Machine(np.zeros(0, np.int64), float(np.log((p + 1e-9) / (1 - p + 1e-9))), np.zeros(0), np.zeros((0, factors)))
    counts = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum(F.signum("toxic").cast("int")).alias("hit")).where("df >= 3")
    counts = materialize(counts, "terms")
    miss = F.col("hit") * (n - pos) - (F.col("df") - F.col("hit")) * pos
    chi = F.pow(miss.cast("double"), 2) / (F.col("df") * F.greatest(n - F.col("df"), F.lit(1)))
    best = counts.withColumn("chi", chi * n / (pos * (n - pos))).where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "term").limit(features)
    chosen = np.sort(np.array([r.term for r in best.collect()], np.int64))
    common = np.sort(np.array([r.term for r in counts.orderBy(F.desc("df"), "term").limit(CANDIDATES).collect()], np.int64))

    pool = np.union1d(chosen, common)  # what any choice can keep; the other terms of a text are dropped as it is read

    def learn(batches):
        found, ys = [], []
        for batch in batches:
            ys += batch.column("toxic").to_pylist()
            found += [np.flatnonzero(np.isin(pool, of.values.to_numpy(), assume_unique=True)).astype(np.int32) for of in batch.column("terms")]
        if not found:
            return
        y = np.array(ys)

        def places(terms):
            at = np.full(len(pool), -1, np.int32)
            at[np.searchsorted(pool, terms)] = np.arange(len(terms))
            return [k[k >= 0] for k in (at[f] for f in found)]

        kept = np.union1d(chosen, common[joint_terms(places(common), y, len(common))]) if len(common) else chosen
        b, w, f = train(places(kept), y, len(kept), factors)
        values = [pa.array([kept.tolist()], pa.list_(pa.int64())), pa.array([b]), pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([f.ravel().tolist()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(values, names=["terms", "b", "w", "f"])

    model = rows.coalesce(1).mapInArrow(learn, "terms array<bigint>, b double, w array<double>, f array<double>").first()
    return Machine(np.array(model.terms, np.int64), model.b, np.array(model.w), np.array(model.f).reshape(len(model.terms), factors))


def score(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """All columns of docs and the score under a name (which replaces a column of that name)."""
    own = [c for c in docs.columns if c != name]

    def rows(batches):
        terms = machine.terms
        slot = np.full(BUCKETS, -1, np.int32)
        slot[terms] = np.arange(len(terms))
        for batch in batches:
            out = [np.zeros(0)]
            for _, n, row, term in hashed_terms(batch.column("text")):
                k = slot[term]
                hit = k >= 0
                out.append(machine.score(n, row[hit], k[hit].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(np.concatenate(out))], names=[*own, name])

    return docs.select(*own).mapInArrow(rows, docs.select(*own).schema.add(name, "double"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: learns from labelled rows whose crc32(doc_id) mod 3 is not 1, scores every row."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    machine = fit(docs, labels.where(~held))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(own, machine)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
