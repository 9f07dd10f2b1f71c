"""N-gram Jaccard join of documents by a blocked sparse matrix product.

1. One pass over the texts gives each document's set size and a 128-bit signature of its shingle set;
   equal sets form a class, so copies never meet again. The same pass reports shingles that are
   frequent within a task's share; the `MAX_FREQUENT` most frequent go last in the global order of
   shingles (any order is valid, so this only saves work).
2. A second pass emits the first n - ceil(0.75 n) + 1 shingles of each set in that order. Two sets that
   link share many of them. Pairs within short lists are counted, and dropped where the count plus
   what can still follow is below the overlap that both sizes demand; long lists only say which
   classes must stand in the same block, after filters by size and position. Lists of hot shingles are
   dealt to slots and count as long.
3. Classes connected in this way form blocks. A block holds whole rows of the class by shingle
   incidence matrix; large ones are cut into tiles of neighbouring sizes, and only tile pairs whose
   sizes can link are multiplied. The product's overlap counts decide every link; a tile pair returns
   link counts and a spanning forest, never its pairs.

Rows: null, empty and word-free texts have n_shingles 0, link with nothing and are their own
component; repeated rows are rows of their own that link with each other; rows without a doc_id link
by their texts like all others and give no component its id; ties in the order are broken by the
shingle's hash; other columns are ignored. Shingles are told apart by 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .store import materialize
from .textbytes import LOWER, SPACE, mix, ragged, text_slices, word_hashes, word_spans

WORDS = 5
#: A class of equal sets: its 128-bit signature.
CLASS = "struct<a:bigint,b:bigint>"
#: Shingles that stand last in the global order; 1.6 MB for every task.
MAX_FREQUENT = 200_000
#: Percent of a set behind its prefix. Less than the threshold, so that a few common shingles do not make a pair.
REST = 75
#: Lists of up to this many classes give pairs; longer ones give block membership only.
SHORT_LIST = 24
#: Classes and shingles of one tile.
TILE_CLASSES, TILE_SHINGLES = 1024, 1_000_000
#: A shingle is hot if it makes up this part of all, so there are no more hot ones than this; its list is dealt to slots.
HOT_SHARE, SLOTS = 20_000, 64


def shingle_sets(texts: pa.Array, words: int = WORDS):
    """Yields (first row, bounds, hashes): each text's distinct shingles, sorted, one after another."""
    for lo, n, buf, offsets in text_slices(texts):
        low = LOWER[buf]
        start, end, first = word_spans(low, offsets, SPACE)
        h = word_hashes(low, start, end)
        count = np.diff(first)
        size = np.where(count >= words, count - words + 1, 0)
        row, at = ragged(size)
        begin = first[row] + at
        x = np.zeros(len(begin), np.uint64)
        for k in range(words):
            x = mix(x * np.uint64(0x9FB21C651E98DF25) + h[begin + k])
        few = np.flatnonzero((count > 0) & (count < words))
        extra = np.zeros(len(few), np.uint64)
        for k in range(words - 1):
            there = count[few] > k
            extra[there] = mix(extra[there] * np.uint64(0x9FB21C651E98DF25) + h[first[few][there] + k])
        x, row = np.concatenate([x, mix(extra ^ np.uint64(0xA5A5))]), np.concatenate([row, few])
        order = np.lexsort((x, row))
        x, row = x[order], row[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
        x, row = x[new], row[new]
        yield lo, np.searchsorted(row, np.arange(n + 1)), x


def _signatures(bounds: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(v)]) for v in (mix(x ^ np.uint64(0x51ED)), mix(x + np.uint64(0x2545F4914F6CDD1D))))
    n = np.diff(bounds).astype(np.uint64)
    return tuple(mix(s[bounds[1:]] - s[bounds[:-1]] + n).view(np.int64) for s in (a, b))


def _classes(a: np.ndarray, b: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _once(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of each different class (a, b), in the order of classes."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    return order[new]


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, and what tells rows without a doc_id apart."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.withColumn("alike", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)))


def _profile(docs: DataFrame, words: int) -> DataFrame:
    """Rows of kind 0: doc_id, alike, set size and class. Of kind 1: a shingle frequent in this task (alike) and its count."""

    def profile(batches):
        seen, held = [], 0

        def frequent():
            x, n = np.unique(np.concatenate(seen), return_counts=True)
            keep = n >= max(4, len(x) // MAX_FREQUENT)
            k = int(keep.sum())
            none = np.zeros(k, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int8)), pa.nulls(k, pa.int64()), pa.array(x[keep].view(np.int64)), pa.array(n[keep].astype(np.int64)), _classes(none, none)], names=names)

        names = ["kind", "doc_id", "alike", "n", "cls"]
        for batch in batches:
            for lo, bounds, x in shingle_sets(batch.column("text"), words):
                n = len(bounds) - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), *(batch.column(c).slice(lo, n) for c in ("doc_id", "alike")), pa.array(np.diff(bounds)), _classes(*_signatures(bounds, x))], names=names)
                seen.append(x)
                held += len(x)
                if held > 2_000_000:
                    yield frequent()
                    seen, held = [], 0
        if held:
            yield frequent()

    return _texts(docs).mapInArrow(profile, f"kind tinyint, doc_id bigint, alike bigint, n bigint, cls {CLASS}")


def _prefixes(docs: DataFrame, frequent: np.ndarray, rank: np.ndarray, words: int, hot: int) -> DataFrame:
    """(shingle, slot, cls, n, pos) of each set's prefix; a class comes once from each slice of texts. The slot is -1, for
    shingles that stand in `hot` sets or more one of SLOTS, by class."""

    def prefixes(batches):
        for batch in batches:
            for _, bounds, x in shingle_sets(batch.column("text"), words):
                a, b = _signatures(bounds, x)
                n = np.diff(bounds)
                chosen = np.zeros(len(n), bool)
                chosen[_once(a, b)] = True
                chosen &= n > 0
                row, _ = ragged(n)
                weight = np.zeros(len(x), np.int64)
                if len(frequent):
                    k = np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)
                    weight = np.where(frequent[k] == x, rank[k], 0)
                order = np.lexsort((x, weight, row))
                _, at = ragged(n)
                take = chosen[row] & (at < (n - (REST * n + 99) // 100 + 1)[row])
                row, at, s, weight = row[take], at[take], x[order][take], weight[order][take]
                slot = np.where(weight >= hot, a[row].view(np.uint64) % np.uint64(SLOTS), -1).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(slot), _classes(a[row], b[row]), pa.array(n[row].astype(np.int32)), pa.array(at.astype(np.int32))], names=["s", "slot", "cls", "n", "pos"])

    return _texts(docs).mapInArrow(prefixes, f"s bigint, slot tinyint, cls {CLASS}, n int, pos int")


def _candidates(prefixes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose components hold every pair of classes that can link.

    Of two sets the one whose prefix ends first has all common shingles up to there in both prefixes, so
    their overlap is at most the prefixes' common shingles and what lies behind that prefix. A pair's first
    common shingle stands within the first n - ceil(percent n) + 1 of both and, in the smaller set, so early
    that the overlap both sizes demand can still follow."""
    lists = prefixes.repartition("s", "slot").groupBy("s", "slot", "cls").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
    size = F.when(F.col("slot") >= 0, F.lit(SHORT_LIST + 1)).otherwise(F.count("*").over(Window.partitionBy("s", "slot")))
    lists = materialize(lists.withColumn("size", size).where("size > 1").drop("slot"), "lists")
    long = lists.where(F.col("size") > SHORT_LIST)
    hidden = long.groupBy("cls").agg(F.count("*").alias("hidden"))
    short = lists.where(F.col("size") <= SHORT_LIST).groupBy("s").agg(F.collect_list(F.struct("cls", "n", "pos")).alias("of"))
    pairs = (
        short.select("of", F.explode("of").alias("x"))
        .select("x", F.explode(F.filter("of", lambda y: (y["cls"] > F.col("x.cls")) & (100 * y["n"] >= percent * F.col("x.n")) & (100 * F.col("x.n") >= percent * y["n"]))).alias("y"))
        .groupBy(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
        .agg(F.count("*").alias("c"))
    )
    need = f"{percent} * (na + nb)"
    rest = "greatest(({0} * na + 99) div 100 - 1, ({0} * nb + 99) div 100 - 1)".format(REST)
    pairs = pairs.join(hidden.select(F.col("cls").alias("a"), F.col("hidden").alias("ha")), "a", "left").join(hidden.select(F.col("cls").alias("b"), F.col("hidden").alias("hb")), "b", "left")
    pairs = pairs.where(f"{100 + percent} * (c + least(coalesce(ha, 0), coalesce(hb, 0)) + {rest}) >= {need}").select("a", "b")
    # a pair that meets in long lists only needs this many of them, whatever the other's size
    long = long.join(hidden, "cls").where(f"pos < n - ({percent} * n + 99) div 100 + 1")
    enough = f"100 * (hidden + 1) >= ({percent} - {REST}) * n"
    long = long.where(enough).select("s", "cls", "n", F.expr(f"{100 + percent} * (n - pos) >= {2 * percent} * n").alias("index"))
    long = materialize(long, "long")
    # the classes of one size hang on one of them, and that one on the next smaller size: windows see sizes, not classes
    one = long.groupBy("s", "n").agg(F.min(F.when(F.col("index"), F.struct("cls", "n"))).alias("one"))
    upto = Window.partitionBy("s").orderBy("n")
    one = one.withColumn("here", F.last("one", ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    one = one.withColumn("before", F.last("one", ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, -1))).drop("one")
    y = F.when(F.col("here.cls") == F.col("cls"), F.col("before")).otherwise(F.col("here"))
    long = long.join(one, ["s", "n"]).withColumn("y", y).where(f"100 * y.n >= {percent} * n")
    return pairs.union(long.select(F.col("y.cls").alias("a"), F.col("cls").alias("b"))).distinct()


def _tiles(sized: DataFrame) -> DataFrame:
    """sized with the tile of each class in its block: neighbouring sizes stand together, about TILE_CLASSES classes or
    TILE_SHINGLES shingles of them.

    Only (block, n, count) is ranked. Within the classes of one size a place is drawn by hash, so no task ranks a block."""
    counts = sized.groupBy("block", "n").agg(F.count("*").alias("k"))
    before = Window.partitionBy("block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("block", "n", "k", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(c) for c, x in (("classes", F.col("k")), ("shingles", F.col("k") * F.col("n")))))
    place = F.pmod(F.xxhash64("cls"), F.col("k"))
    filled = (F.col("classes") + place) / TILE_CLASSES + (F.col("shingles") + place * F.col("n")) / TILE_SHINGLES
    return sized.join(starts, ["block", "n"]).withColumn("tile", F.floor(filled)).drop("k", "classes", "shingles")


def _links(n, sets, weight, percent, tile_a, tile_b):
    """Links between two tiles (or within one): per class the number of linked documents, and a forest."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, columns, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    a, b = np.flatnonzero(tile_a), np.flatnonzero(tile_b)
    place_a, place_b = np.full(len(sets), -1), np.full(len(sets), -1)
    place_a[a], place_b[b] = np.arange(len(a)), np.arange(len(b))
    overlap = np.zeros((len(a), len(b)), np.float32)
    shared = np.flatnonzero(uses > 1)  # columns that one class alone uses add nothing
    new = np.full(len(values), -1)
    new[shared] = np.arange(len(shared))
    col = new[columns]
    step = max(64, 8_000_000 // max(1, len(a) + len(b)))
    by_col = np.argsort(col, kind="stable")
    col, rows = col[by_col], rows[by_col]
    for lo in range(0, len(shared), step):
        i, j = np.searchsorted(col, [lo, lo + step])
        r, c = rows[i:j], col[i:j] - lo
        width = min(step, len(shared) - lo)
        left, right = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        in_a, in_b = place_a[r] >= 0, place_b[r] >= 0
        left[place_a[r[in_a]], c[in_a]] = 1
        right[place_b[r[in_b]], c[in_b]] = 1
        overlap += left @ right.T
    linked = (100 + percent) * overlap.astype(np.int64) >= percent * (n[a][:, None] + n[b][None, :])
    linked &= a[:, None] != b[None, :]
    same = len(a) == len(b) and (a == b).all()
    partners = np.zeros(len(sets), np.int64)
    partners[a] += linked @ weight[b]
    if not same:
        partners[b] += linked.T @ weight[a]
    label = np.arange(len(sets))
    while True:  # least label by neighbours: at most the forest's depth in rounds
        before = label.copy()
        if linked.size:
            near_a = np.where(linked, label[b][None, :], len(sets)).min(1)
            label[a] = np.minimum(label[a], near_a)
            near_b = np.where(linked, label[a][:, None], len(sets)).min(0)
            label[b] = np.minimum(label[b], near_b)
            label = np.minimum(label, label[label])
        if (label == before).all():
            break
    return partners, label


def _multiply(blocks: DataFrame, words: int, percent: int) -> DataFrame:
    """(cls, other, partners): other is the class's tree neighbour in its tile pair, partners are linked documents."""

    def multiply(block: pa.Table) -> pa.Table:
        a, b, n, weight, tile = (block.column(c).to_numpy() for c in ("a", "b", "n", "weight", "tile"))
        got, sets = [], []
        for _, bounds, x in shingle_sets(block.column("text"), words):
            got.append(_signatures(bounds, x))
            sets += np.split(x, bounds[1:-1])
        # another row may carry the doc_id of a class, or the same row come twice
        fits = np.flatnonzero((np.concatenate([g for g, _ in got]) == a) & (np.concatenate([g for _, g in got]) == b))
        first = fits[_once(a[fits], b[fits])]
        a, b, n, weight, tile, sets = a[first], b[first], n[first].astype(np.int64), weight[first], tile[first], [sets[i] for i in first]
        partners, label = _links(n, sets, weight, percent, tile == block.column("ta")[0].as_py(), tile == block.column("tb")[0].as_py())
        keep, other = partners > 0, label[partners > 0]
        return pa.table({"cls": _classes(a[keep], b[keep]), "other": _classes(a[other], b[other]), "partners": partners[keep]})

    return blocks.groupBy("block", "ta", "tb").applyInArrow(multiply, f"cls {CLASS}, other {CLASS}, partners bigint")


def link_documents(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), n_links (documents linked with): one row per row of docs."""
    profile = materialize(_profile(docs, words), "profile")
    sizes = profile.where("kind = 0").select("doc_id", "alike", "n", "cls")
    classes = sizes.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("alike").alias("alike"), F.first("n").cast("int").alias("n"), F.count("*").alias("weight"))
    classes = materialize(classes.withColumn("alike", F.when(F.col("rep").isNull(), F.col("alike")).otherwise(F.lit(0))), "classes")
    top = profile.where("kind = 1").groupBy(F.col("alike").alias("key")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(MAX_FREQUENT).collect()
    frequent, rank = np.array([r.key for r in top], np.int64).view(np.uint64), np.array([r.n for r in top], np.int64)
    order = np.argsort(frequent)
    hot = (sizes.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE + 1
    edges = _candidates(_prefixes(docs, frequent[order], rank[order], words, hot), percent)
    member = connected_components(edges, "blocks")
    sized = classes.join(member.select(F.col("node").alias("cls"), F.col("root").alias("block")), "cls")
    sized = materialize(_tiles(sized), "tiles")
    span = sized.groupBy("block", "tile").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    x, y = (span.select("block", F.col("tile").alias(t), F.col("lo").alias(f"lo_{t}"), F.col("hi").alias(f"hi_{t}")) for t in ("ta", "tb"))
    pairs = x.join(y, "block").where(f"ta <= tb and 100 * hi_ta >= {percent} * lo_tb").select("block", "ta", "tb")
    own = pairs.withColumn("tile", F.explode(F.array_distinct(F.array("ta", "tb"))))
    wanted = sized.join(own, ["block", "tile"]).groupBy("rep", "alike", "cls", "n", "weight", "block", "tile").agg(F.collect_list(F.struct("ta", "tb")).alias("of"))
    texts = _texts(docs)
    named = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["rep"]) & (texts["alike"] == wanted["alike"]))
    blocks = named.select("cls.a", "cls.b", "n", "weight", "block", "tile", "text", F.expr("inline(of)"))
    found = materialize(_multiply(blocks, words, percent), "links")
    forest = found.where("cls != other").select(F.col("cls").alias("a"), F.col("other").alias("b"))
    root = connected_components(forest, "forest").select(F.col("node").alias("cls"), "root")
    count = found.groupBy("cls").agg(F.sum("partners").alias("partners"))
    whole = classes.join(root, "cls", "left").join(count, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = whole.groupBy("root").agg(F.min("rep").alias("component_id"))
    whole = whole.join(least, "root").select("cls", "component_id", (F.coalesce("partners", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = sizes.where("n > 0").join(whole, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    alone = sizes.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"))
    return out.unionByName(alone)
