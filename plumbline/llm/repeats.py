"""Repeated byte strings across documents by common-prefix interval trees over a sparse suffix array.

Anchors: in each window of `length` bytes the leftmost of the least hashed `core`-byte strings is its
anchor, so two equal windows have their anchors at equal places. A run of windows with one anchor
is an occurrence: its context is the run's text. Contexts that occur twice are repeats as a whole.
Contexts that share an anchor string but differ are suffixes of a sparse suffix array: sorted by what
follows the anchor, with the lengths of common prefixes (LCP) of neighbours. A stack scan over the
LCPs gives the common-prefix intervals; within each, the same scan over the texts before the anchor
tests left extension: an interval whose members go on with different bytes on the left is a maximal
repeat, and all its members are its occurrences.

Occurrences are counted by anchor string and context before anything is gathered, so a passage that
everyone holds stands once in a group, and its occurrences join its groups afterwards. Anchor strings
with more than `MAX_GROUP` different contexts are never gathered either: they are re-keyed by longer
pieces of text, halving the range of window offsets, until groups are small or the piece is a whole
window, where equality of keys is the answer. Their keys are named by a broadcast, up to `BROADCAST_KEYS`.

Rows: null is empty; texts shorter than `length` have no repeats; repeated rows repeat each other;
a doc_id that stands on several rows keeps them apart (rows go by 128 bits of doc_id and text); extra
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .textbytes import mix, prefix_hash, ragged, span_hash, text_slices

LENGTH, CORE = 200, 64
#: Bytes of text whose anchors are sought at once.
SLICE = 1 << 19
#: Different contexts of one anchor string that one call sorts.
MAX_GROUP = 512
#: Keys of large groups that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 200_000
#: A key is hot if it holds this part of all occurrences, so there are no more hot ones than this.
HOT_SHARE = 20_000


def _anchors(buf: np.ndarray, offsets: np.ndarray, length: int, core: int):
    """Runs of windows: text number, first and last window start, anchor position, anchor hash, context hash."""
    n = len(buf)
    width = length - core + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none, none
    running = prefix_hash(buf)
    m = n - core + 1
    at = np.arange(m)
    h = mix(span_hash(running, at, at + core))
    # sliding minimum over `width` hashes from block-wise running minima
    blocks = -(-m // width) + 1
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:m] = h
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    back = np.minimum.accumulate(square, axis=1).ravel()
    windows = n - length + 1
    least = np.minimum(ahead[:windows], back[width - 1 : width - 1 + windows])
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:windows]
    inside = np.arange(windows) + length <= offsets[owner + 1]
    # runs of windows that have the same least hash
    turn = np.ones(windows, bool)
    turn[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    begin = np.flatnonzero(turn)
    stop = np.concatenate([begin[1:], [windows]])
    keep = inside[begin]
    begin, stop = begin[keep], stop[keep]
    return owner[begin], begin, stop - 1, h, least[begin], running


def _split_runs(h, least, begin, last, owner, width):
    """Cuts runs where the leftmost anchor moves on to an equal hash; gives each its anchor position."""
    size = last - begin + width  # hashes that the run's windows see
    row, at = ragged(size)
    place = begin[row] + at
    equal = h[place] == least[row]
    row, place = row[equal], place[equal]
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    previous = np.where(first, begin[row] - 1, np.concatenate([[0], place[:-1]]))
    lo = np.maximum(begin[row], previous + 1)
    hi = np.minimum(last[row], place)
    ok = lo <= hi
    return owner[row][ok], lo[ok], hi[ok], place[ok], least[row][ok]


def find_anchors(docs: DataFrame, length: int = LENGTH, core: int = CORE) -> DataFrame:
    """(g, c, occ): anchor hash, context hash, and the places in one slice of texts: row key, context start and end, anchor."""

    def rows(batches):
        for batch in batches:
            ids = batch.column("row")
            for lo_row, _, buf, offsets in text_slices(batch.column("text"), SLICE):
                owner, begin, last, h, least, running = _anchors(buf, offsets, length, core)
                if not len(begin):
                    continue
                owner, begin, last, place, g = _split_runs(h, least, begin, last, owner, length - core + 1)
                c = mix(span_hash(running, begin, last + length) + (place - begin).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
                order = np.lexsort((c, g))
                owner, begin, last, place, g, c = (x[order] for x in (owner, begin, last, place, g, c))
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
                bounds = np.concatenate([np.flatnonzero(new), [len(g)]]).astype(np.int32)
                base = offsets[owner]
                occ = pa.StructArray.from_arrays([ids.take(pa.array(lo_row + owner)), *(pa.array(x.astype(np.int32)) for x in (begin - base, last + length - base, place - base))], names=["row", "a", "z", "p"])
                yield pa.RecordBatch.from_arrays([pa.array(g[new].view(np.int64)), pa.array(c[new].view(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), occ)], names=["g", "c", "occ"])

    return docs.select("row", "text").mapInArrow(rows, "g bigint, c bigint, occ array<struct<row:binary,a:int,z:int,p:int>>")


def intervals(lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """Stack scan: (common length, first, last) of every interval of sorted strings with a common prefix.

    lcp[i] is the common length of strings i - 1 and i (lcp[0] is not used)."""
    out, stack = [], []
    for i in range(1, len(lcp) + 1):
        now = int(lcp[i]) if i < len(lcp) else -1
        first = i - 1
        while stack and stack[-1][0] > now:
            depth, first = stack.pop()
            out.append((depth, first, i - 1))
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, first))
    return out


def _common(matrix: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows x and y."""
    same = matrix[x] == matrix[y]
    whole = same.all(1)
    return np.minimum(np.where(whole, matrix.shape[1], same.argmin(1)), np.minimum(sizes[x], sizes[y]))


def _matrix(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts], np.int64)
    width = max(1, int(sizes.max()))
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width), sizes


def extensions(left: list[bytes], right: list[bytes], length: int):
    """Yields, for each common-prefix interval of what follows the anchor that can hold repeats of `length` bytes,
    (common length, first, last, lcp, members by what stands before the anchor, common lengths of neighbours there, order).

    left is reversed: it starts with the byte before the anchor."""
    order = sorted(range(len(right)), key=right.__getitem__)
    ahead, n_ahead = _matrix([right[i] for i in order])
    behind, n_behind = _matrix([left[i] for i in order])
    n = len(order)
    rank = np.empty(n, np.int64)
    rank[np.lexsort(tuple(behind.T[::-1]))] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    lcp[1:] = _common(ahead, n_ahead, np.arange(n - 1), np.arange(1, n))
    order = np.array(order)
    for depth, first, last in intervals(lcp):
        member = np.arange(first, last + 1)
        member = member[np.argsort(rank[member])]
        ext = np.zeros(len(member) + 1, np.int64)
        ext[1:-1] = _common(behind, n_behind, member[:-1], member[1:])
        if ext.max() + depth >= length:
            yield depth, first, last, lcp, member, ext, order


def maximal_repeats(left: list[bytes], right: list[bytes], length: int):
    """Yields (bytes before the anchor, bytes from it, members) of every maximal repeat of at least `length` bytes."""
    for depth, first, last, lcp, member, ext, order in extensions(left, right, length):
        for reach, i, j in intervals(ext[:-1]):
            group = member[i : j + 1]
            if reach + depth < length:
                continue
            if group.max() - group.min() < last - first and (lcp[group.min() + 1 : group.max() + 1] > depth).all():
                continue  # all go on alike on the right: a deeper interval reports it
            yield reach, depth, order[group]


def _pairs(left: list[bytes], right: list[bytes], length: int):
    """The commonest groups, two contexts each, all at once."""
    ahead, n_ahead = _matrix(right)
    behind, n_behind = _matrix(left)
    x = np.arange(0, len(left), 2)
    r, l = _common(ahead, n_ahead, x, x + 1), _common(behind, n_behind, x, x + 1)
    return x[l + r >= length], l[l + r >= length], r[l + r >= length]


_CONTEXT = ("key", "g", "c", "row", "p", "before", "after")


def context_repeats(contexts: DataFrame, length: int, cover: bool) -> DataFrame:
    """(repeat, g, c, row, p, reach, depth): the members of every maximal repeat of contexts of one key, by how far it
    goes before and after their anchors. cover: one row for each context, with the most of both over its repeats.

    Partitions are sorted by key; a task holds a few groups at a time, each of MAX_GROUP contexts at most."""

    def scan(batches):
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            key = now.column("key").to_numpy()
            first = int(np.flatnonzero(key == key[-1])[0]) if len(key) else 0
            held = now.slice(first)
            yield from groups(now.slice(0, first))
        if held is not None:
            yield from groups(held)

    def groups(part):
        if not part.num_rows:
            return
        key, c = part.column("key").to_numpy(), part.column("c").to_numpy()
        before, after = part.column("before").to_pylist(), part.column("after").to_pylist()
        cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        size = np.diff(cut)
        names, members, reaches, depths = [], [], [], []
        most_before, most_after = np.full(len(key), -1, np.int64), np.full(len(key), -1, np.int64)

        def add(member, reach, depth):
            if cover:
                most_before[member] = np.maximum(most_before[member], reach)
                most_after[member] = np.maximum(most_after[member], depth)
                return
            names.extend([f"{int(key[member[0]]) & (2**64 - 1):016x}-{reach}-{depth}-{int(c[member].min()) & (2**64 - 1):016x}"] * len(member))
            members.extend(member.tolist())
            reaches.extend([reach] * len(member))
            depths.extend([depth] * len(member))

        two = np.flatnonzero(size == 2)
        if len(two):
            take = np.stack([cut[two], cut[two] + 1], 1).ravel()
            for x, reach, depth in zip(*_pairs([before[i] for i in take], [after[i] for i in take], length), strict=True):
                add(take[x : x + 2], int(reach), int(depth))
        for k in np.flatnonzero(size > 2):
            lo, hi = cut[k], cut[k + 1]
            for reach, depth, member in maximal_repeats(before[lo:hi], after[lo:hi], length):
                add(lo + member, reach, depth)
        if cover:
            members = np.flatnonzero(most_before >= 0)
            names, reaches, depths = [""] * len(members), most_before[members], most_after[members]
        own = part.select(["g", "c", "row", "p"]).take(pa.array(members, pa.int64())).combine_chunks()
        columns = [pa.array(names, pa.string()), *(own.column(x).combine_chunks() for x in own.column_names), pa.array(reaches).cast(pa.int32()), pa.array(depths).cast(pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["repeat", "g", "c", "row", "p", "reach", "depth"])

    sorted_contexts = contexts.repartition("key").sortWithinPartitions("key")
    return sorted_contexts.select(*_CONTEXT).mapInArrow(scan, "repeat string, g bigint, c bigint, row binary, p int, reach int, depth int")


def _large_keys(sizes: DataFrame, max_group: int) -> DataFrame:
    """(key) of the groups of more than max_group contexts among (key, k)."""
    keys = materialize(sizes.where(F.col("k") > max_group).select("key"), "large")
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _split_large(large: DataFrame, length: int, core: int, max_group: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Splits groups of more than max_group contexts by longer pieces of text.

    Returns groups fit for one call, and whole windows that more contexts share: (key, g, c, row, p, lo)."""
    large = large.select(*_CONTEXT).withColumn("lo", F.lit(0)).withColumn("hi", F.lit(length - core))
    small = equal = None
    while not large.isEmpty():
        # offsets lo..hi: windows that start that many bytes before the anchor; all contain [p - lo, p - hi + length)
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = large.withColumn("half", F.explode(F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi"))))).where("half.lo <= half.hi")
        halves = halves.withColumn("lo", F.col("half.lo")).withColumn("hi", F.col("half.hi")).drop("half")
        halves = halves.where(f"length(before) >= lo and length(after) >= {length} - hi")
        piece = F.expr(f"concat(substring(before, 1, lo), substring(after, 1, {length} - hi))")
        halves = materialize(halves.withColumn("key", F.xxhash64(F.col("key"), F.col("lo"), F.col("hi"), piece)), "halves")
        keys = _large_keys(halves.groupBy("key").agg(F.count("*").alias("k")), max_group)
        part = halves.join(keys, "key", "left_anti").select(*_CONTEXT)
        large = halves.join(keys, "key", "left_semi")
        same = large.where("lo = hi").select("key", "g", "c", "row", "p", "lo")
        large = large.where("lo < hi")
        small, equal = (part, same) if small is None else (small.unionByName(part), equal.unionByName(same))
    return small, equal


def _keep(found: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of found whose key stands in keys (on, n: occurrences). Hot keys are broadcast, so the rows of a passage that
    many documents hold stay where they are; the rest meet by a shuffle."""
    total = keys.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE >= total
    top = F.broadcast(keys.where(hot).select(*on))
    cold = found.join(top, on, "left_anti").join(keys.where(~hot).select(*on), on, "left_semi")
    return found.join(top, on, "left_semi").unionByName(cold)


def find_repeats(docs: DataFrame, length: int = LENGTH, core: int = CORE, max_group: int = MAX_GROUP, cover: bool = False) -> DataFrame:
    """(repeat, row, start, end) in bytes: every maximal group with all its occurrences.

    A repeat that is longer than the windows of one anchor comes as one group for each of its anchors; together
    they cover it. Groups of anchors with more than max_group contexts are maximal among the contexts that share
    the longer piece, or whole windows. docs: row (binary, equal only for rows that are equal), text. cover leaves
    out the groups' names and gives each context once, from the least start to the greatest end of its groups."""
    found = materialize(find_anchors(docs, length, core), "anchors")
    again = materialize(found.groupBy("g").agg(F.sum(F.size("occ")).alias("n")).where("n > 1"), "again")
    found = materialize(_keep(found, again, ["g"]), "shared")
    per = found.groupBy("g", "c").agg(F.sum(F.size("occ")).alias("n"), F.min(F.col("occ").getItem(0)).alias("one"))
    per = materialize(per, "contexts")
    twice = per.where("n > 1").select("g", "c", "n")
    whole = _keep(found, twice, ["g", "c"]).select(F.format_string("%016x-%016x", "g", "c").alias("repeat"), F.explode("occ").alias("x")).select("repeat", "x.row", F.col("x.a").alias("start"), F.col("x.z").alias("end"))
    sizes = per.groupBy(F.col("g").alias("key")).agg(F.count("*").alias("k"))
    keys = _large_keys(sizes, max_group)
    keyed = per.select(F.col("g").alias("key"), "g", "c", "one.*")
    small = keyed.join(keys, "key", "left_anti").join(sizes.where(F.col("k").between(2, max_group)), "key", "left_semi").withColumn("large", F.lit(False))
    large = keyed.join(keys, "key", "left_semi").withColumn("large", F.lit(True))
    contexts = small.unionByName(large).groupBy("row").agg(F.collect_list(F.struct("key", "g", "c", "large", "a", "z", "p")).alias("of"))
    joined = docs.select("row", "text").join(contexts, "row")

    def cut(batches):
        for batch in batches:
            rows, texts = batch.column("row"), batch.column("text")
            for i in range(batch.num_rows):
                data = texts[i].as_py().encode()
                of = batch.column("of")[i].values
                a, p, z = (of.field(x).to_pylist() for x in ("a", "p", "z"))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(of.field(x) for x in ("key", "g", "c")),
                        rows.take(pa.array(np.full(len(of), i))),
                        of.field("p"),
                        pa.array([data[x:y][::-1] for x, y in zip(a, p, strict=True)], pa.binary()),
                        pa.array([data[y:x] for y, x in zip(p, z, strict=True)], pa.binary()),
                        of.field("large"),
                    ],
                    names=[*_CONTEXT, "large"],
                )

    cuts = materialize(joined.mapInArrow(cut, "key bigint, g bigint, c bigint, row binary, p int, before binary, after binary, large boolean"), "cuts")
    small, equal = _split_large(cuts.where("large"), length, core, max_group)
    groups = cuts.where("not large").select(*_CONTEXT)
    members = context_repeats(groups if small is None else groups.unionByName(small), length, cover)
    if equal is not None:
        own = equal.select(F.format_string("%016x-whole", "key").alias("repeat"), "g", "c", "row", "p", F.col("lo").alias("reach"), (F.lit(length) - F.col("lo")).alias("depth"))
        members = members.unionByName(own)
    if not cover:  # contexts stand for all their occurrences
        every = found.select("g", "c", F.explode("occ").alias("x")).select("g", "c", "x.row", "x.p")
        members = members.drop("row", "p").join(every, ["g", "c"])
    return whole.unionByName(members.select("repeat", "row", (F.col("p") - F.col("reach")).alias("start"), (F.col("p") + F.col("depth")).alias("end")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, core: int = CORE, max_group: int = MAX_GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (byte ranges removed), kept_sha256: one row per row of docs."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("row", F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "text"))))
    found = find_repeats(own, length, core, max_group, cover=True)
    spans = found.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("of"))
    joined = own.join(spans, "row", "left").select("doc_id", "text", "of")

    def digest(batches):
        for batch in batches:
            texts, spans = batch.column("text"), batch.column("of")
            out = {"n_bytes": [], "n_removed": [], "spans": [], "kept_sha256": []}
            for i in range(batch.num_rows):
                data = texts[i].as_py().encode()
                merged: list[list[int]] = []
                for x in sorted((x["start"], x["end"]) for x in spans[i].as_py() or ()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append([*x])
                kept, at = hashlib.sha256(), 0
                for a, z in merged:
                    kept.update(data[at:a])
                    at = z
                kept.update(data[at:])
                out["n_bytes"].append(len(data))
                out["n_removed"].append(sum(z - a for a, z in merged))
                out["spans"].append([{"start": a, "end": z} for a, z in merged])
                out["kept_sha256"].append(kept.hexdigest())
            types = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], names=["doc_id", *out])

    done = joined.mapInArrow(digest, "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept_sha256 string")
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256", "spans")
