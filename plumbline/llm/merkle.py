"""Merkle manifest of a dataset: every row a leaf, a tree for each language, and one over the languages.

Leaves get their places by a range sort and counts of its parts. Levels are built from groups of 4,096
neighbours, twelve levels at a time, and stored as rows that are linked upwards. A recursive query then
climbs from every leaf: each step follows a link, appends the siblings on it and folds them into the
leaf's digest, so a changed row shows as a root that differs. A link spans up to four levels, which makes
a climb of 34 levels nine steps. Rows of nodes above many leaves are stored once for each 4,096 leaves,
so no node is a hot key of the climb's join.

Rows: languages in bytewise order, null first; leaves of one language by doc_id, null first; rows that
share a doc_id by their digest, and rows alike in all columns in any order, since their digests are the
same. An empty table gives no rows. A null doc_id is never tampered with. Extra columns are no part of
a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

#: Levels that are built from one group of nodes, and that a link spans (a divisor of it).
GROUP_LEVELS, LINK_LEVELS = 12, 4
#: Bits of a node's number that name its first leaf; what is above them names its level: of a language's tree, or from this one on of the tree over languages.
PLACE_BITS, TOP_TREE = 52, 64
_HASHED = "doc_id", "source", "lang", "n_chars", "text"


def digest(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def row_digest(columns: dict[str, Column]) -> Column:
    """Of each value its count of UTF-8 bytes, a colon and itself, or - for null."""
    text = [c.cast("string") for c in columns.values()]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text)))


def tampered() -> Column:
    """Rows that the test of the manifest changes."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))


def numbered(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """rows in sorted parts with their place (from 0) over the whole table, and the parts' first places.

    Each part of the range sort counts its own rows; only these counts, one row for each part, meet in one window."""
    keys = [F.col(c).asc_nulls_first() for c in order] + [F.col("_tie")]
    sorted_ = rows.withColumn("_tie", F.rand(7)).repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = materialize(sorted_.drop("_tie").withColumn("part", F.spark_partition_id()).withColumn("at", at), name)
    counts = parts.groupBy("part").agg(F.count("*").alias("_n"))
    first = counts.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    return parts.join(F.broadcast(first), "part").withColumn("place", F.col("_first") + F.col("at")).drop("_first", "at"), first


def leaves(docs: DataFrame) -> DataFrame:
    """place, doc_id, tree (place of the language's first leaf), idx (place within the language), n (leaves of the language), hash, changed (the tampered row's digest)."""
    own = {c: F.col(c) for c in _HASHED}
    more = own | {"n_chars": F.col("n_chars") + 1}
    lang = F.coalesce(F.concat(F.lit("."), F.col("lang").cast("string")), F.lit(""))
    hashed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), lang.alias("lang"), row_digest(own).alias("hash"), F.when(tampered(), row_digest(more)).alias("changed"))
    placed, _ = numbered(materialize(hashed, "leaves"), ["lang", "doc_id", "hash"], "placed")
    per = placed.groupBy("part", "lang").agg(F.count("*").alias("_n"), F.min("place").alias("_first"))
    of = Window.partitionBy("lang")  # a row for each part
    trees = per.select("part", "lang", F.min("_first").over(of).alias("tree"), F.sum("_n").over(of).alias("n"))
    rows = placed.join(trees, ["part", "lang"]).withColumn("idx", F.col("place") - F.col("tree"))
    return materialize(rows.select("place", "doc_id", "tree", "idx", "n", "hash", F.coalesce("changed", "hash").alias("changed")), "tree_leaves")


def height(n: Column) -> Column:
    """Levels above n leaves: the least h with 2^h >= n."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def node(level: Column, first: Column) -> Column:
    return level.cast("bigint") * F.lit(1 << PLACE_BITS) + first


def _above(nodes: Column) -> Column:
    """The next level of an array of digests: every two make one, a last single one by itself."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), lambda i: digest(F.concat(hexed(F.get(nodes, i * 2)), F.coalesce(hexed(F.get(nodes, i * 2 + 1)), F.lit("")))))


def _link(levels: Column, k: Column, j: Column, count: Column) -> Column:
    """The steps from node j of level k up to `count` levels higher: whether the sibling stands left, and its digest (null where there is none)."""

    def step(d):
        i = F.floor(j / F.pow(F.lit(2), d)).cast("int")
        return F.struct((i % 2 == 1).alias("left"), F.get(F.get(levels, k + d), F.when(i % 2 == 1, i - 1).otherwise(i + 1)).alias("hash"))

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), step)).otherwise(F.array().cast("array<struct<left:boolean,hash:binary>>"))


def grow(base: DataFrame, at: int, first_level: int, top_level: int) -> DataFrame:
    """One round of building: rows of linked nodes from the nodes of level `at` of all trees, given as (tree, idx, n, hash, lo, hi).

    Returns kind "link" (node, up, path; lo and hi the leaves below), "next" (the nodes of the level twelve higher) and
    "top" (the top of a tree: its node is the tree over languages' leaf)."""
    group = base.groupBy("tree", F.floor(F.col("idx") / (1 << GROUP_LEVELS)).alias("g"), height(F.col("n")).alias("h"), "n").agg(F.array_sort(F.collect_list(F.struct("idx", "hash", "lo", "hi"))).alias("b"))
    steps = F.least(F.lit(GROUP_LEVELS), F.col("h") - at).cast("int")
    levels = F.aggregate(F.when(F.col("steps") > 0, F.sequence(F.lit(1), F.col("steps"))).otherwise(F.array().cast("array<int>")), F.array(F.col("b.hash")), lambda acc, k: F.concat(acc, F.array(_above(F.element_at(acc, F.lit(-1))))))
    built = group.withColumn("steps", steps).withColumn("levels", levels)

    def linked(k, j):
        """Node j of level k: its link ends in the last level of the tree as the top tree's leaf."""
        count = F.least(F.lit(LINK_LEVELS), F.col("steps") - k)
        width, span = F.pow(F.lit(2), k).cast("int"), F.pow(F.lit(2), k + count).cast("int")
        first = lambda i: F.get("b", i)["lo"]
        up_level = F.when(k + count + at == F.col("h"), F.lit(top_level)).otherwise(k + count + at + first_level)
        return F.struct(
            node(k + at + first_level, first(j * width)).alias("node"), node(up_level, first(F.floor(j * width / span).cast("int") * span)).alias("up"), _link(F.col("levels"), k, j, count).alias("path"),
            first(j * width).alias("lo"), F.get("b", F.least((j + 1) * width, F.size("b")) - 1)["hi"].alias("hi"),
        )

    stations = F.sequence(F.lit(0), F.greatest(F.col("steps") - 1, F.lit(0)), F.lit(LINK_LEVELS))
    # made within the row, so that a node's row does not carry the arrays of its whole group
    all_links = F.flatten(F.transform(stations, lambda k: F.transform(F.sequence(F.lit(0), F.size(F.get("levels", k)) - 1), lambda j: linked(k, j))))
    links = built.select(F.explode(all_links).alias("x")).select(F.lit("link").alias("kind"), "x.*", F.lit(None).cast("binary").alias("hash"), F.lit(None).cast("bigint").alias("tree"), F.lit(None).cast("bigint").alias("idx"), F.lit(None).cast("bigint").alias("n"))
    ends = built.select(
        F.when(F.col("h") - at <= GROUP_LEVELS, F.lit("top")).otherwise("next").alias("kind"), F.lit(None).cast("bigint").alias("node"), F.lit(None).cast("bigint").alias("up"), F.lit(None).cast("array<struct<left:boolean,hash:binary>>").alias("path"),
        F.get("b", F.lit(0))["lo"].alias("lo"), F.element_at("b", -1)["hi"].alias("hi"), F.get(F.element_at("levels", -1), F.lit(0)).alias("hash"), "tree", F.col("g").cast("bigint").alias("idx"), "n",
    )
    return links.unionByName(ends)


def forest(base: DataFrame, first_level: int, top_level: int, name: str) -> tuple[DataFrame, DataFrame]:
    """All linked nodes of all trees over base (tree, idx, n, hash, lo, hi), and the trees' tops (tree, hash, lo, hi)."""
    links = tops = None
    at = 0
    while True:
        built = materialize(grow(base, at, first_level, top_level), name)
        of = lambda kind, rows=built: rows.where(F.col("kind") == kind)
        here, ended = of("link").select("node", "up", "path", "lo", "hi"), of("top").select("tree", "hash", "lo", "hi")
        links, tops = (here, ended) if links is None else (links.unionByName(here), tops.unionByName(ended))
        base = of("next").select("tree", "idx", "n", "hash", "lo", "hi")
        if base.isEmpty():
            return links, tops
        at += GROUP_LEVELS


def blocks(rows: DataFrame) -> DataFrame:
    """rows (lo, hi) once for each block of 4,096 leaves that they stand above."""
    return rows.withColumn("block", F.explode(F.sequence(F.shiftright("lo", GROUP_LEVELS), F.shiftright("hi", GROUP_LEVELS)))).drop("lo", "hi")


_FOLD = "aggregate({path}, {start}, (h, s) -> unhex(sha2(CASE WHEN s.left THEN concat(lower(hex(s.hash)), lower(hex(h))) ELSE concat(lower(hex(h)), coalesce(lower(hex(s.hash)), '')) END, 256)))"


def climb_sql() -> str:
    """Climbs from all leaves at once. LIMIT ALL lifts the limit on the rows of a recursive query."""
    return f"""
WITH RECURSIVE climb(leaf, block, step, at, hash, siblings) AS (
  SELECT place, shiftright(place, {GROUP_LEVELS}), 0, up, {_FOLD.format(path="path", start="changed")}, path.hash FROM {{leaves}}
  UNION ALL
  SELECT c.leaf, c.block, c.step + 1, n.up, {_FOLD.format(path="n.path", start="c.hash")}, n.path.hash FROM climb c JOIN {{nodes}} n ON n.node = c.at AND n.block = c.block
)
SELECT leaf, step, hash, siblings FROM climb LIMIT ALL
"""


def manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The stored manifest: leaves with their first links, higher links by block, subroots by block, and the root (one row, or none)."""
    rows = leaves(docs)
    base = rows.select("tree", "idx", "n", "hash", F.col("place").alias("lo"), F.col("place").alias("hi"))
    links, subroots = forest(base, 0, TOP_TREE, "nodes")
    ranked, _ = numbered(subroots.select("tree", "hash", "lo", "hi"), ["tree"], "subroots")
    total = ranked.agg(F.count("*").alias("n"))
    over = ranked.crossJoin(F.broadcast(total)).select(F.lit(0).cast("bigint").alias("tree"), F.col("place").alias("idx"), "n", "hash", "lo", "hi")
    top_links, root = forest(over, TOP_TREE, 2 * TOP_TREE, "top_nodes")
    is_leaf = F.col("node") < F.lit(1 << PLACE_BITS)
    first = rows.join(links.where(is_leaf).select(F.col("node").alias("place"), "up", "path"), "place")
    higher = materialize(blocks(links.where(~is_leaf).unionByName(top_links).where(F.size("path") > 0)).select("node", "block", "up", "path"), "links")
    return materialize(first, "first_links"), higher, blocks(subroots.select("tree", F.col("hash").alias("subroot"), "lo", "hi")), root.select(F.col("hash").alias("root"))


def verify(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: builds the manifest, then climbs from every (tampered) leaf to the root."""
    first, links, subroots, root = manifest(docs)
    climbed = materialize(docs.sparkSession.sql(climb_sql(), leaves=first, nodes=links), "climb")
    steps = climbed.groupBy("leaf").agg(F.max_by("hash", "step").alias("folded"), F.array_sort(F.collect_list(F.struct("step", "siblings"))).alias("steps"))
    proof = F.sha2(F.array_join(F.transform(F.flatten("steps.siblings"), hexed), ""), 256)
    own = first.select("place", "doc_id", "hash", "tree", F.shiftright("place", GROUP_LEVELS).alias("block")).join(subroots, ["block", "tree"])
    out = own.join(steps.select(F.col("leaf").alias("place"), "folded", proof.alias("proof_sha256")), "place").crossJoin(F.broadcast(root))
    return out.select("doc_id", hexed(F.col("hash")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), "proof_sha256", hexed(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _encoded(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _climb_sql(name: str, start: str, nodes: str) -> str:
    """Rows of start (k, tree, idx, h, proof) folded up the trees of nodes (tree, lvl, idx, h, n)."""
    step = f"SELECT c.k, c.tree, c.lvl + 1, c.idx // 2, sha256(CASE WHEN c.idx % 2 = 1 THEN s.h || c.h ELSE c.h || coalesce(s.h, '') END), c.proof || coalesce(s.h, ''), (c.n + 1) // 2 FROM {name} c LEFT JOIN {nodes} s ON s.tree = c.tree AND s.lvl = c.lvl AND s.idx = xor(c.idx, 1) WHERE c.n > 1"
    return f"{name}(k, tree, lvl, idx, h, proof, n) AS ({start} UNION ALL {step})"


def _levels_sql(name: str, start: str) -> str:
    return f"{name}(tree, lvl, idx, h, n) AS ({start} UNION ALL SELECT tree, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY tree, lvl, idx // 2, n)"


#: Unsigned crc32 of ASCII text in SQL: the table of the reflected polynomial, and the sum over the bytes of {x}.
CRC_TABLE_SQL = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
CRC_SQL = "xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"


def verify_sql() -> str:
    """The rows of verify in DuckDB's SQL."""
    hashed = "sha256(" + " || ".join(map(_encoded, _HASHED)) + ")"
    changed = "sha256(" + " || ".join(_encoded("(n_chars + 1)" if c == "n_chars" else c) for c in _HASHED) + ")"
    crc = CRC_SQL.format(bytes="list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")
    return f"""WITH RECURSIVE {CRC_TABLE_SQL},
leaves AS (SELECT doc_id, lang, {hashed} AS leaf, CASE WHEN {crc} % 7 = 0 THEN {changed} ELSE {hashed} END AS start FROM documents, crc),
placed AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS k, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
{_levels_sql("nodes", "SELECT tree, 0, idx, leaf, n FROM placed")},
{_climb_sql("low", "SELECT k, tree, 0, idx, start, '', n FROM placed", "nodes")},
subroots AS (SELECT tree, h, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_levels_sql("tops", "SELECT 0, 0, tree, h, n FROM subroots")},
{_climb_sql("high", "SELECT low.k, 0, 0, low.tree, low.h, low.proof, subroots.n FROM low JOIN subroots USING (tree) WHERE low.n = 1", "tops")}
SELECT doc_id, leaf, subroots.h AS subroot, tops.h AS root, sha256(high.proof) AS proof_sha256, high.h AS folded_root, high.h = tops.h AS verified
FROM placed JOIN subroots USING (tree) JOIN high ON high.k = placed.k AND high.n = 1 JOIN tops ON tops.n = 1"""
