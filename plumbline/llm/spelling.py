"""Spelling variants: words that differ by one letter, each led to the commonest spelling near it.

Every word is a vector of letter counts, one for each group of letters. Words in the order of their
vectors form a trie whose levels are the groups. One inserted, deleted or replaced letter changes the
vector by at most one letter too many and one too few, so a depth-first search from the root carries a
budget of one surplus and one deficit and leaves a branch when either is spent; the words of the leaves
that it reaches are compared letter by letter.

The trie is cut into shards of neighbouring words by a range sort, each of bounded size. Only the shards'
first and last vectors, a row for each shard, are known to all tasks: the search goes down them first,
which sends a word to the few shards that its budget reaches. There whole batches of words walk down
the shard's trie together. Words that reach one shard are dealt to slots of bounded size. Words are
counted before anything is shuffled, so a common word costs no more than a rare one.

Rows: null and empty texts have no words; a null doc_id is written as nothing in the hash that picks
letters to delete; repeated rows count again; ties of a form's n go to the smallest in code-point
order; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merkle import CRC_SQL, CRC_TABLE_SQL
from .store import materialize

#: Words of a shard of the trie, and words that search it at once.
SHARD_WORDS, SLOT_WORDS = 20_000, 60_000
#: Words of a branch below which all of them are compared with what reaches it.
LEAF_WORDS = 8
#: Shortest word, least number of occurrences, and how much commoner a form is than its variant.
LEAST_LETTERS, LEAST_COUNT, COMMONER = 5, 3, 2
#: One in so many runs loses a letter.
DAMAGED = 97

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]+"
#: Levels of the trie: letters in groups of about equal frequency (the order of letters there and back), common ones first.
LEVELS = 16
_COMMON = [*"etaoinshrdlcumwfgypbvkjxqz", *map(chr, range(0xC0, 0x100))]
GROUPS = ["".join(c for i, c in enumerate(_COMMON) if (i % LEVELS if i // LEVELS % 2 == 0 else LEVELS - 1 - i % LEVELS) == k) for k in range(LEVELS)]
#: Letters of words that are compared as rows of a matrix, and pairs that are compared at once.
ROW_LETTERS, PAIRS = 24, 100_000


def counted(docs: DataFrame) -> DataFrame:
    """word, n: all words of all texts, counted in each task before they are shuffled."""
    text = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.withColumn("size", F.length("run")).where(F.col("size") >= LEAST_LETTERS)
    runs = runs.withColumn("h", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.col("size")).cast("int")
    word = F.when(F.col("h") % DAMAGED == 0, F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.col("size")))).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.where((F.length("word") >= LEAST_LETTERS) & (F.col("n") >= LEAST_COUNT))


def with_vectors(words: DataFrame) -> DataFrame:
    return words.withColumn("vector", F.array(*((F.length("word") - F.length(F.translate("word", g, ""))).alias(str(i)) for i, g in enumerate(GROUPS))))


def matrix(vectors: pa.Array) -> np.ndarray:
    return np.asarray(vectors.flatten()).reshape(len(vectors), len(GROUPS)).astype(np.int32)


def spend(of: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Surplus and deficit of each row of `of` against the nearest value from low to high."""
    return np.maximum(of - high, 0).sum(1), np.maximum(low - of, 0).sum(1)


def reached(queries: np.ndarray, lows: np.ndarray, highs: np.ndarray):
    """Yields (shard, rows of queries that may have near words in it): depth-first over ever smaller runs of shards."""
    stack = [(0, len(lows), np.arange(len(queries)))]
    while stack:
        a, b, rows = stack.pop()
        low, high = lows[a], highs[b - 1]
        shared = int(np.argmax(low != high)) if (low != high).any() else len(low)  # up to there all words agree, next they differ within a range
        cut = slice(0, shared + 1)
        surplus, deficit = spend(queries[rows, cut], low[cut], high[cut])
        rows = rows[(surplus <= 1) & (deficit <= 1)]
        if not len(rows):
            continue
        if b - a == 1:
            yield a, rows
        else:
            steps = np.unique(np.linspace(a, b, 9).astype(int))
            stack += [(int(x), int(y), rows) for x, y in zip(steps, steps[1:], strict=False)]


def candidates(trie: np.ndarray, queries: np.ndarray):
    """Yields (row of trie, rows of queries) whose vectors are within the budget. trie is sorted: a branch is a run of rows that agree in their first groups."""
    none = np.zeros(len(queries), np.int32)
    stack = [(0, len(trie), 0, np.arange(len(queries)), none, none)] if len(trie) else []
    while stack:
        lo, hi, depth, rows, surplus, deficit = stack.pop()
        while depth < trie.shape[1] and hi - lo > LEAF_WORDS and len(rows) and trie[lo, depth] == trie[hi - 1, depth]:
            rows, surplus, deficit = _down(queries, rows, surplus, deficit, depth, trie[lo, depth])
            depth += 1
        if not len(rows):
            continue
        if hi - lo <= LEAF_WORDS or depth == trie.shape[1]:
            for leaf in range(lo, hi):
                more, less = spend(queries[rows, depth:], trie[leaf, depth:], trie[leaf, depth:])
                found = rows[(surplus + more <= 1) & (deficit + less <= 1)]
                if len(found):
                    yield leaf, found
            continue
        values, starts = np.unique(trie[lo:hi, depth], return_index=True)
        ends = [*(lo + starts[1:]), hi]
        for value, start, end in zip(values, lo + starts, ends, strict=True):
            own = _down(queries, rows, surplus, deficit, depth, value)
            if len(own[0]):
                stack.append((int(start), int(end), depth + 1, *own))


def _down(queries, rows, surplus, deficit, depth, value):
    """What is left of the rows and what they have spent after a branch of that value."""
    over = queries[rows, depth] - value
    surplus, deficit = surplus + np.maximum(over, 0), deficit + np.maximum(-over, 0)
    kept = (surplus <= 1) & (deficit <= 1)
    return rows[kept], surplus[kept], deficit[kept]


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one letter is inserted, deleted or replaced between a and b."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


def letters(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and the words' letters as rows, from their beginnings and from their ends; longer words have empty rows."""
    size = np.array([len(t) for t in texts], np.int32)
    rows = np.full((2, len(texts), ROW_LETTERS), pad, np.uint8)
    for i, t in enumerate(texts):
        if len(t) <= ROW_LETTERS:
            own = np.frombuffer(t.encode("latin-1"), np.uint8)  # all letters of words are there
            rows[0, i, : len(own)], rows[1, i, : len(own)] = own, own[::-1]
    return size, rows[0], rows[1]


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters up to the first difference of each pair of rows, whose paddings differ."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), ROW_LETTERS)


class Shard:
    """Words of a shard and those that ask; pairs are compared in blocks."""

    def __init__(self, texts: list[str], asked: list[str]):
        self.texts, self.asked = texts, asked
        self.of, self.by = letters(texts, 0), letters(asked, 1)

    def near(self, t: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which of the pairs are one edit apart: what agrees at both ends leaves one letter."""
        (m, head, tail), (n, asked_head, asked_tail) = self.of, self.by
        long = np.maximum(m[t], n[q])
        same = agreeing(head[t], asked_head[q])
        ends = agreeing(tail[t], asked_tail[q])
        found = (same + ends >= long - 1) & (np.abs(m[t] - n[q]) <= 1) & ~((same >= long) & (m[t] == n[q]))
        for i in np.flatnonzero(long > ROW_LETTERS):
            found[i] = one_edit(self.texts[t[i]], self.asked[q[i]])
        return found


def paired(found, size: int):
    """Candidates as arrays of pairs, at least `size` at once but for the last."""
    held, n = [], 0
    for leaf, rows in found:
        held.append((np.full(len(rows), leaf), rows))
        n += len(rows)
        if n >= size:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


_NEAR = "word string, n_near bigint, form string, form_n bigint"


def search_shard(words: pa.Table, queries: pa.Table) -> pa.Table:
    """For each query with near words in the shard: how many, and the commonest."""
    words = words.sort_by("place")
    texts, asked = words["word"].to_pylist(), queries["word"].to_pylist()
    near = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if texts and asked:
        shard = Shard(texts, asked)
        for t, q in paired(candidates(matrix(words["vector"].combine_chunks()), matrix(queries["vector"].combine_chunks())), PAIRS):
            kept = shard.near(t, q)
            near.append((t[kept], q[kept]))
    t, q = map(np.concatenate, zip(*near, strict=True))
    n = words["n"].to_numpy()
    place = np.empty(len(texts), np.int64)
    place[sorted(range(len(texts)), key=texts.__getitem__)] = np.arange(len(texts))
    order = np.lexsort((place[t], -n[t], q))
    t, q = t[order], q[order]
    who, first, count = np.unique(q, return_index=True, return_counts=True)
    best = t[first]
    return pa.table([pa.array([asked[i] for i in who], pa.string()), pa.array(count, pa.int64()), pa.array([texts[i] for i in best], pa.string()), pa.array(n[best], pa.int64())], names=["word", "n_near", "form", "form_n"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form, form_n of the words (word, n) that have near ones; form is the commonest near word, the least one among equals."""
    total = words.count()
    shards = max(1, -(-total // SHARD_WORDS))
    placed = with_vectors(words).repartitionByRange(shards, "vector", "word").sortWithinPartitions("vector", "word")
    placed = materialize(placed.withColumn("shard", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "shards")
    bounds = placed.groupBy("shard").agg(F.min("vector").alias("low"), F.max("vector").alias("high")).orderBy("shard").collect()  # a row for each shard
    if not bounds:
        return words.sparkSession.createDataFrame([], _NEAR)
    numbers, lows, highs = (np.array([r[k] for r in bounds], np.int32) for k in range(3))

    def route(batches):
        for batch in batches:
            vectors = batch.column("vector")
            for k, rows in reached(matrix(vectors), lows, highs):
                own = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), numbers[k]), pa.int32()), *own.columns], names=["shard", "word", "vector"])

    routed = materialize(placed.select("word", "vector").mapInArrow(route, "shard int, word string, vector array<int>"), "routed")
    slots = routed.groupBy("shard").agg(F.ceil(F.count("*") / SLOT_WORDS).cast("int").alias("slots"))  # a row for each shard
    asking = routed.join(F.broadcast(slots), "shard").withColumn("slot", F.pmod(F.xxhash64("word"), F.col("slots")).cast("int")).drop("slots")
    asked = placed.join(F.broadcast(slots), "shard").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")
    found = asked.groupBy("shard", "slot").cogroup(asking.groupBy("shard", "slot")).applyInArrow(search_shard, _NEAR)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))).alias("x"))
    return best.select("word", "n_near", F.col("x.form").alias("form"), (-F.col("x.n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form: links are doubled until none leads on. n at least doubles with each link, so the rounds are few."""
    links = materialize(forms.where("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        links = materialize(links.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "links")
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.drop("moved")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each word of the texts."""
    words = materialize(counted(docs), "words")
    near = words.join(near_words(words), "word", "left")
    is_form = F.col("form_n") >= COMMONER * F.col("n")
    forms = materialize(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "forms")
    return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_sql() -> str:
    """The rows of variants in DuckDB's SQL, near words by shared patterns."""
    crc = CRC_SQL.format(bytes="flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END))")
    return f"""WITH RECURSIVE {CRC_TABLE_SQL},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
hashed AS (SELECT run, {crc} AS h FROM runs, crc WHERE length(run) >= {LEAST_LETTERS}),
words AS (SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % {DAMAGED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed) WHERE length(word) >= {LEAST_LETTERS} GROUP BY 1 HAVING count(*) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
patterns AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS pattern, substr(word, 1, i - 1) || substr(word, i + 1) AS shorter FROM places),
shorter AS (SELECT DISTINCT p.word, p.n, w.word AS other, w.n AS other_n FROM patterns p JOIN words w ON w.word = p.shorter),
near AS (SELECT DISTINCT * FROM (SELECT a.word, b.word AS form, b.n AS form_n FROM patterns a JOIN patterns b ON a.pattern = b.pattern AND a.word <> b.word UNION ALL SELECT word, other, other_n FROM shorter UNION ALL SELECT other, word, n FROM shorter)),
best AS (SELECT word, count(*) AS n_near, arg_min(form, (-form_n, form)) AS form, max(form_n) AS form_n FROM near GROUP BY word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {COMMONER} * n THEN form END AS form, CASE WHEN form_n >= {COMMONER} * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS onward FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.onward)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN chain ON chain.word = forms.word AND onward IS NULL"""
