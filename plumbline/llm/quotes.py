"""Chat formatting: linking of quoted passages to the messages that they come from.

Lines that start with `>` are quoted; the number of leading `>` is their level. A passage is a run of
quoted lines of one level; it is normalised (lower case, runs of white space as one space) and hashed.
Every message offers the hashes of its own lines and of its own runs of lines. A passage links to the
message that first offered its hash, in its own conversation if that is before it, else in the least
other conversation; a passage that is found nowhere is tried line by line. A message replies to the last message
of its own conversation that it quotes at level 1. Conversations are given in reply order, threads
by their first turn and messages by turn, without quoted lines.

Offers are reduced to one message per conversation and hash, and two of different conversations per
hash (one of which is another than the quoting one), before the joins, so a line that everyone writes
makes no pairs. Everything is DataFrame functions.

Rows: a null text is an empty message; a null role stays null; rows that repeat a conversation's turn
are kept, and the first by text stands for that turn; passages without letters or digits never link;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

_QUOTE = r"^((?:[ \t]{0,3}>)+)[ \t]?(.*)$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def message_lines(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, msg, pos, level, line): level 0 is the message's own text."""
    lines = messages.select("conv_id", "turn", "role", "msg", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("pos", "raw"))
    marks = F.regexp_extract("raw", _QUOTE, 1)
    level = F.length(F.regexp_replace(marks, "[^>]", ""))
    return lines.select("conv_id", "turn", "role", "msg", "pos", level.alias("level"), F.when(level > 0, F.regexp_extract("raw", _QUOTE, 2)).otherwise(F.col("raw")).alias("line"))


def _runs(lines: DataFrame) -> DataFrame:
    """Runs of non-blank lines of one level: (conv_id, turn, msg, level, run, first, of)."""
    by = Window.partitionBy("msg").orderBy("pos")
    cut = (F.lag("level").over(by) != F.col("level")) | (F.trim(F.lag("line").over(by)) == "") | F.lag("level").over(by).isNull()
    runs = lines.withColumn("cut", cut.cast("int")).withColumn("run", F.sum("cut").over(by)).where(F.trim("line") != "")
    return runs.groupBy("msg", "run").agg(F.first("conv_id").alias("conv_id"), F.first("turn").alias("turn"), F.first("level").alias("level"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("of"))


def link_quotes(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages numbered by hash with their lines, and passages with the message they link to.

    Passages: conv_id, turn, msg, run, level, n_lines, passage (hash), from_conv, from_turn."""
    own = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    own = own.withColumn("msg", F.sha2(F.to_json(F.struct("conv_id", "turn", "role", "text")), 256))
    same = Window.partitionBy("msg").orderBy("conv_id")
    numbered = own.withColumn("msg", F.concat_ws("-", "msg", F.row_number().over(same)))
    lines = message_lines(numbered)
    runs = materialize(_runs(lines), "runs")
    whole = F.transform("of", lambda x: x["line"])
    units = runs.select("conv_id", "turn", "msg", "run", "level", F.size("of").alias("n_lines"), F.explode(F.array_union(F.array(F.array_join(whole, " ")), whole)).alias("unit"), F.array_join(whole, " ").alias("all"))
    units = units.select("conv_id", "turn", "msg", "run", "level", "n_lines", (F.col("unit") == F.col("all")).alias("is_run"), normalised(F.col("unit")).alias("unit")).where(F.col("unit").rlike(r"[\p{L}\p{N}]"))
    units = units.withColumn("hash", F.sha2("unit", 256)).drop("unit")
    offers = units.where("level = 0").groupBy("hash", "conv_id").agg(F.min("turn").alias("turn"))
    least = offers.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("g"))
    # one offer more of each hash, of the least other conversation, for quotes in the least one
    second = offers.join(least.select("hash", F.col("g.conv_id").alias("first_conv")), "hash").where("conv_id <> first_conv").groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("g2"))
    anywhere = least.join(second, "hash", "left")
    quoted = units.where("level > 0")
    near = offers.select("hash", "conv_id", F.col("turn").alias("near_turn"))
    found = quoted.join(near, ["hash", "conv_id"], "left").join(anywhere, "hash", "left")
    inside = F.col("near_turn") < F.col("turn")
    other = F.when(F.col("g.conv_id") != F.col("conv_id"), F.col("g")).otherwise(F.col("g2"))
    found = found.withColumn("other", other)
    found = found.select("conv_id", "turn", "msg", "run", "level", "n_lines", "hash", "is_run", F.when(inside, F.col("conv_id")).otherwise(F.col("other.conv_id")).alias("from_conv"), F.when(inside, F.col("near_turn")).otherwise(F.col("other.turn")).alias("from_turn"))
    best = F.struct(F.col("from_turn").isNull().alias("a"), (~F.col("is_run")).alias("b"), (F.col("from_conv") != F.col("conv_id")).alias("c"), (-F.col("from_turn")).alias("d"), "from_conv", "from_turn")
    passages = found.groupBy("msg", "run").agg(F.first("conv_id").alias("conv_id"), F.first("turn").alias("turn"), F.first("level").alias("level"), F.first("n_lines").alias("n_lines"), F.min(F.when(F.col("is_run"), F.col("hash"))).alias("passage"), F.min(best).alias("x"))
    return numbered, passages.select("conv_id", "turn", "msg", "run", "level", "n_lines", "passage", "x.from_conv", "x.from_turn")


def reply_order(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, n_passages, n_linked, max_level, reply_to, thread (turn of its first message), position in reply order, body (text without quoted lines)."""
    numbered, passages = link_quotes(messages)
    passages = materialize(passages, "passages")
    own_link = F.when((F.col("level") == 1) & (F.col("from_conv") == F.col("conv_id")), F.col("from_turn"))
    per = passages.groupBy("msg").agg(F.count("*").alias("n_passages"), F.count("from_turn").alias("n_linked"), F.max("level").cast("bigint").alias("max_level"), F.max(own_link).alias("reply_to"))
    kept = message_lines(numbered).where("level = 0").groupBy("msg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    out = numbered.drop("text").join(per, "msg", "left").join(kept, "msg", "left").fillna(0, ["n_passages", "n_linked", "max_level"]).withColumn("body", F.trim(F.coalesce("body", F.lit(""))))
    out = materialize(out.withColumn("thread", F.coalesce("reply_to", "turn")), "replies")
    links = out.where("reply_to is not null").groupBy("conv_id", "turn").agg(F.min("reply_to").alias("up"))
    links = materialize(links, "up")
    while not links.isEmpty():  # pointer jumping to the first message of each thread
        top = links.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("top"))
        moved = materialize(links.join(top, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "up")
        links = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    out = out.join(links, ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("up", "thread"))
    order = Window.partitionBy("conv_id").orderBy("thread", "turn", "msg")
    return out.select("conv_id", "turn", "role", "n_passages", "n_linked", "max_level", "reply_to", "thread", F.row_number().over(order).cast("bigint").alias("position"), "body")


def conversations(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_messages, n_passages, n_linked, chat (role: body, in reply order)."""
    ordered = reply_order(messages)
    turns = F.array_sort(F.collect_list(F.struct("position", F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.col("body")).alias("said"))))
    return ordered.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.sum("n_passages").alias("n_passages"), F.sum("n_linked").alias("n_linked"), F.array_join(F.transform(turns, lambda x: x["said"]), "\n").alias("chat"))


def quoting(messages: DataFrame) -> DataFrame:
    """Messages as a mail client would send them: by a hash of conversation and turn, half of them quote the first line of the
    message before, a quarter quote all of it, and every other one of these quotes the first line of the message before that,
    one level deeper. Messages of one turn quote the least text of the turns before."""
    texts = messages.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    before = texts.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("one"))
    earlier = texts.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("two"))
    joined = messages.join(before, ["conv_id", "turn"], "left").join(earlier, ["conv_id", "turn"], "left")
    digit = F.substring(F.md5(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))), 1, 1)
    first = lambda c: F.split(c, "\n")[0]  # noqa: E731
    near = F.when(digit < "8", F.concat(F.lit("> "), first("one"))).when(digit < "c", F.concat(F.lit("> "), F.replace("one", F.lit("\n"), F.lit("\n> "))))
    far = F.when(digit.isin(*"02468a") & (F.col("one").isNotNull()), F.concat(F.lit("> > "), first("two")))
    return joined.select("conv_id", "turn", "role", F.concat_ws("\n", far, near, "text").alias("text"))


#: The rows of quoting(conversations) from SQL.
QUOTING_SQL = """SELECT c.conv_id, c.turn, c.role, concat_ws(chr(10),
    CASE WHEN d IN ('0', '2', '4', '6', '8', 'a') AND one IS NOT NULL THEN '> > ' || split_part(two, chr(10), 1) END,
    CASE WHEN d < '8' THEN '> ' || split_part(one, chr(10), 1) WHEN d < 'c' THEN '> ' || replace(one, chr(10), chr(10) || '> ') END, c.text) AS text
  FROM (SELECT *, md5(conv_id::VARCHAR || ':' || turn::VARCHAR)[1] AS d FROM conversations) c
  LEFT JOIN (SELECT conv_id, turn + 1 AS turn, min(text) AS one FROM conversations GROUP BY ALL) USING (conv_id, turn)
  LEFT JOIN (SELECT conv_id, turn + 2 AS turn, min(text) AS two FROM conversations GROUP BY ALL) USING (conv_id, turn)"""


def digest(messages: DataFrame) -> DataFrame:
    """reply_order with the body's digest in its place."""
    return reply_order(messages).withColumn("body_sha256", F.sha2("body", 256)).drop("body")


def digest_sql(source: str = "SELECT * FROM conversations") -> str:
    """The same rows from SQL, where no turn stands on two rows."""
    return rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS msg, conv_id, turn, role, coalesce(text, '') AS text FROM ({source})),
raw AS (SELECT msg, conv_id, turn, unnest(regexp_split_to_array(text, '?
')) AS raw, generate_subscripts(regexp_split_to_array(text, '?
'), 1) AS pos FROM m),
lines AS (SELECT msg, conv_id, turn, pos, length(regexp_replace(regexp_extract(raw, '^((?:[ 	]{{0,3}}>)+)[ 	]?(.*)$', 1), '[^>]', '', 'g')) AS level, raw FROM raw),
l AS (SELECT msg, conv_id, turn, pos, level, CASE WHEN level > 0 THEN regexp_extract(raw, '^((?:[ 	]{{0,3}}>)+)[ 	]?(.*)$', 2) ELSE raw END AS line FROM lines),
c AS (SELECT *, CASE WHEN lag(level) OVER w = level AND trim(lag(line) OVER w) <> '' THEN 0 ELSE 1 END AS cut FROM l WINDOW w AS (PARTITION BY msg ORDER BY pos)),
n AS (SELECT *, sum(cut) OVER (PARTITION BY msg ORDER BY pos) AS run FROM c),
runs AS (SELECT msg, conv_id, turn, level, run, list(line ORDER BY pos) AS of FROM n WHERE trim(line) <> '' GROUP BY ALL),
each AS (SELECT msg, conv_id, turn, level, run, array_to_string(of, ' ') AS whole, unnest(list_distinct(list_append(of, array_to_string(of, ' ')))) AS unit FROM runs),
units AS (SELECT msg, conv_id, turn, level, run, unit = whole AS is_run, trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) AS h FROM each WHERE regexp_matches(unit, '[\pL\pN]')),
offers AS (SELECT h, conv_id, min(turn) AS turn FROM units WHERE level = 0 GROUP BY ALL),
ranked AS (SELECT h, conv_id, turn, row_number() OVER (PARTITION BY h ORDER BY conv_id) AS k FROM offers),
found AS (SELECT u.msg, u.run, u.level, u.conv_id, u.is_run,
    CASE WHEN near.turn < u.turn THEN u.conv_id WHEN a.conv_id <> u.conv_id THEN a.conv_id ELSE b.conv_id END AS from_conv,
    CASE WHEN near.turn < u.turn THEN near.turn WHEN a.conv_id <> u.conv_id THEN a.turn ELSE b.turn END AS from_turn
  FROM units u LEFT JOIN offers near ON near.h = u.h AND near.conv_id = u.conv_id LEFT JOIN ranked a ON a.h = u.h AND a.k = 1 LEFT JOIN ranked b ON b.h = u.h AND b.k = 2 WHERE level > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY msg, run ORDER BY from_turn IS NULL, NOT is_run, from_conv <> conv_id, from_turn DESC, from_conv) AS k FROM found),
per AS (SELECT msg, count(*) AS n_passages, count(from_turn) AS n_linked, max(level) AS max_level, max(CASE WHEN level = 1 AND from_conv = conv_id THEN from_turn END) AS reply_to FROM best WHERE k = 1 GROUP BY msg),
body AS (SELECT msg, string_agg(line, chr(10) ORDER BY pos) AS body FROM l WHERE level = 0 GROUP BY msg),
o AS (SELECT m.msg, m.conv_id, m.turn, m.role, coalesce(n_passages, 0) AS n_passages, coalesce(n_linked, 0) AS n_linked, coalesce(max_level, 0) AS max_level, reply_to, trim(coalesce(body, '')) AS body FROM m LEFT JOIN per USING (msg) LEFT JOIN body USING (msg)),
up(conv_id, turn, top) AS (SELECT conv_id, turn, reply_to FROM o WHERE reply_to IS NOT NULL UNION ALL SELECT up.conv_id, up.turn, o.reply_to FROM up JOIN o ON o.conv_id = up.conv_id AND o.turn = up.top WHERE o.reply_to IS NOT NULL),
t AS (SELECT o.*, coalesce(x.top, o.turn) AS thread FROM o LEFT JOIN (SELECT conv_id, turn, min(top) AS top FROM up GROUP BY ALL) x USING (conv_id, turn))
SELECT conv_id, turn, role, n_passages, n_linked, max_level, reply_to, thread, row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn) AS position, sha256(body) AS body_sha256 FROM t"""
