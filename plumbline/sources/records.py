"""Objects of one large JSON file, found by byte ranges: no task reads the file as one row."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import stored

#: What can change the state of a reader: an escaped sign, a quote, a bracket.
_SIGN = re.compile(r'\\.|["{}\[\]]', re.S)
#: Stands before each object found; JSON has this letter only in escaped form.
_MARK = "\u0001"


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """Each range's own columns and its pieces, with the brace that ended them, of rows that stand together; pieces are read as they come."""
    rows = (row for pdf in batches for row in pdf.itertuples(index=False, name=None))
    held = next(rows, None)

    def pieces(key):
        nonlocal held
        while held is not None and held[1:] == key:
            yield held[0] + "}"
            held = next(rows, None)

    while held is not None:
        key = held[1:]
        yield key, pieces(key)


def _effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each range its number of quotes, and by how much it changes the depth if it begins outside and inside a string.

    Quotes are counted alike in both cases, as escapes stand in strings only and no range begins within one."""
    for (file, at), pieces in _ranges(batches):
        quotes, change, first = 0, [0, 0], None
        for piece in pieces:
            for c in _SIGN.findall(piece):
                first = first or c
                if c == '"':
                    quotes += 1
                elif c in "{[":
                    change[quotes % 2] += 1  # inside strings for one of the cases, outside for the other
                elif c in "}]":
                    change[quotes % 2] -= 1
        yield pd.DataFrame({"file": [file], "at": [at], "quotes": [quotes], "outside": [change[0]], "inside": [change[1]], "first": [first]})


def _cut(batches: Iterator[pd.DataFrame], limit: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """The text of each range, cut behind every object; the last part is what remains, and not closed."""
    names = ["file", "at", "no", "closed", "text"]
    out, size = [], 0
    for (file, at, inside, level, depth), pieces in _ranges(batches):
        text, no = [], 0
        for piece in pieces:
            last = 0
            for m in _SIGN.finditer(piece):
                c = m.group()
                if c == '"':
                    inside = not inside
                elif inside or len(c) > 1:
                    continue
                elif c in "{[":
                    if level == depth and c == "{":
                        text += [piece[last : m.start()], _MARK]
                        last = m.start()
                    level += 1
                else:
                    level -= 1
                    if level == depth and c == "}":
                        text.append(piece[last : m.end()])
                        last = m.end()
                        out.append((file, at, no, True, "".join(text)))
                        size += len(out[-1][-1])
                        text, no = [], no + 1
            text.append(piece[last:])
            if size > limit:
                yield pd.DataFrame(out, columns=names)
                out, size = [], 0
        out.append((file, at, no, False, "".join(text)))
    if out:
        yield pd.DataFrame(out, columns=names)


def read_json_objects(spark: SparkSession, path: str, in_list: int = 1, in_object: int = 1) -> DataFrame:
    """(file, key, value): the texts of all objects that stand so many brackets deep in JSON files, with the key before each, or null in lists.

    in_list is the depth in files that begin with a list, in_object that in others. Files may hold several texts one after
    the other, as JSON lines do. A file is read in as many ranges as Spark cuts it into. A first pass counts for each range its quotes and how it changes
    the depth; running sums of these numbers, of which every range has three, tell how each begins. The second pass cuts the
    objects; only those on the border of ranges move, to be joined. The numbers are broadcast: one row for each
    spark.sql.files.maxPartitionBytes of input. Objects in lists that are values at that depth are deeper and do not count.
    Empty files give no rows; a file that ends within an object or list is an error."""
    pieces = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    effects = stored(pieces.mapInPandas(_effects, "file string, at long, quotes long, outside long, inside long, first string"))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    depth = F.when(F.first("first", True).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == "[", in_list).otherwise(in_object)
    begun = effects.withColumn("_in", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).withColumn("_change", F.when(F.col("_in"), F.col("inside")).otherwise(F.col("outside")))
    # at the end of a file all is closed; a brace too many may stand there, as none ends the last piece of a file without one
    every = Window.partitionBy("file")
    torn = F.raise_error(F.concat(F.lit("the file ends within an object: "), F.col("file"))).cast("long")
    level = F.when((F.sum("_change").over(every) > 0) | (F.sum("quotes").over(every) % 2 == 1), torn).otherwise(F.coalesce(F.sum("_change").over(before), F.lit(0)))
    starts = begun.select("file", "at", "_in", level.alias("_level"), depth.alias("_depth"))
    parts = stored(pieces.join(F.broadcast(starts), ["file", "at"]).select("value", "file", "at", "_in", "_level", "_depth").mapInPandas(_cut, "file string, at long, no long, closed boolean, text string"))
    own = F.col("closed") & (F.col("no") > 0)
    # an object on a border: the parts behind one that is closed, up to the next that is
    order = Window.partitionBy("file").orderBy("at", "no").rowsBetween(Window.unboundedPreceding, -1)
    border = parts.where(~own).withColumn("_chain", F.coalesce(F.sum(F.col("closed").cast("long")).over(order), F.lit(0)))
    joined = border.groupBy("file", "_chain").agg(F.max("closed").alias("closed"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "no", "text"))), lambda x: x["text"]), "").alias("text"))
    texts = parts.where(own).select("file", "text").unionByName(joined.where("closed").select("file", "text"))
    halves = F.split("text", _MARK, 2)
    raw = F.nullif(F.regexp_extract(halves[0], r'("(?:[^"\\]|\\.)*+")\s*:\s*$', 1), F.lit(""))
    return texts.select("file", F.from_json(F.concat(F.lit('{"k":'), raw, F.lit("}")), "k string")["k"].alias("key"), F.get(halves, F.lit(1)).alias("value"))
