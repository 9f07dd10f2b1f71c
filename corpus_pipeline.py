"""A corpus pipeline of the operators in plumbline.llm: score, join, decontaminate, redact, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of documents. Near duplicates and toxicity decide row by row; decontamination
drops all rows of a contaminated doc_id; rows without a doc_id are kept by both filters of ids. Null and
empty texts have no words, so they link with nothing and stay; very long texts are read whole; ties of a
group go to one row; an empty table passes all stages; a caller's other columns are handed on as they are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, ngram_join, secrets, toxicity
from plumbline.llm.queries import vocabulary_path
from plumbline.llm.store import bound_batches, materialize, table

#: The stages' own column beside a caller's, whatever those are named.
_MARK = "_pipeline_mark"


def drop_toxic(spark, docs, sf_dir):
    """Documents that the factorization machine scores at its threshold or above go."""
    bound_batches(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held))
    scored = toxicity.score(docs.withColumn("text", F.col("text").cast("string")), machine, _MARK)
    return scored.where(F.col(_MARK) < toxicity.THRESHOLD).select(docs.columns)


def keep_one_of_each_group(spark, docs, sf_dir):
    """Of the rows connected by links one stays: that of the least doc_id, and of rows that share it any one.

    Rows are numbered and linked by their numbers, so a doc_id on several rows joins no groups and loses none."""
    bound_batches(spark)
    rows = materialize(docs.withColumn(_MARK, F.monotonically_increasing_id()), "numbered")
    links = ngram_join.link_documents(rows.select(F.col(_MARK).alias("doc_id"), "text")).select(F.col("doc_id").alias(_MARK), "component_id")
    members = links.join(rows.where("doc_id is not null").select(_MARK, F.col("doc_id").alias("_id")), _MARK)
    best = members.groupBy("component_id").agg(F.min(F.struct("_id", _MARK))[_MARK].alias("_best"))
    others = members.join(best, "component_id").where(F.col(_MARK) != F.col("_best")).select(_MARK)
    return rows.join(others, _MARK, "left_anti").select(docs.columns)


def drop_contaminated(spark, docs, sf_dir):
    """Documents of which a twentieth of the words stand in benchmark passages go."""
    bound_batches(spark)
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.where("contaminated").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def redact_secrets(spark, docs, sf_dir):
    """Secrets become a mark and n_chars follows; every document stays."""
    bound_batches(spark)
    clean = secrets.redact(docs, secrets.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def encode(spark, docs, sf_dir):
    """Tokens of each document, and the digest of what they decode to."""
    bound_batches(spark)
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary_path(), "decoded")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", keep_one_of_each_group), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("tokens", encode)]
#: A trained model decides in two stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
