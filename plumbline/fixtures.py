"""Views of the input tables in the shapes that the operators take, and the same views as SQL.

The expressions below are read by both engines; only hashing is written twice."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FINDING = "CASE p_type WHEN 'STANDARD' THEN 'pleural effusion' WHEN 'MEDIUM' THEN 'pneumothorax' WHEN 'LARGE' THEN 'consolidation' WHEN 'SMALL' THEN 'atelectasis' WHEN 'ECONOMY' THEN 'cardiomegaly' ELSE 'rib fracture' END"
_SEVERITY = "CASE l_suppkey % 3 WHEN 0 THEN 'mild' WHEN 1 THEN 'moderate' ELSE 'severe' END"
_OTHER_SEVERITY = "CASE l_suppkey % 3 WHEN 0 THEN 'severe' WHEN 1 THEN 'marked' ELSE 'mild' END"
_SIDE = "CASE l_partkey % 2 WHEN 0 THEN 'left' ELSE 'right' END"
_OTHER_SIDE = "CASE l_partkey % 2 WHEN 0 THEN 'right' ELSE 'left' END"
_REGION = "CASE l_partkey % 3 WHEN 0 THEN 'in the lower lobe' WHEN 1 THEN 'in the upper lobe' ELSE 'at the base' END"
_EXTRA = "CASE l_orderkey % 6 WHEN 0 THEN ' compared to the prior study' WHEN 1 THEN ' measuring 3 mm' WHEN 2 THEN ', unchanged since yesterday' WHEN 3 THEN ' with a chest tube in good position' WHEN 4 THEN ', seen on 03/04/2021' ELSE '' END"
_LABEL = "CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE 2 END"


def _sentence(no: str, severity: str, side: str) -> str:
    return f"concat('There is {no} ', {severity}, ' ', {side}, ' ', {_FINDING}, ' ', {_REGION}, {_EXTRA}, '.')"


_EVIDENCE = _sentence("a", _SEVERITY, _SIDE)
_CLAIM = f"CASE WHEN l_returnflag <> 'R' THEN {_EVIDENCE} WHEN l_linenumber % 3 = 0 THEN {_sentence('a', _SEVERITY, _OTHER_SIDE)} WHEN l_linenumber % 3 = 1 THEN {_sentence('a', _OTHER_SEVERITY, _SIDE)} ELSE {_sentence('no', _SEVERITY, _SIDE)} END"

#: Columns of the claims view before hashing.
_COLUMNS = {
    "claim_id": "concat_ws('-', CAST(l_orderkey AS {text}), CAST(l_linenumber AS {text}), CAST(l_partkey AS {text}), CAST(l_suppkey AS {text}))",
    "report_id": "l_orderkey",
    "patient_id": "o_custkey",
    "study_date": "o_orderdate",
    "sex": "c_mktsegment",
    "priority": "o_orderpriority",
    "pathology": "p_type",
    "brand": "p_brand",
    "label": _LABEL,
    "evidence_source_type": "CASE l_linenumber % 4 WHEN 0 THEN 'oracle_report_text' WHEN 1 THEN 'retrieved_report_text' WHEN 2 THEN 'generator_output' ELSE 'unknown' END",
    "claim_generator_id": "CASE WHEN l_suppkey % 7 <> 0 THEN concat('g', CAST(l_suppkey % 3 AS {text})) END",
    "evidence_generator_id": "CASE WHEN l_suppkey % 7 <> 0 THEN concat('g', CAST(l_partkey % 3 AS {text})) END",
    "claim": _CLAIM,
    "evidence_text": _EVIDENCE,
    "line": "l_linenumber",
    "finding": _FINDING,
}
_SCORE = "CASE WHEN label = 1 THEN 0.6e0 * u ELSE 0.35e0 + 0.65e0 * u END"


def uniform(seed: int, *keys) -> F.Column:
    """A uniform in [0, 1) from a seed and key columns, the same on any engine and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *keys)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def digits(seed: int, *keys) -> F.Column:
    """The eight hex digits of uniform(seed, *keys): they sort as the numbers do and take a fraction of the time."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *keys)), 1, 8)


def uniform_at_least(share: float, seed: int, *keys) -> F.Column:
    """uniform(seed, *keys) >= share, without making the number: the hash is compared with the share's own digits."""
    least = max(0, math.ceil(Fraction(share) * 2**32))
    if least >= 2**32:
        return F.lit(False)
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *keys)) >= f"{least:08x}"


def uniform_sql(seed: int, *keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 8))::BIGINT / 4294967296.0e0)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored claims: one row per order line, with report, patient, category, label, score, provenance and texts."""
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "part", "customer")}
    joined = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["part"], F.col("l_partkey") == F.col("p_partkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    rows = joined.select(*(F.expr(e.format(text="string")).alias(n) for n, e in _COLUMNS.items()))
    rows = rows.withColumn("u", uniform(42, F.col("claim_id"))).withColumn("score", F.expr(_SCORE))
    return rows.withColumn("evidence", F.array("evidence_text"))


CLAIMS_SQL = "claims AS (SELECT *, [evidence_text] AS evidence, {score} AS score FROM (SELECT *, {u} AS u FROM (SELECT {cols} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey)))".format(
    score=_SCORE, u=uniform_sql(42, "claim_id"), cols=", ".join(f"{e.format(text='VARCHAR')} AS {n}" for n, e in _COLUMNS.items())
)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report texts: the sentences of a report's claims under FINDINGS, the first again under IMPRESSION for even reports."""
    rows = claims(spark, sf_dir).groupBy("report_id").agg(F.min("patient_id").alias("patient_id"), F.min("study_date").alias("study_date"), F.min("sex").alias("sex"), F.array_sort(F.collect_list("claim")).alias("c"))
    body = F.array_join("c", " ")
    text = F.when(F.col("report_id") % 3 == 0, F.concat(F.lit("FINDINGS: "), body)).when(F.col("report_id") % 3 == 1, F.concat(F.lit("FINDINGS: "), body, F.lit("\nIMPRESSION: "), F.col("c")[0])).otherwise(body)
    return rows.select("report_id", "patient_id", "study_date", "sex", text.alias("text"))


REPORTS_SQL = """reports AS (SELECT report_id, patient_id, study_date, sex, CASE report_id % 3 WHEN 0 THEN 'FINDINGS: ' || body WHEN 1 THEN 'FINDINGS: ' || body || chr(10) || 'IMPRESSION: ' || first ELSE body END AS text FROM (
  SELECT report_id, min(patient_id) AS patient_id, min(study_date) AS study_date, min(sex) AS sex, string_agg(claim, ' ' ORDER BY claim) AS body, min(claim) AS first FROM claims GROUP BY report_id))"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents of more than 20 letters: passage_id, source, text."""
    parts = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return parts.where(F.length("text") > 20).select(F.concat(F.col("doc_id").cast("string"), F.lit("_s"), F.col("pos").cast("string")).alias("passage_id"), "source", "text")


PASSAGES_SQL = "passages AS (SELECT doc_id::VARCHAR || '_s' || (pos - 1)::VARCHAR AS passage_id, source, text FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE length(text) > 20)"


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of documents by three coders, the third 1 to 4 with gaps: unit_id, coder, value."""
    own = table(spark, sf_dir, "labels")
    u = uniform(7, F.col("doc_id").cast("string"))
    third = F.when(u < 0.8, F.floor(u * 5) % 2)
    rows = own.select("doc_id", F.explode(F.array(F.struct(F.lit("a").alias("coder"), F.col("quality").cast("double").alias("value")), F.struct(F.lit("b").alias("coder"), F.when(u < 0.9, F.col("toxic").cast("double")).alias("value")), F.struct(F.lit("c").alias("coder"), third.cast("double").alias("value")))).alias("x"))
    return rows.select(F.col("doc_id").alias("unit_id"), "x.coder", "x.value").where("value is not null")


RATINGS_SQL = f"ratings AS (SELECT * FROM (SELECT doc_id AS unit_id, 'a' AS coder, quality::DOUBLE AS value FROM labels UNION ALL SELECT doc_id, 'b', CASE WHEN {uniform_sql(7, 'doc_id::VARCHAR')} < 0.9e0 THEN toxic::DOUBLE END FROM labels UNION ALL SELECT doc_id, 'c', CASE WHEN {uniform_sql(7, 'doc_id::VARCHAR')} < 0.8e0 THEN (floor({uniform_sql(7, 'doc_id::VARCHAR')} * 5) % 2)::DOUBLE END FROM labels) WHERE value IS NOT NULL)"

#: The five labels of the workbook in their order.
GRADES = ("SUPPORTED", "CONTRADICTED", "NOVEL_PLAUSIBLE", "NOVEL_HALLUCINATED", "UNCERTAIN")


def _grade(seed: int) -> str:
    """An index into GRADES: usually by the claim's label, sometimes by chance."""
    return f"CASE WHEN v{seed} < 0.7e0 THEN CASE label WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END ELSE CAST(floor((v{seed} - 0.7e0) / 0.3e0 * 5) AS INT) END"


def workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded claims: all claims with three graders' labels and confidences, and a person's."""
    rows = claims(spark, sf_dir)
    for k in (11, 12, 13, 14):
        rows = rows.withColumn(f"v{k}", uniform(k, F.col("claim_id")))
    names = F.array(*map(F.lit, GRADES))
    for k, g in ((11, "grader_a_label"), (12, "grader_b_label"), (13, "grader_c_label"), (14, "user_label")):
        rows = rows.withColumn(g, F.get(names, F.least(F.expr(_grade(k)), F.lit(4))))
    rows = rows.withColumn("user_label", F.when(F.col("v14") < 0.95, F.col("user_label")))
    return rows.withColumn("image_file", F.concat(F.lit("p"), F.col("patient_id").cast("string"), F.lit("_"), F.col("report_id").cast("string"), F.lit(".png")))


WORKBOOK_SQL = "workbook AS (SELECT * REPLACE (CASE WHEN v14 < 0.95e0 THEN user_label END AS user_label) FROM (SELECT *, {g}, 'p' || patient_id::VARCHAR || '_' || report_id::VARCHAR || '.png' AS image_file FROM (SELECT *, {v} FROM claims)))".format(
    v=", ".join(f"{uniform_sql(k, 'claim_id')} AS v{k}" for k in (11, 12, 13, 14)),
    g=", ".join(f"[{', '.join(repr(x) for x in GRADES)}][least({_grade(k)}, 4) + 1] AS {n}" for k, n in ((11, "grader_a_label"), (12, "grader_b_label"), (13, "grader_c_label"), (14, "user_label"))),
)

VIEWS = {"claims": ((), CLAIMS_SQL), "reports": (("claims",), REPORTS_SQL), "passages": ((), PASSAGES_SQL), "ratings": ((), RATINGS_SQL), "workbook": (("claims",), WORKBOOK_SQL)}


def with_views(body: str, *names: str) -> str:
    """SQL that sees the named views; body may start with `, more AS (...)`."""
    needed: list[str] = []
    for n in names:
        for x in (*VIEWS[n][0], n):
            if x not in needed:
                needed.append(x)
    head = ",\n".join(VIEWS[x][1] for x in needed)
    body = body.strip()
    return f"WITH {head}{'' if body.startswith(',') else chr(10)}{body}" if needed else (f"WITH {body[1:]}" if body.startswith(",") else body)
