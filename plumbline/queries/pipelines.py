"""Sources, sinks and whole pipelines: S01, S03 to S09, S11, S13, A32, A34, A35, U02."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from .. import vocabulary as V
from ..fixtures import GRADES, claims, ratings, reports, table, workbook
from ..functions import text as T
from ..operators import agreement as G
from ..operators import metrics as M
from ..operators.resample import cluster_bootstrap
from ..sources import results as R
from ..sources import tables as S
from ..sources.tables import stored
from .agreement import _REP, _SEED, _alpha, _bootstrap_sql
from .metrics import _GRADERS, voted
from .registry import SQL, query
from .texts import _CLAIMS_OF, _FLAGS


@query("S01_metadata", "SELECT c_custkey AS study_id, 'p' || c_custkey::VARCHAR || '/s1/v.jpg' AS path, c_mktsegment AS sex, 'p' || c_custkey::VARCHAR AS patient_id FROM customer")
def s01(spark, sf):
    path = S.scratch(spark)
    raw = table(spark, sf, "customer").select(F.col("c_custkey").alias("StudyKey"), F.concat(F.lit("p"), F.col("c_custkey").cast("string"), F.lit("/s1/v.jpg")).alias("Path"), F.col("c_mktsegment").alias("Gender"))
    raw.write.option("header", True).csv(f"{path}/metadata.csv")
    return S.read_metadata(spark, path, Ty.StructType().add("StudyKey", "long").add("Path", "string").add("Gender", "string")).select("study_id", "path", "sex", "patient_id")


@query("S03_schema_adapter", "SELECT patient_id, text FROM reports UNION ALL SELECT patient_id, concat_ws(' ', text, sex) FROM reports", "reports")
def s03(spark, sf):
    rows = reports(spark, sf)
    a = S.adapt_schema(rows.select("patient_id", F.col("text").alias("report")))
    return a.unionByName(S.adapt_schema(rows.select(F.col("patient_id").alias("deid_patient_id"), F.col("text").alias("section_findings"), F.col("sex").alias("section_impression"))))


@query("S04_xml_reports", "SELECT report_id::VARCHAR AS uid, replace(replace(text, 'chest', 'redacted'), chr(10), ' ') AS findings, len(list_distinct(string_split(sex, '/')))::INT AS n_terms FROM reports", "reports")
def s04(spark, sf):
    path = S.scratch(spark)
    body = F.translate(F.regexp_replace("text", "chest", "XXXX"), "\n", " ")
    xml = F.concat(F.lit('<eCitation><uId id="'), F.col("report_id").cast("string"), F.lit('"/><MedlineCitation><Article><Abstract><AbstractText Label="FINDINGS">'), body, F.lit("</AbstractText></Abstract></Article></MedlineCitation><MeSH><major>"), F.col("sex"), F.lit("/x</major></MeSH></eCitation>"))
    reports(spark, sf).select(xml.alias("value")).write.text(path)
    return S.read_xml_reports(spark, path, False).select("uid", "findings", F.size("terms").alias("n_terms"))


_MAP = [("effusion", "Pleural Effusion"), ("pneumo", "Pneumothorax"), ("fracture", "Fracture")]
_NAMES = ("Pleural Effusion", "Pneumothorax", "Fracture", "No Finding")


@query("S05_term_labels", ", t AS (SELECT report_id, CASE WHEN line = 1 THEN 'normal' ELSE finding END AS t FROM claims), l AS (SELECT report_id, CASE WHEN t = 'normal' THEN 'No Finding' " + " ".join(f"WHEN contains(t, '{p}') THEN '{x}'" for p, x in _MAP) + " END AS l FROM t) SELECT report_id, " + ", ".join(f"max(coalesce((l = '{x}')::INT, 0)) AS \"{x}\"" for x in _NAMES) + " FROM l GROUP BY 1", "claims")
def s05(spark, sf):
    rows = claims(spark, sf).groupBy("report_id").agg(F.array_join(F.collect_list(F.when(F.col("line") == 1, "normal").otherwise(F.col("finding"))), ";").alias("terms"))
    return S.term_labels(rows, F.split("terms", ";"), _MAP, _NAMES)


@query("S06_nested_annotations", "SELECT CASE WHEN line % 2 = 0 THEN 'OBS-DP' ELSE 'ANAT-DP' END AS label, count(*) AS n FROM claims GROUP BY 1", "claims")
def s06(spark, sf):
    path = S.scratch(spark)
    rows = claims(spark, sf)
    entity = F.struct(F.col("finding").alias("tokens"), F.when(F.col("line") % 2 == 0, "OBS-DP").otherwise("ANAT-DP").alias("label"), F.lit(0).alias("start_ix"), F.lit(1).alias("end_ix"), F.array(F.array(F.lit("located_at"), F.lit("1"))).alias("relations"))
    doc = rows.groupBy("report_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("claim_id"), entity))).alias("entities"))
    doc.select(F.to_json(F.create_map(F.col("report_id").cast("string"), F.struct("entities"))).alias("value")).repartition("value").write.option("lineSep", "\n").text(path)
    entities, _ = S.read_annotations(spark, path)
    return entities.groupBy("label").agg(F.count("*").alias("n"))


@query("S07_scored_claims", "SELECT count(*) AS n, round(sum(score), 6) AS total FROM claims", "claims")
def s07(spark, sf):
    path = S.scratch(spark)
    part = claims(spark, sf).select("report_id", "claim", "pathology", F.col("patient_id").cast("string").alias("patient_id"), "label", "score")
    by = part.groupBy("report_id").agg(F.collect_list(F.struct("claim", "pathology", "patient_id", "label", "score")).alias("claims"))
    by.select(F.to_json(F.struct("claims")).alias("value")).write.option("compression", "gzip").text(path)  # a tenth of the disk; each file is one range
    return S.read_scored_claims(spark, path).agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("total"))


@query("S08_report_formats", "SELECT text FROM reports", "reports")
def s08(spark, sf):
    path = S.scratch(spark) + ".jsonl"
    reports(spark, sf).select(F.col("text").alias("report")).write.json(path)
    return S.read_reports(spark, path)


@query("S09_resolved_texts", "SELECT report_id, CASE WHEN report_id % 2 = 0 THEN text ELSE sex END AS text FROM reports", "reports")
def s09(spark, sf):
    rows = reports(spark, sf).withColumn("path", F.col("report_id").cast("string"))
    return S.resolve_text(rows.select("report_id", "path", F.when(F.col("report_id") % 2 == 0, F.col("text")).alias("inline")), rows.select("path", F.col("sex").alias("contents")), ("inline",)).select("report_id", "text")


@query("S11_per_claim_table", f"SELECT claim_id, array_to_string({_FLAGS}, ';') AS flags FROM workbook", "workbook")
def s11(spark, sf):
    path = S.scratch(spark)
    S.write_flat(workbook(spark, sf).select("claim_id", T.flags(F.col("claim")).alias("flags")), path, ("flags",))
    return spark.read.option("header", True).schema("claim_id string, flags string").option("nullValue", "\u0001").option("emptyValue", "").csv(path)


@query("S13_resumable_results", "SELECT CASE WHEN line % 2 = 0 THEN 'new' ELSE 'old' END AS run, count(*) AS n FROM claims GROUP BY 1", "claims")
def s13(spark, sf):
    rows = claims(spark, sf).select("claim_id", "line")
    root = S.scratch(spark)
    R.merge_results(rows.withColumn("run", F.lit("old")), root, "claim_id")
    R.merge_results(rows.where("line % 2 = 0").withColumn("run", F.lit("new")), root, "claim_id")
    return R.read_results(spark, root, rows.withColumn("run", F.lit("")).schema).groupBy("run").agg(F.count("*").alias("n"))


_GRAMS = " UNION ALL ".join(f"SELECT report_id, {n} AS n, '{s}' AS side, unnest(list_transform(range(1, len({s}) - {n - 2}), lambda i: array_to_string(list_slice({s}, i, i + {n - 1}), ' '))) AS g FROM w WHERE len({s}) >= {n}" for n in (1, 2, 3, 4) for s in ("ref", "hyp"))
_A32 = (
    f"{_CLAIMS_OF}, w AS (SELECT report_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ref, list_filter(string_split_regex(lower(array_to_string(a, ' ')), '[^a-z0-9]+'), lambda x: x <> '') AS hyp, len(a) AS n_claims FROM c), "
    f"gr AS ({_GRAMS}), cn AS (SELECT report_id, n, g, count(*) FILTER (side = 'hyp') AS h, count(*) FILTER (side = 'ref') AS r FROM gr GROUP BY ALL), pr AS (SELECT n, sum(least(h, r)) / sum(h) AS p FROM cn GROUP BY n), "
    "sz AS (SELECT sum(len(hyp)) AS h, sum(len(ref)) AS r, avg(n_claims) AS mean_claims FROM w) SELECT round(exp((SELECT avg(ln(p)) FROM pr)) * least(1.0, exp(1 - r / h)), 9) AS bleu, round(mean_claims, 9) AS mean_claims FROM sz"
)


@query("A32_extraction_fidelity", _A32, "reports")
def a32(spark, sf):
    """Corpus BLEU-4 of the joined claims against their report, and mean claims per report."""
    rows = reports(spark, sf).select("report_id", T.alnum_tokens(F.col("text")).alias("ref"), T.claims_of(F.col("text")).alias("c"))
    rows = rows.select("report_id", "ref", T.alnum_tokens(F.array_join("c", " ")).alias("hyp"), F.size("c").alias("n_claims"))
    rows = stored(rows)  # reports are put together and cut once
    precision = M.gram_matches(rows, "hyp", "ref").groupBy("n").agg((F.sum("matches") / F.sum("grams")).alias("p"))
    sizes = rows.agg(F.sum(F.size("hyp")).alias("h"), F.sum(F.size("ref")).alias("r"), F.avg("n_claims").alias("mean_claims"))
    score = precision.agg(F.exp(F.avg(F.when(F.col("p") > 0, F.log("p")).otherwise(float("-inf")))).alias("g"))
    return score.crossJoin(F.broadcast(sizes)).select(F.round(F.col("g") * F.least(F.lit(1.0), F.exp(1 - F.col("r") / F.col("h"))), 9).alias("bleu"), F.round("mean_claims", 9).alias("mean_claims"))


def _long_sql(block, name, columns, source):
    return " UNION ALL ".join(f"SELECT '{block}' AS block, {name} AS name, '{c}' AS metric, {c}::DOUBLE AS value FROM ({source})" for c in columns)


def _long(block, name, columns, rows):
    """(block, name, metric, value) of a table of measures."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns)))
    return rows.select(F.lit(block).alias("block"), name.alias("name"), each.alias("x")).select("block", "name", "x.*")


_SUITE = " UNION ALL ".join([
    _long_sql("hallucination", "'ALL'", ["precision", "recall", "f1", "accuracy"], SQL["A02_hallucination_metrics"]),
    _long_sql("laterality", "'ALL'", ["n", "rate"], SQL["A03_laterality_errors"]),
    _long_sql("discoveries", "'ALL'", ["n_green", "fdr", "green_share"], SQL["A04_fdr_among_green"]),
    _long_sql("calibration", "'ALL'", ["ece", "mce"], SQL["A10_calibration_error"]),
    _long_sql("bootstrap", "'fdr'", ["mean", "low", "high", "std"], SQL["B01_cluster_bootstrap"]),
    "SELECT 'category', pathology, 'fdr', count(*) FILTER (score >= 0.5e0 AND label = 1) / count(*) FILTER (score >= 0.5e0) FROM claims GROUP BY 2 HAVING count(*) FILTER (score >= 0.5e0) > 0",
])


@query("A34_full_suite", f"SELECT block, name, metric, round(value, 6) AS value FROM ({_SUITE})", "claims")
def a34(spark, sf):
    rows = stored(claims(spark, sf).select("claim", "label", "score", "pathology", "patient_id"))  # one join of the tables for all measures
    green, false = F.col("score") >= 0.5, F.col("label") == 1
    one = F.lit("ALL")
    parts = [
        _long("hallucination", one, ["precision", "recall", "f1", "accuracy"], M.binary_metrics(rows, F.col("score") < 0.4, F.col("label") != 0)),
        _long("laterality", one, ["n", "rate"], M.laterality_error_rate(rows)),
        _long("discoveries", one, ["n_green", "fdr", "green_share"], M.discoveries(rows, green)),
        _long("calibration", one, ["ece", "mce"], M.calibration_error(M.reliability(rows, F.col("score"), F.col("label") != 1))),
        _long("bootstrap", F.lit("fdr"), ["mean", "low", "high", "std"], cluster_bootstrap(rows, "patient_id", {"g": green.cast("int"), "f": (green & false).cast("int")}, F.col("f") / F.col("g"), _REP, _SEED)),
        _long("category", F.col("pathology"), ["fdr"], M.discoveries(rows, green, ["pathology"]).where("n_green > 0")),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("value", F.round("value", 6))


_RATED = "ratings AS (SELECT claim_id AS unit_id, coder, list_position([" + ", ".join(f"'{g}'" for g in GRADES) + "], g)::DOUBLE AS value FROM (" + " UNION ALL ".join(f"SELECT claim_id, '{c}' AS coder, {c} AS g FROM workbook" for c in _GRADERS) + ") WHERE g IS NOT NULL)"
_SILVER = " UNION ALL ".join([
    f"SELECT 'agreement' AS block, 'ALL' AS name, 'alpha' AS metric, alpha AS value FROM (WITH {_alpha('nominal')} SELECT alpha FROM al)",
    f"SELECT 'agreement', 'ALL', 'passes', (alpha >= 0.35e0)::INT::DOUBLE FROM (WITH {_alpha('nominal')} SELECT alpha FROM al)",
    _long_sql("agreement", "'ALL'", ["low", "high", "std"], f"WITH {_bootstrap_sql(10)[2:]}"),
    _long_sql("grader", "grader", ["n", "accuracy"], SQL["A22_grader_accuracy"]),
    _long_sql("majority", "majority", ["n"], SQL["A23_majority_distribution"]),
    _long_sql("score", "majority", ["n", "mean", "std", "low", "high"], SQL["A24_score_blocks"]),
    _long_sql("baseline", "'ALL'", ["n", "precision", "delta"], SQL["A25_baseline_precision"]),
    _long_sql("flags", "flag", ["n"], SQL["A26_flag_counts"]),
])


@query("A35_silver_compile", f", {_RATED} SELECT block, name, metric, round(value, 6) AS value FROM ({_SILVER})", "workbook")
def a35(spark, sf):
    """Majority, agreement with its interval and gate, graders against the majority, scores, baseline and flags in one table."""
    kept = ["claim_id", "claim", "score", *_GRADERS]
    rows = stored(voted(spark, sf).select(*kept, "majority"))
    place = F.array_position(F.array(*map(F.lit, GRADES)), F.col("g")).cast("double")
    ratings_ = rows.unpivot(["claim_id"], _GRADERS, "coder", "g").where("g is not null").select(F.col("claim_id").alias("unit_id"), "coder", place.alias("value"))
    alpha = G.krippendorff(ratings_, "nominal").withColumn("passes", (F.col("alpha") >= 0.35).cast("int"))
    one = F.lit("ALL")
    given = rows.unpivot(["majority"], _GRADERS, "grader", "given").where(F.col("given").isin(*GRADES))
    hit = F.avg((F.col("majority") == "SUPPORTED").cast("double"))
    flags = rows.select(F.explode(T.flags(F.col("claim"))).alias("flag"))
    parts = [
        _long("agreement", one, ["alpha", "passes"], alpha),
        _long("agreement", one, ["low", "high", "std"], G.bootstrap_alpha(ratings_, "nominal", 10, _SEED)),
        _long("grader", F.col("grader"), ["n", "accuracy"], given.groupBy("grader").agg(F.count("*").alias("n"), F.avg((F.col("given") == F.col("majority")).cast("double")).alias("accuracy"))),
        _long("majority", F.col("majority"), ["n"], M.with_dimension(rows, "majority", GRADES, F.count("*").alias("n")).na.fill(0, ["n"])),
        _long("score", F.col("majority"), ["n", "mean", "std", "low", "high"], M.score_block(rows, "majority", GRADES, "score")),
        _long("baseline", one, ["n", "precision", "delta"], rows.where("score >= 0.5").agg(F.count("*").alias("n"), hit.alias("precision"), (hit - 0.73).alias("delta"))),
        _long("flags", F.col("flag"), ["n"], M.with_dimension(flags, "flag", tuple(V.FLAGS), F.count("*").alias("n")).na.fill(0, ["n"])),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("value", F.round("value", 6))


@query("U02_extractors", _CLAIMS_OF + " SELECT 'claims' AS extractor, count(*) AS n, sum(len(a))::BIGINT AS n_claims, sum(list_sum(list_transform(a, lambda x: length(x))))::BIGINT AS n_letters FROM c GROUP BY 1", "reports")
def u02(spark, sf):
    hooks = {"claims": T.claims_of}
    out = [reports(spark, sf).select(F.lit(name).alias("extractor"), hook(F.col("text")).alias("c")) for name, hook in hooks.items()]
    letters = F.aggregate("c", F.lit(0), lambda a, x: a + F.length(x))
    return reduce(DataFrame.unionByName, out).groupBy("extractor").agg(F.count("c").alias("n"), F.sum(F.size("c")).alias("n_claims"), F.sum(letters).alias("n_letters"))


@query("A17_by_group", ", rt AS (SELECT *, unit_id % 3 AS part FROM ratings), " + _alpha("nominal", "rt", "part") + " SELECT part, round(alpha, 9) AS alpha FROM al", "ratings")
def a17_groups(spark, sf):
    rows = ratings(spark, sf).withColumn("part", F.col("unit_id") % 3)
    return G.krippendorff(rows, "nominal", ["part"]).withColumn("alpha", F.round("alpha", 9))


