"""Summaries by group, acceptance panels, look-ups and merges of evidence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.operators import fusion, integrated, metrics, seals, serving, strict
from docassay.plans import projections as P
from docassay.plans.registry import query

KIND = "CASE d.doc_id % 10 WHEN 0 THEN 'local_cover_overlay' WHEN 1 THEN 'page_splice' WHEN 2 THEN 'stamp_paste' WHEN 3 THEN 'font_mismatch' WHEN 4 THEN 'amount_edit' ELSE 'noise_patch' END"
#: Scored documents; three of seven are fakes whose file tells the kind of tampering.
SCORED = f"""
SELECT printf('doc_%06d', d.doc_id) AS document_id, CASE WHEN d.doc_id % 7 < 3 THEN 'fake' WHEN d.doc_id % 17 = 0 THEN 'uploaded' ELSE 'normal' END AS label, {P.TYPE_OF.format("d.doc_id")} AS doc_type,
  CASE WHEN d.doc_id % 7 < 3 THEN concat('/data/made/synthetic_fake_', lpad(CAST(d.doc_id AS STRING), 4, '0'), '_', {KIND}, '.pdf') ELSE concat('/data/', d.source, '/', CAST(d.doc_id AS STRING), '.pdf') END AS path,
  CAST((d.n_chars * 7 + d.doc_id * 13) % 60 AS INT) AS marker_free_risk_score, CASE WHEN d.doc_id % 5 = 0 THEN '' WHEN d.doc_id % 5 = 1 THEN 'v2' ELSE 'v3' END AS scoring_version,
  CASE WHEN d.doc_id % 23 = 0 THEN concat('timeout: ', CAST(d.doc_id AS STRING)) WHEN d.doc_id % 29 = 0 THEN 'unreadable' ELSE '' END AS error
FROM {{documents}} d
"""
S = P.oracle(SCORED)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.spark_sql(spark, sf_dir, SCORED)


@query(f"WITH s AS ({S}) SELECT regexp_extract(path, 'synthetic_fake_[0-9]+_([^/]+)[.]pdf$', 1) AS kind, count(*) AS documents FROM s WHERE label = 'fake' GROUP BY 1")
def tamper_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of tampering was made."""
    rows = scored(spark, sf_dir).where("label = 'fake'").select(metrics.tamper_kind(F.col("path")).alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("documents"))


@query(f"""WITH s AS ({S}), k AS (SELECT *, regexp_extract(path, 'synthetic_fake_[0-9]+_([^/]+)[.]pdf$', 1) AS kind FROM s WHERE label IN ('fake', 'normal')),
p AS (SELECT 0 AS place, 'pdf_tamper' AS key, * FROM k WHERE label = 'normal' OR kind IN ('local_cover_overlay', 'screenshot_to_pdf', 'page_splice', 'text_layer_mismatch', 'font_mismatch', 'noise_patch', 'signature_paste')
  UNION ALL SELECT 1, 'fake_seal', * FROM k WHERE label = 'normal' OR kind = 'stamp_paste' UNION ALL SELECT 2, 'ps_invoice', * FROM k WHERE doc_type = 'invoice' UNION ALL SELECT 3, 'credit_report', * FROM k WHERE doc_type = 'credit_report'),
c AS (SELECT place, key, count(*) AS n, count(*) FILTER (label = 'fake' AND marker_free_risk_score >= 25) AS tp, count(*) FILTER (label = 'normal' AND marker_free_risk_score >= 25) AS fp, count(*) FILTER (label = 'normal' AND marker_free_risk_score < 25) AS tn, count(*) FILTER (label = 'fake' AND marker_free_risk_score < 25) AS fn FROM p GROUP BY 1, 2
  UNION ALL SELECT 4, 'similar_image', 0, 0, 0, 0, 0),
r AS (SELECT *, CASE WHEN tp + fn = 0 OR fp + tn = 0 THEN 'unavailable' WHEN least(tp + fn, fp + tn) < 20 THEN 'insufficient' ELSE 'diagnostic' END AS status FROM c)
SELECT place, key, status, n AS sample_count, tp, fp, tn, fn, CASE WHEN status <> 'unavailable' THEN round_even((tp + tn) / n, 6) END AS accuracy, CASE WHEN status <> 'unavailable' THEN coalesce(round_even(tp / nullif(tp + fp, 0), 6), 0) END AS precision,
  CASE WHEN status <> 'unavailable' THEN coalesce(round_even(tp / nullif(tp + fn, 0), 6), 0) END AS recall, CASE WHEN status <> 'unavailable' THEN coalesce(round_even(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0) END AS f1 FROM r""")
def acceptance_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of five business panels, with whether there are samples enough."""
    out = metrics.acceptance_panels(scored(spark, sf_dir))
    return out.withColumns({c: F.bround(c, 6) for c in ("accuracy", "precision", "recall", "f1")})


@query(f"""WITH s AS ({S}), l AS (SELECT * FROM s WHERE label IN ('fake', 'normal')), d AS (SELECT count(*) AS n, sha256(string_agg(document_id || '|' || label || '|' || doc_type || '|' || path, chr(10) ORDER BY document_id)) AS h FROM l)
SELECT n AS sample_count, 'labeled-' || n || '-' || substr(h, 1, 12) AS dataset_version, (SELECT scoring_version FROM l WHERE scoring_version <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS scoring_version FROM d""")
def evaluation_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was evaluated: a version by the digest of all labelled identities, and the commonest scoring version."""
    return metrics.provenance(scored(spark, sf_dir))


@query(f"WITH v AS ({P.oracle(P.VISUAL)}) SELECT label, doc_type, count(*) AS pages, count(DISTINCT document_id) AS documents, round_even(avg(ela + edge), 4) AS mean_visual_score, count(*) FILTER (ela > 20) AS errors FROM v GROUP BY 1, 2")
def visual_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, documents, mean score and error rows of each label and type."""
    v = P.spark_sql(spark, sf_dir, P.VISUAL)
    return v.groupBy("label", "doc_type").agg(F.count("*").alias("pages"), F.countDistinct("document_id").alias("documents"), F.bround(F.avg(F.col("ela") + F.col("edge")), 4).alias("mean_visual_score"), F.count_if(F.col("ela") > 20).alias("errors"))


@query(f"WITH s AS ({S}), o AS ({P.oracle(P.OCR)}) SELECT label, count(*) AS documents, round_even(avg(mean_confidence), 4) AS mean_confidence, count(*) FILTER (word_count = 0) AS textless FROM o JOIN s USING (document_id) GROUP BY 1")
def ocr_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised documents, mean confidence and those without text, by label."""
    rows = P.ocr(spark, sf_dir).drop("label").join(scored(spark, sf_dir).select("document_id", "label"), "document_id")
    return rows.groupBy("label").agg(F.count("*").alias("documents"), F.bround(F.avg("mean_confidence"), 4).alias("mean_confidence"), F.count_if(F.col("word_count") == 0).alias("textless"))


@query(f"WITH s AS ({S}) SELECT trim(split_part(error, ':', 1)) AS error, count(*) AS n FROM s WHERE error <> '' GROUP BY 1 ORDER BY n DESC, error LIMIT 30")
def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest errors by what stands before the colon."""
    rows = scored(spark, sf_dir).where("error <> ''").select(F.trim(F.substring_index("error", ":", 1)).alias("error"))
    return rows.groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(30)


@query(f"WITH s AS ({S}), p AS (SELECT doc_type, CASE WHEN marker_free_risk_score < 20 THEN doc_type ELSE 'other' END AS predicted FROM s), k AS (SELECT doc_type AS c FROM p UNION SELECT predicted FROM p), m AS (SELECT c, count(*) FILTER (doc_type = c) AS support, count(*) FILTER (predicted = c) AS given, count(*) FILTER (doc_type = c AND predicted = c) AS hits FROM k, p GROUP BY 1) SELECT count(*) AS classes, round_even(avg(round_even(hits / support, 6)), 6) AS macro_recall, round_even(avg(round_even(2 * hits / (support + given), 6)), 6) AS macro_f1 FROM m WHERE support > 0")
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of recall and F1 over the classes that occur."""
    rows = scored(spark, sf_dir).withColumn("predicted", F.when(F.col("marker_free_risk_score") < 20, F.col("doc_type")).otherwise("other"))
    return metrics.macro(metrics.multiclass(rows, "doc_type", "predicted"))


@query(f"WITH s AS ({S}), p AS (SELECT label, CASE WHEN marker_free_risk_score >= 25 THEN 'fake' ELSE 'normal' END AS predicted FROM s) SELECT label, count(*) FILTER (predicted = 'fake') AS fake, count(*) FILTER (predicted = 'normal') AS normal FROM p GROUP BY 1")
def confusion_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against predictions."""
    rows = scored(spark, sf_dir).withColumn("predicted", F.when(F.col("marker_free_risk_score") >= 25, "fake").otherwise("normal"))
    return metrics.confusion_table(rows, "label", "predicted", ["fake", "normal"])


@query(f"WITH s AS ({S}), n AS (SELECT doc_type, count(*) AS n FROM s GROUP BY 1) SELECT document_id, doc_type, round_even(pow(n, -0.5E0), 9) AS weight FROM s JOIN n USING (doc_type)")
def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of rows in sampling, by the inverse root of their class's count."""
    rows = metrics.sample_weights(scored(spark, sf_dir).select("document_id", "doc_type"), "doc_type", 0.5)
    return rows.select("document_id", "doc_type", F.bround("weight", 9).alias("weight"))


@query(f"WITH s AS ({S}), k AS ({P.oracle(P.MARKER)}) SELECT document_id, doc_type FROM s JOIN k USING (document_id) WHERE label = 'normal' AND marker_flag = 1 ORDER BY document_id LIMIT 10")
def marker_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten normal documents that carry a marker."""
    both = scored(spark, sf_dir).join(P.spark_sql(spark, sf_dir, P.MARKER).select("document_id", "marker_flag"), "document_id")
    return both.where("label = 'normal' AND marker_flag = 1").select("document_id", "doc_type").orderBy("document_id").limit(10)


@query(f"WITH s AS ({S}) SELECT document_id, path FROM s WHERE doc_type = 'credit_report' AND NOT regexp_matches(path, '/synthetic_fake_[^/]*$') ORDER BY document_id LIMIT 40")
def genuine_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty credit reports that were not made for tests, sorted by id."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = scored(spark, sf_dir).where((F.col("doc_type") == "credit_report") & ~name.startswith("synthetic_fake_"))
    return rows.select("document_id", "path").orderBy("document_id").limit(40)


@query(f"WITH s AS ({S}) SELECT document_id, marker_free_risk_score FROM s WHERE marker_free_risk_score >= 30 ORDER BY marker_free_risk_score DESC, document_id LIMIT 500")
def limited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The riskiest documents, as many as are shown where nobody asks for a number."""
    rows = scored(spark, sf_dir).where("marker_free_risk_score >= 30").orderBy(F.desc("marker_free_risk_score"), "document_id")
    return serving.limited(rows.select("document_id", "marker_free_risk_score"), "many")


#: Extracted fields as JSON; braces are spelled out, as they mark tables here.
PEOPLE = """
SELECT printf('doc_%06d', o_orderkey * 2) AS document_id, concat(o, '"Seller_Name": " Firm ', CAST(o_custkey AS STRING), '", "items": [', o, '"payee": "Firm ', CAST(o_custkey + 1 AS STRING), '"', c, ', ', o, '"price": "12"', c, ', ', o, '"payee": "Firm ', CAST(o_custkey AS STRING), '"', c, '], "note": "x", "buyer": "B"', c) AS fields
FROM (SELECT o_orderkey, o_custkey, chr(123) AS o, chr(125) AS c FROM {orders}) x
"""


@query(f"WITH v AS ({P.oracle(P.VISUAL)}), t AS ({P.oracle(PEOPLE)}) SELECT v.document_id, v.page, v.seal_class, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(t.fields, ''), 'Firm [0-9]+'))), '|') AS entities FROM v LEFT JOIN t USING (document_id)")
def visual_with_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual rows with the names in their document's fields; the fields are read once a document, not once a page."""
    t = P.spark_sql(spark, sf_dir, PEOPLE).select("document_id", seals.entities_of(F.col("fields")).alias("names"))
    v = P.spark_sql(spark, sf_dir, P.VISUAL).select("document_id", "page", "seal_class")
    return v.join(t, "document_id", "left").select("document_id", "page", "seal_class", F.array_join(F.array_sort(F.coalesce("names", F.array().cast("array<string>"))), "|").alias("entities"))


OWN = """SELECT CAST(c_custkey AS STRING) AS source_id, CAST(k AS INT) AS place, CAST(c_custkey % 5 + k AS INT) AS pages, CAST(c_custkey % 3 AS INT) AS large_images, CAST(k AS INT) AS font_objects, concat('text ', CAST(c_custkey * 10 + k AS STRING)) AS ocr_text, k AS copy FROM {customer} CROSS JOIN (VALUES (1), (2)) AS x(k)"""


@query("SELECT CAST(c_custkey AS VARCHAR) AS source_id, CASE WHEN c_custkey % 4 <> 0 THEN 'text ' || (c_custkey * 10 + 2) END AS ocr_text, CAST(c_custkey % 5 + 2 AS INTEGER) AS pages, CAST(c_custkey % 3 AS INTEGER) AS large_images, CAST(2 AS INTEGER) AS font_objects FROM customer")
def reports_with_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with the last recognised text and the last structure of their file; one without structure is an error."""
    own = P.spark_sql(spark, sf_dir, OWN)
    return strict.with_objects(own.where("copy = 1").select("source_id"), own, own.where("source_id % 4 <> 0"))


@query("""WITH e AS (SELECT conv_id * 4 AS n FROM conversations GROUP BY 1), t AS (SELECT doc_id AS n FROM documents)
SELECT printf('doc_%06d', 12) AS document_id, 'invoice' AS doc_type, 'A' AS number, '9' AS total, 'yes' AS seen WHERE EXISTS (FROM t WHERE n = 12) AND EXISTS (FROM e WHERE n = 12)""")
def one_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is known of one document, its recognised fields over those of its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.format_string("doc_%06d", "doc_id").alias("document_id"), F.expr(P.TYPE_OF.format("doc_id")).alias("doc_type"), F.lit('{"number": "A", "total": "5"}').alias("extracted_fields_json"))
    ocr = P.ocr(spark, sf_dir).select("document_id", "doc_type", F.lit('{"total": "9", "seen": "yes"}').alias("ocr_fields_json"))
    found = integrated.one_document(P.pdf(spark, sf_dir).select("document_id", "doc_type"), P.spark_sql(spark, sf_dir, P.VISUAL).select("document_id", "ela").limit(1), docs, ocr, "doc_000012")
    return found.select("document_id", "doc_type", *(F.col("fields")[k].alias(k) for k in ("number", "total", "seen")))


@query(f"WITH s AS ({S}), k AS ({P.oracle(P.MARKER)}), q AS ({P.oracle(P.QWEN)}) SELECT s.document_id, s.label, coalesce(k.marker_flag, 0) AS marker_flag, q.qwen_fx_risk_score, CASE WHEN q.document_id IS NOT NULL THEN 'model' ELSE s.scoring_version END AS scoring_version FROM s LEFT JOIN k USING (document_id) LEFT JOIN q USING (document_id)")
def dashboard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document rows with what other tables know of them; a later table's value goes before an earlier one."""
    base = scored(spark, sf_dir).select("document_id", "label", "scoring_version", F.lit(0).alias("marker_flag"))
    marker = P.spark_sql(spark, sf_dir, P.MARKER).select("document_id", "marker_flag")
    model = P.spark_sql(spark, sf_dir, P.QWEN).select("document_id", "qwen_fx_risk_score", F.lit("model").alias("scoring_version"))
    return serving.merged(base, "document_id", marker, model).select("document_id", "label", "marker_flag", "qwen_fx_risk_score", "scoring_version")


@query(f"""WITH s AS ({S}), f AS (SELECT label = 'fake' AS y, CAST(marker_free_risk_score AS DOUBLE) AS score, CAST(length(path) AS DOUBLE) AS path_length, CAST(length(error) AS DOUBLE) AS error_length FROM s WHERE label IN ('fake', 'normal')),
w AS (SELECT 'score' AS feature, (avg(score) FILTER (y) - avg(score) FILTER (NOT y)) / stddev_pop(score) AS weight FROM f UNION ALL SELECT 'path_length', (avg(path_length) FILTER (y) - avg(path_length) FILTER (NOT y)) / stddev_pop(path_length) FROM f UNION ALL SELECT 'error_length', (avg(error_length) FILTER (y) - avg(error_length) FILTER (NOT y)) / stddev_pop(error_length) FROM f)
SELECT CAST(row_number() OVER (ORDER BY abs(weight) DESC, feature) AS INTEGER) AS rank, feature, round_even(weight, 6) AS weight FROM w""")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by how far they part fakes from normal documents, in deviations."""
    from docassay.operators.learning import importance

    rows = scored(spark, sf_dir).where("label in ('fake', 'normal')").selectExpr("label = 'fake' AS y", "double(marker_free_risk_score) AS score", "double(length(path)) AS path_length", "double(length(error)) AS error_length")
    return importance(rows, "y", ["score", "path_length", "error_length"])


@query(f"WITH s AS ({S}) SELECT document_id, left(path, 24) AS path, left(error, 9) AS error FROM s")
def truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to what is shown."""
    return scored(spark, sf_dir).select("document_id", F.left("path", F.lit(24)).alias("path"), F.left("error", F.lit(9)).alias("error"))


@query(f"WITH m AS ({P.oracle(P.MANIFEST)}), p AS ({P.oracle(P.PDF)}) SELECT (SELECT count(*) FROM m) AS documents, (SELECT count(*) FROM p) AS pdf_rows, (SELECT count(*) FROM p WHERE document_id IN (SELECT document_id FROM m)) AS known")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a run, as a summary file holds them."""
    m, p = P.manifest(spark, sf_dir).select("document_id"), P.pdf(spark, sf_dir).select("document_id")
    known = p.join(m.distinct(), "document_id", "left_semi").agg(F.count("*").alias("known"))
    return m.agg(F.count("*").alias("documents")).join(F.broadcast(p.agg(F.count("*").alias("pdf_rows")))).join(F.broadcast(known))  # one row each
