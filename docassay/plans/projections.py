"""The driver tables seen as evidence tables. Each projection is one SQL text that Spark and the oracle both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.functions.text import ACCOUNT_STRICT
from docassay.operators.layout import repeated_lines, word_counts
from docassay.operators.rules import object_rules, ocr_rules, reasons_of, score_of, text_rules, visual_rules

TYPE_OF = "CASE {0} % 6 WHEN 0 THEN 'invoice' WHEN 1 THEN 'contract' WHEN 2 THEN 'bank_page' WHEN 3 THEN 'credit_report' WHEN 4 THEN 'settlement_statement' ELSE 'other' END"

MANIFEST = f"""
SELECT printf('doc_%06d', d.doc_id) AS document_id, d.doc_id AS n,
  CASE WHEN l.toxic = 1 THEN 'fake' WHEN l.toxic = 0 THEN 'normal' ELSE 'uploaded' END AS label,
  {TYPE_OF.format("d.doc_id")} AS doc_type, '.pdf' AS ext, d.n_chars AS size_bytes,
  concat('/data/', d.source, '/', CAST(d.doc_id AS STRING), '.pdf') AS path
FROM {{documents}} d LEFT JOIN {{labels}} l ON d.doc_id = l.doc_id
"""

PDF = f"""
SELECT printf('doc_%06d', page_id * 3) AS document_id,
  CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'fake' ELSE 'normal' END AS label,
  {TYPE_OF.format("(page_id * 3)")} AS doc_type,
  concat('/data/', CASE WHEN page_id % 10 = 0 THEN 'moved' ELSE 'kept' END, '/', CAST(page_id * 3 + CASE WHEN page_id % 9 = 0 THEN 1 ELSE 0 END AS STRING), '.pdf') AS path,
  CASE page_id % 5 WHEN 0 THEN 'CamScanner' WHEN 1 THEN '' ELSE 'Writer' END AS creator,
  CASE page_id % 5 WHEN 1 THEN '' ELSE 'Press' END AS producer,
  CAST(1 + page_id % 3 AS INT) AS pages, CAST(page_id % 4 AS INT) AS large_image_count,
  CAST((length(html) - length(replace(html, '<p>', ''))) / 3 AS INT) AS image_count,
  CAST(floor((length(html) - length(replace(html, '<p>', ''))) / 6) AS INT) AS small_overlay_count,
  CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS smask_count, CASE WHEN page_id % 11 = 0 THEN 1 ELSE 0 END AS font_warning_count,
  CAST(1 + page_id % 3 AS INT) AS incremental_update_count, CASE WHEN page_id % 13 = 0 THEN 1 ELSE 0 END AS javascript_count,
  CASE WHEN page_id % 17 = 0 THEN 1 ELSE 0 END AS embedded_file_count,
  CASE WHEN page_id % 2 = 0 THEN 0 ELSE CAST(floor(length(html) / 40) AS INT) END AS font_object_count,
  CASE WHEN page_id % 9 = 0 THEN 1 ELSE 0 END AS acroform_count
FROM {{pages}}
"""

VISUAL = f"""
SELECT printf('doc_%06d', vec_id * 2) AS document_id, 'normal' AS label, {TYPE_OF.format("(vec_id * 2)")} AS doc_type,
  CAST(vec_id % 3 AS INT) + 1 AS page,
  abs(e0) * 60 AS ela, abs(e1) * 160 AS block_variance, abs(e2) * 120 AS edge, abs(e3) / 10 AS red, abs(e4) / 50 AS red_max_ratio,
  CAST(vec_id % 3 AS INT) AS red_count, abs(e5) * 200 AS edge_contrast, abs(e6) * 200 AS color_std, abs(e7) * 4 AS seal_best,
  CASE vec_id % 4 WHEN 0 THEN 'seal' WHEN 1 THEN 'logo' ELSE 'unknown' END AS seal_class
FROM (SELECT vec_id, {", ".join(f"CAST(embedding[{{i{k}}}] AS DOUBLE) AS e{k}" for k in range(8))} FROM {{embeddings}}) x
"""

OCR = f"""
SELECT printf('doc_%06d', conv_id * 4) AS document_id, {TYPE_OF.format("(conv_id * 4)")} AS doc_type,
  sum(length(text)) AS word_count, avg(CAST((length(text) * 37 + turn * 11) % 100 AS DOUBLE)) AS mean_confidence,
  avg(CASE WHEN (length(text) * 37 + turn * 11) % 100 < 45 THEN 1.0E0 ELSE 0.0E0 END) AS low_confidence_ratio,
  CAST(count(*) AS INT) AS amount_count, CAST(max(turn) % 2 AS INT) AS date_count, CAST(max(turn) % 3 AS INT) AS id_count,
  CAST(max(length(text)) AS DOUBLE) AS amount_1, CAST(min(length(text)) AS DOUBLE) AS amount_2, CAST(sum(length(text)) AS DOUBLE) AS amount_3,
  CASE WHEN conv_id % 19 = 0 THEN 'VOID copy' WHEN conv_id % 23 = 0 THEN 'Training sheet' ELSE '' END AS ocr_text_preview
FROM {{conversations}} GROUP BY conv_id
"""

SEAL = f"""
SELECT printf('doc_%06d', vec_id * 3) AS document_id, {TYPE_OF.format("(vec_id * 3)")} AS doc_type,
  least(abs(e0) * 2, 0.5E0) AS x0, least(abs(e1) * 6, 0.9E0) AS y0, least(abs(e0) * 2, 0.5E0) + 0.05 + abs(e2) AS x1, least(abs(e1) * 6, 0.9E0) + 0.05 + abs(e3) AS y1,
  abs(e4) AS ring, abs(e5) AS center, abs(e6) * 2 AS ink, abs(e7) / 20 AS area, abs(e8) AS saturation, abs(e9) * 4 AS semantic,
  CASE WHEN vec_id % 3 = 0 THEN 'seal' ELSE 'unknown' END AS initial_class, CAST(1 + vec_id % 5 AS INT) AS duplicate_count
FROM (SELECT vec_id, {", ".join(f"CAST(embedding[{{i{k}}}] AS DOUBLE) AS e{k}" for k in range(10))} FROM {{embeddings}}) x
"""

MARKER = """
SELECT printf('doc_%06d', doc_id) AS document_id,
  CASE WHEN contains(lower(text), 'token') OR contains(lower(text), 'secret') THEN 1 ELSE 0 END AS marker_flag,
  concat(CASE WHEN contains(lower(text), 'secret') THEN 'secret' ELSE '' END, CASE WHEN contains(lower(text), 'secret') AND contains(lower(text), 'token') THEN ';' ELSE '' END, CASE WHEN contains(lower(text), 'token') THEN 'token' ELSE '' END) AS marker_tokens
FROM {documents}
"""

QWEN = """
SELECT printf('doc_%06d', user_id * 5) AS document_id, CAST(max(event_id) % 97 AS INT) AS qwen_fx_risk_score, concat(min(event_type), '|', max(event_type)) AS qwen_fx_reason_tags
FROM {events} GROUP BY user_id
"""

BANK = """
SELECT user_id, ts, event_id, round(CASE WHEN event_type IN ('purchase', 'error') THEN -value ELSE value END, 2) AS flow,
  round(sum(CASE WHEN event_type IN ('purchase', 'error') THEN -value ELSE value END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) + CASE WHEN event_id % 97 = 5 THEN 100 ELSE 0 END AS balance
FROM {events}
"""

INVOICE = """
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS amount, l_extendedprice * (1 - l_discount) * l_tax AS tax,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) + CASE WHEN (l_orderkey * 7 + l_linenumber) % 11 = 0 THEN 25 ELSE 0 END AS total
FROM {lineitem}
"""

CREDIT = """
SELECT concat('src', CAST(user_id AS STRING)) AS source_id, CASE WHEN user_id % 3 = 0 THEN 'scanned' ELSE 'original' END AS source_format,
  CASE user_id % 4 WHEN 0 THEN 'personal_print' WHEN 1 THEN 'personal_online' ELSE 'enterprise' END AS report_variant,
  concat('R', CAST(event_id % 9 AS STRING)) AS rule_id, CAST(event_id AS INT) AS position,
  CASE WHEN event_id % 41 = 0 THEN 'fail' WHEN event_id % 29 = 0 THEN 'possible' WHEN event_id % 7 = 0 AND user_id % 2 = 0 THEN 'manual' WHEN user_id % 5 = 0 THEN 'not_applicable' ELSE 'pass' END AS status
FROM {events}
"""

TABLES = ("documents", "labels", "pages", "embeddings", "conversations", "events", "lineitem", "benchmark", "orders", "customer", "supplier")


def spread(table: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all cores by a key, for work a row that far exceeds its bytes: a small file is one split, whatever
    its rows cost, and adaptive execution would put small shuffled parts together again unless their number is given."""
    return table.repartition(4 * table.sparkSession.sparkContext.defaultParallelism, key)


def spark_sql(spark: SparkSession, sf_dir: str, text: str, **keys: str) -> DataFrame:
    """A projection over the driver tables; Spark's array subscripts begin at 0. Tables with a key are spread by it."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    used |= {t: spread(used[t], key) for t, key in keys.items()}
    for k in range(12):
        text = text.replace(f"{{i{k}}}", str(k))
    return spark.sql(text, **used)


def oracle(text: str) -> str:
    """The same projection for the oracle, whose subscripts begin at 1."""
    for k in range(12):
        text = text.replace(f"{{i{k}}}", str(k + 1))
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text.strip()


def sql_rules(rules: list[tuple[str, str, int]]) -> tuple[str, str]:
    """(score, list of reasons) in the oracle's SQL."""
    score = " + ".join(f"CASE WHEN {p} THEN {n} ELSE 0 END" for _, p, n in rules if n)
    names = ", ".join(f"CASE WHEN {p} THEN '{name}' END" for name, p, _ in rules)
    return f"least(100, {score})", f"list_filter([{names}], lambda x: x IS NOT NULL)"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, MANIFEST)


def pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF structure with its rules' score and reasons."""
    rules = object_rules()
    return spark_sql(spark, sf_dir, PDF).withColumns({"object_risk_score": score_of(rules), "object_risk_reasons": F.array_join(reasons_of(rules), "|")})


OBJECT_SQL = sql_rules(
    [
        ("pdf_smask_present", "smask_count >= 1", 25),
        ("poppler_font_warning", "font_warning_count >= 1", 20),
        ("full_page_image_with_local_overlays", "large_image_count >= 1 AND small_overlay_count >= 3", 15),
        ("dense_pdf_image_overlays", "image_count >= 3 * greatest(pages, 1) AND small_overlay_count >= 3", 15),
        ("missing_creator_producer", "creator = '' AND producer = ''", 10),
        ("incremental_update_trace", "incremental_update_count > 1", 15),
        ("embedded_script_or_file", "javascript_count > 0 OR embedded_file_count > 0", 20),
        ("high_font_object_count", "font_object_count > 80", 10),
        ("interactive_form_or_xfa", "acroform_count > 0", 8),
    ]
)
PDF_SQL = f"pdf AS (SELECT *, {OBJECT_SQL[0]} AS object_risk_score, array_to_string({OBJECT_SQL[1]}, '|') AS object_risk_reasons FROM ({oracle(PDF)}) p)"


def visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = visual_rules()
    return spark_sql(spark, sf_dir, VISUAL).withColumns({"visual_risk_score": score_of(rules), "visual_risk_reasons": F.array_join(reasons_of(rules), "|")})


VISUAL_RULES_SQL = sql_rules(
    [
        ("high_ela_recompression_error", "ela >= 7", 20),
        ("local_noise_block_inconsistency", "block_variance >= 22", 15),
        ("dense_edge_or_paste_boundary", "edge >= 18", 10),
        ("red_stamp_like_region", "red >= 0.012", 10),
        ("seal_red_connected_component", "red_max_ratio >= 0.0015 AND red_count >= 1", 8),
        ("seal_hard_edge_overlay", "edge_contrast >= 22 AND red_max_ratio >= 0.001", 12),
        ("seal_flat_color_overlay", "red_max_ratio BETWEEN 0.001 AND 0.08 AND color_std > 0 AND color_std <= 28", 8),
        ("seal_candidate_color_agnostic", "seal_best >= 0.52", 0),
        ("seal_candidate_likely_seal", "seal_best >= 0.52 AND seal_class = 'seal'", 0),
        ("seal_candidate_likely_logo", "seal_best >= 0.52 AND seal_class = 'logo'", 0),
        ("seal_candidate_unknown_review", "seal_best >= 0.52 AND seal_class NOT IN ('seal', 'logo')", 0),
    ]
)
VISUAL_SQL = f"visual AS (SELECT *, {VISUAL_RULES_SQL[0]} AS visual_risk_score, array_to_string({VISUAL_RULES_SQL[1]}, '|') AS visual_risk_reasons FROM ({oracle(VISUAL)}) p)"


def text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text layer features of the documents with their rules' score and reasons."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.col("doc_id")
    rows = docs.select("doc_id", "n_chars", "text", word_counts(F.col("text")).alias("w"), repeated_lines(F.col("text")).alias("lines")).select(
        F.format_string("doc_%06d", "doc_id").alias("document_id"),
        F.when(n % 6 == 0, "fake").otherwise("normal").alias("label"),
        F.expr(TYPE_OF.format("doc_id")).alias("doc_type"),
        F.lit(".pdf").alias("ext"),
        F.col("w.words").alias("word_count"),
        F.col("w.distinct_words").alias("unique_word_count"),
        (F.col("n_chars") * 1.5).alias("amount"),
        (F.col("n_chars") * 0.09).alias("tax"),
        (F.col("n_chars") * 1.59 + F.when(n % 11 == 0, 25).otherwise(0)).alias("total"),
        (n % 3).alias("invoice_number_count"),
        F.when(n % 4 == 0, "").otherwise("A").alias("party_a"),
        F.lit("B").alias("party_b"),
        (n % 2).alias("date_count"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(ACCOUNT_STRICT)).alias("account_count"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[0-9]+")).alias("amount_count"),
        (n % 7).alias("balance_rows"),
        F.when(n % 5 == 0, 1).otherwise(0).alias("balance_breaks"),
        (n % 2).alias("id_count"),
        F.coalesce("lines.duplicate_line_ratio", F.lit(0.0)).alias("duplicate_line_ratio"),
    )
    rules = text_rules()
    return rows.withColumns({"business_risk_score": score_of(rules), "business_risk_reasons": F.array_join(reasons_of(rules), "|")})


TEXT_RULES_SQL = sql_rules(
    [
        ("pdf_text_layer_missing_or_unreadable", "lower(ext) = '.pdf' AND word_count = 0", 20),
        ("very_sparse_text_layer", "word_count BETWEEN 1 AND 19", 12),
        ("text_layer_repetition", "word_count >= 20 AND unique_word_count / greatest(word_count, 1) < 0.28", 10),
        ("duplicated_text_lines", "duplicate_line_ratio >= 0.18", 8),
        ("invoice_amount_tax_total_mismatch", "doc_type = 'invoice' AND abs(amount + tax - total) > 0.05", 35),
        ("invoice_number_missing", "doc_type = 'invoice' AND invoice_number_count = 0", 8),
        ("contract_party_field_missing", "doc_type = 'contract' AND (party_a = '' OR party_b = '')", 8),
        ("contract_date_missing", "doc_type = 'contract' AND date_count = 0", 8),
        ("bank_account_number_missing", "doc_type = 'bank_page' AND account_count = 0", 8),
        ("bank_amount_sequence_sparse", "doc_type = 'bank_page' AND amount_count < 2", 8),
        ("bank_balance_sequence_broken", "doc_type = 'bank_page' AND balance_rows >= 3 AND balance_breaks >= 1", 30),
        ("credit_report_id_missing", "doc_type = 'credit_report' AND id_count = 0", 8),
        ("credit_report_date_missing", "doc_type = 'credit_report' AND date_count = 0", 8),
        ("settlement_core_fields_missing", "doc_type = 'settlement_statement' AND account_count = 0 AND amount_count = 0", 10),
    ]
)
LINES_SQL = r"""lines AS (
  SELECT document_id, lower(trim(regexp_replace(line, '[ \t\r\n]+', ' ', 'g'))) AS line
  FROM (SELECT printf('doc_%06d', doc_id) AS document_id, unnest(string_split(text, chr(10))) AS line FROM documents) x
  WHERE length(trim(regexp_replace(line, '[ \t\r\n]+', ' ', 'g'))) >= 6
), line_ratio AS (
  SELECT document_id, CAST(sum(n) AS BIGINT) AS line_count, round_even(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 4) AS duplicate_line_ratio
  FROM (SELECT document_id, line, count(*) AS n FROM lines GROUP BY 1, 2) y GROUP BY 1
)"""
TEXT_SQL = rf"""{LINES_SQL}, words AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[ \n]+'), lambda w: w <> '') AS w FROM documents
), text_features AS (
  SELECT printf('doc_%06d', d.doc_id) AS document_id, CASE WHEN d.doc_id % 6 = 0 THEN 'fake' ELSE 'normal' END AS label, {TYPE_OF.format("d.doc_id")} AS doc_type, '.pdf' AS ext,
    len(w.w) AS word_count, len(list_distinct(list_transform(w.w, lambda x: lower(x)))) AS unique_word_count,
    n_chars * 1.5E0 AS amount, n_chars * 0.09E0 AS tax, n_chars * 1.59E0 + CASE WHEN d.doc_id % 11 = 0 THEN 25 ELSE 0 END AS total,
    d.doc_id % 3 AS invoice_number_count, CASE WHEN d.doc_id % 4 = 0 THEN '' ELSE 'A' END AS party_a, 'B' AS party_b, d.doc_id % 2 AS date_count,
    len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) BETWEEN 12 AND 24)) AS account_count, len(regexp_extract_all(text, '[0-9]+')) AS amount_count,
    d.doc_id % 7 AS balance_rows, CASE WHEN d.doc_id % 5 = 0 THEN 1 ELSE 0 END AS balance_breaks, d.doc_id % 2 AS id_count,
    coalesce(r.duplicate_line_ratio, 0) AS duplicate_line_ratio
  FROM documents d JOIN words w ON d.doc_id = w.doc_id LEFT JOIN line_ratio r ON r.document_id = printf('doc_%06d', d.doc_id)
), text AS (
  SELECT *, {TEXT_RULES_SQL[0]} AS business_risk_score, array_to_string({TEXT_RULES_SQL[1]}, '|') AS business_risk_reasons FROM text_features
)"""


def ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ocr_rules()
    return spark_sql(spark, sf_dir, OCR).withColumns({"ocr_risk_score": score_of(rules), "ocr_risk_reasons": F.array_join(reasons_of(rules), "|")})


OCR_RULES_SQL = sql_rules(
    [
        ("ocr_text_missing", "word_count = 0", 20),
        ("ocr_low_mean_confidence", "word_count > 0 AND mean_confidence < 45", 18),
        ("ocr_many_low_confidence_words", "word_count > 0 AND low_confidence_ratio > 0.35", 12),
        ("ocr_invoice_amount_logic_suspicious", "word_count > 0 AND doc_type = 'invoice' AND abs(amount_1 + amount_2 - amount_3) > 0.1 AND abs(amount_1 + amount_3 - amount_2) > 0.1 AND abs(amount_2 + amount_3 - amount_1) > 0.1", 25),
        ("ocr_bank_amount_sequence_sparse", "word_count > 0 AND doc_type = 'bank_page' AND amount_count < 2", 8),
        ("ocr_contract_date_missing", "word_count > 0 AND doc_type = 'contract' AND date_count = 0", 8),
        ("ocr_credit_identity_unresolved", "word_count > 0 AND doc_type = 'credit_report' AND id_count = 0", 0),
    ]
)
OCR_SQL = f"ocr AS (SELECT *, {OCR_RULES_SQL[0]} AS ocr_risk_score, array_to_string({OCR_RULES_SQL[1]}, '|') AS ocr_risk_reasons FROM ({oracle(OCR)}) p)"


def seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seal candidates."""
    return spark_sql(spark, sf_dir, SEAL)
