"""Made-up documents in matched pairs: one consistent, one tampered with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.functions import text as T
from docassay.operators import geometry, layout, seals, synthetic
from docassay.plans import projections as P
from docassay.plans import reports  # noqa: F401  its SQL is part of one here
from docassay.plans.registry import SQL, query


def semantic_pairs(spark: SparkSession, n: int) -> DataFrame:
    """document_id, label, doc_type and lines of n invoice pairs and n bank pairs; the fake's total or last balance is off."""
    k = F.col("id")
    pair, kind, fake = F.floor(k / 4), F.when(k % 4 < 2, "invoice").otherwise("bank_page"), k % 2 == 1
    amount = (pair * 37 + 100).cast("double")
    total = amount * 1.06 + F.when(fake, 88.0).otherwise(0.0)
    money = lambda x: F.format_string("%.2f", x)
    invoice = F.array(F.lit("VALUE ADDED TAX INVOICE"), F.concat(F.lit("INV-2026"), F.lpad(pair.cast("string"), 5, "0")), F.concat(F.lit("Amount: "), money(amount)), F.concat(F.lit("Tax: "), money(amount * 0.06)), F.concat(F.lit("Total: "), money(total)))
    rows = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.lit("2026-06-1"), i.cast("string"), F.lit(" +"), money(i * 10.0), F.lit(" Balance "), money(amount + i * (i + 1) * 5.0 + F.when(fake & (i == 5), 63.0).otherwise(0.0))))
    bank = F.concat(F.array(F.lit("Account 6222021234567890123")), rows)
    return spark.range(4 * n).select(F.format_string("%s_%06d", F.when(fake, "fake").otherwise("normal"), k).alias("document_id"), F.when(fake, "fake").otherwise("normal").alias("label"), kind.alias("doc_type"), F.when(kind == "invoice", invoice).otherwise(bank).alias("lines"))


def flagged(pairs: DataFrame) -> DataFrame:
    """Pairs with whether arithmetic or the running balance is broken."""
    a, t, z = (T.labelled_amount(F.col("lines"), x) for x in (("Amount",), ("Tax",), ("Total",)))
    invoices = pairs.where("doc_type = 'invoice'").select("document_id", "label", "doc_type", F.coalesce(F.abs(a + t - z) > 0.05, F.lit(False)).alias("flagged"))
    lines = pairs.where("doc_type = 'bank_page'").select("document_id", F.posexplode("lines").alias("band", "text"))
    breaks = layout.balance_breaks(layout.balance_rows(lines), "document_id", ["position"])
    banks = pairs.where("doc_type = 'bank_page'").join(breaks, "document_id", "left").select("document_id", "label", "doc_type", F.coalesce((F.col("balance_rows") >= 3) & (F.col("balance_breaks") >= 1), F.lit(False)).alias("flagged"))
    return invoices.unionAll(banks)


@query("SELECT t AS doc_type, l AS label, CAST(500 AS BIGINT) AS documents, CASE WHEN l = 'fake' THEN CAST(500 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS flagged FROM (VALUES ('invoice'), ('bank_page')) a(t), (VALUES ('fake'), ('normal')) b(l)")
def semantic_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of the tampered documents and none of the others are flagged."""
    return flagged(semantic_pairs(spark, 500)).groupBy("doc_type", "label").agg(F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"))


CANDIDATES = f"""SELECT document_id, x0 * 1000 AS x0, y0 * 1400 AS y0, x0 * 1000 + 40 + abs(x1 - x0) * 300 AS x1, y0 * 1400 + 40 + abs(y1 - y0) * 300 AS y1, 1000 AS page_width, 1400 AS page_height,
  ring * 2 AS ring, center / 2 AS center, least(1.0E0, 0.5E0 + semantic) AS coverage, least(1.0E0, 0.4E0 + semantic) AS uniformity, ink, saturation, 0.5E0 AS score, duplicate_count AS candidate FROM ({P.SEAL}) s"""


@query(f"""
WITH c AS (SELECT *, greatest(x1 - x0, 1) AS w, greatest(y1 - y0, 1) AS h FROM ({P.oracle(CANDIDATES)}) q),
g AS (SELECT *, w / h AS aspect, w * h / (page_width * page_height) AS area, greatest(w, h) / least(page_width, page_height) AS sh, (y0 + y1) / 2 / page_height AS mid, center / greatest(ring, 1e-6) AS hollow FROM c),
p AS (SELECT *, aspect BETWEEN 0.62 AND 1.62 AS square, aspect BETWEEN 0.72 AND 1.38 AND ink >= 0.285 AND ring >= 0.28 AND center >= 0.22 AND saturation <= 0.10 AS dense, area < 0.0024 OR sh < 0.045 AS tiny,
  aspect BETWEEN 0.45 AND 1.80 AND saturation >= 0.14 AND ring >= 0.035 AND coverage >= 0.50 AND ink <= 0.28 AND area >= 0.0022 AS color,
  mid >= 0.55 AND aspect BETWEEN 0.50 AND 1.85 AND area BETWEEN 0.04 AND 0.075 AND ink <= 0.14 AND ring >= 0.08 AND coverage >= 0.85 AND ((uniformity >= 0.68 AND hollow <= 0.65) OR (uniformity >= 0.58 AND hollow >= 0.80)) AS bottom FROM g),
s AS (SELECT *, greatest(0, least(1, 0.20E0 * greatest(0, 1 - abs(ln(greatest(aspect, 1e-6))) / ln(2.0E0)) + 0.23E0 * coverage + 0.20E0 * uniformity + 0.22E0 * greatest(0, least(1, 1.25E0 - hollow)) + 0.15E0 * least(1, ring / 0.13E0)
  - CASE WHEN dense THEN 0.42E0 ELSE 0 END - CASE WHEN tiny THEN 0.20E0 ELSE 0 END)) AS semantic_score FROM p),
k AS (SELECT *, CASE WHEN dense THEN 'dense_square_pattern' WHEN mid < 0.22 AND saturation >= 0.12 AND area <= 0.03 THEN 'header_emblem_pattern' WHEN NOT square THEN 'elongated_component' WHEN tiny AND NOT color THEN 'tiny_fragment'
  WHEN color OR (ring >= 0.085 AND coverage >= 0.70 AND uniformity >= 0.68 AND hollow <= 0.45 AND ink <= 0.22 AND area >= 0.0035) OR (saturation <= 0.12 AND ring >= 0.085 AND coverage >= 0.78 AND uniformity >= 0.42 AND area BETWEEN 0.0032 AND 0.055 AND hollow <= 0.40 AND ink <= 0.22) THEN 'annular_stamp_geometry'
  WHEN bottom THEN 'bottom_stamp_geometry' ELSE 'insufficient_stamp_geometry' END AS reason FROM s)
SELECT document_id, round_even(semantic_score, 9) AS semantic_score, reason, CASE WHEN reason IN ('annular_stamp_geometry', 'bottom_stamp_geometry') THEN 'seal' ELSE 'unknown' END AS seal_class,
  reason IN ('annular_stamp_geometry', 'bottom_stamp_geometry') OR (reason = 'insufficient_stamp_geometry' AND semantic_score >= 0.42) AS should_ocr FROM k
""")
def candidate_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.semantics(P.spark_sql(spark, sf_dir, CANDIDATES)).select("document_id", F.bround("semantic_score", 9).alias("semantic_score"), "reason", "seal_class", "should_ocr")


NEGATIVES = synthetic.negatives_sql("SELECT doc_id AS id FROM {documents}")


@query(P.oracle(NEGATIVES))
def synthetic_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fakes of every type and kind of tampering, one for each id."""
    return P.spark_sql(spark, sf_dir, NEGATIVES)


@query(f"WITH n AS ({P.oracle(NEGATIVES)}) SELECT tamper_type, category, count(*) AS documents, count(*) FILTER (regexp_matches(text, 'EDITED-|FONT-|HIDDEN_ORIGINAL|INSERTED PAGE|Total: 19800')) AS told_by_text FROM n GROUP BY 1, 2")
def negative_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fakes of each kind there are, and how many of them their text layer tells."""
    rows = P.spark_sql(spark, sf_dir, NEGATIVES)
    return rows.groupBy("tamper_type", "category").agg(F.count("*").alias("documents"), F.count_if(F.col("text").rlike("EDITED-|FONT-|HIDDEN_ORIGINAL|INSERTED PAGE|Total: 19800")).alias("told_by_text"))


@query(f"WITH classified AS ({SQL['seal_classify']}) SELECT seal_class, count(*) AS candidates, count(*) FILTER (should_ocr) AS worth_recognising, round_even(avg(confidence), 4) AS mean_confidence FROM classified GROUP BY 1")
def seal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seals.summary(seals.classify(P.seals(spark, sf_dir)))


@query(f"WITH m AS ({P.oracle(P.MANIFEST)}), k AS ({P.oracle(P.MARKER)}) SELECT label, count(*) AS documents, CAST(sum(marker_flag) AS BIGINT) AS marked, round_even(avg(marker_flag), 6) AS coverage FROM m JOIN k USING (document_id) GROUP BY 1")
def marker_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each label's documents that carry a marker."""
    both = P.manifest(spark, sf_dir).join(P.spark_sql(spark, sf_dir, P.MARKER), "document_id")
    return both.groupBy("label").agg(F.count("*").alias("documents"), F.sum("marker_flag").cast("bigint").alias("marked"), F.bround(F.avg("marker_flag"), 6).alias("coverage"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, least(100, greatest(0, CAST(json_extract(props, '$.k') AS INTEGER))) AS qwen_fx_risk_score FROM events")
def vlm_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores out of JSON that prose surrounds."""
    from docassay.operators.vlm import answers

    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    raw = F.concat(F.lit('Here it is: {"risk_score": '), F.col("k").cast("string"), F.lit(', "reason_tags": ["a"]} thanks'))
    return e.select("event_id", "k").join(answers(e.select("event_id", raw.alias("raw")), "raw", "event_id"), "event_id").select("event_id", "k", "qwen_fx_risk_score")
