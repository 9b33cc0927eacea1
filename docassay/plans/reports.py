"""Seals, rule results of reports, and what readers ask of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.operators import layout, seals, serving
from docassay.plans import projections as P
from docassay.plans.registry import query

SEAL_CTE = f"c AS ({P.oracle(P.SEAL)})"
DENSE = "(ink >= 0.285 AND ring >= 0.28 AND center >= 0.22 AND saturation <= 0.10)"
OUTER = "(ring >= 0.085 AND center / greatest(ring, 1e-6) <= 0.45 AND area >= 0.0035 AND ink <= 0.22)"


@query(f"""
WITH {SEAL_CTE}, z AS (SELECT *, CASE WHEN (y0 + y1) / 2 < 0.25 THEN 'top' WHEN (y0 + y1) / 2 >= 0.68 THEN 'bottom' ELSE 'middle' END AS zone, {DENSE} AS dense, {OUTER} AS outer_ring FROM c),
k AS (SELECT *, CASE WHEN dense THEN 1 WHEN duplicate_count >= 3 AND area BETWEEN 0.003 AND 0.008 AND (center / greatest(ring, 1e-6) >= 1.08 OR ring < 0.06) AND NOT outer_ring THEN 2
  WHEN doc_type IN ('credit_report', 'bank_page') AND zone = 'top' AND area <= 0.03 AND saturation >= 0.12 THEN 3 WHEN duplicate_count >= 3 AND area >= 0.012 AND NOT outer_ring THEN 4 WHEN initial_class = 'seal' THEN 5 ELSE 6 END AS w FROM z),
v AS (SELECT *, CASE w WHEN 1 THEN 'unknown' WHEN 2 THEN 'logo' WHEN 3 THEN 'logo' WHEN 4 THEN 'unknown' WHEN 5 THEN 'seal' ELSE 'unknown' END AS seal_class FROM k)
SELECT document_id, seal_class, CASE w WHEN 1 THEN 0.96E0 WHEN 2 THEN least(0.97E0, 0.68E0 + 0.04E0 * duplicate_count) WHEN 3 THEN 0.78E0 WHEN 4 THEN least(0.96E0, 0.66E0 + 0.03E0 * duplicate_count) WHEN 5 THEN greatest(0.62E0, semantic) ELSE greatest(0.35E0, semantic) END AS confidence,
  CASE w WHEN 1 THEN 'dense_square_pattern' WHEN 2 THEN 'repeated_compact_emblem' WHEN 3 THEN 'header_emblem_context' WHEN 4 THEN 'repeated_layout_fragment' WHEN 5 THEN 'annular_stamp_geometry' ELSE 'insufficient_stamp_geometry' END AS reason, reason || CASE WHEN w = 1 THEN '|ocr_not_recommended' WHEN w IN (2, 4) THEN '|duplicate_hash:' || duplicate_count ELSE '' END AS reasons,
  CASE WHEN w = 5 THEN true WHEN w = 6 THEN semantic >= 0.42 ELSE false END AS should_ocr, zone,
  CASE WHEN seal_class <> 'seal' THEN 'not_applicable' WHEN doc_type IN ('contract', 'invoice', 'settlement_statement') AND zone = 'bottom' THEN 'expected_signature_zone' WHEN doc_type IN ('contract', 'invoice', 'settlement_statement') AND zone = 'top' THEN 'unusual_header_zone_review' ELSE 'context_unknown' END AS position
FROM v
""")
def seal_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seals.classify(P.seals(spark, sf_dir))


@query("""
WITH h AS (SELECT vec_id, CAST(list_sum(list_transform(range(1, 11), lambda k: CASE WHEN embedding[k + 1] > embedding[k] THEN pow(2, k - 1) ELSE 0 END)) AS BIGINT) AS dhash FROM embeddings)
SELECT vec_id, dhash, count(*) OVER (PARTITION BY dhash) AS duplicate_count FROM h
""")
def dhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference hashes of ten neighbours and how many rows share one."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", seals.difference_hash(F.col("embedding"), 10).alias("dhash"))
    return seals.duplicate_counts(e)


ENTITIES = "SELECT s_suppkey, lower(s_name) AS seen, concat('Supplier#', lpad(CAST(s_suppkey AS STRING), 9, '0')) AS e0, concat('Supplier ', CAST(s_suppkey + 1 AS STRING)) AS e1 FROM {supplier}"


@query(f"""
WITH t AS ({ENTITIES.replace("{supplier}", "supplier")}), p AS (SELECT s_suppkey, seen, unnest([e0, e1]) AS entity, unnest([0, 1]) AS place FROM t),
k AS (SELECT *, regexp_replace(seen, '[^A-Za-z0-9]', '', 'g') AS x, lower(regexp_replace(entity, '[^A-Za-z0-9]', '', 'g')) AS y FROM p),
s AS (SELECT *, 1 - levenshtein(x, y) / greatest(length(x), length(y)) AS similarity FROM k)
SELECT s_suppkey, CASE WHEN similarity > 0 THEN entity ELSE '' END AS entity, similarity FROM s QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY similarity DESC, place) = 1
""")
def entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity nearest to a recognised name by edit distance."""
    rows = spark.sql(ENTITIES, supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet")).select("s_suppkey", "seen", F.array("e0", "e1").alias("entities"))
    return seals.best_entity(rows, "s_suppkey", "seen", "entities", seals.edit_likeness)


@query()
def entity_match_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by matching blocks, with containment and windows."""
    rows = spark.sql(ENTITIES, supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet")).select("s_suppkey", "seen", F.array("e0", "e1").alias("entities"))
    return seals.best_entity(rows, "s_suppkey", "seen", "entities")


PAGES = f"SELECT printf('doc_%06d', CAST(floor(n / 3) AS BIGINT)) AS document_id, page, ela, edge, visual_score, seal_class FROM (SELECT CAST(substring(document_id, 5, 6) AS BIGINT) AS n, page, ela, edge, round(ela + edge, 3) AS visual_score, seal_class FROM ({P.VISUAL}) v) x"


@query(f"""WITH p AS ({P.oracle(PAGES)}), b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY visual_score DESC, page) = 1)
SELECT p.document_id, count(*) AS page_count, max(p.ela) AS ela, max(p.edge) AS edge, any_value(b.page) AS best_page, any_value(b.visual_score) AS best_visual_score, any_value(b.seal_class) AS best_seal_class FROM p JOIN b USING (document_id) GROUP BY 1""")
def page_to_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.documents_of_pages(P.spark_sql(spark, sf_dir, PAGES), "document_id", ["ela", "edge"], "visual_score")


@query("""
WITH h AS (SELECT CAST(floor(vec_id / 16) AS BIGINT) AS document_id, vec_id % 16 AS point, (vec_id % 4) * 40.0E0 AS x, (CAST(floor(vec_id / 4) AS BIGINT) % 4) * 40.0E0 AS y,
  CAST(list_sum(list_transform(range(1, 61), lambda k: CASE WHEN embedding[k + 1] > embedding[k] THEN CAST(1 AS BIGINT) << CAST(k - 1 AS INTEGER) ELSE CAST(0 AS BIGINT) END)) AS BIGINT) AS code FROM embeddings),
n AS (SELECT a.document_id, a.point AS p, b.x - a.x AS dx, b.y - a.y AS dy, row_number() OVER (PARTITION BY a.document_id, a.point ORDER BY bit_count(xor(a.code, b.code)), b.point) AS rank FROM h a JOIN h b ON a.document_id = b.document_id AND a.point <> b.point WHERE bit_count(xor(a.code, b.code)) <= 32),
o AS (SELECT document_id, abs(round_even(dx / 8, 0)) AS ox, abs(round_even(dy / 8, 0)) AS oy, count(*) AS votes FROM n WHERE rank <= 3 AND sqrt(dx * dx + dy * dy) >= 32 GROUP BY ALL)
SELECT document_id, max(votes) AS offset_votes, CAST(sum(votes) AS BIGINT) AS match_count FROM o GROUP BY 1
""")
def copied_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset votes among the key points of made-up documents of sixteen points."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    points = e.select(F.floor(F.col("vec_id") / 16).alias("document_id"), (F.col("vec_id") % 16).alias("point"), (F.col("vec_id") % 4 * 40.0).alias("x"), (F.floor(F.col("vec_id") / 4) % 4 * 40.0).alias("y"), seals.difference_hash(F.col("embedding"), 60).alias("code"))
    return seals.copied_regions(points)


CREDIT_CTE = f"r AS ({P.oracle(P.CREDIT)})"
PUBLIC_CTE = f"""{CREDIT_CTE}, a AS (SELECT source_id, source_format, report_variant, count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'fail') AS fail, count(*) FILTER (status = 'possible') AS possible,
  count(*) FILTER (status = 'manual') AS manual, count(*) FILTER (status = 'not_applicable') AS not_applicable,
  arg_min(rule_id, (CASE status WHEN 'fail' THEN 0 WHEN 'possible' THEN 1 ELSE 2 END) * 1000000000 + position) FILTER (status IN ('fail', 'possible', 'manual')) AS primary_finding FROM r GROUP BY 1, 2, 3),
d AS (SELECT 'CR-' || upper(substr(sha256(source_id), 1, 10)) AS document_id, report_variant, source_format, CASE WHEN fail > 0 THEN 'fail' WHEN possible > 0 THEN 'possible' WHEN pass > 0 THEN 'no_automatic_anomaly' ELSE 'undetermined' END AS risk_conclusion,
  manual > 0 AS manual_review_required, pass, fail, possible, manual, not_applicable, primary_finding FROM a)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.spark_sql(spark, sf_dir, P.CREDIT)


@query(f"WITH {PUBLIC_CTE} SELECT * FROM d")
def public_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.public_rows(results(spark, sf_dir))


@query(f"""WITH {PUBLIC_CTE}, f AS (SELECT *, row_number() OVER (ORDER BY CASE risk_conclusion WHEN 'fail' THEN 0 WHEN 'possible' THEN 1 WHEN 'undetermined' THEN 2 ELSE 3 END, fail DESC, possible DESC, document_id) AS place, count(*) OVER () AS total
  FROM d WHERE report_variant = 'enterprise' AND contains(lower(document_id || ' ' || report_variant || ' ' || source_format || ' ' || coalesce(primary_finding, '')), 'original'))
SELECT * EXCLUDE (place, total) FROM f WHERE floor((place - 1) / 10) + 1 = least(2, ceil(total / 10))""")
def report_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of ten of a filtered list."""
    rows = serving.filtered(serving.public_rows(results(spark, sf_dir)), search=" Original ", conclusion="no such", report_variant="enterprise")
    return serving.page_of(rows, 2, 10)


@query(f"""WITH {PUBLIC_CTE}, s AS (UNPIVOT (SELECT sum(pass) AS pass, sum(fail) AS fail, sum(possible) AS possible, sum(manual) AS manual, sum(not_applicable) AS not_applicable FROM d) ON COLUMNS(*) INTO NAME name VALUE n),
f AS (SELECT rule_id || ':' || status AS name, count(*) AS n FROM r WHERE status IN ('fail', 'possible') GROUP BY 1 ORDER BY n DESC, name LIMIT 8)
SELECT 'conclusion' AS section, name, (SELECT count(*) FROM d WHERE risk_conclusion = name) AS n FROM (VALUES ('fail'), ('possible'), ('no_automatic_anomaly'), ('undetermined')) v(name)
UNION ALL SELECT 'status', name, CAST(n AS BIGINT) FROM s UNION ALL SELECT 'source_format', source_format, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'report_variant', report_variant, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'finding', name, n FROM f""")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir)
    return serving.dashboard(serving.public_rows(r), r)
