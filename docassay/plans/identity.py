"""Identity of documents across the projected tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.operators import fusion, identity, metrics, serving
from docassay.plans import projections as P
from docassay.plans.registry import query

BASE = f"m AS ({P.oracle(P.MANIFEST)}), f AS ({P.oracle(P.PDF)})"


@query(f"WITH {BASE}, s AS ({P.oracle(P.SEAL)}) SELECT DISTINCT document_id FROM s WHERE document_id NOT IN (SELECT document_id FROM m)")
def identity_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of seal candidates that the manifest does not know."""
    return identity.outside(P.spark_sql(spark, sf_dir, P.SEAL), P.manifest(spark, sf_dir))


@query(f"WITH {BASE} SELECT document_id FROM m WHERE document_id NOT IN (SELECT document_id FROM f)")
def identity_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.missing(P.spark_sql(spark, sf_dir, P.PDF), P.manifest(spark, sf_dir))


@query(f"""WITH {BASE}, x AS (SELECT f.document_id, f.path <> '' AND m.path <> '' AND split_part(f.path, '/', -1) <> split_part(m.path, '/', -1) AS path_differs,
  f.label <> '' AND m.label <> '' AND f.label <> m.label AS label_differs, f.doc_type <> '' AND m.doc_type <> '' AND f.doc_type <> m.doc_type AS type_differs FROM f JOIN m USING (document_id))
SELECT * FROM x WHERE path_differs OR label_differs OR type_differs""")
def identity_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.mismatched(P.spark_sql(spark, sf_dir, P.PDF), P.manifest(spark, sf_dir))


@query(f"WITH f AS ({P.oracle(P.PDF)}), d AS (SELECT document_id FROM f UNION ALL SELECT document_id FROM f WHERE smask_count = 1) SELECT document_id, count(*) AS n FROM d GROUP BY 1 HAVING count(*) > 1")
def identity_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = P.spark_sql(spark, sf_dir, P.PDF)
    return identity.duplicates(f.select("document_id").unionAll(f.where("smask_count = 1").select("document_id")))


@query(f"""WITH {BASE}, x AS (SELECT (SELECT count(*) FROM f) AS rows_total, CAST(0 AS BIGINT) AS duplicate_ids, (SELECT count(*) FROM f WHERE document_id NOT IN (SELECT document_id FROM m)) AS outside_base,
  (SELECT count(*) FROM m WHERE document_id NOT IN (SELECT document_id FROM f)) AS missing_from_feature,
  (SELECT count(*) FROM f JOIN m USING (document_id) WHERE split_part(f.path, '/', -1) <> split_part(m.path, '/', -1) OR (f.label <> '' AND f.label <> m.label) OR f.doc_type <> m.doc_type) AS identity_mismatch)
SELECT 'pdf' AS feature, *, duplicate_ids = 0 AND outside_base = 0 AND identity_mismatch = 0 AND missing_from_feature = 0 AS passed FROM x""")
def identity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.audit({"pdf": P.spark_sql(spark, sf_dir, P.PDF)}, P.manifest(spark, sf_dir), ("pdf",))


@query(f"WITH {BASE} SELECT document_id, label, doc_type, ext, path FROM m WHERE doc_type = 'credit_report' AND document_id IN (SELECT document_id FROM f WHERE creator = 'CamScanner')")
def semi_scan_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = P.spark_sql(spark, sf_dir, P.PDF).where("creator = 'CamScanner'")
    return identity.scan_manifest(P.manifest(spark, sf_dir), wanted).select("document_id", "label", "doc_type", "ext", "path")


@query("SELECT user_id, event_type AS last_type, value AS last_value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.col("event_type").alias("last_type"), F.col("value").alias("last_value"))
    return fusion.last_wins(e, "event_id", "user_id")


@query(f"WITH {BASE}, a AS (SELECT document_id FROM m), b AS (SELECT document_id FROM f) SELECT (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) x) AS either_n, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) x) AS both_n, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x) AS first_only, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) x) AS second_only")
def id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and both differences of the ids of two tables."""
    a, b = P.manifest(spark, sf_dir).select("document_id"), P.spark_sql(spark, sf_dir, P.PDF).select("document_id")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = n(a.union(b).distinct(), "either_n")
    for other in (n(a.intersect(b), "both_n"), n(a.subtract(b), "first_only"), n(b.subtract(a), "second_only")):  # one row each
        out = out.join(F.broadcast(other))
    return out


@query(f"WITH m AS ({P.oracle(P.MANIFEST)}) SELECT label, doc_type, ext, count(*) AS documents, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM m GROUP BY ALL")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.manifest(spark, sf_dir).groupBy("label", "doc_type", "ext").agg(F.count("*").alias("documents"), F.sum("size_bytes").alias("size_bytes"))


@query(f"WITH m AS ({P.oracle(P.MANIFEST)}) SELECT document_id, printf('%s_%06d', label, row_number() OVER (PARTITION BY label ORDER BY document_id) - 1) AS running_id FROM m")
def running_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents numbered within their label, in the order of their ids."""
    rows = fusion.number_rows(P.manifest(spark, sf_dir).select("document_id", "label"), "document_id", "label", start=0, name="n")
    return rows.select("document_id", F.format_string("%s_%06d", "label", "n").alias("running_id"))


@query(f"WITH m AS ({P.oracle(P.MANIFEST)}) SELECT document_id, doc_type FROM m WHERE label IN ('fake', 'normal') AND lower(ext) IN ('.pdf', '.jpg', '.jpeg', '.png') AND NOT starts_with(split_part(path, '/', -1), '1')")
def manifest_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension, label and file-name predicates."""
    from docassay.functions.text import basename

    m = P.manifest(spark, sf_dir)
    return m.where(F.col("label").isin("fake", "normal") & F.lower("ext").isin(".pdf", ".jpg", ".jpeg", ".png") & ~basename("path").startswith("1")).select("document_id", "doc_type")


@query(f"WITH m AS ({P.oracle(P.MANIFEST)}) SELECT label, doc_type, count(*) AS documents FROM (SELECT label, doc_type FROM m UNION ALL SELECT label, doc_type FROM m WHERE label = 'fake') x GROUP BY ALL")
def training_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historical rows and labelled uploads, whose columns differ."""
    m = P.manifest(spark, sf_dir)
    both = m.select("document_id", "label", "doc_type").unionByName(m.where("label = 'fake'").select("document_id", "label", "doc_type", "path"), allowMissingColumns=True)
    return both.groupBy("label", "doc_type").agg(F.count("*").alias("documents"))


@query(f"WITH m AS ({P.oracle(P.MANIFEST)}), r AS (SELECT document_id, doc_type, CAST(row_number() OVER (PARTITION BY doc_type ORDER BY md5(document_id), document_id) AS INTEGER) AS rank FROM m) SELECT * FROM r WHERE rank <= 20")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty documents of each type in hash order."""
    return serving.sampled(P.manifest(spark, sf_dir), "document_id", "doc_type", 20).select("document_id", "doc_type", "rank")


SPLIT_SQL = "m AS ({0}), r AS (SELECT document_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(document_id), document_id) AS place, count(*) OVER (PARTITION BY label) AS n FROM m)"


@query(f"WITH {SPLIT_SQL.format(P.oracle(P.MANIFEST))} SELECT document_id, label, CASE WHEN n > 1 AND place <= greatest(1, least(n - 1, round_even(n * 0.2E0, 0))) THEN 'validation' ELSE 'train' END AS split FROM r")
def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of each label's documents for validation."""
    return metrics.split_by_document(P.manifest(spark, sf_dir), "document_id", "label")


@query(f"WITH {SPLIT_SQL.format(P.oracle(P.MANIFEST))} SELECT document_id, label, CASE WHEN n > 1 AND place <= greatest(1, round_even(n * 0.25E0, 0)) THEN 'validation' ELSE 'train' END AS split FROM r")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of each label's rows for validation."""
    return metrics.stratified_split(P.manifest(spark, sf_dir).select("document_id", "label"), "document_id", "label")
