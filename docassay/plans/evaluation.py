"""Metrics, splits and feature preparation over projected scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.operators import metrics
from docassay.plans import projections as P
from docassay.plans.fusion import V3_SQL, fused
from docassay.plans.registry import query


def _metrics_sql(source: str, score: str, scope: str) -> str:
    return f"""SELECT '{scope}' AS scope, count(*) AS sample_count, count(*) FILTER (label = 'fake' AND {score} >= 25) AS tp, count(*) FILTER (label <> 'fake' AND {score} >= 25) AS fp,
  count(*) FILTER (label <> 'fake' AND {score} < 25) AS tn, count(*) FILTER (label = 'fake' AND {score} < 25) AS fn FROM {source} WHERE label IN ('fake', 'normal')"""


@query(f"""WITH {V3_SQL}, c AS ({_metrics_sql("fused", "combined_risk_score", "full_labeled_set")} UNION ALL {_metrics_sql("fused", "marker_free_risk_score", "marker_free_counterfactual")})
SELECT *, coalesce(round_even((tp + tn) / sample_count, 6), 0) AS accuracy, CASE WHEN tp + fp = 0 THEN 0 ELSE round_even(tp / (tp + fp), 6) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0 ELSE round_even(tp / (tp + fn), 6) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE round_even(2 * tp / (2 * tp + fp + fn), 6) END AS f1 FROM c""")
def eval_dual_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dual_scope(fused(spark, sf_dir))


AUC_CTE = "c AS (SELECT value AS s, count(*) FILTER (event_type = 'error') AS p, count(*) FILTER (event_type <> 'error') AS n FROM events WHERE value IS NOT NULL GROUP BY 1)"


@query(f"WITH {AUC_CTE}, w AS (SELECT p, n, p * (coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) AS won FROM c) SELECT round_even(sum(won) / (sum(p) * sum(n)), 6) AS auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives FROM w")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking quality of a value against one type of event."""
    return metrics.roc_auc(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", F.col("event_type") == "error")


@query(f"WITH {AUC_CTE}, w AS (SELECT p, p * sum(p) OVER (ORDER BY s DESC) / sum(p + n) OVER (ORDER BY s DESC) AS x FROM c) SELECT round_even(sum(x) / sum(p), 6) AS average_precision FROM w")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", F.col("event_type") == "error")


@query("""
WITH t AS (SELECT CAST(range AS INTEGER) AS k FROM range(1, 20)), e AS (SELECT (event_id * 37 % 100) / 100.0E0 AS s, event_type = 'purchase' AS y FROM events),
c AS (SELECT k, count(*) FILTER (y AND floor(s * 20 + 1e-9) >= k) AS tp, count(*) FILTER (NOT y AND floor(s * 20 + 1e-9) >= k) AS fp, count(*) FILTER (y AND floor(s * 20 + 1e-9) < k) AS fn FROM t, e GROUP BY k),
f AS (SELECT round_even(k / 20.0E0, 2) AS threshold, tp, fp, fn, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE round_even(2 * tp / (2 * tp + fp + fn), 6) END AS f1 FROM c)
SELECT *, threshold = (SELECT threshold FROM f ORDER BY f1 DESC, threshold LIMIT 1) AS is_best FROM f
""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") * 37 % 100 / 100.0).alias("s"), (F.col("event_type") == "purchase").alias("y"))
    return metrics.threshold_sweep(e, "s", F.col("y"))


@query("""
WITH x AS (SELECT event_type AS y, CASE event_id % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE event_type END AS p FROM events), k AS (SELECT y AS class FROM x UNION SELECT p FROM x),
c AS (SELECT class, (SELECT count(*) FROM x WHERE y = class) AS support, (SELECT count(*) FROM x WHERE p = class) AS predicted, (SELECT count(*) FROM x WHERE p = class AND y = class) AS hits FROM k)
SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE round_even(hits / predicted, 6) END AS precision, CASE WHEN support = 0 THEN 0 ELSE round_even(hits / support, 6) END AS recall, CASE WHEN support + predicted = 0 THEN 0 ELSE round_even(2 * hits / (support + predicted), 6) END AS f1 FROM c
""")
def multiclass_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("y"), F.expr("CASE event_id % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE event_type END").alias("p"))
    return metrics.multiclass(e, "y", "p")


BOXES = f"""SELECT document_id, doc_type AS seal_type, y0 < 0.6 AS has_seal, ring > 0.05 AS detected, x0, y0, x1, y1, x0 + 0.01 AS u0, y0 + ring / 10 AS v0, x1 + 0.01 AS u1, y1 + ring / 10 AS v1 FROM ({P.SEAL}) s"""


@query(f"""
WITH b AS ({P.oracle(BOXES)}), w AS (SELECT *, greatest(0, least(x1, u1) - greatest(x0, u0)) * greatest(0, least(y1, v1) - greatest(y0, v0)) AS i FROM b),
i AS (SELECT *, i / ((x1 - x0) * (y1 - y0) + (u1 - u0) * (v1 - v0) - i) AS iou FROM w)
SELECT coalesce(seal_type, 'all') AS seal_type, count(*) AS samples, count(*) FILTER (has_seal AND detected) AS tp, count(*) FILTER (NOT has_seal AND detected) AS fp, count(*) FILTER (NOT has_seal AND NOT detected) AS tn, count(*) FILTER (has_seal AND NOT detected) AS fn,
  round_even(avg(iou) FILTER (has_seal AND detected), 4) AS mean_iou, coalesce(round_even(count(*) FILTER (has_seal AND detected AND iou >= 0.5) / nullif(count(*) FILTER (has_seal), 0), 4), 0) AS recall_iou_50
FROM i GROUP BY GROUPING SETS ((), (seal_type))
""")
def seal_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Localisation of boxes against boxes moved a little, in all and by type."""
    rows = P.spark_sql(spark, sf_dir, BOXES)
    box = lambda *n: dict(zip(("x0", "y0", "x1", "y1"), map(F.col, n), strict=True))
    return metrics.localisation(rows.withColumn("iou", metrics.iou(box("x0", "y0", "x1", "y1"), box("u0", "v0", "u1", "v1"))), "seal_type")


@query("WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM orders WHERE o_orderkey % 5 <> 0) SELECT o_orderkey, (o_totalprice - m) / d AS o_totalprice FROM orders, s")
def standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column standardised by the mean and deviation of the training rows."""
    return metrics.standardise(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice"), ["o_totalprice"], F.col("o_orderkey") % 5 != 0)


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round_even((1.0E0 / n) / (avg(1.0E0 / n) OVER ()), 6) AS weight FROM c")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_weights(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type")


@query(f"""WITH m AS ({P.oracle(P.MANIFEST)}), c AS (SELECT count(*) FILTER (label = 'fake') AS fake, count(*) FILTER (label = 'normal') AS normal, count(*) FILTER (label = 'fake' AND n % 4 = 0) AS held FROM m)
SELECT list_filter([CASE WHEN fake < 20 THEN 'few_fake_samples' END, CASE WHEN held < 5 THEN 'few_validation_fakes' END, CASE WHEN coalesce(greatest(fake, normal) / nullif(least(fake, normal), 0), 1e9) > 10 THEN 'class_imbalance' END], lambda x: x IS NOT NULL) AS warnings, fake, normal FROM c""")
def data_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.data_warnings(P.manifest(spark, sf_dir).withColumn("split", F.when(F.col("n") % 4 == 0, "validation").otherwise("train")))


@query()
def object_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold AUC of a class-weighted logistic regression on PDF structure."""
    from docassay.operators.learning import out_of_fold

    rows = P.pdf(spark, sf_dir).where(F.col("label").isin("fake", "normal"))
    features = ["pages", "image_count", "small_overlay_count", "smask_count", "font_warning_count", "font_object_count", "acroform_count"]
    scored = out_of_fold(rows.select("document_id", "label", *features), features, folds=3)
    return metrics.roc_auc(scored, "score", F.col("label") == "fake")
