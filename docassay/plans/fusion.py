"""Rules, fusion and scores over the projected evidence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.functions.text import split_reasons
from docassay.operators import fusion, integrated, scoring
from docassay.plans import projections as P
from docassay.plans.registry import query

SEAL_EVIDENCE = f"""
SELECT document_id, CASE WHEN semantic > 0.4 THEN 'seal' ELSE '' END AS seal_candidate_class,
  CASE WHEN y0 > 0.5 THEN 'seal_position_expected_context' ELSE '' END AS seal_ocr_risk_reasons
FROM ({P.SEAL}) s
"""


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "pdf": P.pdf(spark, sf_dir),
        "visual": P.visual(spark, sf_dir),
        "text": P.text(spark, sf_dir),
        "ocr": P.ocr(spark, sf_dir),
        "seal": P.spark_sql(spark, sf_dir, SEAL_EVIDENCE),
        "marker": P.spark_sql(spark, sf_dir, P.MARKER),
        "qwen": P.spark_sql(spark, sf_dir, P.QWEN),
    }


def fused(spark: SparkSession, sf_dir: str, version: str = "v3") -> DataFrame:
    return fusion.fuse(fusion.evidence(tables(spark, sf_dir)), version)


def joined_reasons(df: DataFrame, *columns: str) -> DataFrame:
    """Reason lists as sorted, joined text: the oracle keeps no order in a set."""
    return df.withColumns({c: F.array_join(F.array_sort(F.array_distinct(c)), "|") for c in columns})


def _weights(name: str, table: dict[str, int]) -> str:
    return f"{name}(reason, w) AS (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {v})' for k, v in table.items())})"


def _split(column: str, prefix: str) -> str:
    return f"list_transform(list_filter(string_split(coalesce({column}, ''), '|'), lambda x: x <> ''), lambda x: '{prefix}:' || x)"


TAGS = ", ".join(f"'visual:{t}'" for t in fusion.SEAL_TAGS)
EVIDENCE_SQL = f"""
{P.PDF_SQL}, {P.VISUAL_SQL}, {P.TEXT_SQL}, {P.OCR_SQL}, seal AS ({P.oracle(SEAL_EVIDENCE)}), marker AS ({P.oracle(P.MARKER)}), qwen AS ({P.oracle(P.QWEN)}),
ids AS (SELECT document_id FROM pdf UNION SELECT document_id FROM visual UNION SELECT document_id FROM text UNION SELECT document_id FROM ocr UNION SELECT document_id FROM seal),
j AS (
  SELECT i.document_id,
    coalesce(nullif(p.label, ''), nullif(t.label, ''), nullif(v.label, ''), '') AS label, coalesce(nullif(p.doc_type, ''), nullif(t.doc_type, ''), nullif(v.doc_type, ''), '') AS doc_type,
    coalesce(p.object_risk_score, 0) AS object_risk_score, coalesce(v.visual_risk_score, 0) AS visual_risk_score, coalesce(t.business_risk_score, 0) AS business_risk_score,
    list_concat({_split("p.object_risk_reasons", "object")},
      CASE WHEN coalesce(s.seal_candidate_class, '') <> '' THEN list_filter({_split("v.visual_risk_reasons", "visual")}, lambda y: y NOT IN ({TAGS})) ELSE {_split("v.visual_risk_reasons", "visual")} END,
      {_split("s.seal_ocr_risk_reasons", "visual")}, {_split("t.business_risk_reasons", "text")}) AS reasons,
    coalesce(m.marker_flag, 0) = 1 AS marked, coalesce(m.marker_tokens, '') AS marker_tokens,
    o.document_id IS NOT NULL AS has_ocr, coalesce(o.ocr_risk_score, 0) AS os, {_split("o.ocr_risk_reasons", "ocr")} AS ocr_reasons, lower(coalesce(o.ocr_text_preview, '')) AS preview,
    q.document_id IS NOT NULL AS has_q, coalesce(q.qwen_fx_risk_score, 0) AS q, {_split("q.qwen_fx_reason_tags", "qwen")} AS q_reasons,
    p.creator, p.producer, coalesce(p.pages, 0) AS pages, coalesce(p.large_image_count, 0) AS large_image_count, coalesce(p.font_object_count, 0) AS font_object_count, coalesce(p.javascript_count, 0) AS javascript_count,
    coalesce(p.smask_count, 0) AS smask_count, p.object_risk_reasons, v.visual_risk_reasons, v.seal_best, v.seal_class, t.business_risk_reasons, o.ocr_risk_reasons, o.ocr_risk_score
  FROM ids i LEFT JOIN pdf p USING (document_id) LEFT JOIN visual v USING (document_id) LEFT JOIN text t USING (document_id) LEFT JOIN ocr o USING (document_id)
    LEFT JOIN seal s USING (document_id) LEFT JOIN marker m USING (document_id) LEFT JOIN qwen q USING (document_id)
)"""


def _ocr_sql(source: str, out: str, score: str, conf: str, markers: bool) -> str:
    soft = "(contains(preview, 'synthetic') OR contains(preview, 'training'))" if markers else "false"
    hard = "(contains(preview, 'edited') OR contains(preview, 'void') OR contains(preview, 'fake'))" if markers else "false"
    return f"""{out} AS (SELECT * EXCLUDE ({score}, {conf}),
    CASE WHEN NOT has_ocr THEN {score} WHEN {hard} THEN greatest({score}, 72) WHEN {soft} THEN greatest({score}, 58)
      WHEN os >= 35 AND {score} >= 18 THEN greatest({score}, least(55, CAST(round_even(({score} + os) / 2 + 8, 0) AS INTEGER)))
      WHEN os >= 25 AND {conf} = 'none' THEN greatest({score}, 12) ELSE {score} END AS {score},
    CASE WHEN NOT has_ocr THEN {conf} WHEN {hard} OR {soft} THEN 'high' WHEN os >= 35 AND {score} >= 18 THEN CASE WHEN {conf} IN ('none', 'low') THEN 'medium' ELSE {conf} END
      WHEN os >= 25 AND {conf} = 'none' THEN 'low' ELSE {conf} END AS {conf} FROM {source})"""


def _qwen_sql(source: str, out: str, score: str, conf: str) -> str:
    return f"""{out} AS (SELECT * EXCLUDE ({score}, {conf}),
    CASE WHEN has_q AND q >= 60 THEN least(100, greatest({score}, least(90, q))) WHEN has_q AND q >= 35 THEN greatest({score}, 40) ELSE {score} END AS {score},
    CASE WHEN has_q AND q >= 60 THEN 'high' WHEN has_q AND q >= 35 AND {conf} IN ('none', 'low') THEN 'medium' ELSE {conf} END AS {conf} FROM {source})"""


MARKS_SQL = """CASE WHEN has_ocr THEN list_concat(ocr_reasons, list_filter([
      CASE WHEN contains(preview, 'synthetic') OR contains(preview, 'training') THEN 'ocr:training_synthetic_marker' END, CASE WHEN contains(preview, 'edited') THEN 'ocr:edited_marker' END,
      CASE WHEN contains(preview, 'void') THEN 'ocr:void_marker' END, CASE WHEN contains(preview, 'fake') THEN 'ocr:fake_marker' END], lambda x: x IS NOT NULL)) ELSE [] END"""
QWEN_MARKS_SQL = "CASE WHEN has_q THEN list_concat(q_reasons, list_filter([CASE WHEN q >= 60 THEN 'qwen:visual_tamper_high' WHEN q >= 35 THEN 'qwen:visual_tamper_medium' END], lambda x: x IS NOT NULL)) ELSE [] END"

V3_SQL = f"""{EVIDENCE_SQL}, {_weights("w3", scoring.V3_WEIGHTS)},
h AS (SELECT document_id, sum(w) AS s, count(DISTINCT split_part(reason, ':', 1)) AS d FROM (SELECT DISTINCT document_id, unnest(reasons) AS reason FROM j) x JOIN w3 USING (reason) GROUP BY 1),
e AS (SELECT j.*, coalesce(d, 0) AS d, coalesce(s, 0) AS s, CASE WHEN coalesce(d, 0) >= 2 THEN least(90, least(84, s) + 10) ELSE least(84, coalesce(s, 0)) END AS ev FROM j LEFT JOIN h USING (document_id)),
a0 AS (SELECT *, ev AS free, CASE WHEN marked THEN greatest(ev, 72) ELSE ev END AS score,
  CASE WHEN d >= 2 OR ev >= 60 THEN 'high' WHEN s > 0 THEN 'medium' ELSE 'none' END AS free_conf,
  CASE WHEN marked OR d >= 2 OR ev >= 60 THEN 'high' WHEN s > 0 THEN 'medium' ELSE 'none' END AS conf FROM e),
{_ocr_sql("a0", "a1", "free", "free_conf", False)}, {_ocr_sql("a1", "a2", "score", "conf", True)}, {_qwen_sql("a2", "a3", "free", "free_conf")}, {_qwen_sql("a3", "a4", "score", "conf")},
fused AS (
  SELECT document_id, label, doc_type, object_risk_score, visual_risk_score, business_risk_score, CAST(score AS INTEGER) AS combined_risk_score, conf AS risk_confidence,
    array_to_string(list_sort(list_distinct(list_concat(reasons, CASE WHEN d >= 2 THEN ['cross:v3_multi_domain_agreement'] ELSE [] END,
      CASE WHEN marked THEN ['marker:explicit_forgery_text' || CASE WHEN marker_tokens <> '' THEN ':' || marker_tokens ELSE '' END] ELSE [] END, {MARKS_SQL}, {QWEN_MARKS_SQL}))), '|') AS combined_risk_reasons,
    CAST(free AS INTEGER) AS marker_free_risk_score, free_conf AS marker_free_risk_confidence, CASE WHEN marked THEN 1 ELSE 0 END AS marker_flag, marker_tokens, 'v3_sign_corrected' AS scoring_version
  FROM a4)"""


@query(f"WITH {V3_SQL} SELECT * FROM fused")
def fuse_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_reasons(fused(spark, sf_dir), "combined_risk_reasons")


SCAN_SQL = "(" + " OR ".join(f"contains(lower(coalesce(creator, '') || ' ' || coalesce(producer, '')), '{w}')" for w in scoring.SCANNER_WORDS) + ") AND large_image_count >= greatest(1, floor(greatest(pages, 1) / 2)) AND font_object_count = 0 AND creator IS NOT NULL"
EXPLAINED_SQL = ", ".join(f"'{r}'" for r in scoring.SCANNER_EXPLAINS)
V2_VISUAL_SQL, V2_CORR_SQL = (", ".join(f"'{r}'" for r in x) for x in (scoring.V2_VISUAL, scoring.V2_CORROBORATING))


@query(f"""
WITH {EVIDENCE_SQL}, {_weights("strong", scoring.V2_STRONG)}, {_weights("weak", scoring.V2_WEAK)},
k AS (SELECT *, coalesce({SCAN_SQL}, false) AS scanner FROM j),
k1 AS (SELECT * EXCLUDE (reasons), CASE WHEN scanner THEN list_transform(reasons, lambda r: CASE WHEN r = 'object:full_page_image_with_local_overlays' THEN 'object:scanner_image_layer_review'
  WHEN r = 'object:embedded_script_or_file' AND javascript_count <= pages THEN 'object:scanner_annotation_or_app_metadata'
  WHEN r IN ({EXPLAINED_SQL}) THEN replace(r, 'visual:', 'visual:scanner_') ELSE r END) ELSE reasons END AS reasons FROM k),
u AS (SELECT DISTINCT document_id, unnest(reasons) AS reason FROM k1),
st AS (SELECT document_id, sum(w) AS s, max(CASE WHEN reason LIKE 'object:%' THEN 1 ELSE 0 END) AS st, max(CASE WHEN reason LIKE 'text:%' THEN 1 ELSE 0 END) AS lg, max(CASE WHEN reason IN ({V2_VISUAL_SQL}) THEN 1 ELSE 0 END) AS vi, max(CASE WHEN reason IN ({V2_CORR_SQL}) THEN 1 ELSE 0 END) AS co FROM u JOIN strong USING (reason) GROUP BY 1),
we AS (SELECT document_id, sum(w) AS wk FROM u JOIN weak USING (reason) GROUP BY 1),
b AS (SELECT k1.*, coalesce(s, 0) AS s, coalesce(wk, 0) AS wk, coalesce(st, 0) AS st, coalesce(lg, 0) AS lg, coalesce(vi, 0) AS vi, coalesce(co, 0) AS co, coalesce(st, 0) + coalesce(lg, 0) + coalesce(vi, 0) AS n
  FROM k1 LEFT JOIN st USING (document_id) LEFT JOIN we USING (document_id)),
b1 AS (SELECT *, greatest(least(78, s), CAST(round_even(object_risk_score * 0.28E0 + visual_risk_score * 0.38E0 + business_risk_score * 0.18E0, 0) AS INTEGER)) + least(12, wk) + CASE WHEN n >= 2 THEN 12 WHEN co > 0 AND wk > 0 THEN 5 ELSE 0 END AS x FROM b),
b2 AS (SELECT *, CASE WHEN object_risk_score >= 80 AND st > 0 AND NOT scanner THEN greatest(x, 62) ELSE x END AS x2 FROM b1),
b3 AS (SELECT *, CASE WHEN visual_risk_score >= 45 AND vi > 0 THEN greatest(x2, 55) ELSE x2 END AS x3 FROM b2),
b4 AS (SELECT *, least(100, CASE WHEN business_risk_score >= 45 AND lg > 0 THEN greatest(x3, 50) ELSE x3 END) AS score FROM b3),
a0 AS (SELECT *, CASE WHEN s > 0 THEN CASE WHEN n >= 2 OR score >= 60 THEN 'high' ELSE 'medium' END WHEN wk > 0 THEN 'low' ELSE 'none' END AS conf FROM b4),
{_ocr_sql("a0", "a1", "score", "conf", True)}
SELECT document_id, label, doc_type, CAST(score AS INTEGER) AS combined_risk_score, conf AS risk_confidence,
  array_to_string(list_sort(list_distinct(list_concat(reasons, CASE WHEN n >= 2 THEN ['cross:v2_strong_multi_domain_agreement'] WHEN co > 0 AND wk > 0 THEN ['cross:v2_strong_weak_corroboration'] ELSE [] END, {MARKS_SQL}))), '|') AS combined_risk_reasons
FROM a1
""")
def fuse_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joined_reasons(fused(spark, sf_dir, "v2"), "combined_risk_reasons")
    return out.select("document_id", "label", "doc_type", "combined_risk_score", "risk_confidence", "combined_risk_reasons")


@query(f"WITH {V3_SQL} SELECT document_id, combined_risk_score - marker_free_risk_score AS marker_share, marker_free_risk_score, marker_free_risk_confidence FROM fused WHERE combined_risk_score <> marker_free_risk_score")
def marker_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose score rests on explicit markers, and what is left without them."""
    s, f = F.col("combined_risk_score"), F.col("marker_free_risk_score")
    return fused(spark, sf_dir).where(s != f).select("document_id", (s - f).alias("marker_share"), "marker_free_risk_score", "marker_free_risk_confidence")


@query(f"""WITH {V3_SQL} SELECT label, count(*) AS documents, round_even(avg(combined_risk_score), 2) AS mean_score, count(*) FILTER (combined_risk_score >= 60) AS high,
count(*) FILTER (combined_risk_score >= 25 AND combined_risk_score < 60) AS medium, count(*) FILTER (combined_risk_score > 0 AND combined_risk_score < 25) AS low, count(*) FILTER (combined_risk_score <= 0) AS clean FROM fused GROUP BY label""")
def band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.band_counts(fused(spark, sf_dir))


@query(f"WITH {V3_SQL} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(combined_risk_reasons, '|')) AS reason FROM fused WHERE combined_risk_reasons <> '') x GROUP BY reason ORDER BY n DESC, reason LIMIT 30")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.reason_histogram(fused(spark, sf_dir))


@query(f"WITH {P.PDF_SQL} SELECT document_id, object_risk_score, object_risk_reasons FROM pdf")
def object_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pdf(spark, sf_dir).select("document_id", "object_risk_score", "object_risk_reasons")


@query(f"WITH {P.TEXT_SQL} SELECT document_id, business_risk_score, business_risk_reasons FROM text")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.text(spark, sf_dir).select("document_id", "business_risk_score", "business_risk_reasons")


@query(f"WITH {P.OCR_SQL} SELECT document_id, ocr_risk_score, ocr_risk_reasons FROM ocr")
def ocr_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ocr(spark, sf_dir).select("document_id", "ocr_risk_score", "ocr_risk_reasons")


@query(f"WITH {P.VISUAL_SQL} SELECT document_id, visual_risk_score, visual_risk_reasons FROM visual")
def visual_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.visual(spark, sf_dir).select("document_id", "visual_risk_score", "visual_risk_reasons")


@query(f"WITH {P.PDF_SQL} SELECT label, doc_type, count(*) AS documents, CAST(sum(smask_count) AS BIGINT) AS smask_count, CAST(sum(font_warning_count) AS BIGINT) AS font_warning_count, round_even(avg(object_risk_score), 2) AS mean_score FROM pdf GROUP BY 1, 2")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.pdf(spark, sf_dir)
    return rows.groupBy("label", "doc_type").agg(F.count("*").alias("documents"), F.sum("smask_count").alias("smask_count"), F.sum("font_warning_count").alias("font_warning_count"), F.bround(F.avg("object_risk_score"), 2).alias("mean_score"))


@query(f"""WITH {P.TEXT_SQL}, r AS (SELECT label, doc_type, unnest(string_split(business_risk_reasons, '|')) AS reason FROM text WHERE business_risk_reasons <> '')
SELECT label, doc_type, reason, count(*) AS n FROM r GROUP BY ALL""")
def text_reasons_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal sets of reasons are counted before they are split; a filter or a split of the rows would read the texts again."""
    sets = P.text(spark, sf_dir).groupBy("label", "doc_type", "business_risk_reasons").agg(F.count("*").alias("n"))
    return sets.select("label", "doc_type", "n", F.explode(split_reasons("business_risk_reasons")).alias("reason")).groupBy("label", "doc_type", "reason").agg(F.sum("n").alias("n"))


INTEGRATED_SQL = f"""WITH {EVIDENCE_SQL},
d AS (SELECT j.document_id, object_risk_score AS pdf, visual_risk_score AS vis, least(100, CASE WHEN smask_count > 0 THEN 18 ELSE 0 END + CASE WHEN list_contains(string_split(coalesce(visual_risk_reasons, ''), '|'), 'red_stamp_like_region') THEN 12 ELSE 0 END) AS seal,
  greatest(coalesce(ocr_risk_score, 0), business_risk_score) AS ocr, business_risk_score / 2.0 AS biz FROM j),
m AS (SELECT *, (0.32E0 * pdf + 0.18E0 * vis + 0.12E0 * seal + 0.18E0 * ocr + 0.20E0 * biz) AS mean, greatest(pdf, vis, seal, ocr, biz) AS most FROM d),
s AS (SELECT document_id, round_even(least(100, CASE WHEN most >= 60 THEN greatest(mean, most * 0.72E0) ELSE mean END), 2) AS score FROM m)
SELECT document_id, score, CASE WHEN score >= 60 THEN 'high' WHEN score >= 25 THEN 'medium' WHEN score >= 15 THEN 'low' ELSE 'clean' END AS level FROM s"""


@query(INTEGRATED_SQL)
def integrated_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    business = P.text(spark, sf_dir).select("document_id", (F.col("business_risk_score") / 2.0).alias("business_score"))
    return integrated.integrate(fusion.evidence(tables(spark, sf_dir)), business).select("document_id", "score", "level")
