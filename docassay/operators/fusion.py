"""Evidence tables joined by document and scored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docassay.functions.numbers import as_int, first_filled, summary_band
from docassay.functions.text import split_reasons
from docassay.operators.scoring import Verdict, ocr_evidence, scanner_context, scanner_like, score_v2, score_v3, staged, vlm_evidence

KEY = "document_id"
SEAL_TAGS = ("seal_candidate_likely_seal", "seal_candidate_likely_logo", "seal_candidate_unknown_review")


def last_wins(df: DataFrame, position: str, key: str = KEY) -> DataFrame:
    """The last row of each key by position. An aggregate of one struct per key: partial sums meet, not rows."""
    rest = [c for c in df.columns if c not in (key, position)]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(position)).alias("row"))
    return best.select(key, *(F.col("row")[c].alias(c) for c in rest))


def number_rows(df: DataFrame, order: str, group: str | None = None, start: int = 1, name: str = "position") -> DataFrame:
    """Rows numbered in an order, within each group if there is one, without a task that holds a group: rows are dealt to
    ranges, each range is numbered by itself, and the counts of the ranges before it, few rows, give its offset. The number
    of ranges is fixed, so that both readings of them are dealt alike. Equal rows of the order stand in one range."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = [group] if group else []
    dealt = df.repartitionByRange(n, *groups, order).withColumn("range_", F.spark_partition_id())
    before = Window.partitionBy(*groups).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*groups, "range_").agg(F.count("*").alias("here_"))  # one row a range and group
    offsets = counts.select(*(F.col(g).alias(f"{g}_of_") for g in groups), F.col("range_").alias("range_of_"), F.coalesce(F.sum("here_").over(before), F.lit(0)).alias("before_"))
    same = F.col("range_") == F.col("range_of_")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_of_"))
    local = dealt.withColumn("own_", F.row_number().over(Window.partitionBy("range_", *groups).orderBy(order)))
    joined = local.join(F.broadcast(offsets), same)
    return joined.select(*df.columns, (F.col("before_") + F.col("own_") + (start - 1)).alias(name))


def evidence(tables: dict[str, DataFrame], owning: tuple[str, ...] = ("pdf", "visual", "text", "ocr", "seal"), extra: tuple[str, ...] = ("marker", "qwen")) -> DataFrame:
    """Full outer join of the tables that own documents, left join of those that do not.

    Every column becomes <table>_<column>, and has_<table> says whether the document has a row there: an absent row is
    not a row of blanks. All joins are on the key, so one partitioning serves them all.
    """

    def named(t: str) -> DataFrame:
        df = tables[t]
        return df.select(KEY, *(F.col(c).alias(f"{t}_{c}") for c in df.columns if c != KEY), F.lit(True).alias(f"has_{t}"))

    own = [t for t in owning if t in tables]
    joined = reduce(lambda a, b: a.join(b, KEY, "full"), map(named, own))
    joined = reduce(lambda a, b: a.join(named(b), KEY, "left"), [t for t in extra if t in tables], joined)
    present = [F.coalesce(f"has_{t}", F.lit(False)).alias(f"has_{t}") for t in (*own, *(t for t in extra if t in tables))]
    return joined.select(*(c for c in joined.columns if not c.startswith("has_")), *present)


def prefixed(reasons, prefix: str):
    return F.transform(reasons, lambda r: F.concat(F.lit(prefix + ":"), r))


def reasons_in_order(joined: DataFrame):
    """Object, visual, seal (as visual), text. A classified seal replaces the candidate tags of the visual table."""
    visual = split_reasons("visual_visual_risk_reasons")
    classified = F.coalesce(F.col("seal_seal_candidate_class"), F.lit("")) != ""
    visual = F.when(classified, F.filter(visual, lambda r: ~r.isin(*SEAL_TAGS))).otherwise(visual)
    return F.concat(
        prefixed(split_reasons("pdf_object_risk_reasons"), "object"),
        prefixed(visual, "visual"),
        prefixed(split_reasons("seal_seal_ocr_risk_reasons"), "visual"),
        prefixed(split_reasons("text_business_risk_reasons"), "text"),
    )


def fuse(joined: DataFrame, version: str = "v3") -> DataFrame:
    """One scored record a document, with the score that it would have without explicit markers."""
    c = F.col
    rows = joined.withColumn("all_reasons", reasons_in_order(joined))
    ocr_score, ocr_reasons = as_int("ocr_ocr_risk_score"), split_reasons("ocr_ocr_risk_reasons")
    qwen, tags = as_int("qwen_qwen_fx_risk_score"), split_reasons("qwen_qwen_fx_reason_tags")
    object_score, visual_score, business_score = as_int("pdf_object_risk_score"), as_int("visual_visual_risk_score"), as_int("text_business_risk_score")
    marked, tokens = F.coalesce(c("marker_marker_flag").cast("string") == "1", F.lit(False)), F.coalesce("marker_marker_tokens", F.lit(""))

    def ocr(preview):
        return lambda v: ocr_evidence(v, ocr_score, ocr_reasons, preview, c("has_ocr"))

    def vlm(v: Verdict) -> Verdict:
        return vlm_evidence(v, qwen, tags, c("has_qwen"))

    seen = ocr(c("ocr_ocr_text_preview"))
    if version == "v3":
        rows = rows.withColumns(
            {
                "free": staged(c("all_reasons"), lambda r: score_v3(r, F.lit(False), F.lit("")), ocr(None), vlm),
                "full": staged(c("all_reasons"), lambda r: score_v3(r, marked, tokens), seen, vlm),
            }
        )
    else:
        pages = as_int("pdf_pages")
        scanner = scanner_like(c("pdf_creator"), c("pdf_producer"), pages, as_int("pdf_large_image_count"), as_int("pdf_font_object_count"))
        context = scanner_context(c("all_reasons"), scanner, as_int("pdf_javascript_count"), pages)
        rows = rows.withColumn("full", staged(context, lambda r: score_v2(r, object_score, visual_score, business_score, scanner), seen)).withColumn("free", c("full"))
    return rows.select(
        KEY,
        first_filled("pdf_label", "text_label", "visual_label").alias("label"),
        first_filled("pdf_doc_type", "text_doc_type", "visual_doc_type").alias("doc_type"),
        object_score.alias("object_risk_score"),
        visual_score.alias("visual_risk_score"),
        business_score.alias("business_risk_score"),
        c("full")["score"].alias("combined_risk_score"),
        c("full")["confidence"].alias("risk_confidence"),
        c("full")["reasons"].alias("combined_risk_reasons"),
        c("free")["score"].alias("marker_free_risk_score"),
        c("free")["confidence"].alias("marker_free_risk_confidence"),
        (marked.cast("int") if version == "v3" else F.lit(0)).alias("marker_flag"),
        (tokens if version == "v3" else F.lit("")).alias("marker_tokens"),
        F.lit("v3_sign_corrected" if version == "v3" else "v2_evidence_calibrated").alias("scoring_version"),
    )


def band_counts(scored: DataFrame) -> DataFrame:
    """By label: documents, mean score and the number in each band."""
    band = summary_band("combined_risk_score")
    return scored.groupBy("label").agg(F.count("*").alias("documents"), F.bround(F.avg("combined_risk_score"), 2).alias("mean_score"), *(F.count_if(band == b).alias(b) for b in ("high", "medium", "low", "clean")))


def reason_histogram(scored: DataFrame, top: int = 30) -> DataFrame:
    """The commonest reasons; ties by name."""
    return scored.select(F.explode("combined_risk_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(top)
