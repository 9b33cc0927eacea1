"""Evidence scores of one document, as columns over its reasons.

Each function takes and returns (score, confidence, reasons) columns, so that scores compose within one projection.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from docassay.functions.text import ocr_markers

# Weights of reasons.
V3_WEIGHTS = {
    "object:pdf_smask_present": 26,
    "object:embedded_script_or_file": 10,
    "visual:seal_hard_edge_overlay": 14,
    "visual:ela_high_error_region": 14,
    "visual:jpeg_block_artifact_inconsistency": 12,
    "text:invoice_amount_tax_total_mismatch": 24,
    "text:settlement_amount_total_mismatch": 24,
    "text:bank_balance_sequence_broken": 20,
    "text:contract_amount_date_conflict": 20,
    "text:bank_account_number_missing": 16,
    "text:bank_amount_sequence_sparse": 8,
    "text:duplicated_text_lines": 8,
    "object:poppler_font_warning": 6,
}
V2_STRONG = {
    "object:pdf_smask_present": 26,
    "object:full_page_image_with_local_overlays": 24,
    "object:dense_pdf_image_overlays": 20,
    "object:embedded_script_or_file": 18,
    "object:poppler_font_warning": 10,
    "object:high_font_object_count": 8,
    "object:incremental_update": 8,
    "visual:local_noise_block_inconsistency": 12,
    "visual:dense_edge_or_paste_boundary": 10,
    "visual:ela_high_error_region": 16,
    "visual:jpeg_block_artifact_inconsistency": 14,
    "visual:seal_hard_edge_overlay": 16,
    "text:invoice_amount_tax_total_mismatch": 22,
    "text:settlement_amount_total_mismatch": 22,
    "text:bank_balance_sequence_broken": 18,
    "text:contract_amount_date_conflict": 18,
    "text:duplicated_text_lines": 12,
    "text:text_layer_repetition": 10,
}
V2_WEAK = {
    "object:missing_creator_producer": 4,
    "text:pdf_text_layer_missing_or_unreadable": 4,
    "text:very_sparse_text_layer": 4,
    "text:credit_report_id_missing": 3,
    "text:credit_report_date_missing": 3,
    "text:bank_account_number_missing": 3,
    "text:contract_date_missing": 3,
    "text:contract_party_field_missing": 3,
    "text:invoice_number_missing": 3,
    "text:bank_amount_sequence_sparse": 4,
    "visual:red_stamp_like_region": 3,
    "visual:seal_red_connected_component": 4,
    "visual:seal_flat_color_overlay": 4,
}
# Reasons that count as corroboration, and those that a scanner explains.
V2_VISUAL = ("visual:seal_hard_edge_overlay", "visual:ela_high_error_region", "visual:jpeg_block_artifact_inconsistency")
V2_CORROBORATING = (
    "object:pdf_smask_present",
    "object:dense_pdf_image_overlays",
    "object:embedded_script_or_file",
    "object:full_page_image_with_local_overlays",
    *V2_VISUAL,
    "text:invoice_amount_tax_total_mismatch",
    "text:settlement_amount_total_mismatch",
    "text:bank_balance_sequence_broken",
    "text:contract_amount_date_conflict",
)
SCANNER_WORDS = ("intsig", "docucentre", "quartz", "qqbrowser", "scanner", "scan", "camscanner")
SCANNER_EXPLAINS = ("visual:local_noise_block_inconsistency", "visual:dense_edge_or_paste_boundary", "visual:seal_red_connected_component", "visual:seal_flat_color_overlay", "visual:red_stamp_like_region")
HARD_MARKERS = ("ocr:edited_marker", "ocr:void_marker", "ocr:fake_marker")


class Verdict(NamedTuple):
    score: Column
    confidence: Column
    reasons: Column


    def struct(self) -> Column:
        return F.struct(self.score.alias("score"), self.confidence.alias("confidence"), self.reasons.alias("reasons"))


def let(value: Column, f) -> Column:
    """f of a value that is computed once a row, however often f names it; projections that are merged would repeat it."""
    return F.transform(F.array(value), f)[0]


def staged(value: Column, *steps) -> Column:
    """A verdict struct from a value through steps, each of which takes and returns a Verdict but the first, which takes the value."""

    def after(step):
        return lambda v: step(Verdict(v["score"], v["confidence"], v["reasons"])).struct()

    out = let(value, lambda x: steps[0](x).struct())
    for step in steps[1:]:
        out = let(out, after(step))
    return out


def weigh(reasons: Column, weights: dict[str, int]) -> Column:
    """Sum of the weights of the reasons that have one."""
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    return F.aggregate(reasons, F.lit(0), lambda a, r: a + F.coalesce(F.try_element_at(table, r), F.lit(0)))


def among(reasons: Column, names) -> Column:
    return F.array_intersect(reasons, F.array(*map(F.lit, names)))


def domains(hits: Column) -> Column:
    return F.size(F.array_distinct(F.transform(hits, lambda r: F.substring_index(r, ":", 1))))


def score_v3(reasons: Column, marked: Column, tokens: Column) -> Verdict:
    """Sum of weights up to 84; two domains add 10, up to 90; an explicit marker lifts to 72."""
    unique = F.array_distinct(reasons)
    hits = among(unique, V3_WEIGHTS)
    several = domains(hits) >= 2
    base = F.least(F.lit(84), weigh(unique, V3_WEIGHTS))
    evidence = F.when(several, F.least(F.lit(90), base + 10)).otherwise(base)
    score = F.when(marked, F.greatest(evidence, F.lit(72))).otherwise(evidence)
    tag = F.concat(F.lit("marker:explicit_forgery_text"), F.when(F.coalesce(tokens, F.lit("")) != "", F.concat(F.lit(":"), tokens)).otherwise(""))
    more = F.array_compact(F.array(F.when(several, F.lit("cross:v3_multi_domain_agreement")), F.when(marked, tag)))
    confidence = F.when(marked | several | (score >= 60), "high").when(F.size(hits) > 0, "medium").otherwise("none")
    return Verdict(F.least(F.lit(100), score), confidence, F.concat(unique, more))


def scanner_like(creator: Column, producer: Column, pages: Column, large_images: Column, fonts: Column) -> Column:
    name = F.lower(F.concat_ws(" ", F.coalesce(creator, F.lit("")), F.coalesce(producer, F.lit(""))))
    named = F.lit(False)
    for w in SCANNER_WORDS:
        named = named | F.contains(name, F.lit(w))
    half = F.floor(F.greatest(pages, F.lit(1)) / 2)
    return F.coalesce(named & (large_images >= F.greatest(F.lit(1), half)) & (fonts == 0), F.lit(False))


def scanner_context(reasons: Column, scanner: Column, javascript: Column, pages: Column) -> Column:
    """On scanned documents, reasons that the scanner explains become review tags without weight."""
    explained = F.array(*map(F.lit, SCANNER_EXPLAINS))

    def rewrite(r: Column) -> Column:
        return (
            F.when(r == "object:full_page_image_with_local_overlays", F.lit("object:scanner_image_layer_review"))
            .when((r == "object:embedded_script_or_file") & (javascript <= pages), F.lit("object:scanner_annotation_or_app_metadata"))
            .when(F.array_contains(explained, r), F.regexp_replace(r, "^visual:", "visual:scanner_"))
            .otherwise(r)
        )

    return F.when(scanner, F.transform(reasons, rewrite)).otherwise(reasons)


def score_v2(reasons: Column, object_score: Column, visual_score: Column, business_score: Column, scanner: Column) -> Verdict:
    """The calibrated score; reasons have been through scanner_context."""
    unique = F.array_distinct(reasons)
    strong, weak = among(unique, V2_STRONG), among(unique, V2_WEAK)
    starts = lambda p: F.exists(strong, lambda r: r.startswith(p))
    structural, logic, visual = starts("object:"), starts("text:"), F.size(among(strong, V2_VISUAL)) > 0
    n = structural.cast("int") + visual.cast("int") + logic.cast("int")
    calibrated = F.bround(object_score * 0.28 + visual_score * 0.38 + business_score * 0.18).cast("int")
    base = F.greatest(F.least(F.lit(78), weigh(unique, V2_STRONG)), calibrated) + F.least(F.lit(12), weigh(unique, V2_WEAK))
    corroborated = (F.size(among(strong, V2_CORROBORATING)) > 0) & (F.size(weak) > 0)
    score = base + F.when(n >= 2, 12).when(corroborated, 5).otherwise(0)
    for lifted, floor in (((object_score >= 80) & structural & ~scanner, 62), ((visual_score >= 45) & visual, 55), ((business_score >= 45) & logic, 50)):
        score = F.when(lifted, F.greatest(score, F.lit(floor))).otherwise(score)
    score = F.least(F.lit(100), F.greatest(F.lit(0), score))
    tag = F.array_compact(F.array(F.when(n >= 2, F.lit("cross:v2_strong_multi_domain_agreement")).when(corroborated, F.lit("cross:v2_strong_weak_corroboration"))))
    confidence = F.when(F.size(strong) > 0, F.when((n >= 2) | (score >= 60), "high").otherwise("medium")).when(F.size(weak) > 0, "low").otherwise("none")
    return Verdict(score, confidence, F.concat(unique, tag))


def ocr_evidence(v: Verdict, ocr_score: Column, ocr_reasons: Column, preview: Column | None, present: Column) -> Verdict:
    """Evidence of recognised text; without preview its markers are left out."""
    marks = ocr_markers(preview) if preview is not None else F.array().cast("array<string>")
    marked = F.size(marks) > 0
    hard = F.arrays_overlap(marks, F.array(*map(F.lit, HARD_MARKERS)))
    joint = (ocr_score >= 35) & (v.score >= 18)
    weak = (ocr_score >= 25) & (v.confidence == "none")
    mean = F.least(F.lit(55), F.bround((v.score + ocr_score) / 2 + 8).cast("int"))
    score = F.when(marked, F.greatest(v.score, F.when(hard, 72).otherwise(58))).when(joint, F.greatest(v.score, mean)).when(weak, F.greatest(v.score, F.lit(12))).otherwise(v.score)
    confidence = F.when(marked, F.lit("high")).when(joint, F.when(v.confidence.isin("none", "low"), F.lit("medium")).otherwise(v.confidence)).when(weak, F.lit("low")).otherwise(v.confidence)
    reasons = F.array_distinct(F.concat(v.reasons, F.transform(ocr_reasons, lambda r: F.concat(F.lit("ocr:"), r)), marks))
    return Verdict(F.when(present, F.least(F.lit(100), score)).otherwise(v.score), F.when(present, confidence).otherwise(v.confidence), F.when(present, reasons).otherwise(v.reasons))


def vlm_evidence(v: Verdict, q: Column, tags: Column, present: Column) -> Verdict:
    """The verdict of a vision model as one more channel."""
    high, medium = q >= 60, (q >= 35) & (q < 60)
    score = F.when(high, F.greatest(v.score, F.least(F.lit(90), q))).when(medium, F.greatest(v.score, F.lit(40))).otherwise(v.score)
    confidence = F.when(high, F.lit("high")).when(medium & v.confidence.isin("none", "low"), F.lit("medium")).otherwise(v.confidence)
    tag = F.array_compact(F.array(F.when(high, F.lit("qwen:visual_tamper_high")).when(medium, F.lit("qwen:visual_tamper_medium"))))
    reasons = F.array_distinct(F.concat(v.reasons, tag, F.transform(F.slice(tags, 1, 5), lambda t: F.concat(F.lit("qwen:"), t))))
    return Verdict(F.when(present, F.least(F.lit(100), score)).otherwise(v.score), F.when(present, confidence).otherwise(v.confidence), F.when(present, reasons).otherwise(v.reasons))
