"""Additive evidence rules: (name, predicate, points) evaluated in one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    when: Column
    points: int = 0


def score_of(rules: list[Rule], cap: int = 100) -> Column:
    total = F.lit(0)
    for r in rules:
        if r.points:
            total = total + F.when(r.when, F.lit(r.points)).otherwise(F.lit(0))
    return F.least(F.lit(cap), total)


def reasons_of(rules: list[Rule]) -> Column:
    """Names of the rules that fire, in order; a null predicate does not fire."""
    return F.array_compact(F.array(*(F.when(r.when, F.lit(r.name)) for r in rules)))


def object_rules() -> list[Rule]:
    """Structure of a PDF file."""
    c = F.col
    return [
        Rule("pdf_smask_present", c("smask_count") >= 1, 25),
        Rule("poppler_font_warning", c("font_warning_count") >= 1, 20),
        Rule("full_page_image_with_local_overlays", (c("large_image_count") >= 1) & (c("small_overlay_count") >= 3), 15),
        Rule("dense_pdf_image_overlays", (c("image_count") >= 3 * F.greatest(c("pages"), F.lit(1))) & (c("small_overlay_count") >= 3), 15),
        Rule("missing_creator_producer", (c("creator") == "") & (c("producer") == ""), 10),
        Rule("incremental_update_trace", c("incremental_update_count") > 1, 15),
        Rule("embedded_script_or_file", (c("javascript_count") > 0) | (c("embedded_file_count") > 0), 20),
        Rule("high_font_object_count", c("font_object_count") > 80, 10),
        Rule("interactive_form_or_xfa", c("acroform_count") > 0, 8),
    ]


def text_rules() -> list[Rule]:
    """Text layer and business fields, by document type."""
    c, kind = F.col, F.col("doc_type")
    mismatch = F.abs(c("amount") + c("tax") - c("total")) > 0.05
    return [
        Rule("pdf_text_layer_missing_or_unreadable", (F.lower("ext") == ".pdf") & (c("word_count") == 0), 20),
        Rule("very_sparse_text_layer", c("word_count").between(1, 19), 12),
        Rule("text_layer_repetition", (c("word_count") >= 20) & (c("unique_word_count") / F.greatest(c("word_count"), F.lit(1)) < 0.28), 10),
        Rule("duplicated_text_lines", c("duplicate_line_ratio") >= 0.18, 8),
        Rule("invoice_amount_tax_total_mismatch", (kind == "invoice") & mismatch, 35),
        Rule("invoice_number_missing", (kind == "invoice") & (c("invoice_number_count") == 0), 8),
        Rule("contract_party_field_missing", (kind == "contract") & ((c("party_a") == "") | (c("party_b") == "")), 8),
        Rule("contract_date_missing", (kind == "contract") & (c("date_count") == 0), 8),
        Rule("bank_account_number_missing", (kind == "bank_page") & (c("account_count") == 0), 8),
        Rule("bank_amount_sequence_sparse", (kind == "bank_page") & (c("amount_count") < 2), 8),
        Rule("bank_balance_sequence_broken", (kind == "bank_page") & (c("balance_rows") >= 3) & (c("balance_breaks") >= 1), 30),
        Rule("credit_report_id_missing", (kind == "credit_report") & (c("id_count") == 0), 8),
        Rule("credit_report_date_missing", (kind == "credit_report") & (c("date_count") == 0), 8),
        Rule("settlement_core_fields_missing", (kind == "settlement_statement") & (c("account_count") == 0) & (c("amount_count") == 0), 10),
    ]


def ocr_rules() -> list[Rule]:
    """Recognised words; without words nothing but their absence is said."""
    c, kind = F.col, F.col("doc_type")
    some = c("word_count") > 0
    a, b, z = c("amount_1"), c("amount_2"), c("amount_3")
    none_adds_up = (F.abs(a + b - z) > 0.1) & (F.abs(a + z - b) > 0.1) & (F.abs(b + z - a) > 0.1)
    return [
        Rule("ocr_text_missing", c("word_count") == 0, 20),
        Rule("ocr_low_mean_confidence", some & (c("mean_confidence") < 45), 18),
        Rule("ocr_many_low_confidence_words", some & (c("low_confidence_ratio") > 0.35), 12),
        Rule("ocr_invoice_amount_logic_suspicious", some & (kind == "invoice") & none_adds_up, 25),
        Rule("ocr_bank_amount_sequence_sparse", some & (kind == "bank_page") & (c("amount_count") < 2), 8),
        Rule("ocr_contract_date_missing", some & (kind == "contract") & (c("date_count") == 0), 8),
        Rule("ocr_credit_identity_unresolved", some & (kind == "credit_report") & (c("id_count") == 0), 0),
    ]


def visual_rules() -> list[Rule]:
    """Pixel statistics of a page and its best seal candidate; the last six are tags without points."""
    c = F.col
    best, kind = c("seal_best"), c("seal_class")
    return [
        Rule("high_ela_recompression_error", c("ela") >= 7, 20),
        Rule("local_noise_block_inconsistency", c("block_variance") >= 22, 15),
        Rule("dense_edge_or_paste_boundary", c("edge") >= 18, 10),
        Rule("red_stamp_like_region", c("red") >= 0.012, 10),
        Rule("seal_red_connected_component", (c("red_max_ratio") >= 0.0015) & (c("red_count") >= 1), 8),
        Rule("seal_hard_edge_overlay", (c("edge_contrast") >= 22) & (c("red_max_ratio") >= 0.001), 12),
        Rule("seal_flat_color_overlay", c("red_max_ratio").between(0.001, 0.08) & (c("color_std") > 0) & (c("color_std") <= 28), 8),
        Rule("seal_candidate_color_agnostic", best >= 0.52),
        Rule("seal_candidate_likely_seal", (best >= 0.52) & (kind == "seal")),
        Rule("seal_candidate_likely_logo", (best >= 0.52) & (kind == "logo")),
        Rule("seal_candidate_unknown_review", (best >= 0.52) & ~kind.isin("seal", "logo")),
    ]


def local_rules() -> list[Rule]:
    """Local error levels, noise and copied regions."""
    c = F.col
    return [Rule("local_ela_hotspot", c("ela_p99_ratio") >= 6, 22), Rule("local_noise_hotspot", c("noise_peak_ratio") >= 3.5, 18), Rule("copy_move_match", c("copymove_offset_votes") >= 8, 30)]
