"""The detectors side by side: weighted mean, strong single evidence kept, and the business rules over free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.functions import text as T
from docassay.functions.numbers import as_float, detector_level
from docassay.operators.rules import Rule, reasons_of, score_of

# Weights of the detectors.
WEIGHTS = {"pdf_structure": 0.32, "image_forensics": 0.18, "seal_overlay": 0.12, "ocr_text": 0.18, "business_logic": 0.20}


def business_fields(df: DataFrame, text: str = "text", given: tuple[str, ...] = ()) -> DataFrame:
    """Fields of a document's text; columns named in given are kept as supplied."""
    t = F.coalesce(F.col(text), F.lit(""))
    label_date = r"(?i)(?:报告时间|报告日期|查询时间|Report\s*Date)\s*[:：]?\s*(20[0-9]{2}[-/.年](?:0?[1-9]|1[0-2])[-/.月](?:3[01]|[12][0-9]|0?[1-9])日?)"
    label_birth = r"(?i)(?:出生日期|出生年月日|Birth\s*Date)\s*[:：]?\s*((?:20[0-9]{2}|19[0-9]{2})[-/.年](?:0?[1-9]|1[0-2])[-/.月](?:3[01]|[12][0-9]|0?[1-9])日?)"
    made = {
        "amounts": T.bounded_amounts(t),
        "dates": T.iso_dates(t),
        "id_numbers": T.found(t, T.ID_WORD),
        "account_numbers": T.found(t, T.ACCOUNT_WORD),
        "tax_ids": T.found(t, T.TAX_ID),
        "invoice_numbers": T.found(t, T.INVOICE_NUMBER_LOOSE, 0, 10),
        "upper_amounts": T.found(t, T.UPPER_AMOUNT, 0, 10),
        "credit_report_number": F.regexp_extract(t, r"(?i)(?:报告编号|报告号码|Report\s*(?:No\.?|Number))\s*[:：#]?\s*([A-Za-z0-9]{14,})", 1),
        "credit_report_date": F.get(T.iso_dates(F.regexp_extract(t, label_date, 1)), F.lit(0)),
        "birth_date": F.get(T.iso_dates(F.regexp_extract(t, label_birth, 1)), F.lit(0)),
    }
    return df.withColumns({k: v for k, v in made.items() if k not in given})


# What is found in documents of a type (other: none of those named), in the words of the measures below, and
# its points.
FINDINGS = (
    ("invoice_amount_tax_total_mismatch", "invoice", "amount_count >= 3 and not adds_up", 25),
    ("invoice_amount_fields_sparse", "invoice", "amount_count < 3", 8),
    ("invoice_number_missing", "invoice", "size(invoice_numbers) = 0", 8),
    ("invoice_tax_id_missing", "invoice", "size(tax_ids) = 0", 6),
    ("contract_amount_missing", "contract", "amount_count = 0", 8),
    ("contract_date_missing", "contract", "size(dates) = 0", 8),
    ("contract_party_a_missing", "contract", "not names_party_a", 6),
    ("contract_party_b_missing", "contract", "not names_party_b", 6),
    ("contract_uppercase_amount_weak", "contract", "amount_count > 0 and first_upper_length <= 2", 6),
    ("bank_account_number_missing", "bank_page", "size(account_numbers) = 0", 8),
    ("bank_amount_sequence_sparse", "bank_page", "amount_count < 3", 8),
    ("bank_date_missing", "bank_page", "size(dates) = 0", 6),
    ("credit_report_number_date_mismatch", "credit_report", "number_date <> credit_report_date", 35),
    ("credit_report_future_date", "credit_report", "later_dates > 0", 35),
    ("credit_report_id_birth_date_mismatch", "credit_report", "size(births) > 0 and not array_contains(births, birth_date)", 35),
    ("credit_report_report_after_pdf_creation", "credit_report", "report_day > created_day", 35),
    ("settlement_amount_missing", "settlement_statement receipt", "amount_count = 0", 10),
    ("settlement_account_missing", "settlement_statement receipt", "size(account_numbers) = 0", 8),
    ("settlement_date_missing", "settlement_statement receipt", "size(dates) = 0", 6),
    ("generic_core_fields_missing", "other", "amount_count = 0 and size(dates) = 0 and size(account_numbers) = 0", 8),
)


def business_measures(df: DataFrame, text: Column, created: Column | None) -> DataFrame:
    """What the findings compare, from business_fields."""
    first = lambda k: F.get("amounts", F.lit(k))
    sums = [(0, 1, 2), (0, 2, 1), (1, 2, 0)]  # any of three amounts may be the total
    adds = [F.abs(first(i) + first(j) - first(k)) <= F.greatest(F.lit(0.1), first(k) * 0.002) for i, j, k in sums]
    named = lambda *words: F.contains(text, F.lit(words[0])) | F.contains(text, F.lit(words[1]))
    number, day = F.col("credit_report_number"), lambda x: x.try_cast("date")
    measures = {
        "amount_count": F.size("amounts"),
        "adds_up": adds[0] | adds[1] | adds[2],
        "names_party_a": named("甲方", "Party A"),
        "names_party_b": named("乙方", "Party B"),
        "first_upper_length": F.char_length(F.get("upper_amounts", F.lit(0))),
        "number_date": F.when(number.rlike(r"^\d{14}"), F.concat_ws("-", F.substring(number, 1, 4), F.substring(number, 5, 2), F.substring(number, 7, 2))),
        "report_day": day(F.col("credit_report_date")),
        "later_dates": F.size(F.filter("dates", lambda d: day(d) > day(F.col("credit_report_date")))),
        "births": F.filter(F.transform("id_numbers", T.id_birth), lambda x: x.isNotNull()),
        "created_day": F.lit(None).cast("date") if created is None else day(F.get(T.iso_dates(created), F.lit(0))),
    }
    return df.withColumns(measures)


def business_findings() -> list[Rule]:
    """The findings as rules over business_fields and business_measures."""
    known = sorted({t for _, types, _, _ in FINDINGS for t in types.split()} - {"other"})

    def of(types: str) -> Column:
        return ~F.col("doc_type").isin(known) if types == "other" else F.col("doc_type").isin(types.split())

    return [Rule(code, of(types) & F.expr(predicate), points) for code, types, predicate, points in FINDINGS]


def detect_business(df: DataFrame, text: str = "text", created: Column | None = None, given: tuple[str, ...] = ()) -> DataFrame:
    """business_score, business_level and business_findings of every document."""
    rows = business_fields(df, text, given)
    measured = business_measures(rows, F.coalesce(F.col(text), F.lit("")), created)
    rules = business_findings()
    score = score_of(rules)
    found = measured.withColumns({"business_score": score.cast("double"), "business_level": detector_level(score), "business_findings": reasons_of(rules)})
    return found.select(*rows.columns, "business_score", "business_level", "business_findings")


def seal_component(smask: Column, visual_reasons: Column, best: Column, kind: Column, monochrome: Column) -> tuple[Column, Column]:
    """(score, reasons): a candidate adds reasons only."""
    overlay, red, seen = smask > 0, F.array_contains(visual_reasons, "red_stamp_like_region"), best >= 0.52
    named = F.when(kind == "seal", "color_agnostic_likely_seal_localized").when(kind == "logo", "color_agnostic_likely_logo_localized").otherwise("color_agnostic_unknown_candidate_localized")
    score = F.when(overlay, 18.0).otherwise(0.0) + F.when(red, 12.0).otherwise(0.0)
    reasons = F.array_compact(F.array(F.when(overlay, F.lit("smask_alpha_overlay")), F.when(red, F.lit("red_stamp_like_region")), F.when(seen, named), F.when(seen & (monochrome >= 1), F.lit("monochrome_or_photocopy_seal_candidate"))))
    return F.least(F.lit(100.0), score), reasons


def compose(scores: dict[str, Column], reasons: dict[str, Column], enabled: tuple[str, ...] = tuple(WEIGHTS)) -> tuple[Column, Column, Column]:
    """(score, level, reasons) of the enabled detectors; a component of 60 or more keeps 0.72 of itself. Unknown names are an error."""
    if unknown := set(enabled) - set(WEIGHTS):
        raise ValueError(f"unknown detectors: {sorted(unknown)}")
    names = [n for n in WEIGHTS if n in enabled]
    mean = sum((scores[n] * WEIGHTS[n] for n in names), F.lit(0.0)) / sum(WEIGHTS[n] for n in names)
    most = F.greatest(*(scores[n] for n in names)) if len(names) > 1 else scores[names[0]]
    score = F.bround(F.least(F.lit(100.0), F.when(most >= 60, F.greatest(mean, most * 0.72)).otherwise(mean)), 2)
    listed = F.concat(*(F.transform(reasons[n], lambda r, n=n: F.concat(F.lit(n + ":"), r)) for n in names if n in reasons))
    return score, detector_level(score), F.slice(F.array_distinct(listed), 1, 40)


def integrate(joined: DataFrame, business: DataFrame, enabled: tuple[str, ...] = tuple(WEIGHTS)) -> DataFrame:
    """document_id, score, level, reasons from fusion.evidence and detect_business; business findings stay out of the reasons."""
    rows = joined.join(business.select("document_id", "business_score"), "document_id", "left")
    pdf, visual = as_float("pdf_object_risk_score"), as_float("visual_visual_risk_score")
    visual_reasons = T.split_reasons("visual_visual_risk_reasons")
    seal_score, seal_reasons = seal_component(as_float("pdf_smask_count"), visual_reasons, as_float("visual_seal_best"), F.coalesce("visual_seal_class", F.lit("unknown")), F.lit(0.0))
    ocr = F.greatest(as_float("ocr_ocr_risk_score"), as_float("text_business_risk_score"))
    scores = {"pdf_structure": pdf, "image_forensics": visual, "seal_overlay": seal_score, "ocr_text": ocr, "business_logic": F.coalesce("business_score", F.lit(0.0))}
    reasons = {"pdf_structure": T.split_reasons("pdf_object_risk_reasons"), "image_forensics": visual_reasons, "seal_overlay": seal_reasons, "ocr_text": F.concat(T.split_reasons("ocr_ocr_risk_reasons"), T.split_reasons("text_business_risk_reasons"))}
    score, level, listed = compose(scores, reasons, enabled)
    return rows.select("document_id", score.alias("score"), listed.alias("reasons")).withColumn("level", detector_level("score"))


def one_document(pdf: DataFrame, visual: DataFrame, text: DataFrame, ocr: DataFrame, document_id: str, key: str = "document_id") -> DataFrame:
    """What all tables know of one document, with the fields of its text overlaid by those that were recognised. Every
    table is filtered at its scan. A visual row alone is not a document; JSON that cannot be read adds no fields."""
    own = lambda df: df.where(F.col(key) == document_id)
    fields = lambda c: F.coalesce(F.from_json(F.coalesce(c, F.lit("")), "map<string,string>"), F.create_map().cast("map<string,string>"))
    known = [own(df).select(key, *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key), F.lit(True).alias(f"has_{name}")) for name, df in (("pdf", pdf), ("text", text), ("ocr", ocr))]
    joined = known[0].join(known[1], key, "full").join(known[2], key, "full").join(own(visual), key, "left")
    doc_type = F.coalesce(*(F.nullif(f"{name}_doc_type", F.lit("")) for name in ("pdf", "text", "ocr")), F.lit("other"))
    base, over = fields(F.col("text_extracted_fields_json")), fields(F.col("ocr_ocr_fields_json"))
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k))
    return joined.withColumns({"doc_type": doc_type, "fields": F.map_concat(kept, over)})
