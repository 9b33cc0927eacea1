"""Scores of single documents against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from docassay.operators import fusion, metrics, scoring
from docassay.operators.rules import Rule, reasons_of, score_of


def one(spark, struct):
    return spark.range(1).select(struct.alias("x")).first()["x"]


def listed(*reasons):
    return F.array(*map(F.lit, reasons)) if reasons else F.array().cast("array<string>")


@pytest.mark.parametrize(
    ("reasons", "marked", "score", "confidence"),
    [
        ((), False, 0, "none"),
        (("object:pdf_smask_present",), False, 26, "medium"),
        (("object:pdf_smask_present", "text:bank_account_number_missing"), False, 52, "high"),
        (("object:pdf_smask_present", "object:pdf_smask_present"), False, 26, "medium"),
        (("object:incremental_update_trace", "visual:high_ela_recompression_error"), False, 0, "none"),
        ((), True, 72, "high"),
        (tuple(scoring.V3_WEIGHTS), False, 90, "high"),
    ],
)
def test_v3(spark, reasons, marked, score, confidence):
    got = one(spark, scoring.staged(listed(*reasons), lambda r: scoring.score_v3(r, F.lit(marked), F.lit("x"))))
    assert (got["score"], got["confidence"]) == (score, confidence)
    assert ("marker:explicit_forgery_text:x" in got["reasons"]) is marked


def test_ocr_evidence_rounds_half_to_even_and_marks_lift(spark):
    base = lambda r: scoring.score_v3(r, F.lit(False), F.lit(""))
    step = lambda q, text: lambda v: scoring.ocr_evidence(v, F.lit(q), listed("low"), F.lit(text), F.lit(True))
    smask = listed("object:pdf_smask_present")
    assert one(spark, scoring.staged(smask, base, step(35, "")))["score"] == 38  # (26 + 35) / 2 + 8 = 38.5
    assert one(spark, scoring.staged(smask, base, step(0, "VOID")))["score"] == 72
    assert one(spark, scoring.staged(smask, base, step(0, "training")))["score"] == 58
    weak = one(spark, scoring.staged(listed(), base, step(25, "")))
    assert (weak["score"], weak["confidence"], weak["reasons"]) == (12, "low", ["ocr:low"])


def test_vlm_evidence(spark):
    base = lambda r: scoring.score_v3(r, F.lit(False), F.lit(""))
    step = lambda q: lambda v: scoring.vlm_evidence(v, F.lit(q), listed(*"abcdef"), F.lit(True))
    high, medium, low = (one(spark, scoring.staged(listed(), base, step(q))) for q in (95, 35, 34))
    assert (high["score"], high["confidence"]) == (90, "high")
    assert (medium["score"], medium["confidence"]) == (40, "medium")
    assert (low["score"], low["confidence"], low["reasons"]) == (0, "none", ["qwen:a", "qwen:b", "qwen:c", "qwen:d", "qwen:e"])


def test_rules_ignore_null_predicates_and_cap(spark):
    rules = [Rule("a", F.lit(None).cast("boolean"), 50), Rule("b", F.lit(True), 70), Rule("c", F.lit(True), 70)]
    got = spark.range(1).select(score_of(rules).alias("s"), reasons_of(rules).alias("r")).first()
    assert (got["s"], got["r"]) == (100, ["b", "c"])


def test_dual_scope_counts(spark):
    rows = [("fake", 80, 10), ("fake", 30, 30), ("fake", 0, 0), ("normal", 40, 30), ("normal", 0, 0), ("uploaded", 90, 90)]
    df = spark.createDataFrame(rows, "label string, combined_risk_score int, marker_free_risk_score int")
    got = {r["scope"]: (r["sample_count"], r["tp"], r["fp"], r["tn"], r["fn"]) for r in metrics.dual_scope(df).collect()}
    assert got == {"full_labeled_set": (5, 2, 1, 1, 1), "marker_free_counterfactual": (5, 1, 1, 1, 2)}


def test_evidence_keeps_absent_rows_apart_from_blank_ones(spark):
    pdf = spark.createDataFrame([("d1", "", "invoice")], "document_id string, label string, doc_type string")
    text = spark.createDataFrame([("d1", "fake", "x"), ("d2", "normal", "y")], "document_id string, label string, doc_type string")
    got = {r["document_id"]: (r["has_pdf"], r["has_text"]) for r in fusion.evidence({"pdf": pdf, "text": text}).collect()}
    assert got == {"d1": (True, True), "d2": (False, True)}


def test_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("b", 2, "y")], "document_id string, position int, v string")
    assert {r["document_id"]: r["v"] for r in fusion.last_wins(df, "position").collect()} == {"a": None, "b": "y"}


def test_auc_with_ties_and_empty(spark):
    df = spark.createDataFrame([(0.1, False), (0.5, True), (0.5, False), (0.9, True)], "s double, y boolean")
    assert metrics.roc_auc(df, "s", F.col("y")).first()["auc"] == 0.875
    assert metrics.roc_auc(df.limit(0), "s", F.col("y")).first()["auc"] is None


def test_rows_are_numbered_across_ranges(spark):
    from docassay.operators.fusion import number_rows

    rows = [(f"k{i:04d}", None if i % 5 == 0 else "ab"[i % 2]) for i in range(500)]
    df = spark.createDataFrame(rows, "id string, kind string").repartition(7)
    got = {(r["kind"], r["n"]): r["id"] for r in number_rows(df, "id", "kind", start=0, name="n").collect()}
    for kind in (None, "a", "b"):
        ids = sorted(i for i, k in rows if k == kind)
        assert [got[kind, n] for n in range(len(ids))] == ids
    plain = number_rows(df, "id").orderBy("id").collect()
    assert [r["position"] for r in plain] == list(range(1, 501))
    assert number_rows(df.limit(0), "id", "kind").count() == 0
