"""Sections, identity values, fonts and model answers."""

from pyspark.sql import functions as F

from docassay.operators import credit, seals, serving, vlm
from docassay.plans import generated


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


PERSONAL = "\f封面\n\f个人基本信息\n证件号码：\n\n 110101199001011234\n出生日期 1990-01-01\n信息概要\n证件号码 110101199001011299\n"
NAME, CODE, CREDIT = "测试有限公司", "1234567890123456", "91110000ABCDEFGH12"


def enterprise(second_name=NAME, extra=""):
    cover = f"企业信用报告\n企业名称：{NAME}\n中征码：{CODE}\n统一社会信用代码：{CREDIT}\n"
    return f"{cover}\f正文\n身份标识\n企业名称 {second_name}\n{extra}中征码\n{CODE}\n统一社会信用代码 {CREDIT}\n"


def test_personal_section_ends_at_the_next_heading(spark):
    section = credit.personal_section(F.lit(PERSONAL))
    ids, births = credit.personal_values(section)
    assert value(spark, ids) == ["110101199001011234"]
    assert value(spark, births) == ["1990-01-01"]
    rule = credit.birth_rule(ids, births, F.lit(True), F.lit(True))
    assert value(spark, rule) == "pass"
    assert value(spark, credit.birth_rule(ids, F.array(F.lit("1990-01-02")), F.lit(True), F.lit(True))) == "fail"
    assert value(spark, credit.birth_rule(ids, births, F.lit(False), F.lit(True))) == "not_applicable"
    assert value(spark, credit.birth_rule(ids, births, F.lit(True), F.lit(False))) == "manual"
    assert value(spark, credit.personal_section(F.lit("nothing"))) == []


def test_enterprise_identity(spark):
    rule = lambda text, native=True: value(spark, credit.enterprise_identity(F.lit(text), F.lit(native)))
    assert rule(enterprise()) == "pass"
    assert rule(enterprise("另一家公司")) == "fail"
    assert rule(enterprise("另一家公司"), False) == "manual"
    assert rule(enterprise(extra="企业名称 第三家公司\n")) == "manual"
    assert rule("no identity") == "manual"


def test_sections_of_a_report_are_read_once(spark):
    """What a lambda function takes from outside is computed again for every line, so sections must be bound."""
    row = spark.createDataFrame([(enterprise(), True)], "text string, native boolean")
    pieces = lambda column: row.select(column.alias("x"))._jdf.queryExecution().analyzed().toString().count("split(text")
    pages = lambda column: row.select(column.alias("x"))._jdf.queryExecution().analyzed().toString().count("regexp_replace(translate(text")
    assert pages(credit.enterprise_identity(F.col("text"), F.col("native"))) <= 4
    assert pages(credit.let(credit.personal_section(F.col("text")), lambda s: credit.birth_rule(*credit.personal_values(s), F.lit(True), F.col("native")))) == 1
    assert pieces(credit.after_label(F.split("text", "\n"), "label")) == 1


def test_reports_are_spread_over_the_cores(spark, tmp_path):
    from docassay.plans import credit as plans

    spark.range(40).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    rows = plans.full(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert rows.select("source_id").distinct().count() == 40


def test_fonts_must_be_the_allowed_ones(spark):
    good = "name type encoding emb sub uni\n---- ----\nABCDEF+Helvetica Type 1 WinAnsi no no no\nGHIJKL+SourceHanSerifCN-Regular CID TrueType Identity-H yes yes yes\n"
    rule = lambda text: value(spark, credit.fonts_rule(F.lit(text)))
    assert rule(good) == "pass"
    assert rule(good + "Arial Type 1 WinAnsi no no no\n") == "possible"
    assert rule(good.replace("yes yes yes", "yes no yes")) == "possible"
    assert rule("") == "manual"


def test_variants(spark):
    kind = lambda text, embedded=True: value(spark, credit.variant(F.lit(text), F.lit(embedded)))
    assert kind(enterprise()) == "online_enterprise"
    assert kind(enterprise(), False) == "scanned_enterprise"
    assert kind("查询机构：某租赁公司 报告时间\n" + enterprise()) == "leasing_enterprise"
    assert kind("个人信用报告 自主查询版") == "online_personal"
    assert kind("个人信用报告 还款状态") == "pboc_print_personal"
    assert kind("x") == "unknown"


def test_missing_rules_count_as_manual(spark):
    df = spark.createDataFrame([("a", "G1", "pass"), ("a", "G2", "fail"), ("a", "A0", "manual"), ("b", "G1", "pass")], "source_id string, rule_id string, status string")
    got = {r["source_id"]: (r["pass"], r["fail"], r["manual"], r["overall_status"]) for r in credit.status_counts(df).collect()}
    assert got == {"a": (1, 1, 20, "fail"), "b": (1, 0, 21, "manual")}


def test_model_answers(spark):
    good = 'Sure: {"risk_score": 140, "reason_tags": ["x"], "seal_candidates": [{"bbox": [0.1, 0.1, 0.5, 0.5], "pasted_suspicion": 170}, {"bbox": [0.5, 0.1, 0.1, 0.5]}, {"bbox": [1, 2]}]} done'
    df = spark.createDataFrame([("a", good), ("b", "no json"), ("c", None)], "document_id string, raw string")
    got = {r["document_id"]: r for r in vlm.answers(df, "raw").collect()}
    assert got["a"]["qwen_fx_risk_score"] == 100 and len(got["a"]["seal_boxes"]) == 1 and got["a"]["seal_boxes"][0]["pasted_suspicion"] == 100
    assert got["b"]["qwen_fx_error"] == got["c"]["qwen_fx_error"] == "unreadable_answer"


def test_seal_text_lifts_an_unknown_ring(spark):
    df = spark.createDataFrame([("unknown", 0.4, "合同专用章", 80.0, 0.1), ("unknown", 0.4, "合同专用章", 40.0, 0.1), ("logo", 0.9, "公章", 80.0, 0.1)], "seal_class string, confidence double, ocr_text string, ocr_confidence double, ring double")
    assert [(r["seal_class"], r["confidence"]) for r in seals.refine(df).collect()] == [("seal", 0.74), ("unknown", 0.4), ("logo", 0.9)]
    reasons = seals.seal_reasons(F.lit("seal"), F.lit("context_unknown"), F.lit("某某公司"), F.lit(50.0), F.lit("另一家"), F.lit(0.1))
    assert value(spark, reasons) == ["seal_candidate_likely_seal", "seal_ocr_entity_mismatch_review"]


def test_matched_pairs_are_told_apart(spark):
    got = generated.flagged(generated.semantic_pairs(spark, 20)).collect()
    assert len(got) == 80 and all(r["flagged"] is (r["label"] == "fake") for r in got)


def test_pages_are_clamped(spark):
    df = spark.createDataFrame([(f"R{k}", "pdf", "v", "G1", k, "fail" if k % 2 else "pass") for k in range(7)], "source_id string, source_format string, report_variant string, rule_id string, position int, status string")
    rows = serving.public_rows(df)
    assert serving.page_of(rows, 9, 3).count() == 1 and serving.page_of(rows, -1, 3).count() == 3
    assert serving.page_of(rows, 1, 3).first()["risk_conclusion"] == "fail"
    assert serving.filtered(rows, conclusion="fail").count() == 3 and serving.filtered(rows, conclusion="other").count() == 7


def report(**evidence):
    from docassay.operators import strict

    kinds = {"source_id": "string", **strict.EVIDENCE}
    base = {"source_id": "s", "pages": 1, "large_images": 0, "metadata_readable": True, "fonts_readable": True} | evidence
    return [base.get(k) for k in kinds], ", ".join(f"{k} {v}" for k, v in kinds.items())


def statuses(spark, **evidence):
    from docassay.operators import strict

    row, schema = report(**evidence)
    got = strict.analyse(spark.createDataFrame([row], schema)).orderBy("position").collect()
    assert [r["rule_id"] for r in got][:22] == list(credit.RULES)
    return {r["rule_id"]: r for r in got}


def test_all_rules_of_an_unreadable_and_an_empty_report(spark):
    got = statuses(spark, native_text=None)
    assert {k: r["status"] for k, r in got.items()} == {**{k: "manual" for k in ("G1", "G2", "G3", "G4", "A0")}, **{k: "not_applicable" for k in credit.RULES if k[0] != "G"}}
    assert got["G1"]["source_format"] == "scanned_or_image" and got["G1"]["observed"] == ""


def test_number_and_later_dates_of_an_original(spark):
    body = "正文" * 200
    text = f"个人信用报告 还款状态\n报告编号：202001021530590001\n报告时间：2020-01-02 15:30:59\n\f开户日期：2020-01-02 15:31:00 到期日期 2031.1.1\n{body}"
    got = statuses(spark, native_text=text)
    assert got["G1"]["status"] == "pass" and "2020-01-02 15:30:59" in got["G1"]["observed"]
    assert got["G2"]["status"] == "fail" and got["A2"]["status"] == "manual" and got["H5"]["status"] == "manual" and got["C1"]["status"] == "not_applicable"
    assert statuses(spark, native_text=text.replace("0001\n", "0001\n").replace("15305900", "15305800"))["G1"]["status"] == "fail"
    assert statuses(spark, native_text=text.replace(" 15:30:59", ""))["G1"]["status"] == "manual"
    assert statuses(spark, native_text=text.replace("2020-01-02 15:30:59", "2020-02-31 15:30:59"))["G2"]["status"] == "manual"
    scan = statuses(spark, native_text=text, large_images=1)
    assert (scan["G1"]["status"], scan["G2"]["status"], scan["P2"]["status"]) == ("pass", "manual", "not_applicable")


def test_native_text_beneath_images_may_contradict_its_number(spark):
    page = "报告编号：202001021530580001\n报告时间：2020-01-02 15:30:59\n" + "".join(f"第{k}行内容各不相同" for k in range(80))
    evidence = {"native_text": f"{page}\f{page}又一页", "pages": 2, "large_images": 2, "font_objects": 12, "fonts": "A yes yes yes\nB yes yes yes\nC yes yes yes", "ocr_text": "识别"}
    assert statuses(spark, **evidence)["G1"]["status"] == "fail"
    for other in ({"font_objects": 11}, {"fonts": "A yes yes yes\nB yes yes yes"}, {"native_text": f"{page}\f{page}"}, {"native_text": f"{page[:40]}\f{page[:90]}又一页"}):
        assert statuses(spark, **evidence | other)["G1"]["status"] == "manual", other


def test_invalid_rule_sets_and_missing_structure_raise(spark):
    import pytest

    from docassay.operators import strict

    row, schema = report(native_text="x")
    good = strict.analyse(spark.createDataFrame([row], schema))
    assert strict.checked(good).count() == 23
    with pytest.raises(Exception, match="G1"):
        strict.checked(good.where("rule_id <> 'G1'")).collect()
    texts = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "source_id string, place int, ocr_text string")
    objects = spark.createDataFrame([("a", 1, 1, 0, 3)], "source_id string, place int, pages int, large_images int, font_objects int")
    reports = spark.createDataFrame([("a",), ("b",)], "source_id string")
    assert strict.with_objects(reports.limit(1), objects, texts).first()["ocr_text"] == "new"
    with pytest.raises(Exception, match="no object features of b"):
        strict.with_objects(reports, objects, texts).collect()


def test_entities_anywhere_in_fields(spark):
    raw = '{"Party_A": " 甲公司 ", "list": [{"payee": "Bee"}, {"PayeeName": "甲公司"}, {"deep": {"issuer": ["One", "1", "' + "x" * 81 + '"]}}], "note": "no"}'
    assert value(spark, seals.entities_of(F.lit(raw))) == ["甲公司", "Bee", "One"]
    for bad in (None, "", "[1", "[]", "3"):
        assert value(spark, seals.entities_of(F.lit(bad).cast("string"))) == []


def test_seal_outcomes_beside_the_geometry(spark):
    columns = "document_id string, doc_type string, y0 double, y1 double, ring double, center double, ink double, area double, saturation double, semantic double, initial_class string, duplicate_count int, dense_square int, recommended int, class_reason string"
    rows = [
        ("none", "invoice", None, None, 0.1, 0.1, 0.1, 0.01, 0.1, 0.1, "seal", 1, 0, 0, None),
        ("flag", "invoice", 0.8, 0.9, 0.1, 0.1, 0.1, 0.01, 0.1, 0.1, "seal", 1, 1, 0, None),
        ("copies", "invoice", 0.8, 0.9, 0.05, 0.1, 0.1, 0.005, 0.1, 0.1, "seal", 4, 0, 0, None),
        ("told", "invoice", 0.8, 0.9, 0.1, 0.01, 0.1, 0.01, 0.1, 0.9, "seal", 1, 0, 0, "bottom_stamp_geometry"),
        ("asked", "invoice", 0.8, 0.9, 0.1, 0.01, 0.1, 0.01, 0.1, 0.1, "unknown", 1, None, 1, ""),
    ]
    got = {r["document_id"]: (r["seal_class"], r["reasons"], r["should_ocr"]) for r in seals.classify(spark.createDataFrame(rows, columns)).collect()}
    assert got["none"] == ("none", "candidate_missing", False)
    assert got["flag"] == ("unknown", "dense_square_pattern|ocr_not_recommended", False)
    assert got["copies"] == ("logo", "repeated_compact_emblem|duplicate_hash:4", False)
    assert got["told"] == ("seal", "bottom_stamp_geometry", True)
    assert got["asked"] == ("unknown", "insufficient_stamp_geometry", True)
