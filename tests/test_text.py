"""Extraction, redaction, lines and balances."""

from pyspark.sql import functions as F

from docassay.functions import numbers
from docassay.functions import text as T
from docassay.operators import credit, layout, seals
from docassay.operators.integrated import detect_business


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_lenient_numbers(spark):
    df = spark.createDataFrame([("3.9",), ("-1.7",), ("x",), (None,), ("",), ("nan",)], "v string")
    assert [r[0] for r in df.select(numbers.as_int("v")).collect()] == [3, -1, 0, 0, 0, 0]


def test_amounts_guarded_and_free(spark):
    text = F.lit("Total CNY 1,234.50 and INV99 plus ¥7")
    assert value(spark, T.amounts(text)) == [1234.5, 9.0, 7.0]
    assert value(spark, T.bounded_amounts(text)) == [1234.5, 99.0, 7.0]


def test_dates_of_both_alphabets(spark):
    assert value(spark, T.iso_dates(F.lit("2024年1月5日, 1999/12/31"))) == ["2024-01-05", "1999-12-31"]


def test_redaction_order(spark):
    text = F.lit("id 110101199001011234 acct 1234567890123456789 call 13812345678 a.b@c.de 姓名：张三 x")
    out = value(spark, T.redact(text))
    assert "110101199001011234" not in out and "1234567890123456789" not in out and "138" not in out and "@" not in out
    assert T.HIDDEN_ID in out and T.HIDDEN_LONG in out and f"姓名：{T.HIDDEN_VALUE}" in out


def test_labelled_amount_needs_a_number_after_the_label(spark):
    lines = F.array(F.lit("VALUE ADDED TAX INVOICE"), F.lit("Tax: 6.00"), F.lit("Total 106.00"))
    assert value(spark, T.labelled_amount(lines, ("Tax", "税额"))) == 6.0
    assert value(spark, T.labelled_amount(lines, ("Fee",))) is None
    assert value(spark, T.nearby(lines, ("Total",))) == "106.00"


def test_lines_are_put_together_from_boxes(spark):
    words = spark.createDataFrame([("d", 1, 0, "world", 50.0, 12.2, 90.0, 20.0), ("d", 1, 1, "hello", 5.0, 11.8, 40.0, 20.0), ("d", 1, 2, "next", 5.0, 30.0, 20.0, 36.0)], "document_id string, page int, seq int, text string, x_min double, y_min double, x_max double, y_max double")
    assert sorted(r["text"] for r in layout.lines_of(words).collect()) == ["hello world", "next"]


def test_blank_pages_keep_their_place(spark):
    words = spark.createDataFrame([("d", 1, 0, "a", 1.0, 1.0, "1", "1", "1"), ("d", 3, 1, "b", 1.0, 1.0, "", "", "")], "document_id string, page int, seq int, text string, x double, y double, line_num string, block_num string, par_num string")
    pages = spark.createDataFrame([("d", 3)], "document_id string, page_count int")
    assert layout.page_text(words, pages).first()["text"] == "a\n\f\n\n\f\nb"


def test_balance_breaks(spark):
    lines = spark.createDataFrame([("d", 1, "2026-06-10 +5.00 Balance 105.00"), ("d", 2, "2026-06-11 -5.00 余额 100.00"), ("d", 3, "Balance 300.00")], "document_id string, band int, text string")
    rows = layout.balance_rows(lines)
    assert [(r["flow"], r["balance"]) for r in rows.orderBy("position").collect()] == [(5.0, 105.0), (-5.0, 100.0), (None, 300.0)]
    got = layout.balance_breaks(rows, "document_id", ["position"]).first()
    assert (got["balance_rows"], got["balance_breaks"]) == (3, 0)


def test_credit_findings(spark):
    texts = [
        "报告编号：20260102120000ABC 报告时间：2026-01-03",
        "报告时间：2026-01-03 开户日期 2026-02-01",
        "证件号码 110101199001011234 出生日期：1991-01-01",
    ]
    df = spark.createDataFrame([(t, "credit_report") for t in texts], "text string, doc_type string")
    assert [r["business_findings"] for r in detect_business(df).collect()] == [["credit_report_number_date_mismatch"], ["credit_report_future_date"], ["credit_report_id_birth_date_mismatch"]]


def test_strict_rules_of_reports(spark):
    def report(number, time, rest=""):
        return (f"个人信用报告\n报告编号：{number}\n报告时间：{time}\n\f{rest}", True, True)

    rows = [
        report("2024112617005100001", "2024-11-2617:00:51"),
        report("2024112617005200001", "2024-11-26 17:00:51"),
        report("2024112617005100001", "2024-11-26"),
        report("2O241126l7005100001", "2024-11-26 17:00:51", "到期日期：2030-01-01"),
        report("2024112617005100001", "2024-11-26 17:00:51", "开户日期：2030-01-01"),
        report("2024112617005100001", "2024-11-26 17:00:51", "其他 2030-01-01"),
        ("nothing", True, True),
    ]
    df = spark.createDataFrame(rows, "text string, embedded boolean, number_reliable boolean")
    got = [(r["g1"], r["g2"]) for r in credit.common_rules(df).collect()]
    assert got == [("pass", "pass"), ("fail", "pass"), ("manual", "pass"), ("pass", "pass"), ("pass", "fail"), ("pass", "manual"), ("manual", "manual")]


def test_similarity_by_blocks(spark):
    rows = [("abcd", "xxabcdxx", 1.0), ("abc", "abc", 0.0), ("abcdef", "abcxef", 2 * 5 / 12), ("", "abcd", 0.0)]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    assert all(abs(r[0] - r[1]) < 1e-9 for r in df.select(seals.partial_similarity("a", "b"), "want").collect())


def as_rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())


def test_lines_and_pages_within_a_row_are_those_of_boxes(spark):
    boxes = spark.range(400).selectExpr(
        "concat('d', id % 3) document_id", "cast(1 + 2 * (hash(id) % 2) as int) page", "id * 7 % 400 seq", "case id % 9 when 0 then '' when 1 then ' ' when 2 then 'Token' else concat('w', id) end text",
        "cast(id % 5 as double) x_min", "id % 5 + 3.0d x_max", "cast(id % 50 as double) y_min", "id % 50 + 5.0d y_max", "case id % 4 when 0 then '2' when 1 then '' end line_num", "cast(id % 2 as string) block_num", "'1' par_num",
    )
    rows = boxes.groupBy("document_id").agg(F.collect_list(F.struct(*boxes.columns)).alias("b"))
    lines = rows.select("document_id", F.explode(layout.lines_within(F.col("b"))).alias("l")).select("document_id", "l.*")
    assert as_rows(lines) == as_rows(layout.lines_of(boxes)) != []
    named = boxes.withColumnsRenamed({"x_min": "x", "y_min": "y"})
    rows = named.groupBy("document_id").agg(F.collect_list(F.struct(*named.columns)).alias("b"))
    for count in (0, 2, 4):
        text = rows.select("document_id", layout.page_text_within(F.col("b"), F.lit(count)).alias("text")).where("text is not null")
        assert as_rows(text) == as_rows(layout.page_text(named, rows.select("document_id", F.lit(count).alias("page_count"))))
    marks = rows.select("document_id", layout.markers_within(F.col("b"), ("token", "w1", "none")).alias("m")).select("document_id", "m.*")
    assert as_rows(marks) == as_rows(layout.marker_flags(named, ("token", "w1", "none"))) != []


def test_words_of_documents_are_not_shuffled(spark, tmp_path):
    from docassay.plans import text as plans

    texts = [(1, "b a\n" * 900), (2, None), (3, " \n "), (4, "secret Token"), (4, "other words"), (5, "one")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    words = plans.documents(spark, str(tmp_path)).select("document_id", F.posexplode(F.filter(F.split("text", "[ \n]+"), lambda w: w != "")).alias("pos", "word"))
    words = spark.sql(f"{plans.WORDS} FROM {{w}}", w=words)
    found = {q: getattr(plans, q)(spark, str(tmp_path)) for q in ("line_rebuild", "page_text", "marker_tokens")}
    assert as_rows(found["line_rebuild"]) == as_rows(layout.lines_of(words))
    assert as_rows(found["marker_tokens"]) == as_rows(layout.marker_flags(words, ("token", "secret", "license")))
    assert [r["document_id"] for r in found["page_text"].orderBy("document_id").collect()] == ["doc_000001", "doc_000004", "doc_000005"]
    for df in found.values():
        assert "posexplode" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_reasons_are_counted_without_reading_texts_again(spark, tmp_path):
    from docassay.plans import fusion

    spark.createDataFrame([(1, "a b", 3)], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    plan = fusion.text_reasons_by_group(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan
