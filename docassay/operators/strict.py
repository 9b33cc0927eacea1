"""All strict rules of a credit report: one row for each of the 22 numbered rules, and for each prerequisite that applies.

A rule fails only where two readings that are certain contradict each other; what is unreadable, or needs another source,
asks for a person. Rules of another kind of report are not applicable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.functions.text import compact, half_width
from docassay.operators import credit
from docassay.sources.files import printed_date

# Rules in their order, the kind of report that each is for, its grade and what it expects.
RULES = (
    ("G1", "all", "strict", "编号前14位与报告时间（精确到秒）一致"),
    ("G2", "all", "strict", "历史事实日期不得晚于报告时间"),
    ("G3", "all", "strict", "同一份报告每页水印位置一致且水印完整"),
    ("G4", "all", "strict", "字体、字号和行间距与对应报告版本一致"),
    ("P1A", "original", "possible", "创建时间与修改时间一致"),
    ("P1B", "original", "possible", "PDF制作者为 iText 2.1.7 by 1T3XT"),
    ("P1C", "original", "possible", "PDF版本为 1.4"),
    ("P1D", "original", "possible", "包含规则图示中的 Helvetica 与 SourceHanSerifCN-Regular 字体属性"),
    ("P2", "original", "strict", "报告时间不得晚于PDF创建时间"),
    ("O1", "online", "strict", "信息概要中的逾期账户数与明细所列账户笔数一致"),
    ("H1", "print", "strict", "证件号码中的出生日期与报告所列出生日期一致"),
    ("H2", "print", "possible", "若出现信贷交易违约信息概要表，表内不得全部为空白"),
    ("H3", "print", "strict", "违约概要与明细还款记录一致"),
    ("H4", "print", "strict", "异常还款代码均有对应违约记录"),
    ("H5", "print", "strict", "信息概要中的贷款及信用卡账户数与明细账户数一致"),
    ("H6", "print", "strict", "授信及负债概要金额与未结清、未销户明细一致"),
    ("C1", "enterprise", "strict", "报告所列法人工商信息与报告时点的权威登记信息一致"),
    ("C2", "enterprise", "strict", "封面与身份标识页的企业名称、中征码和统一社会信用代码一致"),
    ("C3A", "enterprise", "strict", "被追偿业务概要与信贷明细余额、附件历史表现一致"),
    ("C3B", "enterprise", "strict", "信息概要中的公共记录条数与公共记录明细条数一致"),
    ("C3C", "enterprise", "strict", "未结清关注及不良类账户数和余额与明细、附件历史表现一致"),
    ("C3D", "enterprise", "strict", "已结清关注及不良类账户数和余额与明细、附件历史表现一致"),
)
# Prerequisites, which count for no conclusion.
SUPPORT = (
    ("A0", "报告版本需结合原件确认"),
    ("A1", "网银查询版个人征信应取得原始电子版"),
    ("A2", "建议取得人民银行直接打印的纸质原件"),
    ("A3", "法人征信尽量取得网银导出的原始电子版"),
)
PRODUCER = "iText 2.1.7 by 1T3XT"
NATIVE_CHARS = 300
# What native text beneath page images must have for its report number to count.
UNICODE_FONT = r"(?i)\byes\s+yes\s+yes\b"
DENSE_NUMBER = r"(?i)(?:报告编号|报告号码|NO\.?)\s*[:：]?\s*[0-9 ]{14,28}"
DENSE_TIME = r"报告\s*(?:时间|日期)\s*[:：]?\s*(?:19|20)\d{2}[-/.年]\d{1,2}[-/.月]\d{1,2}(?:日)?[T\s]*(?:[01]?\d|2[0-3])[:：][0-5]\d[:：][0-5]\d"

#: Columns of a report's evidence, with what stands for an absent one.
EVIDENCE = {
    "native_text": "string", "ocr_text": "string", "pages": "int", "large_images": "int", "font_objects": "int", "fonts": "string", "fonts_readable": "boolean",
    "created": "timestamp", "modified": "timestamp", "producer": "string", "version": "string", "metadata_readable": "boolean", "has_pdf": "boolean",
}


def images_prevail(pages: Column, large_images: Column) -> Column:
    return (pages > 0) & (large_images >= F.ceil(pages * 0.8))


def mixed_reliable(text: Column, pages: Column, large_images: Column, font_objects: Column, fonts: Column) -> Column:
    """Whether native text beneath page images is dense and varied enough for its report number to contradict its time."""
    embedded = F.size(F.filter(F.split(fonts, "\n"), lambda s: s.rlike(UNICODE_FONT)))
    parts = F.slice(F.split(text, "\f"), 1, F.greatest(pages, F.lit(1)))

    def varied(sides: Column) -> Column:
        full = F.filter(F.transform(sides, compact), lambda s: F.char_length(s) >= 100)
        return credit.let(full, lambda x: (F.size(x) > 0) & (F.size(F.array_distinct(x)) > 0.5 * F.size(x)))

    dense = F.exists(parts, lambda p: (F.char_length(compact(p)) >= 500) & half_width(p).rlike(DENSE_NUMBER) & half_width(p).rlike(DENSE_TIME))
    formal = images_prevail(pages, large_images) & (font_objects >= F.greatest(F.lit(12), 3 * pages)) & (embedded >= 3)
    return F.coalesce(F.when(formal, credit.let(parts, varied) & dense), F.lit(False))


def read(reports: DataFrame) -> DataFrame:
    """Reports with embedded, text (native, or recognised where that is what counts), report_variant and source_format;
    evidence columns that are absent count as null, dates may be as a tool prints them."""
    have = {f.name: f.dataType.simpleString() for f in reports.schema}

    def given(c: str, kind: str) -> Column:
        if c not in have:
            return F.lit(None).cast(kind)
        return printed_date(F.col(c)) if kind == "timestamp" and have[c] == "string" else F.col(c).cast(kind)

    rows = reports.select("source_id", *(given(c, kind).alias(c) for c, kind in EVIDENCE.items()))
    native = F.coalesce("native_text", F.lit(""))
    rows = rows.withColumn("native", F.char_length(compact(native)) >= NATIVE_CHARS)
    embedded = F.coalesce(F.col("native") & (F.col("pages") > 0) & ~images_prevail(F.col("pages"), F.coalesce("large_images", F.lit(0))), F.lit(False))
    rows = rows.withColumn("embedded", embedded)
    rows = rows.withColumn("analysis", F.when(F.col("embedded"), native).otherwise(F.coalesce(F.nullif("ocr_text", F.lit("")), native)))
    reliable = F.col("embedded") | mixed_reliable(native, F.col("pages"), F.col("large_images"), F.col("font_objects"), F.coalesce("fonts", F.lit("")))
    rows = rows.withColumn("number_reliable", reliable)
    rows = rows.withColumn("text", F.when(F.col("number_reliable"), native).otherwise(F.col("analysis")))
    return rows.withColumns({"report_variant": credit.variant(F.col("analysis"), F.col("embedded")), "source_format": F.when(F.col("embedded"), "original_electronic").otherwise("scanned_or_image")})


def analyse(reports: DataFrame) -> DataFrame:
    """source_id, source_format, report_variant, position, rule_id, grade, status, expected, observed: 22 rows a report,
    then its prerequisites."""
    c, no = F.col, F.lit(False)
    rows = credit.common_rules(read(reports))
    # Rules on the file's properties read the report's time from the text that is analysed.
    exact = F.when(c("text") == c("analysis"), c("report_time_exact")).otherwise(credit.timestamp_of(credit.report_dates(credit.cover(half_width(c("analysis"))))["exact"]))
    rows = rows.withColumn("stamp", exact)
    readable = F.coalesce("metadata_readable", no)
    original = credit.original_rules(c("created"), c("modified"), F.trim(F.coalesce("producer", F.lit(""))), F.trim(F.coalesce("version", F.lit(""))), c("stamp"), ~c("embedded"), readable, (PRODUCER,))
    original["P2"] = F.when(~c("embedded") | readable, original["P2"]).otherwise("manual")
    original["P1D"] = F.when(~c("embedded"), "not_applicable").when(~F.coalesce("fonts_readable", no), "manual").when(credit.fonts_rule(c("fonts")) == "pass", "pass").otherwise("possible")
    kinds = {"online": c("report_variant").isin("online_personal", "scanned_online_personal"), "print": c("report_variant") == "pboc_print_personal", "enterprise": F.contains("report_variant", F.lit("enterprise"))}
    born = credit.let(credit.personal_section(c("analysis")), lambda s: credit.birth_rule(*credit.personal_values(s), F.lit(True), c("embedded")))
    found = {"G1": c("g1"), "G2": c("g2"), **original, "H1": F.when(kinds["print"], born), "C2": F.when(kinds["enterprise"], credit.enterprise_identity(c("analysis"), c("embedded")))}
    time = lambda t: F.coalesce(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.lit("未提供"))
    seen = {
        "G1": F.when(c("g1").isin("pass", "fail") | (F.char_length("report_number") >= 14) & c("report_time_exact").isNotNull(), F.concat(F.lit("编号前14位为 "), F.left("report_number", F.lit(14)), F.lit("；报告时间为 "), time(c("report_time_exact")))),
        "G2": F.when(F.size(F.filter("later", lambda x: x["kind"] != "forward")) > 0, F.concat(F.lit("晚于报告时间的日期数 "), F.size(F.array_distinct(F.transform(F.filter("later", lambda x: x["kind"] != "forward"), lambda x: x["t"]))).cast("string"))),
        "P1A": F.concat(F.lit("创建时间："), time(c("created")), F.lit("；修改时间："), time(c("modified"))),
        "P1B": F.concat(F.lit("PDF制作者："), F.coalesce(F.nullif(F.trim("producer"), F.lit("")), F.lit("未提供"))),
        "P1C": F.concat(F.lit("PDF版本："), F.coalesce(F.nullif(F.trim("version"), F.lit("")), F.lit("未提供"))),
        "P2": F.concat(F.lit("报告时间："), time(c("stamp")), F.lit("；创建时间："), time(c("created"))),
    }

    def made(place: int, rule: str, grade: str, status: Column, expected: str, observed: Column) -> Column:
        return F.struct(F.lit(place).alias("position"), F.lit(rule).alias("rule_id"), F.lit(grade).alias("grade"), status.alias("status"), F.lit(expected).alias("expected"), F.coalesce(observed, F.lit("")).alias("observed"))

    numbered = []
    for place, (rule, kind, grade, expected) in enumerate(RULES):
        status = found.get(rule, F.lit("manual"))
        status = F.when(~kinds[kind], "not_applicable").otherwise(status) if kind in kinds else status
        observed = seen.get(rule, F.lit(None).cast("string"))
        observed = F.when(c("embedded"), observed) if kind == "original" else observed
        numbered.append(made(place, rule, grade, status, expected, observed))
    needed = {"A0": c("report_variant") == "unknown", "A1": kinds["online"] & ~c("embedded"), "A2": kinds["print"], "A3": kinds["enterprise"] & ~c("embedded")}
    support = [F.when(needed[rule], made(len(RULES) + k, rule, "prerequisite", F.lit("manual"), expected, F.lit(None).cast("string"))) for k, (rule, expected) in enumerate(SUPPORT)]
    results = F.concat(F.array(*numbered), F.array_compact(F.array(*support)))
    return rows.select("source_id", "source_format", "report_variant", F.explode(results).alias("result_")).select("source_id", "source_format", "report_variant", "result_.*")


def invalid_sets(results: DataFrame) -> DataFrame:
    """source_id, missing, duplicates, unexpected of the reports whose rule set is not the 22 numbered rules, each once,
    and prerequisites."""
    wanted, known = F.array(*(F.lit(r[0]) for r in RULES)), F.array(*(F.lit(r[0]) for r in (*RULES, *SUPPORT)))
    by = results.groupBy("source_id", "rule_id").agg(F.count("*").alias("n")).groupBy("source_id").agg(F.collect_list(F.struct("rule_id", "n")).alias("x"))  # as many as rules exist
    ids = F.transform("x", lambda x: x["rule_id"])
    found = by.select("source_id", F.array_sort(F.array_except(wanted, ids)).alias("missing"), F.array_sort(F.transform(F.filter("x", lambda x: x["n"] > 1), lambda x: x["rule_id"])).alias("duplicates"), F.array_sort(F.array_except(ids, known)).alias("unexpected"))
    return found.where((F.size("missing") > 0) | (F.size("duplicates") > 0) | (F.size("unexpected") > 0))


def checked(results: DataFrame) -> DataFrame:
    """The results; a report whose rule set is not valid raises when its rows are read."""
    bad = invalid_sets(results).select(F.col("source_id").alias("bad_"), F.to_json(F.struct("missing", "duplicates", "unexpected")).alias("why_"))
    joined = results.join(bad, results["source_id"] == bad["bad_"], "left")
    return joined.where(F.when(F.col("bad_").isNotNull(), F.raise_error(F.concat(F.lit("invalid rule set of "), "bad_", F.lit(": "), "why_")).cast("boolean")).otherwise(True)).drop("bad_", "why_")


def with_objects(reports: DataFrame, objects: DataFrame, texts: DataFrame) -> DataFrame:
    """Reports (source_id, ...) with the recognised text and the structure of the same document, the last row of each; a
    report without structure raises when it is read."""
    newest = lambda df, *columns: df.groupBy("source_id").agg(F.max_by(F.struct(*columns), "place").alias("own"))
    texts = newest(texts, "ocr_text").select("source_id", "own.*")
    objects = newest(objects, "pages", "large_images", "font_objects").select("source_id", "own.*", F.lit(True).alias("known_"))
    joined = reports.join(texts, "source_id", "left").join(objects, "source_id", "left")
    missing = F.raise_error(F.concat(F.lit("no object features of "), F.col("source_id"))).cast("boolean")
    return joined.where(F.when(F.col("known_").isNull(), missing).otherwise(True)).drop("known_")
