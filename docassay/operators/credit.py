"""Strict rules of credit reports: fail only where two readings are certain, else ask for the original.

Rules are columns over a report's text; unreadable input leads to manual, never to fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.functions.text import compact, half_width, let

# How reports write dates, numbers and the labels before a date.
DATE = r"((?:19|20)\d{2})[-/.年](0?[1-9]|1[0-2])[-/.月](3[01]|[12]\d|0?[1-9])(?:日)?(?:[T\s]*([01]?\d|2[0-3])[:：]([0-5]\d)(?:[:：]([0-5]\d))?)?"
NUMBER = r"(?i)(?:报\s*告\s*编\s*号|报告号码|NO\.?)\s*[:：]?\s*([0-9OIl\s]{14,28})"
#: The same without line breaks between date and time.
DATE_ON_LINE = DATE.replace(r"[T\s]*", r"[T \t]*")
#: What stands for a date while a text is split at its dates: splitting at one character needs no pattern.
MARK = "\x01"
BOUNDARY = r"(?<![A-Za-z㐀-鿿])"
TIME_LABELS = (r"报告\s*时\s*间\s*:?\s*", r"报告\s*日\s*期\s*:?\s*")
FORWARD = r"(?i)(?:到期|截止|有效期|有效截止|营业期限|许可截止|还款计划|终止)(?:日期|日|时间|期)?[:：]?$"
HISTORICAL = r"(?i)(?:开户|开立|发放|结清|关闭|更新|信息报告|还款发生|最近一次还款|立案|成立|登记)(?:日期|日|时间)?[:：]?$"
ENTERPRISE = ("企业信用报告", "企业名称", "中征码", "统一社会信用代码")
PERSONAL = ("个人信用报告", "证件号码", "信用卡", "个人基本信息")
ONLINE = ("自主查询版", "账户明细如下", "发生过逾期的贷记卡", "从未逾期过的贷记卡")
PRINTED = ("个人基本信息", "信贷交易信息明细", "信贷交易违约信息概要", "还款状态")
RULES = ("G1", "G2", "G3", "G4", "P1A", "P1B", "P1C", "P1D", "P2", "O1", "H1", "H2", "H3", "H4", "H5", "H6", "C1", "C2", "C3A", "C3B", "C3C", "C3D")


def pages(text: Column) -> Column:
    return F.filter(F.split(text, "\f+"), lambda p: F.trim(F.translate(p, "\n\r\t", "   ")) != "")


def cover(text: Column) -> Column:
    """The first page that is not blank."""
    return F.coalesce(F.get(pages(text), F.lit(0)), F.left(text, F.lit(20000)))


def timestamp_of(raw: Column) -> Column:
    """A date as written, with its time if there is one; impossible dates are null. One match puts it in the usual order,
    what is left of an absent time goes, and a cast that does not raise reads it."""
    usual = F.regexp_replace(raw, f"^(?:{DATE}).*$", "$1-$2-$3 $4:$5:$6")
    return F.rtrim(usual, F.lit(" :")).try_cast("timestamp")


def report_dates(page: Column) -> Column:
    """(any, exact): the dates as written after the first label of a cover page; a report time counts before a report
    date; exact ones have seconds."""

    def chosen(found: Column, seconds: bool) -> Column:
        kept = F.filter(found, lambda d: d.rlike(r"[:：][0-5]\d[:：][0-5]\d$")) if seconds else found
        return F.get(kept, F.lit(0))

    every = [F.regexp_extract_all(page, F.lit(BOUNDARY + label + "(" + DATE + ")"), F.lit(1)) for label in TIME_LABELS]
    both = let(F.struct(every[0].alias("time"), every[1].alias("day")), lambda x: F.struct(*(F.coalesce(chosen(x["time"], s), chosen(x["day"], s)).alias(n) for n, s in (("any", False), ("exact", True)))))
    return F.when(page.rlike("报告\\s*[时日]\\s*[间期]"), both)


def report_number(page: Column) -> Column:
    """Leading digits of the number on a cover page, with letters that recognition takes for digits put right."""
    raw = F.regexp_extract(page, NUMBER, 1)
    return F.regexp_extract(F.translate(compact(raw), "OIl", "011"), r"^\d+", 0)


def later_dates(text: Column, limit: Column) -> Column:
    """(kind, date) of the dates later than a limit: forward, historical or unknown, each by the label right before it on
    its line.

    Split at the dates, the text before the k-th date is the end of the k-th piece: no position is needed.
    """

    def judged(dates: Column, pieces: Column) -> Column:
        times = F.transform(dates, lambda d, i: F.struct(timestamp_of(d).alias("t"), i.alias("i")))
        kept = F.filter(times, lambda x: x["t"] > limit)

        def kind(x: Column) -> Column:
            label = compact(F.regexp_extract(F.right(F.get(pieces, x["i"]), F.lit(36)), r"([^\n\f\r\x0B]*)$", 1))
            return let(label, lambda s: F.struct(F.when(s.rlike(FORWARD), "forward").when(s.rlike(HISTORICAL), "historical").otherwise("unknown").alias("kind"), x["t"].alias("t")))

        return F.transform(kept, kind)

    found = F.regexp_extract_all(text, F.lit(DATE_ON_LINE), F.lit(0))
    return let(found, lambda dates: F.when(F.size(dates) > 0, let(F.split(F.regexp_replace(text, DATE_ON_LINE, MARK), MARK, -1), lambda pieces: judged(dates, pieces))).otherwise(F.array().cast("array<struct<kind:string,t:timestamp>>")))


def common_rules(reports: DataFrame) -> DataFrame:
    """g1 and g2 of reports with text, embedded (native text) and number_reliable, with what they were read from:
    report_number, report_time, report_time_exact, later (kinds and dates)."""
    c = F.col
    rows = reports.withColumn("norm_", half_width(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("cover_", cover(c("norm_")))
    rows = rows.withColumns({"report_number": report_number(c("cover_")), "dates_": report_dates(c("cover_"))})
    rows = rows.withColumns({"report_time": timestamp_of(c("dates_")["any"]), "report_time_exact": timestamp_of(c("dates_")["exact"])})
    limit = F.coalesce("report_time_exact", F.date_trunc("day", "report_time") + F.expr("INTERVAL '23:59:59' HOUR TO SECOND"))
    rows = rows.withColumn("later", F.when(c("report_time").isNotNull(), later_dates(c("norm_"), limit)))
    known = (F.char_length("report_number") >= 14) & c("report_time_exact").isNotNull()
    equal = F.left("report_number", F.lit(14)) == F.date_format("report_time_exact", "yyyyMMddHHmmss")
    g1 = F.when(~F.coalesce(known, F.lit(False)), "manual").when(equal, "pass").when(c("number_reliable"), "fail").otherwise("manual")
    some = lambda kind: F.exists("later", lambda x: x["kind"] == kind)
    g2 = F.when(c("report_time").isNull(), "manual").when(some("historical") & c("embedded"), "fail").when(some("historical") | some("unknown"), "manual").otherwise("pass")
    return rows.withColumns({"g1": g1, "g2": g2}).drop("norm_", "cover_", "dates_")


def variant(text: Column, embedded: Column) -> Column:
    """Which kind of report a text is."""
    found = let(compact(text), lambda flat: F.struct(*(sum((F.contains(flat, F.lit(w)).cast("int") for w in words), F.lit(0)).alias(name) for name, words in (("enterprise", ENTERPRISE), ("personal", PERSONAL), ("online", ONLINE), ("printed", PRINTED)))))
    lessor = F.contains(F.regexp_extract(compact(cover(text)), r"查询机构:?(.{2,100}?)(?=报告时间|报告日期|第\d+页|$)", 1), F.lit("租赁"))
    enterprise = F.when(~embedded, "scanned_enterprise").when(lessor, "leasing_enterprise").otherwise("online_enterprise")

    def judged(n: Column) -> Column:
        personal = F.when(n["online"] > 0, F.when(embedded, "online_personal").otherwise("scanned_online_personal")).when(n["printed"] > 0, "pboc_print_personal").otherwise("unknown")
        return F.when(n["enterprise"] > n["personal"], enterprise).when(n["personal"] > 0, personal).otherwise("unknown")

    return let(found, judged)


def original_rules(created: Column, modified: Column, producer: Column, version: Column, report: Column, scanned: Column, readable: Column, trusted_producers: tuple[str, ...]) -> dict[str, Column]:
    """P1A to P1C and P2: file properties of original reports."""

    def possible(equal: Column) -> Column:
        return F.when(scanned, "not_applicable").when(~readable, "manual").when(F.coalesce(equal, F.lit(False)), "pass").otherwise("possible")

    early = F.expr("INTERVAL '1' DAY")
    p2 = F.when(scanned, "not_applicable").when(report.isNull() | created.isNull(), "manual").when(report > created, "fail").when(created - report <= early, "pass").otherwise("manual")
    return {"P1A": possible(created == modified), "P1B": possible(producer.isin(*trusted_producers)), "P1C": possible(version == "1.4"), "P2": p2}


def birth_rule(ids: Column, births: Column, printed: Column, native: Column) -> Column:
    """H1: one identity number and one date of birth, both native, must agree."""
    from docassay.functions.text import id_birth

    def judged(v: Column) -> Column:
        certain = native & (F.size(F.array_distinct(v["ids"])) == 1) & (F.size(F.array_distinct(v["births"])) == 1)
        return F.when(~F.coalesce(certain, F.lit(False)), "manual").when(id_birth(F.get(v["ids"], F.lit(0))) == F.get(v["births"], F.lit(0)), "pass").otherwise("fail")

    return F.when(~printed, "not_applicable").otherwise(let(F.struct(ids.alias("ids"), births.alias("births")), judged))


def identity_rule(fields: list[tuple[Column, Column]], native: Column) -> Column:
    """C2: pairs of value sets from two sections. Several values in one section are ambiguous before anything else."""

    def judged(v: Column) -> Column:
        ambiguous, conflict, equal = F.lit(False), F.lit(False), F.lit(True)
        for a, b in ((v[f"a{k}"], v[f"b{k}"]) for k in range(len(fields))):
            ambiguous = ambiguous | (F.size(a) > 1) | (F.size(b) > 1)
            both = (F.size(a) == 1) & (F.size(b) == 1)
            conflict = conflict | (both & (F.get(a, F.lit(0)) != F.get(b, F.lit(0))))
            equal = equal & both & (F.get(a, F.lit(0)) == F.get(b, F.lit(0)))
        return F.when(ambiguous, "manual").when(F.coalesce(conflict, F.lit(False)), F.when(native, "fail").otherwise("manual")).when(F.coalesce(equal, F.lit(False)) & native, "pass").otherwise("manual")

    return let(F.struct(*(x.alias(f"{side}{k}") for k, pair in enumerate(fields) for side, x in zip("ab", pair, strict=True))), judged)


def status_counts(results: DataFrame, key: str = "source_id") -> DataFrame:
    """Counts of each status and the overall one, from long-form rule results; rules that are missing count as manual."""
    from docassay.operators.serving import STATUSES, overall

    own = results.where(F.col("rule_id").isin(*RULES)).groupBy(key).agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))
    total = sum((F.col(s) for s in STATUSES), F.lit(0))
    return own.withColumn("manual", F.col("manual") + F.greatest(F.lit(0), F.lit(len(RULES)) - total)).withColumn("overall_status", overall(F.col("fail"), F.col("possible"), F.col("manual")))


# Headings that end the personal section, and labels that end a value.
AFTER_PERSONAL = ("信息概要", "配偶信息", "共同借款人信息", "其他人员信息")
LABELS = ("企业名称", "中征码", "统一社会信用代码", "组织机构代码", "查询机构", "报告时间")
NOT_NAMES = ("信息概要", "身份标识", "企业信用报告")
ALLOWED_FONTS = {"helvetica": r"(?i)\bType\s+1\s+WinAnsi\s+no\s+no\s+no\b", "sourcehanserifcn-regular": r"(?i)\bCID\s+TrueType\s+Identity-H\s+yes\s+yes\s+yes\b"}


def original_source(native_chars: Column, pages: Column, large_images: Column) -> Column:
    """Native text, pages, and page images on less than four fifths of them."""
    return F.coalesce((native_chars >= 300) & (pages > 0) & (large_images < F.ceil(pages * 0.8)), F.lit(False))


def fonts_rule(listing: Column) -> Column:
    """P1D: exactly the allowed fonts, each with its attributes; subset prefixes do not count."""
    lines = F.filter(F.transform(F.split(listing, "\n"), lambda s: F.trim(s)), lambda s: (s != "") & ~s.rlike("(?i)^name") & ~s.rlike("^[- ]+$"))
    name = lambda s: F.lower(F.regexp_replace(F.split(s, r"\s+")[0], "(?i)^[A-Z]{6}\\+", ""))
    same = F.array_sort(F.array_distinct(F.transform(lines, name))) == F.array(*map(F.lit, sorted(ALLOWED_FONTS)))
    for font, attributes in ALLOWED_FONTS.items():
        same = same & F.exists(lines, _has(name, font, attributes))
    return F.when(listing.isNull() | (F.trim(listing) == ""), "manual").when(same, "pass").otherwise("possible")


def _has(name, font: str, attributes: str):
    return lambda s: (name(s) == font) & s.rlike(attributes)


def personal_section(text: Column) -> Column:
    """Lines from the heading of personal data, on one of the first six pages, to the next heading or a hundred lines on."""

    def ends(s: Column, i: Column) -> Column:
        return let(compact(s), lambda flat: F.exists(F.array(*map(F.lit, AFTER_PERSONAL)), lambda h: F.contains(flat, h))) & (i > 1)

    def cut(scoped: Column) -> Column:
        return let(F.array_position(F.transform(scoped, ends), True), lambda stop: F.when(stop > 0, F.slice(scoped, 1, (stop - 1).cast("int"))).otherwise(scoped))

    def of_lines(lines: Column) -> Column:
        start = F.array_position(F.transform(lines, lambda s: F.contains(compact(s), F.lit("个人基本信息"))), True)
        return let(start, lambda at: F.when(at > 0, let(F.slice(lines, F.greatest(at, F.lit(1)).cast("int"), 100), cut)))

    def of_page(page: Column) -> Column:
        return let(F.split(page, "\n"), of_lines)

    found = F.filter(F.transform(F.slice(pages(half_width(text)), 1, 6), of_page), lambda x: x.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.array().cast("array<string>"))


def after_label(lines: Column, label: str, ahead: int = 3) -> Column:
    """What follows a label on its line, or the first of the next lines that is not blank; one value a labelled line."""

    def values(lines: Column) -> Column:
        def value(s: Column, i: Column) -> Column:
            tail = F.regexp_extract(s, label + r"\s*[:：]?\s*(.*)$", 1)
            following = F.get(F.filter(F.slice(lines, i + 2, ahead), lambda x: F.trim(x) != ""), F.lit(0))
            return F.when(s.rlike(label), F.coalesce(F.nullif(F.trim(tail), F.lit("")), following, F.lit("")))

        return F.filter(F.transform(lines, value), lambda v: v.isNotNull())

    return let(lines, values)  # an outer column in a function is computed again for every line


def personal_values(section: Column) -> tuple[Column, Column]:
    """(identity numbers, dates of birth as yyyy-mm-dd) named in the personal section, each once."""
    ids = F.transform(after_label(section, BOUNDARY + "(?:证件号码|身份证号码)"), lambda v: F.regexp_extract_all(compact(v), F.lit(r"(?<!\d)(\d{17}[\dXx]|\d{15})(?!\d)"), F.lit(1)))
    date = r"((?:19|20)\d{2})[-/.年]?(\d{1,2})[-/.月]?(\d{1,2})"
    part = lambda v, k: F.regexp_extract(v, date, k)
    births = F.transform(after_label(section, BOUNDARY + "出生(?:日期|年月日)"), lambda v: F.when(v.rlike(date), F.concat_ws("-", part(v, 1), F.lpad(part(v, 2), 2, "0"), F.lpad(part(v, 3), 2, "0"))))
    return F.array_distinct(F.flatten(ids)), F.array_distinct(F.array_compact(births))


def identity_sections(text: Column) -> tuple[Column, Column]:
    """Lines of the cover, and of the first page from the second to the eighth with an identity heading, up to thirty that are not blank."""
    every = pages(half_width(text))

    def of_lines(lines: Column) -> Column:
        heads = F.transform(F.slice(lines, 1, 60), lambda s: F.regexp_replace(compact(s), "^[:：|｜]+|[:：|｜]+$", "") == "身份标识")
        rest = lambda at: F.filter(F.slice(lines, F.greatest(at, F.lit(1)).cast("int"), 1_000_000), lambda s: F.trim(s) != "")
        return let(F.array_position(heads, True), lambda at: F.when(at > 0, F.slice(rest(at), 1, 30)))

    def of_page(page: Column) -> Column:
        return let(F.split(page, "\n"), of_lines)

    found = F.filter(F.transform(F.slice(every, 2, 7), of_page), lambda x: x.isNotNull())
    return F.split(cover(half_width(text)), "\n"), F.coalesce(F.get(found, F.lit(0)), F.array().cast("array<string>"))


def identity_values(lines: Column, label: str) -> Column:
    """Valid values right after an exact label: a name, a 16-digit code or an 18-character code, by the label; each once."""
    others = "|".join(LABELS)
    known = rf"^\s*(?:{others})\s*:?[ \t]*"

    def valid(raw: Column) -> Column:
        def judged(x: Column) -> Column:
            ok = {"中征码": x.rlike(r"^\d{16}$"), "统一社会信用代码": x.rlike("^[0-9A-Z]{18}$")}.get(label, F.char_length(x).between(2, 80) & x.rlike("[㐀-鿿]") & ~x.isin(*NOT_NAMES))
            return F.when(ok, x)

        return let(F.upper(F.regexp_replace(compact(F.split(raw, others, 2)[0]), "^[:：|｜]+|[:：|｜]+$", "")), judged)

    def values(lines: Column) -> Column:
        def value(s: Column, i: Column) -> Column:
            own = valid(F.regexp_extract(s, rf"^\s*{label}\s*:?[ \t]*(.*)$", 1))
            following = F.get(F.filter(F.slice(lines, i + 2, 4), lambda x: F.trim(x) != ""), F.lit(0))
            return F.when(s.rlike(rf"^\s*{label}"), F.coalesce(own, let(following, lambda x: F.when(~x.rlike(known), valid(F.trim(x))))))

        return F.array_distinct(F.array_compact(F.transform(lines, value)))

    return let(lines, values)


def enterprise_identity(text: Column, native: Column) -> Column:
    """C2 of an enterprise report: name and both codes on the cover and in the identity section."""
    first, second = identity_sections(text)
    both = F.struct(first.alias("first"), second.alias("second"))
    return let(both, lambda s: identity_rule([(identity_values(s["first"], x), identity_values(s["second"], x)) for x in LABELS[:3]], native))
