"""Text normalisation, extraction by pattern, and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docassay.functions.numbers import col

# Patterns of the document model. Java's \b treats letters of all scripts as word characters.
AMOUNT_GUARDED = r"(?<![A-Za-z])(?:CNY|RMB|¥)?\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)"
AMOUNT_FREE = r"(?:CNY|RMB|¥)?\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)"
DATE_ASCII = r"\b(20[0-9]{2}[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12][0-9]|3[01]))\b"
DATE_ANY = r"((?:19|20)[0-9]{2})[-/.年](0?[1-9]|1[0-2])[-/.月](3[01]|[12][0-9]|0?[1-9])日?"
DATE_OCR = r"(20[0-9]{2}[-/.年](?:0?[1-9]|1[0-2])[-/.月](?:0?[1-9]|[12][0-9]|3[01])日?)"
ID_LOOSE = r"\b[0-9]{6}(?:19|20)?[0-9]{6,8}[0-9Xx]?\b"
ID_WORD = r"\b[0-9]{17}[0-9Xx]\b|\b[0-9]{15}\b"
ID_STRICT = r"(?<!\d)(?:\d{17}[\dXx]|\d{15})(?!\d)"
ACCOUNT_WORD = r"\b[0-9]{12,24}\b"
ACCOUNT_STRICT = r"(?<!\d)[0-9]{12,24}(?!\d)"
ACCOUNT_LONG = r"(?<!\d)\d{16,32}(?!\d)"
TAX_ID = r"\b[0-9A-Z]{15,20}\b"
INVOICE_NUMBER = r"(?i)\b(?:INV|FP|FAPIAO|INVOICE)[-_A-Z0-9]*[0-9]{4,}\b"
INVOICE_NUMBER_LOOSE = r"(?i)\b(?:INV|FP|FAPIAO|INVOICE)?[-_A-Z0-9]{6,24}\b"
UPPER_AMOUNT = r"[零壹贰叁肆伍陆柒捌玖拾佰仟万亿元整角分]+"
SOCIAL_CREDIT = r"(?i)(?<![0-9A-Z])[0-9A-Z]{18}(?![0-9A-Z])"
PHONE_CN = r"(?<!\d)1[3-9]\d{9}(?!\d)"
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
NUMBER_AFTER = r"([+-]?[0-9][0-9,]*(?:\.[0-9]{1,2})?)"
SIGNED_FLOW = r"(?<![0-9])([+-][0-9][0-9,]*(?:\.[0-9]{1,2})?)(?![0-9])"
LABELLED = r"((?:姓名|企业名称|单位名称|地址|住址|通讯地址)\s*[:：]?\s*)[^\s|，,；;]{2,80}"
LABELLED_PUBLIC = r"(?i)((?:姓名|企业名称|单位名称|证件号码|身份证号码|统一社会信用代码|中征码|账号|账户|银行卡号|卡号|手机号|联系电话|电子邮箱|地址|住址))(?:\s*[:：]\s*|\s+)[^\s|，,；;]{2,80}"
# Replacements.
HIDDEN_ID, HIDDEN_CREDIT, HIDDEN_LONG = "[证件号码已隐藏]", "[统一社会信用代码已隐藏]", "[长数字字段已隐藏]"
HIDDEN_ACCOUNT, HIDDEN_PHONE, HIDDEN_EMAIL, HIDDEN_VALUE = "[账号已隐藏]", "[联系电话已隐藏]", "[电子邮箱已隐藏]", "[字段值已隐藏]"
PUBLIC_WORDING = (
    ("Word图示基线", "规则基准"),
    ("Word基线", "规则基准"),
    ("Word要求", "核验规则要求"),
    ("Word规则", "核验规则"),
    ("OCR需人工确认", "需结合原件人工确认"),
    ("OCR需确认", "需结合原件确认"),
    ("OCR", "原件信息"),
    ("未被完整稳定提取", "未能完整确认"),
    ("未被稳定识别", "未能稳定确认"),
    ("无法稳定解析", "无法稳定确认"),
    ("被稳定识别", "已稳定确认"),
    ("提取", "确认"),
)
# Tokens of explicit forgery markers.
MARKER_TOKENS = ("synthetic", "tampered", "void stamp", "training only", "generated for model training", "not a valid official document", "screenshot simulation", "specimen", "作废", "伪造", "篡改")
MARKER_HYPHENS = ("edited-", "edit-", "tampered-")
OCR_MARKERS = (
    ("synthetic", "ocr:training_synthetic_marker"),
    ("training", "ocr:training_synthetic_marker"),
    ("generated for model training", "ocr:training_synthetic_marker"),
    ("edited", "ocr:edited_marker"),
    ("void", "ocr:void_marker"),
    ("fake", "ocr:fake_marker"),
    ("作废", "ocr:void_marker"),
    ("伪造", "ocr:fake_marker"),
    ("篡改", "ocr:edited_marker"),
)


def let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def squeeze(x: Column | str) -> Column:
    """White space of any kind collapsed to one space, ends trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?U)\s+", " "))


def compact(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"(?U)\s+", "")


def half_width(x: Column | str) -> Column:
    """Full-width colon, slash and stop made plain; runs of spaces and tabs become one space."""
    return F.regexp_replace(F.translate(col(x), "：／．", ":/."), "[ \t]+", " ")


def letters_key(x: Column | str) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"[^\p{L}\p{N}]", ""))


def safe_name(x: Column | str, limit: int = 120) -> Column:
    return F.left(F.regexp_replace(col(x), r"[^\p{L}\p{N}_-]", "_"), F.lit(limit))


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def found(x: Column | str, pattern: str, group: int = 0, limit: int | None = None) -> Column:
    out = F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(pattern), F.lit(group))
    return F.slice(out, 1, limit) if limit else out


def number(raw: Column) -> Column:
    return F.replace(raw, F.lit(","), F.lit("")).try_cast("double")


def amounts(x: Column | str, pattern: str = AMOUNT_GUARDED, limit: int | None = 30) -> Column:
    return F.transform(found(x, pattern, 1, limit), number)


def bounded_amounts(x: Column | str) -> Column:
    """All amounts from 0 to below 1e12."""
    return F.filter(amounts(x, AMOUNT_FREE, None), lambda v: v.isNotNull() & (v >= 0) & (v < 1e12))


def iso_dates(x: Column | str) -> Column:
    """Dates of either separator as yyyy-mm-dd, in order."""

    def iso(raw: Column) -> Column:
        part = lambda k: F.regexp_extract(raw, DATE_ANY, k)
        return F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))

    return F.transform(found(x, DATE_ANY), iso)


def labelled_amount(lines: Column, labels: tuple[str, ...]) -> Column:
    """The number that follows a label on its line; lines first, then labels in order."""

    def on_line(line: Column) -> Column:
        return F.coalesce(*(number(F.nullif(F.regexp_extract(line, rf"(?i)\Q{label}\E\s*[:：]?\s*(?:CNY|RMB|¥)?\s*{NUMBER_AFTER}", 1), F.lit(""))) for label in labels))

    return F.get(F.filter(F.transform(lines, on_line), lambda v: v.isNotNull()), F.lit(0))


def nearby(lines: Column, labels: tuple[str, ...]) -> Column:
    """What follows a label on the first line that has one, or that whole line; empty if there is none."""

    def on_line(line: Column) -> Column:
        out = None
        for label in labels:
            tail = squeeze(F.ltrim(F.regexp_replace(F.element_at(F.split(line, rf"(?i)\Q{label}\E", 2), 2), r"^[:：\- ]+", "")))
            value = F.when(F.contains(F.lower(line), F.lit(label.lower())), F.coalesce(F.nullif(tail, F.lit("")), line))
            out = value if out is None else F.coalesce(out, value)
        return out

    return F.coalesce(F.get(F.filter(F.transform(lines, on_line), lambda v: v.isNotNull()), F.lit(0)), F.lit(""))


def redact(x: Column | str) -> Column:
    """Identity numbers, credit codes, long numbers, telephones, mail addresses, labelled values: in this order."""
    out = F.coalesce(col(x), F.lit(""))
    for pattern, hidden in ((ID_STRICT, HIDDEN_ID), (SOCIAL_CREDIT, HIDDEN_CREDIT), (ACCOUNT_STRICT, HIDDEN_LONG), (PHONE_CN, HIDDEN_PHONE), (EMAIL, HIDDEN_EMAIL)):
        out = F.regexp_replace(out, pattern, hidden)
    return F.regexp_replace(out, LABELLED, f"$1{HIDDEN_VALUE}")


def public_text(x: Column | str) -> Column:
    """The wording and redaction of what is shown to clients."""
    out = F.coalesce(col(x), F.lit(""))
    for source, target in PUBLIC_WORDING:
        out = F.regexp_replace(out, rf"(?i)\Q{source}\E", target)
    for pattern, hidden in ((ID_STRICT, HIDDEN_ID), (SOCIAL_CREDIT, HIDDEN_CREDIT), (ACCOUNT_LONG, HIDDEN_ACCOUNT), (PHONE_CN, HIDDEN_PHONE), (EMAIL, HIDDEN_EMAIL)):
        out = F.regexp_replace(out, pattern, hidden)
    return F.regexp_replace(out, LABELLED_PUBLIC, f"$1：{HIDDEN_VALUE}")


def tokens_in(x: Column | str, tokens: tuple[str, ...]) -> Column:
    """The tokens that occur in the lower-cased text, in the order of the list."""
    low = F.lower(F.coalesce(col(x), F.lit("")))
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in tokens)))


def ocr_markers(x: Column | str) -> Column:
    low = F.lower(F.coalesce(col(x), F.lit("")))
    return F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(r)) for t, r in OCR_MARKERS))))


def split_reasons(x: Column | str) -> Column:
    return F.filter(F.split(F.coalesce(col(x), F.lit("")), r"\|"), lambda r: r != "")


def public_id(x: Column | str) -> Column:
    return F.concat(F.lit("CR-"), F.upper(F.substring(F.sha2(col(x), 256), 1, 10)))


def id_birth(x: Column | str) -> Column:
    """The date of birth in an identity number of 18 or 15 characters."""
    i = col(x)
    return F.when(i.rlike(r"^\d{17}[\dXx]$"), F.concat_ws("-", F.substring(i, 7, 4), F.substring(i, 11, 2), F.substring(i, 13, 2))).when(i.rlike(r"^\d{15}$"), F.concat(F.lit("19"), F.concat_ws("-", F.substring(i, 7, 2), F.substring(i, 9, 2), F.substring(i, 11, 2))))


def doc_type_of(path: Column | str, keywords: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """The first document type, in order, of which a keyword is in the path."""
    low, out = F.lower(col(path)), None
    for name, words in keywords:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w.lower()))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")
