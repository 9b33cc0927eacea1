"""Binary files: manifests, archives, PDF bytes and what external tools print about them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.functions.text import basename, doc_type_of

# What is taken from folders and archives, and the words that name a document type.
EXTENSIONS = (".pdf", ".jpg", ".jpeg", ".png")
TYPE_WORDS = (
    ("credit_report", ("征信", "credit")),
    ("invoice", ("发票", "invoice")),
    ("contract", ("合同", "contract")),
    ("settlement_statement", ("结算", "settlement")),
    ("receipt", ("回单", "receipt")),
    ("bank_page", ("流水", "银行", "bank")),
)
# Byte patterns counted in a PDF.
PDF_PATTERNS = {
    "xref_count": "xref",
    "startxref_count": "startxref",
    "eof_count": "%%EOF",
    "object_count": r"\d+\s+\d+\s+obj",
    "stream_count": "stream",
    "font_object_count": "/Font",
    "image_object_count": r"/Subtype\s*/Image",
    "javascript_count": r"/JavaScript|/JS\b",
    "embedded_file_count": r"/EmbeddedFile|/Filespec\b",
    "acroform_count": r"/AcroForm|/XFA\b",
    "annotation_count": r"/Annot\b",
}


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder with their bytes; macOS by-products are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = basename("path")
    return files.where(~name.startswith("._") & (name != ".DS_Store") & F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).isin(*EXTENSIONS))


def manifest(spark: SparkSession, root: str, label: str) -> DataFrame:
    """label, doc_type (the folder's name, or by words of the path), ext, size and digest of every file."""
    parent = F.element_at(F.split("path", "/"), -2)
    kind = F.when(parent == label, doc_type_of("path", TYPE_WORDS)).otherwise(parent)
    rows = scan(spark, root).select(F.lit(label).alias("label"), kind.alias("doc_type"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("ext"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "path")
    return rows


def repaired_name(info: zipfile.ZipInfo) -> str:
    """A member's name; names without the UTF-8 flag may be UTF-8 or GBK that was read as code page 437."""
    if info.flag_bits & 0x800:
        return info.filename
    raw = info.filename.encode("cp437", "replace")
    for charset in ("utf-8", "gbk"):
        try:
            return raw.decode(charset)
        except UnicodeDecodeError:
            continue
    return info.filename


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """Archive, member, bytes and digest of the documents in ZIP files; one archive is one task's unit."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        name = repaired_name(info)
                        leaf = name.rsplit("/", 1)[-1]
                        if not info.is_dir() and not leaf.startswith("._") and leaf != ".DS_Store" and name.lower().endswith(EXTENSIONS):
                            yield pd.DataFrame({"archive": [archive], "member": [name], "content": [z.read(info)]})

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, member string, content binary")
    return found.select("archive", "member", doc_type_of("member", TYPE_WORDS).alias("doc_type"), F.length("content").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content")


def pdf_bytes(content: Column | str) -> dict[str, Column]:
    """Counts of structure words in a PDF's bytes, read as Latin-1 so that every byte is a character."""
    text = F.decode(F.col(content) if isinstance(content, str) else content, "ISO-8859-1")
    counts = {name: F.regexp_count(text, F.lit(pattern)) for name, pattern in PDF_PATTERNS.items()}
    head = F.substring(text, 1, 300_000)
    return counts | {
        "incremental_update_count": F.greatest(counts["eof_count"], counts["startxref_count"]),
        "creator_missing": (~F.contains(head, F.lit("/Creator"))).cast("int"),
        "producer_missing": (~F.contains(head, F.lit("/Producer"))).cast("int"),
        "pdf_version": F.regexp_extract(head, r"^%PDF-(\d\.\d)", 1),
    }


def key_values(printed: Column) -> Column:
    """Lines of "key: value" as a map; of equal keys the last one counts."""
    pairs = F.transform(F.filter(F.split(printed, "\n"), lambda s: F.contains(s, F.lit(":"))), lambda s: F.struct(F.trim(F.split(s, ":", 2)[0]).alias("k"), F.trim(F.split(s, ":", 2)[1]).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


# Months, and how tools print a moment: as in mail, and as a clock does.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MAIL_DATE = r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?"
CLOCK_DATE = r"^[A-Za-z]{3}\s+([A-Za-z]{3})\s+(\d{1,2})\s+(\d{1,2}):(\d{2}):(\d{2})(?:\s+[A-Za-z]{1,5})?\s+(\d{4})"
PLAIN_DATES = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd")


def printed_date(raw: Column) -> Column:
    """The wall-clock moment that a tool printed, whatever its zone; null for what is no date."""
    text = F.trim(F.coalesce(raw, F.lit("")))

    def made(pattern: str, year: int, month: int, day: int, hour: int) -> Column:
        part = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).try_cast("int"), F.lit(0))
        number = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(text, pattern, month))).cast("int")
        moment = F.try_make_timestamp_ntz(part(year), number, part(day), part(hour), part(hour + 1), part(hour + 2).cast("decimal(8,6)")).cast("timestamp")
        return F.when(text.rlike(pattern), moment)

    return F.coalesce(made(MAIL_DATE, 3, 2, 1, 4), made(CLOCK_DATE, 6, 1, 2, 3), *(F.try_to_timestamp(text, F.lit(f)) for f in PLAIN_DATES))


def image_rows(df: DataFrame, printed: str, key: str = "document_id") -> DataFrame:
    """One row an image object from a printed list whose first two lines are headings."""
    lines = F.slice(F.split(printed, "\n"), 3, 1_000_000)
    cells = df.select(key, F.explode(lines).alias("line")).select(key, F.split(F.trim("line"), r"\s+").alias("c")).where(F.size("c") >= 5)
    n = lambda k: F.get("c", F.lit(k)).try_cast("int")
    return cells.select(key, n(0).alias("page"), F.get("c", F.lit(2)).alias("kind"), n(3).alias("width"), n(4).alias("height"))


# Pixels from which an image is large, and below which it is an overlay.
LARGE_IMAGE, SMALL_OVERLAY = 1_000_000, 300_000


def image_counts(images: DataFrame, key: str = "document_id", large: int = LARGE_IMAGE, small: int = SMALL_OVERLAY) -> DataFrame:
    """Images, masks, large images and small overlays of each document."""
    area = F.col("width").cast("bigint") * F.col("height")
    image = F.col("kind") == "image"
    return images.groupBy(key).agg(F.count_if(image).alias("image_count"), F.count_if(F.col("kind") == "smask").alias("smask_count"), F.count_if(image & (area >= large)).alias("large_image_count"), F.count_if(image & (area < small)).alias("small_overlay_count"))


def word_boxes(df: DataFrame, xml: str, key: str = "document_id") -> DataFrame:
    """Word boxes of a bounding-box listing: pages in order, words in order within a page."""
    pages = df.select(key, F.posexplode(F.split(xml, "<page[ >]")).alias("page", "body")).where("page > 0")
    word = r'<word xMin="([^"]*)" yMin="([^"]*)" xMax="([^"]*)" yMax="([^"]*)">([^<]*)</word>'
    rows = pages.select(key, "page", F.posexplode(F.regexp_extract_all("body", F.lit(word), F.lit(0))).alias("seq", "w"))
    n = lambda k: F.regexp_extract("w", word, k).try_cast("double")
    text = F.regexp_extract("w", word, 5)
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return rows.select(key, "page", "seq", text.alias("text"), n(1).alias("x_min"), n(2).alias("y_min"), n(3).alias("x_max"), n(4).alias("y_max"))


def recognised_words(df: DataFrame, tsv: str, key: str = "document_id") -> DataFrame:
    """Words of a recogniser's table: level, page, block, paragraph, line, word, box, confidence, text; unsure boxes (-1) go."""
    lines = df.select(key, F.posexplode(F.split(tsv, "\n")).alias("seq", "line")).where("seq > 0")
    c = lambda k: F.get("c", F.lit(k))
    rows = lines.select(key, "seq", F.split("line", "\t").alias("c")).where(F.size("c") >= 12)
    out = rows.select(key, "seq", c(1).try_cast("int").alias("page"), c(2).alias("block_num"), c(3).alias("par_num"), c(4).alias("line_num"), *(c(6 + k).try_cast("double").alias(n) for k, n in enumerate(("x", "y", "w", "h"))), c(10).try_cast("double").alias("conf"), F.trim(c(11)).alias("text"))
    return out.where("conf >= 0 and text <> ''")


def page_count(printed: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(printed, r"(?m)^Pages:\s*(\d+)\s*$", 1), F.lit("")).try_cast("int"), F.lit(0))
