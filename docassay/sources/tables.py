"""Delimited, JSON and text tables: declared schemas, NUL-free strings, absent files as empty tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(spark: SparkSession, path: str, columns: list[str], missing_ok: bool = True) -> DataFrame:
    """A quoted CSV with header, all columns text. Embedded newlines are kept; NULs go; cells may be of any length."""
    schema = strings(*columns)
    try:
        df = spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1, mode="PERMISSIVE", enforceSchema=False).csv(path)
    except AnalysisException as e:
        if not missing_ok or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return df.select(*(F.translate(c, "\0", "").alias(c) for c in columns))


def write_csv(df: DataFrame, path: str, compress: bool = False) -> None:
    """All cells quoted; nested columns must have become text before."""
    writer = df.write.mode("overwrite").options(header=True, quoteAll=True, escape='"')
    (writer.option("compression", "gzip") if compress else writer).csv(path)


def read_results(spark: SparkSession, path: str, version: str = "credit-word-rules-v1") -> DataFrame:
    """Rule results of reports in long form, from the JSON documents of one schema version; others are an error."""
    rule = "struct<rule_id:string,title:string,status:string,message:string,mode:string>"
    schema = f"schema_version string, generated_at string, documents array<struct<source_id:string,source_format:string,report_variant:string,has_pdf:boolean,rule_results:array<{rule}>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    if raw.where(~F.col("schema_version").eqNullSafe(version)).take(1):
        raise ValueError(f"{path} is not of {version}")
    docs = raw.select(F.explode("documents").alias("d"))
    return docs.select("d.source_id", "d.source_format", "d.report_variant", "d.has_pdf", F.posexplode("d.rule_results").alias("position", "r")).select("source_id", "source_format", "report_variant", "has_pdf", "position", "r.*")


def qualified(spark: SparkSession, path: str) -> str:
    """A path as its file system names it, with scheme and without a slash at the end."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString().rstrip("/")


def relative(path: Column) -> Column:
    """A path below a root without "." steps and doubled slashes; null where it is absolute or leaves the root."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), "/+", "/"), r"(^|(?<=/))(\./)+", "")
    return F.when((plain != "") & ~plain.rlike(r"(^|/)\.\.(/|$)|^/|^[A-Za-z][A-Za-z0-9+.-]*:"), plain)


def side_texts(spark: SparkSession, root: str, rows: DataFrame, path: str, *fallbacks: str) -> DataFrame:
    """Rows with private text from files (plain or gzip) below root, by their path relative to it; paths that leave it
    count as absent; then the fallbacks."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("file_text"), F.col("_metadata.file_path").alias("file_path"))
    name = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^([a-z]+):/+", "$1:/")
    base = F.concat(F.regexp_replace(F.lit(qualified(spark, root)), "^([a-z]+):/+", "$1:/"), F.lit("/"))
    keyed = files.select("file_text", F.substring(name(F.col("file_path")), F.char_length(base) + 1, F.lit(1 << 20)).alias("file_key"))
    joined = rows.withColumn("file_key", relative(F.col(path))).join(keyed, "file_key", "left")
    return joined.withColumn("text", F.coalesce(F.nullif("file_text", F.lit("")), *(F.nullif(F.col(c), F.lit("")) for c in fallbacks), F.lit(""))).drop("file_key", "file_text")


def write_summary(summary: DataFrame, path: str) -> None:
    """One JSON object of a summary's columns, published whole."""
    publish(summary.select(F.to_json(F.struct(*summary.columns)).alias("value")).coalesce(1).write.mode("overwrite").text, path)  # one row


def publish(write: Callable[[str], None], path: str) -> None:
    """Write beside a path, then put the result in its place: readers see the old data or the new, and a failed write
    leaves the old."""
    spark = SparkSession.active()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, staged, old = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".staged", ".replaced"))
    files = target.getFileSystem(conf)
    files.delete(staged, True)
    try:
        write(staged.toString())
    except BaseException:
        files.delete(staged, True)
        raise
    files.delete(old, True)
    had = files.exists(target)
    if had and not files.rename(target, old):
        raise OSError(f"cannot move {path} aside")
    if not files.rename(staged, target):
        if had:
            files.rename(old, target)
        raise OSError(f"cannot publish {path}")
    files.delete(old, True)


def console(df: DataFrame, rows: int = 20, width: int = 54) -> str:
    """The first rows as a table of plain text, cells cut to a width."""
    cells = [df.columns, *([("" if v is None else str(v)).replace("\n", " ") for v in r] for r in df.limit(rows).collect())]
    cells = [[c if len(c) <= width else c[: width - 1] + "…" for c in line] for line in cells]
    wide = [max(map(len, column)) for column in zip(*cells, strict=True)]
    lines = ["  ".join(c.ljust(w) for c, w in zip(line, wide, strict=True)).rstrip() for line in cells]
    return "\n".join([lines[0], "  ".join("-" * w for w in wide), *lines[1:]])


def write_private_texts(df: DataFrame, path: str, run_id: str, key: str = "document_id", text: str = "text") -> None:
    """Compressed texts by run, each named after a digest of its document."""
    df.select(F.lit(run_id).alias("run_id"), F.substring(F.sha2(F.col(key), 256), 1, 20).alias("ref"), F.col(text).alias("text")).write.mode("overwrite").partitionBy("run_id").option("compression", "gzip").json(path)
