"""What a reader asks of scored reports: public rows, filters, order, pages, dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docassay.functions.text import public_id
from docassay.operators.metrics import hash_order

STATUSES = ("pass", "fail", "possible", "manual", "not_applicable")
CONCLUSIONS = ("fail", "possible", "no_automatic_anomaly", "undetermined")
ORDER = {"fail": 0, "possible": 1, "undetermined": 2, "no_automatic_anomaly": 3}


def conclusion(fail: Column, possible: Column, passed: Column) -> Column:
    return F.when(fail > 0, "fail").when(possible > 0, "possible").when(passed > 0, "no_automatic_anomaly").otherwise("undetermined")


def overall(fail: Column, possible: Column, manual: Column) -> Column:
    return F.when(fail > 0, "fail").when(possible > 0, "possible").when(manual > 0, "manual").otherwise("pass")


def public_rows(results: DataFrame) -> DataFrame:
    """One row a report from its rule results (source_id, source_format, report_variant, rule_id, title, status, position)."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    rank = F.when(F.col("status") == "fail", 0).when(F.col("status") == "possible", 1).when(F.col("status") == "manual", 2)
    first = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "position", "rule_id")))["rule_id"]
    by = results.groupBy("source_id", "source_format", "report_variant").agg(*counts, first.alias("primary_finding"))
    return by.select(public_id("source_id").alias("document_id"), "report_variant", "source_format", conclusion(F.col("fail"), F.col("possible"), F.col("pass")).alias("risk_conclusion"), (F.col("manual") > 0).alias("manual_review_required"), *STATUSES, "primary_finding")


def ordered(rows: DataFrame) -> list[Column]:
    """Most serious first."""
    rank = F.coalesce(*(F.when(F.col("risk_conclusion") == k, F.lit(v)) for k, v in ORDER.items()), F.lit(9))
    return [rank, F.desc("fail"), F.desc("possible"), F.asc("document_id")]


def filtered(rows: DataFrame, search: str = "", conclusion: str = "", source_format: str = "", report_variant: str = "", review: str = "") -> DataFrame:
    """Unknown conclusions and reviews are ignored."""
    if search.strip():
        text = F.lower(F.concat_ws(" ", "document_id", "report_variant", "source_format", F.coalesce("primary_finding", F.lit(""))))
        rows = rows.where(F.contains(text, F.lit(search.strip().lower())))
    if conclusion in CONCLUSIONS:
        rows = rows.where(F.col("risk_conclusion") == conclusion)
    if source_format:
        rows = rows.where(F.col("source_format") == source_format)
    if report_variant:
        rows = rows.where(F.col("report_variant") == report_variant)
    if review in ("required", "not_required"):
        rows = rows.where(F.col("manual_review_required") == (review == "required"))
    return rows


def page_of(rows: DataFrame, page: int, size: int) -> DataFrame:
    """One page, clamped to those that exist; sorted limits keep no more than the pages up to it in a task."""
    size = max(1, min(size, 100))
    total = rows.count()
    page = min(max(1, page), max(1, -(-total // size)))
    return rows.orderBy(*ordered(rows)).offset((page - 1) * size).limit(size)


def dashboard(rows: DataFrame, results: DataFrame, top: int = 8) -> DataFrame:
    """(section, name, n): conclusions and statuses with their zeros, formats, variants, and the commonest findings."""
    spark = rows.sparkSession

    def zero_filled(section: str, names, counted: DataFrame) -> DataFrame:
        known = spark.createDataFrame([(n,) for n in names], "name string")
        return known.join(counted, "name", "left").select(F.lit(section).alias("section"), "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))

    by = lambda c: rows.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n"))
    statuses = rows.select(F.explode(F.array(*(F.struct(F.lit(s).alias("name"), F.col(s).alias("k")) for s in STATUSES))).alias("x")).groupBy("x.name").agg(F.sum("x.k").alias("n"))
    found = results.where(F.col("status").isin("fail", "possible")).groupBy(F.concat_ws(":", "rule_id", "status").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)
    parts = [zero_filled("conclusion", CONCLUSIONS, by("risk_conclusion")), zero_filled("status", STATUSES, statuses)]
    parts += [by(c).select(F.lit(s).alias("section"), "name", F.col("n").cast("bigint").alias("n")) for s, c in (("source_format", "source_format"), ("report_variant", "report_variant"))]
    parts.append(found.select(F.lit("finding").alias("section"), "name", F.col("n").cast("bigint").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def sampled(df: DataFrame, key: str, group: str, n: int) -> DataFrame:
    """The first n rows of each group in hash order."""
    w = Window.partitionBy(group).orderBy(hash_order(key), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def name_of(source_id: str) -> Column:
    """The public name of a source id, as a literal."""
    return public_id(F.lit(source_id))


def one_report(results: DataFrame, document_id: Column | str) -> DataFrame:
    """The rows of one report by its public name: a name is a digest of the source id, so no table of names is kept."""
    wanted = F.lit(document_id) if isinstance(document_id, str) else document_id
    return results.withColumn("document_id", public_id("source_id")).where(F.col("document_id") == wanted)


def attention(rows: DataFrame, top: int = 12) -> DataFrame:
    """The public rows of the most serious reports."""
    return rows.where(F.col("risk_conclusion").isin("fail", "possible")).orderBy(*ordered(rows)).limit(top)


def limited(rows: DataFrame, asked: str | int | None = None, least: int = 1, most: int = 2000, usual: int = 500) -> DataFrame:
    """As many rows as asked for, within bounds; what is no number counts as not asked."""
    try:
        n = max(least, min(int(asked or usual), most))
    except ValueError:
        n = usual
    return rows.limit(n)


def merged(base: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Rows with what other tables know of them: a later table's value takes the place of an earlier one where it is there."""
    out, known = base, set(base.columns)
    for i, other in enumerate(others):
        fresh = [c for c in other.columns if c != key]
        named = other.select(key, *(F.col(c).alias(f"{c}__{i}") for c in fresh))
        out = out.join(named, key, "left")
        for c in fresh:
            out = out.withColumn(c, F.coalesce(f"{c}__{i}", c) if c in known else F.col(f"{c}__{i}")).drop(f"{c}__{i}")
            known.add(c)
    return out
