"""Identity of documents across tables: joins that keep, exclude or compare, and checks that fail closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docassay.functions.text import basename

KEY = "document_id"


def duplicates(df: DataFrame, key: str = KEY) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def outside(feature: DataFrame, base: DataFrame, key: str = KEY) -> DataFrame:
    """Keys of a feature table that the base table lacks."""
    return feature.select(key).distinct().join(base.select(key), key, "left_anti")


def missing(feature: DataFrame, base: DataFrame, key: str = KEY) -> DataFrame:
    return outside(base, feature, key)


def mismatched(feature: DataFrame, base: DataFrame, key: str = KEY) -> DataFrame:
    """Documents whose file name, label or type differs where both tables have a value."""
    b = base.select(key, *(F.col(c).alias(f"base_{c}") for c in ("path", "label", "doc_type")))
    differs = lambda x, y: (F.coalesce(x, F.lit("")) != "") & (F.coalesce(y, F.lit("")) != "") & (x != y)
    path = differs(basename("path"), basename("base_path"))
    return feature.join(b, key).select(key, path.alias("path_differs"), differs(F.col("label"), F.col("base_label")).alias("label_differs"), differs(F.col("doc_type"), F.col("base_doc_type")).alias("type_differs")).where("path_differs or label_differs or type_differs")


def audit(features: dict[str, DataFrame], base: DataFrame, complete: tuple[str, ...] = ()) -> DataFrame:
    """One row a table: rows, duplicates, outside, missing, mismatched, and whether it passes."""
    out = None
    for name, df in features.items():
        counts = [df.agg(F.count("*").alias("rows_total")), *(x.agg(F.count("*").alias(n)) for n, x in (("duplicate_ids", duplicates(df)), ("outside_base", outside(df, base)), ("missing_from_feature", missing(df, base)), ("identity_mismatch", mismatched(df, base))))]
        row = counts[0]
        for c in counts[1:]:  # one row each
            row = row.join(F.broadcast(c))
        ok = (F.col("duplicate_ids") == 0) & (F.col("outside_base") == 0) & (F.col("identity_mismatch") == 0)
        if name in complete:
            ok = ok & (F.col("missing_from_feature") == 0)
        row = row.select(F.lit(name).alias("feature"), *row.columns, ok.alias("passed"))
        out = row if out is None else out.unionAll(row)
    return out


def scan_manifest(combined: DataFrame, wanted: DataFrame, doc_type: str = "credit_report", key: str = KEY) -> DataFrame:
    """Rows of a type whose key is wanted."""
    return combined.where(F.col("doc_type") == doc_type).join(wanted.select(key).distinct(), key, "left_semi")


def require_empty(df: DataFrame, message: str) -> None:
    """Raise if a check found rows."""
    if bad := df.take(5):
        raise ValueError(f"{message}: {bad}")
