"""Answers of vision models as tables: JSON salvaged from prose, boxes checked, scores clamped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = "risk_score double, reason_tags array<string>, explanation string, seal_candidates array<struct<bbox:array<double>,color:string,text:string,pasted_suspicion:double>>"


def salvaged(raw: Column) -> Column:
    """What lies between the first and the last brace."""
    return F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)(\{.*\})", 1)


def boxes(candidates: Column) -> Column:
    """At most ten boxes of four ordered numbers in 0..1, with suspicion in 0..100 and shortened text."""

    def fair(b: Column) -> Column:
        x0, y0, x1, y1 = (F.get(b, F.lit(k)) for k in range(4))
        return (F.size(b) == 4) & (x0 >= 0) & (x0 < x1) & (x1 <= 1) & (y0 >= 0) & (y0 < y1) & (y1 <= 1)

    kept = F.filter(F.slice(F.coalesce(candidates, F.array()), 1, 10), lambda s: F.coalesce(fair(s["bbox"]), F.lit(False)))
    return F.transform(
        kept,
        lambda s: F.struct(
            F.transform(s["bbox"], lambda v: F.bround(v, 6)).alias("bbox"),
            F.left(F.coalesce(s["color"], F.lit("unknown")), F.lit(20)).alias("color"),
            F.left(F.coalesce(s["text"], F.lit("")), F.lit(120)).alias("text"),
            F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(s["pasted_suspicion"], F.lit(0.0)).cast("int"))).alias("pasted_suspicion"),
        ),
    )


def answers(df: DataFrame, raw: str, key: str = "document_id") -> DataFrame:
    """qwen_fx_risk_score, qwen_fx_reason_tags and seal boxes; what cannot be read is an error, not a score."""
    parsed = df.select(key, F.from_json(salvaged(F.col(raw)), ANSWER).alias("a"))
    ok = F.col("a.risk_score").isNotNull() | F.col("a.reason_tags").isNotNull() | F.col("a.seal_candidates").isNotNull()
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.col("a.risk_score"), F.lit(0.0)).cast("int")))
    return parsed.select(key, F.when(ok, score).otherwise(0).alias("qwen_fx_risk_score"), F.array_join(F.coalesce("a.reason_tags", F.array()), "|").alias("qwen_fx_reason_tags"), boxes(F.col("a.seal_candidates")).alias("seal_boxes"), F.when(ok, "").otherwise("unreadable_answer").alias("qwen_fx_error"))
