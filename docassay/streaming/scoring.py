"""Evidence scored as it arrives: rules are columns, so the batch rules run on a stream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docassay.operators.rules import Rule, reasons_of, score_of


def scored_stream(spark: SparkSession, path: str, schema: StructType, rules: list[Rule], files_per_trigger: int = 64) -> DataFrame:
    """New Parquet files below a folder, each row with risk_score and risk_reasons."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumns({"risk_score": score_of(rules), "risk_reasons": F.array_join(reasons_of(rules), "|")})


def band_windows(stream: DataFrame, time: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Documents and high scores by window of event time; what is later than the watermark is left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("documents"), F.count_if(F.col("risk_score") >= 25).alias("suspicious"))


def publish(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to Parquet, each input once."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
