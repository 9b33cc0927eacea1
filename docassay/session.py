"""Session factory: UTC, ANSI, adaptive execution; partition counts follow the cores unless the caller says otherwise."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int | None = None, **conf: str) -> SparkSession:
    """A session for local work; on a cluster, pass its master and leave partitions to adaptive execution."""
    builder = SparkSession.builder.master(master).appName("docassay")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for key, value in {**settings, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
