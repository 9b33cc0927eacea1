"""Logistic regression over feature tables: class-balanced, standardised on the training rows, scored out of fold."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pipeline(features: list[str], ridge: float = 0.01) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True), LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=ridge, maxIter=50)])


def balanced(df: DataFrame, label: str = "label", positive: str = "fake") -> DataFrame:
    """y and w: each class weighs half."""
    y = (F.col(label) == positive).cast("double")
    counts = df.agg(F.avg(y).alias("share"))
    joined = df.withColumn("y", y).join(F.broadcast(counts))  # one row
    return joined.withColumn("w", F.when(F.col("y") == 1, F.coalesce(F.try_divide(F.lit(0.5), F.col("share")), F.lit(1.0))).otherwise(F.coalesce(F.try_divide(F.lit(0.5), 1 - F.col("share")), F.lit(1.0)))).drop("share")


def fit(df: DataFrame, features: list[str]):
    return pipeline(features).fit(balanced(df.select("label", *(F.col(f).cast("double") for f in features))))


def apply(model, df: DataFrame, features: list[str]) -> DataFrame:
    """The rows with the probability of the positive class as score."""
    typed = df.withColumns({f: F.col(f).cast("double") for f in features})
    return model.transform(typed).withColumn("score", vector_to_array("probability")[1]).drop("raw", "x", "rawPrediction", "probability", "prediction")


def out_of_fold(df: DataFrame, features: list[str], folds: int = 5, key: str = "document_id") -> DataFrame:
    """Every row scored by a model that has not seen its fold; folds by a hash of the key."""
    fold = F.pmod(F.crc32(F.col(key).cast("binary")), F.lit(folds))
    return reduce(DataFrame.unionByName, (apply(fit(df.where(fold != k), features), df.where(fold == k), features) for k in range(folds)))


def importance(rows: DataFrame, positive: str, features: list[str]) -> DataFrame:
    """Features by the weight's size, largest first: the difference of the classes' means in deviations of all rows."""
    yes, no = F.col(positive), ~F.col(positive)
    gap = lambda c: F.try_divide(F.avg(F.when(yes, F.col(c))) - F.avg(F.when(no, F.col(c))), F.stddev_pop(c))
    wide = rows.agg(F.array(*(F.struct(F.lit(c).alias("feature"), F.coalesce(gap(c), F.lit(0.0)).alias("weight")) for c in features)).alias("w"))
    long = wide.select(F.explode("w").alias("w")).select("w.*")  # one row a feature
    rank = F.row_number().over(Window.orderBy(F.desc(F.abs("weight")), "feature"))
    return long.select(rank.alias("rank"), "feature", F.bround("weight", 6).alias("weight"))
