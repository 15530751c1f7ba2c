"""Counts against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = [f"type{k}" for k in range(1, 6)]


def matched(truth: DataFrame, predicted: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, type, t, p): every true count with its prediction, 0 where there is none."""
    long = lambda df, v: df.unpivot([key], TYPES, "type", v)
    return long(truth, "t").join(long(predicted, "p"), [key, "type"], "left").withColumn("p", F.coalesce("p", F.lit(0)))


def points(error: Column, perfect: int = 4, partial: int = 2, tolerance: int = 3) -> Column:
    return F.when(error == 0, perfect).when(error <= tolerance, partial).otherwise(0)


def score(truth: DataFrame, predicted: DataFrame, key: str = "video_id") -> DataFrame:
    """Points, mean absolute error and exact matches by type."""
    error = F.abs(F.col("t") - F.col("p"))
    return matched(truth, predicted, key).groupBy("type").agg(F.sum(points(error)).alias("points"), F.avg(error).alias("mae"), F.count_if(error == 0).alias("exact"))


def distances(truth: DataFrame, predicted: DataFrame, key: str = "video_id") -> DataFrame:
    """By video: sum over types, total, largest type error, and whether all agree."""
    error = F.abs(F.col("t") - F.col("p"))
    return matched(truth, predicted, key).groupBy(key).agg(
        F.sum(error).alias("l1_types"), F.abs(F.sum("t") - F.sum("p")).alias("l1_total"), F.max(error).alias("max_error"), F.bool_and(error == 0).alias("exact")
    )
