"""Statistics over runs as partial states that merge: whatever way runs are split, the result is that of one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A state: the rows, their mean, the squares of what they lie off it, the least and the largest.
STATE = ["n", "mean", "off", "least", "most"]


def states(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, off, least, most) of a run; null values count for nothing."""
    v = F.col(value).cast("double")
    return rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("off"), F.min(v).alias("least"), F.max(v).alias("most"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One state for each of ``keys`` out of any number of them.

    The mean is taken first and the states' distances to it then, so states that lie
    close together far from nought lose no digits. States of no rows add nothing.
    """
    whole = Window.partitionBy(*keys)
    told = parts.where(F.col("n") > 0).withColumn("middle", F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole))
    away = F.col("mean") - F.col("middle")
    return told.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max("middle").alias("mean"), F.sum(F.col("off") + F.col("n") * away * away).alias("off"), F.min("least").alias("least"), F.max("most").alias("most")
    )


def summary(parts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, mean, least, most, deviation) of states merged by ``keys``; without keys one row, zeros if there is nothing."""
    keys = keys or []
    found = merged(parts, keys)
    if not keys:
        found = found.agg(*(F.first(c).alias(c) for c in STATE))
    filled = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("mean", "least", "most")]
    return found.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), *filled, F.coalesce(F.sqrt(F.col("off") / F.col("n")), F.lit(0.0)).alias("deviation"))


def add_run(parts: DataFrame, path: str, run: str) -> None:
    """The states of a run beside those of earlier ones; a run of that name is replaced, so one that is repeated counts once."""
    parts.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def robust_mean(rows: DataFrame, key: str, value: str, order: str, floor: float = 1.0) -> DataFrame:
    """(key, inliers, displacement): the mean of the smaller half of each key's values that lie below three times their median.

    The half has one value at least, ties go by ``order``; the limit is ``floor`` at least.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(value, order))
    ranked = rows.withColumn("place_", place).withColumn("n_", F.count(F.lit(1)).over(Window.partitionBy(key)))
    best = ranked.where(F.col("place_") <= F.greatest(F.lit(1), F.floor(F.col("n_") / 2)))
    middle = best.groupBy(key).agg(F.median(value).alias("middle_"))
    kept = best.join(middle, key).where(F.col(value) < F.greatest(F.lit(floor), 3 * F.col("middle_")))
    return kept.groupBy(key).agg(F.count(F.lit(1)).alias("inliers"), F.avg(value).alias("displacement"))


def late_points(seconds: Column, limit: float, full: int = 3, each: float = 5.0) -> Column:
    """Points for speed: all up to the limit, one less for every begun ``each`` seconds beyond it, none below 0."""
    late = F.floor((seconds - limit) / each).cast("int") + 1
    return F.when(seconds <= limit, full).otherwise(F.greatest(F.lit(0), full - F.least(F.lit(full), late)))
