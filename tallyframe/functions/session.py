"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local run without one gets a temporary folder, a cluster must name one."""
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not where:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tallyframe-checkpoint-")
        context.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def by_key(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Dealt by key over all shuffle partitions, however few bytes there are: for groups that cost more than their size tells."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), *keys)


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``name``: the place of each row in the whole order, from 0; ranges are numbered on their own and shifted by the sizes before them."""
    ranged = cut(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    sizes = sorted((r["range_"], r["count"]) for r in ranged.groupBy("range_").count().collect())  # a number a range
    before, pairs = 0, []
    for part, size in sizes:
        pairs += [F.lit(part), F.lit(before).cast("long")]
        before += size
    if not pairs:
        return ranged.withColumn(name, F.lit(0).cast("long")).drop("range_")
    place = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1
    return ranged.withColumn(name, place + F.create_map(*pairs)[F.col("range_")]).drop("range_")
