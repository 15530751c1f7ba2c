"""Observation tables derived from the star-schema test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Frames of a video, and those whose transform is invalid.
FRAMES, INVALID = 30, (7, 19)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sighting a line item: video, frame, ord, class, confidence, box, place in reference coordinates."""
    t = table(spark, sf_dir, "lineitem")
    frame = F.col("l_orderkey") % FRAMES
    order = Window.partitionBy("video_id").orderBy("frame_id", "l_orderkey", "l_linenumber", "part", "l_quantity", "l_extendedprice")
    # named before they are numbered: Spark then knows that the rows lie by video
    named = t.select(F.col("l_suppkey").alias("video_id"), frame.alias("frame_id"), F.col("l_partkey").alias("part"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    obj = F.col("part") % 50
    rx = 100 + (obj % 10) * 120 + (F.col("l_quantity") - 25.5) * 0.25
    ry = 100 + F.floor(obj / 10) * 120 + (F.col("l_linenumber") - 4) * 1.5
    d = named.withColumn("ord", (F.row_number().over(order) - 1).cast("long")).select(
        "video_id",
        "frame_id",
        obj.alias("obj_id"),
        "ord",
        F.when(F.col("l_linenumber") == 7, "type0").otherwise(F.concat(F.lit("type"), (obj % 5 + 1).cast("string"))).alias("class_name"),
        (F.col("l_quantity") / 50.0).alias("confidence"),
        F.col("l_quantity").cast("long").alias("quantity"),
        "part",
        rx.cast("double").alias("rx"),
        ry.cast("double").alias("ry"),
    )
    fx = F.col("rx") - 8 * F.col("frame_id")
    return d.select("*", (fx - 20).alias("x1"), (F.col("ry") - 18).alias("y1"), (fx + 20).alias("x2"), (F.col("ry") + 18).alias("y2"))


DET = """det AS (
  SELECT *, rx - 8 * frame_id - 20 AS x1, ry - 18 AS y1, rx - 8 * frame_id + 20 AS x2, ry + 18 AS y2 FROM (
    SELECT l_suppkey AS video_id, l_orderkey % 30 AS frame_id, l_partkey % 50 AS obj_id,
           row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey % 30, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS ord,
           CASE WHEN l_linenumber = 7 THEN 'type0' ELSE 'type' || (l_partkey % 50 % 5 + 1) END AS class_name,
           l_quantity / 50.0 AS confidence, l_quantity::BIGINT AS quantity, l_partkey AS part,
           (100 + (l_partkey % 50 % 10) * 120 + (l_quantity - 25.5) * 0.25)::DOUBLE AS rx,
           (100 + (l_partkey % 50 // 10) * 120 + (l_linenumber - 4) * 1.5)::DOUBLE AS ry
    FROM lineitem))"""


def registrations(spark: SparkSession, sf_dir: str, perspective: bool = False) -> DataFrame:
    """One transform a video and frame: a shift of eight pixels a frame, two frames invalid."""
    videos = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("video_id")).distinct()
    rows = videos.withColumn("frame_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FRAMES - 1).cast("long"))))
    tilt = F.col("frame_id") * 1e-6 if perspective else F.lit(0.0)
    entries = [F.lit(1.0), F.lit(0.0), (8 * F.col("frame_id")).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(0.0), tilt, F.lit(0.0), F.lit(1.0)]
    valid = ~F.col("frame_id").isin(*INVALID)
    return rows.select("video_id", "frame_id", F.array(*entries).alias("h"), valid.alias("valid"), F.when(valid, 0.9).otherwise(0.1).alias("inlier_ratio"))


REG = """reg AS (
  SELECT video_id, frame_id, frame_id NOT IN (7, 19) AS valid, CASE WHEN frame_id IN (7, 19) THEN 0.1 ELSE 0.9 END AS inlier_ratio
  FROM (SELECT DISTINCT l_suppkey AS video_id FROM lineitem), (SELECT unnest(range(30)) AS frame_id))"""


def frame_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an ordered signal: video = user, frame = place in time, signal = value."""
    e = table(spark, sf_dir, "events")
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("video_id"), at.cast("long").alias("frame_id"), F.col("value").alias("signal"), "event_type")


SIGNAL = """sig AS (
  SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_id, value AS signal, event_type FROM events)"""


def lengths(signal: DataFrame) -> DataFrame:
    return signal.groupBy("video_id").agg(F.count(F.lit(1)).alias("total"))


LEN = "len AS (SELECT video_id, count(*) AS total FROM sig GROUP BY video_id)"
