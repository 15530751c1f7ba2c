"""Folders, manifests, configurations and truth files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import normalised, stem

#: Suffixes of video and image files.
VIDEO_SUFFIXES = ("mp4", "avi", "mov", "mkv", "m4v", "wmv", "flv", "webm")
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")


def of_kind(paths: DataFrame, suffixes: tuple[str, ...] = VIDEO_SUFFIXES) -> DataFrame:
    """(path, name, stem, size) of the paths (path, size) with one of the suffixes, in any letter case."""
    named = paths.select("path", F.substring_index("path", "/", -1).alias("name"), stem(F.col("path")).alias("stem"), "size")
    return named.where(F.lower(F.substring_index("name", ".", -1)).isin(*suffixes) & F.col("name").contains("."))


def list_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = VIDEO_SUFFIXES, recursive: bool = False, lower: bool = False) -> DataFrame:
    """(path, name, stem, size) by path, or by lower-cased name; contents are not read.

    By lower-cased name it must find something, else it raises.
    """
    kept = of_kind(spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path", F.col("length").alias("size")), suffixes)
    if lower and kept.isEmpty():
        raise FileNotFoundError(f"no such files in {folder}")
    return kept.orderBy(F.lower("name") if lower else "path")


def frames_in(frames: DataFrame, start: int = 0, end: int | None = None, step: int = 1) -> DataFrame:
    """Frames from ``start`` to before ``end``, every ``step``-th."""
    kept = frames.where((F.col("frame_id") >= start) & ((F.col("frame_id") - start) % step == 0))
    return kept if end is None else kept.where(F.col("frame_id") < end)


def frames_at(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (video_id, frame_id), each once, those out of range left out."""
    return frames.join(wanted.select("video_id", "frame_id").distinct(), ["video_id", "frame_id"], "left_semi")


def thresholds(text: DataFrame, column: str = "value") -> DataFrame:
    """(class_key, threshold) from a configuration, nested or flat; values that are no numbers are left out."""
    nested = F.from_json(F.get_json_object(column, "$.class_conf_thresholds"), "map<string,string>")
    flat = F.from_json(column, "map<string,string>")
    rows = text.select(F.explode(F.coalesce(nested, flat)).alias("k", "v"))
    return rows.select(normalised(F.col("k")).alias("class_key"), F.col("v").try_cast("double").alias("threshold")).where("threshold is not null")


def truth(text: DataFrame, column: str = "value") -> DataFrame:
    """(video, type1..type5, total) from ``{video: {type1: n, ...}}`` or ``{video: [n, ...]}``."""
    rows = text.select(F.explode(F.from_json(column, "map<string,string>")).alias("video", "v"))
    named, listed = F.from_json("v", "map<string,long>"), F.from_json("v", "array<long>")
    isl = F.col("v").startswith("[")
    counts = [F.coalesce(F.when(isl, F.try_element_at(listed, F.lit(k))).otherwise(F.try_element_at(named, F.lit(f"type{k}"))), F.lit(0)).alias(f"type{k}") for k in range(1, 6)]
    return rows.select("video", *counts).withColumn("total", F.col("type1") + F.col("type2") + F.col("type3") + F.col("type4") + F.col("type5"))


def manifest_lines(chosen: DataFrame, key: str = "video_id") -> DataFrame:
    """One line a video: the name, a tab, the frame ids in order."""
    grouped = chosen.groupBy(key).agg(F.array_sort(F.collect_set("frame_id")).alias("ids"))
    return grouped.select(F.concat(F.col(key).cast("string"), F.lit("\t"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).alias("value"))


def read_manifest(lines: DataFrame) -> DataFrame:
    """(video, frame_id) from manifest lines; comments and ids that are no numbers are left out."""
    parts = lines.where(~F.col("value").startswith("#") & F.col("value").contains("\t")).select(F.split("value", "\t").alias("p"))
    rows = parts.select(F.trim(F.col("p")[0]).alias("video"), F.explode(F.split(F.col("p")[1], ",")).alias("i"))
    return rows.where(F.trim("i").rlike(r"^\d+$")).select("video", F.trim("i").cast("long").alias("frame_id"))


def missing(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that should be there and are not."""
    return expected.select(key).distinct().join(found.select(key), key, "left_anti")


def require(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The rows of ``found`` that are expected; raises where some are missing."""
    lost = [r[0] for r in missing(expected, found, key).limit(5).collect()]
    if lost:
        raise FileNotFoundError(f"missing: {lost}")
    return found.join(expected.select(key).distinct(), key, "left_semi")


def frame_pairs(frames: DataFrame, wanted: DataFrame, column: str, shrink) -> DataFrame:
    """(video_id, frame_id, high, low): the wanted frames, whole and shrunken."""
    return frames_at(frames, wanted).select("video_id", "frame_id", F.col(column).alias("high"), shrink(F.col(column)).alias("low"))


def manifest_entries(chosen: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, value, total_videos, total_frames): a JSON entry a video, and the totals of all."""
    grouped = chosen.groupBy(key).agg(F.array_sort(F.collect_set("frame_id")).alias("frames")).withColumn("n_frames", F.size("frames").cast("long"))
    totals = grouped.agg(F.count(F.lit(1)).alias("total_videos"), F.sum("n_frames").alias("total_frames"))
    return grouped.select(key, F.to_json(F.struct("frames", "n_frames")).alias("value")).join(totals)  # one row


def label_files(paths: DataFrame, root: str) -> DataFrame:
    """(video, stem, path) of the label files under ``root``: a folder is a video, files beside the folders are the video of the root itself.

    Where a video has a folder ``labels`` only the files in it count; ``classes.txt``
    names the classes and is no label file.
    """
    parts = F.split(F.substring(F.col("path"), len(root.rstrip("/")) + 2, 1 << 30), "/")
    named = paths.where(F.col("path").startswith(root.rstrip("/") + "/") & F.lower("path").endswith(".txt") & ~F.col("path").endswith("/classes.txt"))
    placed = named.select("path", F.when(F.size(parts) > 1, parts[0]).otherwise("").alias("video"), (F.get(parts, F.size(parts) - 2) == "labels").alias("inside"))
    placed = placed.withColumn("inside", F.coalesce("inside", F.lit(False)))
    chosen = placed.groupBy("video").agg(F.bool_or("inside").alias("inside"))
    return placed.join(chosen, ["video", "inside"]).select("video", stem(F.col("path")).alias("stem"), "path")


def class_names(text: DataFrame, used: DataFrame, column: str = "value") -> DataFrame:
    """(place, category): the lines of ``classes.txt`` in order, and ``class_<id>`` for ids (place) that are used beyond them."""
    lines = text.select(F.posexplode(F.split(F.rtrim(column), r"\r?\n")).alias("place", "category")).where("trim(category) != ''")
    named = lines.select(F.col("place").cast("long"), F.trim("category").alias("category"))
    more = used.select(F.col("place").cast("long")).distinct().join(named, "place", "left_anti")
    return named.unionByName(more.select("place", F.concat(F.lit("class_"), F.col("place").cast("string")).alias("category")))
