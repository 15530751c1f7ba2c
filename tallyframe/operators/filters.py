"""Confidence thresholds by class, and what to do about invalid transforms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import circularity, to_normalised
from ..functions.naming import class_index, normalised

#: Thresholds for density clustering and for incremental clustering.
DENSITY_THRESHOLDS = {"type1": 0.46, "type2": 0.80, "type3": 0.52, "type4": 0.45, "type5": 0.67}
INCREMENTAL_THRESHOLDS = {"type1": 0.68, "type2": 0.80, "type3": 0.85, "type4": 0.40, "type5": 0.67}
DEFAULT_CONFIDENCE = 0.10


def above_threshold(det: DataFrame, thresholds: dict[str, float] | None, default: float = DEFAULT_CONFIDENCE, name: str = "class_name") -> DataFrame:
    """Rows at or above their class's threshold.

    Without thresholds ``default`` holds for all; with them a class that they do
    not name is dropped. The smallest threshold goes along as a plain comparison,
    which the scan can use; the dictionary becomes a literal map, not a join.
    """
    if not thresholds:
        return det.where(F.col("confidence") >= default)
    by_class = F.create_map(*(F.lit(v) for pair in thresholds.items() for v in pair))
    return det.where((F.col("confidence") >= min(thresholds.values())) & (F.col("confidence") >= by_class[normalised(F.col(name))]))


def registered(det: DataFrame, reg: DataFrame, policy: str = "skip") -> DataFrame:
    """Detections with their frame's transform ``h``.

    Rows of frames with an invalid transform are dropped (``skip``, and ``tracker``,
    which behaves alike) or keep their place (``identity``). The transforms go with the
    number of frames and are never broadcast, however small they are guessed; where both
    tables lie by video already, as after a window or a distinct, no row is moved.
    """
    keys, reg = ["video_id", "frame_id"], reg.hint("merge")
    if policy in ("skip", "tracker"):
        return det.join(reg.where("valid"), keys)
    if policy != "identity":
        raise ValueError(f"unknown policy {policy}")
    same = F.array(*(F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)))
    return det.join(reg, keys).withColumn("h", F.when(F.col("valid"), F.col("h")).otherwise(same))


def split_by_sharpness(df: DataFrame, least: float, column: str = "sharpness") -> tuple[DataFrame, DataFrame]:
    """Sharp rows and the rest; null counts as not sharp."""
    sharp = F.coalesce(F.col(column) >= least, F.lit(False))
    return df.where(sharp), df.where(~sharp)


def usable(thresholds: dict[str, float], model_classes: list[str]) -> dict[str, float] | None:
    """The thresholds, or none if they name no class of the model: then the default holds for all."""
    known = {re.sub(r"[\W_]", "", c.lower()) for c in model_classes}
    return thresholds if known & {re.sub(r"[\W_]", "", c.lower()) for c in thresholds} else None


def coarse_threshold(thresholds: dict[str, float] | None, default: float = DEFAULT_CONFIDENCE) -> float:
    """What a detector may drop before the classes are looked at."""
    return min([default, *(thresholds or {}).values()])


def crop_rows(rows: DataFrame, least_side: float, least_confidence: float) -> DataFrame:
    """The rows with ``skip``: null, or why a crop is not exported -- ``size`` before ``confidence``."""
    small = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) < least_side
    return rows.withColumn("skip", F.when(small, "size").when(F.col("confidence") < least_confidence, "confidence"))


def crop_records(rows: DataFrame, width: int, height: int, padding: float = 0.1, key: str = "video_id") -> DataFrame:
    """The records of exported crops: place, padded and clipped corners, normalised box, class, path, sharpness, frame size.

    ``rows`` are detections with their boxes, ``ord``, class_name, confidence and
    sharpness; crops of a video and frame are numbered by ``ord``, names that are no
    type have class -1. Confidences have four places, sharpness two.
    """
    box = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    pad = F.least(box[2] - box[0], box[3] - box[1]) * padding
    corner = (F.greatest(box[0] - pad, F.lit(0.0)), F.greatest(box[1] - pad, F.lit(0.0)), F.least(box[2] + pad, F.lit(float(width))), F.least(box[3] + pad, F.lit(float(height))))
    normal = to_normalised(box, float(width), float(height))
    number = F.row_number().over(Window.partitionBy(key, "frame_id").orderBy("ord")) - 1
    kind = class_index(F.col("class_name"))
    told = rows.withColumn("crop_id", number)
    path = F.format_string("%s/%s_frame%06d_crop%04d.jpg", F.when(kind < 0, "unknown").otherwise(F.col("class_name")), F.col(key).cast("string"), F.col("frame_id"), F.col("crop_id"))
    return told.select(
        F.col(key).cast("string").alias("video_name"), "frame_id", "crop_id", *(c.alias(f"bbox_{n}") for c, n in zip(corner, ("x1", "y1", "x2", "y2"))),
        *(F.round(c, 6).alias(f"bbox_{n}_norm") for c, n in zip(normal, ("cx", "cy", "w", "h"))), F.round("confidence", 4).alias("confidence"), kind.alias("class_id"),
        F.when(kind < 0, "unknown").otherwise(F.col("class_name")).alias("class_name"), path.alias("save_path"), F.round("sharpness", 2).alias("sharpness"), F.lit(width).alias("frame_w"), F.lit(height).alias("frame_h"),
    )


def blob(surface: Column, outline: Column, short_side: Column, roundest: float = 0.35) -> Column:
    """Contours kept as detections: between 1 % and 25 % of the frame's short side squared, and round enough."""
    low, high = short_side * 0.01, short_side * 0.25
    return (surface >= low * low) & (surface <= high * high) & (F.coalesce(circularity(surface, outline), F.lit(0.0)) >= roundest)


def checked_arguments(distance: float, least: int, uniform: int = 30) -> None:
    """Raises where a setting makes no sense."""
    if not distance > 0:
        raise ValueError("the distance must be positive")
    if least < 1:
        raise ValueError("a cluster has at least one sighting")
    if not 2 <= uniform <= 300:
        raise ValueError("between 2 and 300 keyframes can be asked for")
