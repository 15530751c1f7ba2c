"""Where models plug in: detectors and classifiers as functions over Arrow batches.

Weights are not part of the library; ``GridDetector`` and ``HashClassifier`` are
deterministic stand-ins with the same interface.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import suppress

DETECTION = "video_id long, frame_id long, x1 double, y1 double, x2 double, y2 double, confidence double, class_name string"


class Detector(Protocol):
    def __call__(self, frames: pd.DataFrame) -> pd.DataFrame: ...


class GridDetector:
    """One box for each cell of a coarse grid whose hash falls under a share; plain arithmetic, so it takes many frames at a time."""

    batch = 4096

    def __init__(self, cells: int = 4, share: float = 0.3):
        self.cells, self.share = cells, share

    def __call__(self, frames: pd.DataFrame) -> pd.DataFrame:
        video, frame, w, h = (frames[c].to_numpy()[:, None] for c in ("video_id", "frame_id", "width", "height"))
        c = np.arange(self.cells * self.cells)
        draw = (video * 31 + frame * 7 + c * 13) % 101 / 101
        at, c = np.nonzero(draw < self.share)
        wide, high, draw = w[at, 0] / self.cells, h[at, 0] / self.cells, draw[at, c]
        x, y = c % self.cells * w[at, 0] / self.cells, c // self.cells * h[at, 0] / self.cells
        name = np.array([f"type{k}" for k in range(1, 6)], object)[c % 5]
        return pd.DataFrame({"video_id": video[at, 0], "frame_id": frame[at, 0], "x1": x, "y1": y, "x2": x + wide, "y2": y + high, "confidence": 1 - draw, "class_name": name})


def detect(frames: DataFrame, make: Callable[[], Detector], batch: int | None = None) -> DataFrame:
    """Detections of all frames; the model is made once a task and sees ``batch`` frames at a time, by default as many as it says of itself, else 16; what it finds leaves the task in larger parts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        each = batch or getattr(model, "batch", 16)
        for part in parts:
            if len(part):
                yield pd.concat([model(part.iloc[at : at + each]) for at in range(0, len(part), each)], ignore_index=True)

    return frames.mapInPandas(run, DETECTION)


class HashClassifier:
    """Probabilities of five classes drawn from a crop's id."""

    def __call__(self, crops: pd.Series) -> np.ndarray:
        raw = np.array([[(int(c) * (k + 3) * 2654435761 % 1000) / 1000 + 0.01 for k in range(5)] for c in crops])
        return raw / raw.sum(axis=1, keepdims=True)


def classify(crops: DataFrame, make: Callable[[], Callable[[pd.Series], np.ndarray]], crop: str = "crop_id", batch: int = 32) -> DataFrame:
    """The crops with ``probs`` and the first most likely class."""

    @F.pandas_udf("array<double>")
    def probabilities(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            found = [p.tolist() for at in range(0, len(part), batch) for p in model(part.iloc[at : at + batch])]
            yield pd.Series(found, index=part.index, dtype=object)

    best = F.array_position("probs", F.array_max("probs")).cast("int") - 1
    return crops.withColumn("probs", probabilities(F.col(crop))).withColumn("pred_class", best)


def slices(frames: DataFrame, side: int = 1280, overlap: float = 0.2) -> DataFrame:
    """Overlapping tiles of frames whose longer edge exceeds ``side``; others are one tile."""
    step = int(side * (1 - overlap))

    def starts(edge: str):
        last = F.greatest(F.col(edge) - side, F.lit(0)).cast("int")
        return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))

    small = F.greatest("width", "height") <= side
    zero = F.array(F.lit(0))
    tiles = frames.withColumn("sx", F.explode(F.when(small, zero).otherwise(starts("width")))).withColumn("sy", F.explode(F.when(small, zero).otherwise(starts("height"))))
    return tiles.withColumn("ex", F.least(F.col("sx") + side, F.col("width"))).withColumn("ey", F.least(F.col("sy") + side, F.col("height")))


def merge_tiles(boxes: DataFrame, limit: float, keys: tuple[str, ...] = ("video_id", "frame_id")) -> DataFrame:
    """(keys, ord, score) and corners of boxes seen in tiles (keys, ord, score, sx, sy, x1, y1, x2, y2), moved to the frame; of overlapping ones the surest stays."""
    moved = boxes.select(*keys, "ord", "score", *((F.col(c) + F.col(f"s{c[0]}")).alias(c) for c in ("x1", "y1", "x2", "y2")))
    return suppress(moved, list(keys), limit, corners=True).select(*(F.col(c).cast(t) for c, t in moved.dtypes))
