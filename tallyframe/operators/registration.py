"""Sequences of transforms: anchors, composition along a chain, status counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import compose
from ..functions.session import by_key
from . import groups
from .matching import nearest_anchor
from .sampling import even_places


def anchor_places(total: Column, count: int, root: Column) -> Column:
    """Array of even anchor places; ``root`` replaces the nearest one, the first of two, if it is none of them."""
    places = even_places(total, count)
    nearest = F.array_min(F.transform(places, lambda p: F.struct(F.abs(p - root).alias("d"), p.alias("p"))))["p"]
    return F.when(F.array_contains(places, root), places).otherwise(F.array_sort(F.transform(places, lambda p: F.when(p == nearest, root).otherwise(p))))


def preferred_root(total: Column, middle: Column) -> Column:
    return F.when(middle, F.floor(total / 2)).otherwise(0).cast("long")


def anchors(videos: DataFrame, key: str, total: str, count: int, middle: bool = False) -> DataFrame:
    """(key, place): even anchor places, the root (first or middle) among them."""
    return videos.where(F.col(total) > 0).select(key, F.explode(anchor_places(F.col(total), count, preferred_root(F.col(total), F.lit(middle)))).alias("place"))


def roots(candidates: DataFrame, keys: list[str], preferred: str = "preferred", features: str = "features", least: int = 15) -> DataFrame:
    """(keys, root): of a video's anchors (keys, anchor_id, preferred, features) the one that all others are registered to.

    It is the anchor with enough features that is nearest to the preferred one, itself
    first, then the earlier one; if none has enough, the preferred one all the same. A
    missing number of features counts as none.
    """
    fit = F.when(F.col(features) >= least, F.struct(F.abs(F.col("anchor_id") - F.col(preferred)).alias("away"), F.col("anchor_id").alias("root")))
    return candidates.groupBy(*keys).agg(F.coalesce(F.min(fit)["root"], F.min(preferred)).alias("root"))


def gates(features: Column, matches: Column, inliers: Column, least: int = 15, ratio: float = 0.25) -> Column:
    return (features >= least) & (matches >= least) & (inliers >= ratio)


def entries(h: str) -> list[Column]:
    return [F.col(h)[k] for k in range(9)]


def through_anchors(frames: DataFrame, to_root: DataFrame, key: str, root: int) -> DataFrame:
    """(key, frame_id, h, valid, inlier_ratio): each frame's transform to its nearest valid anchor, composed with the anchor's own.

    ``frames`` has the transforms between frames and anchors (key, frame_id,
    anchor_id, h, valid, inlier_ratio); ``to_root`` those of the anchors (key,
    frame_id, h, valid, inlier_ratio). Anchors keep their own transform; a frame
    without a valid anchor is invalid.
    """
    chosen = nearest_anchor(frames.select(key, "frame_id").distinct(), to_root, key, root)
    own = to_root.select(key, F.col("frame_id").alias("anchor_id"), F.col("h").alias("ha"), F.col("valid").alias("va"), F.col("inlier_ratio").alias("ia"))
    both = frames.join(chosen, [key, "frame_id", "anchor_id"]).join(own, [key, "anchor_id"])
    product = F.array(*compose(entries("ha"), entries("h")))
    same = F.col("frame_id") == F.col("anchor_id")
    found = both.select(
        key, "frame_id", F.when(same, F.col("ha")).otherwise(product).alias("h"), (same | F.col("valid")).alias("valid"), F.when(same, F.col("ia")).otherwise(F.least("inlier_ratio", "ia")).alias("inlier_ratio")
    )
    every = frames.select(key, "frame_id").distinct().join(found, [key, "frame_id"], "left")
    return every.withColumn("valid", F.coalesce("valid", F.lit(False))).withColumn("inlier_ratio", F.coalesce("inlier_ratio", F.lit(0.0)))


def status(reg: DataFrame, key: str, ratio: float = 0.25) -> DataFrame:
    """Valid and failed registrations of a video, low inlier ratios, and the share that is valid."""
    return reg.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("valid"), F.count_if(F.col("inlier_ratio") < ratio).alias("low_inlier"), F.round(F.avg(F.col("valid").cast("int")), 6).alias("rate")
    )


IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


#: Rows that a task takes at a time to register whole videos, unless one has more.
ROWS_EACH = 1 << 17


class Trees:
    """The pairs of many videos at once, as numpy arrays: the trees of their anchors, and their frames through them.

    Rows have the number of their ``group``, ascending, ``frame``, ``anchor``, the group's
    ``root``, nine entries ``h`` and an inlier ``ratio``. A tree is built for all groups
    in steps, one rank of anchors a step; what does not depend on which pairs count is
    found once. Nodes are the anchors and the root, with ``every`` all frames besides;
    where no anchor is a frame of a pair there is no tree.
    """

    def __init__(self, group: np.ndarray, frame: np.ndarray, anchor: np.ndarray, root: np.ndarray, h: np.ndarray, ratio: np.ndarray, every: bool = False):
        self.h, self.ratio = h, ratio
        first = np.flatnonzero(np.diff(group, prepend=-1))
        top, n, at_group = root[first], len(first), np.cumsum(np.diff(group, prepend=-1) != 0) - 1
        values, code = np.unique(np.concatenate([frame, anchor, top]), return_inverse=True)
        code = np.concatenate([at_group, at_group, np.arange(n)]) * len(values) + code
        of_frame, of_anchor, of_top = np.split(code, [len(frame), 2 * len(frame)])
        self.nodes = np.unique(np.concatenate([of_anchor, of_top, of_frame if every else of_top]))
        self.node_frame, self.node_group = values[self.nodes % len(values)], self.nodes // len(values)
        self.first = first
        away = np.abs(self.node_frame - top[self.node_group])
        order = np.lexsort((self.node_frame, away, self.node_group))
        rank = np.empty(len(order), np.int64)
        begins = np.searchsorted(self.node_group, np.arange(n))
        rank[order] = np.arange(len(order)) - begins[self.node_group]
        self.anchor_at = np.searchsorted(self.nodes, of_anchor)
        there = np.minimum(np.searchsorted(self.nodes, of_frame), len(self.nodes) - 1)
        self.frame_at = np.where(self.nodes[there] == of_frame, there, -1)
        named = np.full(len(self.nodes), every)
        named[self.anchor_at] = True
        inner = (self.frame_at >= 0) & named[self.frame_at]
        self.roots = np.searchsorted(self.nodes, of_top)[np.unique(at_group[inner])]
        near = np.abs(frame - anchor)
        edge = np.flatnonzero(inner)
        edge = edge[rank[self.anchor_at[edge]] < rank[self.frame_at[edge]]]
        self.edge = edge[np.lexsort((rank[self.anchor_at[edge]], near[edge], self.frame_at[edge], rank[self.frame_at[edge]]))]
        ranks = rank[self.frame_at[self.edge]]
        self.steps = np.split(self.edge, np.flatnonzero(np.diff(ranks)) + 1) if len(ranks) else []
        self.frames, self.of_frame = np.unique(of_frame, return_inverse=True)
        self.frame_number, self.frame_group = values[self.frames % len(values)], self.frames // len(values)
        self.order = np.lexsort((rank[self.anchor_at], near, self.of_frame))

    def tree(self, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each node whether it hangs on the tree of the pairs that count, its transform to the root and its ratio."""
        done, h, ratio = np.zeros(len(self.nodes), bool), np.zeros((len(self.nodes), 9)), np.zeros(len(self.nodes))
        done[self.roots], h[self.roots], ratio[self.roots] = True, IDENTITY, 1.0
        for step in self.steps:
            some = step[valid[step] & done[self.anchor_at[step]]]
            some = some[np.diff(self.frame_at[some], prepend=-1) != 0]  # the first of each anchor
            own, outer = self.frame_at[some], self.anchor_at[some]
            done[own], h[own], ratio[own] = True, composed(h[outer], self.h[some]), np.fmin(self.ratio[some], ratio[outer])
        return done, h, ratio

    def through(self, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each frame the node it goes by, -1 for none, its transform and its ratio."""
        done, h, ratio = self.tree(valid)
        used = np.full(len(self.frames), -1)
        found, least = np.zeros((len(self.frames), 9)), np.zeros(len(self.frames))
        some = self.order[valid[self.order] & done[self.anchor_at[self.order]]]
        some = some[np.diff(self.of_frame[some], prepend=-1) != 0]
        at, outer = self.of_frame[some], self.anchor_at[some]
        used[at], found[at], least[at] = outer, composed(h[outer], self.h[some]), np.fmin(self.ratio[some], ratio[outer])
        own = np.minimum(np.searchsorted(self.nodes, self.frames), len(self.nodes) - 1)
        itself = (self.nodes[own] == self.frames) & done[own]
        used[itself], found[itself], least[itself] = own[itself], h[own[itself]], ratio[own[itself]]
        return used, found, least


def composed(outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Matrix products of rows of nine entries, summed as :func:`~tallyframe.functions.geometry.compose` does."""
    return np.stack(compose([outer[:, k] for k in range(9)], [inner[:, k] for k in range(9)]), axis=1)


def matrices(column: pa.ChunkedArray, there: np.ndarray) -> np.ndarray:
    """Nine entries a row, zeros where there are none."""
    h = np.zeros((len(column), 9))
    h[there] = column.filter(pa.array(there)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 9)
    return h


def listed(h: np.ndarray, there: np.ndarray) -> pa.Array:
    """Rows of nine entries as lists, null where they are not there."""
    ends = np.concatenate([[0], np.cumsum(there) * 9]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(h[there].ravel()), mask=pa.array(~there))


def _by_trees(pairs: DataFrame, keys: list[str], root: int | str, frames: bool) -> DataFrame:
    """Whole videos, many a task's slice; ``frames`` asks for all frames, else for anchors."""
    kinds = dict(pairs.dtypes)
    fine = F.coalesce(F.col("valid") & F.col("h").isNotNull(), F.lit(False))
    top = (F.lit(root) if isinstance(root, int) else F.col(root)).cast("long")
    told = pairs.select(*keys, F.col("frame_id").cast("long").alias("frame_"), F.col("anchor_id").cast("long").alias("anchor_"), top.alias("root_"), F.when(fine, F.col("h").cast("array<double>")).alias("h"), F.col("inlier_ratio").cast("double").alias("ratio_"), fine.alias("fine_"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in groups.slices(batches, keys, ROWS_EACH, ROWS_EACH):
            valid = table["fine_"].to_numpy()
            trees = Trees(group, *(table[c].to_numpy() for c in ("frame_", "anchor_", "root_")), matrices(table["h"], valid), table["ratio_"].to_numpy(), not frames)
            if frames:
                used, h, ratio = trees.through(valid)
                fits, at, number = used >= 0, trees.frame_group, trees.frame_number
                more = {"anchor_id": pa.array(trees.node_frame[used], mask=~fits)}
            else:
                fits, h, ratio = trees.tree(valid)
                at, number, more = trees.node_group, trees.node_frame, {}
            named = {k: table[k].take(pa.array(trees.first[at])) for k in keys}
            rows = pa.table(named | {"frame_id": number} | more | {"h": listed(h, fits), "valid": fits, "inlier_ratio": np.where(fits, ratio, 0.0)})
            yield from rows.to_batches(max_chunksize=65536)

    placed = by_key(told, *keys).sortWithinPartitions(*keys)
    schema = f"{', '.join(f'{k} {kinds[k]}' for k in keys)}, frame_id long{', anchor_id long' if frames else ''}, h array<double>, valid boolean, inlier_ratio double"
    found = placed.mapInArrow(fold, schema).withColumn("frame_id", F.col("frame_id").cast(kinds["frame_id"]))
    return found.withColumn("anchor_id", F.col("anchor_id").cast(kinds["anchor_id"])) if frames else found


def anchor_transforms(pairs: DataFrame, key: str | list[str], root: int | str) -> DataFrame:
    """(key, frame_id, h, valid, inlier_ratio): the anchors' transforms to the root, composed outward along a tree.

    ``pairs`` has the transforms between anchors (key, frame_id, anchor_id, h, valid,
    inlier_ratio); ``root`` is a frame, or the column that names each video's. Anchors
    are taken in order of their distance to the root; each hangs on the nearest anchor
    before it that is valid and registers with it, and without any it is invalid. Many
    videos are sorted into a task and folded at a time (:class:`Trees`).
    """
    keys = [key] if isinstance(key, str) else key
    return _by_trees(pairs, keys, root, False)


def multi_anchor(pairs: DataFrame, key: str | list[str], root: int | str) -> DataFrame:
    """(key, frame_id, anchor_id, h, valid, inlier_ratio) of every frame through several anchors.

    ``pairs`` has the transforms between frames and anchors, anchors being frames
    too; ``root`` is a frame, or the column that names each video's. A valid anchor
    keeps its own transform; another frame takes the first anchor, by distance, by
    distance to the root, by number, that is valid and registers with it; without any
    it is invalid. One shuffle; many videos are folded at a time (:class:`Trees`).
    """
    keys = [key] if isinstance(key, str) else key
    return _by_trees(pairs, keys, root, True)


def single_anchor(pairs: DataFrame, key: str, root: int, features: str = "features", least: int = 15) -> DataFrame:
    """(key, frame_id, h, valid, inlier_ratio) of a sequence registered with one frame.

    ``pairs`` has the transforms to the root (key, frame_id, h, valid, inlier_ratio)
    and the number of features of each frame; if the root itself has too few, every
    frame of the video is invalid, else the root is the identity.
    """
    fit = pairs.where((F.col("frame_id") == root) & (F.col(features) >= least)).select(key, F.lit(True).alias("fit")).distinct()
    both = pairs.join(fit, key, "left")
    is_root, fine = F.col("frame_id") == root, F.col("fit").isNotNull()
    same = F.array(*map(F.lit, IDENTITY))
    return both.select(
        key, "frame_id", F.when(fine & is_root, same).when(fine & F.col("valid"), F.col("h")).alias("h"), (fine & (is_root | F.col("valid"))).alias("valid"),
        F.when(fine & is_root, 1.0).when(fine, F.col("inlier_ratio")).otherwise(0.0).alias("inlier_ratio"),
    )


def zipped(frames: DataFrame, detections: DataFrame, registrations: DataFrame, key: str = "video_id") -> DataFrame:
    """One row a frame with its detections and its transform, matched by position; a video whose three lists differ in length stops the job.

    All three tables have (key, position); detections hold a list a position.
    """
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    lengths = count(frames, "n1").join(count(detections, "n2"), key, "full").join(count(registrations, "n3"), key, "full")
    same = F.col("n1").eqNullSafe(F.col("n2")) & F.col("n1").eqNullSafe(F.col("n3"))
    checked = lengths.select(key, F.when(same, True).otherwise(F.raise_error(F.lit("frames, detections and registrations differ in length")).cast("boolean")).alias("checked"))
    both = frames.join(detections, [key, "position"]).join(registrations, [key, "position"]).join(checked, key)
    return both.where("checked").drop("checked")


def outcomes(tries: DataFrame, key: str, least: int = 15, ratio: float = 0.25) -> DataFrame:
    """By video: registrations tried, valid, with too few features or matches, with too few inliers, failed with an error, and the share that is valid.

    ``tries`` has (key, features, matches, inlier_ratio, error); the first reason counts.
    """
    few = (F.col("features") < least) | (F.col("matches") < least)
    failed = F.col("error").isNotNull()
    low = F.col("inlier_ratio") < ratio
    fine = ~failed & gates(F.col("features"), F.col("matches"), F.col("inlier_ratio"), least, ratio)
    return tries.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(fine).alias("valid"), F.count_if(~failed & few).alias("few_matches"), F.count_if(~failed & ~few & low).alias("low_inlier"),
        F.count_if(failed).alias("exceptions"), F.round(F.avg(fine.cast("int")), 6).alias("rate"),
    )
