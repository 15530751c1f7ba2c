"""Nearest anchors, anchor chains, nearest neighbours, nearest observations."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import by_key, cut


def nearest_anchor(frames: DataFrame, anchors: DataFrame, key: str, root: int) -> DataFrame:
    """(key, frame_id, anchor_id): the valid anchor nearest by frame, then nearest to the root, then first.

    It is the last anchor up to a frame or the first from it on, so two running
    windows of a video find it; videos without a valid anchor give nothing.
    """
    found = anchors.where("valid").select(key, "frame_id", F.col("frame_id").alias("anchor"), F.lit(False).alias("asked"))
    wanted = frames.select(key, "frame_id").distinct().select(key, "frame_id", F.lit(None).cast(dict(found.dtypes)["anchor"]).alias("anchor"), F.lit(True).alias("asked"))
    at = Window.partitionBy(key).orderBy("frame_id")
    before, after = F.max("anchor").over(at.rangeBetween(Window.unboundedPreceding, 0)), F.min("anchor").over(at.rangeBetween(0, Window.unboundedFollowing))
    placed = wanted.unionByName(found).select(key, "frame_id", "asked", before.alias("before"), after.alias("after")).where("asked")
    order = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("frame_id") - F.col(c)).alias("near"), F.abs(F.col(c) - root).alias("out"), F.col(c).alias("anchor_id")))
    best = F.array_min(F.array_compact(F.array(order("before"), order("after"))))
    return placed.select(key, "frame_id", best["anchor_id"].alias("anchor_id")).where("anchor_id is not null")


def anchor_chain(anchors: DataFrame, key: str, root: int) -> DataFrame:
    """(key, anchor_id, parent_id, depth): a tree of the valid anchors, built outward from the root.

    An anchor's parent is the nearest valid one on the root's side, which is the
    next one inward; the depth is the number of valid anchors up to it.
    """
    side = F.when(F.col("frame_id") < root, -1).when(F.col("frame_id") > root, 1).otherwise(0)
    valid = anchors.where("valid").select(key, F.col("frame_id").alias("anchor_id"), side.alias("side"), F.abs(F.col("frame_id") - root).alias("away"))
    outward = Window.partitionBy(key, "side").orderBy("away")
    chained = valid.select(key, "anchor_id", "side", F.lag("anchor_id").over(outward).alias("inner"), F.row_number().over(outward).alias("depth"))
    is_root = F.col("side") == 0
    return chained.select(key, "anchor_id", F.when(~is_root, F.coalesce("inner", F.lit(root))).alias("parent_id"), F.when(is_root, 0).otherwise(F.col("depth")).alias("depth"))


#: Queries and base vectors that one task compares.
QUERY_BLOCK, BASE_BLOCK = 2048, 8192


def neighbours(queries: DataFrame, base: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(q, b, squared, place): the ``k`` nearest base vectors of each query by squared distance, others than itself.

    Queries and base are dealt into blocks of a bounded size, every two blocks meet
    in one task, and only a block's best ``k`` of each query go on, so no pair table
    is made. A matrix product finds candidates, whose distances are then summed from
    differences. Ties go to the smaller id.
    """
    parts = [max(1, -(-df.count() // size)) for df, size in ((queries, QUERY_BLOCK), (base, BASE_BLOCK))]

    def dealt(df: DataFrame, side: int) -> DataFrame:
        own = F.pmod(F.xxhash64(id_col), F.lit(parts[side])).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.lit(parts[1 - side] - 1)))
        cell = (own.alias("qb"), other.alias("bb")) if side == 0 else (own.alias("bb"), other.alias("qb"))
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.lit(side).alias("side"), *cell).select("id", "v", "side", "qb", "bb")

    def nearest(table: pa.Table) -> pa.Table:
        ids, side = table["id"].to_numpy(), table["side"].to_numpy()
        v = np.stack(table["v"].combine_chunks().to_numpy(zero_copy_only=False))
        q, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        rows: list[tuple[np.ndarray, ...]] = []
        if len(q) and len(b):
            b = b[np.argsort(ids[b], kind="stable")]
            length = (v[b] ** 2).sum(axis=1)
            for at in range(0, len(q), 256):
                some = q[at : at + 256]
                rough = length - 2 * v[some] @ v[b].T
                keep = min(len(b), k + 8)
                near = np.argpartition(rough, keep - 1, axis=1)[:, :keep]
                # whatever rounding may have put behind the last one kept counts as well
                bound = np.take_along_axis(rough, near, axis=1).max(axis=1) + 1e-9 * (length.max() + (v[some] ** 2).sum(axis=1))
                for row, one in enumerate(some):
                    found = np.flatnonzero(rough[row] <= bound[row])
                    found = found[ids[b[found]] != ids[one]]
                    squared = np.zeros(len(found))
                    for d in range(v.shape[1]):  # summed in the order of the dimensions
                        squared += (v[one, d] - v[b[found], d]) ** 2
                    best = np.lexsort((ids[b[found]], squared))[:k]
                    rows.append((np.full(len(best), ids[one]), ids[b[found[best]]], squared[best]))
        parts_ = [np.concatenate([r[c] for r in rows]) if rows else np.empty(0, t) for c, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table({"q": parts_[0], "b": parts_[1], "squared": parts_[2]})

    local = dealt(queries, 0).unionByName(dealt(base, 1)).groupBy("qb", "bb").applyInArrow(nearest, "q long, b long, squared double")
    place = F.row_number().over(Window.partitionBy("q").orderBy("squared", "b"))
    return local.withColumn("place", place).where(F.col("place") <= k).select("q", "b", "squared", "place")


#: Binary codes of queries and of the base that one task compares, and queries it compares at a time.
CODE_BLOCK, CODES_AT_ONCE = 16384, 64


def sign_code(vector: Column, length: int) -> Column:
    """The signs of a vector's first ``length`` components as a binary code, an array of longs; whatever is not above 0 is a 0."""
    bits = lambda at: [F.when(F.get(vector, at + k) > 0, F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")) for k in range(min(64, length - at))]
    return F.array(*(functools.reduce(lambda x, y: x.bitwiseOR(y), bits(at)) for at in range(0, length, 64)))


def hamming_neighbours(queries: DataFrame, base: DataFrame, k: int, words: int, id_col: str = "vec_id", code: str = "code") -> DataFrame:
    """(q, b, distance, place): the ``k`` nearest binary codes of each query by Hamming distance, others than itself; ties go to the smaller id.

    Codes are arrays of ``words`` longs. Queries and base are dealt into blocks of a
    bounded size, every two blocks meet in one task, where differing bits are counted
    by numpy, and only a block's best ``k`` of each query go on, so no pair table is
    made. Rows without id or code take no part.
    """
    sound = lambda df: df.where(F.col(code).isNotNull() & (F.size(code) == words) & ~F.exists(code, lambda w: w.isNull())).select(F.col(id_col).cast("long").alias("id"), F.col(code).cast("array<long>").alias("code")).where("id is not null").distinct()
    sides = [cut(sound(queries)), cut(sound(base))]
    parts = [max(1, -(-df.count() // CODE_BLOCK)) for df in sides]

    def dealt(side: int) -> DataFrame:
        own = F.pmod(F.xxhash64("id"), F.lit(parts[side])).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.lit(parts[1 - side] - 1)))
        cell = (own.alias("qb"), other.alias("bb")) if side == 0 else (own.alias("bb"), other.alias("qb"))
        return sides[side].select("id", "code", F.lit(side).alias("side"), *cell).select("id", "code", "side", "qb", "bb")

    def nearest(table: pa.Table) -> pa.Table:
        ids, side = table["id"].to_numpy(), table["side"].to_numpy()
        codes = table["code"].combine_chunks().flatten().to_numpy().reshape(-1, words).view(np.uint64)
        q, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        b = b[np.argsort(ids[b], kind="stable")]
        rows: list[tuple[np.ndarray, ...]] = []
        columns, keep = [np.ascontiguousarray(codes[b, w]) for w in range(words)], min(len(b), k)
        for at in range(0, len(q) if len(b) else 0, CODES_AT_ONCE):
            some = q[at : at + CODES_AT_ONCE]
            distance = np.zeros((len(some), len(b)), np.int64)
            for w, column in enumerate(columns):
                distance += np.bitwise_count(codes[some, w][:, None] ^ column)
            distance[ids[some][:, None] == ids[b]] = words * 64 + 1  # itself
            order = distance * len(b) + np.arange(len(b))  # by distance, then by id
            best = np.sort(np.partition(order, keep - 1, axis=1)[:, :keep], axis=1)
            away, place = best // len(b), best % len(b)
            fine = away <= words * 64
            rows.append((np.broadcast_to(ids[some][:, None], best.shape)[fine], ids[b][place[fine]], away[fine]))
        parts_ = [np.concatenate([r[c] for r in rows]) if rows else np.empty(0, np.int64) for c in range(3)]
        return pa.table({"q": parts_[0], "b": parts_[1], "distance": parts_[2].astype(np.int32)})

    local = by_key(dealt(0).unionByName(dealt(1)), "qb", "bb").groupBy("qb", "bb").applyInArrow(nearest, "q long, b long, distance int")
    place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "b"))
    return local.withColumn("place", place).where(F.col("place") <= k).select("q", "b", "distance", "place")


def ratio_test(found: DataFrame, ratio: float = 0.75, distance: Column | None = None) -> DataFrame:
    """Queries whose nearest neighbour is clearly nearer than the second: d1 < ratio * d2. The distance is the root of ``squared`` unless another is given."""
    away = F.sqrt("squared") if distance is None else distance
    both = found.where("place <= 2").groupBy("q").agg(F.min_by("b", "place").alias("b"), F.min(away).alias("d1"), F.max(away).alias("d2"), F.count(F.lit(1)).alias("n"))
    return both.where((F.col("n") == 2) & (F.col("d1") < ratio * F.col("d2"))).select("q", "b")


def mutual(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Pairs that are each other's nearest."""
    one = forward.where("place = 1").select("q", "b")
    other = backward.where("place = 1").select(F.col("b").alias("q"), F.col("q").alias("b"))
    return one.join(other, ["q", "b"])


def nearest_observation(sightings: DataFrame, keys: list[str], target: int, order: str = "ord") -> DataFrame:
    """The sighting nearest to a frame; the first wins ties."""
    return sightings.groupBy(*keys).agg(F.min_by(order, F.struct(F.abs(F.col("frame_id") - target), F.col(order))).alias("nearest_ord"))
