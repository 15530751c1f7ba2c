"""Keyed-state twins of the ordered operators: a keyframe gate and an online clusterer."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.session import cut
from ..operators import clustering, groups
from ..operators.sampling import gate_step

#: Videos share this many states: a call of Python and its frames cost as much as hundreds of points.
BUCKETS = 1024


def _by_bucket(stream: DataFrame, update: Callable, found: str, kinds: str) -> DataFrame:
    """``update`` over the videos of a bucket at a time; its state has the columns ``kinds``."""
    dealt = stream.withColumn("bucket", F.pmod(F.hash("video_id"), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").applyInPandasWithState(update, found, kinds, "append", GroupStateTimeout.NoTimeout)


def gate_stream(stream: DataFrame, limit: float, least_gap: int = 5, forced_gap: int = 15, most: int = 60) -> DataFrame:
    """Keyframes of a stream (video_id, frame_id, signal), frames of a video in order over the batches.

    State of a bucket: for each of its videos the last chosen frame, summed signal, number chosen. A closing
    frame is not known to a stream, so none is added.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {v: now for v, *now in zip(*state.get)} if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(["video_id", "frame_id"])
        taken = []
        for v, f, s in zip(rows["video_id"].tolist(), rows["frame_id"].tolist(), rows["signal"].tolist()):
            last, total, chosen = held.setdefault(v, [-1, 0.0, 0])
            if chosen >= most:
                continue
            now, take = gate_step((None if last < 0 else last, total, chosen), f, s, least_gap, forced_gap, limit, True)
            held[v] = [-1 if now[0] is None else now[0], float(now[1]), int(now[2])]
            if take:
                taken.append((v, f))
        state.update(tuple(map(list, zip(*([v, *now] for v, now in held.items())))))
        yield pd.DataFrame(taken, columns=["video_id", "frame_id"], dtype="int64")

    return _by_bucket(stream, update, "video_id long, frame_id long", "videos array<long>, last array<long>, total array<double>, chosen array<long>")


def ordered_gate_stream(stream: DataFrame, limit: float, least_gap: int = 5, forced_gap: int = 15, most: int = 60) -> DataFrame:
    """Keyframes of a stream (video_id, frame_id, signal, ends) whose frames may come in any order over the batches.

    Frames of a video are numbered from 0; ``ends`` marks its last one. A frame that
    comes before its turn waits in the state, sorted, until those before it are there,
    so the state holds as many frames as the stream is out of order. With the last frame
    the closing frame is given as :func:`~tallyframe.operators.sampling.gate` does,
    and the state forgets what it held. A frame that comes twice counts once.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, arrived, taken = {v: now for v, *now in zip(*state.get)} if state.exists else {}, {}, []
        for rows in frames:
            for v, *row in zip(*(rows[c].tolist() for c in ("video_id", "frame_id", "signal", "ends"))):
                arrived.setdefault(v, []).append(row)
        for v, own in arrived.items():
            last, total, chosen, turn, end, early, signals = held.get(v, (-1, 0.0, 0, 0, -1, [], []))
            now, waiting = (None if last < 0 else last, total, chosen), dict(zip(early, signals))
            for f, s, e in own:
                if f >= turn:
                    waiting[f] = s
                end = f if e else end
            while turn in waiting:
                if now[2] < most:
                    now, take = gate_step(now, turn, waiting[turn], least_gap, forced_gap, limit, True)
                    if take:
                        taken.append((v, turn))
                del waiting[turn]
                turn += 1
            if 0 <= end == turn - 1 and now[0] is not None:
                if end - now[0] >= least_gap and now[2] < most:
                    taken.append((v, end))
                    now = (end, 0.0, now[2] + 1)
                end = -1
            early = sorted(waiting)
            held[v] = (-1 if now[0] is None else now[0], float(now[1]), int(now[2]), turn, end, early, [waiting[f] for f in early])
        state.update(tuple(map(list, zip(*([v, *now] for v, now in held.items())))))
        yield pd.DataFrame(taken, columns=["video_id", "frame_id"], dtype="int64")

    kinds = "videos array<long>, last array<long>, total array<double>, chosen array<long>, turn array<long>, end array<long>, held array<array<long>>, signals array<array<double>>"
    return _by_bucket(stream, update, "video_id long, frame_id long", kinds)


def cluster_stream(stream: DataFrame, distance: float) -> DataFrame:
    """(video_id, ord, cluster_id) of a stream (video_id, ord, x, y): each point joins the nearest running mean within ``distance`` or founds a cluster.

    The twin of :func:`~tallyframe.operators.clustering.incremental_clusters`, with its
    fold. The state of a bucket: its videos, the number of clusters of each, and for
    every cluster the sums of x, of y and its number of points.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, many, *sums = map(np.array, state.get) if state.exists else np.zeros((5, 0))
        held = dict(zip(known.tolist(), np.split(np.array(sums, float), np.cumsum(many, dtype=int)[:-1], axis=1)))
        rows = pd.concat(list(frames)).sort_values(["video_id", "ord"])
        videos, starts, sizes = np.unique(rows["video_id"].to_numpy(), return_index=True, return_counts=True)
        x, y, cluster = rows["x"].to_numpy(), rows["y"].to_numpy(), np.empty(len(rows), np.int64)
        own = [held.get(v, np.zeros((3, 0))) for v in videos.tolist()]
        cost = np.cumsum((sizes + [h.shape[1] for h in own]).astype(float) ** 2)
        at = 0
        while at < len(videos):
            end = max(at + 1, int(np.searchsorted(cost, groups.PAIRS_EACH + (cost[at - 1] if at else 0), side="right")))
            part, now = slice(starts[at], starts[end - 1] + sizes[end - 1]), own[at:end]
            cluster[part] = clustering.running_means_of_groups(np.repeat(np.arange(end - at), sizes[at:end]), x[part], y[part], distance, held=now)
            held |= zip(videos[at:end].tolist(), now)
            at = end
        state.update((list(held), [h.shape[1] for h in held.values()], *np.concatenate(list(held.values()), axis=1).tolist()))
        yield pd.DataFrame({"video_id": rows["video_id"].to_numpy(), "ord": rows["ord"].to_numpy(), "cluster_id": cluster})

    return _by_bucket(stream, update, "video_id long, ord long, cluster_id long", "videos array<long>, clusters array<long>, xs array<double>, ys array<double>, ns array<double>")


def _shared(spark: SparkSession) -> str:
    cut(spark.range(1))  # makes sure that there is a checkpoint folder
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    return os.path.join(base, f"stream-{uuid.uuid4().hex}")


def _through_stream(rows: DataFrame, split: str, parts: int, transform) -> DataFrame:
    """Computes the rows once, has the files of one part after the other arrive and be streamed, from the state so far, and returns what was appended."""
    spark = rows.sparkSession
    base = _shared(spark)
    schema = T.StructType(rows.drop(split).schema.fields)
    rows.write.partitionBy(split).parquet(f"{base}/rows")
    whole = spark.read.schema(T.StructType([*schema.fields, rows.schema[split]])).parquet(f"{base}/rows")
    for k in range(parts):
        whole.where(F.col(split) == k).drop(split).write.mode("append").parquet(f"{base}/in")
        found = transform(spark.readStream.schema(schema).parquet(f"{base}/in"))
        run = found.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start(f"{base}/out")
        run.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{base}/out")


def keyframes(spark: SparkSession, sf_dir: str, limit: float, parts: int = 2) -> DataFrame:
    from ..plans.fixtures import frame_signal

    signal = frame_signal(spark, sf_dir).select("video_id", "frame_id", "signal")
    return _through_stream(signal.withColumn("part", (F.col("frame_id") >= 20).cast("int")), "part", parts, lambda s: gate_stream(s, limit))


def keyframes_out_of_order(spark: SparkSession, sf_dir: str, limit: float, parts: int = 3) -> DataFrame:
    from ..plans.fixtures import frame_signal, lengths

    signal = frame_signal(spark, sf_dir).select("video_id", "frame_id", "signal")
    ends = signal.join(lengths(signal), "video_id").withColumn("ends", F.col("frame_id") == F.col("total") - 1).drop("total")
    return _through_stream(ends.withColumn("part", (F.col("frame_id") * 7 % parts).cast("int")), "part", parts, lambda s: ordered_gate_stream(s, limit))


def sightings(spark: SparkSession, sf_dir: str, distance: float, parts: int = 2) -> DataFrame:
    from ..plans.observation_queries import placed

    points = placed(spark, sf_dir).select("video_id", "ord", "x", "y")
    return _through_stream(points.withColumn("part", (F.col("ord") >= 300).cast("int")), "part", parts, lambda s: cluster_stream(s, distance))
