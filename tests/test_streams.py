"""Streams: states that videos share, sources that are computed once."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions.session import shared_folder
from tallyframe.operators import clustering, sampling
from tallyframe.streaming import stateful


def streamed(spark, parts, transform):
    """What the parts append, one after the other, and the number of states after each."""
    base, states = f"{shared_folder(spark)}/test-{uuid.uuid4().hex}", []
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        found = transform(spark.readStream.schema(part.schema).parquet(f"{base}/in"))
        run = found.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
        run.awaitTermination()
        states.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
    return sorted(map(tuple, spark.read.parquet(f"{base}/out").collect())), states


def test_points_of_many_videos_share_states(spark, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 4)
    draw = np.random.default_rng(3)
    rows = [(v, k, float(draw.integers(0, 30)), float(draw.integers(0, 30))) for v in range(40) for k in range(12 + v % 9)]
    frame = spark.createDataFrame(rows, "video_id long, ord long, x double, y double")
    late = (F.col("ord") >= 5) & (F.col("video_id") != 7) | (F.col("video_id") == 3)  # 3 comes late, 7 does not come again
    found, states = streamed(spark, [frame.where(~late), frame.where(late)], lambda s: stateful.cluster_stream(s, 4.0))
    assert found == sorted(map(tuple, clustering.incremental_clusters(frame, "video_id", 4.0).collect()))
    assert max(states) <= 4


@pytest.mark.parametrize("ordered", [True, False])
def test_gates_of_many_videos_share_states(spark, monkeypatch, ordered):
    monkeypatch.setattr(stateful, "BUCKETS", 4)
    rows = [(v, f, float((v + f) % 5), f == 39) for v in range(30) for f in range(40)]
    frame = spark.createDataFrame(rows, "video_id long, frame_id long, signal double, ends boolean")
    late = F.col("frame_id") >= 17 if ordered else F.col("frame_id") * 7 % 3 == 0
    gate = stateful.gate_stream if ordered else stateful.ordered_gate_stream
    found, states = streamed(spark, [frame.where(~late), frame.where(late)], lambda s: gate(s, 13.0))
    assert found == sorted(map(tuple, sampling.gate(frame.drop("ends"), "video_id", 13.0, closing=not ordered).select("video_id", "frame_id").collect()))
    assert max(states) <= 4


def test_running_means_go_on_from_what_is_held():
    draw = np.random.default_rng(5)
    group = np.repeat(np.arange(6), [3, 40, 1, 17, 25, 9])
    x, y = draw.integers(0, 20, (2, len(group))).astype(float)
    x[[5, 50]], y[60] = np.nan, np.inf
    within = np.arange(len(group)) - np.searchsorted(group, group)
    for small in (4096, 12):
        want = np.concatenate([clustering.running_means(x[group == g], y[group == g], 3.0) for g in range(6)])
        found, held = np.empty(len(group), np.int64), {g: np.zeros((3, 0)) for g in range(6)}
        for part in (within < 7, within >= 7):
            there = np.unique(group[part]).tolist()
            own = [held[g] for g in there]
            found[part] = clustering.running_means_of_groups(np.unique(group[part], return_inverse=True)[1], x[part], y[part], 3.0, small, own)
            held |= zip(there, own)
        assert found.tolist() == want.tolist()
        assert [h[2].tolist() for h in held.values()] == [np.bincount(want[group == g]).tolist() for g in range(6)]


def test_a_streamed_source_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def told(x):
        seen.add(1)
        return x

    rows = spark.range(20).select((F.col("id") % 3).alias("video_id"), F.col("id").alias("ord"), told(F.col("id").cast("double")).alias("x"), F.lit(0.0).alias("y"))
    found = stateful._through_stream(rows.withColumn("part", (F.col("ord") >= 9).cast("int")), "part", 2, lambda s: stateful.cluster_stream(s, 2.0))
    assert found.count() == 20 and seen.value == 20


def test_a_stream_of_nothing(spark):
    rows = spark.createDataFrame([], "video_id long, ord long, x double, y double, part int")
    found = stateful._through_stream(rows, "part", 2, lambda s: stateful.cluster_stream(s, 2.0))
    assert found.columns == ["video_id", "ord", "cluster_id"] and found.count() == 0
