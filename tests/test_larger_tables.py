"""Steps that must not cost a group at a time."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from tallyframe.functions.session import shared_folder
from tallyframe.operators import clustering, groups, matching, models, registration, sampling
from tallyframe.plans import catalog
from tallyframe.sources import annotations
from tallyframe.sources.text_files import write_files


def test_trees_of_many_videos_at_once_by_the_definition(spark, monkeypatch):
    draw = np.random.default_rng(11)
    rows = [(v, int(f), int(a), [1.0, 0.0, float(draw.integers(-9, 9)), 0.0, 1.0, 0.0, 0.0, 0.0, 1.0] if draw.random() < 0.9 else None, bool(draw.random() < 0.5), float(draw.integers(1, 9)) / 10, int(v % 5)) for v in range(12) for f in range(8) for a in (1, 3, 4, 6) if f != a and draw.random() < 0.8]
    frame = spark.createDataFrame(rows, "video_id long, frame_id long, anchor_id long, h array<double>, valid boolean, inlier_ratio double, root long").repartition(3)
    found = registration.multi_anchor(frame, "video_id", "root")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan and "Join" not in plan
    wanted = {}
    for v in range(12):
        own, top = [r for r in rows if r[0] == v], v % 5
        pairs = {(r[1], r[2]): (r[3][2], r[5]) for r in own if r[4] and r[3]}
        anchors = {r[2] for r in own}
        done = {top: (0.0, 1.0)} if any(r[1] in anchors for r in own) else {}
        near = lambda f: min(((abs(f - a), abs(a - top), a) for a in done if (f, a) in pairs), default=None)  # noqa: B023, E731
        by = lambda f, a: (pairs[f, a][0] + done[a][0], min(pairs[f, a][1], done[a][1]))  # noqa: B023, E731
        for a in sorted(anchors - {top}, key=lambda a: (abs(a - top), a)):
            if near(a):
                done[a] = by(a, near(a)[2])
        for f in {r[1] for r in own}:
            a = f if f in done else near(f)[2] if near(f) else None
            wanted[v, f] = (a, a is not None, *((None, 0.0) if a is None else done[f] if a == f else by(f, a)))
    monkeypatch.setattr(registration, "ROWS_EACH", 50)
    for df in (found, registration.multi_anchor(frame, "video_id", "root")):
        assert {(r.video_id, r.frame_id): (r.anchor_id, r.valid, r.h[2] if r.h else None, r.inlier_ratio) for r in df.collect()} == wanted


def test_registrations_under_many_settings_take_one_shuffle(spark, sf_dir):
    plan = catalog.QUERIES["register_settings"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "InPandas" not in plan


def test_segments_cost_no_frame_each(spark):
    signal = spark.createDataFrame([(v, f, float(f % 3)) for v in range(3) for f in range(70)], "video_id long, frame_id long, signal double")
    assert sampling.gate_by_segments(signal, "video_id", 9.0, each=32).count() == sampling.gate(signal, "video_id", 9.0).count()
    rows = signal.withColumn("n", F.lit(1))
    found = groups.folded(rows, ["video_id"], "frame_id", lambda c: [(c["frame_id"][-1], sum(c["signal"]))], {"last": "long", "total": "double"})
    told = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in told and "InPandas" not in told
    assert sorted(map(tuple, found.collect())) == [(v, 69, 69.0) for v in range(3)]


def test_hamming_search_goes_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(matching, "CODE_BLOCK", 16)
    monkeypatch.setattr(matching, "CODES_AT_ONCE", 3)
    draw = np.random.default_rng(2)
    codes = [(n, [int(draw.integers(0, 16))]) for n in range(70)]
    frame = spark.createDataFrame(codes, "vec_id long, code array<long>")
    found = {(r.q, r.place): (r.b, r.distance) for r in matching.hamming_neighbours(frame.where("vec_id % 2 = 0"), frame, 3, 1).collect()}
    want = {}
    for n, (c,) in codes[::2]:
        ranked = sorted(((c ^ d).bit_count(), m) for m, (d,) in codes if m != n)
        want.update({(n, place): (m, away) for place, (away, m) in enumerate(ranked[:3], 1)})
    assert found == want


def test_suppression_of_many_frames_at_once(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BOXES_EACH", 40)
    draw = np.random.default_rng(8)
    rows = [(v, k, int(draw.integers(0, 5)), *map(float, (x, y, x + 20, y + 15))) for v in range(9) for k, (x, y) in enumerate(draw.integers(0, 60, (12 + v, 2)))]
    frame = spark.createDataFrame(rows, "video_id long, ord long, score int, x1 double, y1 double, x2 double, y2 double")
    found = clustering.suppress(frame, ["video_id"], 0.3, corners=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "collect_list" not in plan
    want = []
    for v in range(9):
        kept = []
        for r in sorted((r for r in rows if r[0] == v), key=lambda r: (-r[2], -r[1])):
            over = lambda a: (w := max(0, min(a[5], r[5]) - max(a[3], r[3]) + 1) * max(0, min(a[6], r[6]) - max(a[4], r[4]) + 1)) / (2 * 21 * 16 - w)  # noqa: B023, E731
            if all(over(a) <= 0.3 for a in kept):
                kept.append(r)
        want += kept
    assert sorted(map(tuple, found.select("video_id", "ord", "score", "x1", "y1", "x2", "y2").collect())) == sorted(want)


def test_a_detector_that_takes_many_frames(spark):
    sizes = []

    class Seen(models.GridDetector):
        def __call__(self, frames):
            sizes.append(len(frames))
            return super().__call__(frames)

    frames = spark.range(50).select("id", F.lit(1).alias("v")).toPandas().rename(columns={"id": "frame_id", "v": "video_id"}).assign(width=100, height=100)
    apart = [tuple(r) for at in range(0, 50, 16) for r in models.GridDetector()(frames.iloc[at : at + 16]).itertuples(index=False)]
    assert [tuple(r) for r in Seen()(frames).itertuples(index=False)] == apart and models.GridDetector.batch > 16


def test_annotation_files_are_opened_once(spark):
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    images = spark.createDataFrame([(1, "a.jpg", 10, 10)], "image_id long, file_name string, width int, height int")
    write_files(spark.createDataFrame([("a.txt", "0 0.5 0.5 0.2 0.2"), ("classes.txt", "nut")], "name string, content string"), folder)
    data = annotations.read(spark, folder, "yolo", images)
    plan = data.annotations._jdf.queryExecution().executedPlan().toString()
    assert "text_files" not in plan and "BatchScan" not in plan
    assert [r.category for r in data.annotations.collect()] == ["nut"]
