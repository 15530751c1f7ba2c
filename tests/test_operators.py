import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import geometry, naming
from tallyframe.operators import clustering, filters, matching, sampling, voting


def dbscan(points, eps, least):
    """Labels by the definition; points are (ord, x, y)."""
    near = {a: [b for b, bx, by in points if (ax - bx) ** 2 + (ay - by) ** 2 <= eps * eps] for a, ax, ay in points}
    core = [a for a in near if len(near[a]) >= least]
    label, n = {}, 0
    for a in core:
        if a in label:
            continue
        stack, label[a] = [a], n
        while stack:
            for b in near[stack.pop()]:
                if b not in label:
                    label[b] = n
                    if b in core:
                        stack.append(b)
        n += 1
    return label


@pytest.mark.parametrize("eps,least", [(1.0, 3), (2.0, 4), (0.5, 1), (3.0, 6)])
def test_density_clusters_by_definition(spark, eps, least):
    rng = np.random.default_rng(5)
    points = [(v, k, float(x), float(y)) for v in (1, 2) for k, (x, y) in enumerate(rng.integers(-12, 12, (60, 2)) / 2)]
    frame = spark.createDataFrame(points, "video_id long, ord long, x double, y double")
    found = clustering.density_clusters(frame, "video_id", eps, least).collect()
    for v in (1, 2):
        assert {r.ord: r.cluster_id for r in found if r.video_id == v} == dbscan([p[1:] for p in points if p[0] == v], eps, least)


def test_incremental_clusters_keep_gaps(spark):
    points = [(1, k, x, 0.0) for k, x in enumerate([0.0, 10.0, 1.0, 20.0, 20.5, 0.5])]
    frame = spark.createDataFrame(points, "video_id long, ord long, x double, y double")
    found = {r.ord: r.cluster_id for r in clustering.incremental_clusters(frame, "video_id", 3.0, 2).collect()}
    assert found == {0: 0, 2: 0, 5: 0, 3: 2, 4: 2}
    assert clustering.incremental_clusters(frame.limit(0), "video_id", 3.0).count() == 0


def test_suppression_keeps_the_later_of_equal_scores(spark):
    boxes = [(1, 0, 0.9, 0, 0, 10, 10), (1, 1, 0.9, 1, 1, 11, 11), (1, 2, 0.5, 50, 50, 60, 60)]
    frame = spark.createDataFrame([(v, o, s, *map(float, b)) for v, o, s, *b in boxes], "video_id long, ord long, score double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.ord for r in clustering.suppress(frame, ["video_id"], 0.4).collect()) == [1, 2]


def test_even_places_equal_linspace(spark):
    frame = spark.range(1, 400).withColumnRenamed("id", "total")
    for count in (2, 8, 30, 40):
        for row in frame.select("total", sampling.even_places(F.col("total"), count).alias("p")).collect():
            assert row.p == sorted(set(np.linspace(0, row.total - 1, count, dtype=int).tolist()))


def test_projection_guards(spark):
    h = [F.lit(float(v)) for v in (2, 0, 1, 0, 2, 0, 0, 0, 1)]
    flat = [F.lit(0.0)] * 9
    row = spark.range(1).select(
        *(c.alias(n) for c, n in zip(geometry.project(h, F.lit(1.0), F.lit(2.0)), "xy")), geometry.project(flat, F.lit(1.0), F.lit(2.0))[0].alias("none"),
        geometry.project_box(flat, tuple(F.lit(float(v)) for v in range(4)))[0].alias("nobox"), geometry.iou(tuple(F.lit(float(v)) for v in (0, 0, 9, 9)), tuple(F.lit(float(v)) for v in (0, 0, 9, 4))).alias("iou"),
        geometry.rescale(h, 0.5, 0.25)[0].alias("r"), geometry.letterbox(F.lit(200), F.lit(100), 100)[2].alias("top"), geometry.circularity(F.lit(1.0), F.lit(0.0)).alias("c"),
    ).first()
    assert (row.x, row.y, row.none, row.nobox, row.iou, row.r, row.top, row.c) == (3.0, 4.0, None, None, 0.5, 4.0, 25, None)


def test_names(spark):
    names = [" TYPE-3", "type_12", "Typé9", "type0", None, "screw"]
    frame = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, name string")
    rows = frame.select("k", naming.class_index(F.col("name")).alias("c"), naming.natural_order(F.col("name"))[0].alias("n")).orderBy("k").collect()
    assert [r.c for r in rows] == [2, -1, -1, -1, -1, -1] and [r.n for r in rows] == [3, 12, 999, 0, 999, 999]
    stems = spark.createDataFrame([("a_frame000017",), ("b12",), ("none",)], "s string").select(naming.frame_number(F.col("s")).alias("n")).collect()
    assert [r.n for r in stems] == [17, 12, 0]


def test_thresholds_and_policies(spark):
    det = spark.createDataFrame([(1, 0, "Type_1", 0.5), (1, 1, "type2", 0.5), (1, 2, "type9", 0.99)], "video_id long, frame_id long, class_name string, confidence double")
    assert [r.class_name for r in filters.above_threshold(det, {"type1": 0.5, "type2": 0.6}).collect()] == ["Type_1"]
    assert filters.above_threshold(det, {}, 0.5).count() == 3
    reg = spark.createDataFrame([(1, f, [2.0] * 9, f != 1) for f in range(3)], "video_id long, frame_id long, h array<double>, valid boolean")
    assert filters.registered(det, reg, "skip").count() == filters.registered(det, reg, "tracker").count() == 2
    same = filters.registered(det, reg, "identity").where("frame_id = 1").first()
    assert same.h == [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    with pytest.raises(ValueError):
        filters.registered(det, reg, "other")


def test_votes(spark):
    rows = [(1, "type2", 1), (1, "type1", 1), (2, "screw", 5), (3, "type5", 2), (3, "type4", 1)]
    found = {r.c: (r.pred_class, r.share) for r in voting.detector_vote(spark.createDataFrame(rows, "c int, class_name string, w int"), ["c"], "w").collect()}
    assert found[1] == (0, 0.5) and found[2] == (-1, None) and found[3][0] == 4


def test_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(k, rng.integers(0, 4, 5).astype(float).tolist()) for k in range(60)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    found = {(r.q, r.place): r.b for r in matching.neighbours(frame.where("vec_id < 9"), frame, 3).collect()}
    for q, v in vectors[:9]:
        order = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), k) for k, w in vectors if k != q)
        assert [found[q, p] for p in (1, 2, 3)] == [k for _, k in order[:3]]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "video_id long, frame_id long, signal double, total long")
    assert sampling.gate(none, "video_id", 1.0).count() == 0
    assert sampling.uniform(none, "video_id", "total", 5).count() == 0


def test_threshold_search_merges_and_votes_without_a_planted_id(spark):
    from tallyframe.operators import search

    # four sightings at 0.9 with two of another class at 0.6 in the middle, and four that only those two connect
    rows = [(1, k, "type1", 0.9, 100.0 + k, 100.0) for k in range(4)] + [(1, 4 + k, "type2", 0.6, 130.0 + 2 * k, 100.0) for k in range(2)] + [(1, 6 + k, "type1", 0.5, 160.0 + k, 100.0) for k in range(4)]
    det = spark.createDataFrame(rows, "video_id long, ord long, class_name string, confidence double, rx double, ry double")
    truth = spark.createDataFrame([(1, 2, 0, 0, 0, 0), (2, 0, 0, 1, 0, 0)], "video_id long, type1 long, type2 long, type3 long, type4 long, type5 long")
    found = search.threshold_errors(det, truth, 2, [0.1, 0.7], {"type1": 0.1, "type3": 0.1})
    assert found == {0.1: (2, 0), 0.7: (1, 0)}
    assert search.errors_by_threshold(det, truth, 1, [0.1, 0.6, 0.95]) == {0.1: 0, 0.6: 1, 0.95: 2}


def test_counts_of_the_search_are_those_of_the_clusterer(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tallyframe.operators import clustering, search, voting

    draw = np.random.default_rng(2)
    rows = [(v, k, f"type{draw.integers(1, 6)}", float(draw.integers(1, 100)) / 100, float(draw.integers(0, 300)), float(draw.integers(0, 300))) for v in (1, 2, 3) for k in range(90)]
    det = spark.createDataFrame(rows, "video_id long, ord long, class_name string, confidence double, rx double, ry double")
    points = det.select("video_id", "ord", F.col("rx").alias("x"), F.col("ry").alias("y"))
    sightings = det.join(clustering.density_clusters(points, "video_id", 25.0, 4), ["video_id", "ord"]).withColumn("w", F.col("confidence") * F.col("confidence"))
    truth = voting.dense_counts(voting.detector_vote(sightings, ["video_id", "cluster_id"], "w"), det)
    assert truth.agg(F.sum("type1") + F.sum("type2")).first()[0] > 3
    assert search.threshold_errors(det, truth, 1, [0.0], {f"type{k}": 0.0 for k in range(2, 6)}, 4, 25.0) == {0.0: (0, 0)}


def test_the_detector_sees_every_frame(spark, sf_dir):
    from tallyframe.operators import models
    from tallyframe.plans import catalog

    sizes = {r.user_id: r["count"] for r in spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").count().collect()}
    want = []
    for video, total in sizes.items():
        for frame in range(total):
            for c in range(16):
                draw = (video * 31 + frame * 7 + c * 13) % 101 / 101
                if draw < 0.3:
                    x, y = c % 4 * 1920 / 4, c // 4 * 1080 / 4
                    want.append((video, frame, x, y, x + 480, y + 270, 1 - draw, f"type{c % 5 + 1}"))
    found = catalog.QUERIES["model_detections"](spark, sf_dir)
    assert found.columns == [f.split()[0] for f in models.DETECTION.split(", ")]
    assert max(sizes.values()) > 5
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_files_and_what_must_be_there(spark, tmp_path):
    from tallyframe.sources import files

    for name in ("b.MP4", "A.avi", "c.txt", "d"):
        (tmp_path / name).write_text(name)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.mov").write_text("e")
    assert [r.name for r in files.list_files(spark, str(tmp_path)).collect()] == ["A.avi", "b.MP4"]
    assert [r.stem for r in files.list_files(spark, str(tmp_path), recursive=True, lower=True).collect()] == ["A", "b", "e"]
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(tmp_path), ("wmv",), lower=True)
    found = spark.createDataFrame([(1,), (2,)], "video_id long")
    assert files.require(found.where("video_id = 1"), found, "video_id").count() == 1
    with pytest.raises(FileNotFoundError):
        files.require(found, found.where("video_id = 1"), "video_id")


def test_label_folder_of_files(spark, tmp_path):
    from tallyframe.sources import annotations

    (tmp_path / "x.txt").write_text("0 0.5 0.5 0.5 0.5\n7 0.5 0.5 1 1 0.25\nbad\n")
    (tmp_path / "lost.txt").write_text("0 0.5 0.5 0.5 0.5\n")
    images = spark.createDataFrame([(1, "x.jpg", 100, 50)], "image_id long, file_name string, width int, height int")
    kinds = spark.createDataFrame([("screw", 0)], "category string, place int")
    found = sorted(tuple(r) for r in annotations.read_yolo(spark, str(tmp_path), images, kinds).annotations.collect())
    assert found == [(1, "class_7", 0.0, 0.0, 100.0, 50.0, 0.25), (1, "screw", 25.0, 12.5, 75.0, 37.5, 1.0)]


def test_settings_are_checked():
    filters.checked_arguments(1.0, 1, 2)
    for wrong in ((0.0, 1, 30), (float("nan"), 1, 30), (1.0, 0, 30), (1.0, 1, 1), (1.0, 1, 301)):
        with pytest.raises(ValueError):
            filters.checked_arguments(*wrong)
    assert filters.usable({"Type-1": 0.5}, ["type1"]) == {"Type-1": 0.5} and filters.usable({"nut": 0.5}, ["type1"]) is None
    assert filters.coarse_threshold({"type1": 0.5}) == 0.1 and filters.coarse_threshold({"type1": 0.05}) == 0.05 and filters.coarse_threshold(None) == 0.1


def test_lists_of_different_length_stop_the_job(spark):
    from tallyframe.operators import registration

    rows = lambda n, c: spark.createDataFrame([(1, k, k) for k in range(n)], f"video_id long, position long, {c} long")
    assert registration.zipped(rows(3, "f"), rows(3, "d"), rows(3, "r")).count() == 3
    with pytest.raises(Exception, match="differ in length"):
        registration.zipped(rows(3, "f"), rows(2, "d"), rows(3, "r")).collect()


def test_gate_and_its_stream_treat_missing_signals_alike(spark):
    state, take = sampling.gate_step((0, 1.0, 1), 9, float("nan"), 5, 15, 2.0, True)
    assert (state, take) == ((0, 1.0, 1), False)
    assert sampling.gate_step((0, 1.0, 1), 9, None, 5, 15, 1.0, True)[1]


def test_neighbours_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(matching, "QUERY_BLOCK", 7)
    monkeypatch.setattr(matching, "BASE_BLOCK", 11)
    test_neighbours_by_brute_force(spark)


def test_votes_by_vectors(spark):
    columns = "c int, ord int, confidence double, probs array<double>, sharpness double"
    one, two, three = [0.1, 0.6, 0.1, 0.1, 0.1], [0.6, 0.1, 0.1, 0.1, 0.1], [0.0, 0.0, 1.0, 0.0, 0.0]
    rows = [(1, 0, 0.5, one, 9.0), (1, 1, 1.0, two, 1.0), (2, 0, 0.9, None, 5.0), (3, 0, 1.0, None, None), (3, 1, 0.5, one, 2.0), (3, 2, 0.4, two, 2.0)]
    rows += [(4, 0, 0.1, three, 3.0)] + [(4, 1 + k, 1.0, one, 1.0) for k in range(12)]
    frame = spark.createDataFrame(rows, columns)
    found = {r.c: r for r in voting.vector_vote(frame, ["c"], "probs", "confidence", "ord").collect()}
    # the sharpest is not the surest, and its bonus goes by the surest one's confidence
    assert np.allclose(found[1].class_probs, (np.array(one) * (0.25 + 2) + np.array(two)) / 3.25) and found[1].pred_class == 1
    assert found[2].pred_class == 0 and found[2].class_probs == [0.2] * 5
    # the surest has no crop, two are equally sharp
    assert np.allclose(found[3].class_probs, (np.array(one) * (0.25 + 2) + np.array(two) * 0.16) / 2.41)
    # the sharpest is not among the ten surest
    assert np.allclose(found[4].class_probs, (np.array(one) * 10 + np.array(three) * 2) / 12)
    alone = {r.c: r for r in voting.vector_vote(frame, ["c"], "probs", "confidence", "ord", best_alone=True).collect()}
    assert np.allclose(alone[1].class_probs, one) and np.allclose(alone[4].class_probs, three) and alone[2].class_probs == [0.2] * 5


def test_votes_by_names_give_the_sharpest_its_bonus(spark):
    rows = [(1, 0, "a", 1.0, 1.0), (1, 1, "b", 0.5, 7.0), (2, 0, "a", 1.0, None), (3, 0, "z", 0.1, 9.0)] + [(3, 1 + k, "a", 1.0, 1.0) for k in range(11)]
    frame = spark.createDataFrame(rows, "c int, ord int, name string, confidence double, sharpness double")
    found = {(r.c, r["class"]): r.probability for r in voting.weighted_probabilities(frame, ["c"], "name", "confidence", ["ord"]).collect()}
    want = {(1, "a"): 1 / 3.25, (1, "b"): 2.25 / 3.25, (2, "a"): 1.0, (3, "a"): 10 / 12, (3, "z"): 2 / 12}
    assert found.keys() == want.keys() and all(np.isclose(found[k], want[k]) for k in want)


def test_votes_by_names_sort_once(spark):
    rows = [(1, 2, "a", 1.0, 7.0), (1, 1, "b", 0.5, 7.0), (1, 0, "c", 0.5, None)]
    frame = spark.createDataFrame(rows, "c int, ord int, name string, confidence double, sharpness double")
    found = voting.weighted_probabilities(frame, ["c"], "name", "confidence", ["ord"])
    plan = found._jdf.queryExecution().executedPlan().toString().split("HashAggregate")[-1]
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1
    # of two that are equally sharp the first by order has the bonus
    assert {r["class"]: round(r.probability * 3.5, 6) for r in found.collect()} == {"a": 1.0, "b": 2.25, "c": 0.25}


def test_levels_share_counts_and_links(spark):
    """Several distances and least numbers at once, crowded and sparse cells beside one another."""
    rng = np.random.default_rng(11)
    spots = [(float(x), float(y)) for x, y in rng.integers(-10, 10, (70, 2)) / 2] + [(1.0, 1.0)] * 9 + [(2.25, 1.0)] * 7 + [(2.25 + k / 8, 2.5) for k in range(12)]
    points = [(v, k, x + v / 3, y) for v in (1, 2) for k, (x, y) in enumerate(spots)]
    found = clustering.density_levels(spark.createDataFrame(points, "video_id long, ord long, x double, y double"), "video_id", [0.5, 1.25, 2.0], [1, 3, 5, 9]).collect()
    assert len({(r.video_id, r.distance, r.least, r.ord) for r in found}) == len(found)
    for v in (1, 2):
        mine = [p[1:] for p in points if p[0] == v]
        for distance in (0.5, 1.25, 2.0):
            for least in (1, 3, 5, 9):
                got = {r.ord: r.component for r in found if (r.video_id, r.distance, r.least) == (v, distance, least)}
                want = dbscan(mine, distance, least)
                assert got.keys() == want.keys()
                names = {}
                for k in got:
                    assert names.setdefault(want[k], got[k]) == got[k]
                assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("gap,together", [(9.0, True), (10.0, True), (10.001, False)])
def test_two_crowded_cells_make_no_pair_table(spark, gap, together):
    """Crowds of 3,000 in neighbouring cells that just meet, or just do not: nine million pairs if they were compared."""
    rng = np.random.default_rng(3)
    inner = rng.random((3000, 2)) * 3
    points = [(1, k, float(x), float(y)) for k, (x, y) in enumerate([(-u, 1 + v / 9) for u, v in inner])] + [(1, 3000 + k, float(gap + u), float(1 + v / 9)) for k, (u, v) in enumerate(inner)]
    points += [(1, 6000, 0.0, 1.1), (1, 6001, gap, 1.1)]
    frame = spark.createDataFrame(points, "video_id long, ord long, x double, y double").repartition(4)
    found = clustering.density_clusters(frame, "video_id", 10.0, 4)
    assert found.select("cluster_id").distinct().count() == (1 if together else 2)
    assert found.count() == len(points)


def test_running_means_by_brute_force():
    """Clusters drift, so which mean is nearest changes with the order; the cells must follow."""
    rng = np.random.default_rng(9)
    for distance in (0.7, 2.0, 5.0):
        x, y = np.cumsum(rng.normal(size=(2, 400)) * 0.4, axis=1) + rng.integers(0, 3, (2, 400)) * 3.0
        for order in (np.arange(400), rng.permutation(400)):
            u, v, members, want = x[order], y[order], [], []
            for a, b in zip(u, v):
                away = [np.sqrt((a - sum(p) / len(p)) ** 2 + (b - sum(q) / len(q)) ** 2) for p, q in members]
                best = int(np.argmin(away)) if members and min(away) <= distance else len(members)
                if best == len(members):
                    members.append(([], []))
                members[best][0].append(a)
                members[best][1].append(b)
                want.append(best)
            assert clustering.running_means(u, v, distance).tolist() == want
    assert clustering.running_means(np.array([0.0, 4.0, 2.0]), np.zeros(3), 2.0).tolist() == [0, 1, 0]


def test_incremental_levels_are_the_clusters_one_by_one(spark):
    rng = np.random.default_rng(2)
    points = [(v, k, float(a), float(b)) for v in (1, 2) for k, (a, b) in enumerate(rng.random((60, 2)) * 20)]
    frame = spark.createDataFrame(points, "video_id long, ord long, x double, y double")
    found = clustering.incremental_levels(frame, "video_id", [2.0, 4.0]).collect()
    for distance in (2.0, 4.0):
        one = {(r.video_id, r.ord): r.cluster_id for r in clustering.incremental_clusters(frame, "video_id", distance, 3).collect()}
        assert one == {(r.video_id, r.ord): r.cluster_id for r in found if r.distance == distance and r["size"] >= 3}


def test_roots_fall_back_by_video(spark):
    from tallyframe.operators import registration

    rows = [(1, 0, 40), (1, 5, 40), (1, 9, 40), (2, 0, 40), (2, 5, 3), (2, 9, 40), (3, 1, 40), (3, 5, None), (3, 9, 40), (4, 0, 2), (4, 5, 2), (4, 9, 14)]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "video_id long, anchor_id long, features int, preferred long")
    assert {r.video_id: r.root for r in registration.roots(frame, ["video_id"]).collect()} == {1: 5, 2: 9, 3: 1, 4: 5}
    # a chain of shifts, its root another one in each video
    pairs = [(v, f, a, [1.0, 0.0, 8.0 * (f - a), 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], abs(f - a) < 6, 0.5, {1: 5, 2: 9}[v]) for v in (1, 2) for f in range(10) for a in (0, 5, 9)]
    frame = spark.createDataFrame(pairs, "video_id long, frame_id long, anchor_id long, h array<double>, valid boolean, inlier_ratio double, root long")
    found = {(r.video_id, r.frame_id): (r.valid, r.h[2] if r.h else None) for r in registration.multi_anchor(frame, "video_id", "root").collect()}
    assert found == {(v, f): (True, 8.0 * (f - {1: 5, 2: 9}[v])) for v in (1, 2) for f in range(10)}


@pytest.mark.parametrize("words,k,flips", [(1, 2, 6), (2, 3, 40), (4, 1, 90)])
def test_hamming_neighbours_by_brute_force(spark, words, k, flips):
    draw = np.random.default_rng(words)
    signed = lambda w: w - 2**64 if w >= 2**63 else w
    seeds = [[int.from_bytes(draw.bytes(8)) for _ in range(words)] for _ in range(3)]
    codes = []
    for n in range(90):
        code = list(seeds[n % 3])
        for bit in draw.integers(0, 64 * words, draw.integers(0, flips)):
            code[bit // 64] ^= 1 << int(bit % 64)
        codes.append((n, code))
    codes += [(90 + n, seeds[0]) for n in range(30)]  # copies
    frame = spark.createDataFrame([(n, [signed(w) for w in c]) for n, c in codes] + [(200, None), (None, [0] * words)], "vec_id long, code array<long>")
    found = {(r.q, r.place): (r.b, r.distance) for r in matching.hamming_neighbours(frame.where("vec_id % 10 = 0 or vec_id is null"), frame, k, words).collect()}
    want = {}
    for n, c in codes:
        if n % 10 == 0:
            ranked = sorted((sum((x ^ y).bit_count() for x, y in zip(c, d)), m) for m, d in codes if m != n)
            want.update({(n, place): (m, away) for place, (away, m) in enumerate(ranked[:k], 1)})
    assert found == want
    assert matching.hamming_neighbours(frame.limit(0), frame, k, words).count() == 0
    assert matching.hamming_neighbours(frame.where("vec_id = 1"), frame.where("vec_id = 1"), k, words).count() == 0


def test_sign_codes(spark):
    row = spark.createDataFrame([([1.0, -1.0, 0.0, 2.0] + [0.0] * 59 + [1.0] + [-1.0, 3.0],)], "v array<float>").select(matching.sign_code(F.col("v"), 66).alias("c")).first()
    assert row.c == [9 - 2**63, 2]


def test_statistics_of_any_split_are_those_of_one_pass(spark, tmp_path):
    from tallyframe.operators import statistics

    draw = np.random.default_rng(8)
    values = [float(v) for v in 1e6 + draw.normal(size=200)]
    rows = spark.createDataFrame([(k % 3, k % 11, v) for k, v in enumerate(values)] + [(0, 1, None)], "kind long, run long, value double")
    whole = {r.kind: r for r in statistics.summary(statistics.states(rows, ["kind"], "value"), ["kind"]).collect()}
    path = str(tmp_path / "runs")
    for run in (1, 2, 3, 2):  # the second one is repeated
        statistics.add_run(statistics.states(rows.where(f"run % 3 = {run % 3}"), ["kind", "run"], "value").withColumnRenamed("run", "part"), path, f"r{run}")
    merged = {r.kind: r for r in statistics.summary(statistics.load_runs(spark, path), ["kind"]).collect()}
    for kind in range(3):
        mine = np.array(values[kind::3])
        for r in (whole[kind], merged[kind]):
            assert r.n == len(mine) and (r.least, r.most) == (mine.min(), mine.max())
            assert np.isclose(r["mean"], mine.mean(), rtol=1e-12) and np.isclose(r.deviation, mine.std(), rtol=1e-9)
    none = statistics.summary(statistics.states(rows.limit(0), [], "value")).collect()
    assert [tuple(r) for r in none] == [(0, 0.0, 0.0, 0.0, 0.0)]
    assert statistics.summary(statistics.states(rows.limit(0), ["kind"], "value"), ["kind"]).count() == 0


@pytest.mark.parametrize("limit", [0.0, 0.3, 0.7])
def test_suppression_in_rounds_is_the_fold(spark, limit):
    draw = np.random.default_rng(4)
    rows = [(v, k, int(draw.integers(0, 9)), *map(float, (x, y, x + w, y + h))) for v in (1, 2) for k, (x, y, w, h) in enumerate(zip(*draw.integers(0, 120, (2, 150)), *draw.integers(1, 60, (2, 150))))]
    frame = spark.createDataFrame(rows, "video_id long, ord long, score int, x1 double, y1 double, x2 double, y2 double")
    fold = sorted(map(tuple, clustering.suppress(frame, ["video_id"], limit).collect()))
    assert sorted(map(tuple, clustering.suppress(frame, ["video_id"], limit, crowd=10).collect())) == fold
    mixed = frame.where("video_id = 1 or ord < 5")
    assert sorted(map(tuple, clustering.suppress(mixed, ["video_id"], limit, crowd=10).collect())) == sorted(map(tuple, clustering.suppress(mixed, ["video_id"], limit).collect()))
    assert clustering.suppress_in_rounds(frame.limit(0), ["video_id"], limit).count() == 0


def test_a_frame_of_many_boxes(spark):
    """100,000 boxes in one frame: copies of 2,000 places, of which one each stays."""
    place = F.col("id") % 2000
    x, y = (place % 50 * 40).cast("double"), (F.floor(place / 50) * 40).cast("double")
    frame = spark.range(100_000).select(F.lit(1).alias("frame_id"), F.col("id").alias("ord"), F.floor(F.col("id") / 2000).alias("score"), x.alias("x1"), y.alias("y1"), (x + 19).alias("x2"), (y + 19).alias("y2"))
    assert sorted(r.ord for r in clustering.suppress(frame, ["frame_id"], 0.5).collect()) == list(range(98_000, 100_000))


def test_gates_by_segments_are_the_fold(spark):
    draw = np.random.default_rng(6)
    rows = []
    for v in range(4):
        frames = np.flatnonzero(draw.random(700) < (1.0, 0.8, 0.3, 0.05)[v])
        rows += [(v, int(f), None if draw.random() < 0.02 else float("nan") if draw.random() < 0.02 else float(draw.exponential(2.0))) for f in frames]
    frame = spark.createDataFrame(rows, "video_id long, frame_id long, signal double").repartition(3)
    for rule in ({}, {"most": None}, {"most": 7}, {"closing": False, "cumulative": False, "most": None}, {"least_gap": 1, "forced_gap": 3, "most": None}, {"least_gap": 8, "forced_gap": 8, "most": 20}):
        want = sorted(map(tuple, sampling.gate(frame, "video_id", 12.0, **rule).collect()))
        assert sorted(map(tuple, sampling.gate_by_segments(frame, "video_id", 12.0, **rule, each=16).collect())) == want
    assert sampling.gate_by_segments(frame.limit(0), "video_id", 1.0).count() == 0
    with pytest.raises(ValueError):
        sampling.gate_by_segments(frame, "video_id", 1.0, each=4)
