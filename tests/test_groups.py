import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyframe.operators import clustering, experiments, groups, search, voting


def test_small_groups_are_clustered_in_one_task_as_by_cells(spark):
    draw = np.random.default_rng(3)
    rows = [(f"v{v}", o, float(x), float(y)) for v, n in enumerate((1, 7, 40, 60)) for o, (x, y) in enumerate(draw.integers(-12, 12, (n, 2)))]
    points = spark.createDataFrame(rows, "v string, ord long, x double, y double").repartition(3)
    told = lambda df: sorted(map(tuple, df.collect()))
    found = clustering.density_levels(points, "v", [2.0, 3.0], [1, 4])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
    by_cells = told(clustering.levels_by_cells(points, "v", [2.0, 3.0], [1, 4]))
    assert told(found) == by_cells == told(clustering.density_levels(points, "v", [2.0, 3.0], [1, 4], small=10))


def test_groups_that_go_over_batches_and_slices():
    keys = [k for k, n in enumerate((1, 5, 300, 2, 1, 90)) for _ in range(n)]
    table = pa.table({"k": keys, "n": range(len(keys))})
    for size in (1, 7, 64, 1000):
        seen = [(part["k"].to_pylist(), number.tolist(), part["n"].to_pylist()) for part, number in groups.slices(iter(table.to_batches(max_chunksize=size)), "k")]
        assert [n for part in seen for n in part[2]] == list(range(len(keys)))
        assert len({k for part in seen for k in set(part[0])}) == sum(len(set(part[0])) for part in seen)
        assert all(len(set(zip(k, g))) == len(set(k)) == len(set(g)) for k, g, _ in seen)


def test_pairs_of_groups_by_brute_force():
    draw = np.random.default_rng(4)
    group, x, y = np.sort(draw.integers(0, 4, 120)), draw.normal(0, 9, 120) * 1e3, draw.normal(0, 9, 120)
    for distance in (0.5, 6.0, 900.0):
        a, b = groups.pairs(group, x, y, distance)
        near = ((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= distance**2) & (group[:, None] == group)
        assert sorted(zip(a.tolist(), b.tolist())) == [tuple(p) for p in np.argwhere(near).tolist()]


def test_threshold_sweep_folds_many_videos_and_gives_sums_only(spark):
    draw = np.random.default_rng(5)
    rows = [(v, o, f"type{draw.integers(0, 6)}", int(draw.integers(1, 10)) / 10, float(draw.integers(0, 60)), float(draw.integers(0, 20))) for v, n in enumerate((30, 1, 45)) for o in range(n)]
    det = spark.createDataFrame(rows, "video_id long, ord long, class_name string, confidence double, rx double, ry double")
    truth = spark.createDataFrame([(v, 2, 0, 1, 3, 1) for v in range(4)], "video_id long, type1 long, type2 long, type3 long, type4 long, type5 long")
    candidates, limits = [0.7, 0.2], {"type2": 0.3, "type3": 0.5, "type5": 0.1}
    swept = search.threshold_sweep(det, truth, 2, candidates, limits, least=2, distance=4.0)
    plan = swept._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    found = {r.candidate: (r.every, r.own) for r in swept.collect()}
    for candidate in candidates:
        least = {**limits, "type2": candidate}
        kept = spark.createDataFrame([r for r in rows if r[2] in least and r[3] >= least[r[2]]], det.schema).withColumnsRenamed({"rx": "x", "ry": "y"}).withColumn("w", F.round(F.col("confidence") * F.col("confidence"), 9))
        members = kept.join(clustering.density_clusters(kept, "video_id", 4.0, 2), ["video_id", "ord"])
        counts = voting.dense_counts(voting.detector_vote(members, ["video_id", "cluster_id"], "w"), truth)
        seen = {r.video_id: [r[f"type{k}"] for k in range(1, 6)] for r in counts.collect()}
        errors = [[abs(t - p) for t, p in zip((2, 0, 1, 3, 1), seen[v])] for v in range(4)]
        assert found[candidate] == (sum(map(sum, errors)), sum(e[1] for e in errors))


def test_ways_to_vote_in_one_pass(spark):
    draw = np.random.default_rng(6)
    rows = [(o % 7, o, int(draw.integers(1, 50)), [float(p) for p in draw.dirichlet([1] * 5)] if o % 5 and o % 7 != 6 else None, float(draw.integers(0, 9)) if o % 3 else None) for o in range(150)]
    seen = spark.createDataFrame(rows, "c long, ord long, quantity long, probs array<double>, sharpness double")
    found = voting.vector_votes(seen, ["c"], "probs", "quantity", "ord", experiments.VOTES)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("- Window [") == 1
    for name, (exponent, temperature, alone) in experiments.VOTES.items():
        one = voting.vector_vote(seen, ["c"], "probs", "quantity", "ord", exponent=exponent, temperature=temperature, best_alone=alone)
        assert {r.c: r.pred_class for r in found.where(F.col("setting") == name).collect()} == {r.c: r.pred_class for r in one.collect()}


def test_experiments_share_their_clusters(spark, monkeypatch):
    rows = [(v, o, 10.0 * (o % 3), 0.0, f"type{o % 3 + 1}", 5) for v in range(2) for o in range(9)]
    points = spark.createDataFrame(rows, "video_id long, ord long, x double, y double, class_name string, quantity long")
    truth = spark.createDataFrame([(v, 1, 0, 0, 0, 0) for v in range(2)], "video_id long, type1 long, type2 long, type3 long, type4 long, type5 long")
    calls, real = [], experiments.density_clusters
    monkeypatch.setattr(experiments, "density_clusters", lambda *a: calls.append(1) or real(*a))
    found = {r.experiment: r.l1_types for r in experiments.run(points, truth, ["no_dedup", "density", "density_equal_votes"]).collect()}
    assert len(calls) == 1 and found == {"no_dedup": 16, "density": 0, "density_equal_votes": 0}


def test_running_means_of_many_groups_are_those_one_by_one():
    draw = np.random.default_rng(7)
    group = np.repeat(np.arange(8), draw.integers(1, 50, 8))
    x, y = draw.integers(0, 30, len(group)).astype(float), draw.integers(0, 12, len(group)).astype(float)
    for distance in (1.5, 4.0, 9.0):
        want = np.concatenate([clustering.running_means(x[group == k], y[group == k], distance) for k in range(8)]).tolist()
        assert clustering.running_means_of_groups(group, x, y, distance).tolist() == want == clustering.running_means_of_groups(group, x, y, distance, small=12).tolist()


def test_members_keep_their_columns_and_are_not_joined_back(spark):
    draw = np.random.default_rng(8)
    rows = [(f"v{v}", o, float(x), float(y), f"n{o}") for v, n in enumerate((1, 7, 40, 60)) for o, (x, y) in enumerate(draw.integers(-12, 12, (n, 2)))]
    points = spark.createDataFrame([*rows, (None, 0, 0.0, 0.0, "n")], "v string, ord long, x double, y double, name string").repartition(3)
    told = lambda df: sorted(map(tuple, df.select("v", "ord", "x", "y", "name", "cluster_id").collect()))
    found = clustering.density_members(points, "v", 3.0, 4)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r[0] for r in told(found)} == {"v2", "v3"}
    assert {r[:2] + r[5:] for r in told(found)} == {tuple(r) for r in clustering.density_clusters(points, "v", 3.0, 4).collect()}


def test_a_video_of_detections_is_dealt_once_and_transforms_are_not_broadcast(spark, sf_dir):
    from tallyframe.plans.observation_queries import placed

    plan = placed(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_votes_are_summed_in_one_grouping(spark):
    rows = [(1, "type2", 3), (1, "type1", 3), (1, "type0", 9), (2, "type0", 5), (3, "type5", 0), (3, "type4", 0), (4, "type3", None), (4, "type5", 1)]
    found = voting.detector_vote(spark.createDataFrame(rows, "c int, class_name string, w int"), ["c"], "w")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {r.c: (r.pred_class, r.share) for r in found.collect()} == {1: (0, 0.5), 2: (-1, None), 3: (-1, None), 4: (4, 1.0)}


def test_a_grid_gives_counts_of_groups_and_no_members(spark, monkeypatch):
    draw = np.random.default_rng(9)
    rows = [(v, o % 5, o, f"type{draw.integers(0, 6)}", int(draw.integers(1, 9)), float(x), float(y), float(x), float(y)) for v, n in enumerate((30, 3, 45)) for o, (x, y) in enumerate(draw.integers(0, 25, (n, 2)))]
    det = spark.createDataFrame(rows, "video_id long, frame_id long, ord long, class_name string, w long, x1 double, y1 double, x2 double, y2 double")
    reg = spark.createDataFrame([(r, v, f, [1.0, 0.0, f * r, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], f != 2) for r in (0.0, 3.0) for v in range(4) for f in range(5)], "ratio double, video_id long, frame_id long, h array<double>, valid boolean")
    truth = spark.createDataFrame([(v, 2, 0, 1, 3, 1) for v in range(4)], "video_id long, type1 long, type2 long, type3 long, type4 long, type5 long")
    monkeypatch.setattr(search, "detector_vote", None)  # members of ordinary groups are not voted row by row
    found = search.grid(det, reg, truth, ["ratio"], ["skip", "identity"], ["density", "incremental"], [4.0], [1, 3])
    assert found.count() == 16


def test_a_summary_of_clusters_moves_a_row_a_cluster(spark):
    rows = [(1, o, o // 2, 0.5, float(o), 0.0, 0.0, 0.0, 4.0, 4.0) for o in range(6)]
    seen = spark.createDataFrame(rows, "c int, ord int, frame_id int, confidence double, x double, y double, x1 double, y1 double, x2 double, y2 double")
    found = voting.cluster_summary(seen, ["c"])
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    row = found.first()
    assert (row.n_observations, row.n_frames, row.largest_ord, row.first_frame) == (6, 3, 0, 0)


def _small_search(spark):
    draw = np.random.default_rng(12)
    rows = [(v, int(draw.integers(0, 6)), o, f"type{draw.integers(0, 6)}", int(draw.integers(1, 9)), float(x), float(y), float(x), float(y)) for v, n in enumerate((30, 3, 45, 0, 8)) for o, (x, y) in enumerate(draw.integers(0, 25, (n, 2)))]
    det = spark.createDataFrame(rows, "video_id long, frame_id long, ord long, class_name string, w long, x1 double, y1 double, x2 double, y2 double")
    shift = lambda by: [1.0, 0.0, float(by), 0.0, 1.0, 0.0, 0.0, 0.0, 1.0] if by else None
    told = [(t, v, f, a, shift(draw.integers(0, 5)), float(draw.integers(1, 9)) / 10, int(draw.integers(5, 30))) for t in "ab" for v in range(6) for f in range(6) for a in range(6) if (t, v) != ("b", 1)]
    pairs = spark.createDataFrame(told, "feature string, video_id long, frame_id long, anchor_id long, h array<double>, inlier_ratio double, matches long")
    frames = spark.createDataFrame([(t, v, f, int(draw.integers(5, 30))) for t in "ab" for v in range(6) for f in range(6)], "feature string, video_id long, frame_id long, features long")
    truth = spark.createDataFrame([(v, 2, 0, 1, 3, v) for v in range(8)], "video_id long, type1 long, type2 long, type3 long, type4 long, type5 long")
    return det, pairs, frames, truth


def test_a_grid_of_pairs_moves_neither_transforms_nor_points_under_a_setting(spark, monkeypatch):
    det, pairs, frames, truth = _small_search(spark)
    lists, ways, side = (["first", "middle"], [2, 4], [0.25, 0.6], [6, 15]), (["density", "incremental"], [4.0, 9.0], [1, 3]), ["feature", "strategy", "anchors", "ratio", "matches"]
    whole = search.grid(det, search.sequences(pairs, frames, *lists), truth, side, ["skip"], *ways).drop("policy")
    want, columns = sorted(map(tuple, whole.collect())), whole.columns
    # by the other path for videos of more than twenty detections, and of a place that is no number
    assert sorted(map(tuple, search.grid_of_pairs(det, pairs, frames, truth, *lists, *ways, small=20).select(*columns).collect())) == want
    lost = pairs.withColumn("h", F.when(F.expr("video_id = 4 and h is not null and feature = 'a'"), F.array(*map(F.lit, [float("inf"), *[0.0] * 7, 1.0]))).otherwise(F.col("h")))
    odd = search.grid(det, search.sequences(lost, frames, *lists), truth, side, ["skip"], *ways).drop("policy")
    assert sorted(map(tuple, search.grid_of_pairs(det, lost, frames, truth, *lists, *ways).select(*columns).collect())) == sorted(map(tuple, odd.collect()))
    assert len(want) == 256
    monkeypatch.setattr(search, "grid", None)
    monkeypatch.setattr(search, "sequences", None)
    monkeypatch.setattr(groups, "PAIRS_EACH", 500)
    monkeypatch.setattr(search, "ROWS_EACH", 40)
    assert sorted(map(tuple, search.grid_of_pairs(det, pairs, frames, truth, *lists, *ways).select(*columns).collect())) == want
    assert search.grid_of_pairs(det, pairs, frames, truth.limit(0), *lists, *ways).count() == 0
    assert {r.l1 for r in search.grid_of_pairs(det.limit(0), pairs, frames, truth, *lists, *ways).collect()} == {6 * 8 + 28}
    assert search.grid_of_pairs(det, pairs.limit(0), frames, truth, *lists, *ways).count() == 0


def test_the_search_over_all_lists_goes_by_pairs(spark, sf_dir, monkeypatch):
    from tallyframe.plans import catalog

    monkeypatch.setattr(search, "grid", None)
    monkeypatch.setattr(search, "sequences", None)
    assert catalog.QUERIES["param_grid_all_lists"](spark, sf_dir).count() == 256
