"""Every named query against its SQL on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from tallyframe.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def sql(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def rows(table, names) -> list[tuple]:
    """Values as they come from the engines, so that nulls stay nulls and whole numbers whole."""
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: "null" if v is None or v != v else repr(round(float(v), 6) + 0.0) if isinstance(v, (float, decimal.Decimal)) else str(v)
    return sorted(tuple(plain(row[k]) for k in order) for row in table)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, sql, sf_dir, name):
    found, wanted = catalog.QUERIES[name](spark, sf_dir), sql.execute(catalog.ORACLE[name])
    names = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.collect(), found.columns) == rows(wanted.fetchall(), names)


def test_coordinate_descent_never_gets_worse(spark, sf_dir):
    from pyspark.sql import functions as F

    from tallyframe.operators import search
    from tallyframe.plans.fixtures import detections
    from tallyframe.plans.observation_queries import counted

    det, truth = detections(spark, sf_dir).where(~F.col("frame_id").isin(7, 19)), counted(spark, sf_dir)
    start = {f"type{k}": 0.1 for k in range(1, 6)}
    found = {r.class_name: r for r in search.descend(det, truth, start, step=0.05).collect()}
    for k in range(1, 6):
        before = search.errors_by_threshold(det, truth, k, [0.1])[0.1]
        assert found[f"type{k}"].error <= before
        assert search.errors_by_threshold(det, truth, k, [found[f"type{k}"].threshold]) == {found[f"type{k}"].threshold: found[f"type{k}"].error}


def test_coordinate_descent_against_a_plain_one(spark):
    """Every candidate of every class counted by clusters and votes by the definition."""
    import numpy as np

    from tallyframe.operators import search

    from .test_operators import dbscan

    draw = np.random.default_rng(4)
    rows = [(v, k, f"type{draw.integers(1, 4)}", float(draw.integers(1, 20)) / 20, float(draw.integers(0, 160)), float(draw.integers(0, 160))) for v in (1, 2) for k in range(50)]
    truth = {1: [2, 1, 3, 0, 0], 2: [1, 2, 2, 0, 0]}
    candidates = [round(k * 0.1, 6) for k in range(1, 10)]

    def total(limits):
        error = 0
        for v in (1, 2):
            kept = [r for r in rows if r[0] == v and r[3] >= limits[r[2]]]
            label = dbscan([(r[1], r[4], r[5]) for r in kept], 30.0, 3)
            votes = {}
            for r in kept:
                if r[1] in label:
                    own = votes.setdefault(label[r[1]], [0.0] * 5)
                    own[int(r[2][-1]) - 1] += r[3] ** 2
            counts = [0] * 5
            for own in votes.values():
                counts[own.index(max(own))] += 1
            error += sum(abs(a - b) for a, b in zip(counts, truth[v]))
        return error

    now = {f"type{k}": 0.1 for k in range(1, 6)}
    for _ in range(3):
        before = dict(now)
        for k in range(1, 6):
            best = min(candidates, key=lambda c: (total({**now, f"type{k}": c}), c))
            if total({**now, f"type{k}": best}) < total(now):
                now[f"type{k}"] = best
        if now == before:
            break
    det = spark.createDataFrame(rows, "video_id long, ord long, class_name string, confidence double, rx double, ry double")
    frame = spark.createDataFrame([(v, *t) for v, t in truth.items()], "video_id long, type1 long, type2 long, type3 long, type4 long, type5 long")
    found = {r.class_name: r.threshold for r in search.descend(det, frame, {f"type{k}": 0.1 for k in range(1, 6)}, step=0.1, least=3, distance=30.0).collect()}
    assert found == now


def test_grid_is_what_the_operators_say_one_by_one(spark, sf_dir):
    from pyspark.sql import functions as F

    from tallyframe.operators import clustering, filters, scoring, search, voting
    from tallyframe.plans.fixtures import detections
    from tallyframe.plans.observation_queries import counted
    from tallyframe.plans.registration_queries import feature_pairs

    det = filters.above_threshold(detections(spark, sf_dir), filters.DENSITY_THRESHOLDS).withColumn("w", F.col("quantity") * F.col("quantity"))
    side = ["feature", "strategy", "anchors", "ratio", "matches"]
    reg = search.sequences(*feature_pairs(spark, sf_dir), ["middle"], [4], [0.25], [6, 15]).where("feature = 'sift'")
    truth = counted(spark, sf_dir)
    found = search.grid(det, reg, truth, side, ["skip", "identity"], ["density", "incremental"], [6.0], [3]).collect()
    assert len(found) == 8
    for r in [found[0], found[3], found[5]]:
        one = reg.where(F.col("matches") == r.matches)
        if r.policy == "skip":
            one = one.where("valid")
        x = (F.col("x1") + F.col("x2")) / 2 + F.when(F.col("valid"), F.col("h")[2]).otherwise(0.0)
        points = det.join(one.select("video_id", "frame_id", "h", "valid"), ["video_id", "frame_id"]).select("video_id", "ord", "class_name", "w", x.alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
        make = clustering.density_clusters if r.method == "density" else clustering.incremental_clusters
        voted = voting.detector_vote(points.join(make(points.select("video_id", "ord", "x", "y"), "video_id", 6.0, 3), ["video_id", "ord"]), ["video_id", "cluster_id"], "w")
        want = scoring.distances(truth, voting.dense_counts(voted, truth)).agg(F.sum("l1_types"), F.max("max_error"), F.count_if("exact")).first()
        assert (r.l1, r.worst, r.exact) == tuple(want)


def test_settings_add_no_jobs(spark, sf_dir):
    """Twenty-four settings take as many jobs as two."""
    from pyspark.sql import functions as F

    from tallyframe.operators import search
    from tallyframe.plans.fixtures import detections, registrations
    from tallyframe.plans.observation_queries import counted

    det = detections(spark, sf_dir).where("video_id < 4").withColumn("w", F.lit(1))
    reg = registrations(spark, sf_dir).where("video_id < 4").withColumn("ratio", F.lit(0.25))
    truth = counted(spark, sf_dir).where("video_id < 4")
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for group, (distances, leasts) in {"few": ([40.0], [4]), "many": ([5.0, 10.0, 40.0], [2, 3, 4, 8])}.items():
        spark.sparkContext.setJobGroup(group, group)
        assert search.grid(det, reg, truth, ["ratio"], ["skip", "identity"], ["density"], distances, leasts).count() == 2 * len(distances) * len(leasts)
        jobs.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs[1] <= jobs[0] * 1.5 + 10
