"""Named experiments: several ways to count, scored against one truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut
from .clustering import density_clusters, incremental_clusters
from .scoring import distances
from .voting import CLASSES, dense_counts, detector_vote, vector_votes

#: The experiments by name -- how sightings are merged, how they vote.
EXPERIMENTS = {
    "no_dedup": {"merge": "none", "exponent": 2},
    "incremental": {"merge": "incremental", "exponent": 2},
    "density": {"merge": "density", "exponent": 2},
    "density_equal_votes": {"merge": "density", "exponent": 0},
}

#: Ways to vote with the classifier's vectors: the weight's exponent, the temperature, whether the best crop votes alone.
VOTES = {"squared": (2.0, 1.0, False), "equal": (0.0, 1.0, False), "sharp": (2.0, 0.5, False), "best_crop": (2.0, 1.0, True)}


def counts(points: DataFrame, merge: str, exponent: int, distance: float = 40.0, least: int = 4, found: DataFrame | None = None) -> DataFrame:
    """type1 to type5 by video for one experiment; ``points`` has x, y, class_name and the whole number ``quantity`` as confidence, ``found`` the clusters if they are known."""
    if merge == "none":
        clusters = points.withColumn("cluster_id", F.col("ord"))
    else:
        clusters = points.join(merged(points, merge, distance, least) if found is None else found, ["video_id", "ord"])
    weight = F.col("quantity") * F.col("quantity") if exponent == 2 else F.lit(1).cast("long")
    return dense_counts(detector_vote(clusters.withColumn("w", weight), ["video_id", "cluster_id"], "w"), points)


def merged(points: DataFrame, merge: str, distance: float = 40.0, least: int = 4) -> DataFrame:
    """(video_id, ord, cluster_id) by one way to merge sightings."""
    find = density_clusters if merge == "density" else incremental_clusters
    return find(points.select("video_id", "ord", "x", "y"), "video_id", distance, least)


def run(points: DataFrame, truth: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(experiment, l1_types, max_error, exact_videos), one row each; points, truth and each way to merge are computed once, whatever experiments share them."""
    points, truth = cut(points.select("video_id", "ord", "x", "y", "class_name", "quantity")), cut(truth)
    known, parts = {}, []
    for name in names or list(EXPERIMENTS):
        how = EXPERIMENTS[name]
        if how["merge"] != "none" and how["merge"] not in known:
            known[how["merge"]] = cut(merged(points, how["merge"]))
        found = distances(truth, counts(points, **how, found=known.get(how["merge"])))
        parts.append(found.agg(F.lit(name).alias("experiment"), F.sum("l1_types").alias("l1_types"), F.max("max_error").alias("max_error"), F.count_if("exact").alias("exact_videos")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def run_votes(sightings: DataFrame, truth: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """(experiment, l1_types, max_error, exact_videos) of ways to vote, on sightings (keys, ord, quantity, probs, sharpness) of clusters that are given; all of them in one pass."""
    names = names or list(VOTES)
    voted = vector_votes(sightings, keys, "probs", "quantity", "ord", {name: VOTES[name] for name in names})
    counts = voted.groupBy(F.col("setting").alias("experiment"), "video_id").agg(*(F.count_if(F.col("pred_class") == k).alias(f"p{k + 1}") for k in range(CLASSES)))
    wanted = truth.withColumn("experiment", F.explode(F.array(*map(F.lit, names))))
    error = [F.abs(F.col(f"type{k}") - F.coalesce(f"p{k}", F.lit(0))) for k in range(1, CLASSES + 1)]
    scored = wanted.join(counts, ["experiment", "video_id"], "left").select("experiment", sum(error[1:], error[0]).alias("l1"), F.greatest(*error).alias("worst"))
    return scored.groupBy("experiment").agg(F.sum("l1").alias("l1_types"), F.max("worst").alias("max_error"), F.count_if(F.col("l1") == 0).alias("exact_videos"))
