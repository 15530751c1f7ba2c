"""Classes by vote, dense counts, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import softmax
from ..functions.naming import class_index, label
from ..functions.session import by_key

CLASSES = 5


def detector_vote(sightings: DataFrame, keys: list[str], weight: str, name: str = "class_name") -> DataFrame:
    """(keys, pred_class, share): the class of most weight; the lowest class wins ties.

    Unknown names do not vote; a cluster without positive weight gets class -1. The
    weights of all classes are summed in one grouping.
    """
    votes = sightings.withColumn("class_", class_index(F.col(name)))
    sums = votes.groupBy(*keys).agg(*(F.sum(F.when(F.col("class_") == k, F.col(weight))).alias(f"w{k}_") for k in range(CLASSES)))
    total = sum((F.coalesce(f"w{k}_", F.lit(0)) for k in range(1, CLASSES)), F.coalesce("w0_", F.lit(0)))
    best = F.array_max(F.array(*(F.struct(F.col(f"w{k}_").alias("w"), F.lit(-k).alias("c")) for k in range(CLASSES))))
    found = sums.select(*keys, total.alias("total_"), best.alias("best_"))
    voted = F.col("total_") > 0
    return found.select(*keys, F.when(voted, -F.col("best_.c")).otherwise(-1).alias("pred_class"), F.when(voted, F.col("best_.w") / F.col("total_")).alias("share"))


def weighted_probabilities(sightings: DataFrame, keys: list[str], class_of: str, confidence: str, order: list, sharpness: str = "sharpness", top: int = 10, best_bonus: float = 2.0, exponent: float = 2.0) -> DataFrame:
    """(keys, class, probability) from the ``top`` most confident sightings and the best crop.

    ``class_of`` is what the classifier said of a sighting, as a one-hot vector would.
    Sightings vote with their confidence to ``exponent``; the sharpest crop, the first
    of several, votes once more with ``best_bonus`` times the highest confidence's
    weight, whether or not it is among the most confident. No sharpness is no crop to choose.
    ``order`` names columns that tell the sightings of a cluster apart.
    """
    rows = sightings.select(*keys, F.col(class_of).alias("class"), F.col(confidence).alias("said_"), F.col(sharpness).alias("sharp_"), (F.col(order[0]) if len(order) == 1 and isinstance(order[0], str) else F.struct(*order)).alias("at_"))
    rows = by_key(rows, *keys)  # as many tasks as there are partitions, so that none sorts several
    whole = Window.partitionBy(*keys)
    ranked = whole.orderBy(F.desc("said_"), "at_")  # one sort for all of them
    every = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = rows.withColumn("place_", F.row_number().over(ranked)).withColumn("most_", F.max("said_").over(every)).withColumn("sharpest_", F.max("sharp_").over(every))
    first = F.min(F.when(F.col("sharp_") == F.col("sharpest_"), F.col("at_"))).over(every)
    placed = placed.withColumn("first_", first).withColumn("best_", F.coalesce((F.col("sharp_") == F.col("sharpest_")) & (F.col("at_") == F.col("first_")), F.lit(False)))
    weight = F.when(F.col("place_") <= top, F.pow("said_", exponent)).otherwise(0.0) + F.when(F.col("best_"), best_bonus * F.pow("most_", exponent)).otherwise(0.0)
    sums = placed.where(F.col("best_") | (F.col("place_") <= top)).groupBy(*keys, "class").agg(F.sum(weight).alias("w"))
    return sums.withColumn("probability", F.col("w") / F.sum("w").over(whole)).drop("w")


def dense_counts(clusters: DataFrame, videos: DataFrame, key: str = "video_id") -> DataFrame:
    """type1 to type5 for every video, zeros kept; other classes are not counted."""
    counts = clusters.groupBy(key).agg(*(F.count_if(F.col("pred_class") == k).alias(f"type{k + 1}") for k in range(CLASSES)))
    filled = videos.select(key).distinct().join(counts, key, "left")
    return filled.select(key, *(F.coalesce(f"type{k + 1}", F.lit(0)).cast("long").alias(f"type{k + 1}") for k in range(CLASSES)))


def cluster_summary(sightings: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Mean centre, largest box, most confident sighting, number of sightings and of frames."""
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return sightings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_observations"),
        F.avg("x").alias("center_x"),
        F.avg("y").alias("center_y"),
        F.max_by(order, F.struct(size, -F.col(order))).alias("largest_ord"),
        F.max_by(order, F.struct("confidence", -F.col(order))).alias("best_ord"),
        F.size(F.collect_set("frame_id")).cast("long").alias("n_frames"),  # a distinct count would move a row a frame
        F.min("frame_id").alias("first_frame"),
    )


def vector_vote(
    sightings: DataFrame, keys: list[str], probs: str, confidence: str, order: str, sharpness: str = "sharpness", top: int = 10, exponent: float = 2.0, temperature: float = 1.0, best_bonus: float = 2.0, best_alone: bool = False
) -> DataFrame:
    """(keys, class_probs, pred_class): weighted mean of the classifier's probability vectors, the first of the largest classes.

    The ``top`` most confident sightings, by ``order`` where alike, count by confidence
    to ``exponent``. The best crop counts besides, with ``best_bonus`` times the highest
    confidence of all sightings to ``exponent``: it is the sharpest one that has a crop,
    the first of several, and need not be among the most confident. A vector that is
    null is a sighting without a crop; a null sharpness counts as 0. A cluster without
    any crop gets equal shares and class 0. With a ``temperature`` the vectors are
    sharpened or flattened in log space first; ``best_alone`` lets nothing but the best
    crop vote.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(confidence), order))
    logs = F.transform(probs, lambda v: F.log(F.greatest(F.least(v, F.lit(1.0)), F.lit(1e-10))))
    there = F.col(probs).isNotNull()
    vector = F.col(probs) if temperature == 1.0 else F.when(there, softmax(logs, temperature))
    weight = F.when(there & (place <= top) & F.lit(not best_alone), F.pow(F.col(confidence), exponent)).otherwise(0.0)
    rows = sightings.withColumn("v_", vector).withColumn("w_", weight)
    sums = [F.sum(F.coalesce(F.col("v_")[k], F.lit(0.0)) * F.col("w_")).alias(f"s{k}") for k in range(CLASSES)]
    sharpest = F.when(there, F.struct(F.coalesce(F.col(sharpness).cast("double"), F.lit(0.0)), -F.col(order)))
    summed = rows.groupBy(*keys).agg(F.sum("w_").alias("w"), *sums, F.max_by("v_", sharpest).alias("best"), F.max(confidence).alias("most"))
    bonus = F.when(F.col("best").isNotNull(), best_bonus * F.pow("most", exponent)).otherwise(0.0)
    whole = F.col("w") + bonus
    shares = F.array(*(F.when(whole > 0, (F.col(f"s{k}") + F.coalesce(F.col("best")[k], F.lit(0.0)) * bonus) / whole).otherwise(1 / CLASSES) for k in range(CLASSES)))
    found = summed.select(*keys, shares.alias("class_probs"))
    return found.withColumn("pred_class", (F.array_position("class_probs", F.array_max("class_probs")) - 1).cast("int"))


def vector_votes(sightings: DataFrame, keys: list[str], probs: str, confidence: str, order: str, settings: dict[str, tuple[float, float, bool]], sharpness: str = "sharpness", top: int = 10, best_bonus: float = 2.0) -> DataFrame:
    """(setting, keys, pred_class): :func:`vector_vote` under several settings by name -- exponent, temperature, whether the best crop votes alone -- in one pass over the sightings."""
    logs = lambda vector: F.transform(vector, lambda v: F.log(F.greatest(F.least(v, F.lit(1.0)), F.lit(1e-10))))
    tempered = lambda vector, t: vector if t == 1.0 else F.when(vector.isNotNull(), softmax(logs(vector), t))
    there, heats = F.col(probs).isNotNull(), sorted({t for _, t, _ in settings.values()})
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(confidence), order))
    rows = sightings.select(*keys, order, confidence, sharpness, F.col(probs).alias("v_"), (there & (place <= top)).alias("in_"), *(tempered(F.col(probs), t).alias(f"v{n}_") for n, t in enumerate(heats)))
    weight = lambda exponent: F.when(F.col("in_"), F.pow(F.col(confidence), exponent)).otherwise(0.0)
    voters = {(e, t) for e, t, alone in settings.values() if not alone}
    named = lambda e, t: f"e{sorted(voters).index((e, t))}"
    sums = [F.sum(c).alias(n) for e, t in sorted(voters) for n, c in [(f"{named(e, t)}w", weight(e)), *((f"{named(e, t)}s{k}", F.coalesce(F.col(f"v{heats.index(t)}_")[k], F.lit(0.0)) * weight(e)) for k in range(CLASSES))]]
    sharpest = F.when(F.col("v_").isNotNull(), F.struct(F.coalesce(F.col(sharpness).cast("double"), F.lit(0.0)), -F.col(order)))
    summed = rows.groupBy(*keys).agg(*sums, *(F.max_by(f"v{n}_", sharpest).alias(f"best{n}") for n in range(len(heats))), F.max(confidence).alias("most"))

    def told(name: str, exponent: float, temperature: float, alone: bool):
        best = F.col(f"best{heats.index(temperature)}")
        bonus = F.when(best.isNotNull(), best_bonus * F.pow("most", exponent)).otherwise(0.0)
        part = lambda c: F.lit(0.0) if alone else F.col(named(exponent, temperature) + c)
        whole = part("w") + bonus
        shares = F.array(*(F.when(whole > 0, (part(f"s{k}") + F.coalesce(best[k], F.lit(0.0)) * bonus) / whole).otherwise(1 / CLASSES) for k in range(CLASSES)))
        return F.struct(F.lit(name).alias("setting"), shares.alias("class_probs"))

    found = summed.select(*keys, F.explode(F.array(*(told(name, *how) for name, how in settings.items()))).alias("t")).select("t.setting", *keys, "t.class_probs")
    return found.withColumn("pred_class", (F.array_position("class_probs", F.array_max("class_probs")) - 1).cast("int")).drop("class_probs")


def best_crops(sightings: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The sighting of the sharpest, of the largest and of the surest crop; the first wins ties, null counts least."""
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    pick = lambda score: F.max_by(order, F.struct(F.coalesce(score, F.lit(-1.0)), -F.col(order)))
    return sightings.groupBy(*keys).agg(pick(F.col("sharpness")).alias("sharpest"), pick(size).alias("largest"), pick(F.col("confidence")).alias("surest"))


def summary(clusters: DataFrame) -> DataFrame:
    """(label, n): clusters by label, the unclassified among them."""
    return clusters.groupBy(label(F.col("pred_class")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def frames_of_clusters(sightings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame_ids): the distinct frames of each cluster, in order."""
    return sightings.groupBy(*keys).agg(F.array_sort(F.collect_set("frame_id")).alias("frame_ids"))
