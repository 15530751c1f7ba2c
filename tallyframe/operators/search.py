"""Parameter search: a grid in one job, and coordinate descent over thresholds."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import center, project
from ..functions.naming import class_index
from ..functions.session import by_key, cut
from . import groups
from .clustering import SMALL, incremental_levels, levels_by_cells, running_means_of_groups, split_by_size
from .filters import DENSITY_THRESHOLDS, checked_arguments
from .registration import IDENTITY, ROWS_EACH, Trees, anchor_places, entries, listed, matrices, preferred_root, roots
from .voting import CLASSES, detector_vote


def _literals(**lists) -> Column:
    """Every combination of the lists, exploded from one literal array of structs."""
    rows = [F.struct(*(F.lit(v).alias(k) for k, v in zip(lists, values))) for values in itertools.product(*lists.values())]
    return F.explode(F.array(*rows))


def sequences(
    pairs: DataFrame, frames: DataFrame, strategies: list[str], counts: list[int], ratios: list[float], matches: list[int], key: str = "video_id", least_features: int = 15
) -> DataFrame:
    """Registrations (feature, strategy, anchors, ratio, matches, key, frame_id, h, valid) under every setting.

    ``pairs`` has the transforms between frames as each feature type finds them
    (feature, key, frame_id, anchor_id, h, inlier_ratio, matches), ``frames`` the
    features of each frame (feature, key, frame_id, features), frames numbered from 0.
    Anchors are even places with the root among them, the root the ``first`` or the
    ``middle`` frame or, where that has too few features, another anchor of this video.
    A pair counts if it has enough matches and inliers. A video's pairs are dealt once,
    whatever the number of settings is, which its fold goes through.
    """
    places_ = _places(frames, strategies, counts, key, least_features)
    told = _told(pairs, key)
    told = by_key(told.unionByName(places_, allowMissingColumns=True), "feature", key).sortWithinPartitions("feature", key)
    kinds = dict(pairs.dtypes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs and chosen anchors of whole videos; the trees of a choice of anchors are laid out once for all limits of pairs."""
        for table, group in groups.slices(batches, ["feature", key], ROWS_EACH, ROWS_EACH):
            is_pair = table["strategy_"].is_null().to_numpy()
            begins = np.flatnonzero(np.diff(group, prepend=-1))
            pair_group, chosen_group = group[is_pair], group[~is_pair]
            of_pairs, of_chosen = table.filter(pa.array(is_pair)), table.filter(pa.array(~is_pair))
            there = of_pairs["h"].is_valid().to_numpy()
            numbers = [of_pairs[c].to_numpy() for c in ("frame_", "anchor_", "ratio_", "matches_")]
            places = [of_chosen[c].to_numpy() for c in ("anchor_", "root_", "strategy_", "anchors_")]
            for nth, count, least_ratio, least_matches, of, frame, found, fits in _registered(pair_group, matrices(of_pairs["h"], there), there, *numbers, chosen_group, *places, len(strategies), counts, ratios, matches):
                at, size = begins[of], len(of)
                rows = {"feature": table["feature"].take(pa.array(at)), "strategy": pa.array([strategies[nth]]).take(pa.array(np.zeros(size, np.int32))), "anchors": np.full(size, count, np.int32), "ratio": np.full(size, float(least_ratio))}
                rows |= {"matches": np.full(size, least_matches, np.int32), key: table[key].take(pa.array(at)), "frame_id": frame, "h": listed(found, fits), "valid": fits}
                yield from pa.table(rows).to_batches(max_chunksize=65536)

    found = told.mapInArrow(fold, f"feature {kinds['feature']}, strategy string, anchors int, ratio double, matches int, {key} {kinds[key]}, frame_id long, h array<double>, valid boolean")
    return found.withColumn("frame_id", F.col("frame_id").cast(kinds["frame_id"]))


def _places(frames: DataFrame, strategies: list[str], counts: list[int], key: str, least_features: int) -> DataFrame:
    """(feature, key, anchor_, root_, strategy_, anchors_): the anchors of each video under every strategy, by its number, and every count, with their root."""
    if min(counts) < 2 or not set(strategies) <= {"first", "middle"}:
        raise ValueError("at least two anchors, and first or middle as a strategy")
    totals = frames.groupBy("feature", key).agg(F.count(F.lit(1)).alias("total"))
    placed = totals.select("feature", key, "total", _literals(strategy=strategies, anchors=counts).alias("s")).select("feature", key, "total", "s.*")
    placed = placed.withColumn("preferred", preferred_root(F.col("total"), F.col("strategy") == "middle"))
    places = F.coalesce(*(F.when(F.col("anchors") == c, anchor_places(F.col("total"), c, F.col("preferred"))) for c in counts))
    setting = ["feature", "strategy", "anchors", key]
    chosen = placed.select(*setting, "preferred", F.explode(places).alias("anchor_id"))
    known = chosen.join(frames.select("feature", key, F.col("frame_id").alias("anchor_id"), "features").hint("merge"), ["feature", key, "anchor_id"], "left")
    chosen = chosen.drop("preferred").join(roots(known, setting, least=least_features).hint("merge"), setting)
    return chosen.select("feature", key, F.col("anchor_id").cast("long").alias("anchor_"), F.col("root").cast("long").alias("root_"), (F.array_position(F.array(*map(F.lit, strategies)), F.col("strategy")) - 1).cast("int").alias("strategy_"), F.col("anchors").cast("int").alias("anchors_"))


def _told(pairs: DataFrame, key: str) -> DataFrame:
    """The pairs (feature, key, frame_, anchor_, h, ratio_, matches_) as numbers; what is missing reaches no limit."""
    return pairs.select("feature", key, F.col("frame_id").cast("long").alias("frame_"), F.col("anchor_id").cast("long").alias("anchor_"), F.col("h").cast("array<double>").alias("h"), F.coalesce(F.col("inlier_ratio").cast("double"), F.lit(float("-inf"))).alias("ratio_"), F.coalesce(F.col("matches").cast("long"), F.lit(-(2**63))).alias("matches_"))


def _registered(
    group: np.ndarray, h: np.ndarray, there: np.ndarray, frame: np.ndarray, anchor: np.ndarray, ratio: np.ndarray, said: np.ndarray,
    chosen_group: np.ndarray, chosen: np.ndarray, chosen_root: np.ndarray, strategy: np.ndarray, anchors: np.ndarray, strategies: int, counts: list[int], ratios: list[float], matches: list[int],
) -> Iterator[tuple]:
    """For each setting (number of the strategy, anchors, ratio, matches) the frames it registers: their groups, numbers, transforms and whether those are there.

    Pairs are in order of their groups; a setting without any pair of a chosen anchor is left out.
    """
    n_groups = int(max(group.max(initial=-1), chosen_group.max(initial=-1))) + 1
    values, code = np.unique(np.concatenate([anchor, chosen]), return_inverse=True)
    code = np.concatenate([group, chosen_group]) * len(values) + code
    for nth, count in itertools.product(range(strategies), sorted(set(counts))):
        mine = (strategy == nth) & (anchors == count)
        root = np.zeros(n_groups, np.int64)
        root[chosen_group[mine]] = chosen_root[mine]
        some = np.flatnonzero(np.isin(code[: len(anchor)], code[len(anchor) :][mine]))
        if not len(some):
            continue
        trees = Trees(group[some], frame[some], anchor[some], root[group[some]], h[some], ratio[some])
        of = group[some][trees.first[trees.frame_group]]
        for least_ratio, least_matches in itertools.product(ratios, matches):
            used, found, _ = trees.through(there[some] & ~(ratio[some] < least_ratio) & (said[some] >= least_matches))
            yield nth, count, least_ratio, least_matches, of, trees.frame_number, found, used >= 0


def grid(det: DataFrame, reg: DataFrame, truth: DataFrame, side: list[str], policies: list[str], methods: list[str], distances: list[float], least_seen: list[int]) -> DataFrame:
    """One row a setting: the sums of count errors over videos, the worst one, and the videos that are exact.

    ``reg`` has the registrations (side, video_id, frame_id, h, valid) under each
    setting, whose values ``side`` names; ``det`` the detections (video_id, frame_id,
    ord, class_name, w, and their boxes). Under every policy, method, distance and
    least number of sightings they are projected, clustered, classed by vote and
    counted, and the counts are held against ``truth``.

    Nothing is run anew for a setting: settings that register a video alike share its
    points, told by two independent sums of hashes over its transforms. Videos are
    clustered and voted many at a time under every method, distance and least number, and
    give a task's counts, no rows of members; those of more than ``clustering.SMALL``
    points go by :func:`~tallyframe.operators.clustering.levels_by_cells` and
    :func:`~tallyframe.operators.clustering.incremental_levels`. No table of transforms
    or points is broadcast.
    """
    if not set(methods) <= {"density", "incremental"} or not set(policies) <= {"skip", "tracker", "identity"}:
        raise ValueError("unknown method or policy")
    for distance, least in itertools.product(distances, least_seen):
        checked_arguments(distance, least)
    same = F.array(*(F.lit(v) for v in IDENTITY))
    kept = F.when(F.col("valid"), F.col("h")).when(F.col("policy") == "identity", same)
    reg = reg.withColumn("policy", F.explode(F.array(*map(F.lit, policies))))
    reg = cut(reg.select(*side, "policy", "video_id", "frame_id", kept.alias("h")))
    told = lambda more: F.xxhash64("frame_id", "h", F.lit(more))
    alike = reg.where("h is not null").groupBy(*side, "policy", "video_id").agg(F.sum(told(1).cast("decimal(38,0)")).cast("string").alias("one"), F.bit_xor(told(2)).cast("string").alias("other"))
    alike = cut(alike.select(*side, "policy", "video_id", F.concat_ws("|", F.col("video_id").cast("string"), "one", "other").alias("same")))
    shown = alike.groupBy("same", "video_id").agg(F.min(F.struct(*side, "policy")).alias("s"))
    shown = cut(shown.select("same", "video_id", "s.*", F.monotonically_increasing_id().alias("key")))  # a number is shorter than a text in every row
    alike = cut(alike.join(shown.select("same", "key").hint("merge"), "same").drop("same").withColumnRenamed("key", "same"))
    placed = reg.where("h is not null").join(shown.drop("same").hint("merge"), [*side, "policy", "video_id"]).select("key", "video_id", "frame_id", "h")
    x, y = project(entries("h"), *center(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))))
    points = det.join(placed.hint("merge"), ["video_id", "frame_id"]).select("key", "ord", "class_name", "w", x.alias("x"), y.alias("y")).where("x is not null")
    usual, large = split_by_size(cut(points), "key")
    counts, how = _tallied(usual, methods, distances, least_seen), ["method", "distance", "least"]
    if large is not None:
        plain, clusters = large.select("key", "ord", "x", "y"), []
        if "density" in methods:
            clusters.append(levels_by_cells(plain, "key", distances, least_seen).select("key", "ord", F.lit("density").alias("method"), "distance", "least", F.col("component").alias("cluster")))
        if "incremental" in methods:
            folded = incremental_levels(plain, "key", distances).withColumn("least", F.explode(F.array(*map(F.lit, least_seen)))).where("size >= least")
            clusters.append(folded.select("key", "ord", F.lit("incremental").alias("method"), "distance", "least", F.col("cluster_id").alias("cluster")))
        found = clusters[0] if len(clusters) == 1 else clusters[0].unionByName(clusters[1])
        voted = detector_vote(large.join(found, ["key", "ord"]), ["key", *how, "cluster"], "w")
        more = voted.groupBy("key", *how).agg(*(F.count_if(F.col("pred_class") == k).alias(f"p{k + 1}") for k in range(CLASSES)))
        counts = counts.unionByName(more)
    counts = counts.withColumnRenamed("key", "same")
    settings = F.broadcast(reg.select(*side, "policy").distinct())  # the values of the lists
    wanted = truth.join(settings).join(alike.hint("merge"), [*side, "policy", "video_id"], "left")
    wanted = wanted.withColumn("how", _literals(method=methods, distance=[float(d) for d in distances], least=least_seen))
    wanted = wanted.select(*side, "policy", "same", *(f"type{k}" for k in range(1, CLASSES + 1)), "how.*")
    error = [F.abs(F.col(f"type{k}") - F.coalesce(f"p{k}", F.lit(0))) for k in range(1, CLASSES + 1)]
    scored = wanted.join(counts.hint("merge"), ["same", *how], "left").select(*side, "policy", *how, sum(error[1:], error[0]).alias("l1"), F.greatest(*error).alias("worst"))
    return scored.groupBy(*side, "policy", *how).agg(F.sum("l1").alias("l1"), F.max("worst").alias("worst"), F.count_if(F.col("l1") == 0).alias("exact"))


def grid_of_pairs(
    det: DataFrame, pairs: DataFrame, frames: DataFrame, truth: DataFrame, strategies: list[str], counts: list[int], ratios: list[float], matches: list[int],
    methods: list[str], distances: list[float], least_seen: list[int], least_features: int = 15, small: int = SMALL,
) -> DataFrame:
    """:func:`grid` of :func:`sequences`, frames without a transform skipped: (feature, strategy, anchors, ratio, matches, method, distance, least, l1, worst, exact).

    Neither transforms nor points under a setting become rows. What a video has, its
    pairs, its places of anchors, its detections and its truth, meets in a task in one
    shuffle, the numbers of many rows compressed into one; there whole
    videos, many at a time, are registered, placed, clustered, voted and held against
    their truth under every setting, those that place a video alike once, and only a
    task's sums leave it. Detections of videos with more than ``small`` of them are not
    moved there; they go by :func:`grid`, as do videos with a place that is no number.
    """
    if not set(methods) <= {"density", "incremental"}:
        raise ValueError("unknown method")
    for distance, least in itertools.product(distances, least_seen):
        checked_arguments(distance, least)
    methods, ratios, matches, wide, levels = ([*dict.fromkeys(v)] for v in (methods, map(float, ratios), matches, map(float, distances), least_seen))
    hows = {how: k for k, how in enumerate(itertools.product(methods, wide, levels))}
    x, y = center(*(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")))
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(2**63)))
    seen = det.where("video_id is not null and frame_id is not null").select(
        "video_id", number("ord").alias("ord_"), number("frame_id").alias("frame_"), class_index(F.col("class_name")).cast("long").alias("kind_"), F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w_"), x.alias("x_"), y.alias("y_")
    )
    seen = seen.where("x_ is not null and y_ is not null").withColumn("apart_", F.count(F.lit(1)).over(Window.partitionBy("video_id")) > small)
    told = _told(pairs, "video_id").where("frame_ is not null and anchor_ is not null")
    told = told.select("video_id", "feature", "frame_", "anchor_", "ratio_", "matches_", F.col("h").isNotNull().cast("long").alias("there_"), *(F.coalesce(v, F.lit(float("nan"))).alias(f"h{k}_") for k, v in enumerate(entries("h"))))
    one = F.lit(1).cast("long").alias("n_")
    parts = [
        _packed(told, ["video_id", "feature"], told.columns[2:]), _places(frames, strategies, counts, "video_id", least_features).select("*", one),
        _packed(seen, ["video_id", "apart_"], seen.columns[1:-1], "apart_"), truth.select("video_id", *(F.col(t).cast("long").alias(t) for t in _TRUE), one),
    ]
    rows = parts[0].withColumn("part_", F.lit(0))
    for k, more in enumerate(parts[1:], 1):
        rows = rows.unionByName(more.withColumn("part_", F.lit(k)), allowMissingColumns=True)
    kinds = dict(rows.dtypes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, none, any_truth, sums = uuid.uuid4().hex, np.zeros((len(hows), 3), np.int64), False, {}
        both = lambda a, b: np.stack([a[:, 0] + b[:, 0], np.maximum(a[:, 1], b[:, 1]), a[:, 2] + b[:, 2]], axis=1)
        for table, group in groups.slices(batches, "video_id", ROWS_EACH, ROWS_EACH, weight="n_"):
            types = {c: table.schema.field(c).type for c in ("video_id", "feature")}
            part, n_groups = table["part_"].to_numpy(), int(group[-1]) + 1
            of_pairs, of_places, of_seen, of_truth = (table.filter(pa.array(part == k)) for k in range(4))
            apart = np.zeros(n_groups, bool)
            apart[group[part == 2][of_seen["packed_"].is_null().to_numpy()]] = True
            shown = _placed(of_pairs, group[part == 0], of_places, group[part == 1], of_seen, group[part == 2], strategies, counts, ratios, matches)
            owner, kind, weight, placed = shown
            for _, x, y, there in placed:
                apart[owner[there & ~(np.isfinite(x) & np.isfinite(y))]] = True
            same, found = _alike(n_groups, apart, owner, kind, weight, placed, hows, methods, wide, levels)
            if apart.any():
                yield _row_batch(types, video_id=table["video_id"].take(pa.array(np.flatnonzero(np.diff(group, prepend=-1))[apart])))
            of = group[part == 3]
            true = np.stack([of_truth[t].to_numpy() for t in _TRUE], axis=1).astype(np.int64)[~apart[of]]
            of, any_truth = of[~apart[of]], any_truth or bool((~apart[of]).any())

            def errors(p: np.ndarray) -> np.ndarray:
                error = np.abs(true - p)
                l1 = error.sum(axis=2)
                return np.stack([l1.sum(axis=1), error.max(axis=(1, 2), initial=0), (l1 == 0).sum(axis=1)], axis=1)

            nothing = errors(np.zeros((len(hows), len(of), CLASSES), np.int64))
            mine = {setting: errors(found[:, same[s][of]]) for s, (setting, *_) in enumerate(placed)}
            sums = {s: both(sums.get(s, none), mine.get(s, nothing)) for s in {*sums, *mine}}
            none = both(none, nothing)
        if any_truth:
            yield _row_batch(types, task=[task], l1=none[:1, 0], worst=none[:1, 1], exact=none[:1, 2])
        for (feature, *setting), (l1, worst, exact) in ((s, v.T) for s, v in sums.items()):
            named = {c: [v] * len(hows) for c, v in zip(("task", "feature", "strategy", "anchors", "ratio", "matches"), (task, feature, *setting))}
            yield _row_batch(types, **named, **dict(zip(("method", "distance", "least"), map(list, zip(*hows)))), l1=l1, worst=worst, exact=exact)

    side, how, measures = ["feature", "strategy", "anchors", "ratio", "matches"], ["method", "distance", "least"], ["l1", "worst", "exact"]
    schema = ", ".join(f"{c} {kinds.get(c) or t}" for c, t in _SUMS.items())
    found = cut(by_key(rows, "video_id").sortWithinPartitions("video_id").mapInArrow(fold, schema))
    large, found = found.where("video_id is not null").select("video_id"), found.where("task is not null")
    if not large.isEmpty():
        near = lambda df: df.join(large, "video_id", "left_semi")
        more = grid(near(det), sequences(near(pairs), near(frames), strategies, counts, ratios, matches, least_features=least_features), near(truth), side, ["skip"], methods, wide, levels).drop("policy")
        total, high = sum((F.col(t) for t in _TRUE[1:]), F.col(_TRUE[0])), F.greatest(*_TRUE)
        nothing = near(truth).agg(F.sum(total).alias("l1"), F.max(high).alias("worst"), F.count_if(total == 0).alias("exact")).where("l1 is not null")
        found = found.unionByName(more.unionByName(nothing, allowMissingColumns=True).withColumn("task", F.lit("large")), allowMissingColumns=True)
    own, nothing = found.where("method is not null"), found.where("method is null").select("task", *(F.col(c).alias(f"no_{c}") for c in measures))
    # a setting that a task has not met finds nothing in its videos
    every = nothing.crossJoin(F.broadcast(own.select(*side).distinct())).withColumn("how", _literals(method=methods, distance=wide, least=levels))  # the values of the lists
    every = every.select(*nothing.columns, *side, "how.*").join(own.select("task", *side, *how, *measures), ["task", *side, *how], "left")
    l1, worst, exact = (F.coalesce(c, f"no_{c}") for c in measures)
    return every.groupBy(*side, *how).agg(F.sum(l1).alias("l1"), F.max(worst).alias("worst"), F.sum(exact).alias("exact"))


#: What a task of :func:`grid_of_pairs` says: sums of a setting, sums of videos where nothing is found (without a method), or a video (without a task).
_SUMS = {
    "task": "string", "video_id": None, "feature": None, "strategy": "string", "anchors": "int", "ratio": "double", "matches": "int",
    "method": "string", "distance": "double", "least": "int", "l1": "long", "worst": "long", "exact": "long",
}


def _row_batch(types: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    """Rows of :data:`_SUMS`, columns that are not named being null."""
    plain = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    n, arrays = len(next(iter(columns.values()))), []
    for c, t in _SUMS.items():
        kind, values = types.get(c) or plain[t], columns.get(c)
        arrays.append(values.combine_chunks() if isinstance(values, pa.ChunkedArray) else pa.nulls(n, kind) if values is None else pa.array(values, kind))
    return pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], names=list(_SUMS))


def _packed(rows: DataFrame, keys: list[str], numbers: list[str], aside: str | None = None) -> DataFrame:
    """(keys, n_, packed_): rows of a batch with equal keys as one, their ``numbers`` (longs or doubles, none null) compressed; without them where ``aside`` says so."""
    kinds = dict(rows.dtypes)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pa.array(np.lexsort([batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys])))
            ends = np.append(np.flatnonzero(groups.changes(batch, keys)) + 1, batch.num_rows)
            starts = np.concatenate([[0], ends[:-1]])
            every = np.stack([batch.column(c).to_numpy().view(np.int64) for c in numbers])
            moved = np.ones(len(starts), bool) if aside is None else ~batch.column(aside).to_numpy(zero_copy_only=False)[starts]
            packed = [codec.compress(every[:, low:high].tobytes(), asbytes=True) if m else None for low, high, m in zip(starts.tolist(), ends.tolist(), moved.tolist())]
            counted = np.where(moved, ends - starts, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(starts)) for k in keys), pa.array(counted), pa.array(packed, pa.binary())], names=[*keys, "n_", "packed_"])

    return rows.mapInArrow(pack, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n_ long", "packed_ binary"]))


def _unpacked(table: pa.Table, numbers: int) -> tuple[np.ndarray, np.ndarray]:
    """The row of each of the rows that :func:`_packed` made one, and their numbers as longs, a column each."""
    codec, sizes = pa.Codec("zstd"), np.where(table["packed_"].is_null().to_numpy(), 0, table["n_"].to_numpy())
    parts = [np.frombuffer(codec.decompress(p, 8 * numbers * n), np.int64).reshape(numbers, n) for p, n in zip(table["packed_"].to_pylist(), sizes.tolist()) if p is not None]
    return np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.empty((numbers, 0), np.int64), *parts], axis=1)


def _placed(
    of_pairs: pa.Table, pair_owner: np.ndarray, of_places: pa.Table, place_owner: np.ndarray, of_seen: pa.Table, seen_owner: np.ndarray,
    strategies: list[str], counts: list[int], ratios: list[float], matches: list[int],
) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """Of the detections of many videos, in order, their video, class and weight; and for each setting that registers any of the videos their places (setting, x, y, there)."""
    features = pa.concat_arrays([c for t in (of_pairs, of_places) for c in t["feature"].chunks] or [pa.nulls(0, of_pairs.schema.field("feature").type)]).dictionary_encode(null_encoding="encode")
    names, codes = features.dictionary.to_pylist(), features.indices.to_numpy(zero_copy_only=False)
    pair_owner, place_owner = pair_owner * len(names) + codes[: len(pair_owner)], place_owner * len(names) + codes[len(pair_owner) :]
    row, told = _unpacked(of_pairs, 14)
    order = np.argsort(pair_owner[row], kind="stable")
    pair_group, told = pair_owner[row][order], told[:, order]
    frame, anchor, said, there = told[0], told[1], told[3], told[4] > 0
    ratio, h = told[2].view(np.float64), np.ascontiguousarray(told[5:].view(np.float64).T)
    row, seen = _unpacked(of_seen, 6)
    order = np.lexsort((seen[0], seen_owner[row]))
    owner, seen = seen_owner[row][order], seen[:, order]
    kind, (weight, cx, cy) = seen[2], seen[3:].view(np.float64)
    weight, kind = np.where(kind < 0, 0.0, weight), np.maximum(kind, 0)  # unknown names do not vote
    numbers, nth = np.unique(seen[1], return_inverse=True)
    wanted, at_wanted = np.unique(owner * len(numbers) + nth, return_inverse=True)
    chosen, root, strategy, anchors = (of_places[c].to_numpy() for c in ("anchor_", "root_", "strategy_", "anchors_"))
    placed = []
    for strategy_, count, least_ratio, least_matches, of, number, found, fits in _registered(pair_group, h, there, frame, anchor, ratio, said, place_owner, chosen, root, strategy, anchors, len(strategies), counts, ratios, matches):
        for k, feature in enumerate(names):
            mine = of % len(names) == k
            if not mine.any():
                continue
            some = np.flatnonzero(mine & fits)
            at = np.full(len(wanted), -1)
            if len(wanted):
                place = np.minimum(np.searchsorted(numbers, number[some]), len(numbers) - 1)
                code = of[some] // len(names) * len(numbers) + place
                where = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
                hit = (numbers[place] == number[some]) & (wanted[where] == code)
                at[where[hit]] = some[hit]
            at = at[at_wanted]
            t = np.where((at >= 0)[:, None], found[at], 0.0).T if len(found) else np.zeros((9, len(at)))
            depth = t[6] * cx + t[7] * cy + t[8]
            shown = (at >= 0) & ~(np.abs(depth) < 1e-8)
            depth = np.where(shown, depth, 1.0)
            x, y = (np.where(shown, (t[r] * cx + t[r + 1] * cy + t[r + 2]) / depth, 0.0) for r in (0, 3))
            placed.append(((feature, strategies[strategy_], count, least_ratio, least_matches), x, y, shown))
    return owner, kind, weight, placed


def _alike(
    n_groups: int, apart: np.ndarray, owner: np.ndarray, kind: np.ndarray, weight: np.ndarray, placed: list[tuple], hows: dict[tuple, int], methods: list[str], distances: list[float], leasts: list[int]
) -> tuple[np.ndarray, np.ndarray]:
    """For each setting and video the number of its set of places, one for all settings that place the video alike, -1 for none; and the clusters of each set by voted class under each way to cluster, none in the last row."""
    begins, sets = np.searchsorted(owner, np.arange(n_groups + 1)).tolist(), []
    same = np.full((len(placed), n_groups), -1)
    for g in np.flatnonzero(~apart).tolist():
        low, high, known = begins[g], begins[g + 1], {}
        for s, (_, x, y, there) in enumerate(placed):
            if there[low:high].any():
                name = (x[low:high].tobytes(), y[low:high].tobytes(), there[low:high].tobytes())
                if name not in known:
                    known[name] = len(sets)
                    sets.append((s, low + np.flatnonzero(there[low:high])))
                same[s, g] = known[name]
    found, at = np.zeros((len(hows), len(sets) + 1, CLASSES), np.int64), 0
    sizes = np.array([len(rows) for _, rows in sets], np.int64)
    while at < len(sets):
        many = max(1, int(np.searchsorted(np.cumsum(sizes[at:].astype(np.float64) ** 2), groups.PAIRS_EACH, side="right")))
        some = sets[at : at + many]
        rows, group = np.concatenate([r for _, r in some]), np.repeat(np.arange(len(some)), sizes[at : at + many])
        x, y = (np.concatenate([placed[s][c][r] for s, r in some]) for c in (1, 2))
        for *how, counted in _clustered(group, len(some), kind[rows], weight[rows], x, y, methods, distances, leasts):
            found[hows[tuple(how)], at : at + many] = counted
        at += many
    return same, found


def _tallied(points: DataFrame, methods: list[str], distances: list[float], leasts: list[int]) -> DataFrame:
    """(key, method, distance, least, p1 to p5): the clusters of each class by vote, of groups that fit into a task under every setting."""
    wide, levels = sorted({float(d) for d in distances}), sorted(set(leasts))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in groups.slices(batches, "key"):
            kind, weight, x, y = (table[c].to_numpy() for c in ("kind", "w", "x", "y"))
            weight, kind = np.where(kind < 0, 0.0, weight), np.maximum(kind, 0)  # unknown names do not vote
            first = np.flatnonzero(np.diff(group, prepend=-1))
            keys = table["key"].take(pa.array(first))
            for method, distance, least, found in _clustered(group, len(first), kind, weight, x, y, methods, wide, levels):
                rows = {"key": keys, "method": pa.array([method] * len(first)), "distance": np.full(len(first), distance), "least": np.full(len(first), least, np.int32)}
                yield from pa.table(rows | {f"p{k + 1}": found[:, k] for k in range(CLASSES)}).to_batches()

    rows = points.select("key", "ord", class_index(F.col("class_name")).alias("kind"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("w", "x", "y")))
    counts = ", ".join(f"p{k + 1} long" for k in range(CLASSES))
    return by_key(rows, "key").sortWithinPartitions("key", "ord").mapInArrow(fold, f"key {dict(points.dtypes)['key']}, method string, distance double, least int, {counts}")


def _clustered(group: np.ndarray, n_groups: int, kind: np.ndarray, weight: np.ndarray, x: np.ndarray, y: np.ndarray, methods: list[str], distances: list[float], leasts: list[int]) -> Iterator[tuple[str, float, int, np.ndarray]]:
    """(method, distance, least, clusters by group and voted class) under every setting, of points in order of their groups, none of which is without any."""
    n, first = len(kind), np.flatnonzero(np.diff(group, prepend=-1))
    for distance in distances:
        if "density" in methods:
            a, b = groups.pairs(group, x, y, distance)
            near = np.bincount(a, minlength=n)
            for least in leasts:
                yield "density", distance, least, _votes(group, n_groups, kind, weight, groups.components(n, a, b, least, near))
        if "incremental" in methods:
            own = first[group] + running_means_of_groups(group, x, y, distance)
            size = np.bincount(own, minlength=n)[own]
            for least in leasts:
                yield "incremental", distance, least, _votes(group, n_groups, kind, weight, np.where(size >= least, own, n))


def _votes(group: np.ndarray, n_groups: int, kind: np.ndarray, weight: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Clusters by group and voted class, as ``detector_vote``; a point's label is the number of a point of its group that names the cluster, or the number of all points for none."""
    n = len(kind)
    member = label < n
    votes = np.bincount(label[member] * CLASSES + kind[member], weight[member], n * CLASSES).reshape(n, CLASSES)
    votes = votes.round(9)  # equal weights stay equal in whatever order they were added
    voted = np.flatnonzero(votes.sum(axis=1) > 0)
    return np.bincount(group[voted] * CLASSES + votes[voted].argmax(axis=1), minlength=n_groups * CLASSES).reshape(n_groups, CLASSES)


def _counts(group: np.ndarray, n_groups: int, kind: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Clusters by group and voted class, of points in order with their pairs: as ``density_clusters`` and ``detector_vote``."""
    return _votes(group, n_groups, kind, weight, groups.components(len(kind), a, b, least))


_TRUE = [f"type{k}" for k in range(1, CLASSES + 1)]


def _sorted(det: DataFrame, truth: DataFrame) -> DataFrame:
    """Detections with their video's truth, the rows of a video one after another in one partition, in order."""
    kept = det.select("video_id", "ord", class_index(F.col("class_name")).alias("kind"), F.col("confidence").cast("double").alias("confidence"), *(F.col(f"r{c}").cast("double").alias(c) for c in ("x", "y")))
    for c in ("x", "y"):
        kept = kept.where(F.abs(c) < F.lit(float("inf")))  # what has no place is near nothing
    both = kept.join(truth.select("video_id", *_TRUE), "video_id")
    return by_key(both, "video_id").sortWithinPartitions("video_id", "ord")


def threshold_sweep(det: DataFrame, truth: DataFrame, kind: int, candidates: list[float], thresholds: dict[str, float], least: int = 4, distance: float = 40.0) -> DataFrame:
    """(candidate, every, own): for each candidate threshold of one class the sums of count errors over videos, of all classes and of this one.

    The detections (video_id, ord, class_name, confidence, and rx, ry in reference
    coordinates) that reach their class's threshold are clustered by density and
    classed by vote anew for every candidate; classes without a threshold are
    dropped. One job for all candidates; many videos are folded at a time, their pairs
    are found once, points that are not connected with any of the class are counted
    once, as are candidates between which no confidence lies. Only sums leave a task.
    """
    truth = cut(truth)
    return _swept(_sorted(det, truth), truth, kind, candidates, thresholds, least, distance)


def _swept(rows: DataFrame, truth: DataFrame, kind: int, candidates: list[float], thresholds: dict[str, float], least: int, distance: float) -> DataFrame:
    """:func:`threshold_sweep` of rows as :func:`_sorted` leaves them."""
    limits = {k: thresholds[f"type{k}"] for k in range(1, CLASSES + 1) if k != kind and f"type{k}" in thresholds} | {kind: min(candidates)}
    kept = rows.where(" or ".join(f"kind = {k - 1} and confidence >= {limit!r}D" for k, limit in limits.items()))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(candidates), 2), np.int64)
        for table, group in groups.slices(batches, "video_id"):
            kinds, said, x, y = (table[c].to_numpy() for c in ("kind", "confidence", "x", "y"))
            n_groups, at = int(group[-1]) + 1, np.flatnonzero(np.diff(group, prepend=-1))
            true = np.stack([table[c].to_numpy()[at] for c in _TRUE], axis=1)
            a, b = groups.pairs(group, x, y, distance)
            whole = groups.first_reached(len(x), a, b)
            moving = np.isin(whole, whole[kinds == kind - 1])
            held = ~moving

            def count(alive: np.ndarray) -> np.ndarray:
                place, both = np.cumsum(alive) - 1, alive[a] & alive[b]
                return _counts(group[alive], n_groups, kinds[alive], said[alive] ** 2, place[a[both]], place[b[both]], least)

            still = count(held)
            # only what can move is looked at again
            place, both = np.cumsum(moving) - 1, moving[a]
            a, b, group, kinds, said = place[a[both]], place[b[both]], group[moving], kinds[moving], said[moving]
            own, known = kinds == kind - 1, {}
            for k, candidate in enumerate(candidates):
                alive = ~own | (said >= candidate)
                size = int(alive.sum())
                if size not in known:
                    error = np.abs(true - still - count(alive)) - np.abs(true)
                    known[size] = int(error.sum()), int(error[:, kind - 1].sum())
                sums[k] += known[size]
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(candidates), dtype=np.int32), "every": sums[:, 0], "own": sums[:, 1]})

    # a video without detections has its truth for an error, so the tasks give what theirs change
    found = kept.mapInArrow(fold, "at int, every long, own long").groupBy("at").agg(F.sum("every").alias("more"), F.sum("own").alias("own_more"))
    total = truth.agg(F.sum(sum((F.col(t) for t in _TRUE[1:]), F.col(_TRUE[0]))).alias("all_true"), F.sum(f"type{kind}").alias("own_true")).where("all_true is not null")
    places = rows.sparkSession.range(len(candidates)).select(F.col("id").cast("int").alias("at")).crossJoin(F.broadcast(total))  # one row
    both = places.join(F.broadcast(found), "at", "left")  # a row a candidate
    named = F.element_at(F.array(*(F.lit(float(c)) for c in candidates)), F.col("at") + 1)
    return both.select(named.alias("candidate"), (F.col("all_true") + F.coalesce("more", F.lit(0))).alias("every"), (F.col("own_true") + F.coalesce("own_more", F.lit(0))).alias("own"))


def _errors(swept: DataFrame, candidates: list[float]) -> dict[float, tuple[int, int]]:
    found = {r["candidate"]: (r["every"], r["own"]) for r in swept.collect()}  # a row a candidate
    return {c: found.get(float(c), (0, 0)) for c in candidates}


def threshold_errors(det: DataFrame, truth: DataFrame, kind: int, candidates: list[float], thresholds: dict[str, float], least: int = 4, distance: float = 40.0) -> dict[float, tuple[int, int]]:
    """``threshold_sweep`` as a dictionary, for a search that goes on with it; candidates without any video have no error."""
    return _errors(threshold_sweep(det, truth, kind, candidates, thresholds, least, distance), candidates)


def errors_by_threshold(det: DataFrame, truth: DataFrame, kind: int, candidates: list[float], least: int = 4, distance: float = 40.0) -> dict[float, int]:
    """``threshold_errors`` of one class's detections alone."""
    return {c: own for c, (_, own) in threshold_errors(det, truth, kind, candidates, {}, least, distance).items()}


def descend(det: DataFrame, truth: DataFrame, start: dict[str, float] | None = None, step: float = 0.01, rounds: int = 3, least: int = 4, distance: float = 40.0) -> DataFrame:
    """(class_name, threshold, error): each class's threshold in turn moves to the best candidate if the error of all classes is strictly smaller; stops when a round changes nothing.

    The detections are sorted by video once; every step reads them where they lie.
    """
    now = dict(start or DENSITY_THRESHOLDS)
    truth = cut(truth)
    rows = cut(_sorted(det, truth))
    errors = lambda kind, some: _errors(_swept(rows, truth, kind, some, now, least, distance), some)
    candidates = [round(k * step, 6) for k in range(1, int(1 / step) + 1) if k * step < 1]
    for _ in range(rounds):
        changed = False
        for kind in range(1, CLASSES + 1):
            name = f"type{kind}"
            found = errors(kind, list(dict.fromkeys([now[name], *candidates])))
            best = min(candidates, key=lambda c: (found[c][0], c))
            if found[best][0] < found[now[name]][0]:
                now[name], changed = best, True
        if not changed:
            break
    error = {f"type{k}": errors(k, [now[f"type{k}"]])[now[f"type{k}"]][1] for k in range(1, CLASSES + 1)}
    return det.sparkSession.createDataFrame([(n, float(now[n]), int(error[n] or 0)) for n in sorted(now)], "class_name string, threshold double, error long")
