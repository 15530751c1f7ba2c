"""Merging sightings: range join, density and incremental clustering, suppression."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.session import by_key, cut
from . import groups


def components(edges: DataFrame, key: str | list[str], most_rounds: int = 60) -> DataFrame:
    """(key, ord, component): smallest ord connected with each end of the edges (key, a, b), loops included."""
    keys = [key] if isinstance(key, str) else key
    edges = cut(edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = edges.groupBy(*keys, F.col("a").alias("ord")).agg(F.min("b").alias("component"))
    labels = cut(labels.withColumn("component", F.least("component", "ord")))
    for _ in range(most_rounds):
        near = edges.join(labels.withColumnRenamed("ord", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("ord")).agg(F.min("component").alias("near"))
        lower = labels.join(near, [*keys, "ord"]).select(*keys, "ord", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        jump = lower.select(*keys, F.col("ord").alias("component"), F.col("component").alias("root"))
        after = lower.join(jump, [*keys, "component"]).select(*keys, "ord", F.least("component", "root").alias("component"), "before")
        changed = Observation()
        labels = cut(after.observe(changed, F.count_if(F.col("component") != F.col("before")).alias("n"))).select(*keys, "ord", "component")
        if not changed.get["n"]:
            return labels
    raise RuntimeError("components did not settle")


def _around(cells: DataFrame, far: int = 2) -> DataFrame:
    """The cells with ``nx``, ``ny`` of every cell that can hold points within reach, themselves among them."""
    steps = [(i, j) for i in range(-far, far + 1) for j in range(-far, far + 1)]
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps))
    return cells.withColumn("s", F.explode(steps)).withColumn("nx", F.col("cx") + F.col("s.i")).withColumn("ny", F.col("cy") + F.col("s.j")).drop("s")


def _square(a: str, b: str, c: str, d: str) -> Column:
    return (F.col(a) - F.col(c)) * (F.col(a) - F.col(c)) + (F.col(b) - F.col(d)) * (F.col(b) - F.col(d))


#: Product of two crowds up to which their points are compared one by one, and the parts of a cell's side beyond that.
FEW_PAIRS, SUBCELLS = 4096, 16

_BOX = ("low_x", "high_x", "low_y", "high_y")


def _boxes() -> list[Column]:
    return [f(c).alias(f"{n}_{c}") for c in ("x", "y") for f, n in ((F.min, "low"), (F.max, "high"))]


def _reach() -> tuple[Column, Column]:
    """Squares of the least and the largest distance that points of two boxes, the second one named ``b_``, can have."""
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"b_low_{c}") - F.col(f"high_{c}"), F.col(f"low_{c}") - F.col(f"b_high_{c}"))
    span = lambda c: F.greatest(F.col(f"b_high_{c}") - F.col(f"low_{c}"), F.col(f"high_{c}") - F.col(f"b_low_{c}"))
    return gap("x") * gap("x") + gap("y") * gap("y"), span("x") * span("x") + span("y") * span("y")


def _cell_pairs(cells: DataFrame, at: list[str]) -> DataFrame:
    """(at, crowd, nx, ny, b_crowd, sure): every cell with each other one whose points can be within ``distance``; ``sure`` if all of them must be."""
    outer, far = at[:-2], F.col("distance") * F.col("distance")
    gap, span = _reach()
    there = cells.select(*outer, F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("crowd").alias("b_crowd"), *(F.col(c).alias(f"b_{c}") for c in _BOX))
    pairs = _around(cells).where("nx <> cx or ny <> cy").join(there, [*outer, "nx", "ny"]).where(gap <= far)
    return pairs.select(*at, "crowd", "nx", "ny", "b_crowd", (span <= far * (1 - 1e-9)).alias("sure"))


def _beyond(points: DataFrame, outer: list[str], **others: str) -> DataFrame:
    """The points as the other side of a pair of cells."""
    return points.select(*outer, F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("x").alias("ox"), F.col("y").alias("oy"), *(F.col(c).alias(n) for n, c in others.items()))


def _touching(pairs: DataFrame, points: DataFrame, at: list[str]) -> DataFrame:
    """(at, nx, ny): of pairs of crowded cells that their boxes leave open, those with a point each that are within ``distance``.

    The points of small crowds are compared. Of others the boxes of their sub-cells
    are, at most ``SUBCELLS`` squared a cell, of which one sure pair is enough; only
    points of sub-cells that leave a pair without such a witness open are compared, so
    no table of two whole crowds is made. ``points`` has (at, x, y, px, py).
    """
    outer, far = at[:-2], F.col("distance") * F.col("distance")
    gap, span = _reach()
    both = [*at, "nx", "ny"]
    few = F.col("crowd") * F.col("b_crowd") <= FEW_PAIRS
    close = _square("x", "y", "ox", "oy") <= far
    near = pairs.where(few).select(*both).join(points.select(*at, "x", "y"), at).join(_beyond(points, outer), [*outer, "nx", "ny"]).where(close).select(*both).distinct()
    large = pairs.where(~few).select(*both)
    ends = large.select(*at).unionByName(large.select(*outer, F.col("nx").alias("cx"), F.col("ny").alias("cy"))).distinct()
    parts = points.join(ends, at, "left_semi").groupBy(*at, "px", "py").agg(*_boxes())
    others = parts.select(*outer, F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("px").alias("qx"), F.col("py").alias("qy"), *(F.col(c).alias(f"b_{c}") for c in _BOX))
    open_ = large.join(parts, at).join(others, [*outer, "nx", "ny"]).where(gap <= far)
    open_ = open_.withColumn("sure", span <= far * (1 - 1e-9)).select(*both, "px", "py", "qx", "qy", "sure")
    seen = open_.where("sure").select(*both).distinct()
    rest = open_.join(seen, both, "left_anti").join(points, [*at, "px", "py"]).join(_beyond(points, outer, qx="px", qy="py"), [*outer, "nx", "ny", "qx", "qy"])
    return near.unionByName(seen).unionByName(rest.where(close).select(*both).distinct())


#: Points of a group up to which it is clustered within one task, together with others.
SMALL = 4096


def density_levels(points: DataFrame, key: str, distances: list[float], leasts: list[int], small: int = SMALL) -> DataFrame:
    """(key, distance, least, ord, component): density clusters of points (key, ord, x, y) under every distance and every least number.

    At a distance and a least number a point with at least so many points within the
    distance, itself among them, is a core; connected cores are a cluster, named by
    its first core; another point joins the first cluster within reach, noise has no
    row. Settings are rows, so there are as many jobs for a hundred of them as for one.

    Groups of up to ``small`` points are sorted by key, one shuffle, and clustered many
    at a time (:func:`small_levels`); larger ones are spread over tasks by their cells
    (:func:`levels_by_cells`), with the same result.
    """
    usual, large = split_by_size(cut(points.select(key, "ord", "x", "y")), key, small)
    found = small_levels(usual, key, distances, leasts)
    return found if large is None else found.unionByName(levels_by_cells(large, key, distances, leasts))


def split_by_size(points: DataFrame, key: str, small: int = SMALL) -> tuple[DataFrame, DataFrame | None]:
    """The points, computed already, of groups that fit into a task, and those of larger groups or of groups with a place that is no number; none if there are no such."""
    finite = [F.abs(c) < F.lit(float("inf")) for c in ("x", "y")]  # NaN is above all numbers
    sizes = points.groupBy(key).agg(F.count(F.lit(1)).alias("n_"), F.min(F.coalesce(finite[0] & finite[1], F.lit(False))).alias("fine_"))
    large = cut(sizes.where((F.col("n_") > small) | ~F.col("fine_") | F.col(key).isNull()).select(key))
    if large.isEmpty():
        return points, None
    return points.join(large, key, "left_anti").where(F.col(key).isNotNull()), points.join(large, key, "left_semi")


def small_levels(points: DataFrame, key: str, distances: list[float], leasts: list[int]) -> DataFrame:
    """:func:`density_levels` of groups that fit into a task: rows sorted by key, taken in slices of whole groups."""
    wide, levels = sorted({float(d) for d in distances}), sorted(set(leasts))
    kinds = dict(points.dtypes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in groups.slices(batches, key):
            x, y = (table[c].to_numpy() for c in ("x", "y"))
            for distance in wide:
                a, b = groups.pairs(group, x, y, distance)
                near = np.bincount(a, minlength=len(x))
                for least in levels:
                    found = groups.components(len(x), a, b, least, near)
                    at = np.flatnonzero(found < len(x))
                    keys, ords = table[key].take(pa.array(at)), table["ord"].take(pa.array(at))
                    first = table["ord"].take(pa.array(found[at]))
                    rows = pa.table({key: keys, "distance": np.full(len(at), distance), "least": np.full(len(at), least, np.int32), "ord": ords, "component": first})
                    yield from rows.to_batches(max_chunksize=65536)

    placed = by_key(points.select(key, "ord", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), key).sortWithinPartitions(key, "ord")
    return placed.mapInArrow(fold, f"{key} {kinds[key]}, distance double, least int, ord {kinds['ord']}, component {kinds['ord']}")


def levels_by_cells(points: DataFrame, key: str, distances: list[float], leasts: list[int]) -> DataFrame:
    """:func:`density_levels` of groups of any size; what settings have in common is found once:

    * points are gathered in square cells whose diagonal is the distance, so points of
      a cell are within reach of one another; which cells are within reach, in part or
      as a whole, is told by the boxes of their points;
    * one table counts the neighbours of the points of sparse cells; in a cell of as
      many points as the largest least number all are cores at every one. Each least
      number is a filter on these counts;
    * two cells are linked as strongly as their best link, the smaller count of two
      points within reach of one another: the clusters of a least number are the
      components of the links that strong, whose nodes are cells and not points;
    * points that are no cores take what they reach from the same pairs of cells.

    Points are compared only where two boxes leave it open, which goes with the crowd
    of a sparse cell, below the largest least number, times its neighbour's; how two
    crowded cells are compared, :func:`_touching` says.
    """
    most, levels = max(leasts), sorted(set(leasts))
    side = F.col("distance") / 2**0.5 * (1 - 1e-12)
    outer, at = [key, "distance"], [key, "distance", "cx", "cy"]
    close = _square("x", "y", "ox", "oy") <= F.col("distance") * F.col("distance")
    spread = cut(points.select(key, "ord", "x", "y")).select("*", F.explode(F.array(*(F.lit(float(d)) for d in sorted(set(distances))))).alias("distance"))
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    part = lambda c, of: F.floor((F.col(c) / side - F.col(of)) * SUBCELLS).cast("int")
    placed = spread.select(*outer, "ord", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    cells = cut(placed.groupBy(*at).agg(F.count(F.lit(1)).alias("crowd"), *_boxes()))
    pairs = cut(_cell_pairs(cells, at))
    thin = pairs.where(F.col("crowd") < most)
    counted = placed.join(cells.select(*at, "crowd"), at)
    whole = thin.where("sure").groupBy(*at).agg(F.sum("b_crowd").alias("whole"))
    some = thin.where("not sure").select(*at, "nx", "ny").join(placed, at).join(_beyond(placed, outer), [*outer, "nx", "ny"]).where(close)
    some = some.groupBy(*outer, "ord").agg(F.count(F.lit(1)).alias("some"))
    near = F.col("crowd") + F.coalesce("whole", F.lit(0)) + F.coalesce("some", F.lit(0))
    marked = counted.join(whole, at, "left").join(some, [*outer, "ord"], "left")
    marked = cut(marked.select(*outer, "ord", "x", "y", "cx", "cy", "crowd", F.least(near, F.lit(most)).cast("int").alias("near")))

    # of each cell: the strongest core, and the first core at each level
    firsts = F.array(*(F.min(F.when(F.col("near") >= m, F.col("ord"))) for m in levels))
    cores = cut(marked.where(F.col("near") >= levels[0]).groupBy(*at).agg(F.max("near").alias("near"), firsts.alias("firsts")))
    there = cores.select(*outer, F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("near").alias("there"), F.col("firsts").alias("others"))
    sure = pairs.where("sure").select(*at, "nx", "ny").join(there.drop("others"), [*outer, "nx", "ny"])
    inner = marked.where(F.col("crowd") < most).select(*outer, "ord", "x", "y", "cx", "cy", "near")
    beyond = _beyond(marked.where(F.col("near") >= levels[0]), outer, there="near")
    seen = thin.where("not sure").select(*at, "nx", "ny").join(inner, at).join(beyond, [*outer, "nx", "ny"]).where(close)
    seen = cut(seen.groupBy(*at, "nx", "ny", "ord", "near").agg(F.max("there").alias("there")))  # what each point reaches of each cell
    links = sure.join(cores.select(*at, "near"), at).select(*at, "nx", "ny", F.least("near", "there").alias("strength"))
    links = links.unionByName(seen.groupBy(*at, "nx", "ny").agg(F.max(F.least("near", "there")).alias("strength")).where(F.col("strength") >= levels[0]))
    crowded = placed.join(cells.where(F.col("crowd") >= most).select(*at), at, "left_semi").select(*at, "x", "y", part("x", "cx").alias("px"), part("y", "cy").alias("py"))
    open_ = pairs.where(~F.col("sure") & (F.col("crowd") >= most) & (F.col("b_crowd") >= most) & ((F.col("nx") > F.col("cx")) | ((F.col("nx") == F.col("cx")) & (F.col("ny") > F.col("cy")))))
    links = links.unionByName(_touching(open_, crowded, at).withColumn("strength", F.lit(most)))

    level = F.posexplode(F.array(*map(F.lit, levels))).alias("place", "least")
    first = lambda c: F.element_at(c, F.col("place") + 1)
    ends = links.join(cores.select(*at, "firsts"), at).join(there.drop("there"), [*outer, "nx", "ny"])
    edges = ends.select(*outer, "strength", "firsts", "others", level).where("strength >= least").select(*outer, "least", first("firsts").alias("a"), first("others").alias("b"))
    nodes = cores.select(*at, "near", "firsts", level).where("near >= least").select(*at, "least", first("firsts").alias("ord"))
    found = components(edges, [*outer, "least"])
    names = nodes.join(found, [*outer, "least", "ord"], "left").select(*at, "least", F.coalesce("component", "ord").alias("component"))
    names = cut(names)
    own = marked.join(names, at).where("near >= least").select(*outer, "least", "ord", "component")
    # whatever a point that is no core reaches: its own cell, cells as a whole, cells in part
    apart = marked.where(F.col("near") < levels[-1])
    around = apart.join(sure.select(*at, "nx", "ny", "there"), at).unionByName(apart.join(cores.select(*at, F.col("near").alias("there")), at).withColumn("nx", F.col("cx")).withColumn("ny", F.col("cy")))
    around = around.select(*outer, "ord", "near", "nx", "ny", "there").unionByName(seen.where(F.col("near") < levels[-1]).select(*outer, "ord", "near", "nx", "ny", "there"))
    border = around.join(names.withColumnsRenamed({"cx": "nx", "cy": "ny"}), [*outer, "nx", "ny"]).where("near < least and there >= least")
    return own.unionByName(border.groupBy(*outer, "least", "ord").agg(F.min("component").alias("component")))


def density_members(rows: DataFrame, key: str, eps: float, least: int, small: int = SMALL) -> DataFrame:
    """The rows (key, ord, x, y and more) that lie in a density cluster, with their ``cluster_id``: numbers by key from 0, in order of the first core.

    Rows keep their columns, so none is joined back: they are sorted by key in one
    shuffle, none if they lie so already, and groups of up to ``small`` rows are clustered
    many at a time as :func:`small_levels` does. Rows of larger groups, or of groups with
    a place that is no number, go through as they are and are clustered by
    :func:`levels_by_cells`, with the same result. What is found is computed once, into
    the checkpoint folder.
    """
    columns, distance = rows.columns, float(eps)
    whole = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    finite = [F.abs(c) < F.lit(float("inf")) for c in ("x", "y")]  # NaN is above all numbers
    apart = (F.count(F.lit(1)).over(whole) > small) | ~F.min(F.coalesce(finite[0] & finite[1], F.lit(False))).over(whole)
    placed = by_key(rows.where(F.col(key).isNotNull()), key).withColumn("apart_", apart).sortWithinPartitions(key, "ord")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in groups.slices(batches, key, aside="apart_"):
            if group is None:
                yield from table.append_column("cluster_id", pa.nulls(table.num_rows, pa.int64())).to_batches()
                continue
            x, y = (table[c].cast(pa.float64()).to_numpy() for c in ("x", "y"))
            found = groups.components(len(x), *groups.pairs(group, x, y, distance), least)
            at = np.flatnonzero(found < len(x))
            names, number = np.unique(found[at], return_inverse=True)
            number -= np.searchsorted(names, np.flatnonzero(np.diff(group, prepend=-1)))[group[at]]
            yield from table.take(pa.array(at)).append_column("cluster_id", pa.array(number, pa.int64())).to_batches(max_chunksize=65536)

    kinds = T.StructType([*(T.StructField(f.name, f.dataType) for f in placed.schema), T.StructField("cluster_id", T.LongType())])
    seen = Observation()
    found = cut(placed.mapInArrow(fold, kinds).observe(seen, F.count_if("apart_").alias("n")))
    near = found.where(~F.col("apart_")).select(*columns, "cluster_id")
    if not seen.get["n"]:
        return near
    far = found.where("apart_").select(*columns)
    levels = levels_by_cells(far, key, [distance], [least]).select(key, "ord", (F.dense_rank().over(Window.partitionBy(key).orderBy("component")) - 1).cast("long").alias("cluster_id"))
    return near.unionByName(far.join(levels, [key, "ord"]).select(*columns, "cluster_id"))


def density_clusters(points: DataFrame, key: str, eps: float, least: int) -> DataFrame:
    """(key, ord, cluster_id) of points (key, ord, x, y) by :func:`density_members`; clusters are numbered from 0 by their first core."""
    return density_members(points.select(key, "ord", "x", "y"), key, eps, least).select(key, "ord", "cluster_id")


def running_means(x: np.ndarray, y: np.ndarray, distance: float, sums: list[list[float]] | None = None) -> np.ndarray:
    """The cluster of each point, in order: the nearest running mean at most ``distance`` away, the earliest of several, or a new one.

    Means are kept in square cells of that side and change their cell as they move, so
    a point looks at the means of nine cells, however many clusters there are. ``sums``
    are those of x, of y and the number of points of clusters to start with, and are
    brought up to date. A point without a finite place is a cluster of its own.
    """
    sums = [] if sums is None else sums
    cells: dict[tuple[int, int], set[int]] = {}
    found = np.empty(len(x), np.int64)
    cell = lambda u, v: (math.floor(u / distance), math.floor(v / distance))
    for c, (sx, sy, n) in enumerate(sums):
        if math.isfinite(sx) and math.isfinite(sy):
            cells.setdefault(cell(sx / n, sy / n), set()).add(c)
    for k, (u, v) in enumerate(zip(x.tolist(), y.tolist())):
        if not (math.isfinite(u) and math.isfinite(v)):
            found[k] = len(sums)
            sums.append([u, v, 1])
            continue
        cx, cy = cell(u, v)
        best, near = -1, math.inf
        for at in ((cx + i, cy + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            for c in cells.get(at, ()):
                sx, sy, n = sums[c]
                away = math.sqrt((u - sx / n) ** 2 + (v - sy / n) ** 2)
                if away <= distance and (away, c) < (near, best):
                    best, near = c, away
        if best < 0:
            best, before = len(sums), None
            sums.append([0.0, 0.0, 0])
        else:
            sx, sy, n = sums[best]
            before = cell(sx / n, sy / n)
        own = sums[best]
        own[0], own[1], own[2] = own[0] + u, own[1] + v, own[2] + 1
        after = cell(own[0] / own[2], own[1] / own[2])
        if after != before:
            if before is not None:
                cells[before].discard(best)
            cells.setdefault(after, set()).add(best)
        found[k] = best
    return found


def running_means_of_groups(group: np.ndarray, x: np.ndarray, y: np.ndarray, distance: float, small: int = SMALL, held: list[np.ndarray] | None = None) -> np.ndarray:
    """:func:`running_means` of each of many groups, their numbers ascending: the next point of all groups of up to ``small`` points is placed at once.

    ``held`` has for each group the clusters it starts with, a row each for the sums of
    x, of y and the number of points, and is brought up to date; its clusters count as points.
    """
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(np.append(starts, len(group)))
    had = np.array([h.shape[1] for h in held], np.int64) if held else np.zeros(len(starts), np.int64)
    found = np.empty(len(group), np.int64)
    for g in np.flatnonzero(sizes + had > small).tolist():
        low, size, sums = starts[g], sizes[g], held[g].T.tolist() if held else []
        found[low : low + size] = running_means(x[low : low + size], y[low : low + size], distance, sums)
        if held:
            held[g] = np.array(sums).T
    order = np.argsort(-sizes, kind="stable")
    order = order[(sizes + had)[order] <= small]  # groups that have a point left come first
    starts, left, clusters = starts[order], -sizes[order], had[order]
    wide = max(8, int(clusters.max(initial=0)))
    sums, means, n = np.zeros((2, len(order), wide)), np.full((2, len(order), wide), np.inf), np.zeros((len(order), wide))
    for row, g in enumerate(order.tolist() if held else []):
        sums[:, row, : had[g]], n[row, : had[g]] = held[g][:2], held[g][2]
    np.divide(sums, n, out=means, where=n > 0)
    for k in range(-int(left[0]) if len(left) else 0):
        active = int(np.searchsorted(left, -k, side="left"))
        rows, at = np.arange(active), starts[:active] + k
        u, v = x[at], y[at]
        many = max(1, int(clusters[:active].max()))
        with np.errstate(invalid="ignore"):
            du, dv = u[:, None] - means[0, :active, :many], v[:, None] - means[1, :active, :many]
        away = np.sqrt(du * du + dv * dv)
        away[np.isnan(away)] = np.inf  # of a place that is not finite
        best = away.argmin(axis=1)
        own = np.where(away[rows, best] <= distance, best, clusters[:active])
        new = own == clusters[:active]
        clusters[:active] += new
        if own.max() >= n.shape[1]:
            wider = ((0, 0), (0, n.shape[1]))
            n, sums, means = np.pad(n, wider), np.pad(sums, ((0, 0), *wider)), np.pad(means, ((0, 0), *wider), constant_values=np.inf)
        n[rows, own] += 1
        for c, value in enumerate((u, v)):
            sums[c, rows, own] += value
            means[c, rows, own] = sums[c, rows, own] / n[rows, own]
        found[at] = own
    for row, g in enumerate(order.tolist() if held else []):
        held[g] = np.concatenate([sums[:, row, : clusters[row]], n[None, row, : clusters[row]]])
    return found


def incremental_levels(points: DataFrame, key: str, distances: list[float]) -> DataFrame:
    """(key, distance, ord, cluster_id, size): :func:`running_means` of points (key, ord, x, y), in the order of ``ord``, at every distance.

    Videos are sorted into tasks once and many are folded at a time, at all distances;
    a video is one group, as its order is the operation. Every least number of sightings
    is a filter on ``size``.
    """
    kinds, wide = dict(points.dtypes), sorted({float(d) for d in distances})

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in groups.slices(batches, key):
            x, y = (table[c].to_numpy() for c in ("x", "y"))
            first = np.flatnonzero(np.diff(group, prepend=-1))[group]
            for distance in wide:
                found = running_means_of_groups(group, x, y, distance)
                size = np.bincount(first + found)[first + found]
                rows = pa.table({key: table[key], "distance": np.full(len(x), distance), "ord": table["ord"], "cluster_id": found, "size": size})
                yield from rows.to_batches(max_chunksize=65536)

    placed = by_key(points.select(key, "ord", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), key).sortWithinPartitions(key, "ord")
    return placed.mapInArrow(fold, f"{key} {kinds[key]}, distance double, ord {kinds['ord']}, cluster_id long, size long")


def incremental_clusters(points: DataFrame, key: str, distance: float, least: int = 1) -> DataFrame:
    """(key, ord, cluster_id): :func:`incremental_levels` at one distance; clusters under ``least`` points are dropped and leave gaps in the numbers."""
    return incremental_levels(points, key, [distance]).where(F.col("size") >= least).select(key, "ord", "cluster_id")


def _overlap(a, b) -> Column:
    """Intersection over union of two boxes of whole pixels, corners included."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]) + 1)
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]) + 1)
    size = lambda x: (x["x2"] - x["x1"] + 1) * (x["y2"] - x["y1"] + 1)
    return w * h / (size(a) + size(b) - w * h)


#: Boxes of a group from which it is suppressed in rounds and not by a fold over its array.
CROWD = 2000


def suppress(boxes: DataFrame, keys: list[str], limit: float, crowd: int = CROWD, corners: bool = False) -> DataFrame:
    """Greedy suppression within each group of ``keys``: the highest score stays and removes what overlaps by more than ``limit``.

    Boxes need ord, score, x1, y1, x2, y2; of equal scores the later ord goes first.
    Groups of up to ``crowd`` boxes are folded many at a time within a task; the groups
    beyond that go by :func:`suppress_in_rounds`, with the same result: (keys,
    ord, score), and the ``corners`` if they are wanted.
    """
    named = [*keys, "ord", "score", *(("x1", "y1", "x2", "y2") if corners else ())]
    sizes = boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"))
    large = cut(sizes.where(F.col("n_") > crowd).select(*keys))
    if large.isEmpty():
        return _folded(boxes, keys, limit).select(*named)
    some = boxes.join(large, keys, "left_semi")
    return _folded(boxes.join(large, keys, "left_anti"), keys, limit).unionByName(suppress_in_rounds(some, keys, limit)).select(*named)


#: Boxes that a task suppresses at a time.
BOXES_EACH = 1 << 17


def _folded(boxes: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """Groups sorted in one shuffle, many suppressed at a time: in each step the best box left of every group stays and removes what it covers of its own."""
    corners, kinds = ("x1", "y1", "x2", "y2"), dict(boxes.dtypes)
    known = F.lit(True)
    for c in corners:
        known = known & F.col(c).isNotNull()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in groups.slices(batches, keys, BOXES_EACH, BOXES_EACH):
            whole, box = table["known_"].to_numpy(), {c: table[c].to_numpy() for c in corners}
            left, kept = np.arange(len(group)), []
            while len(left):
                first = np.diff(group[left], prepend=-1) != 0
                top, other = left[first], left[~first]
                kept.append(top)
                best = top[np.cumsum(first)[~first] - 1]
                here, there = ({c: v[at] for c, v in box.items()} for at in (best, other))
                with np.errstate(all="ignore"):
                    w = np.maximum(0.0, np.minimum(here["x2"], there["x2"]) - np.maximum(here["x1"], there["x1"]) + 1)
                    h = np.maximum(0.0, np.minimum(here["y2"], there["y2"]) - np.maximum(here["y1"], there["y1"]) + 1)
                    size = [(x["x2"] - x["x1"] + 1) * (x["y2"] - x["y1"] + 1) for x in (here, there)]
                    covered = w * h / (size[0] + size[1] - w * h) > limit
                left = other[~(covered & whole[best] & whole[other])]
            yield from table.drop_columns(["known_"]).take(pa.array(np.sort(np.concatenate(kept)))).to_batches(max_chunksize=65536)

    placed = by_key(boxes.select(*keys, "ord", "score", *(F.col(c).cast("double").alias(c) for c in corners), known.alias("known_")), *keys)
    placed = placed.sortWithinPartitions(*keys, F.desc("score"), F.desc("ord"))
    return placed.mapInArrow(fold, ", ".join([*(f"{c} {kinds[c]}" for c in (*keys, "ord", "score")), *(f"{c} double" for c in corners)]))


def suppress_in_rounds(boxes: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """Suppression of crowded groups over a grid, without an array or a table of all pairs a group.

    Cells are as wide as the group's largest box, so whatever overlaps a box lies in
    the nine cells around its centre. In each round a box that outscores all boxes of
    these cells stays, and it takes those it covers along; the rest goes on. Only the
    best box of a cell and those that stay are joined with others.
    """
    side = boxes.groupBy(*keys).agg((F.max(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))) + 2).cast("double").alias("side"))
    cell = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / F.col("side")).cast("long")
    corners = ("x1", "y1", "x2", "y2")
    left = boxes.join(side, keys).select(*keys, "ord", "score", *(F.col(c).cast("double").alias(c) for c in corners), cell("x1", "x2").alias("cx"), cell("y1", "y2").alias("cy"))
    left, kept = cut(left), None
    at = [*keys, "cx", "cy"]
    while not left.isEmpty():
        tops = _around(left.groupBy(*at).agg(F.max(F.struct("score", "ord")).alias("top")), 1)
        best = tops.groupBy(*keys, F.col("nx").alias("cx"), F.col("ny").alias("cy")).agg(F.max("top").alias("top"))
        stay = cut(left.join(best, at).where(F.struct("score", "ord") == F.col("top")).drop("top"))
        own = _around(stay.select(*at, F.struct(*corners).alias("own")), 1).select(*keys, F.col("nx").alias("cx"), F.col("ny").alias("cy"), "own")
        other = {c: F.col(c) for c in corners}
        covered = left.join(own, at).where(_overlap(F.col("own"), other) > limit).select(*keys, "ord").distinct()
        gone = covered.unionByName(stay.select(*keys, "ord")).distinct()
        left = cut(left.join(gone, [*keys, "ord"], "left_anti"))
        kept = stay if kept is None else kept.unionByName(stay)
    return (left if kept is None else kept).select(*keys, "ord", "score", *corners)
