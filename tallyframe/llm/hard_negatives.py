"""Hard negatives by inverted lists: rows of other labels that score nearly as high as an anchor's positives.

Vectors are quantised to whole numbers and scored by their inner product, so
scores are exact. Every row stands in the list of its nearest centroid; k-means
fits the centroids on a bounded sample, each list stores its radius, the largest
distance of a member to the centroid. By Cauchy-Schwarz no member of a list can
score outside ``anchor . centroid`` plus or minus ``|anchor| * radius``:

* an anchor visits lists in the order of their upper bounds, in two passes: the
  ``FIRST_LISTS`` best ones, then, the k-th best score known, the others down to
  where the bound falls strictly below that score. An equal bound is visited, as
  a tie may go to a smaller id;
* for negatives, lists whose two bounds lie wholly outside the windows of an
  anchor's positives are skipped, in both passes.

The result is exact whatever the centroids are: they decide only what is skipped.
Anchors go in blocks of at most ``ANCHOR_BLOCK``, crowded lists are dealt into
parts of about ``LIST_PART`` rows, and a task compares one block with one part, so
memory does not grow with the table, and neither one label nor one vector that
holds a third of the rows meets in one task. Only a part's best go on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .learning import fitted

#: Rows that k-means is fitted on at most, chosen by a hash of the id, and its centroids at most.
SAMPLE, MOST_CENTROIDS, ROUNDS = 8192, 256, 8
#: Rows to a centroid, as far as there may be more of them.
LIST_ROWS = 2048
#: Lists of the first pass.
FIRST_LISTS = 2
#: Anchors and rows that a task compares, about, and anchors at a time.
ANCHOR_BLOCK, LIST_PART, CHUNK = 4096, 8192, 256
#: Scores are counted in doubles as long as they cannot leave their whole numbers.
_EXACT = float(2**53)

_NONE = np.iinfo(np.int64).min


def quantised(rows: DataFrame, id_col: str, vector: str, label: str | Column, scale: int = 256) -> DataFrame:
    """(id, label, v) of the rows that take part, components as ``floor(scale * x)``.

    Rows with a null id, label or vector, or a component that is null or not finite,
    take no part. Components too large for an inner product of longs, beyond
    ``sqrt(2 ** 62 / length)`` or a 32-bit number, count as that large.
    """
    x = F.col(vector)
    most = F.least(F.floor(F.sqrt(F.lit(2.0**62) / F.greatest(F.size(x), F.lit(1)))), F.lit(2**31 - 1)).cast("long")
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), most), -most).cast("int"))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    named = F.col(label) if isinstance(label, str) else label
    return rows.where(x.isNotNull() & ~odd).select(F.col(id_col).cast("long").alias("id"), named.cast("string").alias("label"), whole.alias("v")).where("id is not null and label is not null")


def one_by_id(rows: DataFrame) -> DataFrame:
    """Of rows that repeat an id the one whose label, then vector, sorts first."""
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of whole numbers; shorter ones are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    at = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[at, place] = flat
    return out


def k_means(v: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows; a centroid that loses all rows keeps its place."""
    centres = v[np.linspace(0, len(v) - 1, k).astype(np.int64)].astype(np.float64)
    for _ in range(ROUNDS):
        own = _nearest(v, centres)[0]
        size = np.bincount(own, minlength=k)
        for d in range(v.shape[1]):
            total = np.bincount(own, weights=v[:, d], minlength=k)
            centres[:, d] = np.where(size > 0, total / np.maximum(size, 1), centres[:, d])
    return centres


def _nearest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid and its distance."""
    v = v.astype(np.float64)
    own = ((centres**2).sum(axis=1) - 2 * v @ centres.T).argmin(axis=1)
    return own, np.sqrt(((v - centres[own]) ** 2).sum(axis=1))


class Lists:
    """Centroids with the radius, the number of members and of parts of each one's list: bounded by ``MOST_CENTROIDS``."""

    def __init__(self, centres: np.ndarray, radius: np.ndarray, size: np.ndarray):
        self.centres, self.radius, self.size = centres, radius, size
        self.parts = np.maximum(1, -(-size // LIST_PART)).astype(np.int64)

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score that any member of each list can have with each anchor; empty lists have none."""
        a = anchors.astype(np.float64)
        length = np.sqrt((a**2).sum(axis=1))
        middle, reach = a @ self.centres.T, length[:, None] * self.radius
        # whatever rounding may have taken off
        slack = 1e-9 * (length[:, None] * (self.radius + np.sqrt((self.centres**2).sum(axis=1)))) + 1e-6
        empty = self.size == 0
        return np.where(empty, np.inf, middle - reach - slack), np.where(empty, -np.inf, middle + reach + slack)


def build(rows: DataFrame) -> tuple[DataFrame, Lists, int]:
    """The inverted lists of ``rows`` (id, label, v): rows with their list and part, the lists, and the vectors' length.

    The lists are written once; vectors shorter than the longest count as filled up
    with zeros.
    """
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    width, k = facts["width"] or 0, int(max(1, min(MOST_CENTROIDS, facts["n"] // LIST_ROWS)))
    sample = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    centres = fitted(sample.select("v"), lambda table: k_means(_matrix(table["v"], width), min(k, len(table))) if len(table) else np.zeros((1, width)))

    def placed(batches):
        for b in batches:
            own, away = _nearest(_matrix(b.column(2), width), centres)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(away)], names=["id", "label", "v", "list", "away"])

    lists = cut(rows.mapInArrow(placed, "id long, label string, v array<int>, list int, away double"))
    told = lists.groupBy("list").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # at most MOST_CENTROIDS rows
    radius, size = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in told:
        radius[r["list"]], size[r["list"]] = r["radius"] * (1 + 1e-12), r["n"]
    index = Lists(centres, radius, size)
    parts = F.array(*(F.lit(int(p)) for p in index.parts))
    return lists.select("id", "label", "v", "list", F.pmod(F.xxhash64("id"), F.element_at(parts, F.col("list") + 1)).cast("int").alias("part")), index, width


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of each row's ``k`` largest entries other than ``_NONE``, larger ones first, ties by column."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, col = np.nonzero((scores >= least[:, None]) & (scores != _NONE))
    else:
        row, col = np.nonzero(scores != _NONE)
    value = scores[row, col]
    order = np.lexsort((col, -value, row))
    row, col, value = row[order], col[order], value[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], col[nth < k], value[nth < k]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; through doubles where no sum can leave their whole numbers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < _EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _asked(anchors: DataFrame, index: Lists, width: int, low: int, high: int) -> DataFrame:
    """The anchors (id, label, v, scores) with ``seen``, the lists of their first pass, and ``windows``, those that could hold a result at all.

    Without ``scores`` an anchor looks for positives, which may stand in any list.
    Written once, so that both passes agree on what the first one visits.
    """

    def run(batches):
        for b in batches:
            least, most = index.bounds(_matrix(b.column(2), width))
            seen, within = [], []
            for k, scores in enumerate(b.column(3).to_pylist()):
                fine = np.isfinite(most[k])
                if scores is not None:
                    s = np.array([x for x in scores if x >= 0], np.float64)  # the window of a score below nought is empty
                    slack = 1e-9 * s + 1e-6
                    fine &= ((most[k][:, None] >= low * s / 100 - slack) & (least[k][:, None] <= high * s / 100 + slack)).any(axis=1)
                order = np.lexsort((np.arange(len(fine)), -most[k]))
                order = order[fine[order]]
                seen.append(order[:FIRST_LISTS])
                within.append(order[FIRST_LISTS:])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seen, pa.list_(pa.int32())), pa.array(within, pa.list_(pa.int32()))], names=["id", "label", "v", "scores", "seen", "windows"])

    return cut(anchors.select("id", "label", "v", "scores").mapInArrow(run, "id long, label string, v array<int>, scores array<long>, seen array<int>, windows array<int>"))


def _reaching(asked: DataFrame, index: Lists, width: int) -> DataFrame:
    """The anchors of :func:`_asked` with ``floors``, and as ``lists`` those left to visit: not seen, bound not strictly below the least floor."""

    def run(batches):
        for b in batches:
            most = index.bounds(_matrix(b.column(2), width))[1]
            left = []
            for k, (lists, floors) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist())):
                lists = np.array(lists, np.int64)
                left.append(lists[most[k][lists] >= min(floors, default=_NONE)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (0, 1, 2, 3, 5)), pa.array(left, pa.list_(pa.int32()))], names=["id", "label", "v", "scores", "floors", "lists"])

    return asked.select("id", "label", "v", "scores", "windows", "floors").mapInArrow(run, "id long, label string, v array<int>, scores array<long>, floors array<long>, lists array<int>")


def _pass(asked: DataFrame, lists: DataFrame, index: Lists, width: int, k: int, low: int, high: int, blocks: int) -> DataFrame:
    """(id, slot, other, score): the best ``k`` of each part of the anchors' ``lists``, for each of an anchor's positives by slot."""
    parts = F.array(*(F.lit(int(p)) for p in index.parts))
    asked = asked.select("id", "label", "v", "scores", "floors", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode("lists").alias("list"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.element_at(parts, F.col("list") + 1) - 1)))
    none = F.lit(None).cast("array<long>")
    there = lists.join(asked.select("block", "list", "part").distinct(), ["list", "part"])
    own = there.select("id", "label", "v", none.alias("scores"), none.alias("floors"), "block", "list", "part", F.lit(1).alias("side"))

    def compare(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        mine, base = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        found: list[tuple[np.ndarray, ...]] = []
        if mine.num_rows and base.num_rows:
            ids = base["id"].to_numpy()
            order = np.argsort(ids, kind="stable")  # columns in the order of ids, which decides ties
            ids, v = ids[order], _matrix(base["v"], width)[order]
            codes = np.unique(np.array([*base["label"].to_pylist(), *mine["label"].to_pylist()], object).astype(str), return_inverse=True)[1]
            kind, wanted = codes[: len(ids)][order], codes[len(ids) :]
            asking, a = mine["id"].to_numpy(), _matrix(mine["v"], width)
            scores, floors = mine["scores"].to_pylist(), mine["floors"].to_pylist()
            for at in range(0, len(asking), CHUNK):
                some = slice(at, at + CHUNK)
                product = _products(a[some], v)
                same = wanted[some][:, None] == kind
                for slot in range(max(1 if s is None else len(s) for s in scores[some])):
                    windows = [_window(s, slot, f, low, high) for s, f in zip(scores[some], floors[some])]
                    least, most = (np.array(side_, np.int64)[:, None] for side_ in zip(*windows))
                    fits = (product >= least) & (product <= most)
                    fits &= same & (asking[some][:, None] != ids) if scores[at] is None else ~same
                    row, col, value = _best(np.where(fits, product, _NONE), k)
                    found.append((asking[at + row], np.full(len(row), slot, np.int32), ids[col], value))
        cols = [np.concatenate([f[c] for f in found]) if found else np.empty(0, t) for c, t in enumerate((np.int64, np.int32, np.int64, np.int64))]
        return pa.table({"id": cols[0], "slot": cols[1], "other": cols[2], "score": cols[3]})

    return asked.withColumn("side", F.lit(0)).unionByName(own).groupBy("block", "list", "part").applyInArrow(compare, "id long, slot int, other long, score long")


def _window(scores: list[int] | None, slot: int, floors: list[int] | None, low: int, high: int) -> tuple[int, int]:
    """Least and largest score that counts: ``low * positive <= 100 * score <= high * positive``, and not below the k-th so far."""
    floor = floors[slot] if floors else _NONE + 1
    if scores is None:
        return floor, -(_NONE + 1)
    if slot >= len(scores):
        return 0, -1
    return max(floor, -(-low * scores[slot] // 100)), high * scores[slot] // 100


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("id", "slot").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _search(anchors: DataFrame, lists: DataFrame, index: Lists, width: int, k: int, low: int, high: int, blocks: int) -> DataFrame:
    """(id, slot, other, score, rank): both passes, the first one's k-th scores bounding the second."""
    asked = _asked(anchors, index, width, low, high)
    first = asked.select("*", F.col("seen").alias("lists"), F.lit(None).cast("array<long>").alias("floors"))
    start = cut(_ranked(_pass(first, lists, index, width, k, low, high, blocks), k))
    kth = start.where(F.col("rank") == k).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))  # an entry a positive
    slots = F.when(F.col("scores").isNull(), 1).otherwise(F.size("scores"))
    floors = F.transform(F.sequence(F.lit(0), slots - 1), lambda s: F.coalesce(F.element_at("kth", s), F.lit(_NONE + 1)))
    again = asked.join(kth, "id", "left").withColumn("floors", floors)
    rest = _pass(_reaching(again, index, width), lists, index, width, k, low, high, blocks)
    return _ranked(start.drop("rank").unionByName(rest), k)


def mine(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector: str = "embedding", label: str | Column = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exactly as a search through all rows.

    ``anchors`` is a condition on (id, label). An anchor's positives are its first
    ``positives`` other rows of the same label, by score, then smaller id; for each
    of them the first ``negatives`` rows of other labels follow whose score lies
    between ``low`` and ``high`` hundredths of the positive's, ranked from 1.

    Of rows that repeat an id one counts, see :func:`one_by_id`; which rows take no
    part, :func:`quantised` says. Anchors without a positive, and positives without
    a negative, give no rows; an empty table gives none. Other columns are ignored,
    whatever their names. At most all rows come back if there are fewer.
    """
    if not 0 <= low <= high:
        raise ValueError("the window must lie between two shares of the positive's score, the lower one first")
    lists, index, width = build(cut(one_by_id(quantised(rows, id_col, vector, label, scale))))
    queries = lists.where(anchors).select("id", "label", "v")
    blocks = max(1, -(-queries.count() // ANCHOR_BLOCK))
    near = _search(queries.withColumn("scores", F.lit(None).cast("array<long>")), lists, index, width, positives, low, high, blocks)
    order = F.array_sort(F.collect_list(F.struct("rank", "other", "score")))  # ``positives`` at most
    chosen = near.groupBy("id").agg(order.alias("p"))
    told = cut(queries.join(chosen, "id").select("id", "label", "v", F.col("p.score").alias("scores"), F.col("p.other").alias("others")))
    found = _search(told, lists, index, width, negatives, low, high, blocks)
    return found.join(told.select("id", "scores", "others"), "id").select(
        F.col("id").alias("anchor_id"),
        F.element_at("others", F.col("slot") + 1).alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("other").alias("negative_id"),
        F.element_at("scores", F.col("slot") + 1).alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
