"""Many small groups at once: whole groups in slices of Arrow batches, and their density clusters by numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions.session import by_key

#: Sum of the squared sizes of the groups of one slice, unless a single one is larger: what bounds the pairs held.
PAIRS_EACH = 1 << 24


def changes(table: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Whether each row but the first differs from the one before it in any of the keys."""
    differs = np.zeros(max(0, table.num_rows - 1), bool)
    for key in keys:
        column = table.column(key) if isinstance(table, pa.RecordBatch) else table[key].combine_chunks()
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        differs |= codes[1:] != codes[:-1]
    return differs


def slices(batches: Iterator[pa.RecordBatch], key: str | list[str], rows: int = 0, most: int | None = None, aside: str | None = None, weight: str | None = None) -> Iterator[tuple[pa.Table, np.ndarray | None]]:
    """Slices of whole groups, and the number of each row's group within its slice, of batches whose rows of a group follow one another.

    Batches are gathered until they have ``rows`` rows. A slice ends before the squared
    sizes of its groups add up to more than ``PAIRS_EACH``, or, where no pairs are made
    of a group, before it has more than ``most`` rows. Rows whose groups the column
    ``aside`` marks are not gathered: they come as they are, without numbers. A row
    counts as many rows as the column ``weight`` says, if there is one.
    """
    keys = [key] if isinstance(key, str) else key
    held: list[pa.RecordBatch] = []
    size = lambda batch: batch.num_rows if weight is None else pc.sum(batch.column(weight), min_count=0).as_py()

    def told() -> Iterator[tuple[pa.Table, np.ndarray]]:
        table = pa.Table.from_batches(held)
        starts = np.flatnonzero(np.concatenate([[True], changes(table, keys)]))
        sizes = np.diff(np.append(starts, table.num_rows))
        costs = (sizes if weight is None else np.add.reduceat(table[weight].to_numpy(), starts)).astype(np.float64) ** (1 if most else 2)
        at = 0
        while at < len(starts):
            cost = np.cumsum(costs[at:])
            n = max(1, int(np.searchsorted(cost, most or PAIRS_EACH, side="right")))
            first, many = starts[at], int(sizes[at : at + n].sum())
            yield table.slice(first, many), np.repeat(np.arange(len(sizes[at : at + n])), sizes[at : at + n])
            at += n

    for batch in batches:
        if aside and batch.column(aside).true_count:
            yield pa.Table.from_batches([batch.filter(batch.column(aside))]), None
            batch = batch.filter(pc.invert(batch.column(aside)))
        if not batch.num_rows:
            continue
        # rows of the last group may go on in the next batch
        change = np.flatnonzero(changes(batch, keys))
        if held and any(held[-1].column(k)[held[-1].num_rows - 1] != batch.column(k)[0] for k in keys):
            change = np.concatenate([[-1], change])
        cut = int(change[-1]) + 1 if len(change) else None
        if cut is None or sum(map(size, held)) + size(batch.slice(0, cut)) < rows:
            held.append(batch)
            continue
        if cut:
            held.append(batch.slice(0, cut))
        if held:
            yield from told()
        held = [batch.slice(cut)]
    if held:
        yield from told()


#: Rows that :func:`folded` takes at a time.
ROWS_EACH = 1 << 16


def folded(df: DataFrame, keys: list[str], order: str, fold: Callable[[dict[str, list]], list[tuple]], more: dict[str, str]) -> DataFrame:
    """(keys, more): what ``fold`` makes of each group's columns, lists in ``order``; the columns ``more`` are longs or doubles.

    For many small groups: rows are sorted by key in one shuffle and whole groups are
    taken from Arrow batches, so a group costs its rows and no frame of its own.
    """
    kinds, arrow = dict(df.dtypes), {"long": pa.int64(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in slices(batches, keys, ROWS_EACH, ROWS_EACH):
            columns = {c: table[c].to_pylist() for c in table.column_names}
            starts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
            rows, at = [], []
            for low, high in zip(starts, [*starts[1:], table.num_rows]):
                found = fold({c: v[low:high] for c, v in columns.items()})
                rows += found
                at += [low] * len(found)
            told = {c: pa.array([r[n] for r in rows], arrow[t]) for n, (c, t) in enumerate(more.items())}
            yield from pa.table({k: table[k].take(pa.array(at, pa.int64())) for k in keys} | told).to_batches(max_chunksize=65536)

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{c} {t}" for c, t in more.items())])
    return by_key(df, *keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def _close_up(places: np.ndarray) -> np.ndarray:
    """Whole numbers with gaps of more than two narrowed to two: neighbours stay neighbours, others do not become any."""
    values, at = np.unique(places, return_inverse=True)
    return np.concatenate([[0], np.cumsum(np.minimum(np.diff(values), 2))]).astype(np.int64)[at]


def pairs(group: np.ndarray, x: np.ndarray, y: np.ndarray, distance: float) -> tuple[np.ndarray, np.ndarray]:
    """Both directions of all pairs of a group's points at most ``distance`` apart, each point with itself among them."""
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cx, cy = (_close_up(np.floor(v / distance)) for v in (x, y))
    wide, high = int(cx.max()) + 3, int(cy.max()) + 3
    cell = (group.astype(np.int64) * wide + cx + 1) * high + cy + 1
    order = np.argsort(cell, kind="stable")
    cells, starts, counts = np.unique(cell[order], return_index=True, return_counts=True)
    found = []
    for step in (0, 1, high - 1, high, high + 1):
        there = np.minimum(np.searchsorted(cells, cells + step), len(cells) - 1)
        own = np.flatnonzero(cells[there] == cells + step)
        other = there[own]
        # every point of a cell with every one of the other
        rows = np.repeat(np.arange(len(own)), counts[own])
        within = np.arange(len(rows)) - np.repeat(np.cumsum(counts[own]) - counts[own], counts[own])
        many = counts[other][rows]
        left = np.repeat(order[starts[own][rows] + within], many)
        nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        right = order[np.repeat(starts[other][rows], many) + nth]
        near = (x[left] - x[right]) * (x[left] - x[right]) + (y[left] - y[right]) * (y[left] - y[right]) <= distance * distance
        left, right = left[near], right[near]
        found.append((left, right))
        if step:
            found.append((right, left))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def first_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of ``n`` nodes is connected with, itself included, along edges of both directions."""
    label = np.arange(n)
    while len(a):
        lower = label.copy()
        np.minimum.at(lower, a, label[b])
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    return label


def components(n: int, a: np.ndarray, b: np.ndarray, least: int, near: np.ndarray | None = None) -> np.ndarray:
    """For each of ``n`` points with their pairs the first core of its density cluster, ``n`` for noise."""
    core = (np.bincount(a, minlength=n) if near is None else near) >= least
    a, b = a[core[b]], b[core[b]]  # from whatever lies around to cores
    inner = core[a]
    label = np.where(core, first_reached(n, a[inner], b[inner]), n)
    np.minimum.at(label, a[~inner], label[b[~inner]])
    return label
