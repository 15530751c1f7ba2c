"""Choosing frames: even sampling, gates over an ordered signal, filling and thinning."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import cut
from . import groups


def even_places(total: Column, count: int) -> Column:
    """Array of ``count`` whole numbers evenly from 0 to total - 1, truncated, each once, ascending.

    The step is one double, as in a linspace; the last place is total - 1 exactly.
    """
    step = (total - 1).cast("double") / F.lit(float(max(count - 1, 1)))
    inner = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.when(i == count - 1, total - 1).otherwise(F.floor(i.cast("double") * step)).cast("long"))
    return F.array_sort(F.array_distinct(inner if count > 1 else F.array(F.lit(0).cast("long"))))


def uniform(videos: DataFrame, key: str, total: str, count: int) -> DataFrame:
    return videos.where(F.col(total) > 0).select(key, F.explode(even_places(F.col(total), count)).alias("frame_id"))


def by_rate(videos: DataFrame, key: str, total: str, fps: float, target: float) -> DataFrame:
    """Every round(fps / target)-th frame and the last one."""
    step = max(1, round(fps / target))
    last = F.col(total) - 1
    return videos.where(F.col(total) > 0).select(key, F.explode(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long")), F.array(last)))).alias("frame_id"))


def rounded(videos: DataFrame, key: str, total: str, count: int) -> DataFrame:
    """Even places rounded half to even."""
    place = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.rint(i.cast("double") * (F.col(total) - 1) / F.lit(float(max(count - 1, 1)))).cast("long"))
    return videos.where(F.col(total) > 0).select(key, F.explode(F.array_distinct(place)).alias("frame_id"))


def fill_to(chosen: DataFrame, videos: DataFrame, key: str, total: str, least: int) -> DataFrame:
    """Adds frames at a fixed step, unseen ones in order, until a video has ``least`` of them."""
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col(total) / F.lit(least + 1)).cast("long"))
    have = chosen.groupBy(key).agg(F.count(F.lit(1)).alias("have"))
    short = videos.where(F.col(total) > 0).join(have, key, "left").withColumn("need", F.lit(least) - F.coalesce("have", F.lit(0))).where("need > 0")
    offered = short.select(key, "need", F.explode(F.sequence(F.lit(0).cast("long"), F.col(total) - 1, step)).alias("frame_id"))
    unseen = offered.join(chosen, [key, "frame_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy(key).orderBy("frame_id"))
    return chosen.select(key, "frame_id").unionByName(unseen.withColumn("place", place).where("place <= need").select(key, "frame_id"))


def thin_to(chosen: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` frames of a video, evenly by rank."""
    ranked = chosen.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("frame_id")) - 1)
    ranked = ranked.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(key)).cast("long"))
    picked = even_places(F.col("total"), most)
    return ranked.where((F.col("total") <= most) | F.array_contains(picked, F.col("place").cast("long"))).select(key, "frame_id")


def gate_step(state: tuple, frame: int, signal: float, least_gap: int, forced_gap: int, limit: float, cumulative: bool) -> tuple[tuple, bool]:
    """One step of a gate: state (last chosen frame or None, summed signal, chosen so far); a missing or infinite signal counts as none."""
    last, total, chosen = state
    signal = signal if signal is not None and math.isfinite(signal) else 0.0
    if last is None:
        return (frame, 0.0, 1), True
    total = total + signal if cumulative else signal
    gap = frame - last
    take = gap >= least_gap and (gap >= forced_gap or total >= limit)
    return ((frame, 0.0, chosen + 1), True) if take else ((last, total, chosen), False)


def gate(signal: DataFrame, key: str, limit: float, least_gap: int = 5, forced_gap: int = 15, most: int | None = 60, closing: bool = True, cumulative: bool = True) -> DataFrame:
    """Keyframes of an ordered signal (key, frame_id, signal).

    The first frame is taken. A later one is taken if the gap to the last taken is
    at least ``least_gap`` and either reaches ``forced_gap`` or the signal, summed
    since then (or this frame's alone), reaches ``limit``. At ``most`` it stops; the
    last frame follows if its gap is large enough. A fold in frame order, one
    video's signal at a time.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("frame_id")
        state, taken = (None, 0.0, 0), []
        for f, s in zip(frame["frame_id"].tolist(), frame["signal"].tolist()):
            if most is not None and state[2] >= most:
                break
            state, take = gate_step(state, f, s, least_gap, forced_gap, limit, cumulative)
            if take:
                taken.append(f)
        end = int(frame["frame_id"].iloc[-1])
        if closing and end - taken[-1] >= least_gap and (most is None or len(taken) < most):
            taken.append(end)
        return pd.DataFrame({key: frame[key].iloc[0], "frame_id": taken})

    kinds = dict(signal.dtypes)
    return signal.select(key, "frame_id", "signal").groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, frame_id {kinds['frame_id']}")


def _run(frames: list, signals: list, state: tuple, *rule) -> tuple[tuple, list]:
    """The state after the frames, and those that were taken."""
    taken = []
    for f, s in zip(frames, signals):
        state, take = gate_step(state, f, s, *rule)
        if take:
            taken.append(f)
    return state, taken


def gate_by_segments(
    signal: DataFrame, key: str, limit: float, least_gap: int = 5, forced_gap: int = 15, most: int | None = 60, closing: bool = True, cumulative: bool = True, each: int = 4096
) -> DataFrame:
    """The keyframes of :func:`gate`, with a video spread over as many tasks as it has segments of ``each`` frame numbers.

    What a segment must know of what lies before is the last frame taken: at most
    ``forced_gap`` places are possible, as one farther away takes the next frame
    whatever the signal is, and the signal summed since then follows from the frames
    between, which the segment is given too. So each segment is run once for each of
    these states, which gives a map from the state that enters to the state that
    leaves and the number of frames taken. A video's maps are followed from its first
    segment on, a few numbers a segment, and tell each segment the state that really
    enters; with it the segments are run again and give their frames.
    """
    if each < forced_gap or least_gap > forced_gap:
        raise ValueError("a segment must be as long as the forced gap, and that no shorter than the least one")
    rule = (least_gap, forced_gap, limit, cumulative)
    kinds = dict(signal.dtypes)
    own = F.floor(F.col("frame_id") / each).cast("long")
    rows = signal.select(key, F.col("frame_id").cast("long").alias("frame_id"), F.col("signal").cast("double").alias("signal"), own.alias("segment"))
    ahead = rows.where(F.pmod("frame_id", F.lit(each)) >= each - forced_gap).withColumn("segment", F.col("segment") + 1)
    pieces = rows.withColumn("before", F.lit(False)).unionByName(ahead.withColumn("before", F.lit(True)))

    def split(rows: dict[str, list]) -> tuple[list, list, list, list]:
        parts: tuple[list, list, list, list] = ([], [], [], [])
        for f, s, before in zip(rows["frame_id"], rows["signal"], rows["before"]):
            frames, values = parts[:2] if before else parts[2:]
            frames.append(f)
            values.append(s)
        return parts

    def entering(last: int | None, past: list, signals: list) -> tuple:
        """The state of a segment's start, from the last frame taken."""
        if last is None:
            return None, 0.0, 0
        total = 0.0
        for f, s in zip(past, signals):
            if f > last:
                total += s if s is not None and math.isfinite(s) else 0.0
        return last, total, 0

    def maps(rows: dict[str, list]) -> list[tuple]:
        past, signals, frames, values = split(rows)
        found = []
        for last in [None, frames[0] - forced_gap, *(f for f in past if frames[0] - f < forced_gap)] if frames else []:
            state, taken = _run(frames, values, entering(last, past, signals), *rule)
            found.append((frames[0], last, state[0], len(taken)))
        return found

    def follow(rows: dict[str, list]) -> list[tuple]:
        by_segment: dict[int, dict] = {}
        for segment, first, enters, leaves, taken in zip(*(rows[c] for c in ("segment", "first", "enters", "leaves", "taken"))):
            by_segment.setdefault(segment, {"first": first})[enters] = leaves, taken
        last, count, found = None, 0, []
        for segment, known in by_segment.items():
            state = None if last is None else last if known["first"] - last < forced_gap else known["first"] - forced_gap
            found.append((segment, state, count))
            last, taken = known[state]
            count += taken
        return found

    def again(rows: dict[str, list]) -> list[tuple]:
        past, signals, frames, values = split(rows)
        if not frames:
            return []
        taken = _run(frames, values, entering(rows["enters"][0], past, signals), *rule)[1]
        return [(f, rows["count"][0] + n) for n, f in enumerate(taken)]

    told = groups.folded(pieces, [key, "segment"], "frame_id", maps, {"first": "long", "enters": "long", "leaves": "long", "taken": "long"})
    states = groups.folded(told, [key], "segment", follow, {"segment": "long", "enters": "long", "count": "long"})
    known = pieces.join(cut(states), [key, "segment"])
    found = groups.folded(known, [key, "segment"], "frame_id", again, {"frame_id": "long", "nth": "long"}).withColumn("frame_id", F.col("frame_id").cast(kinds["frame_id"]))
    if most is not None:
        found = found.where(F.col("nth") < most)
    found = cut(found.select(key, "frame_id"))
    if not closing:
        return found
    ends = rows.groupBy(key).agg(F.max("frame_id").alias("end")).join(found.groupBy(key).agg(F.max("frame_id").alias("last"), F.count(F.lit(1)).alias("n")), key)
    late = ends.where(F.col("end") - F.col("last") >= least_gap)
    return found.unionByName((late if most is None else late.where(F.col("n") < most)).select(key, F.col("end").alias("frame_id")))


def invalid_runs(reg: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Runs of at least ``least`` consecutive invalid rows: first, last and length."""
    at = Window.partitionBy(key).orderBy("frame_id")
    placed = reg.select(key, "frame_id", "valid", F.row_number().over(at).alias("place"))
    island = F.col("place") - F.row_number().over(Window.partitionBy(key).orderBy("frame_id"))
    runs = placed.where(~F.col("valid")).withColumn("island", island)
    return runs.groupBy(key, "island").agg(F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= least).drop("island")
