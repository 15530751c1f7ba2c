"""Column expressions of video metadata, timing and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def middle_frame(total: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.floor(total / 2).cast("long"))


def frame_rate(fps: Column, default: float = 30.0) -> Column:
    return F.when(fps > 0, fps.cast("double")).otherwise(default)


def frame_count(total: Column, estimate: Column) -> Column:
    """The number of frames a file gives, or what a search for its end found, at least one."""
    return F.when(total > 0, total).otherwise(F.greatest(F.lit(1), F.coalesce(estimate, F.lit(1)))).cast("long")


def duration(total: Column, fps: Column) -> Column:
    return F.try_divide(total.cast("double"), fps.cast("double"))


def upright(width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    """Width and height after a rotation in degrees."""
    turned = F.pmod(rotation, F.lit(180)) == 90
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def shrunk(width: Column, height: Column, longest: int = 960) -> tuple[Column, Column, Column]:
    """Scale and size under a longest edge."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return scale, F.greatest(F.lit(1), F.rint(width * scale).cast("int")), F.greatest(F.lit(1), F.rint(height * scale).cast("int"))


def softmax(values: Column, temperature: float = 1.0) -> Column:
    """Softmax of an array, shifted by its largest entry."""
    top = F.array_max(values)
    raised = F.transform(values, lambda v: F.exp((v - top) / temperature))
    total = F.aggregate(raised, F.lit(0.0), lambda s, v: s + v)
    return F.transform(raised, lambda v: v / total)


def speedup(video_seconds: Column, run_seconds: Column) -> Column:
    return F.when(run_seconds > 0, video_seconds / run_seconds)


def speed_points(run_seconds: Column, allowed: Column, most: int = 3, each: float = 5.0) -> Column:
    """Full points on time; one less for every started further five seconds."""
    late = F.floor((run_seconds - allowed) / each).cast("int") + 1
    return F.when(run_seconds <= allowed, most).otherwise(F.greatest(F.lit(0), most - F.least(F.lit(most), late)))


def rounded_list(values: Column, digits: int = 3) -> Column:
    return F.transform(values, lambda v: F.bround(v, digits))


def parsed_list(text: Column, kind: str) -> Column:
    """Entries of a comma list as numbers; what is no number is left out."""
    return F.array_compact(F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast(kind)))
