"""Column expressions over class names, labels and frame names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(name: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]", "")


def class_index(name: Column) -> Column:
    """0 to 4 for type1 to type5 however written, else -1."""
    found = F.regexp_extract(normalised(name), r"^type([1-5])$", 1)
    return F.when(found != "", found.try_cast("int") - 1).otherwise(F.lit(-1))


def label(index: Column) -> Column:
    return F.when(index < 0, F.lit("Unknown")).otherwise(F.concat(F.lit("Type_"), (index + 1).cast("string")))


def natural_order(name: Column) -> tuple[Column, Column]:
    """Sort keys: the number of a type, 999 for other names, then the normalised name."""
    found = F.regexp_extract(normalised(name), r"^type(\d{1,9})$", 1)
    return F.when(found != "", found.try_cast("int")).otherwise(F.lit(999)), normalised(name)


def frame_name(video: Column, frame: Column) -> Column:
    return F.format_string("%s_frame%06d", video.cast("string"), frame.cast("long"))


def frame_number(stem: Column) -> Column:
    """The number after ``frame``, else closing digits, else 0."""
    named, closing = F.regexp_extract(stem, r"frame(\d+)", 1), F.regexp_extract(stem, r"(\d+)$", 1)
    return F.when(named != "", named.try_cast("long")).when(closing != "", closing.try_cast("long")).otherwise(F.lit(0).cast("long"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
