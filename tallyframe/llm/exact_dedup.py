"""Exact duplicate removal by skew-safe combining, in DataFrame functions only.

Texts are equal when identical after every run of ASCII white space became one
space. Three combining steps, each keyed on the *whole* normalised text beside
its digest, so that equal digests alone never merge two texts:

1. local: the partial aggregate of step 2 folds the copies inside an input
   partition before anything is shuffled;
2. salted: copies meet by (digest, salt, text), the salt taken from the row's
   id with as many values as there are shuffle partitions, so one huge group of
   copies is spread over all tasks;
3. global: the few salt winners of a digest (at most one a salt and text) are
   combined into the group's smallest id and its size.

Should two different texts ever share a SHA-256 digest, the job stops with an
error instead of merging them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, shuffle_width

#: Runs of white space other than one plain space, which need no replacing.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    salts = shuffle_width(docs.sparkSession)
    norm = normalised(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("id"),
        norm.alias("norm"),
        F.sha2(norm.cast("binary"), 256).alias("digest"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int").alias("salt"),
    )


def winners(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(digest, salt, keep_id, group_size): one row for each salt in which a text occurs."""
    rows = _keyed(docs, text_col, id_col)
    salted = rows.groupBy("digest", "salt", "norm").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    one_digest = Window.partitionBy("digest")
    merged = salted.select(
        "digest",
        "salt",
        F.min("least").over(one_digest).alias("keep_id"),
        F.sum("n").over(one_digest).alias("group_size"),
        # full content again: all rows of a digest must carry the same text
        (F.min("norm").over(one_digest) == F.max("norm").over(one_digest)).alias("same"),
    )
    sound = F.when(F.col("same"), F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("long"))
    return merged.select("digest", "salt", "keep_id", sound.alias("group_size"))


def annotate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; a null id sorts after all others and is kept only
    in a group without any id. Of repeated rows with the group's smallest id
    exactly one is kept. An empty table gives no rows. Other columns of ``docs``
    are ignored, whatever their names.
    """
    best = winners(docs, text_col, id_col)
    rows = _keyed(docs, text_col, id_col).drop("norm")
    nth = F.row_number().over(Window.partitionBy("digest", "salt", "id").orderBy(F.lit(1)))
    return (
        rows.join(best, ["digest", "salt"])
        .select("*", nth.alias("nth"))
        .select(
            F.col("id").alias("doc_id"),
            "keep_id",
            "group_size",
            (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )


def deduplicate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct normalised text, all columns as they were.

    Null ids and texts count as in :func:`annotate`; of repeated rows with the
    smallest id the one stays whose columns sort first (columns without an order
    are left out of that); an empty table gives no rows.
    """
    digest, nth = fresh(docs, "digest"), fresh(docs, "nth")
    best = winners(docs, text_col, id_col).select(F.col("digest").alias(digest), F.col("keep_id").alias("keep_id_")).distinct()
    keyed = docs.withColumn(digest, F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    hit = keyed.join(best, (keyed[digest] == best[digest]) & keyed[id_col].eqNullSafe(best["keep_id_"]), "left_semi")
    ordered = [F.col(f.name) for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    one = Window.partitionBy(digest, F.col(id_col)).orderBy(*ordered)
    return hit.withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1).drop(digest, nth)
