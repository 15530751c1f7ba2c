"""Small helpers that several corpus operators share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import shared_folder

#: The six ASCII white-space characters that separate words.
SPACE_CLASS = r"\x20\x09-\x0D"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Characters at which ``str.split`` cuts though they are no separators here.
_ODD_SPACE = re.compile("[" + "".join(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")


def words_of(text: str | None) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    if not text:
        return []
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the rows whose crc32 of the id, as text, leaves 2 mod 4.

    A null id counts as the empty string.
    """
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; only a local run may go without one and gets a temporary folder."""
    return shared_folder(spark)


def cut(df: DataFrame, small: bool = False) -> DataFrame:
    """Compute once into the shared checkpoint folder, so that lost executors cost nothing upstream.

    A ``small`` table, a few hundredths of the input, goes into an eighth as many
    files as a shuffle has partitions.
    """
    checkpoint_dir(df.sparkSession)
    return (df.coalesce(max(1, shuffle_width(df.sparkSession) // 8)) if small else df).checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write once as Parquet into the shared checkpoint folder and read it back, so that later steps read only the columns they need."""
    where = f"{checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def hot_join(rows: DataFrame, table: DataFrame, key: str, spread: str, n: str = "n") -> DataFrame:
    """Left join of ``rows`` with ``table``, which has one row for each ``key`` and counts in ``n`` the rows it meets.

    Keys that meet more than a fixed share of all rows, of which there can be no more
    than four a shuffle partition, are broadcast, and their rows go on spread by a hash
    of the column ``spread``; the rest is an ordinary join. ``table`` is written once.
    """
    table = cut(table)
    most = 4 * shuffle_width(rows.sparkSession)
    limit = (table.agg(F.sum(n)).first()[0] or 0) // most
    others = [c for c in table.columns if c not in (key, n)]
    side = lambda df, name: df.select(F.col(key).alias(f"{name}_key"), F.struct(*others).alias(name))
    hot, light = side(table.where(F.col(n) > limit), "hot"), side(table.where(F.col(n) <= limit), "light").withColumn("light_salt", F.lit(0).cast("long"))
    both = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    both = both.withColumn("salt", F.when(F.col("hot_key").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.lit(1 << 20)) + 1).cast("long"))
    both = both.join(light, (F.col(key) == F.col("light_key")) & (F.col("salt") == F.col("light_salt")), "left")
    return both.select(*rows.columns, *(F.coalesce(F.col(f"light.{c}"), F.col(f"hot.{c}")).alias(c) for c in others))
