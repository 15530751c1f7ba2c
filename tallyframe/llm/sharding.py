"""Shards by balanced label propagation.

Documents with equal texts are linked. Every document starts with the label its
id hashes to. In each round the documents of a group vote with their labels,
joined with the labels of groups they were split from; a group asks for the shard
with most votes that still has room, and each shard admits requests, the largest
first, up to its quota. Groups too large for a shard are propagated in parts of a
quarter shard, drawn to one another's shards; of these groups there are at most
four a shard, so their parts are seated first, on the driver, what is known of
them is broadcast, and their rows are never brought together. Rounds go on while anything that waits fits somewhere. Settled
groups keep their seats; documents without links fill every shard up to its exact
number of rows, so sizes differ by one row at most.

All per-row work is a hash join, an aggregate, or a rank inside a hash bucket of a
few thousand rows; what comes to the driver is one number a shard, and a row for
each part of a large group and each of its votes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of a ranking bucket.
BUCKET_ROWS = 5000


def _pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), at + 1)


def running(df: DataFrame, by: list[str], bucket: str, order: list, weight: Column, name: str) -> DataFrame:
    """``name``: sum of ``weight`` over the rows of ``by`` up to and with this one, in bucket order."""
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy(*by, bucket).agg(F.sum(weight).alias("bucket_sum"))
    before = F.sum("bucket_sum").over(Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*by, bucket, F.coalesce(before, F.lit(0)).alias("offset_"))
    return df.withColumn("inside_", F.sum(weight).over(inside)).join(offsets, [*by, bucket]).withColumn(name, F.col("inside_") + F.col("offset_")).drop("inside_", "offset_")


def _seat_large(parts: list, heard: list, room: list[int]) -> list[tuple]:
    """Seats of the parts of large groups, at most a few a shard, while whole shards are free; ``room`` shrinks.

    A part goes where it fits and its group has most votes, those of its seated
    parts among them; parts that fit nowhere are left to the rounds.
    """
    votes: dict[bytes, dict[int, int]] = {}
    for r in heard:
        votes.setdefault(bytes(r.group), {})[r.label] = r.votes
    whole: dict[bytes, int] = {}
    for r in parts:
        whole[bytes(r.group)] = whole.get(bytes(r.group), 0) + r.n
    seats = []
    for r in sorted(parts, key=lambda r: (-whole[bytes(r.group)], bytes(r.group), -r.n, r.part)):
        own = votes[bytes(r.group)]
        fitting = [k for k in range(len(room)) if room[k] >= r.n]
        if fitting:
            k = max(fitting, key=lambda k: (own.get(k, 0), room[k], -k))
            own[k] = own.get(k, 0) + r.n
            room[k] -= r.n
            seats.append((bytes(r.group), r.part, r.n, k))
    return seats


def assign(docs: DataFrame, shards: int = 40, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 16, null text counts as empty; the law
    is ``rows``. Rows that repeat are placed each; a null id hashes like a value of
    its own; an empty table gives no rows; other columns are ignored. With fewer
    rows than shards the first shards get one row each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("group"),
        F.xxhash64(F.col(id_col), F.lit(7)).alias("h"),
    )
    base = cut(base.withColumn("label", F.pmod("h", F.lit(shards)).cast("int")))
    total = base.count()
    targets = [total // shards + (k < total % shards) for k in range(shards)]
    quota = total // shards
    most = max(2, quota // 4)

    groups = cut(base.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # a large group has over ``most`` rows, so there are fewer than 1 + total / most of them, and twice as many parts
    large = groups.where(F.col("n") > most).select("group", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    dealt = base.join(F.broadcast(large), "group", "left").withColumn("part", F.coalesce(F.pmod(F.shiftright("h", 20), F.col("parts")), F.lit(0)).cast("int"))
    votes = dealt.groupBy("group", "part", "label").agg(F.count(F.lit(1)).alias("votes"))
    votes = cut(votes.join(groups.select("group"), "group", "left_semi"))
    units = votes.groupBy("group", "part").agg(F.sum("votes").alias("n"))
    heard = votes.groupBy("group", "label").agg(F.sum("votes").alias("votes"))  # all parts of a group vote together
    room = [quota] * shards
    of_large = lambda df, how: df.join(F.broadcast(large.select("group")), "group", how)
    seated = _seat_large(of_large(units, "left_semi").collect(), of_large(heard, "left_semi").collect(), room)
    kinds = "`group` binary, part int, n long, shard int"
    settled = docs.sparkSession.createDataFrame(seated, kinds)
    waiting = units.join(F.broadcast(settled.select("group", "part")), ["group", "part"], "left_anti")
    while True:
        wish = waiting.join(heard, "group").select("group", "part", "n", "label", "votes")
        drawn = waiting.join(settled.select("group", F.col("shard").alias("label"), F.col("n").alias("votes")), "group").select("group", "part", "n", "label", "votes")
        wish = wish.unionByName(drawn)
        tallied = wish.groupBy("group", "part", "n", "label").agg(F.sum("votes").alias("votes"))
        tie = F.xxhash64("group", "label")
        fitting = tallied.where(F.col("n") <= _pick(room, F.col("label")))
        chosen = fitting.groupBy("group", "part", "n").agg(F.max_by("label", F.struct("votes", tie.alias("tie"))).alias("shard"))
        roomiest = max(range(shards), key=lambda k: room[k])
        asked = waiting.select("group", "part", "n").join(chosen.select("group", "part", "shard"), ["group", "part"], "left").withColumn("shard", F.coalesce("shard", F.lit(roomiest)))
        width = max(1, math.ceil(total / shards / BUCKET_ROWS))
        large_first = (F.lit(64) - F.floor(F.log2("n"))).cast("long")
        asked = asked.withColumn("fits", F.col("n") <= _pick(room, F.col("shard")))  # what fits nowhere now must not stand before others
        asked = asked.withColumn("bucket", large_first * width + F.pmod(F.xxhash64("group", "part"), F.lit(width)))
        asked = running(asked, ["shard"], "bucket", [F.desc("n"), "group", "part"], F.when(F.col("fits"), F.col("n")).otherwise(0), "upto")
        asked = cut(asked.withColumn("in", F.col("fits") & (F.col("upto") <= _pick(room, F.col("shard")))).select("group", "part", "n", "shard", "in"))
        admitted = asked.where("in").select("group", "part", "n", "shard")
        settled = cut(settled.unionByName(admitted))
        waiting = asked.where(~F.col("in")).select("group", "part", "n")
        taken = {r.shard: r.n for r in settled.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        before, room = room, [quota - taken.get(k, 0) for k in range(shards)]
        if room == before or waiting.isEmpty():  # nothing fits any more, or nothing waits
            break

    seats = settled.select("group", "part", "shard")
    large_seats = seats.join(F.broadcast(large.select("group")), "group", "left_semi").select("group", "part", F.col("shard").alias("large_shard"))
    small_seats = seats.join(F.broadcast(large.select("group")), "group", "left_anti").select(F.col("group").alias("own"), F.col("shard").alias("small_shard"))
    # rows of large groups go by a key of their own, which no seat has, and so to no task in common
    own = F.when(F.col("parts").isNull(), F.col("group")).otherwise(F.unhex(F.hex("h"))).alias("own")
    placed = dealt.join(F.broadcast(large_seats), ["group", "part"], "left").select("doc_id", "size", "text_crc32", "h", "label", "large_shard", own).join(small_seats, "own", "left")
    placed = placed.withColumn("shard", F.coalesce("large_shard", "small_shard"))
    placed = placed.select("doc_id", "size", "text_crc32", "h", F.coalesce("shard", "label").alias("label"), F.col("shard").isNull().alias("loose"))
    width = max(1, math.ceil(total / shards / BUCKET_ROWS))
    placed = placed.withColumn("bucket", F.col("loose").cast("long") * width + F.pmod(F.shiftright("h", 8), F.lit(width)))
    placed = cut(running(placed, ["label"], "bucket", ["h", "doc_id", "size", "text_crc32"], F.lit(1).cast("long"), "rank"))

    counts = {r.label: r.n for r in placed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    have = [counts.get(k, 0) for k in range(shards)]
    over = [max(0, h - t) for h, t in zip(have, targets)]
    free = [max(0, t - h) for h, t in zip(have, targets)]
    over_before = [sum(over[:k]) for k in range(shards)]
    free_upto = [sum(free[: k + 1]) for k in range(shards)]

    rank = F.col("rank") - 1
    stays = rank < _pick(targets, F.col("label"))
    spill = _pick(over_before, F.col("label")) + rank - _pick(targets, F.col("label"))
    seat = sum(((F.lit(upto).cast("long") <= F.col("spill")).cast("int") for upto in free_upto), F.lit(0))
    moved = placed.withColumn("spill", F.when(~stays, spill)).withColumn("shard", F.when(F.col("spill").isNull(), F.col("label")).otherwise(seat))
    slot = F.when(F.col("spill").isNull(), rank).otherwise(_pick(have, F.col("shard")) + F.col("spill") - _pick([u - f for u, f in zip(free_upto, free)], F.col("shard")))
    return moved.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
