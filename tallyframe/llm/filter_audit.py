"""What filters take from a corpus in every order: one pass over the documents, then sums over subsets.

Each document is told by the set of filters it fails, a mask of bits. Documents
are counted by part and mask, at most ``2 ** k`` rows a part, and everything
else is arithmetic on these counts:

1. subset-zeta transform: ``k`` rounds turn the counts of a part into ``sums[T]``,
   the documents whose failures all lie in ``T``; those that survive the filters
   ``S`` are ``sums[complement of S]``;
2. a step of an order is the difference of two neighbouring subsets, the filters
   up to it and those before it; documents with a label go the same way;
3. a filter's removals summed over all orders weigh each subset before it by the
   number of orders that begin with that subset.

All of it is DataFrame functions; no order is ever run over the documents.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS

#: Filters of one audit at most: the report has k! orders of k steps a part.
MOST_FILTERS = 6

#: Measures that masks are counted by.
COUNTS = ["n", "good", "toxic"]


def rule_failures(text: Column) -> dict[str, Column]:
    """The filters that look at a text alone, by letter: true where the text fails. Null counts as empty.

    A: under 50 words. B: fewer than 65 distinct words in a hundred (never of no
    words). C: over 5 capital letters A-Z in a hundred code points. D: a symbol of
    ``#$%&*|``.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "")
    many = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": many < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * many,
        "C": 100 * capitals > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def labelled(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, good, toxic), one row an id: whether any of its label rows says quality 1, or toxic 1."""
    says = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).cast("long")
    return labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))


def mask_counts(docs: DataFrame, labels: DataFrame, repeat_bit: int = 4, text_col: str = "text", id_col: str = "doc_id", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters, with those labelled good and toxic.

    Bits 0 to 3 are :func:`rule_failures`, ``repeat_bit`` is set where the same text
    stands under a smaller id anywhere in the table. Texts are compared by their
    SHA-256 digest. Null text is empty, a null part the empty string; a
    row without id repeats nothing, is repeated by nothing and has no label; rows
    that repeat one id count each; several label rows of an id count as one that
    says what any of them says. Other columns are ignored, whatever their names.

    A text's copies are first folded by id and part, where the shuffle can still
    spread them, and the fold by text is combined before it is shuffled, so one text
    may hold any share of the rows. Of a text one row a part reaches the window.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    mask = F.lit(0)
    for k, failed in enumerate(rule_failures(F.col(text_col)).values()):
        mask = mask + F.when(failed, 1 << k).otherwise(0)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        mask.alias("mask"),
    )
    told = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    # rows without id meet no label and are spread by their texts
    told = told.withColumn("at", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none:"), F.hex("digest"))))
    told = told.join(labelled(labels, id_col).select(F.col("doc_id").cast("string").alias("at"), *COUNTS[1:]), "at", "left")
    told = told.select("doc_id", "digest", "part", "mask", "n", *((F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in COUNTS[1:]))
    # of each text and part: all rows, and those of the smallest id
    counts = F.struct(*COUNTS)
    alone = F.col("doc_id").isNull()
    spread = F.when(alone, F.col("part").cast("binary")).otherwise(F.col("digest"))  # rows without id need no comparing
    by_text = told.groupBy(spread.alias("digest"), "part", "mask", alone.alias("alone")).agg(
        F.min("doc_id").alias("least"), F.min_by(counts, "doc_id").alias("first"), *(F.sum(c).alias(c) for c in COUNTS)
    )
    leader = (F.col("least") == F.min("least").over(Window.partitionBy("digest"))) | F.col("alone")
    marked = by_text.withColumn("leads", leader)
    none = F.struct(*(F.lit(0).cast("long").alias(c) for c in COUNTS))
    stays = F.when(F.col("alone"), counts).when(F.col("leads"), F.col("first")).otherwise(none)
    split = marked.select("part", "mask", *COUNTS, stays.alias("stays"))
    bit = 1 << repeat_bit
    both = F.array(
        F.struct(F.col("mask").alias("mask"), *(F.col(f"stays.{c}").alias(c) for c in COUNTS)),
        F.struct((F.col("mask") + bit).alias("mask"), *((F.col(c) - F.col(f"stays.{c}")).alias(c) for c in COUNTS)),
    )
    return split.select("part", F.explode(both).alias("m")).groupBy("part", "m.mask").agg(*(F.sum(f"m.{c}").alias(c) for c in COUNTS))


def _sums(masks: DataFrame, filters: int, measures: list[str]) -> DataFrame:
    """One row a part: for each measure its counts by mask, and their subset sums after one round a filter."""
    size = 1 << filters
    held = masks.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.col("mask").cast("int"), F.struct(*measures)))).alias("by_mask"))  # at most 2 ** k entries
    dense = lambda c: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.coalesce(F.element_at("by_mask", m)[c], F.lit(0).cast("long")))
    table = held.select("part", *(dense(c).alias(c) for c in measures))
    table = table.withColumns({f"{c}_sums": F.col(c) for c in measures})
    for k in range(filters):
        bit = 1 << k
        one_round = lambda c: F.transform(c, lambda v, m: v + F.when(m.bitwiseAND(bit) != 0, F.element_at(c, m - m.bitwiseAND(bit) + 1)).otherwise(0))
        table = table.withColumns({f"{c}_sums": one_round(F.col(f"{c}_sums")) for c in measures})
    return table


def order_steps(masks: DataFrame, letters: str, lost: dict[str, str]) -> DataFrame:
    """One row for each part, order of the filters and step, from mask counts (part, mask, n, ...).

    ``letters`` names the filters by bit, ``lost`` the result columns of further
    measures. Returns part, filter_order, step, kept, removed, redundant (fail the
    step's filter but were removed before), unique_fails (fail this filter only),
    the lost ones, and shapley, the filter's removals summed over all orders. Parts
    come as they stand in ``masks``; an empty table gives no rows.
    """
    filters = len(letters)
    if not 1 <= filters <= MOST_FILTERS or len(set(letters)) != filters:
        raise ValueError(f"between 1 and {MOST_FILTERS} different filters can be audited")
    whole = (1 << filters) - 1
    table = _sums(masks, filters, ["n", *lost])
    survive = lambda c, used: F.element_at(f"{c}_sums", F.lit(whole) - used + 1)

    def weighed(k: int) -> Column:
        total = F.lit(0).cast("long")
        for used in range(whole + 1):
            if not used >> k & 1:
                before = used.bit_count()
                orders = math.factorial(before) * math.factorial(filters - 1 - before)
                total = total + orders * (survive("n", F.lit(used)) - survive("n", F.lit(used | 1 << k)))
        return total

    # by filter: failing it, failing it alone, removals over all orders
    of_filter = [
        F.struct((survive("n", F.lit(0)) - survive("n", F.lit(1 << k))).alias("fails"), F.element_at("n", (1 << k) + 1).alias("unique_fails"), weighed(k).alias("shapley"))
        for k in range(filters)
    ]
    table = table.select("part", "n_sums", *(f"{c}_sums" for c in lost), F.array(*of_filter).alias("of_filter"))
    orders = F.array(*(F.lit("".join(p)) for p in itertools.permutations(letters)))
    rows = table.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(filters))))
    place = lambda letter: F.instr("filter_order", letter)
    used = sum((F.when(place(c) <= F.col("step"), 1 << k).otherwise(0) for k, c in enumerate(letters)), F.lit(0))
    before = sum((F.when(place(c) < F.col("step"), 1 << k).otherwise(0) for k, c in enumerate(letters)), F.lit(0))
    own = F.element_at("of_filter", F.instr(F.lit(letters), F.substring("filter_order", F.col("step"), F.lit(1))))
    rows = rows.select("*", used.alias("used"), before.alias("before"), own.alias("own"))
    removed = survive("n", F.col("before")) - survive("n", F.col("used"))
    return rows.select(
        "part", "filter_order", "step", survive("n", F.col("used")).alias("kept"), removed.alias("removed"), (F.col("own.fails") - removed).alias("redundant"), F.col("own.unique_fails").alias("unique_fails"),
        *((survive(c, F.col("before")) - survive(c, F.col("used"))).alias(name) for c, name in lost.items()), F.col("own.shapley").alias("shapley"),
    )


def masks_of(rows: DataFrame, failures: dict[str, Column], part: Column, measures: dict[str, Column]) -> DataFrame:
    """(part, mask, n, measures): mask counts of any table under any filters, for :func:`order_steps`.

    ``failures`` has a condition for each filter, true where a row fails (null counts
    as passed); ``measures`` has conditions whose rows are counted beside all rows.
    """
    mask = sum((F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(failures.values())), F.lit(0))
    cells = rows.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask"), *(F.coalesce(c, F.lit(False)).alias(m) for m, c in measures.items()))
    return cells.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(m).alias(m) for m in measures))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over documents by source, in all 120 orders."""
    return order_steps(mask_counts(docs, labels), "ABCDE", {"good": "good_lost", "toxic": "toxic_lost"})
