import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import product

from tallyframe.llm.sharding import assign


def check(rows, docs, shards):
    want = {i: t for i, t in docs}
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(i) for i, _ in docs)
    sizes = Counter(r.shard for r in rows)
    counts = [sizes.get(k, 0) for k in range(shards)]
    assert max(counts) - min(counts) <= 1 and max(sizes, default=0) < shards
    by_shard, groups = defaultdict(list), defaultdict(Counter)
    for r in rows:
        by_shard[r.shard].append(r.slot)
        groups[want[r.doc_id] or ""][r.shard] += 1
        raw = (want[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    return groups


def test_balance_and_groups(spark):
    docs = [(k, f"text {k}") for k in range(700)]
    docs += [(1000 + k, f"pair {k // 2}") for k in range(100)] + [(2000 + k, f"five {k // 5}") for k in range(100)]
    docs += [(3000 + k, "hot") for k in range(400)] + [(9000, None), (9001, "")]
    frame = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, shard int").repartition(5)
    groups = check(assign(frame, 10).collect(), docs, 10)
    small = [g for t, g in groups.items() if t != "hot" and sum(g.values()) > 1]
    assert sum(len(g) == 1 for g in small) >= 0.95 * len(small)
    assert len(groups["hot"]) <= 6  # 400 rows do not fit into fewer than 4 shards of 130


def test_everything_is_one_group(spark):
    docs = [(k, "same") for k in range(203)]
    check(assign(spark.createDataFrame(docs, "doc_id long, text string"), 7).collect(), docs, 7)


def test_few_and_no_rows(spark):
    docs = [(1, "a"), (2, "a"), (None, "b"), (4, None)]
    check(assign(spark.createDataFrame(docs, "doc_id long, text string"), 40).collect(), docs, 40)
    assert assign(spark.createDataFrame([], "doc_id long, text string"), 40).count() == 0


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(assign(docs, 40).collect(), [(r.doc_id, r.text) for r in docs.collect()], 40)


def split_pairs(groups):
    """Links cut: pairs of equal texts in different shards."""
    return sum(sum(g.values()) ** 2 - sum(n * n for n in g.values()) for g in groups.values()) // 2


def least_split_pairs(sizes, shards):
    """The least number of cut pairs over all ways of filling shards of sizes at most one apart."""
    total = sum(sizes)
    room = tuple(sorted(total // shards + (k < total % shards) for k in range(shards)))

    @lru_cache(None)
    def best(at, left):
        if at == len(sizes):
            return 0
        found = None
        for parts in product(*(range(min(sizes[at], r) + 1) for r in left)):
            if sum(parts) == sizes[at]:
                cost = (sizes[at] ** 2 - sum(p * p for p in parts)) // 2 + best(at + 1, tuple(sorted(r - p for r, p in zip(left, parts))))
                found = cost if found is None else min(found, cost)
        return found

    return best(0, room)


def test_cut_edges_against_the_best_of_all_assignments(spark):
    rnd = random.Random(2)
    for shards, sizes in ((3, [4, 3, 3, 2, 2, 1, 1, 1, 1, 1, 1, 1]), (2, [5, 4, 3, 1, 1, 1, 1]), (3, [2] * 6 + [1] * 3), (2, [9, 1, 1, 1])):
        rows = [(i, f"t{g}") for i, g in enumerate(g for g, n in enumerate(sizes) for _ in range(n))]
        rnd.shuffle(rows)
        got = split_pairs(check(assign(spark.createDataFrame(rows, "doc_id long, text string"), shards).collect(), rows, shards))
        best = least_split_pairs(tuple(sorted(sizes, reverse=True)), shards)
        assert best <= got <= best + max(sizes), (sizes, got, best)


def test_half_of_the_rows_in_one_group(spark):
    docs = [(k, "hot" if k % 2 else f"t{k // 6}") for k in range(4000)]
    groups = check(assign(spark.createDataFrame(docs, "doc_id long, text string"), 8).collect(), docs, 8)
    assert len(groups["hot"]) <= 6
    assert sum(len(g) > 1 for t, g in groups.items() if t != "hot") <= 8  # threes that no longer fit where a shard fills up


def test_very_long_texts_and_clashing_columns(spark):
    long = "word " * 400_000
    docs = [(1, long), (2, long), (3, "x"), (4, long + "y")]
    frame = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in docs], "doc_id long, text string, size int, label int, part int, own int")
    groups = check(assign(frame, 2).collect(), docs, 2)
    assert sum(groups[long].values()) == 2
