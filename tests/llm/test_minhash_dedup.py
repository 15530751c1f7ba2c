import random
import re

import pyarrow as pa

from tallyframe.llm import minhash_dedup
from tallyframe.llm.minhash_dedup import deduplicate, group


def brute(rows, size):
    """component of each id, number of shingles: every pair compared on its full sets."""
    sets = {}
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def made(seed, groups, copies, words):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    common, rows, at = [word() for _ in range(60)], [], 0
    for g in range(groups):
        base = [word() for _ in range(words)] + (common if g % 2 else [])
        for _ in range(copies):
            text = list(base)
            for _ in range(rnd.randrange(0, 6)):
                text[rnd.randrange(len(text))] = word()
            rows.append((at, " ".join(text)))
            at += 1
    rnd.shuffle(rows)
    return rows


def same(spark, rows, size):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in group(docs, size).collect()}
    assert got == brute(rows, size)


ODD = [(9000, None), (9001, ""), (9002, " "), (9003, "One two"), (9004, "one  TWO"), (9005, "One"), (9006, "x " * 3000), (9007, "x " * 2000)]


def test_against_all_pairs(spark):
    same(spark, made(1, 24, 14, 90) + ODD, 4)


def test_against_all_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 3)  # so that most open buckets are dealt out in blocks
    same(spark, made(5, 16, 14, 90) + ODD, 4)


def star(seed, members, edits, words=120):
    """Variants of one text with up to ``edits`` new words each: few of them are near one another, the least changed are near many."""
    rnd = random.Random(seed)
    base = [f"b{k}" for k in range(words)]
    rows = []
    for at in range(members):
        text = list(base)
        for _ in range(rnd.randrange(1, edits + 1)):
            text[rnd.randrange(words)] = f"n{at}x{rnd.randrange(10**6)}"
        rows.append((at, " ".join(text)))
    return rows


def test_one_huge_group_of_variants(spark, monkeypatch):
    rows = star(3, 300, 6) + [(1000 + i, t) for i, t in star(4, 40, 3, 60)]
    same(spark, rows, 4)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 50)
    same(spark, rows, 4)


def test_links_that_hubs_do_not_find(spark):
    """Chains whose ends differ: members near only one or two others, beside popular texts that share their buckets."""
    rnd, rows = random.Random(9), []
    for g in range(6):
        words = [f"c{g}w{k}" for k in range(100)]
        for step in range(12):
            rows.append((100 * g + step, " ".join(words)))
            at = rnd.randrange(100)
            words = [*words]
            words[at] = f"c{g}s{step}"
        rows += [(100 * g + 50 + k, " ".join(words[:60] + [f"o{g}{k}v{j}" for j in range(40)])) for k in range(5)]
    same(spark, rows, 4)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    same(spark, [(r.doc_id, r.text) for r in docs.collect()], 5)


def test_deduplicate_and_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(2, text, 1), (5, text + " more", 2), (7, "other words here", 3), (7, "other words here", 4), (None, text, 5), (8, None, 6)], "doc_id long, text string, n int")
    left = deduplicate(docs)
    assert left.columns == docs.columns
    assert sorted(r.n for r in left.collect()) == [1, 3, 4, 5, 6]
    assert group(docs.limit(0)).count() == 0


def test_an_id_with_several_texts(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(50)) for c in "ab")
    rows = [(7, one, 1), (7, two, 2), (3, one + " more", 3), (7, two, 4), (9, two + " end", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").select("text", "n", "doc_id")
    found = sorted((r.doc_id, r.component_id, r.kept) for r in group(docs).collect())
    assert found == [(3, 3, True), (7, 3, False), (7, 7, True), (7, 7, True), (9, 7, False)]
    left = deduplicate(docs)
    assert left.columns == ["text", "n", "doc_id"]
    assert sorted(r.n for r in left.collect()) == [2, 3, 4]


def test_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(2, text, 1, 2, "x", 3), (5, text, 1, 2, "y", 3)], "doc_id long, text string, id int, mark int, class string, component int")
    assert sorted((r.doc_id, r.component_id) for r in group(docs).collect()) == [(2, 2), (5, 2)]
    left = deduplicate(docs)
    assert left.columns == docs.columns
    assert [r["class"] for r in left.collect()] == ["x"]


def candidates(items, limit=600):
    fine = [0] * (minhash_dedup.FINE_BITS // 64)
    kinds = pa.list_(pa.int64())
    columns = {k: pa.array([r[at] for r in items], pa.int64()) for at, k in enumerate(("key", "class", "n", "component"))}
    columns |= {"block": pa.array([r[4] for r in items], pa.int32()), "bands": pa.array([r[5] for r in items], kinds), "fine": pa.array([fine] * len(items), kinds)}
    blocks = sorted({r[4] for r in items})
    columns |= {"low": pa.array([blocks[0]] * len(items), pa.int32()), "high": pa.array([blocks[-1]] * len(items), pa.int32())}
    found = minhash_dedup._candidates(pa.table(columns), 80, limit)
    return sorted(zip(found["a"].to_pylist(), found["b"].to_pylist()))


def test_candidates_of_buckets(spark):
    two = [(5, 1, 10, 1, -1, [5, 8]), (5, 2, 10, 2, -1, [5, 8]), (8, 1, 10, 1, -1, [5, 8]), (8, 2, 10, 2, -1, [5, 8])]
    assert candidates(two) == [(1, 2)]  # once, by the first band
    assert candidates([(5, 1, 10, 1, -1, [5, 8]), (5, 2, 20, 2, -1, [5, 8])]) == []  # too different in size
    many = [(5, k, 10, k // 30, -1, [5, 8]) for k in range(40)]  # two components of one bucket
    assert candidates(many) == [(a, b) for a in range(30) for b in range(30, 40)]
    blocks = [(5, k, 10, k, k // 3, [5, 8]) for k in range(6)]
    assert candidates(blocks) == [(a, b) for a in range(3) for b in range(3, 6)]
