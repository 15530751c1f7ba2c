import hashlib
import re

from tallyframe.llm.exact_dedup import annotate, deduplicate


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[ \t-\r]+", " ", text or ""), []).append(doc_id)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


ROWS = [(1, "a  b"), (2, "a\tb"), (3, "a b "), (4, None), (5, ""), (6, "A b"), (7, "x" * 100000), (8, "x" * 100000), (9, "a\n\n b"), (9, "a\n\n b"), (1, "a  b"), (None, "a b")]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in ROWS], "doc_id long, text string, digest string")
    want = brute(ROWS)
    got = annotate(docs).collect()
    assert len(got) == len(ROWS)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    assert all((r.keep_id, r.group_size) == by_sha[r.text_sha256] for r in got)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(want) and all(r.doc_id == r.keep_id for r in kept)


def test_deduplicate_keeps_all_columns_and_one_row_a_text(spark):
    docs = spark.createDataFrame([(i, t, "s", k) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, digest string, nth long")
    left = deduplicate(docs)
    assert left.columns == docs.columns
    want = brute(ROWS)
    assert sorted(r.doc_id for r in left.collect()) == sorted(k for k, _ in want.values())
    assert deduplicate(docs.limit(0)).count() == 0 and annotate(docs.limit(0)).count() == 0


def test_which_of_repeated_rows_stays_does_not_depend_on_their_order(spark):
    rows = [(1, "a b", k, {"k": k}) for k in range(40)] + [(None, "c", k, None) for k in range(40)]
    for seed in range(3):
        docs = spark.createDataFrame(sorted(rows, key=lambda r: (r[2] * 7 + seed) % 11), "doc_id long, text string, n int, m map<string,int>").repartition(3 + seed)
        assert sorted(r.n for r in deduplicate(docs).collect()) == [0, 0]
