import re
from collections import Counter

from tallyframe.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


TEXTS = [None, "", " \n\t", "a a a a a", "a b c a b c d", "x\x1cy z" + chr(0xA0) + "q", "one\ntwo\none\n\n\none \n", "a b a b a b", "#$<> | w", "p q r s\np q r s\n" * 3]


def test_counts_against_brute_force():
    for text in [*TEXTS, "lorem ipsum dolor\n" * 60_000, "x" * 1_000_000, " ".join(map(str, range(200_000)))]:
        assert quality.base_counts(text) == brute(text)


def test_query_on_the_table(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.judge(docs, model).collect()}
    for row in docs.collect():
        n_words, word_chars, n_symbols, n_dup, repeat = brute(row.text)
        r = got[row.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, word_chars, n_symbols, n_dup, repeat)
        assert r.base_failed == (n_words < 50 or 100 * repeat > 50 * n_words)
        assert not (r.kept and r.base_failed)


def test_model_separates_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    first = labels.where("doc_id % 2 = 0")
    model = quality.train(docs, first)
    rest = quality.judge(docs, model).where("not base_failed").join(labels.where("doc_id % 2 = 1 and quality is not null"), "doc_id").collect()
    right = sum((r.probability >= 0.5) == (r.quality == 1) for r in rest)
    assert right >= 0.95 * len(rest)


def test_odd_rows_and_missing_labels(spark):
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(TEXTS)] + [(None, "w " * 60, None), (1, "", False)], "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert model is None
    rows = quality.judge(docs, model).collect()
    assert len(rows) == len(TEXTS) + 2 and all(r.base_failed for r in rows)
    assert quality.keep_good(docs, model).columns == docs.columns and quality.keep_good(docs, model).count() == 0
    assert quality.judge(docs.limit(0), model).count() == 0
    good = spark.createDataFrame([(9, " ".join(f"w{k}" for k in range(80)), None)], docs.schema)
    assert quality.keep_good(good, model).collect() == good.collect()
