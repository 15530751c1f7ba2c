import itertools
import random

import numpy as np
import public_tokenizers

from tallyframe.llm.packing import WordIds, candidates, cheapest_cuts, pack

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def test_word_ids_equal_the_library():
    words, rnd = WordIds(VOCAB), random.Random(2)
    parts = [*" \t\n'''aAbcdrevlstm09.,!?", chr(0xDF), chr(0x3A3), chr(0x130), chr(0x212A), chr(0x6F22), "e" + chr(0x301), chr(0xA0), chr(0x1C), chr(0x85), "\x02", " \x02 ", "<|endoftext|>", "<|startoftext|>", "'re"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(50))) for _ in range(3000)] + ["", " ", "a" * 3000, "Word. " * 3000]
    for text, ids in zip(texts, words.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == words.library.encode(text, add_special_tokens=False).ids


def cost(cuts, at, penalty, window):
    price, total, before = dict(zip(at.tolist(), penalty.tolist())), 0, 0
    for c in cuts:
        if c - before > window:
            return None
        total, before = total + (window - (c - before) + price[c] if c != cuts[-1] else 0), c
    return total


def test_cuts_are_cheapest_by_brute_force():
    rnd = random.Random(3)
    for _ in range(60):
        n, window = rnd.randrange(8, 16), rnd.randrange(3, 7)
        ids = np.array([rnd.choice([7, 1, 1]) for _ in range(n)])
        ends = np.array(sorted({rnd.randrange(1, n), n}))
        at, penalty = candidates(ids, ends, np.array([7]), window)
        cuts = cheapest_cuts(at, penalty, window)
        inner = [a for a in at.tolist() if a != n]
        every = [c for k in range(len(inner) + 1) for some in itertools.combinations(inner, k) if (c := cost([*some, n], at, penalty, window)) is not None]
        assert cost(cuts, at, penalty, window) == min(every)


def check(docs, rows, window):
    words = WordIds(VOCAB)
    want = {i: np.frombuffer(words.encode([t or ""])[0], "<u4").tolist() + [2] for i, t in docs}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert [x for r in pieces for x in np.frombuffer(bytes(r.ids), "<u4").tolist()] == want[i]
        assert all(r.doc_tokens == len(want[i]) and r.length == len(r.ids) // 4 for r in pieces)
    padding = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / sum(map(len, want.values()))


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    rows = pack(docs, VOCAB).collect()
    assert check([(r.doc_id, r.text) for r in docs.collect()], rows, 4096) < 0.01


def cuts_inside(pieces, docs, words):
    """Full windows' ends that stand neither after a document nor after a sentence."""
    ids = {i: np.frombuffer(words.encode([t or ""])[0] + b"\2\0\0\0", "<u4") for i, t in docs}
    last = {}
    for r in pieces:
        if r.sequence_id not in last or last[r.sequence_id].offset < r.offset:
            last[r.sequence_id] = r
    size = {k: r.offset + r.length for k, r in last.items()}
    ends = [r for k, r in last.items() if size[k] & (size[k] - 1) or size[k] == 4096]
    return [r for r in ends if r.start + r.length < r.doc_tokens and ids[r.doc_id][r.start + r.length - 1] not in words.sentence_ends], len(ends)


def test_sentences_are_not_cut(spark):
    rnd = random.Random(7)
    sentence = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rnd.randrange(3, 90))) + rnd.choice(".!?")
    texts = [(k, " ".join(sentence() for _ in range(rnd.choice([1, 5, 200])))) for k in range(300)]
    rows = pack(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), VOCAB).collect()
    inside, full = cuts_inside(rows, texts, WordIds(VOCAB))
    assert full > 100
    assert not inside
    assert check(texts, rows, 4096) < 0.01


def test_long_texts_without_sentences_are_cut_at_little_padding(spark):
    texts = [(k, "word " * (3000 + 7 * k)) for k in range(40)] + [(99, "One. " * 300_000)]
    rows = pack(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), VOCAB).collect()
    assert check(texts, rows, 4096) < 0.01


def test_small_windows_and_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "word " * 500), (4, "One. Two! Three? " * 40), (5, "x"), (None, "a b")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, offset int").coalesce(1)
    check(texts, pack(docs, VOCAB, window=64).collect(), 64)
    assert pack(docs.limit(0), VOCAB).count() == 0
