import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyframe.llm import fst_tokens
from tallyframe.llm.fst_tokens import count_tokens, token_counts

VOCAB = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    lib = Tokenizer.from_file(VOCAB)
    return [len(e.ids) for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def fuzz(n, seed=3):
    rnd = random.Random(seed)
    parts = [*" \t\n'''aabcdrevlstmA09.,!", chr(0xDF), chr(0xF1), chr(0x6F22), chr(0x1F600), chr(0xA0), chr(0x2003), chr(0x1C), "e" + chr(0x301), "'re", "'ve", "'ll", "'s", " '", "<|endoftext|>", "\r\n", "   "]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(n)]


def test_counts_equal_the_library_on_random_and_extreme_texts():
    texts = [*fuzz(2000), None, "", "a" * 5000, "ab" * 3000, " " * 3000, "'" * 999, chr(0x6F22) * 900, "word " * 20000]
    assert list(count_tokens(texts, VOCAB)) == library(texts)


def test_small_state_budget_changes_nothing(monkeypatch):
    monkeypatch.setattr(fst_tokens, "MAX_STATES", 50)
    monkeypatch.setattr(fst_tokens, "BATCH_CHARS", 500)
    texts = fuzz(300, seed=4)
    assert list(count_tokens(texts, VOCAB)) == library(texts)


def test_query_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in token_counts(docs, VOCAB).collect()}
    rows = docs.collect()
    want = library([r.text for r in rows])
    assert [got[r.doc_id].n_tokens for r in rows] == want
    assert all(got[r.doc_id].n_bytes == len(r.text.encode()) and got[r.doc_id].over_limit == (n > 512) for r, n in zip(rows, want))


def test_nulls_empties_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "a b", 6), (2, "", 7), (3, "x", 8), (3, "x", 8)], "doc_id long, text string, n_tokens long")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(docs, VOCAB).collect()), key=str)
    assert got == sorted([(1, 0, 0), (None, 3, 2), (2, 0, 0), (3, 1, 1), (3, 1, 1)], key=str)
    assert token_counts(docs.limit(0), VOCAB).count() == 0


@pytest.mark.parametrize("text", ["a'rex 'lly don't we'll 've x'd", "\n\n 'r", "  \t x"])
def test_contractions(text):
    assert list(count_tokens([text], VOCAB)) == library([text])


@pytest.mark.parametrize("other", [0xA0, 0x3000, 0x2003, 0x85])
def test_runs_of_mixed_white_space_at_chunk_boundaries(other):
    run = (" " + chr(other)) * 40
    texts = ["x" * k + run + "y z" for k in range(fst_tokens.CHUNK - 90, fst_tokens.CHUNK + 10)]
    for text in [*texts, run * 40, "a b " * 300 + run * 20 + "c"]:
        assert list(count_tokens([text], VOCAB)) == library([text])
    assert list(count_tokens(texts, VOCAB)) == library(texts)


def test_every_code_point():
    lib = Tokenizer.from_file(VOCAB)
    for template in ("it{c}'s {c}'re", "a{c}1", "{c}{c} {c}"):
        texts = [template.format(c=chr(k)) for k in (*range(0xD800), *range(0xE000, 0x110000)) if k < 0x32000 or k % 61 == 0 or k > 0xE0000 and k < 0xE0200]
        for at in range(0, len(texts), 20000):
            some = texts[at : at + 20000]
            got, want = count_tokens(some, VOCAB), [len(e.ids) for e in lib.encode_batch(some, add_special_tokens=False)]
            assert [t.encode("unicode_escape") for t, a, b in zip(some, got, want) if a != b] == []


def test_long_texts_without_resets_through_state_maps(monkeypatch):
    calls = []
    scanned = fst_tokens.Transducer.scanned
    monkeypatch.setattr(fst_tokens.Transducer, "scanned", lambda self, *a: calls.append(a[-1]) or scanned(self, *a))
    rnd = random.Random(7)
    letters = "".join(rnd.choices("etaoinshrdlu", k=1_000_000))
    mixed = "".join(rnd.choices("ethe'sre09.,-", k=40_000))
    texts = [letters, mixed, "a" * 30_000, "ab" * 9_000, "'" * 7_000, "9" * 5_000, (" " + chr(0xA0)) * 4_000, chr(0x6F22) * 3_000 + "x", "short one", "x" * (fst_tokens.LONG + 1) + " y " + "z" * 5000]
    assert list(count_tokens(texts, VOCAB)) == library(texts)
    assert len(calls) == 10 and max(calls) == 1_000_000


@pytest.mark.parametrize("bits", [2, 20])
def test_characters_without_a_column_share_a_small_table(monkeypatch, bits):
    monkeypatch.setattr(fst_tokens, "RARE_BITS", bits)
    monkeypatch.setattr(fst_tokens, "transducer", fst_tokens.lru_cache(maxsize=1)(fst_tokens.Transducer))
    rnd = random.Random(bits)
    signs = [*map(chr, range(0x4E00, 0x5100)), *map(chr, range(0x1F600, 0x1F640)), *"ab ,.'", chr(0x3002)]
    texts = ["".join(rnd.choices(signs, k=rnd.randrange(400))) for _ in range(120)] + ["".join(rnd.choices(signs[:500], k=9000))]
    assert list(count_tokens(texts, VOCAB)) == library(texts)
    assert list(count_tokens(texts[::-1], VOCAB)) == library(texts[::-1])
