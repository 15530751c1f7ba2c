import base64
import random

import numpy as np
import public_tokenizers
import tiktoken

from tallyframe.llm.byte_bpe import ByteBpe, decode, encode

FILE, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ints(raw):
    return [int.from_bytes(raw[k : k + 4], "little") for k in range(0, len(raw), 4)]


def texts():
    rnd = random.Random(5)
    parts = [*" \t\n'''aabcdrevlstmA09.,!", chr(0xDF), chr(0x6F22), chr(0x1F600), chr(0xA0), chr(0x2003), chr(0x1C), chr(0x85), "'re", "<|endoftext|>", "\r\n", "   "]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    made += ["".join(rnd.choice(letters) for _ in range(20000)) for letters in ("ab", "thenaio", "abcdefgh")]
    return [*made, "", "a" * 50000, " " * 5000, "'" * 5000, chr(0x6F22) * 5000]


def test_ids_equal_the_library_and_decode_back():
    bpe, lib = ByteBpe(FILE, PATTERN), library()
    for text in texts():
        ids = bpe.encode(text)
        assert ints(ids) == lib.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_long_merge_equals_short_merge():
    bpe, rnd = ByteBpe(FILE, PATTERN), random.Random(1)
    for _ in range(200):
        piece = bytes(rnd.choice(b"aethinos") for _ in range(60))
        assert bpe.merge(piece) == bpe._merge_long(piece) == bpe.tree(piece)


def test_frames(spark, sf_dir):
    lib = library()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, "x y"), (-3, "a"), (-3, "a")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    want = {r.doc_id: r.text or "" for r in both.collect()}
    tokens = encode(both, FILE, PATTERN)
    rows = tokens.collect()
    assert len(rows) == docs.count() + 5
    assert all(ints(r.ids) == lib.encode_ordinary(want[r.doc_id]) and r.n_tokens == len(r.ids) // 4 for r in rows)
    assert all(r.decoded.decode() == want[r.doc_id] for r in decode(tokens, FILE, PATTERN).collect())
    assert encode(docs.limit(0), FILE, PATTERN).count() == 0


def test_every_code_point():
    bpe, lib = ByteBpe(FILE, PATTERN), library()
    for template in ("it{c}'s {c}'re", "a{c}1", "{c}{c} {c}", "1{c}!{c} "):
        texts = [template.format(c=chr(k)) for k in (*range(0xD800), *range(0xE000, 0x110000)) if k < 0x32000 or k % 61 == 0 or k > 0xE0000 and k < 0xE0200]
        for text, want in zip(texts, lib.encode_ordinary_batch(texts)):
            got = np.frombuffer(b"".join(map(bpe.encode_piece, bpe.pieces(text))), "<u4").tolist()
            assert got == want, text.encode("unicode_escape")


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x", b"y")], "doc_id long, text string, n_tokens int, ids string, decoded binary")
    row = encode(docs, FILE, PATTERN, decoded=True).first()
    assert (row.doc_id, row.n_tokens, row.decoded) == (1, 2, b"a b")
