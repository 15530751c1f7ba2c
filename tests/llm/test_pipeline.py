"""The pipeline's stages, each against a plain version of its decision on its own input."""

import re

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tallyframe.llm import minhash_dedup, quality, toxicity
from tallyframe.llm.packing import WordIds

from .test_minhash_dedup import brute


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input and output rows of every stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found, base = {}, tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        out = spark.read.parquet(f"{base}/{name}")
        found[name] = (docs, out)
        docs = out
    return found


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_all_but_the_last_keep_the_columns(spark, sf_dir, stages):
    want = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert all(out.columns == want for name, (_, out) in stages.items() if name != "packing")
    texts = {r.doc_id: r for r in stages["quality_rules"][0].collect()}
    assert all(texts[r.doc_id] == r for r in stages["near_copies"][1].collect())


def test_quality_and_toxicity(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs, out = stages["quality_rules"]
    assert ids(out) == ids(quality.judge(docs, quality.train(docs, labels)).where("kept"))
    docs, out = stages["toxicity"]
    assert ids(out) == ids(toxicity.score(docs, toxicity.train(docs, labels)).where("predicted = 0"))


def test_copies(stages):
    docs, out = stages["exact_copies"]
    groups = {}
    for r in docs.collect():
        groups.setdefault(re.sub(r"[ \t-\r]+", " ", r.text or ""), []).append(r.doc_id)
    assert ids(out) == sorted(min(g) for g in groups.values())
    docs, out = stages["near_copies"]
    assert ids(out) == sorted({c for _, c in brute([(r.doc_id, r.text) for r in docs.collect()], 5).values()})
    assert minhash_dedup.group(out, 5).where("not kept").isEmpty()


def test_packing_covers_every_id_once(stages):
    docs, out = stages["packing"]
    words, want = WordIds(public_tokenizers.path("word_bpe_49k.json")), {}
    for r in docs.collect():
        want[r.doc_id] = len(np.frombuffer(words.encode([r.text or ""])[0], "<u4")) + 1
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(got) == set(want)
    for i, pieces in got.items():
        at = 0
        for start, length, total in sorted(pieces):
            assert start == at and total == want[i]
            at += length
        assert at == want[i]


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    assert ids(corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct()) == ids(stages["packing"][1].select("doc_id").distinct())


ODD_COLUMNS = ("id", "mark", "class", "component", "digest", "nth", "probability", "text_judged", "text_scored", "keep_id", "key", "start", "words")


def test_odd_rows_through_every_stage(spark, sf_dir):
    """Nulls, empties, repeats, a very long text and clashing columns; what each stage keeps, on its own input."""
    labels = ", ".join(f"{c} int" for c in ODD_COLUMNS)
    own = " ".join(f"plainword{k}" for k in range(60))
    rows = [(1, None), (2, ""), (3, " \t"), (None, own + " without id"), (4, own), (4, own), (5, own + " more"), (6, own.replace(" ", "  ")), (7, "you idiot " * 40), (8, " ".join(f"long{k}" for k in range(300_000)))]
    docs = spark.createDataFrame([(*r, *range(len(ODD_COLUMNS))) for r in rows], f"doc_id long, text string, {labels}").repartition(3)
    kept = {name: stage(spark, docs, sf_dir) for name, stage in corpus_pipeline.STAGES}
    some = lambda name: sorted((r.doc_id for r in kept[name].collect()), key=str)
    assert all(kept[n].columns == docs.columns for n in ("quality_rules", "toxicity", "exact_copies", "near_copies"))
    assert not {1, 2, 3} & set(some("quality_rules"))
    assert {1, 2, 3, 4, 5, 6, 8, None} <= set(some("toxicity"))
    assert some("exact_copies") == [1, 3, 4, 5, 7, 8, None]
    assert some("near_copies") == [1, 2, 3, 4, 4, 7, 8, None]
    pieces = kept["packing"].collect()
    assert sorted({r.doc_id for r in pieces}, key=str) == [1, 2, 3, 4, 5, 6, 7, 8, None]
    assert [(r.start, r.length, r.doc_tokens) for r in pieces if r.doc_id in (1, 2)] == [(0, 1, 1)] * 2


def test_empty_table_through_every_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
