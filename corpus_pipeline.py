"""From raw documents to packed training sequences, stage by stage.

Quality rules, toxicity, exact copies, near copies, packing. Each stage but the
last returns the documents it keeps, with their columns as they were and in their
order, whatever other columns there are. Every stage takes an empty table and
gives an empty one; rows that repeat are judged each. Null texts count as empty:
quality rules reject them, the later stages, should they get any, keep them
(toxicity, near copies), fold them into one (exact copies), or pack them as the end
id alone. Rows without id are kept by all stages that keep their text, but for
exact copies, where an id comes before none.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import exact_dedup, minhash_dedup, quality, toxicity
from tallyframe.llm.common import checkpoint_dir, read_table
from tallyframe.llm.packing import pack


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trained verdict reject go; texts without words, null ones too, fail the base rules."""
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def toxicity_grammar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; null and empty texts have no clause and stay."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the row with the smallest id stays; null and empty texts are equal, and of repeated rows one stays."""
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group (five-word shingles, similarity 0.8) the smallest id stays; texts without words and rows without id are in no group and stay."""
    return minhash_dedup.deduplicate(docs, shingle_words=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens; a null or empty text is its end id alone, repeated rows are packed each."""
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2, remember=False)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_grammar),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("packing", packing),
]

#: No stage but the exact copies can be said in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet into the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
