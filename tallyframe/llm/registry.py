"""Queries of the corpus operators, by name, and their SQL where there is any."""

from __future__ import annotations

import json
import uuid

import public_tokenizers
from pyspark.sql import functions as F

from . import chat_format, filter_audit, hard_negatives, language_id, minhash_dedup, quality, sharding, toxicity, warc
from .byte_bpe import encode as bpe_encode
from .common import checkpoint_dir, read_table
from .exact_dedup import annotate as exact_annotate
from .fst_tokens import token_counts
from .packing import pack


def op1_quality_rules(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op2_token_counts(spark, sf_dir):
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op3_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op4_exact_dedup(spark, sf_dir):
    return exact_annotate(read_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""


def op5_minhash_near_dedup(spark, sf_dir):
    return minhash_dedup.group(read_table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def op6_byte_bpe(spark, sf_dir):
    tokens = bpe_encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op8_packing(spark, sf_dir):
    pieces = pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


#: Both texts of conversation -7, which comes as a record of another layout.
ODD_TEXT = "</s>[INST] ok [/INST]"


def op9_chat_format(spark, sf_dir):
    table = read_table(spark, sf_dir, "conversations")
    odd = json.dumps({"prompt": ODD_TEXT, "response": ODD_TEXT})
    record = spark.createDataFrame([(-7, odd)], f"conv_id {dict(table.dtypes)['conv_id']}, record string")
    turns = chat_format.canonical(table).unionByName(chat_format.canonical_records(record).select("conv_id", "turns"))
    return chat_format.digests(chat_format.render(turns))


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), c AS (
  SELECT *, 9 + length(role) + length(text)
            + length(regexp_replace(role, '[^\<\[\]]', '', 'g')) + length(regexp_replace(text, '[^\<\[]', '', 'g')) AS chars
  FROM t
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


def op10_sharding(spark, sf_dir):
    return sharding.assign(read_table(spark, sf_dir, "documents"), shards=40)


def op11_hard_negatives(spark, sf_dir):
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=wrong)


OP11_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.id AS anchor_id, a.v, a.label, b.id AS positive_id, list_dot_product(a.v, b.v)::BIGINT AS positive_score
  FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id WHERE a.id % 100 = 0
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.v, b.v) DESC, b.id) <= 5
), n AS (
  SELECT anchor_id, positive_id, b.id AS negative_id, positive_score, list_dot_product(p.v, b.v)::BIGINT AS negative_score FROM p JOIN v b ON b.label <> p.label
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id))::INT AS rank, negative_id, positive_score, negative_score
FROM n WHERE 80 * positive_score <= 100 * negative_score AND 100 * negative_score <= 100 * positive_score
QUALIFY rank <= 5
"""


def op12_warc(spark, sf_dir):
    where = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(warc.records(warc.decisions(read_table(spark, sf_dir, "pages"))), where)
    found = warc.pages_of(warc.contents(spark, where, payloads=False))
    sound = F.when(F.col("problem").isNull(), F.col("page_id")).otherwise(F.raise_error(F.col("problem")).cast("long"))
    return found.select(sound.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t FROM pages
), b AS (
  SELECT *, min(page_id) OVER (PARTITION BY t) AS least,
         list_aggregate(list_transform(string_split(sha1(t), ''), lambda h: right((('0x' || h)::INT::BIT)::VARCHAR, 4)), 'string_agg', '') AS bits FROM p
)
SELECT page_id, strlen(t) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: substr(bits, 5 * i + j + 1, 1)::INT << (4 - j)::INT))::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > least THEN least END AS refers_to
FROM b
"""


def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d
), m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
       + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
       + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
       + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
       + CASE WHEN least < doc_id THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM m GROUP BY ALL
), f AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)
), o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step])::INT AS used, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM o, (SELECT unnest(range(1, 6))::INT AS step)
), r AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (WHERE mask & used = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(g) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
         coalesce(sum(x) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""


def queries() -> dict:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_token_counts": op2_token_counts,
        "op3_toxicity": op3_toxicity,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_minhash_near_dedup": op5_minhash_near_dedup,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_language_id": op7_language_id,
        "op8_packing": op8_packing,
        "op9_chat_format": op9_chat_format,
        "op10_sharding": op10_sharding,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_warc": op12_warc,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict:
    return {"op4_exact_dedup": OP4_SQL, "op9_chat_format": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_warc": OP12_SQL, "op13_filter_audit": OP13_SQL}
