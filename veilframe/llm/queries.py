"""The queries of this subpackage's operators over the tables of a folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, chat, jpeg, langid, lattice_lm, linededup, packing, pq, simhash, suffixes
from ._common import ship


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, ids=False)


def op2_lm_scoring(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lattice_lm.score(docs, public_tokenizers.path("piece_bpe_32k.model"), langid.fold("doc_id", 5) != 1)


def op3_line_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.report(docs)


def op4_chat_formatting(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.format_records(chat.records(rows.union(own))))


def op5_progressive_jpeg(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return jpeg.features(jpeg.store(docs))


def op6_byte_bpe(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op7_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.fold("doc_id", 3) == 1
    model = langid.fit(docs.where(~held_out))
    out = langid.classify(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_suffix_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffixes.passages(docs)
    return found.select("doc_id", F.col("lo").alias("start_word"), (F.col("hi") - F.col("lo")).alias("n_words"), "dropped", F.col("first").alias("first_doc_id"))


def op9_embedding_dedup(spark, sf_dir):
    return pq.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_simhash(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs)


def _shipped(f):
    def run(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries():
    return {k: _shipped(f) for k, f in globals().items() if k.startswith("op") and callable(f)}


_OP4_SQL = r"""
with rows as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), wide as (
    select *, len(replace(replace(text, '\', '\\'), '<', '\l')) as text_chars,
        len(replace(replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g'), chr(10), '\n')) as role_chars
    from rows
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    cast(coalesce(sum(len(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(text_chars + role_chars + 15) as bigint) as formatted_chars
from wide group by conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_formatting": _OP4_SQL}
