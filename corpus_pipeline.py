"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, suffix-array dedup, packing.

Every stage takes the documents that its predecessor kept and decides over all of them; all but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import langid, linededup, packing, simhash, suffixes
from veilframe.llm._common import release, settled, ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without letters or with a narrow margin go, and so do null and empty texts.

    Copies of a row are judged alike. As in all stages, ids may be null, other columns stay as they are, and an empty table gives an empty one.
    """
    ship(spark)
    model = langid.fit(docs.where(langid.fold("doc_id", 3) != 1))
    return langid.accepted(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that came before, or nearly so, go; documents stay with what is left, if that is more than blank lines.

    Null and empty texts stay. Ties go to the least id, nulls last, then the least text hash; rows with the same id and text are one document.
    """
    return linededup.deduplicate(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8); ties and repeated rows as in line_dedup, wordless texts stay."""
    ship(spark)
    return simhash.deduplicate(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words and more stay only where they come first; ties and repeated rows as in line_dedup, shorter texts stay as they are."""
    ship(spark)
    return suffixes.remove(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, sources in proportion; every row is packed, a null text as an empty one."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]

#: Compression, fingerprints, suffixes and a tokenizer are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each one's result is written and reread, and what was written on the way to it deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, settled(lambda f=stage, x=docs: f(spark, x, sf_dir), f"pipeline-{name}")
        release(last)
    return STAGES[-1][1](spark, docs, sf_dir)
