"""Language identification by compression: the language whose dictionary packs a text best."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._common import written

UNKNOWN = "und"


def letters(text):
    """What is compared: lower case, with all but letters as single spaces."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 64, docs: int = 4096) -> dict[str, bytes]:
    """Raw dictionary contents by language, the most frequent first; of every language.

    The bound of what is learned from is one on rows: the whole texts of docs_per_lang documents of
    each language, drawn by the hash of their text. With more languages each gives fewer, so that
    they are `docs` in all, and beyond `docs` languages one each. Rows with a null or empty text or a
    null language teach nothing. Copies of a text count once, so that a language with as many
    different texts as it gives, or fewer, gives all of them.
    """
    h = F.xxhash64("text")
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null and length(text) > 0")
    texts = written(rows.groupBy("lang", h.alias("h")).agg(F.count("*").alias("n")), "lang-texts")
    counts = texts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").collect()  # a row for each language
    if not counts:
        return {}
    docs_per_lang = min(docs_per_lang, max(1, docs // len(counts)))
    drawn = texts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= docs_per_lang).select("lang", "h", "r")
    some = rows.withColumn("h", h).join(F.broadcast(drawn), ["lang", "h"]).select("lang", "r", letters(F.col("text")).alias("text")).distinct()
    out: dict[str, list[str]] = {r.lang: [] for r in counts}
    for r in some.orderBy("lang", F.desc("r"), "text").collect():  # `docs` rows at most, or one for each language
        out[r.lang].append(r.text)
    return {k: " ".join(v).encode() for k, v in out.items()}


class Classifier:
    """Sizes of a text under each language's dictionary, in blocks of whole bytes that cover it all."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 6, block: int = 4096):
        import zstandard as z

        self.langs, self.block = list(dictionaries), block
        self.packers = []
        for content in dictionaries.values():
            params = z.ZstdCompressionParameters.from_level(level, source_size=block, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.packers.append(z.ZstdCompressor(dict_data=d, compression_params=params))

    def sizes(self, text: bytes) -> list[int]:
        blocks = [text[i : i + self.block] for i in range(0, len(text), self.block)]
        return [sum(len(p.compress(b)) for b in blocks) for p in self.packers]

    def predict(self, text: bytes) -> tuple[str, float]:
        """The language of the smallest size (ties: the first) and how much smaller it is than the next, from 0 to 1."""
        if not self.langs:
            return UNKNOWN, 0.0
        sizes = self.sizes(text)
        if len(sizes) == 1:
            return self.langs[0], 1.0
        first, second = sorted(sizes)[:2]
        return self.langs[sizes.index(first)], (second - first) / max(second, 1)


def classify(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), min_margin: float = 0.004) -> DataFrame:
    """The kept columns, lang_pred, score and rejected; one row per row.

    A null text and one without a letter are `und` with score 0, rejected; so is all if nothing was
    learned. Other texts get a learned language; one with a score below min_margin is rejected.
    """
    spark = df.sparkSession
    models = spark.sparkContext.broadcast(dictionaries)  # see the bound of fit()
    few = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.when(F.col(text_col).rlike(r"\p{L}"), letters(F.col(text_col))).cast("binary").alias("t"))
    schema = few.drop("t").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        model = Classifier(models.value)
        for b in batches:
            found = [(UNKNOWN, 0.0) if t is None else model.predict(t) for t in (x.as_py() for x in b.column(b.num_columns - 1))]
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=[*b.schema.names[:-1], "lang_pred", "score"])

    out = few.mapInArrow(run, schema)
    rejected = (F.col("lang_pred") == UNKNOWN) | (F.col("score") < min_margin)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", rejected.alias("rejected"))


def fold(id_col: str, n: int):
    """crc32 of an id as text, modulo n; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n)), F.lit(0))


def accepted(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = 0.004) -> DataFrame:
    """The rows of df whose text is not rejected, all columns as they are."""
    whole = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.col(text_col).alias("_t"))
    kept = classify(whole, dictionaries, "_t", ("row",), min_margin).where(~F.col("rejected"))
    return kept.select("row.*")
