"""Language-model scores from a lattice of subword pieces.

The pieces are those of an existing vocabulary. A piece's score is the logarithm of its unigram
probability in the training texts, with the ranks of the vocabulary's own scores as prior. A text's
probability is the sum over all its segmentations, by a forward recursion in log space: no piece
crosses words, so that it is the product of its words' sums and of the end of the text. Each
different word of the corpus is summed once.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import release, written

START = "▁"
FLUSH = 400_000


def pieces_of(model_path: str) -> list[str]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())]


def segmented(model_path: str, words: list[str], counts: list[int]) -> np.ndarray:
    """How often each piece occurs in the vocabulary's own segmentation of the words."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    out = np.zeros(sp.get_piece_size())
    for at in range(0, len(words), 4096):
        got = sp.encode([w.replace(START, " ") for w in words[at : at + 4096]], num_threads=1)
        ids = np.fromiter((i for x in got for i in x), np.int64)
        out += np.bincount(ids, np.repeat(np.array(counts[at : at + 4096], float), [len(x) for x in got]), len(out))
    return out


def piece_scores(pieces: list[str], counts: np.ndarray, ends: int) -> tuple[dict[str, float], float]:
    """Natural log probabilities of the pieces, and that of the end of a text."""
    rank = 1.0 / (np.arange(len(pieces)) + 1.0)  # the vocabulary's scores fall with the rank
    prior = rank / rank.sum()
    weight = float(len(pieces))
    total = counts.sum() + ends + weight
    p = np.log((counts + prior * (weight - 1)) / total)
    return dict(zip(pieces, p.tolist())), math.log((ends + 1) / total)


class Lattice:
    def __init__(self, scores: dict[str, float]):
        self.bytes = [scores.get(f"<0x{i:02X}>", -math.inf) for i in range(256)]
        self.scores = {k: v for k, v in scores.items() if k and not (k[0] == "<" and k[-1] == ">" and len(k) > 2) and START not in k[1:]}
        self.longest = max(map(len, self.scores), default=1)

    def word(self, word: str) -> float:
        """The natural log of the sum over all segmentations of a word; a character may also be its bytes."""
        get, longest, exp, log = self.scores.get, self.longest, math.exp, math.log
        w = START + word.replace(START, "")  # a marker within a word is only its bytes
        n = len(w)
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        for i in range(n):
            arcs = into[i]
            if not arcs:
                continue
            if len(arcs) == 1:
                a = arcs[0]
            else:
                m = max(arcs)
                a = m + log(sum([exp(x - m) for x in arcs]))
            for j in range(i + 1, min(n, i + longest) + 1):
                s = get(w[i:j])
                if s is not None:
                    into[j].append(a + s)
            c = w[i]
            if i or get(c) is None:
                into[i + 1].append(a + sum([self.bytes[x] for x in (START if c == "" else c).encode()]))
        m = max(into[n])
        return m + log(sum([exp(x - m) for x in into[n]]))


def _batch(cols, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def word_counts(rows: DataFrame) -> DataFrame:
    """word and c, its count in rows with `train`, for every word of any row; rows have train and t (UTF-8)."""
    schema = pa.schema([("word", pa.string()), ("c", pa.int64())])

    def run(batches):
        learnt, other = Counter(), set()
        for b in batches:
            for train, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (learnt if train else other).update(t.lower().split())
                if len(learnt) + len(other) > FLUSH:
                    other.difference_update(learnt)
                    yield _batch(([k.decode() for k in [*learnt, *other]], [*learnt.values(), *[0] * len(other)]), schema)
                    learnt, other = Counter(), set()
        other.difference_update(learnt)
        yield _batch(([k.decode() for k in [*learnt, *other]], [*learnt.values(), *[0] * len(other)]), schema)

    return rows.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def score(df: DataFrame, model_path: str, train, id_col: str = "doc_id", text_col: str = "text", frequent: int = 131_072) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `train` is a condition on df; held_out is its negation. Words are maximal runs of bytes that are
    not ASCII white space, A-Z in lower case; the end of a text is one more token. base_score is the
    add-half unigram score of the tokens in log10, score the lattice's log10 probability. A null text
    is empty (its end alone); a null condition is false; an empty table gives no rows. The words seen
    most often, `frequent` of them at most, are scored in the tasks that read the texts; the others
    meet their counts in a join.
    """
    spark = df.sparkSession
    rows = df.select(F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"), F.col(id_col).alias("id"))
    ends = rows.where("train").count()
    counted = written(word_counts(rows.select("train", "t")), "lm-words")
    sums = counted.where("c > 0").agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    total, kinds = (sums.n or 0) + ends, sums.v + (ends > 0)
    pieces = pieces_of(model_path)

    def tally(batches):
        out = np.zeros(len(pieces))
        for b in batches:
            out += segmented(model_path, b.column(0).to_pylist(), b.column(1).to_pylist())
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["piece", "n"])

    counts = np.zeros(len(pieces))
    for r in counted.where("c > 0").mapInArrow(tally, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():  # one row per piece at most
        counts[r.piece] = r.n
    model = spark.sparkContext.broadcast(piece_scores(pieces, counts, ends))

    def sum_up(batches):
        lattice = Lattice(model.value[0])
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([lattice.word(w) / math.log(10) for w in b.column(0).to_pylist()], pa.float64())], names=["word", "c", "lp"])

    scored = written(counted.mapInArrow(sum_up, "word string, c long, lp double"), "lm-scores")
    release(counted)
    top = {r.word.encode(): (r.c, r.lp) for r in scored.where("c > 0").orderBy(F.desc("c"), "word").limit(frequent).collect()}
    known = spark.sparkContext.broadcast(top)
    down = total + 0.5 * (kinds + 1)
    base_end = math.log10((ends + 0.5) / down)
    few = rows.select(F.monotonically_increasing_id().alias("rid"), "id", (~F.col("train")).alias("held_out"), "t")
    schema = few.drop("t").schema
    for c, kind in (("n_tokens", "long"), ("n_known", "long"), ("base", "double"), ("lp", "double"), ("rest", T.ArrayType(T.StringType())), ("times", T.ArrayType(T.LongType()))):
        schema = schema.add(c, kind)

    def read(batches):
        get, end = known.value.get, model.value[1] / math.log(10)
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column(3).to_pylist():
                words = Counter(t.lower().split())
                n, k, base, lp, rest, times = 1, int(ends > 0), base_end, end, [], []
                for w, c in words.items():
                    n += c
                    found = get(w)
                    if found is None:
                        rest.append(w.decode())
                        times.append(c)
                    else:
                        k += c
                        base += c * math.log10((found[0] + 0.5) / down)
                        lp += c * found[1]
                for col, x in zip(cols, (n, k, base, lp, rest, times)):
                    col.append(x)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, kind) for c, kind in zip(cols, kinds))], names=schema.names)

    docs = written(few.mapInArrow(read, schema), "lm-docs")
    rare = docs.select("rid", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("rid", F.col("x.rest").alias("word"), F.col("x.times").alias("k"))
    more = rare.join(scored, "word").groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("n_more"),
        F.sum(F.col("k") * F.log10((F.col("c") + 0.5) / F.lit(down))).alias("base_more"),
        F.sum(F.col("k") * F.col("lp")).alias("lp_more"),
    )
    out = docs.drop("rest", "times").join(more, "rid", "left")
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("n_more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"),
        (F.col("lp") + F.coalesce("lp_more", F.lit(0.0))).alias("score"),
    )
