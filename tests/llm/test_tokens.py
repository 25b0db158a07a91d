import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from veilframe.llm import bpe, lattice_lm, packing


def test_packing_pieces_and_sequences(spark, docs, table):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {}
    for i, t, *_ in docs:
        want.setdefault(i, np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4"))
    pieces = packing.pack(table, P.path("byte_bpe_50k.json"), P.PATTERN)
    rows = pieces.toPandas()
    got = {i: np.zeros(len(x), int) for i, x in want.items()}
    for r in rows.itertuples():
        x = want[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and zlib.crc32(x.tobytes()) == r.ids_crc32 and np.array_equal(np.frombuffer(r.ids, "<u2"), x)
        got[r.doc_id][r.start : r.start + r.length] += 1
    for i, x in got.items():
        assert (x == (2 if i == 1 else 1)).all()  # document 1 is there twice
    for s, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == np.append(0, own.length.cumsum()[:-1]).tolist()
        if s != rows.sequence_id.max():
            assert own.length.sum() == 1024
    whole = packing.sequences(pieces).toPandas()
    assert all(len(x) == 1024 for x in whole.ids) and len(whole) == rows.sequence_id.nunique()
    # Every window holds the sources in the proportions of all tokens, but for rounding.
    share = rows.groupby("source").length.sum() / rows.length.sum()
    first = rows[rows.sequence_id < rows.sequence_id.max()].groupby(["sequence_id", "source"]).length.sum().unstack(fill_value=0)
    assert (abs(first - 1024 * share) <= 8).all(axis=None)


def test_packing_ids_are_those_of_the_library():
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encode = packing.load_encoding(P.path("byte_bpe_50k.json"), P.PATTERN)
    assert encode("a<|endoftext|>b").tolist() == [64, 50256, 65]
    rng = random.Random(1)
    parts = ["<|endoftext|>", "<|", "endoftext", "|>", " ", "  ", "\n", "\t", "\x00", "a", "the", "1", "'s", "é", "漢", "😀", "Ω", "\u0301"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_packing_targets_carry_deficits():
    phases = packing.schedule(np.array([5000, 3000, 10]), np.array([0.7, 0.3, 0.0]), 100, 4)
    assert sum(p.length * p.repeats for p in phases) == 8010
    seen = np.zeros(8010, int)
    for q, n in enumerate((5000, 3000, 10)):
        a, g, k = packing.place(phases, q, 0, n)
        assert k.sum() == n
        for start, size in zip(g, k):
            seen[start : start + size] += 1
    assert (seen == 1).all()


def test_packing_of_many_sources(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(60)), "hot" if i % 2 else f"s{i % 300}") for i in range(3000)] + [(9000, "", "rare"), (9001, None, "rarer")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    named = {i: s for i, _, s in rows}

    def packed(**more):
        out = packing.pack(df, P.path("byte_bpe_50k.json"), P.PATTERN, ids=False, **more).toPandas()
        assert all(named[i] == s for i, s in zip(out.doc_id, out.source))
        got = out.groupby("doc_id").agg(a=("length", "sum"), b=("doc_tokens", "first"))
        assert len(got) == len(rows) and (got.a == got.b).all()
        at = np.sort((out.sequence_id * 1024 + out.offset).to_numpy())
        assert len(np.unique(at)) == len(at) and out.length.sum() == (out.sequence_id * 1024 + out.offset + out.length).max()
        return out

    for more in ({}, {"cycle": 16}):
        out = packed(**more)
        share = out[out.source == "hot"].length.sum() / out.length.sum()
        hot = out[out.source == "hot"].groupby("sequence_id").length.sum()
        assert (abs(hot[hot.index < 0.9 * out.sequence_id.max()] - 1024 * share) <= 16).all()
    out = packed(targets={"hot": 0.75, "s0": 0.25}, cycle=1)  # a cycle that s0 can fill
    first = out[out.sequence_id < 1]
    assert set(first.source) == {"hot", "s0"} and abs(first[first.source == "hot"].length.sum() - 768) <= 2
    for bad in ({"none": 1.0}, {"hot": -1.0}, {}):
        with pytest.raises(ValueError):
            packing.pack(df, P.path("byte_bpe_50k.json"), P.PATTERN, targets=bad)


def test_packing_empty(spark, table):
    assert packing.pack(table.where("false"), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(codec, library, docs, monkeypatch):
    rng = random.Random(1)
    texts = [t or "" for _, t, *_ in docs] + ["a" * 5000, " " * 3001 + "x", "ab " * 4000, "\n\n \n", "don't  I'll we've"]
    texts += ["".join(rng.choice("ab' \n1é漢s😀tl") for _ in range(rng.randint(1, 400))) for _ in range(300)]
    for leaf in (bpe.LEAF_CHARS, 16):
        monkeypatch.setattr(bpe, "LEAF_CHARS", leaf)
        for t in texts:
            ids = np.frombuffer(codec.encode(t), "<u4")
            assert ids.tolist() == library.encode_ordinary(t)
            assert codec.decode(ids) == t.encode()


def test_bpe_table(spark, table, docs):
    out = bpe.encode_documents(table, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert len(out) == len(docs) and all(r.n_tokens * 4 == len(r.ids) for r in out)
    assert bpe.encode_documents(table.where("false"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_lattice_sums_all_segmentations():
    import itertools
    import math

    scores = {"▁": -2.0, "▁a": -1.0, "a": -1.5, "b": -2.5, "ab": -1.2, "▁ab": -3.0, "ba": -2.2}
    x = lattice_lm.Lattice(scores)
    for word in ("a", "ab", "aba", "abba", "babab"):
        w, total = "▁" + word, 0.0
        for cuts in itertools.product((0, 1), repeat=len(w) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(w)]
            parts = [w[a:b] for a, b in zip(at, at[1:])]
            if all(p in scores for p in parts):
                total += math.exp(sum(scores[p] for p in parts))
        assert x.word(word) == pytest.approx(math.log(total))


def test_scores_against_brute_force(spark, table, docs):
    import math
    import re
    from collections import Counter

    from pyspark.sql import functions as F

    for frequent in (131_072, 10):
        out = lattice_lm.score(table, P.path("piece_bpe_32k.model"), F.col("doc_id") % 3 != 0, frequent=frequent).toPandas()
        low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x7f" else c for c in t or ""))
        c = Counter()
        for i, t, *_ in docs:
            if i % 3:
                c.update([*low(t), None])
        n, v = sum(c.values()), len(c)
        want = sorted((i, len(low(t)) + 1, sum(c[w] > 0 for w in [*low(t), None]), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*low(t), None]), 6)) for i, t, *_ in docs)
        assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out.itertuples()) == want
        assert (out.train_tokens == n).all() and (out.score < 0).all() and (out.held_out == (out.doc_id % 3 == 0)).all()
    assert lattice_lm.score(table.where("false"), P.path("piece_bpe_32k.model"), F.lit(True)).count() == 0
