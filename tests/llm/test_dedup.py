import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilframe.llm import linededup, pq, simhash, suffixes
from veilframe.llm._common import connected_components


def components(n, pairs):
    comp = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            a = min(comp[i], comp[j])
            changed |= comp[i] != a or comp[j] != a
            comp[i] = comp[j] = a
    return comp


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(300, 360)]
    got = dict(connected_components(spark.createDataFrame([(a, b) for a, b in pairs] + [(None, 1)], "u long, v long")).collect())
    want = components(361, pairs)
    assert got == {i: want[i] for p in pairs for i in p if p[0] != p[1]} | {i: want[i] for i in got}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def line_classes(spark, lines, *how):
    df = spark.createDataFrame([(x,) for x in lines], "key string")
    named = df.distinct().select("key", F.struct(*linededup.name_of(F.col("key"))).alias("node"))
    got = {}
    for r in named.join(connected_components(linededup.links(df, *how)), "node").collect():
        got.setdefault(tuple(r.component), set()).add(r.key)
    return sorted(sorted(x) for x in got.values() if len(x) > 1)


def edited(rng, line, n, letters):
    y = list(line)
    for _ in range(n):
        at = rng.randrange(len(y) + 1)
        y[at : at + rng.randint(0, 1)] = rng.choice(["", *letters])
    return "".join(y)


@pytest.mark.parametrize("threshold,per_edit,block", [(2, 8, 256), (2, 8, 8), (1, 4, 64), (2, 1, 16), (3, 8, 32)])
def test_line_links_against_brute_force(spark, threshold, per_edit, block):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé漢😀 c") for _ in range(rng.randint(1, 40))).strip() for _ in range(60)]
    lines = {*base, *(edited(rng, rng.choice(base), rng.randint(1, 3), "abé") for _ in range(120)), *(f"Number {i:03} of a template" for i in range(0, 300, 3))}
    lines = sorted(lines - {""})
    pairs = [(i, j) for i, a in enumerate(lines) for j, b in enumerate(lines[:i]) if edits(a, b) <= min(threshold, max(len(a), len(b)) // per_edit)]
    comp = components(len(lines), pairs)
    want = sorted([x for x, d in zip(lines, comp) if d == c] for c in set(comp) if comp.count(c) > 1)
    assert line_classes(spark, lines + lines[:50], threshold, per_edit, block) == want and want


def test_line_sketches_rule_out_only_what_is_too_far(spark):
    """An edit changes four bits of a sketch at most; variants of a line by words, which share most of it, are nearly all ruled out."""
    rng = random.Random(4)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(30)] + ["a", "é漢😀", "ab ab ab ab"]
    near = [(a, edited(rng, a, n, "aé😀 "), n) for a in base for n in (1, 2, 3) for _ in range(20)]
    shared = base[0].split(" ")
    far = [" ".join([*shared[:20], *(rng.choice(words) if rng.random() < 0.1 else x for x in shared[20:])]) for _ in range(60)]
    pairs = [(a, b, n) for a, b, n in near if b] + [(a, b, 0) for i, a in enumerate(far) for b in far[:i] if edits(a, b) > 2]
    df = spark.createDataFrame(pairs, "a string, b string, n int")
    apart = F.bit_count(linededup.sketch(linededup.wide(F.col("a"))).bitwiseXOR(linededup.sketch(linededup.wide(F.col("b")))))
    got = df.select("n", apart.alias("apart")).collect()
    assert all(r.apart <= 4 * r.n for r in got if r.n)
    ruled = [r.apart > 8 for r in got if not r.n]
    assert len(ruled) > 1000 and sum(ruled) >= 0.95 * len(ruled)


def test_line_template_of_thousands_of_variants(spark):
    """Every number from 0 to 1999 is joined with others by one digit; far ones have three or four edits and are joined by a chain."""
    lines = [f"Customer {i:04} has called about an invoice." for i in range(2000)]
    far = [f"Customer {a}{b}{c}{d}{e} has called about an invoice." for a, b, c, d, e in ["vwxyz", "qrstu"]]
    assert line_classes(spark, lines + far) == [lines]


def test_line_report(spark):
    rows = [(1, "one line of text that is long enough\nshort\n\nshort"), (2, "one line of text that is lonq enough\nother"), (3, None), (4, ""), (None, "short"), (1, "one line of text that is long enough\nshort\n\nshort")]
    df = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], "doc_id long, text string, lines int, _lines int, d int")
    got = sorted((r.doc_id or 0, r.n_lines, r.dropped, r.kept_chars) for r in linededup.report(df).collect())
    assert got == [(0, 1, "0", 0), (1, 4, "3", 41), (1, 4, "3", 41), (2, 2, "0", 5), (3, 0, "", 0), (4, 1, "", 0)]
    kept = {r.doc_id: r.text for r in linededup.deduplicate(df).collect()}
    assert kept == {1: "one line of text that is long enough\nshort\n", 2: "other", 3: None, 4: ""} and linededup.deduplicate(df).columns == df.columns
    assert linededup.report(df.where("false")).count() == 0


@pytest.mark.parametrize("radius,words,verify,block", [(2, 1, None, 2048), (2, 1, None, 4), (7, 1, None, 16), (9, 4, 40, 2048)])
def test_simhash_links(spark, radius, words, verify, block):
    rng = np.random.default_rng(4)
    f = rng.integers(0, 2**64, (120, words), np.uint64)
    more = [f]
    for bits in (1, 2, 3, 6, 8, 10):
        y = f[:20].copy()
        for row in y:
            for b in rng.choice(64 * words, bits, replace=False):
                row[b // 64] ^= np.uint64(1 << int(b % 64))
        more.append(y)
    f = np.unique(np.concatenate(more), axis=0)
    rows = [(i, i, *(int(x) for x in r.view(np.int64))) for i, r in enumerate(f)]
    nodes = spark.createDataFrame(rows, "m long, id long, fp long" + "".join(f", w{i} long" for i in range(1, words)))
    d = np.bitwise_count(f[:, None] ^ f[None])
    near = (d[:, :, 0] <= radius) & (d.sum(2) <= (verify or 10**6))
    pairs = [(i, j) for i, j in zip(*np.nonzero(near)) if i < j]
    got = [(r.u.m, r.v.m) for r in simhash.links(nodes, radius, words, verify, block).collect()]
    assert all(near[i, j] for i, j in got)
    assert components(len(f), got) == components(len(f), pairs)


def test_simhash_documents(spark, table, docs):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(table).collect()}
    f = [simhash.fingerprint(t.encode() if t else None)[0] for _, t, *_ in docs]
    pairs = [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 2]
    comp = components(len(f), pairs)
    least = {c: min(docs[i][0] for i in range(len(f)) if comp[i] == c) for c in comp}
    assert got == {(docs[i][0], f"{f[i]:016x}"): least[comp[i]] for i in range(len(f))}
    assert simhash.near_duplicates(table.where("false")).count() == 0


def test_simhash_stage(spark, table):
    kept = [r.doc_id for r in simhash.deduplicate(table).collect()]
    assert not set(range(100, 105)) & set(kept) and set(range(60)) <= set(kept) and {120, 121, 122, 123, 130, 131, 132, 133, 134} <= set(kept)
    assert kept.count(1) == 2  # rows of the same id and text are one document


@pytest.mark.parametrize("block", [512, 6])
def test_simhash_stage_against_brute_force(spark, block):
    """Copies with 1 to 15 changed words: those linked by the sets of shingles go, no others, whatever the block."""
    rng = random.Random(8)
    rows = []
    for i in range(30):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(120, 200))]
        rows.append((f"a{i:02}", " ".join(w)))
        for j in range(4):
            x = list(w)
            for _ in range(rng.choice([0, 1, 1, 2, 8, 15])):
                x[rng.randrange(len(x))] = "changed"
            rows.append((f"b{i:02}{j}", " ".join(x)))
    rows += [(None, rows[0][1]), (None, "x"), ("c", "X "), ("d", None), ("e", " "), ("f", " ")]
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for _, t in rows for w in [(t or "").lower().split()]]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][1] and rows[i][1].strip() and sets[i] & sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    comp = components(len(rows), pairs)
    first = {}
    for at in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or "", k)):
        first.setdefault(comp[at], at)
    want = sorted((rows[k] for k in first.values()), key=str)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id string, text string, t int, _t int, c int")
    out = simhash.deduplicate(df, block=block)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == want and out.columns == df.columns and 40 < len(want) < 120


def test_repeated_passages(spark, table, docs):
    found = [r for r in suffixes.passages(table.where("doc_id <> 1")).collect()]
    shared = {r.doc_id: r for r in found if 120 <= r.doc_id < 124}
    assert set(shared) == {120, 121, 122, 123}
    assert [shared[i].dropped for i in range(120, 124)] == [False, True, True, True] and all(abs(r.hi - r.lo - 70) <= 1 for r in shared.values())
    text = dict((i, t) for i, t, *_ in docs)
    for r in found:
        window = text[r.doc_id].lower().split()[r.lo : r.lo + 50]
        assert any(" ".join(window) in " ".join((t or "").lower().split()) for i, t in text.items() if i != r.doc_id)
    kept = {r.doc_id: r.text for r in suffixes.remove(table.where("doc_id <> 1")).collect()}
    assert len(kept[121].split()) in (79, 80, 81) and kept[120] == text[120] and kept[130] is None and kept[134] == text[134]
    assert suffixes.passages(table.where("false")).count() == 0


def passages_by_hand(rows, n):
    """{(row's id and text, word): whether an earlier document has it} of the words in windows of n words that other documents have."""
    docs = sorted({(i is None, i, hash_of(t), t) for i, t in rows if t is not None}, key=lambda x: (x[0], x[1] if not x[0] else 0, x[2]))
    grams, out = {}, {}
    for at, (_, _, _, t) in enumerate(docs):
        w = t.lower().split()
        for p in range(len(w) - n + 1):
            grams.setdefault(tuple(w[p : p + n]), set()).add(at)
    for at, (_, i, _, t) in enumerate(docs):
        w = t.lower().split()
        for p in range(len(w) - n + 1):
            own = grams[tuple(w[p : p + n])]
            if len(own) > 1:
                for q in range(p, p + n):
                    out[i, t, q] = out.get((i, t, q), False) or min(own) < at
    return out


def hash_of(text):
    import xxhash

    x = xxhash.xxh64_intdigest(text.encode(), 42)
    return x - (1 << 64) if x >> 63 else x


def found_passages(spark, rows, kind, **how):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], f"doc_id {kind}, text string, t int, _d int")
    text = {(i, hash_of(t)): t for i, t in rows if t is not None}
    out = {}
    for r in suffixes.passages(df, words=12, k=4, **how).collect():
        for p in range(r.lo, r.hi):
            assert (r.doc_id, text[r.doc_id, r.t], p) not in out
            out[r.doc_id, text[r.doc_id, r.t], p] = r.dropped
    return out


def passage_rows(rng):
    """Documents that share passages, some around a common text that is the minimiser of most windows around it."""
    words = [f"w{i}" for i in range(2000)]

    def own(n):
        return [rng.choice(words) for _ in range(n)]

    def least_key(w):
        h, n = suffixes.word_hashes(pa.array([" ".join(w)]))
        return suffixes.minimisers(h, np.zeros(len(h)), 8, 4)[1].min()

    common = min((own(8) for _ in range(300)), key=least_key)
    rows = [[*own(12), *common, *own(12)] for _ in range(200)]
    for i in range(0, 60, 2):  # before the common text, so that what follows it sorts them apart
        rows[i + 1][8:12] = rows[i][8:12]
    rows += [[rng.choice(words[:60]) for _ in range(rng.randint(5, 60))] for _ in range(60)]
    for _ in range(40):
        a, b = rng.sample(range(200, 260), 2)
        at, n = rng.randrange(len(rows[a]) // 2 + 1), rng.randint(8, 25)
        rows[b][len(rows[b]) // 2 : len(rows[b]) // 2] = rows[a][at : at + n]
    rows += [[*own(5), *rows[0][2:30], *own(5)] for _ in range(30)]  # many have one passage
    return [" ".join(r) for r in rows]


@pytest.mark.parametrize("kind,most,parts,batch,sent", [("long", 16_384, 4, 10_000, None), ("string", 8, 16, 16, None), ("long", 40, 7, 64, None), ("long", 8, 1, 16, 0), ("string", 16_384, 64, 10_000, 0), ("long", 8, 5, 100, 3)])
def test_passages_against_brute_force(spark, monkeypatch, kind, most, parts, batch, sent):
    rng = random.Random(11)
    texts = passage_rows(rng)
    rng.shuffle(texts)
    ids = [2**60 + i if kind == "long" else f"n{i}" for i in range(len(texts))]
    rows = list(zip(ids, texts)) + [(None, texts[3]), (None, texts[3]), (None, " ".join([texts[4]] * 2)), (ids[5], texts[5]), (ids[6], texts[7]), (ids[8], None), (ids[9], ""), (None, None)]
    if sent is not None:
        monkeypatch.setattr(suffixes, "BROADCAST_KEYS", sent)
    monkeypatch.setattr(suffixes, "SLICE", 50 * parts)
    monkeypatch.setattr(suffixes, "ROWS", 20 * parts)
    conf = {"spark.sql.shuffle.partitions": parts, "spark.sql.execution.arrow.maxRecordsPerBatch": batch}
    before = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        got = found_passages(spark, rows, kind, most=most)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == passages_by_hand(rows, 12) and got


@pytest.mark.parametrize("most,bits,joined", [(16_384, 20, False), (8, 20, False), (8, 20, True)])
def test_passages_by_a_filter_of_keys(spark, monkeypatch, most, bits, joined):
    """Beyond the list's bound keys go as a filter, with the same results and without a join of the texts; joined: beyond that of the filter."""
    rng = random.Random(12)
    rows = list(enumerate(passage_rows(rng)))
    made = set()
    monkeypatch.setattr(suffixes, "BROADCAST_KEYS", 20)
    monkeypatch.setattr(suffixes, "FILTER_BITS", bits)
    for name in ("_marked", "_filter"):
        monkeypatch.setattr(suffixes, name, lambda *a, f=getattr(suffixes, name), name=name: made.add(name) or f(*a))
    if joined:
        monkeypatch.setattr(suffixes, "FILTER_KEYS", 20)
    assert found_passages(spark, rows, "long", most=most) == passages_by_hand(rows, 12)
    assert made == {"_marked" if joined else "_filter"}


def test_a_filter_lets_its_keys_pass(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**63), 2**63, 50_000)
    got = suffixes._filter(spark.createDataFrame([(x,) for x in keys.tolist()], "key long"), np.sort(keys[:100])).value
    assert not got.passes(keys[:100]).any() and got.passes(keys[100:]).all() and got.passes(rng.integers(-(2**63), 2**63, 50_000)).mean() < 0.05


def test_a_passage_repeated_within_one_document_only(spark):
    text = " ".join(f"a{i}" for i in range(30))
    assert found_passages(spark, [(None, f"{text} {text}"), (1, "other")], "long") == {}


def test_words_are_split_like_bytes():
    texts = ["", " ", "A\x1cb c\x85d\u00a0e\u2003F\x0bg\x0c\rÄ\t\n z", "\x00 x", "ab ba a b", " x", "x ", "y"]
    texts = [f"{t} N{i}" if i > 7 else t for i in range(48) for t in texts]
    for at, size in ((0, 384), (0, 2), (0, 0), (1, 1), (13, 50), (383, 1)):
        want = [t.encode().lower().split() for t in texts[at : at + size]]
        h, n = suffixes.word_hashes(pa.array(texts, pa.string()).slice(at, size))
        flat = [w for x in want for w in x]
        assert n.tolist() == [len(w) for w in want] and len(h) == len(flat)
        assert len(set(zip(h.tolist(), flat))) == len(set(h.tolist())) == len(set(flat))


def vectors(rng):
    base = rng.normal(size=(150, 16))
    near = base[:60] + 0.12 * rng.normal(size=(60, 16))
    hot = base[0] + 0.05 * rng.normal(size=(80, 16))
    x = np.concatenate([base, near, hot, base[:10]]).astype(np.float32)
    return [x[i].tolist() for i in range(len(x))] + [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None], [float("inf"), 1.0], [1e30, 1e30], [1e-30, 1e-30], [3.0], [5.0], [-2.0]]


@pytest.mark.parametrize("slack,block", [(4.0, 512), (3.0, 16)])
def test_embeddings_against_brute_force(spark, slack, block):
    v = vectors(np.random.default_rng(6))
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, n long")
    got = sorted(pq.near_duplicates(df, slack=slack, block=block).collect())

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b or not np.isfinite([*a, *b]).all() or not any(a) or not any(b):
            return -1
        a, b = np.array(a, np.float32).astype(np.float64), np.array(b, np.float32).astype(np.float64)
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b)

    link = np.array([[i != j and cosine(a, b) >= 0.95 for j, b in enumerate(v)] for i, a in enumerate(v)])
    found, true = sum(r.n_links for r in got), int(link.sum())
    assert 0.98 * true <= found <= true
    if slack == 4.0:  # the root of the dimension: exact
        comp = components(len(v), list(zip(*np.nonzero(link))))
        assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in got] == [(i, int(link[i].sum()), comp[i], comp[i] == i) for i in range(len(v))]
    assert pq.near_duplicates(df.where("false")).count() == 0


def test_embeddings_without_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [0.0, 1.0]), (None, None)], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in pq.near_duplicates(df).collect())
    assert got == [(0, 0, 0, False), (0, 0, 0, False), (0, 1, 3, False), (3, 1, 3, True)]


def test_probe_recall_grows_to_all():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    home, found = pq.probes(x, x[:20], 2.0)
    assert all(set(range(h + 1, 20)) == set(f) for h, f in zip(home, found))
    index = pq.fit(x, 10, 4)
    codes, lost = index.encode(x - index.centres[0])
    assert codes.shape == (500, 4) and (lost >= 0).all()
