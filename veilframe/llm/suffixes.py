"""Repeated passages by a sparse suffix array.

Of each document only the suffixes at minimiser positions are kept: in every window of `words` words,
the one that starts the `k` words of least hash. Two equal passages of that length keep a suffix at
the same place. Keys of `k` words are counted first, as hashes alone; the suffixes of those that two
documents have are dealt by key and sorted there, neighbours are compared, and matches are extended
word by word to the right and to the left. All windows of `words` words around a suffix are settled
exactly, so that results do not depend on partitions. Keys of very many suffixes are cut by what
stands on either side, and then matched by grouping the hashes of their windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import fits, fresh, written

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
#: Keys are sent to all tasks up to so many (8 MB), beyond that up to so many as a filter of at most 1 << FILTER_BITS bits (32 MB).
BROADCAST_KEYS = 1_000_000
FILTER_KEYS, FILTER_BITS = 1 << 26, 28
#: Bytes of text whose words are taken at once, and rows that are compared at once.
SLICE, ROWS = 1 << 19, 20_000
ALL = "all"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_BYTES = np.arange(256, dtype=np.uint64)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + np.uint64(32), _BYTES)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts (sums over their bytes, each mixed with its place), and how many words each text has."""
    texts = texts.cast(pa.large_binary())
    _, ends, raw = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(raw or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    space = _SPACE[raw]
    start = ~space
    start[1:] &= space[:-1]
    inner = ends[ends < len(raw)]
    start[inner] = ~space[inner]  # a text begins a word
    first = np.flatnonzero(start)
    n = np.diff(np.searchsorted(first, ends))
    if not len(first):
        return np.zeros(0, np.uint64), n
    place = np.arange(len(raw))
    place[first[0] :] -= np.repeat(first, np.diff(np.append(first, len(raw))))
    mixed = _mix((place.view(np.uint64) << np.uint64(8) | _LOWER[raw]) * _P + _P)
    mixed[space] = 0
    return _mix(np.add.reduceat(mixed, first)), n


def minimisers(h: np.ndarray, doc: np.ndarray, words: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the kept suffixes in the word hashes of documents one after another, and their keys; leftmost among equals."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(h) < words:
        return none
    whole = np.flatnonzero(doc[: len(h) - words + 1] == doc[words - 1 :])  # where windows of one document start
    if not len(whole):
        return none
    g = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        g = g * _P + h[j : len(h) - k + 1 + j]
    g = _mix(g)

    def least(v, i, step):
        """Of each window and the one `step` after it."""
        left = v[: len(v) - step] <= v[step:]
        return np.where(left, v[: len(v) - step], v[step:]), np.where(left, i[: len(i) - step], i[step:])

    v, i, size, w = g, np.arange(len(g)), 1, words - k + 1
    while size * 2 <= w:
        v, i = least(v, i, size)
        size *= 2
    if size < w:
        v, i = least(v, i, w - size)
    at = i[whole]
    at = at[np.append(True, np.diff(at) != 0)]
    return at, g[at]


class Suffixes:
    """The kept suffixes of some texts. Those of a text that have the same words around them, all within it, are one, with all its places."""

    def __init__(self, texts: pa.Array, words: int, k: int):
        h, n = word_hashes(texts)
        doc = np.repeat(np.arange(len(n)), n)
        at, key = minimisers(h, doc, words, k)
        self.words, self.before = words, words - k
        first = np.cumsum(n) - n
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h), _P)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1])])
        self.back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h), _INVERSE)]))
        self.short = np.concatenate([np.zeros(self.before, np.uint32), _mix(h).astype(np.uint32), np.zeros(words, np.uint32)])
        row = doc[at] if len(at) else np.zeros(0, np.int64)
        pos = at - first[row]
        right, left = np.minimum(words, n[row] - pos), np.minimum(self.before, pos)
        around = self.hash(at - left, left + right) + _mix((row * 4096 + right * 64 + left).astype(np.uint64))
        _, one, group = np.unique(around, return_index=True, return_inverse=True)
        places = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(group, minlength=len(one)))).astype(np.int32)), pa.array(pos[np.argsort(group, kind="stable")].astype(np.int32)))
        self.all = {"at": at[one], "key": key[one].view(np.int64), "row": row[one], "right": right[one], "left": left[one], "places": places}
        self.halves = None  # (keys, suffixes) that stand for the suffixes themselves
        self.take(np.arange(len(one)))

    def take(self, use: np.ndarray) -> None:
        """Have those of all suffixes."""
        for c, x in self.all.items():
            setattr(self, c, x.take(pa.array(use)) if c == "places" else x[use])

    def hash(self, start: np.ndarray, words) -> np.ndarray:
        """Of so many words from there."""
        return _mix((self.sums[start + words] - self.sums[start]) * self.back[start])

    def context(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words from suffixes on, and those before them, backwards."""
        view, at = np.lib.stride_tricks.sliding_window_view, self.at[use]
        return view(self.short, self.words)[at + self.before], view(self.short, self.before)[at][:, ::-1]


def _keys(s: Suffixes):
    yield {"key": s.key}, s.row


def _halves(s: Suffixes):
    """Of a suffix two keys: with half of `words` words from it on, and before it. A window around it has one of them whole."""
    half = s.words // 2
    key = s.key.view(np.uint64)
    for start, n, reach, salt in ((s.at, s.words - half, s.right, 0), (s.at - half, half, s.left, 1)):
        use = np.flatnonzero(reach >= n)
        yield (_mix((key[use] + np.uint64(salt)) * _P) ^ s.hash(start[use], n)).view(np.int64), use


def _half_keys(s: Suffixes):
    for key, use in _halves(s):
        yield {"key": key}, s.row[use]


def _contexts(s: Suffixes):
    def binary(x):
        return pa.Array.from_buffers(pa.binary(x.shape[1] * 4), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())

    key, use = (s.key, np.arange(len(s.key))) if s.halves is None else s.halves
    r, l = s.context(use)
    yield {"key": key, "r": binary(r), "l": binary(l), "right": s.right[use].astype(np.int32), "left": s.left[use].astype(np.int32), "places": s.places.take(pa.array(use))}, s.row[use]


def _windows(s: Suffixes):
    """For each number of words from the suffix on, the windows of `words` words around it."""
    some = np.unique(s.halves[1]) if s.halves is not None else np.arange(len(s.key))
    for after in range(s.words - s.before, s.words + 1):
        own = some[(s.right[some] >= after) & (s.left[some] >= s.words - after)]
        if len(own):
            yield {"key": s.hash(s.at[own] - (s.words - after), s.words).view(np.int64), "after": np.full(len(own), after, np.int32), "places": s.places.take(pa.array(own))}, s.row[own]


class Filter:
    """Stands for keys, of which each has two bits; lets some others pass, but none of `less`, which are sorted."""

    def __init__(self, bits: np.ndarray, less: np.ndarray):
        self.bits, self.less, self.shift = bits, less, np.uint64(64 - int(len(bits) * 8).bit_length() + 1)

    def passes(self, x: np.ndarray) -> np.ndarray:
        u = x.view(np.uint64)
        out = ~_among(x, self.less)
        for p in (u >> self.shift, u & np.uint64(len(self.bits) * 8 - 1)):
            out &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def _among(x: np.ndarray, keys: np.ndarray | Filter) -> np.ndarray:
    """Which of x are of the sorted keys, or pass the filter."""
    if isinstance(keys, Filter):
        return keys.passes(x)
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def _suffixes(docs: DataFrame, words: int, k: int, make, more: str, *sets) -> DataFrame:
    """Rows of make() for the suffixes of documents (d, t, w, x: the text, and where there is one, `at`: the keys that count), with d, t and w.

    Sets of keys are broadcast, sorted or as a filter. Suffixes of the first set (if None, all, unless there is a
    second) are taken as they are, those of the second (or ALL) by their halves, which have to be in
    the third, if there is one.
    """
    kinds = {"key": "long", "r": "binary", "l": "binary", "right": "integer", "left": "integer", "after": "integer", "places": T.ArrayType(T.IntegerType())}
    names = more.split(", ")
    schema = T.StructType()
    for c in names:
        schema = schema.add(c, kinds[c])
    for c in ("d", "t", "w"):
        schema = schema.add(c, docs.schema[c].dataType)
    marked = "at" in docs.columns

    def made(part):
        whole, hot, halves = (*(x if x is None or isinstance(x, str) else x.value for x in sets), None, None, None)[:3]
        s = Suffixes(part.column("x"), words, k)
        every = np.arange(len(s.key))
        if marked:  # a list of the keys that count of each text
            lists = part.column("at").to_pylist()
            every = every[[x in own for x, own in zip(s.key.tolist(), map([set(x or ()) for x in lists].__getitem__, s.row.tolist()))]]
        if hot is not None:
            s.take(every if isinstance(hot, str) else every[_among(s.all["key"][every], hot)])
            found = [(h[ok], use[ok]) for h, use in _halves(s) for ok in [slice(None) if halves is None else _among(h, halves)]]
            s.halves = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
            yield from make(s)
            s.halves = None
        if whole is not None or hot is None:
            s.take(every if whole is None else every[_among(s.all["key"][every], whole)])
            yield from make(s)

    def run(batches):
        for b in batches:
            size = np.cumsum(pc.binary_length(b.column("x")).to_numpy().astype(np.int64))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE)))
                part = b.slice(lo, hi - lo)
                lo = hi
                for cols, row in made(part):
                    if len(row):
                        own = pa.array(row)
                        yield pa.RecordBatch.from_arrays([*(pa.array(cols[c]) for c in names), *(part.column(c).take(own) for c in ("d", "t", "w"))], names=schema.names)

    return docs.mapInArrow(run, schema)


def _met(rows: DataFrame, tag: str) -> DataFrame:
    """The keys that two documents have, and how many rows have them."""
    return written(rows.groupBy("key").agg(F.min("w").alias("x"), F.max("w").alias("y"), F.count("*").alias("n")).where("x != y").select("key", "n"), tag)


def _sent(keys: DataFrame):
    """The keys, sorted, for all tasks."""
    return keys.sparkSession.sparkContext.broadcast(np.sort(keys.select("key").toArrow().column(0).to_numpy()))


def _filter(keys: DataFrame, less: np.ndarray):
    """A filter of the keys, for all tasks; its pieces of 128 KB are made in parallel."""
    spark, piece = keys.sparkSession, 20
    size = min(FILTER_BITS, max(piece, (keys.count() * 16).bit_length()))
    both = F.array(F.shiftrightunsigned("key", 64 - size), F.col("key").bitwiseAND(F.lit((1 << size) - 1)))
    at = keys.select(F.explode(both).alias("p")).select(F.shiftright("p", piece).cast("int").alias("i"), F.col("p").bitwiseAND(F.lit((1 << piece) - 1)).cast("int").alias("p"))

    def run(batches):
        made = {}
        for b in batches:
            i, p = b.column(0).to_numpy(), b.column(1).to_numpy()
            for own in np.unique(i).tolist():
                bits = made.setdefault(own, np.zeros(1 << piece, bool))
                bits[p[i == own]] = True
        for own, bits in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["i", "bits"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = np.zeros(1 << (size - 3), np.uint8)
    for r in at.repartition(parts, "i").mapInArrow(run, "i int, bits binary").toLocalIterator():
        out[r.i << (piece - 3) : (r.i + 1) << (piece - 3)] = np.frombuffer(r.bits, np.uint8)
    return spark.sparkContext.broadcast(Filter(out, less))


def _lcp(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How many columns each row has in common with the row before it; 0 where the keys differ."""
    out = np.zeros(len(x), np.int64)
    differ = np.concatenate([x[1:] != x[:-1], np.ones((max(len(x) - 1, 0), 1), bool)], axis=1)
    if len(x) > 1:
        out[1:] = np.where(key[1:] == key[:-1], differ.argmax(axis=1), 0)
    return out


def link(key, r, l, reach_r, reach_l, rank, words: int, k: int):
    """Of suffixes sorted by key and r: how far (words before, words after) other documents have what is around them, how far earlier
    ones do, and the least document (as a rank) of those; 0, 0 where there is none of `words` words."""
    n, before = len(key), l.shape[1]
    lo, hi, glo, ghi = (np.zeros(n, np.int64) for _ in range(4))
    first = np.full(n, np.iinfo(np.int64).max)
    if n < 2:
        return lo, hi, glo, ghi, first
    right = _lcp(r, key)
    wide = np.concatenate([key.astype(">i8").view(np.uint8).reshape(n, 8), np.ascontiguousarray(l).view(np.uint8).reshape(n, -1)], axis=1)
    order = np.argsort(np.ascontiguousarray(wide).view(f"S{wide.shape[1]}").ravel(), kind="stable")
    left = _lcp(l[order], key[order])

    def most(x):  # the longest match of a sorted row is with a neighbour
        return np.maximum(x, np.append(x[1:], 0))

    can_r, can_l = np.minimum(most(right), reach_r), np.empty(n, np.int64)
    can_l[order] = most(left)
    can_l = np.minimum(can_l, reach_l)
    live = np.flatnonzero(can_r + can_l >= words)
    of_left = np.empty(n, np.int64)
    for after in range(k, words + 1):
        b = words - after
        use = live[(can_r[live] >= after) & (can_l[live] >= b)]
        if len(use) < 2:
            continue
        of_right = np.cumsum(right < after)  # rows with these words from the suffix on stand together
        of_left[order] = np.cumsum((left < b) | np.append(True, key[order][1:] != key[order][:-1]))
        code = of_right[use] * (n + 1) + of_left[use]
        turn = np.argsort(code, kind="stable")
        use, code = use[turn], code[turn]
        start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        size = np.diff(np.append(start, len(use)))
        a = np.repeat(np.minimum.reduceat(rank[use], start), size)
        shared = a != np.repeat(np.maximum.reduceat(rank[use], start), size)
        use, a = use[shared], a[shared]
        lo[use], hi[use] = np.maximum(lo[use], b), np.maximum(hi[use], after)
        first[use] = np.minimum(first[use], a)
        late = use[rank[use] > a]
        glo[late], ghi[late] = np.maximum(glo[late], b), np.maximum(ghi[late], after)
    return lo, hi, glo, ghi, first


def _ranks(d: pa.Array, t: pa.Array) -> np.ndarray:
    """Of rows' documents: by id, nulls last, then by text hash."""
    one = pc.rank(d, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
    two = pc.rank(t, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
    return one * (len(two) + 1) + two


def _linked(rows: DataFrame, words: int, k: int) -> DataFrame:
    """Matches of the rows of _contexts(), dealt by key and sorted by r."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key").sortWithinPartitions("key", "r")
    kind = rows.schema["d"].dataType
    schema = T.StructType().add("d", kind).add("t", "long").add("places", T.ArrayType(T.IntegerType()))
    for c in ("lo", "hi", "glo", "ghi"):
        schema = schema.add(c, "integer")
    schema = schema.add("first", kind)

    def table(x: pa.Table):
        x = x.combine_chunks()
        one = {c: x.column(c).combine_chunks() if isinstance(x.column(c), pa.ChunkedArray) else x.column(c) for c in x.column_names}

        def context(c, width):
            return np.frombuffer(b"".join(one[c].to_pylist()), np.uint32).reshape(-1, width)

        rank = _ranks(one["d"], one["t"])
        *spans, first = link(one["key"].to_numpy(), context("r", words), context("l", words - k), one["right"].to_numpy(), one["left"].to_numpy(), rank, words, k)
        use = np.flatnonzero(spans[1])
        known, row = np.unique(rank, return_index=True)
        own = pa.array(use)
        return pa.RecordBatch.from_arrays(
            [*(one[c].take(own) for c in ("d", "t", "places")), *(pa.array(x[use].astype(np.int32)) for x in spans), one["d"].take(pa.array(row[np.searchsorted(known, first[use])]))], names=schema.names
        )

    def run(batches):
        held: list[pa.RecordBatch] = []
        count = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            count += b.num_rows
            if count < ROWS:
                continue
            x = pa.Table.from_batches(held)
            keys = x.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # rows of the last key wait for more of it
            if cut:
                yield table(x.slice(0, cut))
                held, count = x.slice(cut).to_batches(), len(keys) - cut
        if held:
            yield table(pa.Table.from_batches(held))

    return rows.mapInArrow(run, schema)


def _by_windows(windows: DataFrame, words: int) -> DataFrame:
    """Matches of the rows of _windows(), however many there are of one: windows are grouped by their hashes, with partial minima, and cut to those that two documents have."""
    windows = written(windows, "suffix-windows")
    at = F.struct(F.col("d").isNull().alias("n"), "d", "t")
    shared = written(windows.groupBy("key").agg(F.min("w").alias("x"), F.max("w").alias("y"), F.min(at).alias("a")).where("x != y").select("key", "a"), "suffix-shared")
    own = windows.join(F.broadcast(shared) if fits(shared, 100_000) else shared, "key")
    late = F.col("a") != at
    before = F.lit(words) - F.col("after")
    least = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("int")
    own = own.groupBy("d", "t", "places").agg(
        least(before).alias("lo"), least("after").alias("hi"), least(F.when(late, before)).alias("glo"), least(F.when(late, F.col("after"))).alias("ghi"), F.min("a").alias("a")
    )
    return own.select("d", "t", "places", "lo", "hi", "glo", "ghi", F.col("a.d").alias("first"))


def _marked(docs: DataFrame, keys: DataFrame, words: int, k: int) -> DataFrame:
    """docs with `at`, those of the keys that they have, found by a join; documents without one go."""
    rows = _suffixes(docs, words, k, _keys, "key").join(keys.select("key"), "key").groupBy("w").agg(F.collect_set("key").alias("at"))
    return docs.join(rows, "w").select("d", "t", "w", "x", "at")


def matches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50, k: int = 8, most: int = 16_384) -> DataFrame:
    """A row for each kept suffix in a passage that another document has too: d, t, its places in the text (words from 0), and words before and after.

    lo and hi words is how far the windows of `words` words around the suffix reach that other
    documents have, glo and ghi words those that an earlier one has (else 0 and 0); first is the id
    of the earliest document with one of them. A task holds at most `most` suffixes of one key. Suffixes of keys that
    have more go by their halves, of which each window around them has one whole; those of halves
    that have more than `most` are matched by grouping the hashes of their windows.
    """
    docs = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("t"), F.col(text_col).cast("string").alias("x"))
    docs = docs.select("d", "t", F.xxhash64("d", "t").alias("w"), "x")
    split = lambda met: (met.where(F.col("n") <= most), met.where(F.col("n") > most))
    sent = lambda keys: _sent(keys) if fits(keys, BROADCAST_KEYS) else None

    def passing(keys, less):  # what passes a filter besides has no match; but it must not pass those of many suffixes
        return sent(keys) or (_filter(keys, less.value) if less is not None and fits(keys, FILTER_KEYS) else None)

    schema = "key, r, l, right, left, places"
    cold, hot = split(_met(_suffixes(docs, words, k, _keys, "key"), "suffix-keys"))

    def whole():
        if own is not None:
            return _suffixes(docs, words, k, _contexts, schema, own)
        return _suffixes(_marked(docs, cold, words, k), words, k, _contexts, schema)

    hot_keys = sent(hot)
    own = passing(cold, hot_keys)
    if fits(hot, 0):
        return _linked(whole(), words, k)
    some, of_hot = (docs, hot_keys) if hot_keys is not None else (_marked(docs, hot, words, k), ALL)
    halves, full = split(_met(_suffixes(some, words, k, _half_keys, "key", hot_keys), "suffix-halves"))
    full_keys = sent(full)
    half_keys = passing(halves, full_keys)
    if own is not None and hot_keys is not None and half_keys is not None:
        out = _linked(_suffixes(docs, words, k, _contexts, schema, own, hot_keys, half_keys), words, k)
    else:
        rows = _suffixes(some, words, k, _contexts, schema, None, of_hot, half_keys)
        out = _linked(whole().unionByName(rows if half_keys is not None else rows.join(halves.select("key"), "key", "left_semi")), words, k)
    if fits(full, 0):
        return out
    return out.union(_by_windows(_suffixes(some, words, k, _windows, "key, after, places", None, of_hot, full_keys), words))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _without(spans: list[tuple[int, int]], gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for lo, hi in spans:
        for a, b in gone:
            if a < hi and b > lo:
                if lo < a:
                    out.append((lo, a))
                lo = max(lo, b)
        if lo < hi:
            out.append((lo, hi))
    return out


def passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50, k: int = 8, most: int = 16_384) -> DataFrame:
    """A row for each repeated passage of a document: id, t, lo, hi (words from 0, without hi), dropped, first id.

    A word belongs to a passage if a window of `words` words around it is in another document too;
    passages of a document that touch are one. `dropped` says that the windows are in an earlier
    document: one of lesser id (nulls last; then of lesser text hash). `first` is the id of the
    earliest document with a window of the passage. Words are runs of bytes without ASCII white
    space, A-Z in lower case. Null, empty and short texts have no passages; rows with the same id
    and text are one document; ids are of any type that has an order; other columns are ignored.
    """
    found = matches(df, id_col, text_col, words, k, most)
    kind = df.schema[id_col].dataType
    groups = found.groupBy("d", "t").agg(F.collect_set(F.struct("places", "lo", "hi", "glo", "ghi", "first")).alias("s"))
    schema = T.StructType().add("d", kind).add("t", "long").add("lo", "integer").add("hi", "integer").add("dropped", "boolean").add("first", kind)

    def run(batches):
        for b in batches:
            doc, rows = [], []
            for i, s in enumerate(b.column(2).to_pylist()):
                spans = sorted((p - x["lo"], p + x["hi"], at) for at, x in enumerate(s) for p in x["places"])
                every = _merged([x[:2] for x in spans])
                gone = _merged([(p - x["glo"], p + x["ghi"]) for x in s if x["ghi"] for p in x["places"]])
                near = 0
                for lo, hi, away in sorted([(*x, True) for x in gone] + [(*x, False) for x in _without(every, gone)]):
                    while near < len(spans) and spans[near][1] <= lo and spans[near][0] < lo:
                        near += 1
                    ids = []
                    for start, end, at in spans[near:]:
                        if start >= hi:
                            break
                        if end > lo and s[at]["first"] is not None:
                            ids.append(s[at]["first"])
                    doc.append(i)
                    rows.append((lo, hi, away, min(ids, default=None)))
            own = pa.array(doc, pa.int64())
            cols = list(zip(*rows)) or [()] * 4
            kinds = (pa.int32(), pa.int32(), pa.bool_(), b.schema.field(0).type)
            yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), *(pa.array(c, x) for c, x in zip(cols, kinds))], names=schema.names)

    return groups.mapInArrow(run, schema).withColumnRenamed("d", id_col)


def remove(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50, k: int = 8, most: int = 16_384) -> DataFrame:
    """df with texts without their dropped passages, as passages() tells; documents without any word left go, if they had one.

    The white space after a dropped word goes with it. All columns of df stay, whatever their names.
    """
    d, t, spans = fresh(df, "d", "t", "spans")
    gone = passages(df, id_col, text_col, words, k, most).where("dropped").groupBy(F.col(id_col).alias(d), F.col("t").alias(t)).agg(F.collect_list(F.struct("lo", "hi")).alias(spans))
    out = df.join(gone, df[id_col].eqNullSafe(gone[d]) & (F.xxhash64(df[text_col]) == gone[t]), "left")
    names = df.columns
    at = names.index(text_col)
    schema = df.schema

    def run(batches):
        import re

        word = re.compile(rb"[^ \t-\r]+[ \t-\r]*")
        for b in batches:
            texts = b.column(at).to_pylist()
            keep = [True] * len(texts)
            for i, s in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if s:
                    raw = texts[i].encode()
                    ends = [m.span() for m in word.finditer(raw)]
                    left, upto = [], 0
                    for lo, hi in _merged([(x["lo"], x["hi"]) for x in s]):
                        left.append(raw[upto : ends[lo][0]])
                        upto = ends[hi - 1][1]
                    left.append(raw[upto:])
                    texts[i] = b"".join(left).decode()
                    keep[i] = bool(texts[i].split())
            cols = [pa.array(texts, pa.string()) if j == at else b.column(j) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    return out.select(*[df[c] for c in names], spans).mapInArrow(run, schema)
