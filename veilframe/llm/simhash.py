"""SimHash near-duplicates by the generalised pigeonhole principle.

Every document has a 64-bit fingerprint, and where asked for a longer one to verify with; deduplicate() settles by the sets of shingles. Correlated
bits are grouped into partitions; a dynamic program gives each partition its own threshold, of which
the sum guarantees that two fingerprints within the radius agree up to that threshold in some
partition. Fingerprints meet in buckets of what they then share and are verified there; buckets that
are too full are cut into blocks that meet in pairs, and only a spanning forest of the links leaves
a bucket, so that neither a task nor the result grows with the square of a group.
"""

from __future__ import annotations

import math
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import connected_components, fits, fresh, written

SEED = 42
_ALL = (1 << 64) - 1


def fingerprint(text: bytes | None, n: int = 3, words: int = 1) -> list[int]:
    """The unsigned 64-bit words of a UTF-8 text's fingerprint; zeros for a null text or one without words."""
    import xxhash

    w = (text or b"").lower().split()
    if not w:
        return [0] * words
    if len(w) < n:
        shingles = [b" ".join(w)]
    else:
        shingles = list(map(b" ".join, zip(*(w[i:] for i in range(n)))))
    digest = xxhash.xxh64_intdigest
    total, bits = len(shingles), np.zeros((words, 64), np.int64)
    for at in range(0, total, 1 << 16):
        h = np.array([digest(s, SEED) for s in shingles[at : at + (1 << 16)]], np.uint64)
        bits[0] += _ones(h)
        for i in range(1, words):  # further words from the same hashes, mixed anew
            x = (h ^ np.uint64(i * 0x9E3779B97F4A7C15 & _ALL)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            bits[i] += _ones(x ^ (x >> np.uint64(32)))
    return np.packbits(bits * 2 > total, axis=1, bitorder="little").view(np.uint64).ravel().tolist()


def _ones(h: np.ndarray) -> np.ndarray:
    """How often each bit is set, from bit 0; eight counters are added in one word, 255 rows at most."""
    lanes = np.unpackbits(h.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
    whole = len(lanes) // 255 * 255
    sums = [lanes[:whole].reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64), lanes[whole:].sum(axis=0, dtype=np.uint64)[None]]
    return np.concatenate(sums).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def with_fingerprint(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), n: int = 3, words: int = 1) -> DataFrame:
    """The kept columns, `fp`, the fingerprint as a signed long, and w1 and so on, its further words; one row per row.

    Words of a text are maximal runs of bytes that are not ASCII white space, with A-Z in lower case.
    """
    few = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("binary").alias("t"))
    schema, names = few.drop("t").schema, ["fp", *_more(words)]
    for c in names:
        schema = schema.add(c, "long")

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, n, words) for t in b.column(b.num_columns - 1).to_pylist()], np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(np.ascontiguousarray(x)) for x in fp.T)], names=schema.names)

    return few.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names)


def _more(words: int) -> list[str]:
    return [f"w{i}" for i in range(1, words)]


def bit_partitions(co: np.ndarray, ones: np.ndarray, n: int, m: int) -> list[int]:
    """m masks of nearly equal size; each grows by the bit that correlates most with its bits."""
    p = ones / max(n, 1)
    cov = np.abs(co / max(n, 1) - np.outer(p, p)) / np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    left, masks = set(range(64)), []
    for i in range(m):
        want = 64 // m + (i < 64 % m)
        part = [min(left, key=lambda b: (abs(p[b] - 0.5), b))]
        left.remove(part[0])
        while len(part) < want:
            best = max(left, key=lambda b: (cov[b, part].sum(), -b))
            part.append(best)
            left.remove(best)
        masks.append(sum(1 << b for b in part))
    return masks


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up, one per partition, of the given sum and the least cost; costs[i][e + 1] is of threshold e."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, picks) in best.items():
            for j, more in enumerate(row):
                if (s + j - 1) not in new or new[s + j - 1][0] > c + more:
                    new[s + j - 1] = (c + more, [*picks, j - 1])
        best = new
    return best[total]


def _bits(mask: int) -> list[int]:
    return [b for b in range(64) if mask >> b & 1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


ROW, PAIR = 200.0, 1.0  # what a row in a bucket and a comparison cost, as measured
MOST_MASKS = 600


def plan(nodes: DataFrame, radius: int) -> list[int]:
    """The masks of which two fingerprints within the radius share one; counts are over all fingerprints."""

    def stats(batches):
        co = np.zeros((64, 64), np.int64)
        n = 0
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
            for at in range(0, len(h), 65536):
                x = np.unpackbits(np.ascontiguousarray(h[at : at + 65536]), axis=1, bitorder="little").astype(np.float32)
                co += (x.T @ x).astype(np.int64)
            n += len(h)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.append(co.ravel(), n))], names=["cell", "n"])

    flat = np.zeros(4097, np.int64)
    for r in nodes.select("fp").mapInArrow(stats, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # 4097 rows
        flat[r.cell] = r.n
    return masks_for(flat[:4096].reshape(64, 64), int(flat[4096]), radius)


def masks_for(co: np.ndarray, n: int, radius: int) -> list[int]:
    """The masks of least estimated cost; co counts the fingerprints in which two bits are both set."""
    ones = np.diagonal(co).copy()
    p = ones / max(n, 1)
    same = p**2 + (1 - p) ** 2  # the odds that two fingerprints agree in a bit
    choices = []
    for m in range(max(1, (radius + 1) // 3), radius + 2):
        own, costs = bit_partitions(co, ones, n, m), []
        for x in own:
            bits = _bits(x)
            row = [0.0]
            for e in range(radius - m + 2 if len(bits) else 1):
                # Agreement but for e bits: the sum over all ways to leave out e of them.
                agree = np.prod(same[bits]) * _elementary(1 / np.maximum(same[bits], 0.5), e)
                row.append(n * comb(len(bits), e) * ROW + PAIR * n * n / 2 * agree)
            costs.append(row)
        cost, thresholds = allocate(costs, radius - m + 1)
        if sum(comb(len(_bits(x)), t) for x, t in zip(own, thresholds) if t >= 0) <= MOST_MASKS:
            choices.append((cost, thresholds, own))
    if not choices:
        raise ValueError(f"a radius of {radius} of 64 bits needs more than {MOST_MASKS} masks")
    _, thresholds, own = min(choices, key=lambda c: c[0])
    out = []
    for t, x in zip(thresholds, own):
        if t >= 0:
            out += [x & ~sum(1 << b for b in gone) for gone in combinations(_bits(x), t)]
    return out


def _elementary(x: np.ndarray, e: int) -> float:
    """The elementary symmetric polynomial of degree e."""
    out = np.zeros(e + 1)
    out[0] = 1
    for v in x:
        out[1:] = out[1:] + v * out[:-1]
    return float(out[e])


def links(nodes: DataFrame, radius: int = 2, words: int = 1, verify: int | None = None, block: int = 2048) -> DataFrame:
    """Edges (u, v) of structs (m, id) that join all fingerprints within the radius.

    nodes has m, which orders them, id, fp and the further words of distinct fingerprints. The edges
    are a spanning forest of each bucket, not all its pairs. With `verify`, all words together may
    differ in so many bits at most. A bucket with more than `block` members is cut into blocks of
    half that size on average, of which any two meet.
    """
    masks, cols = plan(nodes, radius), ["m", "id", "fp", *_more(words)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(x)))) for i, x in enumerate(masks)])
    rows = nodes.select(*cols, F.explode(keys).alias("key"))
    counts = written(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "simhash-buckets")
    small = rows.join(counts.where(F.col("c") <= block), "key", "left_semi").groupBy("key").agg(F.collect_list(F.struct(*cols)).alias("g")).select("g")
    full = counts.where(F.col("c") > block).select("key", F.ceil(F.col("c") * 2 / block).cast("int").alias("nb"))
    n_full = full.count()
    if n_full:
        hot = rows.join(F.broadcast(full) if n_full <= 100_000 else full, "key")
        b = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
        others = F.filter(F.sequence(F.lit(0), F.col("nb") - 1), lambda i: i != F.col("b"))
        dealt = hot.withColumn("b", b).select(*cols, "key", F.explode(F.transform(others, lambda i: F.struct(F.least(i, F.col("b")).alias("i"), F.greatest(i, F.col("b")).alias("j")))).alias("at"))
        small = small.union(dealt.groupBy("key", "at").agg(F.collect_list(F.struct(*cols)).alias("g")).select("g"))
    out = small.mapInArrow(lambda it: _forests(it, radius, words, verify), "um long, ui long, vm long, vi long")
    return out.select(F.struct(F.col("um").alias("m"), F.col("ui").alias("id")).alias("u"), F.struct(F.col("vm").alias("m"), F.col("vi").alias("id")).alias("v")).distinct()


def links_by_any(nodes: DataFrame, radius: int = 2, words: int = 1, verify: int | None = None, block: int = 2048) -> DataFrame:
    """The edges of links() by the first word, by the second, and so on: of all pairs within the radius in some word.

    Four words with a radius of 8 find about as many pairs as one with a radius of 12, of which the
    masks are shorter, so that their buckets grow sooner.
    """
    every = ["fp", *_more(words)]
    out = None
    for i in range(words):
        turned = nodes.select("m", "id", *[F.col(every[(i + j) % words]).alias(c) for j, c in enumerate(every)])
        own = links(turned, radius, words, verify, block)
        out = own if out is None else out.union(own)
    return out.distinct() if words > 1 else out


def near(f: np.ndarray, radius: int, verify: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (i < j) within the radius; f has a column for each word."""
    i, j = [], []
    for at in range(0, len(f), 256):
        a, b = np.nonzero(np.bitwise_count(f[at : at + 256, None, 0] ^ f[None, at:, 0]) <= radius)
        up = b > a
        a, b = a[up] + at, b[up] + at
        if verify is not None:
            use = np.bitwise_count(f[a] ^ f[b]).sum(axis=1, dtype=np.int64) <= verify
            a, b = a[use], b[use]
        i.append(a)
        j.append(b)
    return np.concatenate(i), np.concatenate(j)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph of these pairs."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _forests(batches, radius: int, words: int, verify: int | None):
    """For each list of members, the edges of a spanning forest of the graph of near fingerprints."""
    for batch in batches:
        g = batch.column(0)
        ends = g.offsets.to_numpy()
        every = [x.to_numpy() for x in g.values.flatten()]
        out = [np.zeros((0, 4), np.int64)]
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
            m, ids = every[0][lo:hi], every[1][lo:hi]
            i, j = near(np.stack([x[lo:hi] for x in every[2:]], 1).view(np.uint64), radius, verify)
            if len(i):
                a, b = np.array(forest(len(m), i, j)).T
                out.append(np.stack([m[a], ids[a], m[b], ids[b]], 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in np.concatenate(out).T], names=["um", "ui", "vm", "vi"])


_LAST = (1 << 63) - 1


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, radius: int = 2, keep: tuple[str, ...] = (), words: int = 1, verify: int | None = None
) -> DataFrame:
    """One row per document: id, the kept columns, fingerprint (16 hex digits), component_id.

    component_id is the least id reachable over fingerprints with at most `radius` differing bits in
    one of their words and, with `verify`, at most so many in all `words` words. Null and
    wordless texts have fingerprint zero and link like any other. Repeated rows are rows of
    the same component; rows with a null id count last, and a component of such rows alone has a
    null component_id. An empty table gives no rows; other columns are ignored.
    """
    cols = tuple(dict.fromkeys((id_col, *keep)))
    every = ["fp", *_more(words)]
    marked = written(with_fingerprint(df, text_col, cols, n, words), "simhash-fp")
    node = F.col("fp") if words == 1 else F.xxhash64(*every)
    nodes = marked.groupBy(*every).agg(F.coalesce(F.min(F.col(id_col).cast("long")), F.lit(_LAST)).alias("m"))
    nodes = written(nodes.withColumn("id", node), "simhash-nodes")
    parts = connected_components(links_by_any(nodes, radius, words, verify))
    labels = parts.select(F.col("node.id").alias("id"), F.col("node.m").alias("m"), F.col("component.m").alias("least"))
    labels = nodes.join(labels, ["id", "m"], "left").select(*every, F.coalesce("least", "m").alias("least"))
    out = marked.join(labels, every)
    return out.select(
        *cols,
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("least") != _LAST, F.col("least")).alias("component_id"),
    )


def similar_bits(similarity: float, bits: int, spare: float = 0.0) -> int:
    """How many of so many bits differ between sets of that Jaccard similarity and equal size, on average and by so many standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(p * bits + spare * math.sqrt(p * (1 - p) * bits))


def shingles_of(df: DataFrame, n: int) -> DataFrame:
    """c and t of df, and s: the sorted hashes of the different n-word shingles of the text x, as bytes."""

    def run(batches):
        import xxhash

        digest = xxhash.xxh64_intdigest
        for b in batches:
            out = []
            for x in b.column(2).to_pylist():
                w = x.lower().split()
                own = map(b" ".join, zip(*(w[i:] for i in range(n)))) if len(w) >= n else [b" ".join(w)]
                out.append(np.sort(np.fromiter({digest(y, SEED) for y in own}, np.uint64)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["c", "t", "s"])

    return df.select("c", "t", F.col("x").cast("binary").alias("x")).mapInArrow(run, "c long, t long, s binary")


def similar_sets(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets whose Jaccard similarity is that or more."""
    size = np.array([len(x) for x in sets])
    start = np.append(0, np.cumsum(size)[:-1])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    i, j, mark = [], [], np.zeros(code.max() + 1, np.int64)
    for k in range(len(sets) - 1):
        own = code[start[k] : start[k] + size[k]]
        mark[own] = 1
        both = np.add.reduceat(mark[code[start[k + 1] :]], start[k + 1 :] - start[k + 1])
        mark[own] = 0
        near = np.flatnonzero(both >= similarity * (size[k] + size[k + 1 :] - both) - 1e-9)
        i.append(np.full(len(near), k))
        j.append(near + k + 1)
    return forest(len(sets), np.concatenate(i), np.concatenate(j))


def similar_links(members: DataFrame, similarity: float, block: int) -> DataFrame:
    """Edges (u, v) between the texts t that join all similar ones of a cluster c, a forest of each group; s as shingles_of() gives it.

    A cluster of more than `block` texts (one counts once more for each 4096 shingles) is cut into
    blocks of half that on average, of which any two meet.
    """
    weight = F.floor(F.length("s") / (8 * 4096)) + 1
    full = members.groupBy("c").agg(F.sum(weight).alias("w")).where(F.col("w") > block)
    full = written(full.select("c", F.ceil(F.col("w") * 2 / block).cast("int").alias("blocks")), "simhash-full")
    at = F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i != at)
    pairs = F.transform(others, lambda i: F.struct(F.least(i, at).alias("i"), F.greatest(i, at).alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    dealt = members.join(F.broadcast(full) if fits(full, 100_000) else full, "c", "left")
    dealt = dealt.select("c", "t", "s", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(pairs)).alias("at"))
    groups = dealt.groupBy("c", "at").agg(F.collect_list(F.struct("t", "s")).alias("g")).select("g")

    def run(batches):
        for b in batches:
            u, v = [], []
            for g in b.column(0):
                t = [x["t"].as_py() for x in g]
                if len(t) > 1:
                    for i, j in similar_sets([np.frombuffer(x["s"].as_py(), np.uint64) for x in g], similarity):
                        u.append(t[i])
                        v.append(t[j])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return groups.mapInArrow(run, "u long, v long").distinct()


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: float = 0.8, radius: int = 8, words: int = 4, block: int = 512) -> DataFrame:
    """df with one document of each group of near-duplicates: that of the least id (nulls last, then of the least text hash).

    Documents are linked if the sets of their n-word shingles have that Jaccard similarity or more.
    Fingerprints find the candidates: within `radius` bits in one of `words` words of 64, and in all
    words within two standard deviations of what the similarity makes differ. Clusters of candidates
    are then compared by their sets, so that no other documents are linked; a pair that chance takes
    apart by more bits in every word may be missed. Rows with the same id and text are one document and stay or go
    together. Null and wordless texts have nothing to compare and stay. Ids are of any type that has
    an order; all columns stay, whatever their names; an empty table gives no rows.
    """
    has_words = F.coalesce(F.col(text_col).cast("binary").cast("string").rlike("[^ \\t-\\r]"), F.lit(False))
    some = df.where(has_words).select(F.col(id_col).alias("d"), F.col(text_col).alias("x"), F.xxhash64(text_col).alias("t"))
    found = near_duplicates(some, "t", "x", n, radius, (), words, similar_bits(similarity, 64 * words, 2.0))
    texts = written(found.groupBy("t").agg(F.min("component_id").alias("c")), "simhash-texts")
    several = texts.groupBy("c").agg(F.count("*").alias("k")).where("k > 1").select("c")
    mates = written(texts.join(several, "c"), "simhash-mates")
    sets = shingles_of(some.join(F.broadcast(mates) if fits(mates, 500_000) else mates, "t").select("c", "t", "x"), n)
    members = written(sets.groupBy("c", "t").agg(F.min("s").alias("s")), "simhash-members")
    parts = connected_components(similar_links(members, similarity, block)).select(F.col("node").alias("t"), F.col("component").alias("c"))
    parts = written(parts, "simhash-parts")
    every = some.select("d", "t").distinct().join(F.broadcast(parts) if fits(parts, 500_000) else parts, "t", "left")
    every = every.select(F.coalesce("c", "t").alias("c"), F.struct(F.col("d").isNull().alias("n"), "d", "t").alias("at"))
    first = written(every.groupBy("c").agg(F.min("at").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k"), "simhash-first")
    gone = every.join(F.broadcast(first) if fits(first, 250_000) else first, "c").where("at != first")
    d, t = fresh(df, "d", "t")
    gone = written(gone.select(F.col("at.d").alias(d), F.col("at.t").alias(t)), "simhash-gone")
    side = F.broadcast(gone) if fits(gone, 500_000) else gone
    return df.join(side, df[id_col].eqNullSafe(gone[d]) & (F.xxhash64(df[text_col]) == gone[t]), "left_anti").select(*df.columns)
