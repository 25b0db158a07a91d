"""Near-duplicate embeddings by product quantisation with an inverted index.

Equal vectors are one representative first. Representatives are assigned to the lists of a coarse
quantiser and stored there with codes of their residuals' subspaces. A vector probes the lists that
can hold a neighbour, reads its distances to their codes from tables (the vector itself is not
quantised), and reranks what is left by exact cosines in double precision. Lists are cut into
blocks, so that no task has a whole hot list, and neither pairs nor lists are ever emitted: a task
returns how many links each vector has and a spanning forest of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import connected_components, fits, written

_LAST = (1 << 63) - 1


@dataclass
class Index:
    """The coarse centres, and the codewords of each subspace of the residuals (subspace, code, values)."""

    centres: np.ndarray
    words: np.ndarray

    @property
    def subspaces(self) -> int:
        return len(self.words)

    def split(self, x: np.ndarray) -> np.ndarray:
        """x by subspace, filled up with zeros where the dimension does not divide."""
        m, _, w = self.words.shape
        out = np.zeros((len(x), m * w), np.float64)
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), m, w)

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and how far each residual is from what its codes stand for."""
        parts = self.split(residuals)
        codes, lost = np.empty(parts.shape[:2], np.uint8), np.zeros(len(parts))
        for s, words in enumerate(self.words):
            d = _squares(parts[:, s], words)
            codes[:, s] = d.argmin(axis=1)
            lost += d.min(axis=1)
        return codes, np.sqrt(lost)

    def tables(self, residuals: np.ndarray) -> np.ndarray:
        """Squared distances of each residual to all codewords: row, subspace, code."""
        parts = self.split(residuals)
        return np.stack([_squares(parts[:, s], words) for s, words in enumerate(self.words)], 1)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None], 0)


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centres by Lloyd's rounds; an empty one moves to a point far from its own."""
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near, far = np.empty(len(x), np.int64), np.empty(len(x))
        for at in range(0, len(x), 8192):
            d = _squares(x[at : at + 8192], centres)
            near[at : at + 8192], far[at : at + 8192] = d.argmin(axis=1), d.min(axis=1)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(n)
        centres[full] = np.add.reduceat(x[order], np.append(0, np.cumsum(n))[full]) / n[full, None]
        empty = np.flatnonzero(n == 0)
        centres[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return centres


def fit(sample: np.ndarray, lists: int, subspaces: int = 8, rounds: int = 8, seed: int = 7) -> Index:
    """An index of unit vectors; the sample bounds what is learned from."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    m = max(1, min(subspaces, dim))
    width = -(-dim // m)
    centres = _means(sample, max(1, min(lists, len(sample))), rounds, rng)
    near = np.concatenate([_squares(sample[at : at + 8192], centres).argmin(axis=1) for at in range(0, len(sample), 8192)])
    out = Index(centres, np.zeros((m, 1, width)))
    parts = out.split(sample - centres[near])
    out.words = np.stack([_means(np.ascontiguousarray(parts[:, s]), min(256, len(parts)), rounds, rng) for s in range(m)])
    return out


def probes(x: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each vector's own list, and the lists of higher number on whose side of the bisecting plane something within reach of it can lie."""
    home, found = np.empty(len(x), np.int64), []
    gaps = np.sqrt(_squares(centres, centres))
    for at in range(0, len(x), 2048):
        d = _squares(x[at : at + 2048], centres)
        own = d.argmin(axis=1)
        home[at : at + 2048] = own
        over = d - d[np.arange(len(d)), own][:, None] <= 2 * reach * gaps[own] + 1e-12
        for o, row in zip(own.tolist(), over):
            hit = np.flatnonzero(row)
            found.append(hit[hit > o])
    return home, found


def _unit(lists: pa.Array, dim: int) -> np.ndarray:
    """Vectors of at most dim components, filled up with zeros, divided by their lengths."""
    flat, offsets = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
    size = np.diff(offsets)
    out = np.zeros((len(size), dim))
    if len(flat):
        out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], size)] = flat
    out /= np.abs(out).max(axis=1, initial=1e-300)[:, None]  # so that squares neither overflow nor vanish
    return out / np.sqrt((out * out).sum(1))[:, None]


def _compare(index: Index, at: int, x: np.ndarray, y: np.ndarray, codes: np.ndarray, lost: np.ndarray, xd: np.ndarray, yd: np.ndarray, cosine: float) -> np.ndarray:
    """Which of the queries x link with which of the members y of a list, of which only the codes are looked at first."""
    near = math.sqrt(max(2 - 2 * cosine, 0))
    out = np.zeros((len(x), len(y)), bool)
    for lo in range(0, len(x), 256):
        q = x[lo : lo + 256]
        tables = index.tables(q - index.centres[at])
        adc = np.zeros((len(q), len(y)))
        for s in range(index.subspaces):
            adc += tables[:, s][:, codes[:, s]]
        # A code's distance is off by what coding has lost, no more.
        i, j = np.nonzero((adc <= (near + lost[None] + 1e-6) ** 2) & (xd[lo : lo + 256, None] == yd[None]))
        for a in range(0, len(i), 65536):
            p, r = i[a : a + 65536], j[a : a + 65536]
            hit = np.einsum("ij,ij->i", q[p], y[r]) >= cosine
            out[lo + p[hit], r[hit]] = True
    return out


def _forest(adj: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric adjacency."""
    left, out = adj.any(axis=1), []
    while left.any():
        stack = [int(left.argmax())]
        left[stack[0]] = False
        while stack:
            i = stack.pop()
            near = np.flatnonzero(left & adj[i])
            left[near] = False
            for j in near.tolist():
                out.append((i, j))
                stack.append(j)
    return out


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, slack: float = 3.0,
    lists_per_root: float = 2.0, max_lists: int = 16_384, sample_per_list: int = 64, subspaces: int = 8, block: int = 512,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors of one dimension link if their cosine, in double precision, is `cosine` or more; others
    never do. n_links counts the other rows linked directly, copies included; component_id is the
    least id reachable. Null, empty and zero vectors and those with a null or non-finite component
    link with nothing. Repeated rows are rows of their own, linked with each other; rows with a null
    id count last, and a component of such rows alone has a null component_id and is not kept. An
    empty table gives no rows; other columns are ignored.

    The index has lists_per_root times the root of the number of different vectors as lists (bound:
    max_lists) and is fitted on sample_per_list vectors for each list, drawn by hash; all are
    indexed. A list is probed if the plane between it and the vector's own is at most `slack`
    standard deviations away of how far a neighbour in a random direction lies across it; with the
    root of the dimension as slack, nothing can be missed.
    """
    spark = df.sparkSession
    v = F.col(vector_col)
    ok = v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    key = F.transform(v, lambda x: x.cast("double") + F.lit(0.0))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.when(ok, key).alias("v"))
    h = F.when(F.col("v").isNotNull(), F.xxhash64("v")).otherwise(F.xxhash64("id"))
    rows = rows.select("id", "v", h.alias("h1"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")).alias("h2"))
    marked = rows.select("id", "h1", "h2")
    reps = rows.where("v is not null").groupBy("h1", "h2").agg(F.coalesce(F.min("id"), F.lit(_LAST)).alias("m"), F.count("*").alias("n"), F.first("v").alias("v"))
    reps = written(reps, "pq-vectors")
    size = reps.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if size.n:
        counts, edges = _links(spark, reps, size.n, size.d, cosine, slack, lists_per_root, max_lists, sample_per_list, subspaces, block)
        parts = connected_components(edges).select(F.col("node.h").alias("h1"), F.col("node.m").alias("m"), F.col("component.m").alias("least"))
        links = counts.groupBy("h1", "m").agg(F.sum("k").alias("k"))
        known = reps.drop("v").join(links, ["h1", "m"], "left").join(parts, ["h1", "m"], "left")
        known = known.select("h1", "h2", (F.coalesce("k", F.lit(0)) + F.col("n") - 1).alias("k"), F.coalesce("least", "m").alias("least"))
    else:
        known = spark.createDataFrame([], "h1 long, h2 long, k long, least long")
    out = marked.join(known, ["h1", "h2"], "left")
    least = F.when(F.col("h2").isNull(), F.col("id")).otherwise(F.when(F.col("least") != _LAST, F.col("least")))
    out = out.select(F.col("id").alias(id_col), F.coalesce("k", F.lit(0)).cast("long").alias("n_links"), least.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _links(spark, reps, n, dim, cosine, slack, lists_per_root, max_lists, sample_per_list, subspaces, block):
    """Tables of link counts (h1, m, k), in parts, and of edges (u, v)."""
    lists = max(1, min(max_lists, math.ceil(lists_per_root * math.sqrt(n))))
    want = lists * sample_per_list
    drawn = reps if want >= n else reps.where(F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 30)) < int(want / n * (1 << 30)) + 1)
    drawn = drawn.select("v").orderBy("v").limit(2 * want)
    sample = np.zeros((0, dim))
    for b in drawn.toArrow().to_batches():
        sample = np.concatenate([sample, _unit(b.column(0), dim)])
    index = fit(sample, lists, subspaces)
    model = spark.sparkContext.broadcast(index)  # max_lists centres at most
    near = math.sqrt(max(2 - 2 * cosine, 0))
    reach = near * min(1.0, slack / math.sqrt(dim))
    names = ["h1", "m", "n", "d", "v", "home", "visits", "codes", "lost"]

    def assign(batches):
        ix = model.value
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = _unit(part.column(3), dim)
                home, found = probes(x, ix.centres, reach)
                codes, lost = ix.encode(x - ix.centres[home])
                offsets = np.append(0, np.cumsum([len(f) for f in found]))
                visits = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)))
                sizes = pa.array(np.diff(part.column(3).offsets.to_numpy()).astype(np.int32))
                packed = [pa.array([r.tobytes() for r in y], pa.binary()) for y in (x, codes)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), sizes, packed[0], pa.array(home.astype(np.int32)), visits, packed[1], pa.array(lost)], names=names)

    schema = "h1 long, m long, n long, d int, v binary, home int, visits array<int>, codes binary, lost double"
    stored = written(reps.select("h1", "m", "n", "v").mapInArrow(assign, schema), "pq-lists")
    own = {r.l: r.c for r in stored.groupBy(F.col("home").alias("l")).agg(F.count("*").alias("c")).collect()}  # a row for each list
    seen = {r.l: r.c for r in stored.select(F.explode("visits").alias("l")).groupBy("l").agg(F.count("*").alias("c")).collect()}
    blocks = spark.createDataFrame([(l, -(-c // block), -(-seen.get(l, 0) // block)) for l, c in own.items()], "l int, nm int, nv int")
    entries = stored.select("h1", "m", "n", "d", "v", F.col("home").alias("l"), F.lit(True).alias("own"), "codes", "lost")
    visitors = stored.select("h1", "m", "n", "d", "v", F.explode("visits").alias("l"), F.lit(False).alias("own"), F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("lost"))
    # Blocks 0 to nm - 1 are of members, the next nv of visitors; an item is a block of members with another block or itself.
    every = entries.union(visitors).join(F.broadcast(blocks), "l")
    b = F.when(F.col("own"), F.pmod("h1", "nm")).otherwise(F.col("nm") + F.pmod("h1", F.greatest("nv", F.lit(1)))).cast("int")
    items = F.when(
        F.col("own"), F.transform(F.sequence(F.lit(0), F.col("nm") + F.col("nv") - 1), lambda i: F.struct(F.least(i, F.col("b")).alias("i"), F.greatest(i, F.col("b")).alias("j")))
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda i: F.struct(i.alias("i"), F.col("b").alias("j"))))
    dealt = every.withColumn("b", b).select("l", F.explode(items).alias("at"), "b", "h1", "m", "n", "d", "v", "own", "codes", "lost")
    fields = ["b", "h1", "m", "n", "d", "v", "codes", "lost"]
    groups = dealt.groupBy("l", "at").agg(F.collect_list(F.struct(*fields)).alias("g")).select("l", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "g")
    out_names = ["h1", "m", "k", "h2", "m2"]

    def compare(batches):
        ix = model.value
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in out_names]
            for r in range(batch.num_rows):
                l, i, j = (batch.column(c)[r].as_py() for c in range(3))
                g = batch.column(3)[r].values
                b, h, m, n, d = (g.field(c).to_numpy() for c in range(5))
                v = np.frombuffer(b"".join(g.field(5).to_pylist()), np.float64).reshape(len(b), -1)
                left = np.flatnonzero(b == i)
                codes = np.frombuffer(b"".join(g.field(6).take(pa.array(left)).to_pylist()), np.uint8).reshape(len(left), -1)
                lost = g.field(7).to_numpy()[left]
                right = left if i == j else np.flatnonzero(b == j)
                if not len(left) or not len(right):
                    continue
                hit = _compare(ix, l, v[right], v[left], codes, lost, d[right], d[left], cosine)
                if i == j:
                    hit |= hit.T
                    np.fill_diagonal(hit, False)
                    adj, who = hit, left
                    k = hit @ n[left]
                else:
                    who = np.concatenate([left, right])
                    adj = np.zeros((len(who), len(who)), bool)
                    adj[: len(left), len(left) :] = hit.T
                    adj[len(left) :, : len(left)] = hit
                    k = np.concatenate([hit.T @ n[right], hit @ n[left]])
                use = np.flatnonzero(k)
                pairs = np.array(_forest(adj), np.int64).reshape(-1, 2)
                none = np.full(len(use), 0)
                a, c = who[pairs[:, 0]], who[pairs[:, 1]]
                for col, x in zip(cols, (np.append(h[who[use]], h[a]), np.append(m[who[use]], m[a]), np.append(k[use], np.zeros(len(a), np.int64)), np.append(none, h[c]), np.append(none, m[c]))):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0), pa.int64()) for c in cols], names=out_names)

    found = written(groups.mapInArrow(compare, ", ".join(f"{c} long" for c in out_names)), "pq-links")
    edges = found.where("k = 0").select(F.struct("m", F.col("h1").alias("h")).alias("u"), F.struct(F.col("m2").alias("m"), F.col("h2").alias("h")).alias("v"))
    return found.where("k > 0").select("h1", "m", "k"), edges
