"""Mixture-controlled packing by deficit round-robin.

Every document's ids, followed by a separator, join the queue of its source. Sequences (windows) are
filled from the queues in turn; each window adds to a queue's deficit what the target proportions
give it, the queue is served what is due, and what is still owed is carried to the next window. The
round-robin runs over a cycle of windows after which all deficits are zero, so that the same cycle
holds from any of its repeats on: every task places its part of a queue by arithmetic from one small
table, with the deficits that the windows before it, in other partitions, have left. When a queue
has less than a cycle's share left, a shorter cycle drains it and the others go on in proportion.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import written


@dataclass
class Phase:
    """`repeats` cycles from global position `start`; per queue its position, share, and segments of a cycle."""

    start: int
    length: int
    repeats: int
    queue_start: np.ndarray
    quota: np.ndarray
    segments: list[np.ndarray]  # by queue: rows of position in the queue's share, position in the cycle, length


def shares(weights: np.ndarray, total: int) -> np.ndarray:
    """Integers in proportion to the weights, by largest remainder; they add up to the total."""
    exact = weights / weights.sum() * total
    out = np.floor(exact).astype(np.int64)
    for i in np.argsort(-(exact - out), kind="stable")[: total - int(out.sum())]:
        out[i] += 1
    return out


def round_robin(quota: np.ndarray, window: int, filled: int, quantum: int = 1) -> list[np.ndarray]:
    """The segments of one cycle: deficit round-robin over the queues, from a window of which some is filled."""
    total = int(quota.sum())
    served = np.zeros(len(quota), np.int64)
    deficit = np.zeros(len(quota))
    out: list[list[tuple[int, int, int]]] = [[] for _ in quota]
    at, turn, n = 0, 0, len(quota)
    while at < total:
        space = min(window - (filled + at) % window, total - at)
        deficit += quota * (space / total)
        due = np.minimum(np.maximum(np.floor(deficit + 1e-9), 0).astype(np.int64), quota - served)
        due[due < quantum] = 0
        over = int(due.sum()) - space
        if over > 0:  # a quantum that had to wait: the last in turn wait for the next window
            for i in [(turn + k) % n for k in range(n)][::-1]:
                less = min(over, int(due[i]))
                due[i] -= less
                over -= less
        left = space - int(due.sum())
        while left > 0:  # what rounding leaves goes to those owed most, who then owe
            for i in np.argsort(-(deficit - due), kind="stable"):
                more = min(left, max(quantum, 1), int(quota[i] - served[i] - due[i]))
                if more > 0:
                    due[i] += more
                    left -= more
                if not left:
                    break
        order = (turn + np.arange(n)) % n
        for i in order[due[order] > 0].tolist():
            out[i].append((int(served[i]), at, int(due[i])))
            at += int(due[i])
        served += due
        deficit -= due
        turn = (turn + 1) % n
    return [np.array(x, np.int32).reshape(-1, 3) for x in out]


def schedule(totals: np.ndarray, weights: np.ndarray, window: int = 1024, cycle: int = 64, quantum: int = 1) -> list[Phase]:
    """Phases that serve every queue whole, to the weights as long as it lasts. At most two for each queue."""
    left, done, at, out = totals.astype(np.int64).copy(), np.zeros(len(totals), np.int64), 0, []
    weights = np.where(weights > 0, weights, 0).astype(float)
    while left.sum():
        live = left > 0
        w = np.where(live, weights, 0.0)
        if not w.sum():
            w = live.astype(float)  # queues of no weight come last
        quota = shares(w, window * cycle)
        reach = [int(left[i] // quota[i]) for i in np.flatnonzero(quota)]
        repeats = min(reach)
        if repeats == 0:
            # Drain what cannot fill another share, with as much of the others as is in proportion.
            part = min(1.0, float((left[quota > 0] / quota[quota > 0]).max()))
            quota, repeats = np.minimum(left, np.ceil(quota * part).astype(np.int64)), 1
        length = int(quota.sum())
        out.append(Phase(at, length, repeats, done.copy(), quota, round_robin(quota, window, at % window, quantum)))
        at += length * repeats
        done += quota * repeats
        left -= quota * repeats
    return out


def place(phases: list[Phase], queue: int, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where positions start to end of a queue go: pieces' positions in the queue, global positions, lengths."""
    q, g, n = [], [], []
    for p in phases:
        share = int(p.quota[queue])
        if not share:
            continue
        lo, hi = max(start, int(p.queue_start[queue])), min(end, int(p.queue_start[queue]) + share * p.repeats)
        if lo >= hi:
            continue
        first, last = (lo - int(p.queue_start[queue])) // share, (hi - 1 - int(p.queue_start[queue])) // share
        seg, c = p.segments[queue], np.arange(first, last + 1)[:, None]
        a = (int(p.queue_start[queue]) + c * share + seg[:, 0]).ravel()
        b = (p.start + c * p.length + seg[:, 1]).ravel()
        size = np.broadcast_to(seg[:, 2], (len(c), len(seg))).ravel()
        skip = np.maximum(lo - a, 0)
        keep = np.minimum(a + size, hi) - (a + skip)
        use = keep > 0
        q.append((a + skip)[use])
        g.append((b + skip)[use])
        n.append(keep[use])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (q, g, n))


def load_encoding(path: str, pattern: str):
    """The ids that the `tokenizers` library gives by a byte-level BPE file of its, without special tokens around a text.

    The strings of added tokens within a text are these tokens, as there. The merges are done by
    another library, by rank; so a merge's rank must be the id of what it makes, else ValueError.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    vocab, merges = found["model"]["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in found["model"]["merges"]]
    added = {x["content"]: x["id"] for x in found["added_tokens"]}
    if found["model"]["type"] != "BPE" or found["normalizer"] or any(x[k] for x in found["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError(f"not a plain byte-level BPE: {path}")
    # Bytes that are printable stand for themselves, the others in order for the characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    ranks = {bytes(map(of.__getitem__, t)): i for t, i in vocab.items() if t not in added}
    if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)) or len(ranks) != 256 + len(merges):
        raise ValueError(f"merges are not in the order of ids: {path}")
    encoding = tiktoken.Encoding("rows", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


def tokenised(df: DataFrame, tokenizer_path: str, pattern: str, id_col: str, text_col: str, queue) -> DataFrame:
    """Per row: id, queue, part (the task that read it), pos (tokens of its queue before it there), n, ids (unsigned 16-bit)."""
    few = df.select(F.col(id_col).alias("id"), queue.alias("queue"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    schema = few.drop("t").schema.add("part", "integer").add("pos", "long").add("n", "long").add("ids", "binary")

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        encode = load_encoding(tokenizer_path, pattern)
        for b in batches:
            pos, n, ids = [], [], []
            for q, t in zip(b.column(1).to_pylist(), b.column(2)):
                x = np.append(encode(t.as_py()), 0).astype("<u2")
                pos.append(seen.get(q, 0))
                n.append(len(x))
                seen[q] = pos[-1] + len(x)
                ids.append(x.tobytes())
            more = [pa.array([part] * len(n), pa.int32()), pa.array(pos, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *more], names=schema.names)

    return few.mapInArrow(run, schema)


def pack(
    df: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    targets: dict[str, float] | None = None, window: int = 1024, cycle: int = 64, quantum: int = 1, ids: bool = True,
) -> DataFrame:
    """Pieces of documents in sequences: id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with `ids`, ids (binary, unsigned 16-bit).

    Ids are those of load_encoding(), of 65,536 at most; after each document comes id 0. Without targets the
    queues keep the proportions of all tokens, so that no queue runs dry before the end; a source
    without a target comes last. Every source that has a target or a share of a token in a cycle has
    a queue of its own; the others share one that has the sum of their weights. Targets that cannot
    be applied raise ValueError: bad weights, or none of a source that is there. Only the last sequence is short. A null text is an empty one (its
    separator alone), a null source a queue of its own, repeated rows are packed each; an empty
    table gives no rows.
    """
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("")) if source_col in df.columns else F.lit("")
    if targets is not None and not all(0 <= x < float("inf") for x in targets.values()):
        raise ValueError("targets must be finite and not negative")
    rows = written(tokenised(df, tokenizer_path, pattern, id_col, text_col, source), "pack-ids")
    parts = written(rows.groupBy("queue", "part").agg(F.sum("n").alias("n")), "pack-parts")
    sources = parts.groupBy("queue").agg(F.sum("n").alias("n"))
    total = sources.agg(F.sum("n")).first()[0] or 0
    wanted = F.col("queue").isin(list(targets)) if targets else F.lit(False)
    totals = {r.queue: r.n for r in sources.where(wanted | (F.col("n") * (window * cycle) >= total)).orderBy("queue").collect()}  # at most a row for each target and each token of a cycle
    if targets is not None and total and not any(targets.get(k, 0) > 0 for k in totals):
        raise ValueError("no source that is there has a target")
    names = list(totals)
    rest = total - sum(totals.values())
    size = np.array([*totals.values(), *([rest] if rest else [])], np.int64)
    weights = size if targets is None else np.array([targets.get(k, 0.0) for k in names] + [0.0] * bool(rest))
    plan = df.sparkSession.sparkContext.broadcast(schedule(size, weights, window, cycle, quantum))
    own = df.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "queue string, number int")
    numbered = parts.join(F.broadcast(own), "queue", "left").withColumn("number", F.coalesce("number", F.lit(len(names))))
    before = F.sum("n").over(Window.partitionBy("number").orderBy("part", "queue")) - F.col("n")
    bases = written(numbered.select("queue", "part", "number", before.alias("base"), "n"), "pack-bases")
    side = bases.drop("n")
    if bases.count() <= 100_000:  # tasks times queues: some 4 MB; beyond that it is an ordinary join
        side = F.broadcast(side)
    schema = rows.select("id").schema.add("source", "string")
    for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(c, "long")
    if ids:
        schema = schema.add("ids", "binary")

    def run(batches):
        phases = plan.value
        for b in batches:
            if not b.num_rows:
                continue
            queues = b.column("number").to_numpy()
            first = b.column("base").to_numpy() + b.column("pos").to_numpy()
            n = b.column("n").to_numpy()
            found = []
            for i in np.unique(queues):
                own = np.flatnonzero(queues == i)
                own = own[np.argsort(first[own], kind="stable")]
                q, g, k = place(phases, i, int(first[own[0]]), int(first[own[-1]] + n[own[-1]]))
                order = np.argsort(q, kind="stable")
                q, g, k = q[order], g[order], k[order]
                cuts = np.union1d(q, first[own])  # pieces end at segments' and at documents' ends
                seg, doc = np.searchsorted(q, cuts, "right") - 1, np.searchsorted(first[own], cuts, "right") - 1
                length = np.append(cuts[1:], q[-1] + k[-1]) - cuts
                length = np.minimum(length, first[own][doc] + n[own][doc] - cuts)  # rows of other tasks may lie between
                use = (length > 0) & (cuts < first[own][doc] + n[own][doc])
                found.append(np.stack([own[doc], cuts - first[own][doc], length, g[seg] + cuts - q[seg]], 1)[use])
            row, start, length, at = np.concatenate(found).T
            raw = b.column("ids")
            texts = [np.frombuffer(raw[i].as_buffer(), "<u2") for i in range(b.num_rows)]
            wide, crc, piece = {}, [], []
            for r, s, m in zip(row.tolist(), start.tolist(), length.tolist()):
                x = wide.get(r)
                if x is None:
                    wide = {r: (x := texts[r].astype("<u4"))}
                crc.append(zlib.crc32(x[s : s + m]))
                if ids:
                    piece.append(texts[r][s : s + m].tobytes())
            cols = [b.column("id").take(pa.array(row)), b.column("queue").take(pa.array(row)).cast(pa.string()), *(pa.array(x, pa.int64()) for x in (start, length, np.array(crc, np.int64), n[row], at // window, at % window))]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(piece, pa.binary())] if ids else [])], names=schema.names)

    out = rows.join(side, ["queue", "part"]).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame, window: int = 1024, pad: int = 0) -> DataFrame:
    """sequence_id, n_tokens and ids, an array of `window` ids, padded at the end of the last one; from the pieces of pack()."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    one = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_join(parts, "").alias("h"))
    digits = F.transform(F.sequence(F.lit(0), F.col("n_tokens") - 1), lambda i: F.conv(F.concat(F.substring("h", (i * 4 + 3).cast("int"), F.lit(2)), F.substring("h", (i * 4 + 1).cast("int"), F.lit(2))), 16, 10).cast("int"))
    return one.select("sequence_id", "n_tokens", F.concat(digits, F.array_repeat(F.lit(pad), (F.lit(window) - F.col("n_tokens")).cast("int"))).alias("ids"))
