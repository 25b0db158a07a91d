"""Byte-level BPE by monoid tree reduction.

A text is cut in halves down to small leaves. An element of the monoid is the list of a span's
matches of the split pattern; two neighbours are joined by matching again from a boundary that no
text beyond the left span can move, until a match ends where a match of the right span ends: the
pattern looks only ahead, so all after that is unchanged. Inside a match, tokens of two halves are
joined by merging a growing window around the seam, until the tokens at both its edges form valid
pairs with their outer neighbours: a token sequence is the encoding if and only if each adjacent
pair is. Decoding concatenates bytes up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF_CHARS = 2048
SHORT = 12  # spans of so many bytes are remembered
AHEAD = 3  # a contraction looks so far ahead


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encoder and decoder of one vocabulary; caches are bounded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 1_000_000):
        import regex

        self.ranks, self.pattern, self.limit = ranks, regex.compile(pattern), cache
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.token[v] = k
        self.byte = [[ranks[bytes([i])]] if bytes([i]) in ranks else None for i in range(256)]
        self.known: dict[str, bytes] = {}
        self.spans: dict[bytes, list[int]] = {}
        self.pairs: dict[tuple[int, int], list[int]] = {}

    # -- inside a match --------------------------------------------------------------------------
    def merge(self, piece: bytes) -> list[int]:
        """Merges by rank, the least first and from the left, of a window."""
        if len(piece) > 32:
            return self.merge_long(piece)
        get, parts = self.ranks.get, [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def merge_long(self, piece: bytes) -> list[int]:
        """Merges by rank in n log n steps, for windows that do not settle early."""
        n, get = len(piece), self.ranks.get
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i + 1], 1) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, right, size = heappop(heap)
            j = after[i]
            if parts[i] is None or len(parts[i]) != size or j >= n or parts[j] != right:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = parts[i] + right, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(parts[i] + parts[k])) is not None:
                    heappush(heap, (r, i, parts[k], len(parts[i])))
            if (h := before[i]) >= 0 and (r := get(parts[h] + parts[i])) is not None:
                heappush(heap, (r, h, parts[i], len(parts[h])))
        return [self.ranks[p] for p in parts if p is not None]

    def pair(self, a: int, b: int) -> list[int]:
        """The encoding of the bytes of two tokens, which is valid as it is if it is these two."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= self.limit:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(self.token[a] + self.token[b])
        return found

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes together."""
        if not left or not right:
            return left + right
        k, mid = 1, self.pair(left[-1], right[0])
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            if (i == 0 or self.pair(left[i - 1], mid[0]) == [left[i - 1], mid[0]]) and (j == len(right) or self.pair(mid[-1], right[j]) == [mid[-1], right[j]]):
                return left[:i] + mid + right[j:]
            k *= 2
            mid = self.merge(b"".join(map(self.token.__getitem__, left[-k:] + right[:k])))

    def tree(self, piece: bytes) -> list[int]:
        """By halves, down to single bytes."""
        n = len(piece)
        if n < 2:
            return self.byte[piece[0]] if n else []
        found = self.spans.get(piece)
        if found is None:
            found = self.join_tokens(self.tree(piece[: n // 2]), self.tree(piece[n // 2 :]))
            if n <= SHORT:
                if len(self.spans) >= self.limit:
                    self.spans.clear()
                self.spans[piece] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.tree(piece)

    def encode_match(self, match: str) -> bytes:
        """The ids of one match as little-endian unsigned 32-bit integers."""
        found = self.known.get(match)
        if found is None:
            if len(self.known) >= self.limit:
                self.known.clear()
            found = array("I", self.encode_piece(match.encode())).tobytes()
            if len(match) <= 64:
                self.known[match] = found
        return found

    # -- over matches ----------------------------------------------------------------------------
    def matches(self, text: str) -> list[str]:
        """All matches of the pattern, by halves."""
        if len(text) <= LEAF_CHARS:
            return self.pattern.findall(text)
        half = len(text) // 2
        return self.join_matches(self.matches(text[:half]), self.matches(text[half:]))

    def join_matches(self, left: list[str], right: list[str]) -> list[str]:
        """The matches of two neighbours' text together."""
        if not left or not right:
            return left + right
        # Matches are kept on the left if they end before what any match could look at beyond the seam.
        i, size, solid = len(left), 0, 0
        while i and solid <= AHEAD:
            i -= 1
            size += len(left[i])
            solid += len(left[i]) if solid else len(left[i].rstrip())
        head = "".join(left[i:])
        k = 1
        while True:
            window = head + "".join(right[:k])
            ends, at = set(), len(head)
            for m in right[:k]:
                at += len(m)
                ends.add(at)
            done = k >= len(right)
            at, mid = 0, []
            for m in self.pattern.findall(window):
                at += len(m)
                mid.append(m)
                # A match settles the seam if it ends with one of the right and saw all that it could look at.
                if at in ends and len(window) - at > AHEAD and window[at:].strip():
                    skip = 0
                    rest = at - len(head)
                    while rest > 0:
                        rest -= len(right[skip])
                        skip += 1
                    return left[:i] + mid + right[skip:]
            if done:
                return left[:i] + mid
            k *= 2

    # -- documents -------------------------------------------------------------------------------
    def encode(self, text: str) -> bytes:
        return b"".join(map(self.encode_match, self.matches(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, halves first."""
        if len(ids) <= 65536:
            return b"".join(map(self.token.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """The kept columns and n_tokens, ids (binary, little-endian unsigned 32-bit), ids_sha256, decoded_sha256.

    decoded_sha256 is of the bytes that the ids decode to. A null text is an empty one; without
    `ids` that column is left out. The vocabulary file must be readable on every executor.
    """
    few = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    schema = few.drop("t").schema
    for name, kind in [("n_tokens", "long"), *([("ids", "binary")] if ids else []), ("ids_sha256", "string"), ("decoded_sha256", "string")]:
        schema = schema.add(name, kind)

    def run(batches):
        codec, sha = Codec(load_ranks(ranks_path), pattern), hashlib.sha256
        for b in batches:
            n, raw, one, two = [], [], [], []
            for text in b.column(b.num_columns - 1):
                got = codec.encode(text.as_py())
                n.append(len(got) // 4)
                one.append(sha(got).hexdigest())
                two.append(sha(codec.decode(np.frombuffer(got, "<u4"))).hexdigest())
                if ids:
                    raw.append(got)
            cols = [pa.array(n, pa.int64()), *([pa.array(raw, pa.binary())] if ids else []), pa.array(one, pa.string()), pa.array(two, pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=schema.names)

    return few.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})
