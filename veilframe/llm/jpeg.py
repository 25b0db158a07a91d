"""Media columns as progressive JPEG.

The decoder accumulates the scans of spectral selection and successive approximation into arrays of
coefficients, inverse-transforms them in numpy, upsamples the chroma planes and gives RGB tensors of
full resolution. Payload bytes are stored losslessly in the format's own unit: 64 bytes are the
quantised coefficients of a block, 256 added, over a luma plane and two halved chroma planes.
Long payloads are a sequence of frames, each a whole JPEG stream.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
_k = np.arange(8)
DCT = (np.where(_k[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _k + 1) * _k[:, None] * np.pi / 16)).astype(np.float32)
FRAME_BYTES = 1 << 20
_MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


# -- decoder --------------------------------------------------------------------------------------
@dataclass
class Component:
    id: int
    h: int
    v: int
    table: int
    rows: int = 0  # blocks, whole MCUs
    cols: int = 0
    own_rows: int = 0  # blocks that a scan of this component alone has
    own_cols: int = 0
    coef: np.ndarray | None = None  # blocks by 64, in zigzag order


class Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[tuple[int, int], int] = {}
        code = at = 0
        for size, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[size, code] = symbols[at]
                code += 1
                at += 1
            code <<= 1
        self.single = next(iter(self.codes.items())) if len(self.codes) == 1 else None
        sizes = {k[0] for k in self.codes}
        self.fixed = sizes.pop() if len(sizes) == 1 else 0


class Bits:
    """A segment's bits as text of 0 and 1, and as an array."""

    def __init__(self, data: bytes):
        self.array = np.unpackbits(np.frombuffer(data, np.uint8))
        self._text: str | None = None
        self.size, self.at = len(self.array), 0

    @property
    def text(self) -> str:
        if self._text is None:
            self._text = (self.array + 48).tobytes().decode()
        return self._text

    def window(self, n: int) -> str:
        """The next n bits, without all the text if only a few are looked at."""
        if self._text is None and self.size > 256:
            return (self.array[self.at : self.at + n] + 48).tobytes().decode()
        return self.text[self.at : self.at + n]

    def take(self, n: int) -> int:
        if not n:
            return 0
        got = int(self.window(n) or "0", 2)
        self.at += n
        return got

    def symbol(self, h: Huffman) -> int:
        codes = h.codes
        if h.fixed:
            return codes[h.fixed, self.take(h.fixed)]
        text, at = self.text, self.at
        code = 0
        for size in range(1, 17):
            if at + size > self.size:
                break
            code = code << 1 | (text[at + size - 1] == "1")
            got = codes.get((size, code))
            if got is not None:
                self.at = at + size
                return got
        raise ValueError("no such code")


def _value(bits: Bits, size: int) -> int:
    if not size:
        return 0
    v = bits.take(size)
    return v if v >> (size - 1) else v - (1 << size) + 1


def _dc_first(bits: Bits, own, orders, al: int) -> None:
    """own: (component, table) of the scan; orders: a row of blocks of each for each unit. Predictions start from 0."""
    slots = [h for (_, h), o in zip(own, orders) for _ in range(o.shape[1])]
    units, diffs = len(orders[0]), []
    if all(h.fixed for h in slots):
        text, at = bits.text, bits.at
        sizes = [({f"{code:0{size}b}": v for (size, code), v in h.codes.items()}, h.fixed) for h in slots]
        for _ in range(units):
            for codes, width in sizes:
                n = codes[text[at : at + width]]
                at += width
                if n:
                    d = int(text[at : at + n], 2)
                    diffs.append(d if text[at] == "1" else d - (1 << n) + 1)
                    at += n
                else:
                    diffs.append(0)
    else:
        for _ in range(units):
            for h in slots:
                diffs.append(_value(bits, bits.symbol(h)))
    grid, at = np.array(diffs, np.int32).reshape(units, -1), 0
    for (c, _), o in zip(own, orders):
        c.coef[o.ravel(), 0] = grid[:, at : at + o.shape[1]].ravel().cumsum() << al
        at += o.shape[1]


def _ac_first(bits: Bits, c: Component, index: np.ndarray, ss: int, se: int, al: int, h: Huffman) -> None:
    if h.single and h.single[1] >> 4 == 0 and h.single[1] & 15:  # every coefficient has the same code and size
        (size, code), s = h.single
        width, n = size + (s & 15), len(index) * (se - ss + 1)
        rows = bits.array[: n * width].reshape(n, width)
        s &= 15
        if s <= 8:
            v = np.packbits(rows[:, size:] if s < 8 else np.ascontiguousarray(rows[:, size:]).ravel(), axis=1 if s < 8 else None).ravel().astype(np.int32) >> (8 - s)
        else:
            v = rows[:, size:].astype(np.int32) @ (1 << np.arange(s)[::-1])
        if not (v >> (s - 1)).all():
            v = np.where(v >> (s - 1), v, v - (1 << s) + 1)
        c.coef[index, ss : se + 1] = (v << al).reshape(len(index), -1)
        return
    run = 0
    for i in index.tolist():
        if run:
            run -= 1
            continue
        k = ss
        while k <= se:
            rs = bits.symbol(h)
            r, s = rs >> 4, rs & 15
            if s:
                k += r
                c.coef[i, k] = _value(bits, s) << al
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + bits.take(r) - 1
                break


def _ac_refine(bits: Bits, c: Component, index: np.ndarray, ss: int, se: int, al: int, h: Huffman) -> None:
    bit, b = 1 << al, 0

    def correct(block: np.ndarray, k: int, upto: int) -> None:
        own = c.coef[block, k : upto + 1]
        if own.size and own.min() > 0:
            got = bits.array[bits.at : bits.at + own.size].reshape(own.shape)
            bits.at += own.size
            c.coef[block, k : upto + 1] = own | got.astype(np.int32) << al
            return
        where = own != 0
        n = int(np.count_nonzero(where))
        got = bits.array[bits.at : bits.at + n].astype(np.int32)
        bits.at += n
        vals = own[where]
        own[where] = vals + np.where(vals > 0, bit, -bit) * got * ((np.abs(vals) & bit) == 0)
        c.coef[block, k : upto + 1] = own

    while b < len(index):
        k = ss
        while k <= se:
            rs = bits.symbol(h)
            r, s = rs >> 4, rs & 15
            if s == 0 and r < 15:
                run = (1 << r) + bits.take(r)
                if k > ss:
                    correct(index[b : b + 1], k, se)
                    b += 1
                    run -= 1
                if run:  # whole blocks at once: a correction for each coefficient with a history
                    correct(index[b : b + run], ss, se)
                b += run - 1
                break
            new = 0
            if s:
                new = bit if bits.take(1) else -bit
            row = c.coef[index[b]]
            while k <= se:
                if row[k]:
                    if bits.take(1) and not abs(int(row[k])) & bit:
                        row[k] += bit if row[k] > 0 else -bit
                else:
                    if r == 0:
                        if s:
                            row[k] = new
                        k += 1
                        break
                    r -= 1
                k += 1
        b += 1


def _baseline(bits: Bits, blocks, dc, ac) -> None:
    last: dict[int, int] = {}
    for c, i in blocks:
        last[c.id] = value = last.get(c.id, 0) + _value(bits, bits.symbol(dc[c.id]))
        c.coef[i, 0] = value
        k = 1
        while k < 64:
            rs = bits.symbol(ac[c.id])
            r, s = rs >> 4, rs & 15
            if s:
                k += r
                c.coef[i, k] = _value(bits, s)
            elif r < 15:
                break
            else:
                k += 15
            k += 1


class Image:
    """A decoded stream: components with coefficients, quantisation tables, comments; `end` is after its last byte."""

    def __init__(self, data: bytes, at: int = 0):
        self.tables: dict[int, np.ndarray] = {}
        self.components: list[Component] = []
        self.comments: list[bytes] = []
        self.width = self.height = self.restart = 0
        self.colour: int | None = None  # as an Adobe segment says: 0 as they are, 1 luma and chroma, 2 that with black
        self.room = 8 * (len(data) - at)
        self.orders: dict[tuple[int, bool], np.ndarray] = {}
        huffman: dict[tuple[int, int], Huffman] = {}
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("not a JPEG stream")
        at += 2
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            kind = data[at + 1]
            at += 2
            if kind == 0xD9:
                break
            size = int.from_bytes(data[at : at + 2], "big")
            body = data[at + 2 : at + size]
            at += size
            if kind == 0xFE:
                self.comments.append(body)
            elif kind == 0xEE and body[:5] == b"Adobe" and len(body) > 11:
                self.colour = body[11]
            elif kind == 0xDB:
                self._quantisation(body)
            elif kind == 0xC4:
                while body:
                    counts = body[1:17]
                    n = sum(counts)
                    huffman[body[0] >> 4, body[0] & 15] = Huffman(counts, body[17 : 17 + n])
                    body = body[17 + n :]
            elif kind in (0xC0, 0xC1, 0xC2):
                self.progressive = kind == 0xC2
                self._frame(body)
            elif kind == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif kind == 0xDA:
                found = _MARKER.search(data, at)
                if not found:
                    raise ValueError("stream ends early")
                raw = data[at : found.start()]
                at = found.start()
                self._scan(body, raw, huffman)
            elif 0xC3 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
                raise ValueError(f"frames of kind {kind:#x} are not read")
        self.end = at

    def _quantisation(self, body: bytes) -> None:
        while body:
            wide, i = body[0] >> 4, body[0] & 15
            n = 128 if wide else 64
            self.tables[i] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int32)
            body = body[1 + n :]

    def _frame(self, body: bytes) -> None:
        """A block has a bit at least of the first scan of its component, so that a stream has no more blocks than bits; ValueError else."""
        depth, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if depth != 8 or not self.height or not self.width or n not in (1, 3, 4):
            raise ValueError(f"frames of {n} components, {depth} bits, {self.width} by {self.height} are not read")
        self.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        if len({c.id for c in self.components}) < n or not all(0 < x < 5 for c in self.components for x in (c.h, c.v)):
            raise ValueError("bad components")
        if n == 1:  # one alone is not interleaved, whatever it says
            self.components[0].h = self.components[0].v = 1
        self.h, self.v = max(c.h for c in self.components), max(c.v for c in self.components)
        self.mcu_cols, self.mcu_rows = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        if self.mcu_cols * self.mcu_rows * len(self.components) > self.room:
            raise ValueError("the frame is larger than its stream can fill")
        for c in self.components:
            c.rows, c.cols = self.mcu_rows * c.v, self.mcu_cols * c.h
            c.own_rows, c.own_cols = -(-(-(-self.height * c.v // self.v)) // 8), -(-(-(-self.width * c.h // self.h)) // 8)
            c.coef = np.zeros((c.rows * c.cols, 64), np.int32)

    def order(self, c: Component, alone: bool) -> np.ndarray:
        """Indexes of a component's blocks in scan order; of an interleaved scan, a row for each MCU."""
        if (c.id, alone) not in self.orders:
            self.orders[c.id, alone] = self._order(c, alone)
        return self.orders[c.id, alone]

    def _order(self, c: Component, alone: bool) -> np.ndarray:
        grid = np.arange(c.rows * c.cols).reshape(c.rows, c.cols)
        if alone:
            return grid[: c.own_rows, : c.own_cols].ravel()
        return grid.reshape(self.mcu_rows, c.v, self.mcu_cols, c.h).transpose(0, 2, 1, 3).reshape(-1, c.v * c.h)

    def _scan(self, head: bytes, raw: bytes, huffman) -> None:
        n = head[0]
        own = []
        for i in range(n):
            c = next(c for c in self.components if c.id == head[1 + 2 * i])
            own.append((c, head[2 + 2 * i] >> 4, head[2 + 2 * i] & 15))
        ss, se, ah, al = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        segments = [x.replace(b"\xff\x00", b"\xff") for x in (_RESTART.split(raw) if self.restart else [raw])]
        alone = n == 1
        orders = [self.order(c, alone) for c, _, _ in own]
        units = len(orders[0])
        step = self.restart or max(units, 1)
        for s, data in enumerate(segments):
            lo, hi = s * step, min(units, (s + 1) * step)
            if lo >= hi:
                break
            bits = Bits(data)
            if self.progressive and ss:
                c, _, t = own[0]
                (_ac_refine if ah else _ac_first)(bits, c, orders[0][lo:hi], ss, se, al, huffman[1, t])
                continue
            if self.progressive and ah:  # one bit for each block
                widths = [1 if alone else o.shape[1] for o in orders]
                got = bits.array[: (hi - lo) * sum(widths)].reshape(hi - lo, -1).astype(np.int32)
                at = 0
                for (c, _, _), o, w in zip(own, orders, widths):
                    c.coef[o[lo:hi].ravel(), 0] |= got[:, at : at + w].ravel() << al
                    at += w
                continue
            rows = [o[lo:hi].reshape(hi - lo, -1) for o in orders]
            if self.progressive:
                _dc_first(bits, [(c, huffman[0, t]) for c, t, _ in own], rows, al)
                continue
            lists = [o.tolist() for o in rows]
            blocks = [(c, i) for m in range(hi - lo) for (c, _, _), x in zip(own, lists) for i in x[m]]
            _baseline(bits, blocks, {c.id: huffman[0, t] for c, t, _ in own}, {c.id: huffman[1, t] for c, _, t in own})

    def plane(self, c: Component) -> np.ndarray:
        """A component's samples, upsampled to the frame's size."""
        x = np.empty((len(c.coef), 64), np.float32)
        x[:, ZIGZAG] = c.coef * self.tables[c.table]
        x = (x.reshape(-1, 8) @ DCT).reshape(-1, 8, 8).transpose(0, 2, 1)  # rows, then columns
        x = (np.ascontiguousarray(x).reshape(-1, 8) @ DCT).reshape(c.rows, c.cols, 8, 8)
        p = x.transpose(0, 3, 1, 2).reshape(c.rows * 8, c.cols * 8) + 128
        if self.v % c.v or self.h % c.h:
            return p[np.arange(self.height) * c.v // self.v][:, np.arange(self.width) * c.h // self.h]
        if (self.v // c.v, self.h // c.h) != (1, 1):
            p = p.repeat(self.v // c.v, 0).repeat(self.h // c.h, 1)
        return p[: self.height, : self.width]

    def rgb(self) -> np.ndarray:
        """Height by width by 3, unsigned bytes."""
        if not self.components or any(len(self.tables.get(c.table, ())) != 64 for c in self.components):
            raise ValueError("no frame, or a table is missing")
        planes = [self.plane(c) for c in self.components]
        if len(planes) == 1:
            y = np.clip(np.rint(planes[0]), 0, 255).astype(np.uint8)
            return np.repeat(y[:, :, None], 3, 2)
        planes = [np.clip(p, 0, 255) for p in planes]
        out = np.empty((self.height, self.width, 3), np.float32)
        plain = bytes(c.id for c in self.components) == b"RGB" if self.colour is None else self.colour == 0
        if plain or len(planes) == 4 and self.colour != 2:
            for i in range(3):
                out[:, :, i] = planes[i]
        else:
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            out[:, :, 0] = y + 1.402 * cr
            out[:, :, 1] = y - 0.344136 * cb - 0.714136 * cr
            out[:, :, 2] = y + 1.772 * cb
        if len(planes) == 4:  # inks are stored as what they leave of the light; the fourth dims the others
            out = np.clip(out, 0, 255) * (planes[3][:, :, None] / 255)
        return np.clip(np.rint(out, out), 0, 255).astype(np.uint8)


# -- payloads -------------------------------------------------------------------------------------
def _segment(kind: int, body: bytes) -> bytes:
    return b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body


def _entropy(bits: np.ndarray) -> bytes:
    more = -len(bits) % 8
    if more:
        bits = np.concatenate([bits, np.ones(more, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _scan(parts: tuple[tuple[int, int], ...], ss: int, se: int, ah: int, al: int, bits: np.ndarray) -> bytes:
    return _segment(0xDA, bytes([len(parts), *[x for p in parts for x in p], ss, se, ah << 4 | al])) + _entropy(bits)


def _table(kind: int, i: int, size: int, symbols: bytes) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | i]) + bytes(len(symbols) if s == size else 0 for s in range(1, 17)) + symbols)


_DC = _table(0, 0, 4, bytes(range(11)))  # sizes of differences, four bits each
_AC = _table(1, 0, 1, b"\x08")  # of every coefficient, eight bits follow
_RUNS = _table(1, 1, 5, bytes(r << 4 for r in range(15)))  # runs of blocks with corrections only
_ONES = _segment(0xDB, b"\x00" + b"\x01" * 64)
_SIZE = np.array([int(x).bit_length() for x in range(1024)])
_SHIFTS = np.arange(14)[::-1]


def encode_frame(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload's bytes plus 256; its length is in a comment."""
    n = len(payload) // 64
    m = -(-n // 6)
    w = isqrt(m - 1) + 1
    h = -(-m // w)
    coef = np.zeros((6 * w * h, 64), np.uint8)
    coef[:n] = np.frombuffer(payload, np.uint8).reshape(n, 64)
    y = np.arange(4 * w * h).reshape(h, 2, w, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
    chroma = np.arange(w * h)
    mcu = np.concatenate([y, (4 * w * h + chroma)[:, None], (5 * w * h + chroma)[:, None]], 1)
    out = [
        b"\xff\xd8", _ONES, _segment(0xFE, struct.pack(">Q", len(payload))),
        _segment(0xC2, struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"), _DC, _AC, _RUNS,
    ]
    every = ((1, 0), (2, 0), (3, 0))
    # DC, all but the last bit: differences within each component, in the order of the MCUs.
    half = 128 + (coef[:, 0] >> 1).astype(np.int32)
    diff = np.empty((w * h, 6), np.int32)
    for lo, hi in ((0, 4), (4, 5), (5, 6)):
        diff[:, lo:hi] = np.diff(half[mcu[:, lo:hi]].ravel(), prepend=0).reshape(-1, hi - lo)
    diff = diff.ravel()
    size = _SIZE[np.abs(diff)]
    word = (size << size) | np.where(diff < 0, diff + (1 << size) - 1, diff)  # four bits of size, then as many bits
    grid = (word[:, None] >> _SHIFTS & 1).astype(np.uint8)
    out.append(_scan(every, 0, 0, 0, 1, grid[_SHIFTS[None] < (4 + size)[:, None]]))
    # AC, all but the last bit; luma in two bands.
    planes = ((1, coef[: 4 * w * h]), (2, coef[4 * w * h : 5 * w * h]), (3, coef[5 * w * h :]))
    for ss, se, some in ((1, 5, planes[:1]), (1, 63, planes[1:]), (6, 63, planes[:1])):
        for i, own in some:
            v = np.ascontiguousarray(own[:, ss : se + 1] >> 1 | 128)
            bits = np.zeros((v.size, 9), np.uint8)
            bits[:, 1:] = np.unpackbits(v.ravel()).reshape(-1, 8)
            out.append(_scan(((i, 0),), ss, se, 0, 1, bits.ravel()))
    # The last bits: a run over all blocks, with one correction for each coefficient.
    out.append(_scan(every, 0, 0, 1, 0, coef[mcu.ravel(), 0] & 1))
    for i, own in planes:
        r = len(own).bit_length() - 1
        lead = f"{r:05b}" + (f"{len(own) - (1 << r):0{r}b}" if r else "")
        bits = np.concatenate([np.frombuffer(lead.encode(), np.uint8) - 48, (own[:, 1:] & 1).ravel()])
        out.append(_scan(((i, 1),), 1, 63, 1, 0, bits))
    out.append(b"\xff\xd9")
    return b"".join(out)


def encode_payload(payload: bytes) -> bytes:
    """Frames of at most FRAME_BYTES; the payload's length is a positive multiple of 64."""
    return b"".join(encode_frame(payload[i : i + FRAME_BYTES]) for i in range(0, len(payload), FRAME_BYTES))


def frames(media: bytes):
    """The images of a sequence of streams; ValueError for all that cannot be decoded."""
    at = 0
    while at < len(media):
        try:
            image = Image(media, at)
        except (LookupError, ArithmeticError, TypeError, AttributeError, StopIteration, MemoryError, struct.error) as e:
            raise ValueError(f"corrupt stream: {e!r}") from None
        at = image.end
        yield image


def payload_of(image: Image) -> bytes:
    n = struct.unpack(">Q", image.comments[0])[0]
    coef = np.concatenate([c.coef for c in image.components])
    return (coef - 256).astype(np.uint8).tobytes()[:n]


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % 64 or (0 if text else 64))


def store(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_bytes and media (binary): each text's UTF-8 bytes with zeros up to a positive multiple of 64. A null text is empty."""
    few = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    schema = few.drop("t").schema.add("n_bytes", "long").add("media", "binary")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(part.num_columns - 1).to_pylist()
                cols = [pa.array([len(t) for t in texts], pa.int64()), pa.array([encode_payload(padded(t)) for t in texts], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cols], names=schema.names)

    return few.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def features(stored: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """What the stored streams hold: payload sizes and hashes, and a feature string of the RGB tensors: mean and deviation of each channel.

    One row per row. A null stream, and one that is not of store()'s kind or is damaged, has nulls
    (but its own size and hash if it is not null); equal streams have equal values; an empty table
    gives no rows; other columns are ignored.
    """
    few = stored.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(media_col).alias("m"))
    schema = few.drop("m").schema
    for c, kind in (("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")):
        schema = schema.add(c, kind)

    def one(media: bytes | None):
        if media is None:
            return (None,) * 6
        try:
            return read(media)
        except (ValueError, struct.error, IndexError, ZeroDivisionError):  # damaged, or without a comment that has the payload's size
            return None, None, None, len(media), hashlib.sha256(media).hexdigest(), None

    def read(media: bytes):
        sha, size, tail, n = hashlib.sha256(), 0, b"", 0
        total, square = np.zeros(3), np.zeros(3)
        for image in frames(media):
            own = payload_of(image)
            sha.update(own)
            size += len(own)
            tail = own[-64:]
            x = image.rgb().reshape(-1, 3)
            n += len(x)
            for i in range(3):
                counts = np.bincount(x[:, i], minlength=256)
                total[i] += counts @ np.arange(256)
                square[i] += counts @ np.arange(256) ** 2
        mean = total / n
        dev = np.sqrt(np.maximum(square / n - mean**2, 0))
        text = ",".join(f"{a:.3f}/{d:.3f}" for a, d in zip(mean, dev))
        return size, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), text

    def run(batches):
        for b in batches:
            cols = list(zip(*map(one, b.column(b.num_columns - 1).to_pylist()))) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, k) for c, k in zip(cols, kinds))], names=schema.names)

    return few.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def tensors(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns, frame, height, width and rgb (binary, row by row, three bytes a pixel), a row for each frame.

    A null or empty stream has no rows; one that is not a baseline or progressive JPEG, or is damaged
    so that it cannot be decoded, has one with nulls. Frames have one (grey), three or four components
    of 8 bits, with any sampling; chroma is upsampled by its nearest sample. Equal streams have equal rows.
    """
    few = df.where(F.col(media_col).isNotNull()).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(media_col).alias("m"))
    schema = few.drop("m").schema.add("frame", "integer").add("height", "integer").add("width", "integer").add("rgb", T.BinaryType())

    def run(batches):
        for b in batches:
            for r, media in enumerate(b.column(b.num_columns - 1).to_pylist()):
                rows = []
                try:
                    for i, image in enumerate(frames(media)):
                        rows.append((i, image.height, image.width, image.rgb().tobytes()))
                except ValueError:
                    rows = [(None, None, None, None)]
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
                own = [b.column(j).take(pa.array([r] * len(rows), pa.int64())) for j in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds))], names=schema.names)

    return few.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})
