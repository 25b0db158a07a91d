import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import chat, jpeg, langid


def test_layouts_by_fingerprint(spark):
    records = [
        {"prompt": "p", "response": "r"},
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "<turn u>"}, {"content": None, "role": "assistant"}]},
        {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]},
        {"output": "o", "input": "", "instruction": "i"},
        {"data": {"chat": [{"speaker": "bot", "utterance": "b"}]}},
        {"other": 1},
    ]
    rows = [(json.dumps(r), 1) for r in records] + [(None, 1), ("{", 1)]
    got = chat.canonical(spark.createDataFrame(rows, "record string, turns int")).collect()
    turns = [None if r.turns is None else [(t.role, t.text) for t in r.turns] for r in got]
    assert turns[0] == [("user", "p"), ("assistant", "r")] and turns[2] == [("user", "h"), ("assistant", "g")]
    assert turns[3] == [("user", "i"), ("user", ""), ("assistant", "o")] and turns[4] == [("assistant", "b")] and turns[5:] == [None, None, None]
    assert [r.layout for r in got][:3] == ["prompt_response", "messages", "conversations"]
    assert turns[1][1] == ("user", "<turn u>")


def test_round_trip_and_mask(spark):
    rng = random.Random(1)
    said = ["\\### Assistant: </turn> ok", "", "\\", "\\\\l<", "</turn>\n<turn assistant>x</turn>\n", "é漢😀\\n"] + ["".join(rng.choice("\\<>ln\n/turé") for _ in range(20)) for _ in range(60)]
    rows = [(i // 4, i % 4, rng.choice(["user", "assistant", "a>b<\n\\g"]), x) for i, x in enumerate(said)] + [(99, None, None, None)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, x string")
    out = chat.format_rows(df)
    back = {r.conv_id: [(t.role, t.text) for t in r.b] for r in out.select("conv_id", chat.parsed(F.col("formatted")).alias("b")).collect()}
    want = {}
    for c, _, r, x in rows:
        want.setdefault(c, []).append((r or "", x or ""))
    assert back == want
    for r in chat.digests(out).collect():
        mine = "".join(x for role, x in want[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(want[r.conv_id]), len(mine), hashlib.sha256(mine.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want[r.conv_id]).encode()).hexdigest()
    assert chat.format_rows(df.where("false")).count() == 0


def test_chat_equals_sql(spark):
    import duckdb

    from veilframe.llm import queries

    con = duckdb.connect()
    con.sql("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    r = con.sql(queries.oracle_sql()["op4_chat_formatting"])
    got = queries.queries()["op4_chat_formatting"](spark, "/root/testdata/sf0.001").select(*r.columns).collect()
    assert sorted(map(tuple, got)) == sorted(r.fetchall())


def test_payloads_survive(spark, table, docs, monkeypatch):
    monkeypatch.setattr(jpeg, "FRAME_BYTES", 1 << 14)  # the long text has several frames
    for _, t, *_ in docs[:3] + docs[-6:-1]:
        p = jpeg.padded((t or "").encode())
        media = jpeg.encode_payload(p)
        assert b"".join(map(jpeg.payload_of, jpeg.frames(media))) == p and len(p) % 64 == 0 and p
    out = {r.doc_id: r for r in jpeg.features(jpeg.store(table)).collect()}
    for i, t, *_ in docs:
        raw = (t or "").encode()
        p = jpeg.padded(raw)
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert out[100].media_sha256 == out[0].media_sha256 and out[100].feature == out[0].feature
    assert jpeg.features(jpeg.store(table.where("false"))).count() == 0


def test_tensors_and_bad_streams(spark):
    media = jpeg.encode_payload(bytes(range(256)) * 8)
    rows = jpeg.tensors(spark.createDataFrame([(1, bytearray(media)), (2, bytearray(b"no")), (3, None)], "id long, media binary"), keep=("id",)).collect()
    good = next(r for r in rows if r.id == 1)
    assert len(good.rgb) == good.height * good.width * 3 and [r.height for r in rows if r.id == 2] == [None] and len(rows) == 2


def test_decoder_transform():
    """A block with only a DC coefficient is flat, and the transform is orthonormal."""
    assert np.allclose(jpeg.DCT @ jpeg.DCT.T, np.eye(8), atol=1e-6)
    image = next(jpeg.frames(jpeg.encode_frame(b"\0" * 384)))
    assert image.progressive and (image.width, image.height) == (16, 16) and image.rgb().shape == (16, 16, 3)


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.fold("doc_id", 3) == 1
    model = langid.fit(docs.where(~held))
    out = langid.classify(docs.where(held), model, keep=("doc_id", "lang")).toPandas()
    known = out[out.lang.notna() & (out.lang_pred != "und")]
    assert (known.lang == known.lang_pred).mean() > 0.97
    assert out.score.between(0, 1).all() and out[out.lang_pred != "und"].rejected.mean() < 0.02


def test_language_odd_texts(spark, table):
    model = langid.fit(table.where("lang is not null"))
    got = {r.doc_id: r for r in langid.classify(table, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (130, 131, 132))
    assert got[134].lang_pred in ("en", "de") and langid.fit(table.where("false")) == {}
    assert langid.classify(table, {}).where("lang_pred <> 'und'").count() == 0
    kept = langid.accepted(table, model)
    assert kept.columns == table.columns and kept.count() <= table.count()


def test_language_of_many_copies(spark):
    """A text that is there very often takes no place from the others of its language."""
    rows = [("aa", "the same words again and again")] * 20_000 + [("aa", f"own{chr(97 + i % 26)}{chr(97 + i // 26)} text") for i in range(40)]
    rows += [("bb", f"eigen{chr(97 + i % 26)}{chr(97 + i // 26)} wort") for i in range(300)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert list(model) == ["aa", "bb"]
    assert model["aa"].count(b"own") == 40 and model["aa"].count(b"the same words") == 1 and model["bb"].count(b"eigen") == 64


def test_sizes_by_hand(spark):
    """Whole texts, in blocks, by compressors made one by one for each; the least size wins, the first of equals."""
    import zstandard as z

    rng = random.Random(2)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(200)] for lang, letters in (("aa", "abcde"), ("bb", "defgh"), ("cc", "xyzuv"))}
    rows = [(lang, " ".join(rng.choice(own) for _ in range(rng.choice([3, 50, 3000])))) for lang, own in words.items() for _ in range(20)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert all(len(model[k]) >= sum(len(t) for x, t in rows if x == k) for k in words)  # no text is cut
    got = {r.text: (r.lang_pred, r.score) for r in langid.classify(spark.createDataFrame(rows, "lang string, text string"), model, keep=("text",)).collect()}
    for _, text in rows:
        raw, sizes = text.encode(), []
        for content in model.values():
            params = z.ZstdCompressionParameters.from_level(6, source_size=4096, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
            own = z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params)
            sizes.append(sum(len(own.compress(raw[i : i + 4096])) for i in range(0, len(raw), 4096)))
        best = min(sizes)
        lang, score = got[text]
        first, second = sorted(sizes)[:2]
        if second - first > 2:  # a prepared dictionary may differ by a byte or two
            assert lang == list(model)[sizes.index(best)] and abs(score - (second - first) / second) < 0.1


def test_every_language_is_learned(spark):
    rng = random.Random(8)
    rows = []
    for i in range(80):
        words = ["".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(7)) for _ in range(12)]
        rows += [(f"l{i:02}", " ".join(rng.choice(words) for _ in range(30))) for _ in range(9)]
    df = spark.createDataFrame(rows, "lang string, text string")
    model = langid.fit(df)
    assert set(model) == {x for x, _ in rows}
    got = langid.classify(df, model, keep=("lang",)).collect()
    assert all(r.lang == r.lang_pred for r in got)
    few = langid.fit(df, docs=160)  # two documents for each
    assert set(few) == set(model) and all(abs(len(v) - 2 * 239) <= 2 for v in few.values())
    assert len(langid.fit(df, docs=20)) == 80


def test_layouts_with_more_or_fewer_fields(spark):
    records = [
        {"id": 7, "prompt": "p", "response": "r"},
        {"messages": [{"role": "user", "content": "u", "name": "x"}, {"role": "bot"}], "id": "m"},
        {"id": 1, "system": "s", "instruction": "i", "input": "n", "output": "o", "tags": ["a"]},
        {"prompt": "p", "response": None, "n": 1},
        {"id": 3, "prompt": "p"},
        {"id": 3, "messages": []},
        {"id": 3, "messages": ["no", 1]},
        {"data": {"chat": [{"speaker": "human", "utterance": "h", "at": 1}], "more": {}}},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, record string")
    got = [None if r.turns is None else [(t.role, t.text) for t in r.turns] for r in chat.canonical(df).orderBy("i").collect()]
    assert got == [
        [("user", "p"), ("assistant", "r")],
        [("user", "u"), ("assistant", "")],
        [("system", "s"), ("user", "i"), ("user", "n"), ("assistant", "o")],
        [("user", "p")],
        None,
        None,
        None,
        [("user", "h")],
    ]


def test_query_goes_through_records(spark):
    said = ["\\### Assistant: </turn> ok", "", "\\", "é漢😀\\n\n\t\0\"", "</turn>\n<turn assistant>x"]
    df = spark.createDataFrame([(i // 2, i, ["human", "a>b<\n\\g"][i % 2], x) for i, x in enumerate(said)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = chat.format_records(chat.records(df)).collect()
    assert {r.layout for r in got} == {"table"}
    assert sorted(map(str, (r.asDict() for r in chat.digests(chat.format_records(chat.records(df))).collect()))) == sorted(map(str, (r.asDict() for r in chat.digests(chat.format_rows(df)).collect())))


class StreamWriter:
    """Writes known coefficients as a JPEG with codes of many lengths; not the library's own writer."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> i) & 1 for i in range(n - 1, -1, -1)]

    def symbol(self, s):
        # Two symbols of one to three bits each, then the others of sixteen, in order of their values.
        order = {0: (0, 2), 1: (1, 2), 0x11: (4, 3), 2: (5, 3)}
        code = order.get(s)
        if code is None:
            rest = [x for x in range(256) if x not in order]
            code = (0xC000 + rest.index(s), 16)
        self.put(*code)

    @staticmethod
    def table(kind):
        order = [0, 1, 0x11, 2]
        rest = [x for x in range(256) if x not in order]
        counts = [0, 2, 2] + [0] * 12 + [252]
        return segment(0xC4, bytes([kind << 4]) + bytes(counts) + bytes(order + rest))

    def value(self, v, n):
        self.put(v if v > 0 else v + (1 << n) - 1, n)

    def done(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        self.bits = []
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def segment(kind, body):
    return b"\xff" + bytes([kind]) + (len(body) + 2).to_bytes(2, "big") + body


def toward_zero(v, al):
    return (abs(v) >> al) * (1 if v > 0 else -1)


def write_jpeg(size, samplings, coefs, quant, progressive, restart=0):
    """coefs: by component, rows by columns by 64 in zigzag order, of whole MCUs."""
    height, width = size
    h, v = max(x for x, _ in samplings), max(y for _, y in samplings)
    cols, rows = -(-width // (8 * h)), -(-height // (8 * v))
    n, w = len(samplings), StreamWriter()
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, b"\x00" + bytes(quant)) + StreamWriter.table(0) + StreamWriter.table(1)
    out += segment(0xC2 if progressive else 0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([i + 1, x << 4 | y, 0]) for i, (x, y) in enumerate(samplings)))
    if restart:
        out += segment(0xDD, restart.to_bytes(2, "big"))

    def blocks(own):
        """Of a scan, units of (component, block)."""
        if len(own) > 1 or n == 1:
            for my in range(rows):
                for mx in range(cols):
                    yield [(i, coefs[i][my * samplings[i][1] + y][mx * samplings[i][0] + x]) for i in own for y in range(samplings[i][1]) for x in range(samplings[i][0])]
        else:
            (i,) = own
            for y in range(-(-(-(-height * samplings[i][1] // v)) // 8)):
                for x in range(-(-(-(-width * samplings[i][0] // h)) // 8)):
                    yield [(i, coefs[i][y][x])]

    def scan(own, ss, se, ah, al):
        nonlocal out
        out += segment(0xDA, bytes([len(own)]) + b"".join(bytes([i + 1, 0]) for i in own) + bytes([ss, se, ah << 4 | al]))
        last, run, pending = {}, 0, []

        def flush():
            nonlocal run, pending
            if run:
                k = run.bit_length() - 1
                w.symbol(k << 4)
                w.put(run - (1 << k), k)
                for b in pending:
                    w.put(b, 1)
                run, pending = 0, []

        for at, unit in enumerate(blocks(own)):
            if restart and at and at % restart == 0:
                flush()
                out += w.done() + bytes([0xFF, 0xD0 + (at // restart - 1) % 8])
                last = {}
            for i, block in unit:
                b = [int(x) for x in block]
                if ss == 0 and not ah:
                    d = (b[0] >> al) - last.get(i, 0)
                    last[i] = b[0] >> al
                    w.symbol(abs(d).bit_length())
                    if d:
                        w.value(d, abs(d).bit_length())
                if ss == 0 and ah:
                    w.put(b[0] >> al & 1, 1)
                lo = max(ss, 1)
                if se < lo:
                    continue
                if not ah:
                    vals = [toward_zero(x, al) for x in b]
                    end = max([k for k in range(lo, se + 1) if vals[k]], default=lo - 1)
                    if end >= lo:
                        flush()
                    zeros = 0
                    for k in range(lo, end + 1):
                        if not vals[k]:
                            zeros += 1
                            continue
                        while zeros > 15:
                            w.symbol(0xF0)
                            zeros -= 16
                        s = abs(vals[k]).bit_length()
                        w.symbol(zeros << 4 | s)
                        w.value(vals[k], s)
                        zeros = 0
                    if end < se:
                        if progressive:
                            run += 1
                            if run == 0x7FFF:
                                flush()
                        else:
                            w.symbol(0)
                else:
                    mag = [abs(x) >> al for x in b]
                    end = max([k for k in range(lo, se + 1) if mag[k] == 1], default=lo - 1)
                    zeros, fixes = 0, []
                    if end >= lo:
                        flush()
                    for k in range(lo, se + 1):
                        if mag[k] > 1:
                            fixes.append(mag[k] & 1)
                            continue
                        if k > end:
                            continue
                        if mag[k] == 0:
                            zeros += 1
                            if zeros == 16:
                                w.symbol(0xF0)
                                for f in fixes:
                                    w.put(f, 1)
                                zeros, fixes = 0, []
                            continue
                        w.symbol(zeros << 4 | 1)
                        w.put(int(b[k] > 0), 1)
                        for f in fixes:
                            w.put(f, 1)
                        zeros, fixes = 0, []
                    if end < se:
                        run += 1
                        pending += fixes
        flush()
        out += w.done()

    every = list(range(n))
    if not progressive:
        scan(every, 0, 63, 0, 0)
    else:
        scan(every, 0, 0, 0, 1)
        for i in every:
            scan([i], 1, 5, 0, 2)
            scan([i], 6, 63, 0, 2)
        scan(every, 0, 0, 1, 0)
        for i in every:
            scan([i], 1, 63, 2, 1)
            scan([i], 1, 63, 1, 0)
    return out + b"\xff\xd9"


def slow_rgb(size, samplings, coefs, quant):
    height, width = size
    h, v = max(x for x, _ in samplings), max(y for _, y in samplings)
    basis = [[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]
    planes = []
    for (sx, sy), c in zip(samplings, coefs):
        p = np.zeros((height, width))
        for y in range(height):
            for x in range(width):
                py, px = y * sy // v, x * sx // h
                block, total = c[py // 8][px // 8], 128.0
                for k in np.flatnonzero(block):
                    z = jpeg.ZIGZAG[k]
                    total += block[k] * quant[k] * basis[z // 8][py % 8] * basis[z % 8][px % 8]
                p[y, x] = min(max(total, 0), 255)
        planes.append(p)
    y, cb, cr = planes if len(planes) == 3 else (planes[0], 128, 128)
    out = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], -1)
    return np.clip(out, 0, 255)


@pytest.mark.parametrize("progressive", [True, False])
@pytest.mark.parametrize("samplings,restart", [([(1, 1)], 0), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2), ([(3, 1), (2, 1), (1, 1)], 0), ([(1, 2), (1, 1), (1, 2)], 3)])
def test_jpeg_of_another_writer(progressive, samplings, restart):
    rng = np.random.default_rng(5)
    size, quant = (21, 35), [*range(3, 67)]
    h, v = max(x for x, _ in samplings), max(y for _, y in samplings)
    cols, rows = -(-size[1] // (8 * h)), -(-size[0] // (8 * v))
    coefs = []
    for x, y in samplings:
        c = np.where(rng.random((rows * y, cols * x, 64)) < 0.15, rng.integers(-9, 10, (rows * y, cols * x, 64)), 0)
        c[:, :, 0] = rng.integers(-30, 30, c.shape[:2])
        c[rng.random(c.shape[:2]) < 0.3, 1:] = 0
        # Scans of one component have no blocks beyond the picture.
        own = -(-(-(-size[0] * y // v)) // 8), -(-(-(-size[1] * x // h)) // 8)
        c[own[0] :, :, 1:] = 0
        c[:, own[1] :, 1:] = 0
        coefs.append(c)
    image = next(jpeg.frames(write_jpeg(size, samplings, coefs, quant, progressive, restart)))
    for c, want in zip(image.components, coefs):
        assert np.array_equal(c.coef.reshape(want.shape), want)
    assert abs(image.rgb() - slow_rgb(size, samplings, coefs, quant)).max() <= 1


def test_damaged_jpeg_streams(spark):
    rng = random.Random(1)
    base = [jpeg.encode_payload(bytes(rng.randrange(256) for _ in range(64 * n))) for n in (1, 7, 40)]
    out = 0
    for _ in range(4000):
        m = bytearray(rng.choice(base))
        for _ in range(rng.randint(1, 4)):
            m[rng.randrange(min(len(m), rng.choice([60, 300, 10**9])))] = rng.randrange(256)
        if rng.random() < 0.2:
            m = m[: rng.randrange(len(m))]
        try:
            for image in jpeg.frames(bytes(m)):
                image.rgb()
        except ValueError:
            out += 1
    assert out > 1000
    rows = [(1, None, 5), (2, bytearray(b""), 5), (3, bytearray(b"no"), 5), (4, bytearray(base[0]), 5), (None, bytearray(base[0][:-9]), 5)]
    got = {r.doc_id: r for r in jpeg.features(spark.createDataFrame(rows, "doc_id long, media binary, k0 int"), keep=("doc_id",)).collect()}
    assert got[1].media_bytes is None and got[3].media_bytes == 2 and got[3].feature is None and got[None].payload_bytes is None and got[4].payload_bytes == 64
