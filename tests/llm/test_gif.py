import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loresift.llm import gif as coder
from loresift.llm.gif import BadGif, decode, encode, frames, lzw, payload_of, read_back, store


def compress(samples, code_size):
    """A plain LZW coder, code by code, with the string table in full use."""
    clear, end = 1 << code_size, (1 << code_size) + 1
    bits, n = 0, 0
    out = bytearray()

    def put(code, width):
        nonlocal bits, n
        bits |= code << n
        n += width
        while n >= 8:
            out.append(bits & 255)
            bits >>= 8
            n -= 8

    def fresh():
        return {bytes([i]): i for i in range(clear)}

    table, width, free = fresh(), code_size + 1, end + 1
    put(clear, width)
    word = b""
    for s in samples:
        if word + bytes([s]) in table:
            word += bytes([s])
            continue
        put(table[word], width)
        if free == 4096:
            put(clear, width)
            table, width, free = fresh(), code_size + 1, end + 1
        else:
            table[word + bytes([s])] = free
            if free == 1 << width:
                width += 1
            free += 1
        word = bytes([s])
    if word:
        put(table[word], width)
        if free == 1 << width and width < 12:
            width += 1
    put(end, width)
    if n:
        out.append(bits & 255)
    return bytes(out)


@pytest.mark.parametrize("code_size", range(2, 9))
@pytest.mark.parametrize("n", [1, 5, 300, 20_000])
def test_lzw_against_a_plain_coder(code_size, n):
    r = random.Random(n * code_size)
    alphabet = 1 << code_size
    for samples in (bytes(r.randrange(alphabet) for _ in range(n)), bytes(min(alphabet - 1, int(r.expovariate(1))) for _ in range(n)), bytes(n), bytes((0, 1) * (n // 2) + (0,) * (n % 2))):
        assert lzw(compress(samples, code_size), code_size, n).tobytes() == samples
        assert coder.compress(samples, code_size) and lzw(coder.compress(samples, code_size), code_size, n).tobytes() == samples


def test_streams_use_the_string_table():
    text = ("the quick brown fox jumps over the lazy dog " * 400).encode()
    assert len(coder.compress(text)) < len(text) / 5
    assert len(encode(payload_of(text))) < len(text) / 3


@pytest.mark.parametrize("n", [30_000, 100_000])
def test_long_streams_that_never_clear(n):
    """Once the table is full a coder may go on with it: any number of codes follow one clear code."""
    r = np.random.default_rng(n)
    samples = r.integers(0, 256, n).astype(np.uint8)
    table, codes, word, free = {}, [], int(samples[0]), 258
    for s in samples[1:].tolist():
        if (word, s) in table:
            word = table[word, s]
            continue
        codes.append(word)
        if free < 4096:
            table[word, s] = free
            free += 1
        word = s
    codes.append(word)
    bits = coder._pack(np.array([256, *codes, 257]), np.concatenate([[9], coder._widths(8, len(codes) + 1)]))
    assert len(codes) > 16_384 and (lzw(bits, 8, n) == samples).all()


@pytest.mark.parametrize("n", [576, 576 * 15, 576 * 16, 576 * 17, 576 * 40])
def test_samples_come_back(n):
    samples = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
    assert b"".join(f["index"].tobytes() for f in decode(encode(samples))) == samples


def gif(canvas, parts, palette):
    size = {2: 0, 4: 1, 8: 2}[len(palette)]
    out = b"GIF89a" + struct.pack("<HHBBB", *canvas, 0x80 | size, 0, 0) + bytes(v for c in palette for v in c)
    for left, top, w, h, delay, disposal, transparent, interlaced, samples in parts:
        out += b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (transparent is not None), delay, transparent or 0, 0)
        body = compress(samples, 2)
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x40 if interlaced else 0) + b"\x02" + b"".join(bytes([len(body[i : i + 9])]) + body[i : i + 9] for i in range(0, len(body), 9)) + b"\0"
    return out + b"\x21\xfe\x02hi\0\x3b"


R, G, B, K = (255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0)


def test_disposal_transparency_interlacing(spark):
    data = gif((2, 2), [(0, 0, 2, 2, 10, 1, None, False, bytes([0, 0, 0, 0])), (0, 0, 2, 1, 20, 2, 3, False, bytes([1, 3])), (1, 1, 1, 1, 5, 3, None, False, bytes([2])), (0, 0, 1, 1, 0, 0, None, False, bytes([2]))], [R, G, B, K])
    shots = [f["rgba"][..., :3].tolist() for f in decode(data)]
    alpha = [f["rgba"][..., 3].tolist() for f in decode(data)]
    r, g, b, k = map(list, (R, G, B, K))
    assert shots[0] == [[r, r], [r, r]]
    assert shots[1] == [[g, r], [r, r]]
    assert shots[2] == [[k, k], [r, b]] and alpha[2] == [[0, 0], [255, 255]]  # the second frame's place was cleared
    assert shots[3] == [[b, k], [r, r]] and alpha[3] == [[255, 0], [255, 255]]  # the third frame's was restored
    inter = gif((1, 9), [(0, 0, 1, 9, 0, 0, None, True, bytes([0, 1, 2, 3, 0, 1, 2, 3, 0]))], [R, G, B, K])
    assert next(decode(inter))["index"][:, 0].tolist() == [0, 1, 3, 2, 2, 3, 0, 0, 1]
    df = spark.createDataFrame([(1, data), (2, None), (3, data[:-30]), (4, b"GIF89a")], "doc_id long, content binary").withColumn("frame", F.lit(9))
    got = [(x["id"], x["frame"], x["start_ms"], x["error"] is None, sum(x["histogram"] or [])) for x in frames(df).collect()]
    assert [x for x in got if x[0] == 1] == [(1, 0, 0, True, 4), (1, 1, 100, True, 4), (1, 2, 300, True, 2), (1, 3, 350, True, 3)]
    assert all(not x[3] for x in got if x[0] in (2, 4)) and not [x for x in got if x[0] == 3][-1][3]


def test_documents(spark):
    rows = [(1, "é" * 400), (2, None), (3, ""), (4, "x" * 576), (5, "y" * 577), (6, "z" * 30_000), (7, "x" * 576)]
    got = {x["doc_id"]: x for x in read_back(store(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, t in rows:
        data = payload_of((t or "").encode())
        x = got[i]
        assert len(data) % 576 == 0 and data and data.startswith((t or "").encode()) and set(data[len((t or "").encode()) :]) <= {255}
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
    assert got[4]["media_sha256"] == got[7]["media_sha256"] and got[4]["feature"] == got[7]["feature"]
    for i, t in rows:
        data, x = payload_of((t or "").encode()), got[i]
        shot = [np.frombuffer(data, dtype=np.uint8)[a : a + 576 * 16] for a in range(0, len(data), 576 * 16)]
        bins = np.bincount(np.concatenate(shot) // 64, minlength=4)
        assert x["feature"] == f"frames={len(shot)};ms={40 * len(shot)};hist=" + ",".join(f"{21 * i}:{n}" for i, n in enumerate(bins) if n)
    assert read_back(store(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


@pytest.mark.parametrize("data", [b"", b"GIF89a", b"PNG" + bytes(20), encode(bytes(576))[:-100], encode(bytes(576))[:-1]])
def test_faults(data):
    with pytest.raises(BadGif):
        list(decode(data))
