"""GIF media columns.

`decode` reads any GIF87a/89a: it decodes the LZW code streams, applies local and global palettes,
interlacing, transparency and the disposal rules, and returns timed frames. `frames` turns a column of
files into one row per frame with its delay, size, composed picture and a colour histogram. `encode`
writes samples losslessly as compressed code streams with a grey palette, so that a composed pixel is its
sample.

Between clear codes the width of the n-th code depends on n alone, so codes are packed and cut out by array
operations, any number of them, and expanded by pointers into what they stand for; only the coder builds its
string table code by code.

Defined results: null counts as the empty payload; a payload is padded with bytes 255 to a positive
multiple of 576 samples; equal payloads give equal files; a file that is cut short or no GIF gives no
frames and its error; empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import arrow_map, kept, text_bytes

ROW = 576
#: Rows of samples in a frame, at most: a frame is decoded at once.
FRAME_ROWS = 16
GRID = 4  # histogram bins a colour channel


def grey_palette() -> bytes:
    return bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))


def _widths(first: int, n: int) -> np.ndarray:
    """Widths of the n codes after a clear code: the table grows with every code but the first."""
    at = np.minimum(np.maximum(np.arange(n) - 1, 0) + (1 << first) + 2, 4095)
    return np.maximum(np.floor(np.log2(at)).astype(np.int64) + 1, first + 1)


_BITS = np.arange(12, dtype=np.uint16)


class _Places:
    """Widths and bit places of the codes after a clear code, by number, grown on demand."""

    def __init__(self, first: int):
        self.first = first
        self.grow(1 << 14)

    def grow(self, n: int) -> None:
        self.widths = _widths(self.first, n)
        self.offsets = np.concatenate([[0], np.cumsum(self.widths)])

    def upto(self, n: int) -> np.ndarray:
        while len(self.widths) < n:
            self.grow(2 * len(self.widths))
        return self.widths


_PLACES = {k: _Places(k) for k in range(2, 9)}


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of the given widths (12 bits at most) as bytes, least significant bit first."""
    bits = (codes.astype(np.uint16)[:, None] >> _BITS) & np.uint16(1)
    return np.packbits(bits[_BITS < widths[:, None]].astype(bool), bitorder="little").tobytes()


def compress(samples: bytes, code_size: int = 8) -> bytes:
    """An LZW code stream: the table is cleared when it is full."""
    clear, end = 1 << code_size, (1 << code_size) + 1
    runs, table, free = [], {}, end + 1
    codes: list[int] = []
    word = -1
    for s in samples:
        if word < 0:
            word = s
            continue
        key = word << 8 | s
        if (longer := table.get(key)) is not None:
            word = longer
            continue
        codes.append(word)
        word = s
        if free < 4095:
            table[key] = free
            free += 1
        else:  # the decoder's table is full with the next code
            runs.append(codes)
            codes, table, free = [], {}, end + 1
    if word >= 0:
        codes.append(word)
    runs.append(codes)
    # the code after a run, a clear code or the end, has the width of the next code
    every = [clear, *(c for run in runs[:-1] for c in (*run, clear)), *runs[-1], end]
    widths = _PLACES[code_size].upto(max(map(len, runs)) + 1)
    return _pack(np.array(every, dtype=np.uint16), np.concatenate([widths[:1], *(widths[: len(run) + 1] for run in runs)]))


def _blocks(data: bytes) -> bytes:
    """Data as sub-blocks of up to 255 bytes, with the terminator."""
    whole = len(data) // 255
    body = np.frombuffer(data[: whole * 255], dtype=np.uint8).reshape(whole, 255)
    head = np.concatenate([np.full((whole, 1), 255, dtype=np.uint8), body], axis=1).tobytes()
    rest = data[whole * 255 :]
    return head + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode(samples: bytes, width: int = ROW, frame_rows: int = FRAME_ROWS, delay: int = 4) -> bytes:
    """A GIF whose frames hold the samples in order, `width` a row."""
    x = np.frombuffer(samples, dtype=np.uint8)
    rows = len(x) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0), grey_palette()]
    for top in range(0, rows, frame_rows):
        part = x[top * width : (top + frame_rows) * width]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 0x04, delay, 0, 0))  # disposal 1, no transparency
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08" + _blocks(compress(part.tobytes())))
    return b"".join(out) + b"\x3b"


class BadGif(ValueError):
    """The file is no GIF, or ends too early."""


def lzw(data: bytes, code_size: int, expected: int) -> np.ndarray:
    """Samples of an LZW code stream, `expected` of them."""
    if not 2 <= code_size <= 8:
        raise BadGif(f"code size {code_size}")
    clear, end, first_free = 1 << code_size, (1 << code_size) + 1, (1 << code_size) + 2
    buf = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(4, dtype=np.uint8)]).astype(np.uint32)
    bits, at, have = len(data) * 8, 0, 0
    out: list[bytes] = []
    places, guess = _PLACES[code_size], 4096
    while have < expected:
        places.upto(guess)
        offsets = places.offsets
        n = min(guess, int(np.searchsorted(offsets, bits - at, side="right")) - 1)
        if n <= 0:
            raise BadGif("the code stream ends early")
        pos = at + offsets[:n]
        byte = pos >> 3
        codes = ((buf[byte] | buf[byte + 1] << 8 | buf[byte + 2] << 16) >> (pos & 7).astype(np.uint32)) & ((1 << places.widths[:n]) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stop) and n == guess:
            guess *= 2
            continue
        size = int(stop[0]) if len(stop) else n
        if size:
            out.append(_strings(codes[:size], clear, first_free))
            have += len(out[-1])
        if not len(stop) or codes[size] == end:
            break
        at += int(offsets[size + 1])
    if have < expected:
        raise BadGif("the code stream ends early")
    return np.frombuffer(b"".join(out), dtype=np.uint8)[:expected]


def _roots(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Follow pointers to smaller places until they rest: where they end, and after how many steps."""
    steps = (of != np.arange(len(of))).astype(np.int64)
    while True:
        further = of[of]
        if (further == of).all():
            return of, steps
        steps, of = steps + steps[of], further


def _strings(codes: np.ndarray, clear: int, first_free: int) -> bytes:
    """What the codes between two clear codes stand for. The n-th code adds the string of the code before
    it and its own first byte to the table, so a table entry is a stretch of the output: its length and its
    bytes follow from pointers back to literals."""
    codes, at = codes.astype(np.int64), np.arange(len(codes))
    literal = codes < clear
    entry = np.where(literal, at, codes - first_free)  # the code at whose output an entry starts
    if not literal[0] or (entry[~literal] >= at[~literal]).any():
        raise BadGif("a code is not in the table")
    length = _roots(entry)[1] + 1
    start = np.cumsum(length) - length
    code = np.repeat(at, length)
    place = np.arange(len(code))
    source = _roots(np.where(literal[code], place, start[entry[code]] + place - start[code]))[0]
    return codes[code[source]].astype(np.uint8).tobytes()


def _deinterlace(x: np.ndarray) -> np.ndarray:
    order = np.concatenate([np.arange(s, len(x), k) for s, k in ((0, 8), (4, 8), (2, 4), (1, 2))])
    out = np.empty_like(x)
    out[order] = x
    return out


def _subblocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise BadGif("a block is missing")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        if at + 1 + n > len(data):
            raise BadGif("a block is cut short")
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def decode(data: bytes, compose: bool = True):
    """Frames of a GIF, one by one: dicts of left, top, delay_ms, disposal, transparent, index (samples as
    rows) and, with `compose`, rgba (the whole canvas after the frame, before its disposal)."""
    if len(data) < 13 or data[:3] != b"GIF" or data[3:6] not in (b"87a", b"89a"):
        raise BadGif("no GIF header")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette = 13, None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        palette = np.frombuffer(data[at : at + n], dtype=np.uint8)
        if len(palette) < n:
            raise BadGif("the palette is cut short")
        palette, at = palette.reshape(-1, 3), at + n
    canvas = np.zeros((height, width, 4), dtype=np.uint8) if compose else None
    delay, disposal, transparent = 0, 0, None
    while True:
        if at >= len(data):
            raise BadGif("no trailer")
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            if at + 2 > len(data):
                raise BadGif("an extension is cut short")
            label = data[at + 1]
            body, at = _subblocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                packed, delay = body[0], int.from_bytes(body[1:3], "little") * 10
                disposal, transparent = packed >> 2 & 7, body[3] if packed & 1 else None
            continue
        if kind != 0x2C:
            raise BadGif(f"block {kind:#x}")
        if at + 11 > len(data):
            raise BadGif("a frame is cut short")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = palette
        if flags & 0x80:
            n = 3 << (flags & 7) + 1
            colours = np.frombuffer(data[at : at + n], dtype=np.uint8)
            if len(colours) < n:
                raise BadGif("a palette is cut short")
            colours, at = colours.reshape(-1, 3), at + n
        if at >= len(data):
            raise BadGif("a frame is cut short")
        code_size = data[at]
        body, at = _subblocks(data, at + 1)
        index = lzw(body, code_size, w * h).reshape(h, w)
        if flags & 0x40:
            index = _deinterlace(index)
        frame = {"left": left, "top": top, "delay_ms": delay, "disposal": disposal, "transparent": transparent, "index": index, "palette": colours}
        if compose:
            if colours is None:
                raise BadGif("a frame has no palette")
            if top + h > height or left + w > width:
                raise BadGif("a frame lies outside the canvas")
            before = canvas[top : top + h, left : left + w].copy() if disposal == 3 else None
            padded = np.zeros((256, 3), dtype=np.uint8)
            padded[: len(colours)] = colours
            spot = canvas[top : top + h, left : left + w]
            if transparent is None:
                spot[..., :3], spot[..., 3] = padded[index], 255
            else:
                shown = index != transparent
                spot[shown, :3], spot[shown, 3] = padded[index[shown]], 255
            frame["rgba"] = canvas.copy()
            if disposal == 2:
                spot[:] = 0
            elif disposal == 3:
                spot[:] = before
        yield frame
        delay, disposal, transparent = 0, 0, None


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Counts of the visible pixels in GRID bins a channel."""
    bin_ = rgba // np.uint8(256 // GRID)
    seen = bin_[..., 0] * np.uint8(GRID * GRID) + bin_[..., 1] * np.uint8(GRID) + bin_[..., 2]
    return np.bincount(seen[rgba[..., 3] > 0], minlength=GRID**3)


FRAMES = "id long, frame int, start_ms long, delay_ms long, disposal int, transparent boolean, width int, height int, histogram array<long>, rgba binary, error string"


def frames(media: DataFrame, *, id_col: str = "doc_id", content_col: str = "content", pictures: bool = True) -> DataFrame:
    """One row per frame: its time, disposal, canvas size, colour histogram and picture (RGBA). A file that
    can't be read gives the frames before its fault and then one row with the error."""

    def run(batches):
        for b in batches:
            for i, content in zip(b.column("id").to_pylist(), b.column("content").to_pylist()):
                start, n = 0, 0
                try:
                    for n, f in enumerate(decode(content or b""), 1):
                        h, w = f["rgba"].shape[:2]
                        yield row(i, n - 1, start, f["delay_ms"], f["disposal"], f["transparent"] is not None, w, h, histogram(f["rgba"]).tolist(), f["rgba"].tobytes() if pictures else None, None)
                        start += f["delay_ms"]
                except BadGif as e:
                    yield row(i, n, start, None, None, None, None, None, None, None, str(e))

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.string()]
    names = [x.split()[0] for x in FRAMES.split(", ")]

    def row(*values):
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

    return arrow_map(media.select(media[id_col].cast("long").alias("id"), media[content_col].alias("content")), run, FRAMES)


def payload_of(text: bytes) -> bytes:
    """A text padded with bytes 255 to a positive multiple of ROW."""
    return text + b"\xff" * (ROW - len(text) if len(text) < ROW else -len(text) % ROW)


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, content): every text's payload as a GIF of grey samples, written to the shared
    folder; what is returned reads the stored files."""

    def run(batches):
        for b in batches:
            texts = text_bytes(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(payload_of(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "content"]
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return kept(arrow_map(rows, run, "doc_id long, n_bytes long, content binary"), "media")


def read_back(media: DataFrame) -> DataFrame:
    """What the stored files of (doc_id, n_bytes, content) hold: payload, file digests and a feature, the
    colour histogram over all frames as composed (its bins that are not empty), with their number and time.
    The payload is read from the composed pictures, whose pixels are grey samples."""

    def run(batches):
        for b in batches:
            cols = [[] for _ in range(6)]
            for content in b.column("content").to_pylist():
                n = ms = 0
                bins, parts = np.zeros(GRID**3, dtype=np.int64), []
                for n, f in enumerate(decode(content), 1):
                    h, w = f["index"].shape
                    shown = f["rgba"][f["top"] : f["top"] + h, f["left"] : f["left"] + w]
                    parts.append(shown[..., 0].tobytes())
                    bins += histogram(shown)
                    ms += f["delay_ms"]
                data = b"".join(parts)
                feature = f"frames={n};ms={ms};hist=" + ",".join(f"{i}:{bins[i]}" for i in np.flatnonzero(bins))
                for c, v in zip(cols, (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(content), hashlib.sha256(content).hexdigest(), feature)):
                    c.append(v)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_bytes", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow_map(media, run, schema)
