"""Media columns: GIF.

``encode`` writes indexed frames as GIF89a, ``decode`` reads any GIF: LZW code
streams, global and local palettes, interlacing, transparency, and the three
disposal rules, giving timed frames as they show.  ``media_columns`` stores
texts as animations, one byte a pixel in frames 24 pixels wide, and adds columns
about the frames that the stored bytes give back.  ``gif_frames`` reads a column
of GIFs from anywhere into a row a frame, with times and colour histograms.

Nulls: a null text is an empty one, which is stored as one frame of padding; a
null doc_id keeps its row.  Long texts have more frames; nothing is cut.
Repeated rows and equal texts give equal values; nothing is ordered, so there
are no ties.  An empty table gives an empty result; other columns are not read.
A file that is no GIF, breaks off, lacks a palette or has an unlawful code size
gives the frames before the fault and then an error, never a crash.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import AT_ONCE, documents, slices

SIDE = 24
BLOCK = SIDE * SIDE
#: Blocks in a frame, one below the other: the largest number up to this that divides a text's blocks.
TALL = 16
PAD = b"\xff"
DELAY_CS = 10
BINS = 16
TABLE = 4096


def _layout(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Width of each code after a clear code and the bits before it, for a table that grows until it is full."""
    size = (1 << bits) + 2
    n = TABLE + 64
    # when the decoder reads code i after a clear (0-based), its table holds size + max(0, i - 1) entries
    held = np.minimum(size + np.maximum(np.arange(n) - 1, 0), TABLE)
    width = np.maximum(bits + 1, np.minimum(12, np.floor(np.log2(held)).astype(np.int64) + 1))
    return width, np.r_[0, np.cumsum(width)]


_LAYOUTS = {b: _layout(b) for b in range(2, 9)}
_MASKS = {b: (1 << w) - 1 for b, (w, _) in _LAYOUTS.items()}


def lzw_codes(data: bytes, bits: int = 8) -> list[int]:
    """LZW codes with a leading clear code, one whenever the table is full, and the end code."""
    clear = 1 << bits
    codes, table, nxt = [clear], {}, clear + 2
    if data:
        prefix = data[0]
        get, put = table.get, codes.append
        for c in data[1:]:
            key = prefix << 8 | c
            code = get(key)
            if code is None:
                put(prefix)
                table[key] = nxt
                nxt += 1
                prefix = c
                if nxt == TABLE:
                    put(clear)
                    table.clear()
                    nxt = clear + 2
            else:
                prefix = code
        put(prefix)
    codes.append(clear + 1)
    return codes


def pack_codes(codes: list[int], bits: int = 8) -> bytes:
    """Codes as a stream of bytes, each as wide as the reader's table asks for then."""
    return pack_streams([codes], bits)[0]


def pack_streams(streams: list[list[int]], bits: int = 8) -> list[bytes]:
    """Several streams at once; each begins with a clear code and on a byte of its own."""
    width, _ = _LAYOUTS[bits]
    size = np.array([len(c) for c in streams])
    arr = np.fromiter(itertools.chain.from_iterable(streams), np.int64, int(size.sum()))
    at = np.arange(len(arr))
    first = np.cumsum(size) - size
    last = np.maximum.accumulate(np.where(arr == 1 << bits, at, -1))  # the clear code at or before each code
    since = at - np.r_[-1, last[:-1]] - 1  # how many codes since the clear code before it
    since[first] = 0
    w = width[since]
    run = np.cumsum(w)
    total = np.diff(np.r_[0, run[first + size - 1]])
    length = (total + 7) // 8
    begin = np.cumsum(length) - length
    start = run - w + np.repeat(8 * begin - np.r_[0, np.cumsum(total)[:-1]], size)
    byte, v = start >> 3, arr << (start & 7)
    end = int(length.sum())
    out = np.zeros(end + 3, np.int64)
    for k in range(3):
        out += np.bincount(byte + k, (v >> (8 * k)) & 255, end + 3).astype(np.int64)
    out = out.astype(np.uint8).tobytes()
    return [out[x : x + n] for x, n in zip(begin.tolist(), length.tolist(), strict=True)]


def unlzw(stream: bytes, bits: int, most: int) -> bytes:
    """Colour indices of a code stream, ``most`` at most; a stream that breaks off gives what it has."""
    clear, end = 1 << bits, (1 << bits) + 1
    width, before = _LAYOUTS[bits]
    mask = _MASKS[bits]
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.int64)
    raw = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16  # the 24 bits from each byte on
    total, pos, have = 8 * len(stream), 0, 0
    out: list[bytes] = []
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, prev, k = base.copy(), None, 0
    while pos + bits < total and have < most:
        # codes up to the next clear code have known places
        n = int(np.searchsorted(before, min(total - pos, before[-1] - before[k]) + before[k], side="right")) - 1 - k
        if n > 0:
            places = pos + before[k : k + n] - before[k]
            codes = (raw[places >> 3] >> (places & 7)) & mask[k : k + n]
        else:  # the table is full and stays so
            n = max(1, (total - pos) // 12)
            places = pos + 12 * np.arange(n)
            codes = (raw[places >> 3] >> (places & 7)) & 4095
        stop = np.flatnonzero((codes == clear) | (codes == end))
        upto = int(stop[0]) if len(stop) else n
        some = codes[:upto].tolist()
        if prev is None and some:
            if some[0] >= clear:
                break
            prev = table[some[0]]
            out.append(prev)
            have += 1
            del some[0]
        held = len(out)
        size, put, add = len(table), out.append, table.append
        for c in some:
            if c < size:
                entry = table[c]
            elif c == size < TABLE:
                entry = prev + prev[:1]
            else:
                return b"".join(out)[:most]
            if size < TABLE:
                add(prev + entry[:1])
                size += 1
            put(entry)
            prev = entry
        have += sum(map(len, out[held:]))
        if len(stop):
            if codes[upto] == end:
                break
            pos = int(places[upto]) + (int(width[k + upto]) if k + upto < len(width) else 12)
            table, prev, k = base.copy(), None, 0
        else:
            pos = int(places[-1]) + (int(width[k + n - 1]) if k + n - 1 < len(width) else 12)
            k = min(k + n, len(width))
    return b"".join(out)[:most]


def _blocks(stream: bytes) -> bytes:
    parts = [bytes([len(p)]) + p for i in range(0, len(stream), 255) for p in (stream[i : i + 255],)]
    return b"".join(parts) + b"\0"


GREYS = bytes(c for i in range(256) for c in (i, i, i))


def encode(frames: list[bytes], width: int, height: int, delay_cs: int = DELAY_CS, palette: bytes = GREYS) -> bytes:
    """Whole frames of 8-bit indices as a GIF89a animation."""
    head = b"GIF89a" + struct.pack("<HHBBB", width, height, 0xF7, 0, 0) + palette
    control = b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay_cs, 0) + b"\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0) + b"\x08"
    return head + b"".join(control + _blocks(c) for c in pack_streams([lzw_codes(f) for f in frames])) + b"\x3b"


def _sub(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, size: int) -> np.ndarray:
    if at + 3 * size > len(data):
        raise ValueError("the GIF breaks off")
    return np.frombuffer(data, np.uint8, 3 * size, at).reshape(-1, 3)


def _rows(height: int) -> np.ndarray:
    """The picture row of each stored row of an interlaced image."""
    return np.concatenate([np.arange(a, height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


#: Pixels that a screen or a frame may have: a file of a few bytes may claim four thousand million of them.
PIXELS = 1 << 24


def decode(data: bytes, pixels: int = PIXELS):
    """Yields (delay in hundredths of a second, canvas of height x width x RGBA) as each frame shows; ValueError at a fault, or above ``pixels``."""
    try:
        yield from _decode(data, pixels)
    except (IndexError, struct.error) as e:
        raise ValueError("the GIF breaks off") from e


def _decode(data: bytes, pixels: int):
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common = 13, None
    if flags & 0x80:
        size = 2 << (flags & 7)
        common = _palette(data, at, size)
        at += 3 * size
    if width * height > pixels:
        raise ValueError(f"a screen of {width} x {height}")
    canvas = np.zeros((height, width, 4), np.uint8)  # never changed in place: a frame makes a new one
    delay, disposal, clear = 0, 0, None
    colours = painted = None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", data, at + 3)
                disposal, clear = packed >> 2 & 7, index if packed & 1 else None
            _, at = _sub(data, at + 2)
            continue
        if data[at] != 0x2C:
            raise ValueError("not a GIF block")
        x, y, w, h, f = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        if w * h > pixels:
            raise ValueError(f"a frame of {w} x {h}")
        palette = common
        if f & 0x80:
            size = 2 << (f & 7)
            palette = _palette(data, at, size)
            at += 3 * size
        if palette is None:
            raise ValueError("a frame without a palette")
        bits = data[at]
        if not 2 <= bits <= 8:
            raise ValueError(f"code size {bits}")
        stream, at = _sub(data, at + 1)
        index = np.frombuffer(unlzw(stream, bits, w * h), np.uint8)
        if len(index) < w * h:
            index = np.r_[index, np.zeros(w * h - len(index), np.uint8)]
        index = index.reshape(h, w)
        if f & 0x40:
            index, straight = np.empty_like(index), index
            index[_rows(h)] = straight
        if painted is not palette:
            painted, colours = palette, np.full((max(256, len(palette)), 4), 255, np.uint8)
            colours[: len(palette), :3] = palette
        before = canvas
        if clear is None and (x, y, w, h) == (0, 0, width, height):
            canvas = colours.view(np.uint32).ravel()[index].view(np.uint8).reshape(height, width, 4)
        else:
            canvas = canvas.copy()
            part = canvas[y : y + h, x : x + w]
            index = index[: part.shape[0], : part.shape[1]]
            seen = index != (-1 if clear is None else clear)
            part[seen] = colours[index][seen]
        yield delay, canvas
        if disposal == 2:
            canvas = canvas.copy()
            canvas[y : y + h, x : x + w] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear = 0, 0, None


def store(raw: bytes) -> tuple[bytes, bytes]:
    """(payload: raw padded to a positive multiple of BLOCK, the animation that holds it)."""
    payload = raw + PAD * (-len(raw) % BLOCK if raw else BLOCK)
    blocks = len(payload) // BLOCK
    tall = max(n for n in range(1, TALL + 1) if blocks % n == 0)
    return payload, encode([payload[i : i + tall * BLOCK] for i in range(0, len(payload), tall * BLOCK)], SIDE, SIDE * tall)


def read(media: bytes) -> tuple[bytes, list[int], np.ndarray]:
    """(the payload, each frame's time in hundredths of a second, its colour histogram) from the stored bytes."""
    parts, delays = [], []
    for delay, canvas in decode(media):
        parts.append(canvas[:, :, 0].tobytes())
        delays.append(delay)
    payload = b"".join(parts)
    bins = np.frombuffer(payload, np.uint8).reshape(len(parts), -1) // (256 // BINS) + BINS * np.arange(len(parts))[:, None]
    return payload, delays, np.bincount(bins.ravel(), minlength=BINS * len(parts)).reshape(-1, BINS)


COLUMNS = [
    ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()),
    ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("frames", T.IntegerType()), ("duration_ms", T.LongType()), ("histogram", T.ArrayType(T.LongType())),
    ("frame_ms", T.ArrayType(T.LongType())), ("frame_histograms", T.ArrayType(T.ArrayType(T.LongType()))),
]


def media_columns(docs: DataFrame, media: bool = True) -> DataFrame:
    """doc_id, the columns above, and with ``media`` the GIF itself."""
    more = [T.StructField("media", T.BinaryType())] if media else []
    schema = T.StructType([docs.schema["doc_id"]] + [T.StructField(n, t) for n, t in COLUMNS] + more)
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    types += [pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))] + ([pa.binary()] if media else [])

    def row(raw: bytes) -> tuple:
        payload, gif = store(raw)
        back, delays, histograms = read(gif)
        if back != payload:
            raise ValueError("the stored bytes don't give the payload back")
        got = (
            len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(gif),
            hashlib.sha256(gif).hexdigest(), len(histograms), 10 * sum(delays), histograms.sum(0).tolist(),
            [10 * d for d in delays], histograms.tolist(),
        )
        return (*got, gif) if media else got

    def run(batches):
        for b in slices(batches, most=AT_ONCE // 2):
            rows = [row(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id")] + [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


#: Cells of a colour histogram: four steps each of red, green and blue.
CELLS = 64
FRAMES = [
    ("frame", T.IntegerType()), ("start_ms", T.LongType()), ("delay_ms", T.LongType()), ("width", T.IntegerType()), ("height", T.IntegerType()),
    ("transparent", T.LongType()), ("colours", T.ArrayType(T.LongType())), ("error", T.StringType()),
]


def _frame_rows(data: bytes):
    at = n = 0
    try:
        for delay, canvas in decode(data):
            seen = canvas[canvas[:, :, 3] > 0].astype(np.int64) >> 6
            cells = np.bincount(seen[:, 0] << 4 | seen[:, 1] << 2 | seen[:, 2], minlength=CELLS)
            yield n, 10 * at, 10 * delay, canvas.shape[1], canvas.shape[0], canvas.shape[0] * canvas.shape[1] - len(seen), cells.tolist(), None
            at, n = at + delay, n + 1
    except ValueError as e:
        yield None, None, None, None, None, None, None, str(e)


def gif_frames(df: DataFrame, key: str, column: str) -> DataFrame:
    """key and FRAMES: a row for each frame of the GIFs in ``column`` (null: no row), and one with ``error`` where a file has a fault."""
    schema = T.StructType([df.schema[key]] + [T.StructField(n, t) for n, t in FRAMES])
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.string()]

    def run(batches):
        for b in slices(batches, column):
            for i, data in enumerate(b.column(column).to_pylist()):
                if data is not None:
                    rows = list(_frame_rows(bytes(data)))
                    keys = b.column(key).take(pa.array([i] * len(rows), pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys] + [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=schema.names)

    return df.select(key, column).mapInArrow(run, schema)


def op8_gif_media(spark, sf_dir: str) -> DataFrame:
    out = media_columns(documents(spark, sf_dir), media=False)
    frames = F.array_join(F.transform("frame_histograms", lambda h: F.array_join(h, "-")), ",")
    text = F.format_string("gif:%d:%d:%s", F.col("frames"), F.col("duration_ms"), F.array_join("histogram", "-"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", text.alias("feature"), F.array_join("frame_ms", ",").alias("frame_ms"), frames.alias("frame_histograms"))
