import base64
import hashlib
import random
import zlib

import pytest
import numpy as np
from fieldmark.llm import gif as G
from hypothesis import given, settings
from hypothesis import strategies as st

from .helpers import documents, empty


def plain_lzw(stream, bits):
    """A bit-by-bit reader."""
    clear, at, width, out, table, prev = 1 << bits, 0, bits + 1, b"", None, None
    value = int.from_bytes(stream, "little")
    while at + width <= 8 * len(stream):
        code = value >> at & (1 << width) - 1
        at += width
        if code == clear:
            table, prev, width = [bytes([i]) for i in range(clear)] + [b"", b""], None, bits + 1
            continue
        if code == clear + 1:
            break
        entry = table[code] if code < len(table) else prev + prev[:1]
        if prev is not None and len(table) < 4096:
            table.append(prev + entry[:1])
        if len(table) == 1 << width and width < 12:
            width += 1
        out += entry
        prev = entry
    return out


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=400), st.integers(1, 30))
def test_lzw_round_trip(data, times):
    data *= times
    stream = G.pack_codes(G.lzw_codes(data))
    assert G.unlzw(stream, 8, len(data)) == data == plain_lzw(stream, 8)


def test_long_streams_fill_the_table():
    rng = random.Random(5)
    for data in (bytes(rng.randrange(256) for _ in range(30_000)), bytes(rng.choice(b"ab") for _ in range(200_000)), b"z" * 100_000):
        stream = G.pack_codes(G.lzw_codes(data))
        assert G.unlzw(stream, 8, len(data)) == data == plain_lzw(stream, 8)


def test_a_full_table_without_a_clear_code():
    rng = random.Random(6)
    data = bytes(rng.randrange(256) for _ in range(9000))
    codes = [256, *data, 257]  # literals only: the reader's table fills and stays at 12 bits
    width = G._LAYOUTS[8][0]
    value = at = 0
    for i, c in enumerate(codes):
        w = 9 if i == 0 else int(width[i - 1]) if i - 1 < len(width) else 12
        value |= c << at
        at += w
    stream = value.to_bytes((at + 7) // 8, "little")
    assert G.unlzw(stream, 8, len(data)) == data == plain_lzw(stream, 8)


def test_known_files():
    dot = base64.b64decode("R0lGODlhAQABAIAAAAAAAP///yH5BAEAAAAALAAAAAABAAEAAAIBRAA7")
    ((delay, canvas),) = G.decode(dot)
    assert canvas.shape == (1, 1, 4) and canvas[0, 0, 3] == 0  # a transparent dot
    sample = bytes.fromhex(  # red, blue and white squares, 10 x 10
        "4749463839610a000a00910000ffffffff00000000ff00000021f90400000000002c000000000a000a0000021"
        "68c2d99872a1cdc33a0027 5ec95faa8de608c0491 4c01003b".replace(" ", "")
    )
    ((_, canvas),) = G.decode(sample)
    red, blue, white = (255, 0, 0, 255), (0, 0, 255, 255), (255, 255, 255, 255)
    assert tuple(canvas[0, 0]) == red and tuple(canvas[0, 9]) == blue and tuple(canvas[4, 4]) == white
    assert tuple(canvas[9, 0]) == blue and tuple(canvas[9, 9]) == red


def frame(x, y, w, h, data, disposal=0, clear=None, delay=5, interlaced=False, palette=None):
    out = b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), delay, 0, clear or 0]) + b"\0"
    flags = (0x40 if interlaced else 0) | (0x81 if palette else 0)
    return out + b"\x2c" + bytes([x, 0, y, 0, w, 0, h, 0, flags]) + (palette or b"") + b"\x08" + G._blocks(G.pack_codes(G.lzw_codes(bytes(data))))


def test_disposal_transparency_interlacing_and_palettes():
    head = b"GIF89a\x04\x00\x04\x00\xf7\0\0" + G.GREYS
    local = bytes([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12])
    rows = np.arange(16).reshape(4, 4)
    order = [0, 2, 1, 3]  # 4 rows: passes start at 0, 4, 2, 1
    frames = [
        frame(0, 0, 4, 4, [9] * 16, 1),
        frame(1, 1, 2, 2, [7, 8, 8, 7], 3, clear=8),
        frame(0, 0, 1, 1, [3], 2),
        frame(2, 2, 1, 1, [1], 1, palette=local, delay=9),
        frame(0, 0, 4, 4, rows[order].ravel().tolist(), 1, interlaced=True),
    ]
    got = list(G.decode(head + b"\x21\xfe\x03abc\0" + b"".join(frames) + b"\x3b"))
    grey = [c[:, :, 0].tolist() for _, c in got]
    assert [d for d, _ in got] == [5, 5, 5, 9, 5]
    assert grey[0] == [[9] * 4] * 4
    assert grey[1] == [[9] * 4, [9, 7, 9, 9], [9, 9, 7, 9], [9] * 4]
    assert grey[2] == [[3, 9, 9, 9], [9] * 4, [9] * 4, [9] * 4]  # the one before was undone
    assert got[3][1][0, 0].tolist() == [0, 0, 0, 0] and got[3][1][2, 2].tolist() == [4, 5, 6, 255]
    assert grey[4] == rows.tolist()


def test_documents(spark):
    docs = documents(spark)
    got = G.media_columns(docs).collect()
    assert len(got) == docs.count()
    text = {(r.doc_id): r.text for r in docs.collect()}
    for g in got:
        raw = (text[g.doc_id] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert g.media_sha256 == hashlib.sha256(g.media).hexdigest() and g.media_bytes == len(g.media)
        assert b"".join(c[:, :, 0].tobytes() for _, c in G.decode(bytes(g.media))) == payload
        assert g.histogram == [sum(f[i] for f in g.frame_histograms) for i in range(16)] and sum(g.histogram) == len(payload)
    assert G.media_columns(empty(spark)).count() == 0


def test_faults_give_an_error_after_the_frames_before(spark):
    good = G.encode([bytes([7] * 16), bytes([9] * 16)], 4, 4)
    bare = b"GIF89a\x04\x00\x04\x00\x70\0\0" + frame(0, 0, 4, 4, [1] * 16) + b"\x3b"
    narrow = bytearray(good)
    narrow[good.index(b"\x2c", 13 + 768) + 10] = 1
    files = [(1, good), (2, good[:-30]), (3, bare), (4, bytes(narrow)), (5, b"no GIF at all"), (6, b""), (7, None), (8, good[:40]), (9, good[:8])]
    rows = G.gif_frames(spark.createDataFrame(files, "k int, media binary"), "k", "media").collect()
    got = {}
    for r in rows:
        got.setdefault(r.k, []).append((r.frame, r.start_ms, r.delay_ms, r.error))
    assert got[1] == [(0, 0, 100, None), (1, 100, 100, None)]
    assert [x[:3] for x in got[2]] == [(0, 0, 100), (None, None, None)] and got[2][1][3]
    assert all(len(got[k]) == 1 and got[k][0][3] for k in (3, 4, 5, 6, 8, 9)) and 7 not in got
    first = next(r for r in rows if r.k == 1)
    assert (first.width, first.height, first.transparent, sum(first.colours)) == (4, 4, 0, 16)
    for cut in range(len(good) - 1):  # never anything but a ValueError
        try:
            list(G.decode(good[:cut]))
        except ValueError:
            pass


def test_a_few_bytes_can_not_claim_a_huge_picture():
    import struct

    bomb = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x08\x00\x3b"
    with pytest.raises(ValueError, match="screen"):
        list(G.decode(bomb))
    small = bomb[:6] + struct.pack("<HH", 4, 4) + bomb[10:]
    with pytest.raises(ValueError, match="frame"):
        list(G.decode(small))
    with pytest.raises(ValueError, match="screen"):
        list(G.decode(G.encode([bytes([7] * 16)], 4, 4), pixels=15))
