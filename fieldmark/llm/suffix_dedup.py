"""Exact substring dedup: common-prefix interval trees over enhanced suffix arrays.

Every byte covered by a ``SPAN``-byte string that also starts earlier (in a
smaller doc_id, or earlier in the same document) goes.  A maximal repeat is a
string of two or more occurrences that no longer agree when it is extended on
either side; all occurrences but the first lose it, and the union over all
maximal repeats of SPAN bytes and more is exactly those bytes.

A suffix array of the whole corpus would hold every byte's suffix.  Instead,
of every SPAN-byte window the leftmost least of its GRAM-byte hashes is chosen
(the choice depends on the window alone, so equal windows choose alike), and
only suffixes at chosen places enter, about one in 35.

1. Each chunk sends its distinct hashes to key ranges and learns which occur
   twice or more in the corpus; all others are done with.
2. For the rest it sends the text around the place: the windows that chose it.
   Equal surroundings within a chunk, and then within a range, leave their
   first occurrence only.  What differs is sorted into a suffix array with
   common-prefix lengths; a scan with a stack gives its intervals; the members
   of each interval are sorted by what stands to their left, and a second scan
   gives the groups whose left extension is diverse: maximal repeats, with all
   their occurrences.
3. A hash with more than ``HOT`` occurrences makes a tree too large for a task,
   so the tree is divided by more text.  A window about a place has b bytes from
   the place on and SPAN - b before it.  The values of b are cut into spans
   lo..hi: all windows of a span share lo bytes to the right and SPAN - hi to
   the left, so occurrences that may share such a window agree in those, and
   each group of agreeing ones is a smaller tree of its own, over surroundings
   clipped to the span's windows.  Groups still above HOT are divided again,
   down to a single b, where all members are one window: a tree of one interval,
   of which a chunk sends one entry.  No member is left out at any level, and no
   tree ever holds more than HOT suffixes or, at a single b, an entry a chunk.

``substring_dedup`` removes what the groups cover; ``repeat_groups`` returns the
groups themselves with all their occurrences.

Equality of surroundings within a chunk and of the text that trees are divided by is by
64-bit hashes.

Nulls: a null text has no bytes; a null doc_id comes after all others.  Rows
that repeat a doc_id stand in the order of their texts' digests, each later one
losing what the earlier one has; among equal rows any one keeps its text.  A
text is never cut, however long.  An empty table gives an empty result.  Other
columns than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import FAN, chunked, corpus_totals, pack_ints, ranges_for, salts_for, segments, unpack_ints, unseal
from .common import documents, give_back, materialise

SPAN = 100
GRAM = 32
REACH = SPAN - GRAM  # how far left of its place a window may start
HOT = 5000
#: Values of b in a span, from one division of a tree to the next; the last must be 1.
WIDTHS = (9, 1)
_BLOCK = 1 << 18
#: Text of a chunk and of a key range: what a task holds at once is a small multiple.
CHUNK, RANGE = 2 << 20, 4 << 20
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = 0x9E3779B97F4A7C15


def _powers() -> dict[int, np.uint64]:
    out, x = {}, _ODD
    for n in (1, 2, 4, 8, 16, 32, 64):
        out[n] = np.uint64(x)
        x = x * x % (1 << 64)
    return out


_POWER = _powers()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each GRAM bytes, hash of each SPAN bytes) by place."""
    h = {1: _TABLE[data]}
    for n in (1, 2, 4, 8, 16, 32):
        h[2 * n] = h[n][: len(h[n]) - n] * _POWER[n] + h[n][n:]
        if n not in (4, 32):
            del h[n]
    n = max(0, len(data) - SPAN + 1)
    whole = (h[64][:n] * _POWER[32] + h[32][64 : 64 + n]) * _POWER[4] + h[4][96 : 96 + n]
    return _mix(h[32]), _mix(whole)


class Chunk:
    """A chunk's bytes in document order, and the place each window chose."""

    def __init__(self, table: pa.Table, name: str):
        ids = table.column("doc_id").to_pylist()
        texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
        digest = [xxhash.xxh64_intdigest(t) for t in texts]  # settles the order of rows that share a doc_id
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, digest[i], i))
        self.table, self.order = table, order
        self.texts = [texts[i] for i in order]
        top = (1 << 64) - 1
        self.doc = np.array([top if ids[i] is None else ids[i] + (1 << 63) for i in order], np.uint64)
        self.sub = np.array([digest[i] for i in order], np.uint64)
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)

    def row(self, at: np.ndarray) -> np.ndarray:
        """The document of each place."""
        return np.searchsorted(self.ends, at, side="right")

    def choose(self) -> None:
        """place, first and last window, hash, and hashes of the first and last window, of each run of windows that chose alike."""
        parts = []
        room = len(self.data) - SPAN + 1
        for lo in range(0, max(room, 0), _BLOCK):
            hi = min(lo + _BLOCK, room)
            gram, whole = rolling(self.data[lo : hi + SPAN - 1])
            v = (gram >> np.uint64(24) << np.uint64(24)) | np.arange(len(gram), dtype=np.uint64)
            m, width = v, 1
            while width * 2 <= REACH + 1:
                m = np.minimum(m[: len(m) - width], m[width:])
                width *= 2
            n = hi - lo
            m = np.minimum(m[:n], m[REACH + 1 - width : REACH + 1 - width + n])
            s = np.arange(n)
            fits = s + lo + SPAN <= self.ends[self.row(s + lo)]
            s = s[fits]
            at = (m[fits] & np.uint64((1 << 24) - 1)).astype(np.int64)
            new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)][: len(s)])
            last = np.r_[new[1:] - 1, len(s) - 1][: len(new)]
            # the least hashes are small ones: mixed again, they spread over the key ranges
            parts.append((at[new] + lo, s[new] + lo, s[last] + lo, _mix(gram[at[new]] + np.uint64(_ODD)), whole[s[new]], whole[s[last]]))
        empty = np.zeros(0, np.int64)
        self.place, self.first, self.last, self.hash, self.head, self.tail = (
            np.concatenate([p[i] for p in parts]) if parts else empty.astype(np.uint64 if i > 2 else np.int64) for i in range(6)
        )

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.unique(self.hash, return_inverse=True, return_counts=True)


def gram_totals(chunks: DataFrame, ranges: int, hot: int, salts: int) -> DataFrame:
    """Stored rows (chunk, part, data): 0, 1 or 2 for each sorted distinct hash of the chunk: once, repeated, hot in the corpus."""

    def send(batches):
        for b in batches:
            for name, payload in zip(b.column("chunk").to_pylist(), b.column("payload").to_pylist(), strict=True):
                c = Chunk(unseal(payload), name)
                c.choose()
                keys, _, counts = c.keys()
                rows = [(p, pack_ints(keys[x:y], True), pack_ints(counts[x:y])) for p, x, y in segments(keys, ranges, 64)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary())))], names=["chunk", "part", "keys", "counts"])
        give_back()

    sent = chunks.select("chunk", "payload").mapInArrow(send, "chunk string, part bigint, keys binary, counts binary")
    return corpus_totals(sent, salts, "gram-kinds", lambda total: (total > 1).astype(np.uint64) + (total > hot)).where("chunk is not null")


SENT = "kind string, part bigint, chunk string, data array<binary>"
SPANS = "chunk string, start binary, stop binary"
GROUPS = "chunk string, group binary, length binary, at binary"


def _first_of(labels: np.ndarray, n: int) -> np.ndarray:
    """Is each element the first with its label?"""
    out = np.zeros(n, bool)
    out[np.unique(labels, return_index=True)[1]] = True
    return out


class Members(NamedTuple):
    """Occurrences in a chunk, in document order for each key: what they must share, their place, their bytes to both sides, their document."""

    key: np.ndarray
    place: np.ndarray
    n_left: np.ndarray
    n_right: np.ndarray
    doc: np.ndarray
    sub: np.ndarray
    begin: np.ndarray  # of the leftmost byte in text
    text: bytes

    def take(self, i: np.ndarray) -> Members:
        return Members(*(x[i] for x in self[:7]), self.text)

    def packed(self) -> list[bytes]:
        ends = self.begin + self.n_left + self.n_right
        return [pack_ints(x) for x in self[:6]] + [b"".join([self.text[x:y] for x, y in zip(self.begin.tolist(), ends.tolist(), strict=True)])]

    @classmethod
    def unpacked(cls, data: list[bytes]) -> Members:
        cols = [unpack_ints(d) for d in data[:6]]
        place, n_left, n_right = (x.astype(np.int64) for x in cols[1:4])
        return cls(cols[0], place, n_left, n_right, *cols[4:], np.r_[0, np.cumsum(n_left + n_right)][:-1], data[6])


def divided(m: Members, width: int, whole: bool) -> tuple[Members, tuple[np.ndarray, np.ndarray]]:
    """Members clipped to spans of ``width`` values of b, keyed by what windows of the span share, and (start, stop) settled here.

    Equal clipped members of a chunk leave their first only, unless ``whole``.
    """
    parts, gone = [], [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    at = m.begin + m.n_left
    for lo in range(GRAM, SPAN + 1, width):
        hi = min(lo + width - 1, SPAN)
        i = np.flatnonzero((m.n_right >= lo) & (SPAN - m.n_left <= hi))
        if not len(i):
            continue
        left, right = np.minimum(m.n_left[i], SPAN - lo), np.minimum(m.n_right[i], hi)
        p = at[i].tolist()
        key = np.array([xxhash.xxh64_intdigest(m.text[x - SPAN + hi : x + lo], lo) for x in p], np.uint64)
        clipped = Members(key, m.place[i], left, right, m.doc[i], m.sub[i], at[i] - left, m.text)
        if not whole:
            same = key
            if hi > lo:
                same = np.array([xxhash.xxh64_intdigest(m.text[x - a : x + b], a) for x, a, b in zip(p, left.tolist(), right.tolist(), strict=True)], np.uint64)
            new = _first_of(same, len(i))
            old = clipped.take(np.flatnonzero(~new))
            gone.append((old.place - old.n_left, old.place + old.n_right))
            clipped = clipped.take(np.flatnonzero(new))
        parts.append(clipped)
    if not parts:
        return m.take(np.zeros(0, np.int64)), gone[0]
    return Members(*(np.concatenate([x[k] for x in parts]) for k in range(7)), m.text), tuple(np.concatenate([g[k] for g in gone]) for k in (0, 1))


def routed(name: str, m: Members, kind: np.ndarray, gone: tuple, ranges: int, single: bool, whole: bool) -> list[tuple]:
    """Rows of SENT for a chunk's members: those of trees that a task can hold, those to be divided further, single windows, and settled spans."""
    rows = []
    t = m.take(np.flatnonzero(kind == 1))
    t = t.take(np.argsort(t.key, kind="stable"))
    for p, x, y in segments(t.key, ranges, 64):
        rows.append(("around", p, name, t.take(np.arange(x, y)).packed()))
    h = m.take(np.flatnonzero(kind == 2))
    if len(h.key) and not single:
        rows.append(("hot", 0, name, h.packed()))
    elif len(h.key) and whole:
        group = [xxhash.xxh64_intdigest(h.text[x : x + SPAN]) for x in h.begin.tolist()]
        rows.append(("group", 0, name, [pack_ints(np.array(group, np.uint64)), pack_ints(np.full(len(group), SPAN)), pack_ints(h.place - h.n_left)]))
    elif len(h.key):
        h = h.take(np.argsort(h.key, kind="stable"))
        for p, x, y in segments(h.key, ranges, 64):
            w = h.take(np.arange(x, y))
            rows.append(("window", p, name, [pack_ints(w.key, True), pack_ints(w.place - w.n_left), pack_ints(w.doc), pack_ints(w.sub)]))
    if len(gone[0]):
        rows.append(("settled", 0, name, [pack_ints(x) for x in merged(*gone)]))
    return rows


def _kinds(table: pa.Table, inverse: np.ndarray) -> np.ndarray:
    parts = sorted(zip(table.column("part").to_pylist(), table.column("data").to_pylist(), strict=True))
    return np.concatenate([unpack_ints(d) for _, d in parts])[inverse] if parts else np.zeros(0, np.uint64)


def surroundings(name: str, payload: bytes, kinds: pa.Table, ranges: int, whole: bool) -> list[tuple]:
    """Rows of SENT for a chunk: the surroundings of its repeated places, the windows from first to last."""
    c = Chunk(unseal(payload), name)
    c.choose()
    _, inverse, _ = c.keys()
    kind = _kinds(kinds, inverse)
    at = np.flatnonzero(kind > 0)
    gone = (np.zeros(0, np.int64),) * 2
    if not whole:
        with np.errstate(over="ignore"):
            same = _mix(c.hash[at] ^ _mix(c.head[at] + np.uint64(1)) ^ _mix(c.tail[at] * np.uint64(3) + (c.place[at] - c.first[at] + ((c.last[at] - c.first[at]) << 8)).astype(np.uint64)))
        new = _first_of(same, len(at))
        gone = (c.first[at[~new]], c.last[at[~new]] + SPAN)
        at = at[new]
    doc = c.row(c.first[at])
    m = Members(c.hash[at], c.place[at], c.place[at] - c.first[at], c.last[at] + SPAN - c.place[at], c.doc[doc], c.sub[doc], c.first[at], c.data.tobytes())
    return routed(name, m, kind[at], gone, ranges, False, whole)


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans."""
    if not len(start):
        return start, stop
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.r_[True, start[1:] > stop[:-1]]
    return start[new], stop[np.r_[np.flatnonzero(new)[1:] - 1, len(stop) - 1]]


def intervals(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """Common-prefix intervals (depth, first, last) of depth ``least`` and more; lcp[i] is that of suffixes i and i + 1."""
    out, stack = [], []
    for i, h in enumerate([*lcp, 0]):
        at = i
        while stack and stack[-1][0] > h:
            depth, at = stack.pop()
            out.append((depth, at, i))
        if h >= least and (not stack or stack[-1][0] < h):
            stack.append((h, at))
    return out


def _prefix(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of matching rows, at most ``most``."""
    differ = a != b
    return np.minimum(np.where(differ.any(1), differ.argmax(1), a.shape[1]), most)


def repeats(key, left, right, n_left, n_right, rank, whole: bool = False) -> tuple[np.ndarray, ...]:
    """(member, left reach, right reach, group, is it the first) of all occurrences of each maximal repeat of SPAN bytes and more.

    left and right: zero-padded bytes (shifted by one) outwards from the
    places, which all share GRAM bytes by key; rank: order of the occurrences.
    Without ``whole`` a group may come whose members all go on alike to the right; one as large and longer comes with it.
    """
    n = len(key)
    row = np.empty((n, 8 + SPAN), np.uint8)
    row[:, :8] = key.astype(">u8").view(np.uint8).reshape(-1, 8)
    row[:, 8:] = right
    order = np.argsort(np.ascontiguousarray(row).view(f"S{8 + SPAN}").ravel(), kind="stable")
    same = key[order][1:] == key[order][:-1]
    lcp = np.where(same, _prefix(right[order][1:], right[order][:-1], np.minimum(n_right[order][1:], n_right[order][:-1])), 0)
    found = intervals(lcp.tolist(), GRAM)
    empty = np.zeros(0, np.int64)
    out = [(empty, empty, empty, empty, empty.astype(bool))]
    count = 0
    pairs = np.array([(d, a) for d, a, b in found if b == a + 1], np.int64).reshape(-1, 2)
    if len(pairs):
        x, y = order[pairs[:, 1]], order[pairs[:, 1] + 1]
        reach = _prefix(left[x], left[y], np.minimum(n_left[x], n_left[y]))
        ok = reach + pairs[:, 0] >= SPAN
        x, y, reach, depth, group = x[ok], y[ok], reach[ok], pairs[ok, 0], np.arange(ok.sum())
        swap = rank[x] > rank[y]
        out.append((np.where(swap, y, x), reach, depth, group, np.ones(len(x), bool)))
        out.append((np.where(swap, x, y), reach, depth, group, np.zeros(len(x), bool)))
        count = len(group)
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    for depth, a, b in found:
        if b > a + 1:
            m = order[a : b + 1]
            m = m[n_left[m] >= SPAN - depth]
            if len(m) < 2:
                continue
            m = m[np.argsort(np.ascontiguousarray(left[m]).view(f"S{left.shape[1]}").ravel(), kind="stable")]
            reach = _prefix(left[m[1:]], left[m[:-1]], np.minimum(n_left[m[1:]], n_left[m[:-1]]))
            groups = intervals(reach.tolist(), max(1, SPAN - depth))
            if depth == SPAN and not reach.all():  # long enough without any left extension
                groups.append((0, 0, len(m) - 1))
            for d, i, j in groups:
                g = m[i : j + 1]
                if whole and lcp[where[g].min() : where[g].max()].min() > depth:
                    continue
                size = len(g)
                out.append((g, np.full(size, d), np.full(size, depth), np.full(size, count), np.arange(size) == rank[g].argmin()))
                count += 1
    return tuple(np.concatenate([o[k] for o in out]) for k in range(5))


def _by_chunk(chunk: np.ndarray, cols: list[np.ndarray], names: list[str], schema: str, made=lambda *cols: cols) -> pa.Table:
    """A row a chunk with the packed columns that ``made`` makes of its entries."""
    rows = []
    order = np.argsort(chunk, kind="stable")
    cut = np.searchsorted(chunk[order], np.arange(len(names) + 1))
    for k, name in enumerate(names):
        i = order[cut[k] : cut[k + 1]]
        if len(i):
            rows.append((name, *(pack_ints(x) for x in made(*(c[i] for c in cols)))))
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], pa.string() if t == "string" else pa.binary()) for i, (n, t) in enumerate(fields)})


def _spans(chunk: np.ndarray, start: np.ndarray, stop: np.ndarray, names: list[str]) -> pa.Table:
    return _by_chunk(chunk, [start, stop], names, SPANS, merged)


def outwards(text: np.ndarray, at: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of ``size`` bytes from each place on, zero-padded; byte values are shifted by one, as 255 is no byte of UTF-8."""
    out, k = np.zeros((len(at), width), np.uint8), np.arange(width)
    for i in range(0, len(at), 4096):
        inside = k < size[i : i + 4096, None]
        out[i : i + 4096] = np.where(inside, text[np.where(inside, at[i : i + 4096, None] + step * k, 0)] + np.uint8(1), 0)
    return out


def _range_members(table: pa.Table) -> tuple[list[str], np.ndarray, Members, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks by name; of those members of a key range whose key another one has chunk, fields, rank, and bytes to the right and left."""
    table = table.sort_by("chunk")
    names, data = table.column("chunk").to_pylist(), table.column("data").to_pylist()
    each = [Members.unpacked(d) for d in data]
    chunk = np.repeat(np.arange(len(names)), [len(m.key) for m in each])
    cols = [np.concatenate([m[k] for m in each]) for k in range(6)]
    begin = np.r_[0, np.cumsum(cols[2] + cols[3])][:-1]
    m = Members(*cols, begin, b"".join(m.text for m in each))
    # a key that one place alone holds here was repeated within its chunk only
    _, inverse, count = np.unique(m.key, return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[inverse] > 1)
    m, chunk = m.take(some), chunk[some]
    rank = np.empty(len(some), np.int64)
    rank[np.lexsort((m.place, chunk, m.sub, m.doc))] = np.arange(len(some))
    text, at = np.frombuffer(m.text, np.uint8), m.begin + m.n_left
    return names, chunk, m, rank, outwards(text, at, m.n_right, SPAN, 1), outwards(text, at - 1, m.n_left, REACH, -1)


def tree_spans(table: pa.Table) -> pa.Table:
    """Spans to remove, from the surroundings of one key range."""
    names, chunk, m, rank, right, left = _range_members(table)
    out = [(np.zeros(0, np.int64),) * 3]
    if len(m.key):
        row = np.hstack([m.key.astype(">u8").view(np.uint8).reshape(-1, 8), right, left])
        _, label = np.unique(np.ascontiguousarray(row).view(f"V{row.shape[1]}").ravel(), return_inverse=True)
        by = np.lexsort((rank, label))
        new = np.r_[True, label[by][1:] != label[by][:-1]]
        again = by[~new]
        out.append((again, m.n_left[again], m.n_right[again]))
        left_over = np.sort(by[new])
        _, inverse, count = np.unique(m.key[left_over], return_inverse=True, return_counts=True)
        k = left_over[count[inverse] > 1]
        if len(k):
            i, a, b, _, first = repeats(m.key[k], left[k], right[k], m.n_left[k], m.n_right[k], rank[k])
            out.append((k[i[~first]], a[~first], b[~first]))
    i, a, b = (np.concatenate([o[k] for o in out]) for k in range(3))
    return _spans(chunk[i], m.place[i] - a, m.place[i] + b, names)


def tree_groups(table: pa.Table) -> pa.Table:
    """Maximal repeat groups with all their occurrences, from the surroundings of one key range."""
    names, chunk, m, rank, right, left = _range_members(table)
    if not len(m.key):
        return _by_chunk(chunk, [m.place] * 3, names, GROUPS)
    i, a, b, group, first = repeats(m.key, left, right, m.n_left, m.n_right, rank, whole=True)
    ids = np.zeros(group.max() + 1 if len(group) else 0, np.uint64)
    at = (m.begin + m.n_left)[i]
    for k in np.flatnonzero(first).tolist():
        ids[group[k]] = xxhash.xxh64_intdigest(m.text[at[k] - a[k] : at[k] + b[k]])
    return _by_chunk(chunk[i], [ids[group], a + b, m.place[i] - a], names, GROUPS)


def _windows(table: pa.Table) -> tuple:
    """Chunks by name; of their windows chunk, key and place; the order by key and then by text, chunk and place; doc and text digest."""
    table = table.sort_by("chunk")
    names, data = table.column("chunk").to_pylist(), table.column("data").to_pylist()
    cols = [[unpack_ints(d[i], i == 0) for d in data] for i in range(4)]
    chunk = np.repeat(np.arange(len(names)), [len(x) for x in cols[0]])
    key, place, doc, sub = (np.concatenate(c) for c in cols)
    return names, chunk, key, place, np.lexsort((place, chunk, sub, doc, key)), doc, sub


def _window_removal(names, chunk, place, gone: np.ndarray) -> pa.Table:
    at = place[gone].astype(np.int64)
    return _spans(chunk[gone], at, at + SPAN, names)


def window_spans(table: pa.Table) -> pa.Table:
    """Spans to remove, from the windows of one key range: all occurrences but the first."""
    names, chunk, key, place, by, _, _ = _windows(table)
    return _window_removal(names, chunk, place, by[1:][key[by][1:] == key[by][:-1]])


def first_windows(table: pa.Table) -> pa.Table:
    """The first occurrence of each window in a salt's share of a key range."""
    names, chunk, key, place, by, doc, sub = _windows(table)
    i = by[np.r_[True, key[by][1:] != key[by][:-1]]]
    data = [pack_ints(key[i], True), pack_ints(place[i]), pack_ints(doc[i]), pack_ints(sub[i]), "\n".join(names[k] for k in chunk[i]).encode()]
    return pa.table({"part": table.column("part").slice(0, 1), "salt": table.column("salt").slice(0, 1), "data": pa.array([data], pa.list_(pa.binary()))})


def winning_salts(table: pa.Table) -> pa.Table:
    """For each salt of a key range the keys of the windows whose first occurrence it has not."""
    data, salts = table.column("data").to_pylist(), table.column("salt").to_pylist()
    cols = [[unpack_ints(d[i], i == 0) for d in data] for i in range(4)]
    salt = np.repeat(np.arange(len(salts)), [len(x) for x in cols[0]])
    key, place, doc, sub = (np.concatenate(c) for c in cols)
    chunk = np.unique(np.concatenate([np.array(d[4].decode().split("\n")) for d in data]), return_inverse=True)[1]
    by = np.lexsort((place, chunk, sub, doc, key))
    lost = by[1:][key[by][1:] == key[by][:-1]]
    each = [np.sort(key[lost[salt[lost] == k]]) for k in range(len(salts))]
    return pa.table({"part": table.column("part"), "salt": table.column("salt"), "lost": pa.array([pack_ints(x, True) for x in each], pa.binary())})


def salted_window_spans(left: pa.Table, right: pa.Table) -> pa.Table:
    """Spans to remove, from one salt's share of a key range, when other salts may have the first occurrence."""
    names, chunk, key, place, by, _, _ = _windows(left)
    first = np.r_[True, key[by][1:] != key[by][:-1]]
    lost = np.isin(key[by], unpack_ints(right.column("lost")[0].as_py(), True))
    return _window_removal(names, chunk, place, by[~first | lost])


OUT = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType())]


def _sent(rows: list[tuple]) -> pa.Table:
    types = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.binary()))
    return pa.table({c.split()[0]: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(SENT.split(", "), types, strict=True))})


def gathered(chunks: DataFrame, ranges: int, hot: int, salts: int, whole: bool) -> DataFrame:
    """Rows of SENT of all chunks: first by hashes at chosen places; what is above ``hot`` is divided, level by level."""

    def around(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for name, payload in zip(left.column("chunk").to_pylist(), left.column("payload").to_pylist(), strict=True):
            rows += surroundings(name, payload, right, ranges, whole)
        return _sent(rows)

    kinds = gram_totals(chunks, ranges, hot, salts)
    level = materialise(chunks.select("chunk", "payload").groupBy("chunk").cogroup(kinds.select("chunk", "part", "data").groupBy("chunk")).applyInArrow(around, SENT), "surroundings")
    out = level
    for width in WIDTHS:
        members = level.where("kind = 'hot'").select("chunk", "data")
        if members.isEmpty():
            break
        level = materialise(_divide(members, width, ranges, hot, salts, whole), f"divided-{width}")
        out = out.unionByName(level)
    return out


def _divide(members: DataFrame, width: int, ranges: int, hot: int, salts: int, whole: bool) -> DataFrame:
    """Rows of SENT for chunks' members of trees above ``hot``, one level down."""

    def totals(batches):
        for b in batches:
            for name, data in zip(b.column("chunk").to_pylist(), b.column("data").to_pylist(), strict=True):
                keys, counts = np.unique(divided(Members.unpacked(data), width, whole)[0].key, return_counts=True)
                rows = [(p, pack_ints(keys[x:y], True), pack_ints(counts[x:y])) for p, x, y in segments(keys, ranges, 64)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary())))], names=["chunk", "part", "keys", "counts"])
        give_back()

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for name, data in zip(left.column("chunk").to_pylist(), left.column("data").to_pylist(), strict=True):
            m, gone = divided(Members.unpacked(data), width, whole)
            rows += routed(name, m, _kinds(right, np.unique(m.key, return_inverse=True)[1]), gone, ranges, width == 1, whole)
        return _sent(rows)

    counted = members.mapInArrow(totals, "chunk string, part bigint, keys binary, counts binary")
    kinds = corpus_totals(counted, salts, f"kinds-{width}", lambda total: (total > 1).astype(np.uint64) + (total > hot)).where("chunk is not null")
    return members.groupBy("chunk").cogroup(kinds.select("chunk", "part", "data").groupBy("chunk")).applyInArrow(send, SENT)


def removed_spans(docs: DataFrame, hot: int = HOT, size: int = CHUNK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(chunks of docs, stored spans to remove by chunk and place in it)."""
    chunks = chunked(docs.select("doc_id", "text"), "suffix-chunks", size)
    ranges, salts = ranges_for(chunks, RANGE), salts_for(chunks, fan)
    sent = gathered(chunks, ranges, hot, salts, False)
    of = lambda kind: sent.where(F.col("kind") == kind).select("part", "chunk", "data")
    settled = of("settled").select("chunk", F.col("data")[0].alias("start"), F.col("data")[1].alias("stop"))
    spans = of("around").groupBy("part").applyInArrow(tree_spans, SPANS).unionByName(settled)
    if salts == 1:
        windows = of("window").groupBy("part").applyInArrow(window_spans, SPANS)
    else:  # a window that every chunk has is no task's burden: first within a salt, then between salts
        salted = of("window").withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int"))
        firsts = salted.groupBy("part", "salt").applyInArrow(first_windows, "part bigint, salt int, data array<binary>")
        lost = materialise(firsts.groupBy("part").applyInArrow(winning_salts, "part bigint, salt int, lost binary"), "lost-windows")
        windows = salted.groupBy("part", "salt").cogroup(lost.groupBy("part", "salt")).applyInArrow(salted_window_spans, SPANS)
    return chunks, materialise(spans.unionByName(windows), "spans")


def repeat_groups(docs: DataFrame, hot: int = HOT, size: int = CHUNK, fan: int = FAN) -> DataFrame:
    """All occurrences (group, length, doc_id, start) of the corpus's repeats of SPAN bytes and more; start counts bytes of the document.

    group: 16 hexadecimal digits, the XXH64 of the repeat's bytes.  A group has
    every occurrence of its string in the corpus, first ones and rows that
    repeat included.  Groups are maximal within the windows about a chosen
    place: they can't be extended there on either side without losing an
    occurrence.  A longer repeat comes as the overlapping groups of its places;
    one divided for its number of occurrences as pieces of SPAN bytes and more.
    Each window that occurs twice lies within a group.  Occurrences of a group
    above ``hot`` are never gathered.  Nulls, empty tables and rows that
    repeat an id: as for the module.
    """
    chunks = chunked(docs.select("doc_id", "text"), "suffix-chunks", size)
    ranges, salts = ranges_for(chunks, RANGE), salts_for(chunks, fan)
    sent = gathered(chunks, ranges, hot, salts, True)
    single = sent.where("kind = 'group'").select("chunk", *(F.col("data")[i].alias(n) for i, n in enumerate(("group", "length", "at"))))
    found = sent.where("kind = 'around'").select("part", "chunk", "data").groupBy("part").applyInArrow(tree_groups, GROUPS).unionByName(single)
    schema = T.StructType([T.StructField("group", T.StringType()), T.StructField("length", T.LongType()), docs.schema["doc_id"], T.StructField("start", T.LongType())])

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for name, payload in zip(left.column("chunk").to_pylist(), left.column("payload").to_pylist(), strict=True):
            c = Chunk(unseal(payload), name)
            group, length, at = (np.concatenate([unpack_ints(x) for x in right.column(k).to_pylist()] or [np.zeros(0, np.uint64)]) for k in ("group", "length", "at"))
            doc = c.row(at.astype(np.int64))
            start = at.astype(np.int64) - (c.ends - c.sizes)[doc]
            ids = c.table.column("doc_id").take(pa.array(np.array(c.order, np.int64)[doc]))
            rows.append(pa.table([pa.array([f"{g:016x}" for g in group.tolist()], pa.string()), pa.array(length.astype(np.int64)), ids, pa.array(start)], names=schema.names))
        return pa.concat_tables(rows) if rows else pa.table([pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int64())], names=schema.names)

    return chunks.select("chunk", "payload").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(place, schema)


def substring_dedup(docs: DataFrame, hot: int = HOT, texts: bool = False, size: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id and OUT for each row of docs; with ``texts`` also what is left of each text (broken characters dropped)."""
    chunks, spans = removed_spans(docs, hot, size, fan)
    more = [T.StructField("kept_text", T.StringType())] if texts else []
    schema = T.StructType([docs.schema["doc_id"]] + [T.StructField(n, t) for n, t in OUT] + more)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = [[] for _ in range(len(schema) - 1)]
        ids = []
        for name, payload in zip(left.column("chunk").to_pylist(), left.column("payload").to_pylist(), strict=True):
            c = Chunk(unseal(payload), name)
            got = [np.concatenate([unpack_ints(x).astype(np.int64) for x in right.column(k).to_pylist()] or [np.zeros(0, np.int64)]) for k in ("start", "stop")]
            change = np.zeros(len(c.data) + 1, np.int32)
            np.add.at(change, got[0], 1)
            np.add.at(change, got[1], -1)
            gone = np.cumsum(change[:-1]) > 0
            begin = 0
            for text, end in zip(c.texts, c.ends.tolist(), strict=True):
                g = gone[begin:end]
                kept = text if not g.any() else c.data[begin:end][~g].tobytes()
                runs = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                row = [len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest()]
                for col, v in zip(cols, row + [kept.decode("utf-8", "ignore")] * texts, strict=True):
                    col.append(v)
                begin = end
            ids.append(c.table.column("doc_id").take(pa.array(c.order, pa.int64())))
        return pa.table([pa.chunked_array([x for i in ids for x in i.chunks]), *map(pa.array, cols)], names=schema.names)

    return chunks.select("chunk", "payload").groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(cut, schema)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))
