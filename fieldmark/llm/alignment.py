"""Alignment of two tokenizations of the same text, document by document.

Tokens of A (byte-level pairs, of space + text) and B (pieces with byte
fallback, which puts a space before the text) are cut into groups where both
end at one byte.  Both tokenizers always end a token before a single space that
stands between two other characters, and neither looks across it, so a text
falls into units there and a unit is tokenised like a text of its own.

A fragment is what is known of a byte range of a document: an open prefix (the
bytes before its first such cut), the closed groups between its first and last
cut, and an open suffix.  ``compose`` joins two neighbouring fragments by
tokenising what lies between their outer cuts; it is associative, and bytes
without a cut are a fragment that is all open.  Documents of more than ``span``
bytes are cut into byte ranges, wherever these fall, which are tokenised on
different executors and composed in a tree of ``FAN`` at a time; shorter ones
are one range, closed at both ends.  Groups' texts stay in rows, in the order of
the document, and are hashed as they stream past; no task holds a document's.

A chunk of documents sends each of its distinct id pairs once, in compressed
blocks by ranges of A ids, and gets back in how many documents of the corpus the
pair is linked and whether that is the most of its A id.

Nulls: a null or empty text, and one whose tokens don't give its bytes (B reads
U+2581 as a space), has no tokens.  A null doc_id keeps its row.  Every row is a
document of its own, repeated rows too.  Ties for an A id's highest count all
count.  A unit (a text without a cut may be one, however long) is tokenised in
one task.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import FAN as BLOCKS
from .chunks import corpus_totals, pack_ints, ranges_for, salts_for, seal, segments, unpack_ints, unseal
from .common import documents, give_back, materialise, slices

#: Bytes of a range of a document, and fragments that are composed at once.
SPAN, FAN = 1 << 16, 16
#: Bytes of text of which a chunk's documents consist, about.
CHUNK = 2 << 20
#: Bits of an A id and of a B id in the key of a pair.
A_BITS, B_BITS = 16, 15
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Pairs that are spelt out at once.
AT_ONCE = 4 << 20


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sorted; the sum of the values of each)."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def _spread(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place): places start .. start + length - 1 of each, end to end."""
    which = np.repeat(np.arange(len(length)), length)
    return which, start[which] + np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length)


@dataclass
class Closed:
    """What closed groups come to: tokens, groups, links, and how often each pair (a << B_BITS | b) is linked."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    valid: bool = True
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __add__(self, other: Closed) -> Closed:
        keys, times = _sums(np.concatenate([self.keys, other.keys]), np.concatenate([self.times, other.times]))
        return Closed(self.n_a + other.n_a, self.n_b + other.n_b, self.n_groups + other.n_groups, self.n_links + other.n_links, self.valid and other.valid, keys, times)


class Aligner:
    """Both tokenizers, and a cache of aligned units (results never depend on it) that starts anew at ``keep`` units or ``most`` bytes."""

    def __init__(self, a: str, b: str, keep: int = 150_000, most: int = 24 << 20):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b, self.keep, self.most = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b), keep, most
        self.a.encode_special_tokens = True
        shown = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
        byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(sorted({*range(256)} - {*shown}))}
        names = {i: s for s, i in self.a.get_vocab().items()}
        self.a_bytes = [bytes(byte[c] for c in names.get(i, "") if c in byte) for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(self.a_bytes) > 1 << A_BITS or len(self.b_bytes) > 1 << B_BITS:
            raise ValueError("a vocabulary is larger than its part of a pair's key")
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # an id's text is followed by ',' within its side, by '|' after the last of A and by ';' after the last of B
        self.text = np.array([f"{i}{sep}" for n, seps in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for sep in seps for i in range(n)], object)
        self.text_size = np.array(list(map(len, self.text)), np.int64)
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 5), np.int64)  # of each unit: n_a, n_b, n_groups, n_links, valid
        self.first = np.zeros(1, np.int64)  # of each unit its first pair, and the end
        self.keys, self.times, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def slots(self, units: list[str]) -> np.ndarray:
        """The place of each unit in the tables, until the next call."""
        if len(self.slot) > self.keep or self.held > self.most:
            self._clear()
        if new := list(set(units).difference(self.slot)):
            self._add(new)
        return np.fromiter(map(self.slot.__getitem__, units), np.int64, len(units))

    def _add(self, units: list[str]) -> None:
        want = [b" " + u.encode() for u in units]
        a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        b = self.b.encode(units, num_threads=1)
        valid = np.array([b"".join(map(self.a_bytes.__getitem__, x)) == w and b"".join(map(self.b_bytes.__getitem__, y)) == w for x, y, w in zip(a, b, want, strict=True)], bool)
        if not valid.all():
            a, b = ([x if v else [] for x, v in zip(ids, valid, strict=True)] for ids in (a, b))
        n = len(units)
        size_a, size_b = (np.fromiter(map(len, x), np.int64, n) for x in (a, b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        ends = np.cumsum(np.where(valid, np.fromiter(map(len, want), np.int64, n), 0))
        end_a, end_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        unit = np.searchsorted(ends, shared)  # of each group
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        # texts: a group's A tokens, then its B tokens
        side = np.concatenate([2 * group_a, 2 * group_b + 1])
        last = np.concatenate([np.r_[group_a[1:] != group_a[:-1], True][: len(group_a)], np.r_[group_b[1:] != group_b[:-1], True][: len(group_b)]])
        index = np.concatenate([flat_a, 2 * len(self.a_bytes) + flat_b]) + last * np.where(side % 2, len(self.b_bytes), len(self.a_bytes))
        index = index[np.argsort(side, kind="stable")]
        text, cut = "".join(self.text[index].tolist()), np.zeros(n + 1, np.int64)
        cut[1:] = np.r_[0, np.cumsum(self.text_size[index])][np.cumsum(size_a + size_b)]
        cuts = cut.tolist()
        self.groups += [text[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        in_a, in_b = np.bincount(group_a, minlength=len(shared)), np.bincount(group_b, minlength=len(shared))
        links, per_unit = np.zeros(n, np.int64), np.bincount(unit, minlength=n)
        np.add.at(links, unit, in_a * in_b)
        self.counts = np.concatenate([self.counts, np.stack([size_a, size_b, per_unit, links, valid], 1)])
        of, keys, times = self._pairs(group_a, flat_a, group_b, flat_b, unit)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(of, minlength=n))])
        self.keys, self.times = np.concatenate([self.keys, keys]), np.concatenate([self.times, times])
        self.slot.update(zip(units, range(len(self.slot), len(self.slot) + n), strict=True))
        self.held += len(text) + int(ends[-1]) + 16 * len(keys)

    @staticmethod
    def _pairs(group_a, ids_a, group_b, ids_b, unit) -> tuple[np.ndarray, ...]:
        """(unit, key, times) of the distinct pairs that share a group, by unit: distinct ids of a group meet, not occurrences."""
        a, times_a = np.unique(group_a << A_BITS | ids_a, return_counts=True)
        b, times_b = np.unique(group_b << B_BITS | ids_b, return_counts=True)
        start = np.searchsorted(b >> B_BITS, a >> A_BITS)
        reps = np.searchsorted(b >> B_BITS, a >> A_BITS, side="right") - start
        until, out, at = np.cumsum(reps), [], 0
        while at < len(a):
            upto = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + AT_ONCE, side="right")))
            i, j = _spread(start[at:upto], reps[at:upto])
            i += at
            key = (a[i] & (1 << A_BITS) - 1) << B_BITS | b[j] & (1 << B_BITS) - 1
            out.append(_sums(unit[a[i] >> A_BITS] << A_BITS + B_BITS | key, times_a[i] * times_b[j]))
            at = upto
        both, times = _sums(np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return both >> A_BITS + B_BITS, both & (1 << A_BITS + B_BITS) - 1, times

    def closed(self, units: list[str]) -> tuple[Closed, str]:
        """Whole units, one after another, and the text of their groups, each with ';' after it."""
        at = self.slots(units)
        n = self.counts[at].sum(0).tolist()
        which, place = _spread(self.first[at], self.first[at + 1] - self.first[at])
        return Closed(*n[:4], bool(n[4] == len(units)), *_sums(self.keys[place], self.times[place])), "".join(map(self.groups.__getitem__, at.tolist()))

    def documents(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(counts of each text, text of its groups; document, key, times of the pairs, sorted); no tokens where they don't give the text."""
        units = [_CUT.split(t) if t else [] for t in texts]
        size = np.fromiter(map(len, units), np.int64, len(units))
        at = self.slots(list(chain.from_iterable(units)))
        end = np.cumsum(size)
        doc = np.repeat(np.arange(len(size)), size)
        counts = np.zeros((len(size), 5), np.int64)
        some = np.flatnonzero(size)
        if len(some):
            counts[some] = np.add.reduceat(self.counts[at], end[some] - size[some])
        ok = (size > 0) & (counts[:, 4] == size)
        counts[~ok] = 0
        groups = ["".join(map(self.groups.__getitem__, at[e - s : e].tolist())) if o else "" for s, e, o in zip(size.tolist(), end.tolist(), ok.tolist(), strict=True)]
        held = ok[doc]
        met, n = np.unique(doc[held] * len(self.slot) + at[held], return_counts=True)
        doc, at = np.divmod(met, max(1, len(self.slot)))
        which, place = _spread(self.first[at], self.first[at + 1] - self.first[at])
        both, times = _sums(doc[which] << A_BITS + B_BITS | self.keys[place], self.times[place] * n[which])
        return counts[:, :4], groups, both >> A_BITS + B_BITS, both & (1 << A_BITS + B_BITS) - 1, times


@lru_cache(1)
def shared_aligner(a: str, b: str) -> Aligner:
    """A worker's own, with a small cache, for tasks of many small groups."""
    return Aligner(a, b, 10_000, 2 << 20)


# ---------------------------------------------------------------- fragments


@dataclass
class Fragment:
    """Of a byte range: what precedes its first cut, what is closed, what follows its last cut (None: no cut, all is prefix)."""

    prefix: bytes
    closed: Closed = field(default_factory=Closed)
    suffix: bytes | None = None


def fragment(data: bytes, aligner: Aligner) -> tuple[Fragment, str]:
    """The fragment of some bytes of a document, and the text of its closed groups.  A character may be cut at either end."""
    low = 0
    while low < min(3, len(data)) and data[low] & 0xC0 == 0x80:
        low += 1
    high = len(data)
    for back in range(1, min(4, high - low) + 1):
        if (c := data[-back]) & 0xC0 != 0x80:
            if c >= 0xC0 and back < (2 if c < 0xE0 else 3 if c < 0xF0 else 4):
                high -= back
            break
    units = _CUT.split(data[low:high].decode())
    if len(units) == 1:
        return Fragment(data), ""
    closed, text = aligner.closed(units[1:-1]) if len(units) > 2 else (Closed(), "")
    return Fragment(data[:low] + units[0].encode(), closed, units[-1].encode() + data[high:]), text


def compose(x: Fragment, y: Fragment, aligner: Aligner) -> tuple[Fragment, str]:
    """The fragment of two neighbours, and the text of the groups that close between them."""
    between, text = fragment((x.prefix if x.suffix is None else x.suffix) + y.prefix, aligner)
    if x.suffix is None and y.suffix is None:
        return between, text

    def shut(*ends: bytes) -> tuple[Closed, str]:
        return aligner.closed([e.decode() for e in ends])

    if between.suffix is None:  # no cut of its own: it stays open on an open side
        if x.suffix is None:
            return Fragment(between.prefix, y.closed, y.suffix), text
        if y.suffix is None:
            return Fragment(x.prefix, x.closed, between.prefix), text
        one, text = shut(between.prefix)
        return Fragment(x.prefix, x.closed + one + y.closed, y.suffix), text
    if x.suffix is None:
        one, more = shut(between.suffix)
        return Fragment(between.prefix, between.closed + one + y.closed, y.suffix), text + more
    one, more = shut(between.prefix)
    if y.suffix is None:
        return Fragment(x.prefix, x.closed + one + between.closed, between.suffix), more + text
    two, most = shut(between.suffix)
    return Fragment(x.prefix, x.closed + one + between.closed + two + y.closed, y.suffix), more + text + most


def shut_ends(x: Fragment, aligner: Aligner) -> tuple[Closed, str, str]:
    """A whole document's fragment: all closed, and the texts of its first and last groups."""
    if x.suffix is None:
        return (*aligner.closed([x.prefix.decode()]), "")
    one, first = aligner.closed([x.prefix.decode()])
    two, last = aligner.closed([x.suffix.decode()])
    return one + x.closed + two, first, last


# ---------------------------------------------------------------- Spark

DOC = [(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", T.StringType())]
CHUNKS = "chunk string, bytes bigint, docs binary, keys binary, counts binary, places binary, times binary"
#: kind 0: a fragment; 1: text of groups, in its place (at, sub) of the document.
PARTS = "row bigint, at bigint, sub int, kind int, data binary"


def _digest(groups: str) -> str:
    return hashlib.sha256(groups[:-1].encode()).hexdigest() if groups else ""


def _chunk(doc_ids: pa.Array, size: int, counts: np.ndarray, shas: list[str], doc: np.ndarray, key: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """One row of CHUNKS; each distinct pair of the chunk is there once, with the number of its documents."""
    keys, place = np.unique(key, return_inverse=True)
    table = pa.RecordBatch.from_arrays([doc_ids, *(pa.array(counts[:, i]) for i in range(4)), pa.array(shas, pa.string())], names=["doc_id", *(n for n, _ in DOC)])
    packed = [seal(table), pack_ints(keys, True), pack_ints(np.bincount(place, minlength=len(keys))), pack_ints(doc * len(keys) + place, True), pack_ints(times)]
    return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([size], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)], names=[c.split()[0] for c in CHUNKS.split(", ")])


def _short(docs: DataFrame, a: str, b: str, size: int) -> DataFrame:
    """CHUNKS of documents that are one range each."""

    def run(batches):
        aligner = Aligner(a, b)
        for s in slices(batches, most=size):
            counts, groups, *pairs = aligner.documents([t or "" for t in s.column("text").to_pylist()])
            yield _chunk(s.column("doc_id"), s.column("text").nbytes, counts, list(map(_digest, groups)), *pairs)
        del aligner
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, CHUNKS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[c.split()[0] for c in PARTS.split(", ")])


def _seal(x) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x))


def _unseal(data: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))  # noqa: S301  our own rows


def fragments(docs: DataFrame, a: str, b: str, span: int = SPAN, fan: int = FAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, doc_id, size; a composed fragment for each row; text parts of closed groups) of documents that are many ranges."""
    ids = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("data"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("data") - 1) / span).cast("int")), lambda i: F.substring("data", i * span + 1, F.lit(span)))
    held = materialise(ids.select("row", "doc_id", F.octet_length("data").cast("bigint").alias("size"), F.posexplode(cut).alias("at", "data")), "align-ranges")
    whole = held.where("at = 0").select("row", "doc_id", "size")

    def leaves(batches):
        aligner = Aligner(a, b)
        for s in slices(batches, "data"):
            rows = []
            for row, at, data in zip(*(s.column(c).to_pylist() for c in ("row", "at", "data")), strict=True):
                x, text = fragment(data, aligner)
                rows.append((row, at, 0, 0, _seal(x)))
                if text:
                    rows.append((row, at, 0, 1, text.encode()))
            yield _rows(rows)
        del aligner
        give_back()

    top = held.agg(F.max("at")).first()[0] or 0
    parallel = held.repartition("row", "at").select("row", "at", "data")
    level = materialise(parallel.mapInArrow(leaves, PARTS), "align-leaves")
    texts, step = level.where("kind = 1"), 1

    def climb(t: pa.Table) -> pa.Table:
        aligner, rows, x = shared_aligner(a, b), [], None
        for row, at, data in sorted(zip(*(t.column(c).to_pylist() for c in ("row", "at", "data")), strict=True), key=lambda r: r[1]):
            y = _unseal(data)
            if x is None:
                x, first = y, at
            else:
                x, text = compose(x, y, aligner)
                if text:
                    rows.append((row, at - 1, 1, 1, text.encode()))  # after the last range of the left side
        rows.append((row, first, 0, 0, _seal(x)))
        return pa.Table.from_batches([_rows(rows)])

    while step <= top:
        step *= fan
        grouped = level.where("kind = 0").groupBy("row", F.floor(F.col("at") / step).alias("group"))
        level = materialise(grouped.applyInArrow(climb, PARTS), "align-level")
        texts = texts.unionByName(level.where("kind = 1"))
    return whole, level.where("kind = 0"), texts


def _long(docs: DataFrame, a: str, b: str, span: int, fan: int) -> DataFrame:
    """CHUNKS, one for each document of many ranges."""
    whole, composed, texts = fragments(docs, a, b, span, fan)

    def finish(batches):
        aligner = Aligner(a, b)
        for s in slices(batches, "data", 1):
            rows = []
            for row, data in zip(s.column("row").to_pylist(), s.column("data").to_pylist(), strict=True):
                closed, first, last = shut_ends(_unseal(data), aligner)
                rows += [(row, -1, 0, 0, _seal(closed)), (row, -1, 0, 1, first.encode()), (row, 1 << 60, 0, 1, last.encode())]
            yield _rows(rows)
        del aligner
        give_back()

    ends = materialise(composed.mapInArrow(finish, PARTS), "align-ends")

    def hashed(batches):
        """sha256 of each row's texts in order, without the last ';'."""
        row = now = held = None
        for batch in batches:
            for r, data in zip(batch.column("row").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if r != row:
                    if now:
                        now.update(held[:-1])
                        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([now.hexdigest()])], names=["row", "sha"])
                    row, now, held = r, hashlib.sha256(), b""
                if data:
                    now.update(held)
                    held = data
        if now:
            now.update(held[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([now.hexdigest()])], names=["row", "sha"])

    ordered = texts.unionByName(ends.where("kind = 1")).select("row", "at", "sub", "data").repartition("row").sortWithinPartitions("row", "at", "sub")
    shas = ordered.mapInArrow(hashed, "row bigint, sha string")
    told = ends.where("kind = 0").select("row", "data").join(shas, "row").join(whole, "row").select("doc_id", "size", "data", "sha")

    def chunks(batches):
        for s in slices(batches, "data", 1):
            closed, n = _unseal(s.column("data")[0].as_py()), np.zeros((1, 4), np.int64)
            keys, times, sha = np.zeros(0, np.int64), np.zeros(0, np.int64), ""
            if closed.valid:
                n[0], keys, times, sha = (closed.n_a, closed.n_b, closed.n_groups, closed.n_links), closed.keys, closed.times, s.column("sha")[0].as_py()
            yield _chunk(s.column("doc_id"), s.column("size")[0].as_py(), n, [sha], np.zeros(len(keys), np.int64), keys, times)

    return told.mapInArrow(chunks, CHUNKS)


def most_of(keys: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """2 * total, and 1 more where it is the highest of the A id; keys of whole A ids, sorted."""
    a = keys >> np.uint64(B_BITS)
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    most = np.maximum.reduceat(totals, first) if len(keys) else totals
    return totals * np.uint64(2) + (totals == np.repeat(most, np.diff(np.append(first, len(keys))))).astype(np.uint64)


def aligned(docs: DataFrame, a: str | None = None, b: str | None = None, span: int = SPAN, fan: int = FAN, size: int = CHUNK, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum for each row."""
    a, b = a or byte_bpe(), b or piece_bpe()
    long = F.coalesce(F.octet_length("text") > span, F.lit(False))
    chunks = materialise(_short(docs.where(~long), a, b, size).unionByName(_long(docs.where(long), a, b, span, fan)), "align-chunks")
    ranges = min(1 << A_BITS, ranges_for(chunks))  # a range never parts an A id

    def send(batches):
        for s in slices(batches, "keys"):
            rows = []
            for chunk, keys, counts in zip(*(s.column(c).to_pylist() for c in ("chunk", "keys", "counts")), strict=True):
                keys, counts = unpack_ints(keys, True), unpack_ints(counts)
                rows += [(chunk, p, pack_ints(keys[x:y], True), pack_ints(counts[x:y])) for p, x, y in segments(keys, ranges, A_BITS + B_BITS)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["chunk", "part", "keys", "counts"])

    sent = chunks.select("chunk", "keys", "counts").mapInArrow(send, "chunk string, part bigint, keys binary, counts binary")
    totals = corpus_totals(sent, salts_for(chunks, blocks), "pair-totals", keyed=most_of)
    schema = T.StructType([docs.schema["doc_id"]] + [T.StructField(n, t) for n, t in DOC + [("n_best", T.LongType()), ("count_sum", T.LongType())]])

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        docs, place, times = unseal(left.column("docs")[0].as_py()), unpack_ints(left.column("places")[0].as_py(), True), unpack_ints(left.column("times")[0].as_py()).astype(np.int64)
        data = [unpack_ints(d) for _, d in sorted(zip(right.column("part").to_pylist(), right.column("data").to_pylist(), strict=True))]
        value = np.concatenate(data).astype(np.int64) if data else np.zeros(0, np.int64)
        doc, place = np.divmod(place.astype(np.int64), max(1, len(value)))
        best, total = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
        np.add.at(best, doc, times * (value[place] & 1))
        np.add.at(total, doc, times * (value[place] >> 1))
        return pa.table([*docs.columns, pa.array(best), pa.array(total)], names=schema.names)

    answers = totals.where("chunk is not null").select("chunk", "part", "data")
    return chunks.select("chunk", "docs", "places", "times").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(tell, schema)


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    return aligned(documents(spark, sf_dir))
