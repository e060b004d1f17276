"""Best-fit packing of tokenised documents into sequences.

Best-two-fit: a sequence starts with the largest piece left and is filled
greedily with the largest piece that fits; then its smallest piece is replaced
by two pieces left over that fit the widened gap more tightly, if there are
such.  What it picks depends only on which lengths are left, so it runs on the
histogram of piece lengths (at most ``limit`` rows whatever the corpus size):
each filling found is repeated as often as the counts allow, which is what
packing one by one would do.  Spark then gives every piece its rank among
those of equal length and looks its place up in the plan.  Ranks are counted
over salted buckets, so that a hot length is never one task's.

A sequence of one piece is not improved: its smallest piece is the one it was
started for, the largest left.

Nulls: a null text is an empty document (the end token alone); a null doc_id
keeps its pieces.  Repeated rows are packed as often as they occur.  Pieces of
one length are alike: which goes where is settled by salt, id and piece.  Texts
of any length are cut into pieces, nothing else is.  An empty table gives an
empty result.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import AT_ONCE, documents, give_back, materialise, slices

LIMIT = 4096
#: Fixed by the contract: it follows a document's own tokens.
END_ID = 1

# ---------------------------------------------------------------- tokens

#: The tokenizer's own split, for texts of the first 256 code points.  It never joins what white space parts.
_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_N = "0-9²³¹¼-¾"
_S = " \t-\r\x85\xa0"  # what both the tokenizer and Arrow take for white space
_PIECE = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
#: White space for Python and Arrow, not for the tokenizer.
_CONTROLS = "\x1c\x1d\x1e\x1f"
#: The same split for all of Unicode.
_WIDE_PIECE = regex.compile(r"'(?:s|t|re|ve|m|ll|d)|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class _Settled(dict):
    """Character -> whether its kind is beyond doubt, worked out once each.

    Not so are letters, digits and spaces that are younger than Unicode 3.2 or
    were another kind of character then, as the tokenizer's tables may be older
    or newer than ours; characters that are not assigned; and the four controls
    that Arrow takes for white space and the tokenizer doesn't.
    """

    def __missing__(self, c: str) -> bool:
        kind, old = unicodedata.category(c), unicodedata.ucd_3_2_0.category(c)
        ok = not ("\x1c" <= c <= "\x1f" or kind in ("Cn", "Co", "Cs") or (kind[0] in "LNZ" and c > "\xff" and old[0] != kind[0]))
        self[c] = ok
        return ok


_SETTLED = _Settled()


def _lower(text: str) -> str:
    """As the tokenizer normalises: composed, each character lower-cased by itself (a final sigma is like any other)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Merges:
    """Byte pairs merged by rank, for many words at a time, as the tokenizer does it for one."""

    def __init__(self, path: str):
        with open(path) as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*shown}))}
        self.first = np.array([vocab[names[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[names[b] + model["end_of_word_suffix"]] for b in range(256)], np.int32)
        self.base = np.int64(max(vocab.values()) + 1)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.none = len(pairs)
        keys = np.array([vocab[a] * int(self.base) + vocab[b] for a, b in pairs], np.int64)
        self.slots = np.full(1 << self.BITS, -1, np.int64)  # open addressing: the next free slot from a key's own on
        self.rank = np.full(1 << self.BITS, self.none, np.int32)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.slots[slot] >= 0:
                slot = (slot + 1) % (1 << self.BITS)
            self.slots[slot], self.rank[slot] = key, rank

    BITS = 18

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).view(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.base + b
        slot = self._slot(key)
        there = self.slots[slot]
        out = np.where(there == key, self.rank[slot], np.int32(self.none))
        go = np.flatnonzero((there != key) & (there >= 0))
        while len(go):
            slot[go] = (slot[go] + 1) % (1 << self.BITS)
            there = self.slots[slot[go]]
            hit = there == key[go]
            out[go[hit]] = self.rank[slot[go[hit]]]
            go = go[~hit & (there >= 0)]
        return out

    def ids(self, words: list[str], at_once: int = 4000) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each non-empty word; some thousand at a time fit a core's cache."""
        return [x for i in range(0, len(words), at_once) for x in self._ids(words[i : i + at_once])]

    def _ids(self, words: list[str]) -> list[bytes]:
        """Rounds of merges over the symbols of all words, laid end to end.

        A merge's result has a higher rank than the merge itself, so all
        places of a word's lowest pair merge in one round.
        """
        raw = [w.encode() for w in words]
        size = np.array(list(map(len, raw)), np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.first[flat]
        ends = np.cumsum(size)
        sym[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(raw), dtype=np.int32), size)
        rank = np.empty(len(sym), np.int32)
        rank[:-1] = self._ranks(sym[:-1], sym[1:])
        rank[ends - 1] = self.none
        done_word, done_sym = [], []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, len(word)))
            if (over := low == self.none).any():
                go = np.repeat(~over, length)
                done_word.append(word[~go])
                done_sym.append(sym[~go])
                sym, word, rank = sym[go], word[go], rank[go]
                low, length = low[~over], length[~over]
            hit = np.flatnonzero(rank == np.repeat(low, length))
            if not len(hit):
                break
            if len(close := np.flatnonzero(np.diff(hit) == 1)):  # of adjoining places, every second one, from the left
                run = np.ones(len(hit), bool)
                run[close + 1] = False
                began = hit[np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))]
                hit = hit[(hit - began) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            rank[hit] = rank[hit + 1]  # a last symbol has no pair to its right
            new = hit - np.arange(len(hit))
            sym, word, rank = sym[stay], word[stay], rank[stay]
            near = np.zeros(len(sym), bool)
            near[new] = True
            near[new[new > 0] - 1] = True
            two = np.flatnonzero(near[:-1] & (word[:-1] == word[1:]))
            rank[two] = self._ranks(sym[two], sym[two + 1])
        if not done_sym:
            return []
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(word, kind="stable")
        out = sym[order].astype("<u4").tobytes()
        cuts = (4 * np.searchsorted(word[order], np.arange(len(raw) + 1))).tolist()
        return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _strings(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()  # many times faster than to_pylist


class Known:
    """Ids of strings, those of recent strings kept as Arrow arrays (a cache only: results never depend on it).

    When it is full, by number or bytes, what was asked for last lives on alone, if that fits.
    """

    def __init__(self, find: Callable[[pa.Array], pa.Array], keep: int, most: int = 16 << 20):
        self.find, self.keep, self.most = find, keep, most
        self._clear()

    def _clear(self) -> None:
        self.keys, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _full(self) -> bool:
        return len(self.keys) > self.keep or self.keys.nbytes + self.ids.nbytes > self.most

    def __call__(self, keys: pa.Array) -> pa.Array:
        """Ids of each of the keys, which are distinct."""
        at = pc.index_in(keys, value_set=self.keys)
        new = at.is_null()
        place = np.where(new, len(self.keys) - 1 + np.cumsum(new), at.fill_null(0))
        fresh = keys.filter(new)
        self.keys, self.ids = pa.concat_arrays([self.keys, fresh]), pa.concat_arrays([self.ids, self.find(fresh)])
        out = self.ids.take(pa.array(place))
        if self._full():
            self.keys, self.ids = pa.concat_arrays([keys]), out
            if self._full():
                self._clear()
        return out

    def joined(self, parts: pa.ListArray) -> pa.Array:
        """The ids of each list of strings, end to end."""
        coded = parts.values.dictionary_encode()
        ids = self(coded.dictionary).take(coded.indices)
        return pc.binary_join(pa.ListArray.from_arrays(parts.offsets, ids), pa.scalar(b"", ids.type))


class Tokens:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    Words repeat, so Arrow splits texts and numbers their words; the ids of
    recent words, and of the pieces that words with other characters than
    letters consist of, are kept.  Only words that are not become Python
    objects.  An entry takes some 40 bytes, and each of the two caches 16 MB at
    most.  Texts in any script are split here; those with what may be a special
    token, or with characters whose kind depends on the version of Unicode, go
    to the tokenizer as they are.
    """

    def __init__(self, path: str, keep: int = 400_000):
        self.path, merges = path, Merges(path)
        self.pieces = Known(lambda pieces: pa.array(merges.ids(_strings(pieces)), pa.large_binary()), keep)
        self.words = Known(lambda words: self.pieces.joined(pa.array(map(self._cut, _strings(words)), pa.list_(pa.large_string()))), keep)

    @cached_property
    def model(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ids(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _words(text: str) -> str | None:
        """The text's words as they are to be looked up, between white space; None if the tokenizer has to take it."""
        if "<|" in text:  # it may be a special token
            return None
        if text.isascii():
            return None if any(c in text for c in _CONTROLS) else text.lower()
        return _lower(text) if all(map(_SETTLED.__getitem__, set(text))) else None

    @staticmethod
    def _cut(word: str) -> list[str]:
        return [word] if word.isalpha() else (_PIECE if word.isascii() else _WIDE_PIECE).findall(word)

    def encode(self, texts: list[str]) -> list[bytes]:
        lowered = [self._words(t) for t in texts]
        plain = pa.array([t for t in lowered if t is not None], pa.large_string())
        joined = iter(self.words.joined(pc.utf8_split_whitespace(plain)).to_pylist())
        return [self._ids(t) if s is None else next(joined) for t, s in zip(texts, lowered, strict=True)]


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


PIECES = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, at_once: int = 2 * AT_ONCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece; only documents longer than limit are cut."""
    schema = T.StructType([docs.schema["doc_id"]] + [T.StructField(n, t) for n, t in PIECES])
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = Tokens(tokenizer)
        for b in slices(batches, most=at_once):
            where, rows = [], []
            for i, ids in enumerate(tokens.encode([t or "" for t in b.column("text").to_pylist()])):
                ids += end
                for k, start in enumerate(range(0, len(ids) // 4, limit)):
                    part = ids[4 * start : 4 * (start + limit)]
                    where.append(i)
                    rows.append((k, start, len(part) // 4, zlib.crc32(part)))
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(where, pa.int64())), *cols], names=schema.names)
        del tokens
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


# ---------------------------------------------------------------- plan


def _largest_below(left: np.ndarray) -> np.ndarray:
    """For each x the largest length up to x of which there is some left (0: none)."""
    return np.maximum.accumulate(np.where(left > 0, np.arange(len(left)), 0))


def best_two_fit(counts: np.ndarray, limit: int) -> list[tuple[int, list[int]]]:
    """counts[length] pieces -> (times, lengths in order of placing) fillings that use every piece once."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out = []
    if left[limit]:
        out.append((int(left[limit]), [limit]))
        left[limit] = 0
    while left.any():
        taken: dict[int, int] = {}

        def take(x, n, taken=taken):
            left[x] -= n
            taken[x] = taken.get(x, 0) + n
            if not taken[x]:
                del taken[x]

        gap = limit
        below = _largest_below(left)
        while gap and (x := int(below[gap])):
            n = min(int(left[x]), gap // x)
            take(x, n)
            gap -= n * x
            if not left[x]:
                below = _largest_below(left)
        small = min(taken)
        if gap and sum(taken.values()) > 1:
            room = gap + small
            below = _largest_below(left)
            a = np.flatnonzero(left[: room + 1])  # the first of the two, the second not above it
            if len(a):
                b = below[np.minimum(room - a, a)]
                b = np.where((b == a) & (left[a] < 2), np.where(a > 0, below[a - 1], 0), b)
                total = np.where(b > 0, a + b, 0)
                best = int(total.argmax())
                if total[best] > small:
                    take(small, -1)
                    take(int(a[best]), 1)
                    take(int(b[best]), 1)
        times = 1 + min(int(left[x]) // n for x, n in taken.items())
        for x, n in taken.items():
            left[x] -= n * (times - 1)
        out.append((times, [x for x in sorted(taken, reverse=True) for _ in range(taken[x])]))
    return out


def placing(plan: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """The plan by length, for look-up by (length, rank): runs of ranks, how many of a length a sequence takes, from which offset."""
    rows, first, used = [], 0, {}
    for times, lengths in plan:
        at = 0
        i = 0
        while i < len(lengths):
            x, n = lengths[i], lengths.count(lengths[i])
            rank = used.get(x, 0)
            rows.append((x, rank, n, first, at))
            used[x] = rank + n * times
            at += n * x
            i += n
        first += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "n", "sequence", "offset"), cols, strict=True))


def pack(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    """cut: pieces with ``length`` -> the same columns with sequence_id and offset.

    The salt is stored with each piece, as it depends on the piece's partition, too: rows that repeat an id and a text
    have as many salts as partitions hold them, so a mass of equal rows is ranked in as many tasks.
    """
    spark = cut.sparkSession
    salts = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = materialise(cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id()), F.lit(salts))), "pieces")
    sizes = materialise(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "piece-sizes")
    counts = np.zeros(limit + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most limit rows
        counts[r["length"]] = r["n"]
    look = placing(best_two_fit(counts, limit))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["length", "salt"])
    ranked = ranked.select(*cut.columns, (F.col("rank") + F.col("base")).alias("rank"))
    schema = T.StructType([*cut.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    key, names = look["length"] << 44 | look["rank"], cut.columns

    def place(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = np.searchsorted(key, length << 44 | rank, side="right") - 1
            nth = rank - look["rank"][run]
            n = look["n"][run]
            seq, off = look["sequence"][run] + nth // n, look["offset"][run] + nth % n * length
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(seq), pa.array(off)], names=schema.names)

    return ranked.mapInArrow(place, schema)


def packed_documents(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of the documents."""
    return pack(pieces(docs, tokenizer or word_tokenizer(), limit), limit)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))
