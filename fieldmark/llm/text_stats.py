"""Per-document statistics of whole texts, for the quality rules and the quality classifier."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa

from .common import slices

#: Fixed by the contract of the quality rules.
SYMBOLS = "#*$%&|<>"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WINDOW = 8

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_ascii_letters", "n_digits", "n_bang", "n_stops", "n_high", "longest_word"]


def repeat_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur twice or more in the text, the first occurrence included."""
    if len(words) <= WINDOW:
        return 0
    grams = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    covered, end = 0, 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered += i + WINDOW - max(i, end)
            end = i + WINDOW
    return covered


def stats(text: str | None) -> tuple[int, ...]:
    """FIELDS of one text; a null text counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    gone = lambda drop: len(raw) - len(raw.translate(None, drop))
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeat_words(words),
        lines, len(set(words)), gone(_UPPER), gone(_LETTERS), gone(_DIGITS), text.count("!"),
        text.count(".") + text.count(","), len(raw) - len(text), max(map(len, words), default=0),
    )


def stats_batch(batch: pa.RecordBatch) -> list[pa.Array]:
    """FIELDS as int64 columns for the column ``text`` of a batch."""
    rows = [stats(t) for t in batch.column("text").to_pylist()]
    return [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(FIELDS))]


def with_stats(docs, keep: list[str]):
    """Columns ``keep`` of docs and the FIELDS of its text; one narrow pass, nothing else is read."""
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(f, T.LongType()) for f in FIELDS])

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + stats_batch(b), names=[*keep, *FIELDS])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
