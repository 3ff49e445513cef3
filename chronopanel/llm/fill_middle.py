"""Fill-in-middle documents by rotating blocks of a buffer in place.

A text's UTF-8 bytes go into one bytearray.  Its two cuts are found by a scan in
slices, sentinels are inserted at them, and the segments change places by
rotations of three reversals each, which need no second buffer.  The way back
finds the sentinels, rotates the other way and deletes them.

Units are runs of white space with the word after them, or white space at the
end.  Cuts, and whether and how a document changes, come from a hash of a seed
and its id alone, so any executor that repeats a task gives the same rows.

Defined cases: a null text is an empty one; an empty text, and one that holds a
sentinel already, stay plain.  A null id hashes like an empty one.  Rows that
repeat an id are cut by the same hash, each in its own text.  Columns other than
the id and the text are left out, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, utf8

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes that a scan or a swap looks at together.
SLICE = 1 << 20


def _ends(text: np.ndarray, at: int) -> np.ndarray:
    """Places after the words that end in the slice from ``at``; a word at the end of the text ends there."""
    space = _SPACE[text[at : at + SLICE + 1]]
    n = min(SLICE, len(text) - at)
    after = space[1 : n + 1] if len(space) > n else np.append(space[1:], True)
    return np.flatnonzero(~space[:n] & after) + at + 1


def count_units(text: np.ndarray) -> int:
    n = sum(len(_ends(text, at)) for at in range(0, len(text), SLICE))
    return n + int(len(text) > 0 and _SPACE[text[-1]])


def unit_end(text: np.ndarray, units: int) -> int:
    """Place after so many units."""
    if not units:
        return 0
    for at in range(0, len(text), SLICE):
        ends = _ends(text, at)
        if units <= len(ends):
            return int(ends[units - 1])
        units -= len(ends)
    return len(text)  # white space at the end


def reverse(buffer: np.ndarray, low: int, high: int) -> None:
    """Turn [low, high) round in place, a slice from either side at a time."""
    while high - low > 1:
        k = min(SLICE, (high - low) // 2)
        left = buffer[low : low + k][::-1].copy()
        buffer[low : low + k] = buffer[high - k : high][::-1]
        buffer[high - k : high] = left
        low, high = low + k, high - k


def rotate(buffer: bytearray, low: int, middle: int, high: int) -> None:
    """Let [low, middle) and [middle, high) change places: each is reversed, then both together."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view, low, middle)
    reverse(view, middle, high)
    reverse(view, low, high)


def characters(text: np.ndarray, low: int, high: int) -> int:
    """Code points of a range of UTF-8."""
    return sum(int(np.count_nonzero((text[at : min(high, at + SLICE)] & 0xC0) != 0x80)) for at in range(low, high, SLICE))


def arrange(text: bytes, first: int, second: int, suffix_first: bool) -> bytearray:
    """The text with sentinels before its prefix, middle and suffix, and the suffix moved before the middle or before all."""
    buffer = bytearray(text)
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(buffer, 0 if suffix_first else middle, suffix, len(buffer))
    return buffer


def rearrange(output: bytes, form: str) -> bytearray:
    """The text that ``arrange`` was given; no text between sentinels holds one."""
    buffer = bytearray(output)
    if form == "plain":
        return buffer
    low = buffer.index(PREFIX if form == "spm" else MIDDLE)
    start = 0 if form == "spm" else buffer.index(SUFFIX)
    rotate(buffer, start, low, len(buffer))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(mark)
        del buffer[at : at + len(mark)]
    return buffer


def _draws(seed: int, ident: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """Per document: id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            out: list[tuple] = []
            for ident, text in zip(b.column("id").to_pylist(), utf8(b.column("text")), strict=True):
                text = text or b""
                view = np.frombuffer(text, np.uint8)
                n, draws = count_units(view), _draws(seed, ident)
                if not text or draws[2] % 100 >= fim_percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
                    out.append((ident, n, "plain", None, None, text))
                    continue
                first, second = (unit_end(view, k) for k in sorted(h % (n + 1) for h in draws[:2]))
                spm = draws[3] % 100 < spm_percent
                output = bytes(arrange(text, first, second, spm))
                out.append((ident, n, "spm" if spm else "psm", characters(view, 0, first), characters(view, first, second), output))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            cols[-1] = cols[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = picked.mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


def restore(df: DataFrame, output_col: str = "output", form_col: str = "form", text_col: str = "restored") -> DataFrame:
    """``df`` and the exact text behind each output."""
    names = [*df.columns, text_col]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            forms = b.column(form_col).to_pylist()
            texts = [bytes(rearrange(o, f)) for o, f in zip(utf8(b.column(output_col)), forms, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=names)

    return df.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in df.dtypes) + f", `{text_col}` string")
