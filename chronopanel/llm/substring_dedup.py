"""Substring dedup: winnowed anchors as seeds, extended to maximal repeats.

A window is ``window`` consecutive words.  Its anchor is its first gram of
``gram`` words with the least hash, so equal windows have equal anchors at
equal places.  Consecutive windows of a document with one anchor make a block:
the anchor extended both ways as far as it stays the anchor.  Documents meet on
anchors that occur more than once.

Blocks of equal content repeat as a whole: all but the first occurrence are
removed, and no later step looks at them, so a passage that many documents
share costs one row for each of them and no pairs.  Where an anchor has blocks
of different content (at the ends of a passage), the first occurrences of these
are compared window by window; a window that starts earlier elsewhere is
removed.  Every window's first place is in the first occurrence of a block, so
this is exact.  Removed windows that touch make up the maximal repeats, which
are at least ``window`` words long.

Words are compared by 64-bit hashes, windows by 128 bits.

Defined cases: a null or empty text has no words.  Places are ordered by id,
then word; a null id comes first.  Rows that share an id share their places: an
equal window at an equal start is not a repeat.  Other columns are passed on,
except input columns named ``n_words``, ``n_removed`` or ``repeats``, which are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, materialise, utf8

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, gram: int) -> np.ndarray:
    n = len(h) - gram + 1
    out = h[:n].copy()
    for k in range(1, gram):
        out = (out ^ (out >> np.uint64(31))) * _M1 + h[k : k + n]
    return (out ^ (out >> np.uint64(29))) * _M2


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hashes of h[start:end], from running sums of a polynomial in ``base``."""
    n = len(h)
    power = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, base, np.uint64), out=power[1:])
    inverse = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64), out=inverse[1:])
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * power[:-1], out=sums[1:])
    out = (sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _M3
    return (out ^ (out >> np.uint64(32))) * _M2


def blocks(text: bytes | None, window: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """Anchor hash, content hash, first window and number of windows of each block."""
    words = (text or b"").split()
    if len(words) < window:
        return None
    h = word_hashes(words)
    grams = gram_hashes(h, gram)
    each = window - gram + 1
    at = np.lib.stride_tricks.sliding_window_view(grams, each).argmin(axis=1) + np.arange(len(grams) - each + 1)
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    counts = np.diff(starts, append=len(at))
    return grams[at[starts]].view(np.int64), span_hashes(h, starts, starts + counts + window - 1, _M1).view(np.int64), starts.astype(np.int32), counts.astype(np.int32)


def _emit(window: int, gram: int, anchors_only: bool):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = ["anchor", "content", "id", "start", "n"]

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            out: list[tuple] = []
            texts = utf8(b.column("text"))
            for ident, text in zip([None] * len(texts) if anchors_only else b.column("id").to_pylist(), texts, strict=True):
                own = blocks(text, window, gram)
                if own:
                    out.append((own[0], own[1], [ident] * (0 if anchors_only else len(own[0])), own[2], own[3]))
            if out:
                cols = list(zip(*out, strict=True))
                if anchors_only:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cols[0]))], names=["anchor"])
                else:
                    ids = [i for part in cols[2] for i in part]
                    full = [np.concatenate(cols[0]), np.concatenate(cols[1]), ids, np.concatenate(cols[3]), np.concatenate(cols[4])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(full, kinds, strict=True)], names=names)

    return emit


def _window_rows(window: int):
    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            one, two, ids, at = [], [], [], []
            for ident, text, spans in zip(b.column("id").to_pylist(), utf8(b.column("text")), b.column("spans").to_pylist(), strict=True):
                h = word_hashes((text or b"").split())
                starts = np.unique(np.concatenate([np.arange(s["start"], s["start"] + s["n"]) for s in spans]))
                starts = starts[starts + window <= len(h)]  # rows that share an id may differ in length
                one.append(span_hashes(h, starts, starts + window, _M1))
                two.append(span_hashes((h ^ (h >> np.uint64(27))) * _M3, starts, starts + window, _M2))
                ids += [ident] * len(starts)
                at.append(starts)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(one).view(np.int64)), pa.array(np.concatenate(two).view(np.int64)), pa.array(ids, pa.int64()), pa.array(np.concatenate(at), pa.int32())], names=["w1", "w2", "id", "start"])

    return emit


def repeated_windows(docs: DataFrame, window: int = 20, gram: int = 6) -> DataFrame:
    """(id, start, n): runs of n windows from word ``start`` that also start earlier; docs: (id, text)."""
    anchors = docs.select("text").mapInArrow(_emit(window, gram, True), "anchor long")
    shared = materialise(anchors.groupBy("anchor").count().where(F.col("count") > 1).select("anchor"), "shared", few_files=True)
    every = docs.mapInArrow(_emit(window, gram, False), "anchor long, content long, id long, start int, n int")
    met = materialise(every.join(shared, "anchor"), "blocks")

    place = F.struct("id", "start")
    first = materialise(met.groupBy("anchor", "content").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("k"), F.first("n").alias("n")), "first_blocks")
    later = met.join(first.where("k > 1").select("anchor", "content", "first"), ["anchor", "content"]).where(~place.eqNullSafe(F.col("first"))).select("id", "start", "n")

    varied = materialise(first.groupBy("anchor").count().where(F.col("count") > 1).select("anchor"), "varied", few_files=True)
    ends = first.join(varied, "anchor").select(F.col("first.id").alias("own"), F.struct(F.col("first.start").alias("start"), "n").alias("span"))
    ends = materialise(ends.groupBy("own").agg(F.collect_list("span").alias("spans")), "ends", few_files=True)
    single = materialise(docs.join(ends, F.col("id").eqNullSafe(F.col("own"))).select("id", "text", "spans").mapInArrow(_window_rows(window), "w1 long, w2 long, id long, start int"), "windows")
    earliest = materialise(single.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "earliest", few_files=True)
    rest = single.join(earliest, ["w1", "w2"]).where(~place.eqNullSafe(F.col("first"))).select("id", "start", F.lit(1).alias("n"))
    return later.unionByName(rest)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, gram: int = 6) -> DataFrame:
    """``docs`` with kept words joined by one space, n_words, n_removed and the maximal repeats (start, end) in words."""
    docs = docs.drop("n_words", "n_removed", "repeats")
    names = docs.columns
    runs = repeated_windows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), window, gram)
    runs = runs.groupBy(F.col("id").alias("__id")).agg(F.collect_list(F.struct("start", "n")).alias("__runs"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("repeats", T.ArrayType(span))])

    def rewrite(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            texts, n_words, n_removed, repeats = [], [], [], []
            for text, found in zip(utf8(b.column(text_col)), b.column("__runs").to_pylist(), strict=True):
                words = (text or b"").split()
                edge = np.zeros(len(words) + 1, np.int64)
                if found:
                    start = np.array([r["start"] for r in found])
                    end = np.minimum(start + np.array([r["n"] for r in found]) + window - 1, len(words))
                    np.add.at(edge, np.minimum(start, len(words)), 1)
                    np.add.at(edge, end, -1)
                gone = np.cumsum(edge) > 0
                turns = np.flatnonzero(np.diff(gone, prepend=False))
                repeats.append([{"start": int(s), "end": int(e)} for s, e in zip(turns[::2], turns[1::2], strict=True)])
                texts.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if found else b" ".join(words))
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
            cols = [pa.array(texts, pa.binary()).cast(pa.string()) if c == text_col else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(repeats, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=[*names, "n_words", "n_removed", "repeats"])

    return docs.join(runs, F.col(id_col).eqNullSafe(F.col("__id")), "left").drop("__id").mapInArrow(rewrite, schema)
