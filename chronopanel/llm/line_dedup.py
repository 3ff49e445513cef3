"""Line dedup behind two Bloom filters.

One scan builds two Bloom filters over line keys: ``once`` (seen in a document)
and ``twice`` (seen in two).  Tasks build partial filters, which merge in a
tree: an element of two parts has all its bits in both, so ``twice`` takes the
AND of the ``once`` parts.  There are no false negatives.  Only keys that the
``twice`` filter suspects are shuffled, as 128-bit hashes, for exact counts and
the choice of the document that keeps the line.

The filters are sized from the number of lines, ``bits_per_line`` each, and no
broadcast is over ``max_filter_bits``.  Where one filter would be larger, keys
are dealt by hash over up to ``max_passes`` filters that are built and asked one
after another, each in a scan of its own.  Past that more keys are suspected and
the exact pass has more to do; results stay the same.

Defined cases: a null or empty text is one empty line, which is under
``min_chars`` and stays.  Each row is a document; rows that repeat a doc_id
count once each, and all keep a line whose keeper is that doc_id.  A null
doc_id counts as a document but is never a keeper.  Other columns are passed
on, except input columns named ``n_lines`` or ``n_dropped``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, hold, materialise, utf8

SEGMENT = 1 << 20  # bytes of filter per row of a partial filter
FAN_IN = 32


def line_keys(text: bytes | None, min_chars: int) -> set[bytes]:
    """Distinct keys of at least ``min_chars`` code points."""
    out = set()
    for line in (text or b"").lower().split(b"\n"):
        key = line.strip()
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
            out.add(key)
    return out


def _bits(hashes: np.ndarray, n_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two (byte index, bit mask) pairs for each hash; n_bits is a power of two."""
    out = []
    for h in (hashes, (hashes >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) + hashes):
        at = (h >> np.uint64(3)) & np.uint64(n_bits - 1)
        out.append(((at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8))))
    return out


def _has(filt: np.ndarray, bits) -> np.ndarray:
    return np.logical_and.reduce([(filt[i] & m) != 0 for i, m in bits])


def _set(filt: np.ndarray, bits) -> None:
    for i, m in bits:
        np.bitwise_or.at(filt, i, m)


def _of_shard(hashes: np.ndarray, shard: int, shards: int) -> np.ndarray:
    return hashes % np.uint64(shards) == np.uint64(shard)


def _build(text_col: str, min_chars: int, n_bits: int, shard: int, shards: int):
    def build(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        once, twice = np.zeros(n_bits // 8, np.uint8), np.zeros(n_bits // 8, np.uint8)
        digest = xxhash.xxh3_64_intdigest
        for b in batches(rows):
            own: list[int] = []
            for text in utf8(b.column(text_col)):
                own += map(digest, line_keys(text, min_chars))
            hashes, counts = np.unique(np.array(own, np.uint64), return_counts=True)
            if shards > 1:
                mine = _of_shard(hashes, shard, shards)
                hashes, counts = hashes[mine], counts[mine]
            bits = _bits(hashes, n_bits)
            again = (counts > 1) | _has(once, bits)
            _set(twice, [(i[again], m[again]) for i, m in bits])
            _set(once, bits)
        part, zip_ = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1).compress
        for k in range(0, len(once), SEGMENT):
            if once[k : k + SEGMENT].any():
                yield _row(part, k // SEGMENT, zip_(once[k : k + SEGMENT].tobytes()), zip_(twice[k : k + SEGMENT].tobytes()))

    return build


_FILTER = "part int, seg int, once binary, twice binary"


def _row(part: int, seg: int, once: bytes, twice: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([once], pa.binary()), pa.array([twice], pa.binary())], names=["part", "seg", "once", "twice"])


def _merge(rows: pa.Table) -> pa.Table:
    """One partial filter of up to FAN_IN."""
    unzip = zstandard.ZstdDecompressor().decompress
    once = twice = None
    for a, b in zip(rows["once"], rows["twice"], strict=True):
        a, b = (np.frombuffer(unzip(x.as_py()), np.uint8) for x in (a, b))
        once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
    zip_ = zstandard.ZstdCompressor(level=1).compress
    return pa.Table.from_batches([_row(rows["part"][0].as_py() // FAN_IN, rows["seg"][0].as_py(), zip_(once.tobytes()), zip_(twice.tobytes()))])


def filter_sizes(docs: DataFrame, text_col: str, bits_per_line: int, max_filter_bits: int, max_passes: int) -> tuple[int, int]:
    """Bits of a filter, a power of two, and how many filters the keys are dealt over."""
    lines = docs.select(F.sum(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    shards = max(1, min(max_passes, -(-lines * bits_per_line // max_filter_bits)))
    return min(max_filter_bits, 1 << max(20, int(-(-lines * bits_per_line // shards) - 1).bit_length())), shards


def twice_filter(docs: DataFrame, text_col: str, min_chars: int, n_bits: int, shard: int = 0, shards: int = 1) -> np.ndarray:
    """The ``twice`` filter over the shard's line keys of all documents."""
    texts = docs.select(text_col)
    parts, n = texts.mapInArrow(_build(text_col, min_chars, n_bits, shard, shards), _FILTER), texts.rdd.getNumPartitions()
    while n > 1:  # the job may be planned with more tasks than n; what is then left merges below
        parts, n = parts.groupBy("seg", (F.col("part") / FAN_IN).cast("int").alias("up")).applyInArrow(_merge, _FILTER), -(-n // FAN_IN)
    once, twice = np.zeros(n_bits // 8, np.uint8), np.zeros(n_bits // 8, np.uint8)
    unzip = zstandard.ZstdDecompressor().decompress
    for r in parts.select("seg", "once", "twice").toLocalIterator():
        at = slice(r["seg"] * SEGMENT, (r["seg"] + 1) * SEGMENT)
        a, b = (np.frombuffer(unzip(bytes(r[k])), np.uint8) for k in ("once", "twice"))
        twice[at] |= b | (once[at] & a)
        once[at] |= a
    return twice


def _suspects(docs: DataFrame, min_chars: int, n_bits: int, shard: int, shards: int) -> DataFrame:
    """(h1, h2, id) of the shard's keys that its ``twice`` filter suspects; docs: (id, text)."""
    filt = twice_filter(docs, "text", min_chars, n_bits, shard, shards)
    shared = docs.sparkSession.sparkContext.broadcast(zstandard.ZstdCompressor(level=1).compress(filt.tobytes()))

    def suspect(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(zstandard.ZstdDecompressor().decompress(shared.value), np.uint8)
        for b in batches(rows):
            ids, keys = [], []
            for doc, text in zip(b.column("id").to_pylist(), utf8(b.column("text")), strict=True):
                new = line_keys(text, min_chars)
                keys += new
                ids += [doc] * len(new)
            if keys:
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
                keep = _has(twice, _bits(hashes, n_bits))
                if shards > 1:
                    keep &= _of_shard(hashes, shard, shards)
                at = np.flatnonzero(keep)
                full = np.frombuffer(b"".join(xxhash.xxh3_128_digest(keys[i]) for i in at), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(full[:, 0].copy()), pa.array(full[:, 1].copy()), pa.array([ids[i] for i in at], pa.int64())], names=["h1", "h2", "id"])

    return docs.mapInArrow(suspect, "h1 long, h2 long, id long")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, bits_per_line: int = 8, max_filter_bits: int = 1 << 31, max_passes: int = 8) -> DataFrame:
    """Drop lines found in at least ``min_docs`` documents, but in the largest id that holds them.

    Returns ``docs`` with its text replaced, and ``n_lines`` and ``n_dropped``.
    """
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    n_bits, shards = filter_sizes(docs, text_col, bits_per_line, max_filter_bits, max_passes)
    kept = [hold(_suspects(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), min_chars, n_bits, k, shards)) for k in range(shards)]
    seen = reduce(DataFrame.unionByName, kept)
    known = materialise(seen.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).drop("n"), "repeats", few_files=True)
    drops = seen.join(known, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("id").agg(F.collect_set("h1").alias("__drop"))

    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def rewrite(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(utf8(b.column(text_col)), b.column("__drop").to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                kept = lines
                if drop:
                    gone, kept = set(drop), []
                    for line in lines:
                        key = line.strip().lower()
                        if not (len(key) >= min_chars and int.from_bytes(xxhash.xxh3_128_digest(key)[:8], "little", signed=True) in gone and len(key.decode("utf-8", "replace")) >= min_chars):
                            kept.append(line)
                texts.append(b"\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            cols = [pa.array(texts, pa.binary()).cast(pa.string()) if c == text_col else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    drops = drops.withColumnRenamed("id", "__id")
    return docs.join(drops, F.col(id_col).eqNullSafe(F.col("__id")), "left").drop("__id").mapInArrow(rewrite, schema)
