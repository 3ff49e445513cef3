"""Shared helpers: staging tables, held frames, Arrow access.

Staging tables cut lineage; they are written below ``spark.checkpoint.dir``,
which executors share, so a lost executor loses nothing that later stages read.
Held frames let several consumers read one result without cutting lineage: they
stay on executors' disks, and what a lost executor held is computed again.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_unset_dir: list[str] = []

#: A-Z to a-z only, as the contracts ask; ``lower`` would fold other letters too.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _unset_dir:
            _unset_dir.append("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        base = _unset_dir[0]
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/chronopanel-{uuid.uuid4().hex[:12]}/{name}"


#: Bytes of rows that make up a staging file.
FILE_BYTES = 32 << 20


def materialise(df: DataFrame, name: str, few_files: bool = False, size: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    ``size``, where the caller knows about how many bytes the rows have, sets the
    number of files.  ``few_files`` is for tables that may be far smaller than
    their inputs: adaptive execution deals them into files by their bytes.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    if size is not None:
        df = df.repartition(max(1, -(-size // FILE_BYTES)))
    elif few_files:
        df = df.hint("rebalance")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a segment of a key filter, and of the largest filter that is sent to tasks (32 MB).
SEGMENT_BITS, MAX_FILTER_BITS = 1 << 23, 1 << 28


def _segment(rows: pa.Table) -> pa.Table:
    at = rows["at"].to_numpy() & (SEGMENT_BITS - 1)
    bits = np.zeros(SEGMENT_BITS // 8, np.uint8)
    np.bitwise_or.at(bits, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
    return pa.table({"seg": pa.array([rows["seg"][0].as_py()], pa.int64()), "bits": pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())})


def apart(df: DataFrame, column: str, keys: DataFrame, bits_per_key: int = 12) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose 64-bit hash ``column`` is surely none of ``keys``, and all others.

    A Bloom filter spares the first ones the shuffle of an exact join, which the
    others still need.  Where the keys would overfill the largest filter, all
    rows are others.
    """
    spark, n = df.sparkSession, keys.count()
    if n > MAX_FILTER_BITS // 4:
        return df.where("false"), df
    n_bits = min(MAX_FILTER_BITS, 1 << max(16, (n * bits_per_key).bit_length()))
    h, mask = F.col(column), F.lit(n_bits - 1)
    at = keys.select(F.explode(F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 30).bitwiseAND(mask))).alias("at")).distinct()
    parts = at.withColumn("seg", F.shiftright("at", 23)).groupBy("seg").applyInArrow(_segment, "seg long, bits binary")
    filt = np.zeros(max(n_bits, SEGMENT_BITS) // 8, np.uint8)
    for r in parts.collect():  # at most MAX_FILTER_BITS
        filt[r["seg"] * (SEGMENT_BITS // 8) :][: SEGMENT_BITS // 8] = np.frombuffer(zlib.decompress(bytes(r["bits"])), np.uint8)
    shared = spark.sparkContext.broadcast(zlib.compress(filt[: n_bits // 8].tobytes(), 1))

    def asked(want: bool):
        def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.frombuffer(zlib.decompress(shared.value), np.uint8)
            for b in batches(rows):
                h = b.column(column).to_numpy().view(np.uint64)
                found = np.ones(len(h), bool)
                for at in (h & np.uint64(n_bits - 1), (h >> np.uint64(30)) & np.uint64(n_bits - 1)):
                    found &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                yield b.filter(pa.array(found == want))

        return df.mapInArrow(ask, df.schema)

    return asked(False), asked(True)


_held: list[DataFrame] = []


def hold(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it on executors' disks until ``release``."""
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()  # joins are then planned by its real size
    _held.append(df)
    return df


def release() -> None:
    """Drop all held frames, once what was derived from them has been written."""
    while _held:
        df = _held.pop()
        if df.sparkSession.sparkContext._jsc:  # its session still runs
            df.unpersist()


def utf8(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string array, nulls as None."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.view(kind).to_pylist()


#: Rows of an Arrow batch: whole texts may be long, and a batch is held at once.
BATCH_ROWS = 2048


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows in this session; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named input table, only the given columns."""
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ascii_lower(column):
    """A-Z lower-cased, everything else as it is."""
    return F.translate(column, UPPER, LOWER)


def trim() -> None:
    """Give freed memory back to the system: Spark keeps its Python workers for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input batches that hold rows."""
    yield from (b for b in rows if b.num_rows)
    trim()
