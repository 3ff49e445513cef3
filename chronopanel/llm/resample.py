"""Importance resampling towards a target, drawn by a distributed radix sort.

Words and pairs of words are features, hashed into buckets.  One scan counts the
buckets of all documents and of the target; the log ratio of a bucket's shares
is its gain.  A second scan scores each document by an array of gains: the mean
gain of its features plus Gumbel noise from a hash of its id, so that the
highest scores are a weighted draw without replacement.

Ranks come from a least-significant-digit radix sort over (score descending, id).
A pass counts the rows of each (block, digit), turns the counts into global
offsets, and gives each row the place offset + its place within its block and
digit; blocks are runs of the places of the pass before, so passes are stable.
A digit that a third of all rows share is still spread over all blocks, and no
task sorts more than a block.  Only a digit's total goes to the driver.

Defined cases: a null or empty text has no features and weight 0.  Rows are
scored and drawn one by one; rows that repeat an id and a score share their
places in any order.  A null id hashes like an empty one and comes after others
in ties.  Without documents of ``least_words`` nothing is drawn.  Columns other
than the id and the text are left out, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, batches, materialise, utf8

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: Bytes of a text that are looked at together.
SLICE = 1 << 20


def word_slices(text: bytes) -> Iterator[list[bytes]]:
    """The text's words, a slice that ends between words at a time."""
    text, at = text.translate(_LOWER), 0
    while len(text) - at > SLICE:
        word = _WORD.match(text, at + SLICE)  # a word that the slice would cut
        end = word.end() if word else at + SLICE
        yield _WORD.findall(text, at, end)
        at = end
    yield _WORD.findall(text, at)


def feature_hashes(text: bytes, longest: int) -> Iterator[tuple[np.ndarray, int]]:
    """CRC-32 of all runs of 1 to ``longest`` words, and the number of words, by slices; runs may span slices."""
    before: list[bytes] = []
    for words in word_slices(text):
        joined = before + words
        starts = [zlib.crc32(w) for w in joined]
        out, fresh = [np.array(starts[len(before) :], np.uint32)], len(before)
        for n in range(1, longest):  # runs of n + 1 words, by going on from those of n
            starts = [zlib.crc32(b" " + w, h) for h, w in zip(starts, joined[n:])]
            out.append(np.array(starts[max(0, fresh - n) :], np.uint32))
        yield np.concatenate(out), len(words)
        before = joined[len(joined) - longest + 1 :] if longest > 1 and len(joined) >= longest else joined if longest > 1 else []


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, longest: int) -> np.ndarray:
    """Features of all texts in each bucket; tasks count, and at most ``buckets`` rows reach the driver."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for b in batches(rows):
            for text in utf8(b.column("text")):
                for hashes, _ in feature_hashes(text or b"", longest):
                    seen += np.bincount(hashes % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["bucket", "n"])

    counted = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Log ratio of the smoothed shares of each bucket, in floored thousandths."""
    n_source, n_target, n = int(source.sum()), int(target.sum()), len(source)
    ratio = lambda s, t: (t + 1) * (n_source + n) / ((s + 1) * (n_target + n))
    return np.array([math.floor(scale * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: int, ident: int | None, scale: int = 1000) -> int:
    """Gumbel noise from a hash of the id, in floored thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, longest: int = 2) -> DataFrame:
    """Per document: id, n_words, n_features, weight, score."""
    buckets = np.uint32(len(gain))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            out: list[tuple] = []
            for ident, text in zip(b.column("id").to_pylist(), utf8(b.column("text")), strict=True):
                n_words = n = total = 0
                for hashes, words in feature_hashes(text or b"", longest):
                    n_words, n, total = n_words + words, n + len(hashes), total + int(gain[hashes % buckets].sum())
                weight = total // n if n else 0
                out.append((ident, n_words, n, weight, weight + noise(seed, ident)))
            names = ["id", "n_words", "n_features", "weight", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "id long, n_words long, n_features long, weight long, score long").withColumnRenamed("id", id_col)


def digits(keys: list[tuple[str, int, int]], most_bits: int) -> list[tuple[str, int, int, int]]:
    """(column, low, shift, bits) of each pass, least significant first; ``keys`` are (column, least, greatest), most significant first."""
    out = []
    for column, low, high in reversed(keys):
        width = (high - low).bit_length()
        passes = -(-width // most_bits)
        each = -(-width // passes) if passes else 0
        out += [(column, low, k * each, each) for k in range(passes)]
    return out


def radix_rank(rows: DataFrame, keys: list[str], out: str = "rank", block_rows: int = 1 << 18, most_bits: int = 12) -> DataFrame:
    """``rows`` with their place, from 1, by ascending integer ``keys``.

    Passes over the keys' digits, as many as the keys' ranges need; each writes
    its rows to the shared folder.  ``most_bits`` bounds the digits whose totals
    go to the driver, ``block_rows`` the rows that a task orders at once.
    """
    ends = rows.agg(F.count(F.lit(1)).alias("n"), *[f(k).alias(f"{f.__name__}{i}") for i, k in enumerate(keys) for f in (F.min, F.max)]).first()
    n = ends["n"]
    if not n:
        return rows.withColumn(out, F.lit(0).cast("long"))
    blocks = -(-n // block_rows)
    # before the first pass any order does; a hash of the keys gives repeated tasks the same
    placed = rows.withColumns({"_block": F.pmod(F.xxhash64(*keys), F.lit(blocks)), "_at": F.xxhash64(*rows.columns)})
    steps = digits([(k, ends[f"min{i}"], ends[f"max{i}"]) for i, k in enumerate(keys)], most_bits) or [(keys[0], ends["min0"], 0, 1)]
    for k, (column, low, shift, bits) in enumerate(steps):
        digit = F.shiftright(F.col(column) - F.lit(low), shift).bitwiseAND(F.lit((1 << bits) - 1))
        dealt = materialise(placed.withColumn("_digit", digit), f"digit{k}", few_files=True)
        counts = dealt.groupBy("_digit", "_block").agg(F.count(F.lit(1)).alias("_n"))
        totals = dict(sorted((r["_digit"], r["n"]) for r in counts.groupBy("_digit").agg(F.sum("_n").alias("n")).collect()))  # at most 2 ** bits
        starts = np.cumsum([0, *totals.values()])[:-1].tolist()
        base = rows.sparkSession.createDataFrame(list(zip(totals, starts, strict=True)), "_digit long, _base long")
        within = F.sum("_n").over(Window.partitionBy("_digit").orderBy("_block")) - F.col("_n")
        offsets = counts.withColumn("_before", within).join(base, "_digit").select("_digit", "_block", (F.col("_base") + F.col("_before")).alias("_offset"))
        own = F.row_number().over(Window.partitionBy("_digit", "_block").orderBy("_at"))
        moved = dealt.withColumn("_own", own).join(offsets, ["_digit", "_block"]).withColumn("_at", F.col("_offset") + F.col("_own") - 1)
        placed = moved.withColumn("_block", F.floor(F.col("_at") / block_rows)).select(*rows.columns, "_block", "_at")
    return placed.select(*rows.columns, (F.col("_at") + 1).alias(out))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = 25, least_words: int = 20,
    buckets: int = 10_000, longest: int = 2, seed: int = 7, block_rows: int = 1 << 18,
) -> DataFrame:
    """Per document: id, n_features, weight, score, rank; ranks of the drawn share of documents with ``least_words``, null for all others."""
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest))
    scored = materialise(weigh(docs, gain, id_col, text_col, seed, longest), "scores", few_files=True)
    able = scored.where(F.col("n_words") >= least_words)
    keyed = able.select(id_col, "n_features", "weight", "score", (-F.col("score")).alias("_down"), F.col(id_col).isNull().cast("long").alias("_null"), F.coalesce(id_col, F.lit(0)).alias("_id"))
    ranked = radix_rank(keyed, ["_down", "_null", "_id"], block_rows=block_rows)
    drawn = percent * able.count() // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    names = [id_col, "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < least_words).select(*names, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*names, rank).unionByName(rest)
