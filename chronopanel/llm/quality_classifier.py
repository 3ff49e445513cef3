"""Quality classifier from compressed sizes.

Two Zstandard dictionaries are built from text labelled good and bad.  A text
is cut into blocks, each compressed with either dictionary; the difference of
the summed sizes over their sum says which dictionary knows the text better.
A logistic fit turns that difference, the plain compressed share, the length
and their products into a calibrated probability of label 1.  The README tells
how far each of them goes alone.

Only the fit is bounded: ``sample`` labelled documents a class for the
dictionaries and as many others for the calibration, both chosen by a hash of
the id and read as a whole.  Scoring reads every whole text.  The model (two dictionaries of at most
``dict_bytes`` and a few weights) is all that is sent to the tasks.

Defined cases: a null or empty text gets the score of a text of one block's
size with no difference.  Labels that are null or neither 0 nor 1 are unused;
rows with null ids are scored and never learned from.  Repeated rows get equal
scores.  Without labels of both kinds the score is 0.5 throughout.  Only the
id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, utf8

BLOCK = 2048


@dataclass(frozen=True)
class Model:
    """Dictionaries and the calibration's weights, mean and scale."""

    good: bytes
    bad: bytes
    level: int
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]


def blocks_of(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


class Sizer:
    """Compressed sizes of texts under either dictionary and under none."""

    def __init__(self, good: bytes, bad: bytes, level: int):
        self.by = []
        for data in (good, bad, b""):
            held = zstandard.ZstdCompressionDict(data) if data else None
            if held:
                held.precompute_compress(level=level)
            self.by.append(zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def features(self, text: bytes | None) -> tuple[float, float, float]:
        """Normalised difference (positive: the good one knows it better), plain share, log length."""
        text = text or b""
        if not text:
            return 0.0, 1.0, float(np.log1p(BLOCK))
        parts = blocks_of(text)
        good, bad = (sum(len(f(p)) for p in parts) for f in self.by[:2])
        plain = len(self.by[2](text))
        return (bad - good) / max(good + bad, 1), plain / len(text), float(np.log1p(len(text)))


def expand(x: np.ndarray) -> np.ndarray:
    """Features and the terms that let the difference count for more in some lengths and shares."""
    d, share, size = x.T
    return np.stack([d, share, size, d * size, d * share, share * size, d * d, share * share], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 200) -> np.ndarray:
    """Newton's method on a ridge-penalised likelihood; a leading intercept.

    A step is halved until the loss falls, so that classes that a line parts
    (nearly) don't make it overshoot.
    """
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-9

    def loss(v: np.ndarray) -> float:
        z = a @ v
        return float((np.logaddexp(0, z) - y * z).sum() + v @ penalty @ v / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        size = 1.0
        while size > 1e-6 and not (new := loss(w + size * step)) < now:
            size /= 2
        if size <= 1e-6:
            break
        w, now, fell = w + size * step, new, now - new
        if fell < 1e-10 * max(1.0, now):
            break
    return w


def fold(id_col: str | Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def _ids(labels: DataFrame, id_col: str, label_col: str, sample: int) -> DataFrame:
    """(id, y, part): 2 * sample ids a class by hash; part 0 builds dictionaries, part 1 calibrates."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull()).where(fold("id") != 0)
    known = known.groupBy("id").agg(F.max("y").alias("y"), F.min("y").alias("z")).where("y = z").drop("z")
    order = F.xxhash64(F.col("id").cast("string"))
    one = [known.where(F.col("y") == k).orderBy(order, "id").limit(2 * sample) for k in (0, 1)]
    return one[0].unionByName(one[1]).withColumn("part", F.pmod(F.shiftright(order, 8), F.lit(2)).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 1500, dict_bytes: int = 112_640, level: int = 3) -> Model | None:
    """Dictionaries and calibration from at most 4 * ``sample`` labelled documents; None without both labels."""
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # at most 4 * sample ids
    picked = read.join(F.broadcast(_ids(labels, id_col, label_col, sample)), "id")

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            for text, y in zip(utf8(b.column("text")), b.column("y").to_pylist(), strict=True):
                parts = blocks_of(text or b"")
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), pa.array([y] * len(parts), pa.int32())], names=["block", "y"])

    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for r in picked.where("part = 0").select("text", "y").mapInArrow(cut, "block binary, y int").collect():
        texts[r["y"]].append(bytes(r["block"]))
    if min(map(len, texts.values())) < 8:
        return None
    good, bad = (_dictionary(sorted(texts[k]), dict_bytes) for k in (1, 0))

    def sizes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(good, bad, level)
        for b in batches(rows):
            x = [sizer.features(t) for t in utf8(b.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("y")], names=["x", "y"])

    seen = sorted((tuple(r["x"]), r["y"]) for r in picked.where("part = 1").select("text", "y").mapInArrow(sizes, "x array<double>, y int").collect())
    y = np.array([s[1] for s in seen], float)
    if len(set(y)) < 2:
        return None
    x = expand(np.array([s[0] for s in seen]))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return Model(good, bad, level, tuple(logistic((x - mean) / scale, y)), tuple(mean), tuple(scale))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    whole = sum(map(len, samples))
    if whole > 20 * 1024:
        try:
            return zstandard.train_dictionary(min(size, whole // 8), samples, k=256, d=8, level=3).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"\n".join(samples)[-size:] or b" " * 8


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns ``keep`` and score: the probability of label 1 for every whole text."""
    read = docs.select(F.col(id_col), *keep, F.col(text_col).alias("__text"))
    names = [id_col, *keep]
    if model is None:
        return read.select(*names, F.lit(0.5).alias("score"))

    def scored(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(model.good, model.bad, model.level)
        w, mean, scale = (np.array(v) for v in (model.weights, model.mean, model.scale))
        for b in batches(rows):
            x = (expand(np.array([sizer.features(t) for t in utf8(b.column("__text"))])) - mean) / scale
            p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(p, pa.float64())], names=[*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:-1]) + ", score double"
    return read.mapInArrow(scored, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **fitting) -> DataFrame:
    """Per document: id, held_out, score, predicted (1 if score >= threshold)."""
    out = score(docs, fit(docs, labels, id_col, text_col, **fitting), id_col, text_col)
    return out.select(id_col, F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
