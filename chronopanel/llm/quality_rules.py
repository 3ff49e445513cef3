"""Quality rules: base counts, and the divergence of a text from its language.

Base counts follow fixed definitions.  The method's verdict compares two
histograms of a document to references of its language by Jensen-Shannon
distance: character classes, and occurrences of common words.  References are
means over all documents of a language, so long documents weigh as much as
short ones.  A guard skips a comparison where the text is too short for it.
In a language of which no common word is listed, nearly all words are others
and their comparison rejects nothing; that of character classes still does.

By chance alone a text of n words strays about 1/sqrt(n) from its reference.
How far is taken from the distances of all documents, per language and length:
``noise_widths`` times the lower spread (median less 16th percentile, which far
texts hardly move) above the median.  Within that a text is not far, unless it
is as far as a text without any common word.

One scan makes the counts and one pass over them both distances (Python, Arrow
batches); references and noise are DataFrame aggregates over the small tables.

Defined cases: a null or empty text has no words and fails the base rules.  A
null ``lang`` is a language of its own.  Each row is judged by itself, repeated
rows alike; an empty table gives an empty result.  Only the id, text and lang
columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, hold, materialise, utf8

#: Frequent function words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to in is that it for was with as be on by are this from or have "
    "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans par sur au "
    "el los se del las por con no una su para es al lo"
).split()

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

CLASSES = ("lower", "upper", "digit", "space", "newline", "punctuation", "symbol", "beyond_ascii")

_COMMON = {w.encode(): i for i, w in enumerate(dict.fromkeys(COMMON_WORDS))}


def _class_table() -> np.ndarray:
    """Class of each byte; continuation bytes of UTF-8 have none (8)."""
    out = np.full(256, 5, np.uint8)
    for k, chars in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, *range(9, 14)), (10,))):
        out[list(chars)] = k
    out[list(SYMBOLS)] = 6
    out[0x80:0xC0] = 8
    out[0xC0:] = 7
    return out


_CLASS = _class_table()


def covered_by_repeats(words: list[bytes], width: int) -> int:
    """Words in ``width``-word windows that occur twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    grams = h[:n].copy()
    for k in range(1, width):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) ^ (grams >> np.uint64(29))
        grams += h[k : k + n]
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    repeated = np.zeros(n, bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: bytes | None) -> tuple:
    """Base counts, class histogram and common-word histogram (last place: any other word)."""
    text = text or b""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) - int(np.count_nonzero(_CLASS[np.frombuffer(joined, np.uint8)] == 8))
    classes = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=9)[:8]
    seen: set[bytes] = set()
    dup_lines = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup_lines += 1
        elif line.strip():
            seen.add(line)
    common = [0] * (len(_COMMON) + 1)
    get = _COMMON.get
    for w in text.lower().split():
        k = get(w.rstrip(b".,"))
        if k is not None:
            common[k] += 1
    common[-1] = len(words) - sum(common)
    return len(words), chars, int(classes[6]), dup_lines, covered_by_repeats(words, 3), classes.tolist(), common


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common")


def _measured(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(rows):
        found = list(zip(*map(measure, utf8(b.column("text"))), strict=True))
        cols = [pa.array(x, pa.int64()) for x in found[:5]] + [pa.array(x, pa.list_(pa.int64())) for x in found[5:]]
        yield pa.RecordBatch.from_arrays([b.column("id"), *cols, b.column("lang")], names=["id", *_MEASURES, "lang"])


def _shares(counts: str) -> Column:
    """A histogram as shares of its sum."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares; null if either is."""

    def part(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    both = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2))


def _stacked(column: pa.Array, n: int) -> np.ndarray:
    """A list column of ``n`` places as a matrix; rows of nulls are nan."""
    out = np.full((len(column), n), np.nan)
    out[column.is_valid().to_numpy(zero_copy_only=False)] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return out


def _js(counts: np.ndarray, q: np.ndarray, told: np.ndarray) -> pa.Array:
    """Jensen-Shannon distances of rows of counts to rows of shares, where told; null if either is missing."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p = counts / counts.sum(1, keepdims=True)
        m = (p + q) / 2
        terms = np.where(p > 0, p * np.log2(p / m), 0.0) + np.where(q > 0, q * np.log2(q / m), 0.0)
        terms[np.isnan(p) | np.isnan(q)] = np.nan
        out = np.sqrt(np.maximum(0.0, terms.sum(1) / 2))
    return pa.array(out, mask=np.isnan(out) | ~told)


def _mean(column: str, n: int) -> Column:
    return F.array(*[F.avg(F.col(column)[i]) for i in range(n)])


def _octave() -> Column:
    """Binary digits of the number of words: lengths within a factor of two."""
    return F.length(F.bin("n_words"))


def _noise(scored: DataFrame, widths: float, min_docs: int) -> DataFrame:
    """Per language a map from octave (0: all lengths) to the noise of a common-word distance times sqrt(n_words).

    Octaves of fewer than ``min_docs`` documents have no entry.  Quantiles come
    from counts of hundredths, which are few and add up alike in any order.
    """
    step = F.floor(F.col("common_distance") * F.sqrt("n_words") * 100).cast("int")
    steps = scored.where("common_distance is not null").groupBy("lang", _octave().alias("octave"), step.alias("step")).agg(F.count("*").alias("n"))
    steps = materialise(steps, "distances", few_files=True)
    steps = steps.union(steps.groupBy("lang", F.lit(0).alias("octave"), "step").agg(F.sum("n").alias("n")))
    group = Window.partitionBy("lang", "octave")
    ranked = steps.select("lang", "octave", "step", F.sum("n").over(group.orderBy("step")).alias("upto"), F.sum("n").over(group).alias("total"))
    mid, low = (F.min(F.when(100 * F.col("upto") >= k * F.col("total"), F.col("step") + 1)) for k in (50, 16))
    per = ranked.groupBy("lang", "octave").agg(F.max("total").alias("total"), ((mid + widths * (mid - low)) / 100).alias("noise"))
    per = per.where((F.col("octave") == 0) | (F.col("total") >= min_docs))
    return per.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("octave", "noise"))).alias("noise"))


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_class_chars: int = 200,
    min_common_words: int = 100,
    max_class_distance: float = 0.3,
    max_common_distance: float = 0.28,
    noise_widths: float = 6.0,
    min_noise_docs: int = 30,
) -> DataFrame:
    """Base counts, distances and the verdict per document.

    The bound on common words is ``max_common_distance``, or what sampling noise
    gives (``_noise``) where that is more; noise counts no further than to the
    distance of a text without common words.

    Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, common_distance, kept.
    """
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit("none")).alias("lang"))
    kinds = {c: "array<long>" if c in ("classes", "common") else "long" for c in _MEASURES}
    schema = f"id {dict(read.dtypes)['id']}, " + ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", lang string"
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counts = hold(read.mapInArrow(_measured, schema)).withColumn("base_failed", base_failed)
    shares = counts.where(~F.col("base_failed")).select("lang", _shares("classes").alias("cp"), _shares("common").alias("wp"))
    refs = shares.groupBy("lang").agg(_mean("cp", len(CLASSES)).alias("cr"), _mean("wp", len(_COMMON) + 1).alias("wr"))
    none = F.array(*[F.lit(0.0)] * len(_COMMON), F.lit(1.0))
    refs = materialise(refs.withColumn("no_common", js_distance(none, F.col("wr"))), "references", few_files=True)
    kept = ["id", *_MEASURES[:5], "lang", "base_failed", "no_common"]

    def measure_distances(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            classes, common = _stacked(b.column("classes"), len(CLASSES)), _stacked(b.column("common"), len(_COMMON) + 1)
            by_class = _js(classes, _stacked(b.column("cr"), len(CLASSES)), classes.sum(1) >= min_class_chars)
            by_word = _js(common, _stacked(b.column("wr"), len(_COMMON) + 1), b.column("n_words").to_numpy() >= min_common_words)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), by_class, by_word], names=[*kept, "class_distance", "common_distance"])

    joined = counts.join(refs, "lang", "left")
    types = dict(joined.dtypes)
    scored = joined.mapInArrow(measure_distances, ", ".join(f"{c} {types[c]}" for c in kept) + ", class_distance double, common_distance double")
    scored = materialise(scored, "scored", few_files=True)
    own = F.col("noise")
    noise = F.coalesce(F.try_element_at(own, _octave()), F.try_element_at(own, F.lit(0))) / F.sqrt("n_words")
    scored = scored.join(_noise(scored.where(~F.col("base_failed")), noise_widths, min_noise_docs), "lang", "left")
    common_bound = F.greatest(F.lit(max_common_distance), F.least(noise, F.col("no_common") * (1 - 1e-9)))
    far = (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance) | F.coalesce(F.col("common_distance") > common_bound, F.lit(False))
    return scored.withColumn("kept", ~F.col("base_failed") & ~far).select(F.col("id").alias(id_col), *_MEASURES[:5], "base_failed", "class_distance", "common_distance", "kept")
