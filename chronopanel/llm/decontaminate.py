"""Benchmark decontamination by winnowing; DataFrame functions only.

Words of documents and benchmark items are hashed.  Of every window of
``window`` consecutive words the minimum hash of its ``gram``-word grams is a
fingerprint, so a window that two texts share gives both the same fingerprint:
every shared span of ``window`` words is found.  A document emits a fingerprint
where the minimum changes, with the words around it.  Fingerprints that some
item has are extended: each window around them is compared to the items'
windows by the hash of all its words.  Items of fewer words are one window of
their own length; their fingerprint is their minimum word hash.

Documents are scanned once, and seeds that no item has end in the join with
the items' fingerprints.  Spark broadcasts that side as long as it is under
its own size threshold and shuffles beyond that.

Defined cases: a null or empty text has no words.  Rows of one id give one
result: the largest word count and the hits of all, null ids alike.  Items
without words hit nothing; an item with a null id hits words but is not listed
or counted.  Only the named columns are read, so other columns can't clash.  A
benchmark without rows leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

#: Fixed value: what separates words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def places(n: Column) -> Column:
    """0 to n - 1; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def minima(hashes: Column, window: int, gram: int) -> Column:
    """The minimum gram hash of each window."""
    n, each = F.size(hashes), window - gram + 1
    grams = F.transform(places(n - gram + 1), lambda i: F.xxhash64(*[F.get(hashes, i + t) for t in range(gram)]))
    return let(grams, lambda g: F.transform(places(n - window + 1), lambda j: F.least(*[F.get(g, j + t) for t in range(each)])))


def _seed(fp: Column, at: Column, near: Column) -> Column:
    return F.struct(fp.alias("fp"), at.cast("int").alias("at"), near.alias("near"))


def seeds(hashes: Column, window: int, gram: int) -> Column:
    """Fingerprints where the minimum changes, and within long runs, with the words that their windows span."""
    each = window - gram + 1

    def chosen(m: Column) -> Column:
        new = lambda j: (j == 0) | (F.get(m, j) != F.get(m, j - 1)) | ((j % each == 0) & (F.get(m, j) == F.get(m, F.greatest(j - each, F.lit(0)))))
        return F.transform(F.filter(places(F.size(m)), new), lambda j: _seed(F.get(m, j), j, F.slice(hashes, j + 1, 2 * each + window - 2)))

    return let(minima(hashes, window, gram), chosen)


def short_seeds(hashes: Column, window: int) -> Column:
    """Every word as a fingerprint, with the words of all shorter windows that hold it."""
    first = lambda j: F.greatest(j - (window - 2), F.lit(0))
    return F.transform(places(F.size(hashes)), lambda j: _seed(F.get(hashes, j), first(j), F.slice(hashes, first(j) + 1, 2 * window - 3)))


def windows(near: Column, at: Column, length: int) -> Column:
    """Each window of ``length`` words: start, length and hash."""
    return F.transform(places(F.size(near) - length + 1), lambda t: F.struct((at + t).alias("start"), F.lit(length).alias("length"), F.xxhash64(F.lit(length), F.slice(near, t + 1, length)).alias("key")))


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, gram: int = 5) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items (sorted as strings), contaminated."""
    known = items.select(F.col(item_col).cast("string").alias("item"), word_hashes(F.col(item_text_col)).alias("h")).where(F.size("h") > 0)
    known = materialise(known, "known", few_files=True)
    whole, short = known.where(F.size("h") >= window), known.where(F.size("h") < window)
    lengths = sorted(r[0] for r in short.select(F.size("h")).distinct().collect())  # fewer than ``window`` numbers
    prints = whole.select(F.explode(minima(F.col("h"), window, gram)).alias("key")).unionByName(short.select(F.array_min("h").alias("key"))).distinct()
    prints = materialise(prints, "prints", few_files=True)
    spans = whole.select("item", F.explode(windows(F.col("h"), F.lit(0), window)).alias("w")).select("item", F.col("w.key").alias("key"))
    spans = spans.unionByName(short.select("item", F.xxhash64(F.size("h"), "h").alias("key")))
    spans = materialise(spans.groupBy("key").agg(F.collect_set("item").alias("found")), "spans", few_files=True)

    def emitted(h: Column) -> Column:
        count = F.array(_seed(F.lit(None).cast("long"), F.size(h), F.lit(None).cast("array<long>")))
        own = [seeds(h, window, gram)] + ([short_seeds(h, window)] if lengths else [])
        return F.concat(count, *own)

    rows = docs.select(F.col(id_col).alias("id"), F.explode(let(word_hashes(F.col(text_col)), emitted)).alias("s")).select("id", "s.fp", "s.at", "s.near")
    near = rows.join(prints.withColumn("hit", F.lit(True)), rows["fp"] == prints["key"], "left").where(F.col("hit") | F.col("near").isNull()).select("id", "at", "near")
    around = F.concat(*[windows(F.col("near"), F.col("at"), n) for n in [*lengths, window]])
    spread = near.select("id", F.when(F.col("near").isNull(), F.col("at")).alias("n_words"), F.explode_outer(around).alias("w")).select("id", "n_words", "w.*")
    spread = spread.withColumnRenamed("key", "own")
    hits = spread.join(spans.withColumn("is_hit", F.lit(True)), F.col("own") == F.col("key"), "left").where(F.col("is_hit") | F.col("n_words").isNotNull())
    place = F.when(F.col("is_hit"), F.struct("start", "length"))
    out = hits.groupBy("id").agg(F.max("n_words").cast("long").alias("n_words"), F.collect_set(place).alias("places"), F.array_distinct(F.flatten(F.collect_set("found"))).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["start"], p["start"] + p["length"] - 1))))
    out = out.select(F.col("id").alias(id_col), "n_words", F.size(covered).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sort_array("items").alias("items"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)
