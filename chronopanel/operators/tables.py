"""Table mutation and incremental jobs: the result is a frame to write.

Parquet has no MERGE, so a mutation is a join or a union and a window over the
key; the writer overwrites the partitions it touches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows of ``new`` whose key is not stored, one per key by ``order``."""
    return first_per_key(new, keys, order).join(old.select(*keys), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Old rows that no new one replaces, and the new ones, one per key."""
    fresh = first_per_key(new, keys, order)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def fill_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the new attribute where there is one, else the old."""
    n = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in new.columns if c not in keys])
    both = old.join(n, keys, "full")
    return both.select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in old.columns if c not in keys])


def reconcile(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows to add and to remove: the columns and ``action``."""
    add = wanted.exceptAll(stored).withColumn("action", F.lit("add"))
    return add.unionByName(stored.exceptAll(wanted).withColumn("action", F.lit("remove")))


def newer_than_stored(rows: DataFrame, stored: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Rows later than the latest stored one of their keys."""
    latest = stored.groupBy(*keys).agg(F.max(time).alias("_latest"))
    return rows.join(latest, keys, "left").where(F.col("_latest").isNull() | (F.col(time) > F.col("_latest"))).drop("_latest")


def lookback(kind: str, period: int) -> int | None:
    """Bars to read before the cutoff: a plain window, a converging recursion, or None for all."""
    if kind == "window":
        return max(20, period) + 10
    if kind == "converging":
        return max(400, 25 * period) + 10
    if kind == "full":
        return None
    raise ValueError(f"unknown lookback {kind!r}")


def lookback_column(kind: str, period: str) -> Column:
    """``lookback`` for a column of kinds; an unknown one fails the job."""
    p = F.col(period)
    bars = F.when(F.col(kind) == "window", F.greatest(F.lit(20), p) + 10).when(F.col(kind) == "converging", F.greatest(F.lit(400), 25 * p) + 10).when(F.col(kind) == "full", F.lit(None))
    return bars.otherwise(F.raise_error(F.concat(F.lit("unknown lookback "), F.col(kind))).cast("long"))


def coherence(runs: DataFrame, keys: list[str], run: str, admitted: str, passed: str, k: int) -> DataFrame:
    """Whether none of the latest k complete runs admitted anything without having passed its test."""
    last = latest_rows(runs, keys, run, k)
    coherent = F.bool_and(F.col(passed) | (F.col(admitted) == 0))
    return last.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.sum(admitted).alias("admitted"), coherent.alias("coherent"))


def _value_range(df: DataFrame, value: str, buckets: int) -> Column:
    """Number of a value's range, in order of the values; ranges hold about equally many rows."""
    cuts = sorted(set(df.approxQuantile(value, [k / buckets for k in range(1, buckets)], 0.01))) if buckets > 1 else []
    return F.aggregate(F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>"), F.lit(0), lambda a, c: a + (F.col(value) > c).cast("int"))


def running_total(df: DataFrame, value: str, amount: str, out: str, total: str, descending: bool = False, buckets: int = 64, ties: tuple[str, ...] = (), groups: tuple[str, ...] = ()) -> DataFrame:
    """Sum of ``amount`` up to each row in order of ``value`` (then ``ties``), and of all rows of its group, without one task for all.

    Sums run within value ranges of a group; those of the ranges before are
    added.  Any ranges give the same result.  Groups and values are not null.
    """
    rows = df.withColumn("_b", _value_range(df, value, buckets))
    order = F.desc if descending else F.asc
    sizes = rows.groupBy(*groups, "_b").agg(F.sum(amount).alias("_n")).withColumn("_one", F.lit(1))
    part = W.partitionBy(*(groups or ("_one",)))
    before = F.coalesce(F.sum("_n").over(part.orderBy(order("_b")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.select(*groups, "_b", before.alias("_before"), F.sum("_n").over(part).alias(total))
    own = F.sum(amount).over(W.partitionBy(*groups, "_b").orderBy(order(value), *ties).rowsBetween(W.unboundedPreceding, 0))
    return rows.join(ranges if groups else F.broadcast(ranges), [*groups, "_b"]).withColumn(out, F.col("_before") + own).drop("_b", "_before")  # broadcast: a row for each range


def lowest_share(df: DataFrame, groups: list[str], key: str, ties: list[str], num: int | str, den: int) -> DataFrame:
    """The floor(num * n / den) rows of each group with the lowest ``key``, a hexadecimal hash; ``num`` may be a column of ``groups``.

    Counts of the hashes' first three digits tell which bins are in as a whole
    and which one the cut falls into; only that bin's rows are ordered.
    """
    rows = df.withColumn("_bin", F.substring(key, 1, 3))
    part = W.partitionBy(*groups)
    sizes = rows.groupBy(*groups, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumns({"_upto": F.sum("_n").over(part.orderBy("_bin")), "_all": F.sum("_n").over(part)})  # at most 4096 bins a group
    sizes = sizes.withColumn("_left", F.expr(f"_all * {num} div {den}") - F.col("_upto") + F.col("_n")).where("_left > 0")
    dealt = rows.join(sizes.select(*groups, "_bin", "_left", (F.col("_left") >= F.col("_n")).alias("_whole")), [*groups, "_bin"])
    cut = dealt.where("not _whole").withColumn("_k", F.row_number().over(W.partitionBy(*groups, "_bin").orderBy(key, *ties))).where("_k <= _left")
    return dealt.where("_whole").select(*df.columns).unionByName(cut.select(*df.columns))


def margin_closeout(positions: DataFrame, accounts: DataFrame, account: str, least: float, buffer: float, buckets: int = 64) -> DataFrame:
    """Shares to close per position where an account's equity is under ``least`` of its gross exposure.

    ``positions``: account, position_id, shares (negative: short), avg_price,
    price (null: none now, marked at avg_price), exiting (leaves the book
    anyway: counts for equity, not for exposure).  ``accounts``: account, cash.
    The budget brings the ratio back to ``least + buffer``; the biggest
    unrealised losses, ties by position_id, are closed first.  All but the last
    are closed whole, so what is left for one is the budget less the exposure
    before it, a running total; the last closes shares up to the next whole one.
    """
    mark = F.coalesce("price", "avg_price")
    rows = positions.withColumn("_gross", F.when(~F.col("exiting"), F.abs("shares") * mark).otherwise(0))
    totals = rows.groupBy(account).agg(F.sum(F.col("shares") * mark).alias("_held"), F.sum("_gross").alias("_all")).join(accounts, account)
    equity, gross = (F.col("_held") + F.col("cash")).cast("double"), F.col("_all").cast("double")
    called = totals.where((gross > 0) & (equity / gross < least)).select(account, F.least(gross, gross - equity / (least + buffer)).alias("_budget"))
    able = rows.where(~F.col("exiting") & (F.col("price") > 0) & (F.col("shares") != 0)).withColumn("_gain", (F.col("price") - F.col("avg_price")) * F.col("shares"))
    able = able.join(called, account)
    spent = running_total(able, "_gain", "_gross", "_upto", "_total", buckets=buckets, ties=("position_id",), groups=(account,))
    left = F.col("_budget") - (F.col("_upto") - F.col("_gross"))
    closed = F.least(F.abs("shares"), F.ceil(left / F.col("price"))).cast("long")
    return spent.where(left > 0).select(account, "position_id", F.when(F.col("shares") > 0, "sell").otherwise("cover").alias("action"), closed.alias("closed"))


def global_rank(df: DataFrame, value: str, tie: str, out: str = "place") -> DataFrame:
    """Place by descending value over all rows."""
    return running_total(df.withColumn("_w", F.lit(1)), value, "_w", out, "_all", descending=True, ties=(tie,)).drop("_w", "_all")


def bounded_read(rows: DataFrame, cutoff: DataFrame, keys: list[str], time: str, bars: int | None) -> DataFrame:
    """New rows and the last ``bars`` rows at or before the cutoff; entities without new rows are left out."""
    joined = rows.join(cutoff, keys, "left")
    late = F.col("cutoff").isNull() | (F.col(time) > F.col("cutoff"))
    part = W.partitionBy(*keys)
    back = F.row_number().over(W.partitionBy(*keys, "_late").orderBy(F.desc(time)))
    out = joined.withColumn("_late", late).withColumns({"_any": F.max("_late").over(part), "_back": back}).where("_any")
    if bars is not None:
        out = out.where(F.col("_late") | (F.col("_back") <= bars))
    return out.drop("_late", "_any", "_back")


def incremental(rows: DataFrame, stored: DataFrame, keys: list[str], time: str, bars: int | None, compute, kept: list[str]) -> DataFrame:
    """New feature rows only: bounded read, compute, keep what lies after the cutoff."""
    cutoff = stored.groupBy(*keys).agg(F.max(time).alias("cutoff"))
    out = compute(bounded_read(rows, cutoff, keys, time, bars))
    return out.where(F.col("cutoff").isNull() | (F.col(time) > F.col("cutoff"))).select(*kept)


def latest_rows(df: DataFrame, keys: list[str], time: str, k: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(time)))).where(F.col("_k") <= k).drop("_k")


def trim(df: DataFrame, time: str, before=None, after=None, where: Column | None = None) -> DataFrame:
    """What is left after deleting rows before or after a date, optionally only where a condition holds."""
    gone = F.lit(False)
    for cond in ([F.col(time) < F.lit(before)] if before else []) + ([F.col(time) > F.lit(after)] if after else []):
        gone = gone | cond
    return df.where(~F.coalesce(gone & (F.lit(True) if where is None else where), F.lit(False)))


def delete_plan(dependents: dict[str, DataFrame], key: str, doomed: DataFrame) -> DataFrame:
    """Rows of each dependent table that would go with the doomed keys."""
    out = None
    for name, df in dependents.items():
        one = df.join(doomed.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("dependent", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def benjamini_hochberg(df: DataFrame, p: str, family: list[str], rate: float) -> DataFrame:
    """survivor: p up to the largest k with p_k <= k / n * rate; a null p counts in n and never survives.

    A family's distinct p are counted over value ranges, which gives k for each,
    and the largest p that passes is the cut for the family's rows.
    """
    seen = df.where(F.col(p).isNotNull()).groupBy(*family, p).agg(F.count(F.lit(1)).alias("_m"))
    placed = running_total(seen, p, "_m", "_k", "_known", groups=tuple(family)).join(df.groupBy(*family).agg(F.count(F.lit(1)).alias("_n")), family)
    cut = placed.where(F.col(p) <= F.col("_k") * rate / F.col("_n")).groupBy(*family).agg(F.max(p).alias("_cut"))
    return df.join(cut, family, "left").withColumn("survivor", F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))).drop("_cut")


def digest_words(value: Column) -> list[Column]:
    """Two words of 60 bits from a value's salted SHA-256."""
    return [F.conv(F.substring(F.sha2(F.concat(value, F.lit(f":{salt}")), 256), 1, 15), 16, 10).cast("decimal(20,0)") for salt in (0, 1)]


def set_digest(value: Column) -> Column:
    """An aggregate: a fingerprint of a group's values that doesn't depend on their order.

    Sums of the values' hashes, and their number, so parts of a group combine
    wherever they are; no task holds a group's values.  Nulls are left out.
    """
    sums = [F.lpad(F.lower(F.hex((F.sum(w) % F.lit(1 << 60).cast("decimal(20,0)")).cast("long"))), 15, "0") for w in digest_words(value)]
    return F.concat(*[F.coalesce(s, F.lit("0" * 15)) for s in sums], F.lit("-"), F.count(value).cast("string"))


def list_digest(df: DataFrame, key: str, value: str, joint: str = ",") -> DataFrame:
    """(key, fingerprint, n): the SHA-256 of a key's texts in order, joined, and its number of rows.

    A hash of a whole list is taken along the list: rows are sorted by Spark and
    pass through in batches, of which a task holds one.  Nulls are counted and
    left out; without a text the fingerprint is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, n, begun = None, None, 0, False
        for batch in batches:
            done = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not begun or k != now:
                    if begun:
                        done.append((now, digest and digest.hexdigest(), n))
                    now, digest, n, begun = k, None, 0, True
                n += 1
                if text is not None:
                    if digest is None:
                        digest = hashlib.sha256()
                    else:
                        digest.update(joint.encode())
                    digest.update(text.encode())
            kind = batch.schema.field(0).type
            yield table(done, kind)
        if begun:
            yield table([(now, digest and digest.hexdigest(), n)], kind)

    def table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        keys, digests, counts = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(digests, pa.string()), pa.array(counts, pa.int64())], [key, "fingerprint", "n"])

    rows = df.select(key, F.col(value).cast("string").alias("_text")).repartition(key).sortWithinPartitions(key, "_text")
    return rows.mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, fingerprint string, n long")


def canonical(node: dict) -> str:
    """A rule tree as text, children of AND and OR in order of their own texts, so that equal rules are equal texts."""
    import json

    def form(n: dict):
        if n.get("op") in ("AND", "OR"):
            return {"op": n["op"], "children": sorted((form(c) for c in n["children"]), key=lambda c: json.dumps(c, sort_keys=True))}
        return n | {"children": [form(c) for c in n["children"]]} if "children" in n else n

    return json.dumps(form(node), sort_keys=True, separators=(",", ":"))


def duplicates(df: DataFrame, ident: str, parts: list[str]) -> DataFrame:
    """Rows whose ``parts``, whatever their order and repeats, equal those of another: id, fingerprint, first id and copies."""
    text = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.concat(F.lit(f"{p}="), F.col(p).cast("string")) for p in parts])))), "|")
    marked = df.select(ident, F.sha2(text, 256).alias("fingerprint"))
    groups = marked.groupBy("fingerprint").agg(F.min(ident).alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return marked.join(groups, "fingerprint").select(ident, "fingerprint", "first_id", "copies")


def guarded_refresh(everyone: DataFrame, excluded: DataFrame, stored: DataFrame, pins: DataFrame, key: str, most_growth: float = 0.25, force: bool = False) -> DataFrame:
    """(key, action) that bring the stored exclusions to the wanted ones: add or remove.

    ``pins`` are never excluded.  A refresh that leaves nobody, or whose exclusions
    grow by more than ``most_growth`` of all, is refused with an error unless forced.
    """
    wanted = excluded.select(key).distinct().join(pins.select(key), key, "left_anti").join(everyone.select(key), key, "left_semi")
    held = stored.select(key).distinct()
    if not force:
        one = everyone.select(key).distinct().join(wanted.withColumn("_w", F.lit(1)), key, "left").join(held.withColumn("_s", F.lit(1)), key, "left")
        n = one.agg(F.count(F.lit(1)).alias("all"), F.count("_w").alias("wanted"), F.count("_s").alias("stored")).first()
        if n["wanted"] == n["all"]:
            raise ValueError("no member would be left")
        if n["wanted"] - n["stored"] > most_growth * n["all"]:
            raise ValueError(f"exclusions would grow from {n['stored']} to {n['wanted']} of {n['all']}")
    return reconcile(wanted, held)
