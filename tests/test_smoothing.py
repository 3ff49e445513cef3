"""Smoothing in chunks against the plain recursion, and tables dealt by value ranges."""

import datetime
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from chronopanel.operators import recursive, tables


def plain_ema(values, period):
    k, seed, y, out = 2 / (period + 1), [], None, []
    for x in values:
        if x is not None:
            if y is None:
                seed.append(x)
                y = sum(seed) / period if len(seed) == period else None
            else:
                y = y * (1 - k) + x * k
        out.append(y)
    return out


def plain_rsi(values, period):
    gains, losses, g, out = [], [], None, []
    for before, x in zip([None, *values], values):
        if before is not None and x is not None:
            up, down = max(x - before, 0), max(before - x, 0)
            if g is None:
                gains.append(up)
                losses.append(down)
                if len(gains) == period:
                    g, low = sum(gains) / period, sum(losses) / period
            else:
                g, low = (g * (period - 1) + up) / period, (low * (period - 1) + down) / period
        out.append(None if g is None else 50.0 if g + low == 0 else 100 * g / (g + low))
    return out


def history(spark, lengths, gaps=True):
    rng = random.Random(6)
    rows, series = [], {}
    for e, n in lengths.items():
        series[e] = [None if gaps and rng.random() < 0.15 else rng.randint(1, 10_000) for _ in range(n)]
        rows += [(e, t, v) for t, v in enumerate(series[e])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "entity_id long, t long, c long").withColumn("d", F.timestamp_seconds(F.col("t") * 60))
    return df.repartition(6), series


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def by_entity(df, column):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["entity_id"], r["t"])):
        out.setdefault(r["entity_id"], []).append(r[column])
    return out


@pytest.mark.parametrize("chunk", [3, 7, 40, 1000])
def test_ema_and_adjusted(spark, chunk):
    """Chunks shorter and longer than the seeds, entities shorter than a chunk, gaps at chunk ends."""
    df, series = history(spark, {1: 200, 2: 5, 3: 41, 4: 1, 5: 9})
    got = by_entity(recursive.ema(df, "c", 10, ["t"], chunk_rows=chunk), "ema")
    adjusted = by_entity(recursive.adjusted_ema(df, "c", 10, ["t"], chunk_rows=chunk), "ema")
    for e, values in series.items():
        same(got[e], plain_ema(values, 10))
        num = den = 0.0
        want = []
        for x in values:
            if x is not None:
                num, den = x + (1 - 2 / 11) * num, 1 + (1 - 2 / 11) * den
            want.append(num / den if den else None)
        same(adjusted[e], want)


@pytest.mark.parametrize("chunk", [4, 30, 1000])
def test_rsi_and_macd(spark, chunk):
    df, series = history(spark, {1: 150, 2: 3, 3: 60})
    got = by_entity(recursive.rsi(df, "c", 14, ["t"], chunk_rows=chunk), "rsi")
    lines = recursive.macd(df, "c", ["t"], chunk_rows=chunk)
    macd, signal = by_entity(lines, "macd"), by_entity(lines, "signal")
    full, _ = history(spark, {1: 150, 2: 3, 3: 60}, gaps=False)
    whole = by_entity(recursive.rsi(full, "c", 14, ["t"], chunk_rows=chunk), "rsi")
    exact = {e: [r["c"] for r in sorted(full.where(F.col("entity_id") == e).collect(), key=lambda r: r["t"])] for e in series}
    for e, values in series.items():
        same(got[e], plain_rsi(values, 14))
        same(whole[e], plain_rsi(exact[e], 14))
        line = [None if a is None or b is None else a - b for a, b in zip(plain_ema(values, 12), plain_ema(values, 26))]
        same(macd[e], line)
        same(signal[e], [s if m is not None else None for s, m in zip(plain_ema(line, 9), line)])


def test_one_entity_is_split_over_tasks(spark):
    """A long history: many chunks of bounded size, the result that of the plain recursion."""
    n = 200_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("entity_id"), F.col("id").alias("t"), F.timestamp_seconds("id").alias("d"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("c"))
    chunks, many = recursive.chunked(df, "entity_id", "d", 10_000)
    sizes = [r["count"] for r in chunks.groupBy("_c").count().collect()]
    assert many and len(sizes) >= 20 and max(sizes) <= 11_000
    got = recursive.ema(df, "c", 10, ["t"], chunk_rows=10_000)
    values = [r["c"] for r in df.orderBy("t").collect()]
    same(by_entity(got, "ema")[1], plain_ema(values, 10))


def test_empty(spark):
    df, _ = history(spark, {1: 3})
    assert recursive.ema(df.where("false"), "c", 3, ["t"]).collect() == []


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_grouped_running_total(spark, buckets):
    rng = random.Random(1)
    rows = [(g, rng.randint(0, 20), k, rng.randint(1, 5)) for g, n in (("a", 400), ("b", 3), ("c", 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, v long, k long, n long").repartition(5)
    got = {(r["g"], r["k"]): (r["upto"], r["all"]) for r in tables.running_total(df, "v", "n", "upto", "all", buckets=buckets, ties=("k",), groups=("g",)).collect()}
    for g in "abc":
        total = 0
        own = sorted(r for r in rows if r[0] == g)
        for r in own:
            total += r[3]
            assert got[g, r[2]] == (total, sum(x[3] for x in own))


def test_false_discovery_rate(spark):
    """Ties, nulls, families of one, all and none."""
    rng = random.Random(3)
    rows = [(f, k, None if rng.random() < 0.1 else round(rng.random() ** power, 2)) for f, power in (("low", 4), ("flat", 1), ("none", 0.1)) for k in range(200)] + [("one", 0, 0.04), ("missing", 0, None)]
    df = spark.createDataFrame(rows, "f string, k long, p double").repartition(4)
    got = {(r["f"], r["k"]): r["survivor"] for r in tables.benjamini_hochberg(df, "p", ["f"], 0.1).collect()}
    for f in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == f]
        known = sorted(r[2] for r in own if r[2] is not None)
        cut = max((p for k, p in enumerate(known, 1) if p <= k * 0.1 / len(own)), default=-1)
        assert all(got[f, r[1]] == (r[2] is not None and r[2] <= cut) for r in own)


def test_lowest_share(spark):
    rows = [(g, k) for g, n in (("a", 5000), ("b", 7), ("c", 1)) for k in range(n)] + [("d", 1)] * 4
    df = spark.createDataFrame(rows, "g string, k long").withColumn("h", F.sha2(F.col("k").cast("string"), 256)).repartition(4)
    got = sorted((r["g"], r["k"]) for r in tables.lowest_share(df, ["g"], "h", ["k"], 3, 10).collect())
    want = []
    for g in "abcd":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: hashlib.sha256(str(r[1]).encode()).hexdigest())
        want += own[: 3 * len(own) // 10]
    assert got == sorted(want)


def test_margin_closeout(spark):
    """Account by account against the plain loop: shorts, no price, exits, ties, cash from rich to ruined."""
    rng = random.Random(11)
    held, cash = [], []
    for a in range(12):
        for k in range(rng.randint(1, 30)):
            price = None if rng.random() < 0.1 else rng.randint(1, 200)
            held.append((a, k, rng.choice([-1, 1]) * rng.randint(0, 40), rng.randint(1, 200), price, rng.random() < 0.1))
        cash.append((a, rng.randint(-60_000, 20_000)))
    df = spark.createDataFrame(held, "a long, position_id long, shares long, avg_price long, price long, exiting boolean").repartition(3)
    got = {(r["a"], r["position_id"]): (r["action"], r["closed"]) for r in tables.margin_closeout(df, spark.createDataFrame(cash, "a long, cash long"), "a", 0.25, 0.05, buckets=3).collect()}
    want = {}
    for a, c in cash:
        own = [h for h in held if h[0] == a]
        mark = {h[1]: h[3] if h[4] is None else h[4] for h in own}
        equity = float(c + sum(h[2] * mark[h[1]] for h in own))
        gross = float(sum(abs(h[2]) * mark[h[1]] for h in own if not h[5]))
        if gross <= 0 or equity / gross >= 0.25:
            continue
        budget = min(gross, gross - equity / (0.25 + 0.05))
        for h in sorted((h for h in own if not h[5] and h[4] is not None and h[2]), key=lambda h: ((h[4] - h[3]) * h[2], h[1])):
            if budget <= 0:
                break
            n = min(abs(h[2]), math.ceil(budget / h[4]))
            budget -= n * h[4]
            want[a, h[1]] = ("sell" if h[2] > 0 else "cover", n)
    assert got == want and want


def test_dates_too(spark):
    rows = [(1, datetime.date(2020, 1, 1) + datetime.timedelta(k), k % 7) for k in range(30)]
    df = spark.createDataFrame(rows, "entity_id long, d date, c long")
    got = sorted((r["d"], r["ema"]) for r in recursive.ema(df, "c", 5, ["d"], chunk_rows=6).collect())
    same([y for _, y in got], plain_ema([r[2] for r in rows], 5))


def test_macd_line_is_one_pass(spark):
    """The line alone equals the full operator's, over batches that end within histories, and no pass for the signal is planned."""
    df, series = history(spark, {1: 200, 2: 5, 3: 41, 4: 26, 5: 90})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        line = recursive.macd_line(df, "c", ["t"])
        got = by_entity(line, "macd")
        whole = by_entity(recursive.macd(df, "c", ["t"]), "macd")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for e, values in series.items():
        want = [None if f is None or s is None else f - s for f, s in zip(plain_ema(values, 12), plain_ema(values, 26))]
        same(got[e], want)
        assert got[e] == whole[e]
    assert line._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
