"""Structured Streaming jobs over an event stream: bars, duplicates, upserts, recursions, bounds, sessions.

Each function takes a streaming frame and returns one; ``replay`` runs a bounded
input to its end and returns what the sink holds.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A stream of the Parquet files of that name below a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def land(batches: list[DataFrame], path: str, files: int = 1) -> DataFrame:
    """Write frames one after another below ``path``, each as so many files, and the stream that reads one of them a batch, in that order."""
    spark, schema = batches[0].sparkSession, batches[0].schema
    for k, df in enumerate(batches):
        at = f"{path}/batch={k}"
        df.repartition(files).write.parquet(at)
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/part-*")
        made = len(where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or [])
        for _ in range(files - made):  # partitions without rows leave no file
            spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*")


def replay(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run the stream over all that is there into Parquet, and read that."""
    out = f"{path}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    with rocksdb(stream.sparkSession):
        query = writer.format("parquet").option("path", out).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def bars(events: DataFrame, key: str, time: str, value: str, delay: str, span: str = "1 day") -> DataFrame:
    """Open, high, low, close, sum and count per key and window, once the watermark has passed it."""
    w = F.window(time, span)
    out = events.withWatermark(time, delay).groupBy(w.alias("w"), key).agg(
        F.min_by(value, F.struct(time, "event_id")).alias("o"), F.max(value).alias("h"), F.min(value).alias("l"), F.max_by(value, F.struct(time, "event_id")).alias("c"), F.count(F.lit(1)).alias("n")
    )
    return out.select(key, F.to_date("w.start").alias("d"), "o", "h", "l", "c", "n")


def first_seen(events: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Rows whose key has not come before within the watermark; late ones are dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def versions_of(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions ``v<number>`` of a table below ``path``, in order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    done = store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(where, "v*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName().removeprefix("v")) for f in done)


def upsert_into(stream: DataFrame, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the last row per key: each batch is merged with the newest version before it, under a new one.

    Versions are found in the folder, so a restart goes on from what it holds;
    a batch that is run again is merged with the version before it once more.
    """
    from chronopanel.operators.tables import first_per_key

    spark, schema = stream.sparkSession, stream.schema
    latest = [F.desc(c) for c in order]

    def merge(batch: DataFrame, number: int) -> None:
        new = first_per_key(batch, keys, latest)
        before = [v for v in versions_of(spark, path) if v < number]
        if before:
            old = spark.read.schema(schema).parquet(f"{path}/v{before[-1]}")
            new = first_per_key(old.unionByName(new), keys, latest)
        new.write.mode("overwrite").parquet(f"{path}/v{number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    versions = versions_of(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v{versions[-1]}") if versions else spark.createDataFrame([], schema)


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start within keep their state in RocksDB; the session's own choice comes back after."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def running_mean(events: DataFrame, key: str, time: str, value: str, period: int, delay: str, idle_ms: int, ident: str = "event_id", buckets: int = 1024) -> DataFrame:
    """Per event the exponential mean of its key up to it, seeded with the first value, once the watermark has passed it.

    Rows wait in a state until the watermark has passed them, then they go into the
    mean in order of time and id.  A state is that of a bucket of keys, so calls
    don't grow with the keys; a task holds a bucket's rows within the delay and one batch.

    Events may come in any order within ``delay`` and more than once; later ones
    are dropped.  A key that has had no event for ``idle_ms`` starts anew, and its
    state goes once the watermark has passed that time.
    """
    # the watermark is set on ``time`` itself, so it has to stay among the columns
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bucket")
    rows = events.withWatermark(time, delay).select(bucket, key, time, F.unix_micros(time).alias("_at"), F.col(ident).alias("_id"), F.col(value).cast("double").alias("_value"))
    k, idle, kinds = 2 / (period + 1), idle_ms * 1000, {key: "int64", ident: "int64", "mean": "float64", "n": "int64"}

    def follow(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() * 1000
        held = state.get if state.exists else ([],) * 8
        means = dict(zip(held[0], zip(*held[1:4], strict=True), strict=True))
        waiting = set(zip(*held[4:], strict=True))  # rows that came twice are one
        if not state.hasTimedOut:
            for f in frames:
                waiting.update(zip(*(f.iloc[:, c].tolist() for c in (1, 3, 4, 5)), strict=True))
        out, rest = [], []
        for who, at, number, x in sorted(waiting):
            if at > now:
                rest.append((who, at, number, x))
                continue
            mean, n, last = means.get(who, (None, 0, 0))
            mean, n = (x, 1) if mean is None or at - last > idle else (mean * (1 - k) + x * k, n + 1)
            means[who] = mean, n, at
            out.append((who, number, mean, n))
        awaited = {r[0] for r in rest}
        means = {who: s for who, s in means.items() if who in awaited or now <= s[2] + idle}
        if not means and not rest:
            state.remove()
        else:
            columns = lambda made, width: [list(c) for c in zip(*made, strict=True)] or [[] for _ in range(width)]
            state.update((list(means), *columns(means.values(), 3), *columns(rest, 4)))
            # a bucket is woken once the watermark is past its timeout
            wake = [r[1] - 1 for r in rest] + [s[2] + idle for who, s in means.items() if who not in awaited]
            state.setTimeoutTimestamp(min(wake) // 1000)
        if out:
            yield pd.DataFrame(out, columns=list(kinds)).astype(kinds)

    schema = f"{key} long, {ident} long, mean double, n long"
    kept = "who array<long>, mean array<double>, n array<long>, last array<long>, waits array<long>, at array<long>, id array<long>, value array<double>"
    return rows.groupBy("_bucket").applyInPandasWithState(follow, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)


def out_of_bounds(events: DataFrame, rules: DataFrame, kind: str, value: str) -> DataFrame:
    """Events whose value lies outside the static bounds of their kind."""
    return events.join(rules, kind).where((F.col(value) < F.col("lo")) | (F.col(value) > F.col("hi")))


def sessions(events: DataFrame, keys: list[str], time: str, gap: str, delay: str) -> DataFrame:
    """Episodes: events of one key no further apart than the gap."""
    s = F.session_window(time, gap)
    out = (events if events.isStreaming and "EventTimeWatermark" in events._jdf.queryExecution().analyzed().toString() else events.withWatermark(time, delay)).groupBy(s.alias("s"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
