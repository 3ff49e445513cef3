"""Queries of streaming jobs (section J): bounded replays of the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.sources import fixtures as fx
from chronopanel.sources.staging import shared_path as scratch
from chronopanel.streaming import events as op

from .registry import query


#: Rows of a landed file, about.
FILE_ROWS = 1 << 19


def _events(spark, sf_dir):
    rows = op.source(spark, sf_dir, "events.parquet", fx.table(spark, sf_dir, "events").schema)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # event time must be an instant


def unruly_events(spark, sf_dir, path):
    """The events in three batches as a stream: some come a batch late but in time, some twice, and copies of old ones under new ids too late."""
    rows = fx.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    ends = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    cuts = [ends["lo"] + (ends["hi"] - ends["lo"]) * k / 3 for k in (1, 2)]
    third = (F.col("ts") >= F.lit(cuts[0])).cast("int") + (F.col("ts") >= F.lit(cuts[1])).cast("int")
    near = F.lit(False)
    for cut in cuts:
        near = near | ((F.col("ts") < F.lit(cut)) & (F.col("ts") >= F.lit(cut) - F.expr("interval 30 minutes")))
    dealt = rows.withColumns({"batch": third + (near & (F.col("event_id") % 5 == 0)).cast("int"), "near": near})
    old = F.col("ts") < F.lit(cuts[0]) - F.expr("interval 2 days")  # a batch's late rows are told by the watermark before it
    late = dealt.where(old & (F.col("event_id") % 7 == 0)).withColumn("event_id", F.col("event_id") + 10**12)
    batches = [dealt.where("batch = 0"), dealt.where("batch = 1").unionByName(dealt.where("batch = 0 and near")), dealt.where("batch = 2").unionByName(dealt.where("batch = 1 and near")).unionByName(late)]
    return op.land([b.drop("batch", "near") for b in batches], path, max(1, -(-ends["n"] // (len(batches) * FILE_ROWS))))


_TOP = "top AS (SELECT max(ts) AS hi FROM events)"


@query(_TOP + """, e AS (SELECT user_id, CAST(ts AS DATE) AS d, value, row(ts, event_id) AS k FROM events)
SELECT user_id, d, arg_min(value, k) AS o, max(value) AS h, min(value) AS l, arg_max(value, k) AS c, count(*) AS n FROM e, top WHERE CAST(d AS TIMESTAMP) + INTERVAL 1 DAY <= hi - INTERVAL 1 HOUR GROUP BY 1, 2""")
def j1_streaming_bars(spark, sf_dir):
    return op.replay(op.bars(_events(spark, sf_dir), "user_id", "ts", "value", "1 hour"), scratch(spark, "j1"))


@query("SELECT event_id, user_id FROM events")
def j2_first_seen(spark, sf_dir):
    """Of a stream with repeats and late copies: every event once, no late one."""
    path = scratch(spark, "j2")
    return op.replay(op.first_seen(unruly_events(spark, sf_dir, f"{path}/landed"), ["event_id"], "ts", "1 hour"), path).select("event_id", "user_id")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def j3_streaming_upsert(spark, sf_dir):
    last = op.upsert_into(_events(spark, sf_dir), scratch(spark, "j3"), ["user_id"], ["ts", "event_id"])
    return last.select("user_id", "event_id", "event_type")


@query(_TOP + """, e AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r(user_id, rn, mean) AS (SELECT user_id, rn, value FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.rn, r.mean * (1 - 2::DOUBLE / 11) + e.value * (2::DOUBLE / 11) FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, event_id, mean, rn AS n FROM r JOIN e USING (user_id, rn), top WHERE ts <= hi - INTERVAL 1 HOUR""")
def j4_running_mean(spark, sf_dir):
    """Events out of order, repeated and late: the mean of each key along its events in time."""
    path = scratch(spark, "j4")
    return op.replay(op.running_mean(unruly_events(spark, sf_dir, f"{path}/landed"), "user_id", "ts", "value", 10, "1 hour", 400 * 86_400_000), path)


@query("r AS (SELECT * FROM (VALUES ('click', 1.0::DOUBLE, 50.0::DOUBLE), ('view', 0.5::DOUBLE, 80.0::DOUBLE)) t(event_type, lo, hi)) SELECT event_id, event_type FROM events JOIN r USING (event_type) WHERE value < lo OR value > hi")
def j5_streaming_bounds(spark, sf_dir):
    rules = spark.createDataFrame([("click", 1.0, 50.0), ("view", 0.5, 80.0)], "event_type string, lo double, hi double")
    return op.replay(op.out_of_bounds(_events(spark, sf_dir), rules, "event_type", "value"), scratch(spark, "j5")).select("event_id", "event_type")


@query(_TOP + """, g AS (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 48 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
s AS (SELECT user_id, event_type, ts, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, event_type, min(ts) AS start, max(ts) + INTERVAL 48 HOUR AS "end", count(*) AS n FROM s, top GROUP BY user_id, event_type, k HAVING max(ts) + INTERVAL 48 HOUR <= any_value(hi) - INTERVAL 1 HOUR""")
def j6_sessions(spark, sf_dir):
    """Episodes of a label: events of one user and type; repeats and late copies of the stream don't count."""
    path = scratch(spark, "j6")
    seen = op.first_seen(unruly_events(spark, sf_dir, f"{path}/landed"), ["event_id"], "ts", "1 hour")
    out = op.replay(op.sessions(seen, ["user_id", "event_type"], "ts", "48 hours", "1 hour"), path)
    return out.select("user_id", "event_type", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
