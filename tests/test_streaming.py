"""Streams that stop and start again."""

from chronopanel.streaming import events as op


def test_upsert_goes_on_after_a_restart(spark, tmp_path):
    landed, table = tmp_path / "landed", f"file://{tmp_path}/table"

    def land(rows, k):
        spark.createDataFrame(rows, "key long, at long, value string").coalesce(1).write.parquet(f"{landed}/batch={k}")

    def run():
        stream = spark.readStream.schema("key long, at long, value string").parquet(f"{landed}/*")
        return {r["key"]: (r["at"], r["value"]) for r in op.upsert_into(stream, table, ["key"], ["at"]).collect()}

    land([(1, 1, "a"), (2, 1, "b"), (2, 2, "c")], 0)
    assert run() == {1: (1, "a"), 2: (2, "c")}
    land([(2, 1, "late"), (3, 5, "d")], 1)
    assert run() == {1: (1, "a"), 2: (2, "c"), 3: (5, "d")}
    land([(1, 9, "e")], 2)
    assert run() == {1: (9, "e"), 2: (2, "c"), 3: (5, "d")}
    assert run() == {1: (9, "e"), 2: (2, "c"), 3: (5, "d")}


def test_running_mean_over_batches(spark, tmp_path):
    """Three runs of one stream: rows out of order, a batch late, twice, too late; a key that is forgotten and comes back."""
    import datetime

    base = f"file://{tmp_path}"
    at = lambda minute: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)

    def run(rows, k):
        df = spark.createDataFrame([(e, at(m), u, float(v)) for e, m, u, v in rows], "event_id long, ts timestamp, user_id long, value double")
        df.coalesce(1).write.parquet(f"{base}/landed/batch={k}")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/landed/*")
        made = op.running_mean(stream, "user_id", "ts", "value", 3, "60 minutes", 600 * 60_000)
        return {(r["user_id"], r["event_id"]): (r["mean"], r["n"]) for r in op.replay(made, f"{base}/job").collect()}

    first = [(3, 30, 1, 8), (1, 10, 1, 2), (2, 20, 1, 4), (4, 200, 1, 6), (5, 15, 2, 100)]
    got = run(first, 0)  # the watermark is at 140 minutes
    assert got == {(1, 1): (2, 1), (1, 2): (3, 2), (1, 3): (5.5, 3), (2, 5): (100, 1)}
    second = [(4, 200, 1, 6), (6, 150, 1, 7.5), (7, 190, 1, 10), (90, 12, 1, 1000), (8, 300, 1, 2), (8, 300, 1, 2)]
    got = run(second, 1)  # event 90 is too late, 4 comes again, 6 and 7 come late but in time; the watermark goes to 240
    assert {k: v for k, v in got.items() if k[1] > 3 and k[0] == 1} == {(1, 6): (6.5, 4), (1, 7): (8.25, 5), (1, 4): (7.125, 6)}
    got = run([(9, 5000, 1, 1), (10, 4990, 2, 7)], 2)  # all that waited is due; key 2 has been idle
    assert got[1, 8] == (4.5625, 7) and (1, 9) not in got and (2, 10) not in got
    got = run([(11, 9000, 1, 3)], 3)
    assert got[2, 10] == (7, 1) and got[1, 9] == (1, 1) and (1, 90) not in got
    assert len(got) == 10


def test_land_gives_one_frame_a_batch(spark, tmp_path):
    frames = [spark.createDataFrame([(k, k)], "event_id long, x long") for k in range(3)]
    stream = op.land(frames, f"file://{tmp_path}/landed")
    seen = []
    stream.writeStream.foreachBatch(lambda b, n: seen.append([r["event_id"] for r in b.collect()])).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination()
    assert seen == [[0], [1], [2]]


def test_land_in_several_files(spark, tmp_path):
    """Each batch is its frame, whole, also where a frame has fewer rows than files."""
    frames = [spark.range(lo, hi).toDF("event_id") for lo, hi in ((0, 100), (100, 102), (102, 102), (102, 150))]
    stream, seen = op.land(frames, f"file://{tmp_path}/landed", 4), []
    stream.writeStream.foreachBatch(lambda b, n: seen.append(sorted(r["event_id"] for r in b.collect()))).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination()
    assert seen == [list(range(100)), [100, 101], [], list(range(102, 150))]
    assert all(len(list((tmp_path / "landed" / f"batch={k}").glob("part-*"))) == 4 for k in range(4))


def test_running_mean_keeps_states_with_its_rows(spark, tmp_path):
    """No call for each key's state; a store of maps and timers takes several for every key and batch."""
    df = spark.createDataFrame([], "event_id long, ts timestamp, user_id long, value double")
    df.write.parquet(f"{tmp_path}/landed")
    made = op.running_mean(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/landed"), "user_id", "ts", "value", 3, "60 minutes", 1000)
    assert "TransformWithState" not in made._jdf.queryExecution().logical().toString()
