import pytest
from pyspark.sql import functions as F

from lorekeep.streaming import state


def test_window_is_anchored_at_the_last_accepted(spark):
    rows = [("a", t) for t in (0.0, 299.0, 300.0, 301.0, 600.0, 602.0)] + [("b", 5.0)]
    got = state.dedup_window(spark.createDataFrame(rows, "digest string, ts double")).orderBy("digest", "ts").collect()
    assert [r.accepted for r in got] == [True, False, False, True, False, True, True]


def test_debounce(spark):
    rows = [("a", t * 60.0) for t in (0, 29, 30, 45, 60)]
    assert [r.fired for r in state.debounce(spark.createDataFrame(rows, "k string, ts double"), "k", "ts", 30).orderBy("ts").collect()] == [True, False, True, False, True]
    assert [r.fired for r in state.debounce(spark.createDataFrame(rows, "k string, ts double"), "k", "ts", 1).orderBy("ts").collect()] == [True, True, False, True, True]  # five minutes at least


def test_cadence(spark):
    rows = spark.createDataFrame([("s", i) for i in range(25)], "sid string, i int")
    fired = [r.i for r in state.journal_cadence(rows, "sid", ["i"]).filter("fires").orderBy("i").collect()]
    assert fired == [9, 19]


def test_review_waits_for_logged_turns(spark):
    rows = [("s", float(i), 5 if i < 18 else 12, i > 30) for i in range(60)]
    df = spark.createDataFrame(rows, "sid string, ts double, logged int, paused boolean")
    got = state.review_cadence(df, "sid", "ts", "logged", paused="paused").orderBy("ts").collect()
    assert [r.ts for r in got if r.fires] == [18.0] and [r.ts for r in got if r.notice] == [33.0]


@pytest.mark.parametrize("steps", [[(0.0, 100.0, 301.0), (302.0, 700.0)]])
def test_stream_equals_batch(spark, tmp_path, steps):
    schema = "digest string, ts double"
    for i, part in enumerate(steps):
        spark.createDataFrame([("a", t) for t in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = state.stream_fold(stream, "digest", "ts", state.dedup_step()).writeStream.format("memory").queryName("dedup").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = state.dedup_window(spark.read.parquet(str(tmp_path / "in"))).select("ts", "accepted")
    assert sorted(map(tuple, spark.table("dedup").select("ts", "accepted").collect())) == sorted(map(tuple, batch.collect()))


def test_once_per_day(spark):
    df = spark.createDataFrame([("a", 1, "2024-01-01 01:00:00"), ("a", 2, "2024-01-01 02:00:00"), ("a", 3, "2024-01-02 00:00:00")], "k string, i int, t string").withColumn("ts", F.to_timestamp("t"))
    assert sorted(r.i for r in state.once_per_day(df, "k", "ts").collect()) == [1, 3]
