import random

import pytest
from pyspark.sql import functions as F

from lorekeep.streaming import event_time, state

SCHEMA = "k string, ts timestamp, i int, logged int, paused boolean"
END = 100_000.0


def made(rng, n=240):
    """Events of a few keys with ties, a null key and null inputs, and one of a key of its own at the end of time."""
    rows = [(rng.choice(["a", "b", "c", None]), float(rng.randrange(0, 4000)) + rng.choice([0.0, 0.0005]), i, rng.choice([5, 10, 20, None]), rng.choice([True, False, None])) for i in range(n)]
    return rows, ("end", END, n, 0, False)


def write(spark, rows, folder):
    df = spark.createDataFrame([(k, t, i, l, p) for k, t, i, l, p in rows], "k string, s double, i int, logged int, paused boolean")
    df.select("k", F.timestamp_micros(F.round(F.col("s") * 1e6).cast("long")).alias("ts"), "i", "logged", "paused").coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, batches, fold, delay="2 hours"):
    """Each batch is a run of the stream of its own: the state goes on from the checkpoint."""
    for rows in batches:
        write(spark, rows, str(tmp_path / "in"))
        stream = event_time.folded(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "k", "ts", fold, ("i",), delay=delay)
        out = event_time.run_available(stream, str(tmp_path / "out"))
    return out.filter("k IS NULL OR k <> 'end'")


@pytest.mark.parametrize("cuts", [1, 3])
def test_shuffled_rows_in_any_batches_give_the_batch_form(spark, tmp_path, cuts):
    rng = random.Random(cuts)
    rows, end = made(rng)
    rng.shuffle(rows)
    batches = [rows[j::cuts] for j in range(cuts)] + [[end]]
    got = run(spark, tmp_path, batches, event_time.dedup(300.0))
    events = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in")).filter("k IS NULL OR k <> 'end'").withColumn("at", F.unix_micros("ts") / 1e6)
    want = state.dedup_window(events, "k", "at", 300.0, ("i",))
    pick = lambda df: sorted((r.i, r.accepted) for r in df.collect())
    assert pick(got) == pick(want) and got.count() == len(rows)


def test_reviews_and_journals_of_a_stream(spark, tmp_path):
    rng = random.Random(5)
    rows, end = made(rng, 160)
    rows = [(k, t + i * 1e-6, i, l, p) for k, t, i, l, p in rows]  # no ties: the batch form of reviews has no order for them
    rng.shuffle(rows)
    batches = [rows[::2], rows[1::2], [end]]
    events = lambda p: spark.read.schema(SCHEMA).parquet(str(p / "in")).filter("k IS NULL OR k <> 'end'")
    got = run(spark, tmp_path / "r", batches, event_time.review("logged", "paused", 5, 10))
    want = state.review_cadence(events(tmp_path / "r"), "k", "ts", "logged", 5, 10, "paused")
    pick = lambda df, *c: sorted(tuple(r[n] for n in ("i", *c)) for r in df.collect())
    assert pick(got, "fires", "notice") == pick(want, "fires", "notice") and any(r.fires for r in got.collect())
    got = run(spark, tmp_path / "j", batches, event_time.journal(7))
    assert pick(got, "turn_count", "fires") == pick(state.journal_cadence(events(tmp_path / "j"), "k", ["ts", "i"], 7), "turn_count", "fires")


def test_state_goes_once_it_cannot_matter(spark, tmp_path):
    run(spark, tmp_path, [[("a", 10.0, 1, 0, False), ("b", 20.0, 2, 0, False)], [("end", END, 3, 0, False)], [("end", 3 * END, 4, 0, False)]], event_time.dedup(300.0), "1 hour")
    kept = spark.read.format("statestore").option("stateVarName", "now").load(str(tmp_path / "out" / "checkpoint"))
    assert {r.key.k for r in kept.collect()} <= {"end"}


def test_late_rows_and_rows_without_time_are_left_out(spark, tmp_path):
    got = run(spark, tmp_path, [[("a", 5000.0, 1, 0, False), ("a", None, 2, 0, False)], [("end", END, 3, 0, False)], [("a", 6000.0, 4, 0, False), ("end", 3 * END, 5, 0, False)]], event_time.dedup(300.0), "1 minute")
    assert [(r.i, r.accepted) for r in got.collect()] == [(1, True)]


def test_the_setting_of_the_session_is_put_back(spark):
    before = spark.conf.get(event_time._PROVIDER)
    with event_time.rocksdb(spark):
        assert "RocksDB" in spark.conf.get(event_time._PROVIDER)
    assert spark.conf.get(event_time._PROVIDER) == before


def test_key_and_time_cannot_be_kept_twice(spark):
    with pytest.raises(ValueError):
        event_time.folded(spark.createDataFrame([], SCHEMA), "k", "ts", event_time.dedup(), ("ts",))
