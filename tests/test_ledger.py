"""Streams with state of their own and a ledger dealt by key: restarts, late repeats, expiry, and what a batch reads."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from paperloom.streaming import ledger

START = datetime(2024, 1, 1)


def put(spark, path, *rows):
    rows = [(k, None if h is None else START + timedelta(hours=h), n) for k, h, n in rows]
    spark.createDataFrame(rows, "k string, ts timestamp, n int").coalesce(1).write.mode("append").parquet(path)


def test_first_seen_state(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))

    def run():  # each run starts again from the checkpoint
        s = spark.readStream.schema("k string, ts timestamp, n int").option("maxFilesPerTrigger", 1).parquet(src)
        with ledger.rocks(spark):
            q = ledger.first_seen(s, "k", "ts", "1 hour", 5 * 3_600_000).writeStream.format("parquet").option("path", out)
            q.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.n for r in spark.read.parquet(out).collect())

    put(spark, src, ("a", 0.5, 2), ("a", 0, 1), ("b", 1, 3), ("z", None, 9))
    assert run() == [1, 3]  # the earliest row of a key, no row without a time
    put(spark, src, ("a", 2, 4), ("c", 2, 5))
    assert run() == [1, 3, 5]  # known after a restart
    put(spark, src, ("d", 30, 6))
    run()
    put(spark, src, ("a", 31, 7), ("d", 31, 8))
    assert run() == [1, 3, 5, 6, 7]  # a's state had gone, d's had not


def test_keyed_ledger(spark, tmp_path):
    target = str(tmp_path / "ledger")
    frame = lambda *rows: spark.createDataFrame([(k, START + timedelta(hours=h), n) for k, h, n in rows], "k string, ts timestamp, n int")
    first = frame(*((f"k{i}", i % 7, i) for i in range(200)), ("k5", -1, 999), (None, 0, 0))
    assert ledger.load_keyed(first, target, "k", "ts", 32) == 0
    files = lambda: sum(1 for _ in (tmp_path / "ledger").rglob("*.parquet"))
    before = files()
    assert ledger.load_keyed(first, target, "k", "ts", 32) == 32 and files() == before  # again: nothing more
    for i in range(5):  # a batch of one new and one old key reads two directories, however often it comes
        assert ledger.load_keyed(frame((f"new{i}", 1, i), ("k7", 9, 1)), target, "k", "ts", 32) <= 2
    got = {r.k: r.n for r in ledger.read_ledger(spark, target, first.schema).collect()}
    assert len(got) == 205 and got["k5"] == 999 and got["k7"] == 7 and None not in got


def test_keyed_ledger_stream_restarts(spark, tmp_path):
    src, target, state = (str(tmp_path / x) for x in ("src", "ledger", "state"))

    def run():
        s = spark.readStream.schema("k string, ts timestamp, n int").option("maxFilesPerTrigger", 1).parquet(src)
        ledger.start_keyed_ledger(s, target, "k", "ts", state, buckets=4).awaitTermination()
        return {r.k: r.n for r in ledger.read_ledger(spark, target, s.schema).collect()}

    put(spark, src, ("a", 5, 1), ("b", 1, 2))
    assert run() == {"a": 1, "b": 2}
    put(spark, src, ("a", 0, 3), ("c", 1, 4))  # a late repeat changes nothing
    assert run() == {"a": 1, "b": 2, "c": 4}


def test_first_seen_state_follows_buckets(spark, tmp_path):
    """Many keys share few states and timers."""
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    spark.range(16_000).selectExpr("cast(id % 8000 as string) AS k", "timestamp_seconds(1704067200 + id) AS ts", "cast(id AS int) AS n").write.parquet(src)
    s = spark.readStream.schema("k string, ts timestamp, n int").parquet(src)
    with ledger.rocks(spark):
        q = ledger.first_seen(s, "k", "ts", "4000 days", 86_400_000).writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        q = q.trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == list(range(8000))
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) < 8000


def test_keys_of_one_bucket_end_apart(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))

    def run():
        s = spark.readStream.schema("k string, ts timestamp, n int").option("maxFilesPerTrigger", 1).parquet(src)
        with ledger.rocks(spark):
            q = ledger.first_seen(s, "k", "ts", "1 hour", 5 * 3_600_000, buckets=1).writeStream.format("parquet").option("path", out)
            q.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.n for r in spark.read.parquet(out).collect())

    put(spark, src, ("a", 0, 1), ("b", 4, 2), (None, 4, 3), (None, 3.5, 4))
    assert run() == [1, 2, 4]  # the null key is one of its own
    put(spark, src, ("b", 7.5, 5))
    assert run() == [1, 2, 4]  # a has ended, b has not
    put(spark, src, ("a", 7.6, 6), ("b", 7.7, 7), (None, 7.7, 8))
    assert run() == [1, 2, 4, 6]
    put(spark, src, ("c", 40, 9))
    assert run() == [1, 2, 4, 6, 9]  # now all others end
    put(spark, src, ("a", 40, 10), ("b", 40, 11), (None, 40, 12), ("c", 41, 13))
    assert run() == [1, 2, 4, 6, 9, 10, 11, 12]
