"""A ledger of keys that streams load, dealt by key, and first-seen rows with state of its own."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

#: The directory column of a ledger.
BUCKET = "ledger_bucket"
#: Columns of a first-seen stream on its way: the key as text, and its time in milliseconds.
KEY, AT = "ledger_key", "ledger_at"
#: Buckets of keys that first-seen rows share their state in.
BUCKETS = 1024


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def load_keyed(batch: DataFrame, target: str, key: str, time: str, buckets: int) -> int:
    """Appends the rows whose key the ledger lacks, of rows with one key the earliest, and returns how many buckets were read.

    The ledger lies in directories by the hash of the key. A batch reads the directories of its own keys (at most `buckets` numbers reach the driver),
    so what it reads follows the batch and not the ledger. A batch that runs twice appends nothing more.
    Rows without a key are left out; a null time comes last.
    """
    spark, columns = batch.sparkSession, batch.columns
    row = F.struct(F.col(time).isNull().alias("late"), F.col(time).alias("at"), F.struct(*columns).alias("row"))
    first = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("x")).select("x.row.*").withColumn(BUCKET, bucket_of(key, buckets))
    first = first.persist()
    try:
        wanted = sorted(r[0] for r in first.select(BUCKET).distinct().collect())
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(target)
        fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        there = [b for b in wanted if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{target}/{BUCKET}={b}"))]
        new = first
        if there:
            have = spark.read.schema(batch.schema).parquet(*(f"{target}/{BUCKET}={b}" for b in there)).select(key)
            new = first.join(have, key, "left_anti")
        new.select(*columns, BUCKET).repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(target)
        return len(there)
    finally:
        first.unpersist()


def start_keyed_ledger(stream: DataFrame, target: str, key: str, time: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    def each(batch: DataFrame, _: int) -> None:
        load_keyed(batch, target, key, time, buckets)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_ledger(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField(BUCKET, IntegerType())])).parquet(target).drop(BUCKET)


class FirstSeen(StatefulProcessor):
    """Each key's earliest row of its first batch; repeats are dropped until the key has been silent for some time, as event time goes.

    The keys of a bucket share one state: an Arrow table of each key and when it ends, and one timer at the first end. So calls to the
    state store follow the buckets and not the keys.
    """

    def __init__(self, time: str, silent_ms: int) -> None:
        self.time, self.silent_ms = time, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "timer long, keys binary")

    def _read(self) -> tuple[int | None, pd.Series]:
        """The bucket's timer, and the end of each of its keys."""
        state = self.seen.get()
        if state is None:
            return None, pd.Series([], index=pd.Index([], dtype=object), dtype="int64")
        t = pa.ipc.open_stream(bytes(state[1])).read_all()
        return state[0], pd.Series(t.column("until").to_numpy(), index=pd.Index(t.column("key").to_pylist(), dtype=object))

    def _write(self, timer: int, ends: pd.Series) -> None:
        t = pa.table({"key": pa.array(list(ends.index), pa.string()), "until": pa.array(ends.to_numpy(), pa.int64())})
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, t.schema) as writer:
            writer.write_table(t)
        self.seen.update((timer, out.getvalue().to_pybytes()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        timer, known = self._read()
        ends = [known]
        for frame in rows:
            ends.append(frame.groupby(KEY)[AT].max() + self.silent_ms)
            both = frame if first is None else pd.concat([first, frame], ignore_index=True)
            first = both.sort_values(self.time, kind="stable").drop_duplicates(KEY)
        now = pd.concat(ends).groupby(level=0, sort=False).max()
        end = int(now.min())
        if timer is None or end < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(end)
            timer = end
        self._write(timer, now)
        new = first[~first[KEY].isin(known.index)]
        if len(new):
            yield new.drop(columns=[BUCKET, KEY, AT])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, known = self._read()
        left = known[known >= timerValues.getCurrentWatermarkInMs()]
        if len(left):
            end = int(left.min())
            self.handle.registerTimer(end)
            self._write(end, left)
        else:
            self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, key: str, time: str, late: str = "1 hour", silent_ms: int = 86_400_000, buckets: int = BUCKETS) -> DataFrame:
    """Each key once, until event time has passed its last row by silent_ms; then its state goes and it counts as new.

    Rows later than the watermark are dropped by it; a keyed ledger behind this stream catches keys that come back. Null times never pass.
    Keys are dealt to buckets; a batch reads and writes the state of the buckets that its keys are in. A null key is a key of its own.
    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = stream.where(F.col(time).isNotNull()).withWatermark(time, late)
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    rows = rows.withColumns({KEY: name, AT: F.unix_millis(time), BUCKET: F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")})
    return rows.groupBy(BUCKET).transformWithStateInPandas(FirstSeen(time, silent_ms), stream.schema, "Append", "EventTime")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession):
    """Streams that start meanwhile keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)
