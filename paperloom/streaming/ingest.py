"""Incremental jobs as Structured Streaming: ingestion, chunking, ledger loads, embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators.index import embed_missing


def new_papers(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark; state is dropped beyond it, and a ledger load catches later repeats."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def load_batch(batch: DataFrame, target: str, key: str) -> None:
    """Appends the keys that the target lacks: a batch that runs twice appends nothing more."""
    schema = ", ".join(f"`{n}` {t}" for n, t in batch.dtypes)
    have = read_or_empty(batch.sparkSession, target, schema).select(key)
    batch.dropDuplicates([key]).join(have, key, "left_anti").write.mode("append").parquet(target)


def start_ledger(stream: DataFrame, target: str, key: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(lambda batch, _: load_batch(batch, target, key))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_embedding(chunks: DataFrame, target: str, checkpoint: str, encoder: Callable | None = None) -> StreamingQuery:
    """Embeds chunks that the target has no vector of, batch by batch."""

    def each(batch: DataFrame, _: int) -> None:
        have = read_or_empty(batch.sparkSession, target, "chunk_id string, embedding array<double>")
        embed_missing(batch.dropDuplicates(["chunk_id"]), have, encoder).write.mode("append").parquet(target)

    return chunks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 10, **options) -> DataFrame:
    """A stream over Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).options(**options).parquet(path)


def event_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Arrivals per event-time window and type; late rows within the watermark count."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
