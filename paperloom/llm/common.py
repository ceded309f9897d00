"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def without(text: Column, characters: str, instead: str = "") -> Column:
    """text with each of a few characters replaced."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(instead))
    return text


def words_of(text: Column) -> Column:
    """All runs of characters that are not white space; none for null."""
    return F.filter(F.split(without(F.coalesce(text, F.lit("")), "\n\t\x0b\f\r", " "), " "), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share.

    The cluster names it in spark.checkpoint.dir. Where that is unset, a folder below the warehouse is taken
    on a single machine (tests); on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: lineage ends there, lost executors cost nothing."""
    return Rounds().written(df, what)


class Rounds:
    """Tables of a loop: when the next one is written, the one before it is removed."""

    def __init__(self) -> None:
        self.path = None

    def written(self, df: DataFrame, what: str) -> DataFrame:
        spark, old = df.sparkSession, self.path
        self.path = scratch(spark, what)
        df.write.parquet(self.path)
        if old:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        return spark.read.schema(df.schema).parquet(self.path)


def in_slices(batch: pa.RecordBatch, column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have at most so many bytes together; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(sizes.searchsorted(before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a long, b long): rows (node, component), the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014), until nothing changes. Each round hangs
    neighbours on the smallest known one, so a hub never gathers its neighbours in one row, and the number of
    edges does not grow. Each round is written out; only a checksum of the edges reaches the driver.
    """
    kept, minima = Rounds(), Rounds()
    now = kept.written(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before = settled = None
    while not settled:
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join below has two plain exchanges and adaptive execution can split a hub's rows
        least = minima.written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        # large star: each larger neighbour of a goes to a's smallest
        large = (
            both.join(least, "a")
            .where("b > a and b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        # small star: each smaller neighbour of a, and a itself, goes to a's smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        now = kept.written(small, "edges")
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
        settled, before = mark == before, mark
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(nodes.select("component", "component").toDF("node", "component").distinct())
