"""The engine's models over the driver's tables, in Spark and, for the oracles, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers: the first line is the title, the text the abstract, the language the category."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ordinal"),
        F.col("doc_id").cast("string").alias("paper_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("abstract"),
        F.array("lang").alias("categories"),
        "lang",
        "source",
        (2012 + F.pmod("doc_id", F.lit(18))).cast("int").alias("year"),
        "n_chars",
    )


PAPERS = (
    "papers AS (SELECT doc_id AS ordinal, CAST(doc_id AS VARCHAR) AS paper_id, split_part(text, chr(10), 1) AS title, text AS abstract, "
    "lang, source, CAST(2012 + doc_id % 18 AS INTEGER) AS year, n_chars FROM documents)"
)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as citing papers, parts as cited ones."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("citing_id"), F.col("l_partkey").cast("string").alias("cited_id"), "l_quantity")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cited part its citations; every seventh part is unknown to the snapshot."""
    e = table(spark, sf_dir, "lineitem").where("l_partkey % 7 <> 0").groupBy("l_partkey")
    return e.agg(F.count("*").alias("citation_count"), F.count_if(F.col("l_quantity") > 40).alias("influential_count")).select(
        F.col("l_partkey").cast("string").alias("paper_id"), "citation_count", "influential_count", F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("tldr")
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("ordinal"), F.col("p_partkey").cast("string").alias("paper_id"), F.col("p_name").alias("title"), F.col("p_size").alias("year"))


CITATIONS = (
    "citations AS (SELECT CAST(l_partkey AS VARCHAR) AS paper_id, count(*) AS citation_count, count(*) FILTER (WHERE l_quantity > 40) AS influential_count, "
    "'part ' || CAST(l_partkey AS VARCHAR) AS tldr FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY l_partkey), "
    "parts AS (SELECT p_partkey AS ordinal, CAST(p_partkey AS VARCHAR) AS paper_id, p_name AS title, p_size AS year FROM part)"
)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with sections: each document's lines in runs of 12 as one section."""
    d = papers(spark, sf_dir).withColumn("lines", F.split("abstract", "\n"))
    n = F.ceil(F.size("lines") / 12).cast("int")
    s = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(F.concat(F.lit("Part "), i.cast("string")).alias("heading"), i.cast("string").alias("section_num"), F.array_join(F.slice("lines", i * 12 + 1, F.lit(12)), "\n").alias("text")),
    )
    return d.select("paper_id", strip(F.col("title")).alias("abstract"), s.alias("sections"), "title", "year")
