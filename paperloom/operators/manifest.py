"""Corpus statistics and the manifest row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distributions(papers: DataFrame) -> DataFrame:
    """Counts by year band, year and extraction method in one pass over grouping sets."""
    d = papers.select(F.coalesce("year_band", F.lit("unknown")).alias("year_band"), F.col("year").cast("string").alias("year"), "extraction_method")
    names = d.columns
    # grouping() is 0 for the column that a row counts by
    dimension = F.coalesce(*(F.when(F.grouping(c) == 0, c) for c in names))
    counts = d.groupingSets([[c] for c in names], *names).agg(dimension.alias("dimension"), F.count("*").alias("n"))
    return counts.select("dimension", F.coalesce(*names).alias("value"), "n")


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """Chunks per type, and in all."""
    return chunks.rollup("chunk_type").agg(F.count("*").alias("n")).select(F.coalesce("chunk_type", F.lit("total")).alias("chunk_type"), "n")


def manifest(papers: DataFrame, chunks: DataFrame, run_id: str, version: str) -> DataFrame:
    """One row with nested sections, every value computed."""
    p = papers.agg(F.struct(F.count("*").alias("n_papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year")).alias("corpus"))
    c = chunks.agg(
        F.struct(
            F.count_if(F.col("chunk_type") == "abstract").alias("abstract"),
            F.count_if(F.col("chunk_type") == "parent").alias("parent"),
            F.count_if(F.col("chunk_type") == "child").alias("child"),
            F.count("*").alias("total"),
        ).alias("chunks")
    )
    return p.crossJoin(c).select(F.lit(run_id).alias("run_id"), F.lit(version).alias("version"), "corpus", "chunks")
