"""Enrichment from citation snapshots, and citation statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import paper_id
from ..functions.sets import containment


def enrich(papers: DataFrame, citations: DataFrame) -> DataFrame:
    """Left join on paper_id with defaults and a status."""
    c = citations.select("paper_id", "citation_count", "influential_count", "tldr", F.lit("found").alias("status"))
    d = papers.join(c, "paper_id", "left")
    return d.withColumns(
        {
            "citation_count": F.coalesce("citation_count", F.lit(0)),
            "influential_count": F.coalesce("influential_count", F.lit(0)),
            "tldr": F.coalesce("tldr", F.lit("")),
            "status": F.coalesce("status", F.lit("not_found")),
        }
    )


def still_to_do(papers: DataFrame, ledger: DataFrame, only_found: bool = True) -> DataFrame:
    """Resume rule: skip papers already found, or any that the ledger has."""
    done = ledger.where("status = 'found'") if only_found else ledger
    return papers.join(done.select("paper_id"), "paper_id", "left_anti")


def match_titles(queries: DataFrame, candidates: DataFrame, over: float = 0.7, first: int = 3) -> DataFrame:
    """First of the `first` ranked candidates whose title has more than `over` of the query's words.

    queries: query_id, title; candidates: query_id, rank, candidate_id, title.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    d = candidates.where(F.col("rank") <= first).withColumnRenamed("title", "candidate_title").join(queries, "query_id")
    hit = containment(words(F.col("title")), words(F.col("candidate_title")))
    return d.withColumn("overlap", hit).where(F.col("overlap") > over).groupBy("query_id").agg(F.min_by(F.struct("candidate_id", "overlap"), "rank").alias("m")).select("query_id", "m.*")


def concept_tags(concepts: Column, first: int = 5, over: float = 0.3) -> Column:
    """Names of the first concepts with a score above the bound."""
    return F.transform(F.filter(F.slice(concepts, 1, first), lambda x: x["score"] > over), lambda x: x["display_name"])


def flatten_references(papers: DataFrame, most: int = 200) -> DataFrame:
    """(citing_id, cited_id) of the first `most` references that have an id, versions stripped."""
    d = papers.select(F.col("paper_id").alias("citing_id"), F.explode(F.slice("references", 1, most)).alias("r"))
    return d.where("r.id is not null and r.id <> ''").select("citing_id", paper_id(F.col("r.id")).alias("cited_id"))


def top_cited(papers: DataFrame, k: int) -> DataFrame:
    return papers.orderBy(F.desc("citation_count"), "ordinal").limit(k)


def citation_spread(papers: DataFrame) -> DataFrame:
    """Papers, upper median (element n // 2 of the descending list) and papers without citations.

    The median comes from counts per value, so no task sorts all papers.
    """
    counts = papers.groupBy("citation_count").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("citation_count") == 0, F.col("c"))), F.lit(0)).alias("zero"))
    above = Window.orderBy(F.desc("citation_count"))  # over distinct values only
    ranked = counts.withColumn("upto", F.sum("c").over(above)).crossJoin(total)
    return ranked.where(F.expr("upto > n div 2")).agg(F.max("n").alias("n_papers"), F.max("citation_count").alias("upper_median"), F.max("zero").alias("n_zero"))


def status_counts(papers: DataFrame) -> DataFrame:
    return papers.groupBy("status").agg(F.count("*").alias("n"), F.sum("citation_count").alias("citations"), F.sum("influential_count").alias("influential"))
