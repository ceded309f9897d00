"""Building a corpus: sampling, merging, routing and loading, as joins and ranks.

Bands, seeds and categories are small input tables; the optimiser broadcasts them by their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safe_count, safe_year
from .lineage import cut


def append_new(existing: DataFrame, candidates: DataFrame, start_year: int, categories: list[str], max_total: int) -> DataFrame:
    """Unknown candidates of a wanted category from start_year on, newest first, up to max_total papers in all."""
    room = max(0, max_total - existing.count())
    wanted = F.arrays_overlap("categories", F.array(*map(F.lit, categories)))
    new = candidates.join(existing.select("paper_id"), "paper_id", "left_anti").where((F.col("year") >= start_year) & wanted)
    return new.orderBy(F.desc("year"), "paper_id").limit(room)


def sample_bands(candidates: DataFrame, existing: DataFrame, bands: DataFrame, categories: list[str], min_abstract: int = 100) -> DataFrame:
    """Per year band the most relevant papers it still needs, looking at three times as many candidates.

    bands: label, start, end, target; candidates: paper_id, year, categories, abstract, relevance (smaller first).
    """
    in_band = lambda d: (d["year"] >= F.col("start")) & (d["year"] <= F.col("end"))
    have = existing.join(bands, in_band(existing)).groupBy("label").agg(F.count("*").alias("have"))
    need = bands.join(have, "label", "left").withColumn("need", F.greatest(F.col("target") - F.coalesce("have", F.lit(0)), F.lit(0)))
    w = Window.partitionBy("label").orderBy("relevance", "paper_id")
    need = cut(need)
    most = need.agg(F.max("need")).first()[0] or 0  # a fixed limit is applied before rows are dealt by band, so only these are
    seen = candidates.join(need, in_band(candidates)).withColumn("r", F.row_number().over(w))
    seen = seen.where((F.col("r") <= 3 * most) & (F.col("r") <= 3 * F.col("need")))
    fit = seen.join(existing.select("paper_id"), "paper_id", "left_anti").where(
        F.arrays_overlap("categories", F.array(*map(F.lit, categories))) & (F.length("abstract") >= min_abstract)
    )
    best = fit.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.col("need"))
    return best.select(*candidates.columns, F.col("label").alias("year_band"))


def backfill_seeds(corpus: DataFrame, catalogue: DataFrame, seeds: DataFrame) -> DataFrame:
    """The corpus and the seeds that it lacks, tagged."""
    new = catalogue.join(seeds.select("paper_id"), "paper_id", "left_semi").join(corpus.select("paper_id"), "paper_id", "left_anti")
    new = new.withColumns({"year_band": F.lit("foundational"), "is_seed": F.lit(True)})
    return corpus.unionByName(new, allowMissingColumns=True)


def band_counts(papers: DataFrame, bands: DataFrame) -> DataFrame:
    """Papers per band label, zero for empty bands; papers without a band are `unknown`."""
    n = papers.groupBy(F.coalesce("year_band", F.lit("unknown")).alias("label")).agg(F.count("*").alias("n"))
    return bands.select("label").join(n, "label", "full").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def keep_first(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of each key; equal rows are found with map-side combining of the least order."""
    columns = [c for c in rows.columns if c != key]
    packed = rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__r"))
    return packed.select(key, *(F.col(f"__r.`{c}`").alias(c) for c in columns)).select(*rows.columns)


def merge_chunks(structured: DataFrame, fallback: DataFrame) -> DataFrame:
    """Union by chunk_id; the structured source wins."""
    both = structured.withColumn("source_rank", F.lit(0)).unionByName(fallback.withColumn("source_rank", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, "chunk_id", "source_rank").drop("source_rank")


def route(papers: DataFrame, files: DataFrame, successes: DataFrame) -> DataFrame:
    """paper_id and route: primary (extracted), fallback (file only) of the papers that have a file."""
    targets = papers.select("paper_id").join(files.select("paper_id"), "paper_id", "left_semi")
    ok = successes.select("paper_id").distinct().withColumn("ok", F.lit(True))
    return targets.join(ok, "paper_id", "left").select("paper_id", F.when(F.col("ok"), "primary").otherwise("fallback").alias("route"))


def with_metadata(chunks: DataFrame, metadata: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Chunks with metadata columns; defaults where the paper is unknown."""
    d = chunks.join(metadata.select(key, *defaults), key, "left")
    return d.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def insert_or_ignore(target: DataFrame, rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows to append: the first of each new key. Applying it twice appends nothing more."""
    return keep_first(rows, key, *order).join(target.select(key), key, "left_anti")


def vectors_to_load(chunks: DataFrame, embeddings: DataFrame, ledger: DataFrame, index: str) -> DataFrame:
    """Chunks with an embedding that this index does not have yet."""
    done = ledger.where(F.col("index_name") == index).select("chunk_id")
    return chunks.join(done, "chunk_id", "left_anti").join(embeddings, "chunk_id")


def split_vectors(rows: DataFrame, dims: int, id_column: str = "chunk_id") -> DataFrame:
    """Adds error: why a vector can't be loaded; null for good ones."""
    error = (
        F.when(F.col(id_column).isNull(), "missing id")
        .when(F.col("embedding").isNull(), "missing embedding")
        .when(F.size("embedding") != dims, F.concat(F.lit("wrong dimension "), F.size("embedding").cast("string")))
    )
    return rows.withColumn("error", error)


def light_metadata(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """What goes beside a vector: short title and section, clean lists, whole counts, a year."""
    d = chunks.join(papers, "paper_id", "left")
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.cast("string")), lambda x: x.isNotNull())
    return d.select(
        "chunk_id",
        "paper_id",
        F.coalesce(F.substring("title", 1, 200), F.lit("")).alias("title"),
        F.coalesce(F.substring("section", 1, 100), F.lit("")).alias("section"),
        safe_year(F.col("year")).alias("year"),
        clean(F.col("categories")).alias("categories"),
        safe_count(F.col("citation_count")).alias("citation_count"),
    )


def summary(chunks: DataFrame) -> DataFrame:
    """Chunks and papers per type and extraction method."""
    return chunks.groupBy("chunk_type", "extraction_method").agg(F.count("*").alias("n_chunks"), F.countDistinct("paper_id").alias("n_papers"))
