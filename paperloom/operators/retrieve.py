"""Hybrid retrieval over tables of queries: dense, sparse, fusion, caps, expansion, merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import top_k
from .lineage import cut, sent

#: Numbers in a block of vectors or of query vectors: a task holds one block of each.
BLOCK_NUMBERS = 1 << 22
#: Queries scored together within a task.
TILE = 128


def cut_best(rows: pa.Table, k: int) -> pa.Table:
    """The first k rows of each query by score, then id."""
    rows = rows.sort_by([("query_id", "ascending"), ("score", "descending"), ("id", "ascending")])
    if not rows.num_rows:
        return rows
    codes = rows.column("query_id").combine_chunks().dictionary_encode()
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    rank = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    return rows.filter(pa.array(rank < k))


def matrix(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    column = t.column("embedding")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)


def best_products(left: pa.Table, right: pa.Table, k: int, digits: int) -> pa.Table:
    """(query_id, id, score): of vectors (id, embedding) the best k for each query (query_id, embedding)."""
    found = [pa.table({"query_id": right.column("query_id").slice(0, 0), "id": left.column("id").slice(0, 0), "score": pa.array([], pa.float64())})]
    if left.num_rows and right.num_rows:
        e, m = matrix(left), matrix(right)
        for a in range(0, len(m), TILE):
            scores = np.round(e @ m[a : a + TILE].T, digits)
            last = min(k, len(e))
            worst = -np.partition(-scores, last - 1, axis=0)[last - 1]
            row, col = np.nonzero(scores >= worst)  # ties at the edge are kept for the total order
            found.append(pa.table({"query_id": right.column("query_id").take(pa.array(col + a)), "id": left.column("id").take(pa.array(row)), "score": pa.array(scores[row, col])}))
    return cut_best(pa.concat_tables(found), k)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together until they have so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 5, best_of: Callable = best_products, more: tuple[str, ...] = (), at_once: int = 1) -> DataFrame:
    """(query_id, id, score, rank): exact best k by dot product of unit vectors.

    best_of says which vectors of a block are looked at for which queries: all, or those that an index finds by columns `more` of the
    vectors. It gets at least at_once vectors together, where a task has them.

    vectors: id, embedding; queries: query_id, embedding. Vectors of another dimension than the queries', or null, match
    nothing. Queries that fit one block (BLOCK_NUMBERS numbers, 32 MB) go to every task, and vectors are mapped where they lie. More
    queries are dealt in blocks of that size and vectors too, and each block of vectors meets each block of queries in
    one task. Either way a task keeps its best k per query and only these are ranked over the cluster.
    """
    kinds = dict(vectors.dtypes)["id"], dict(queries.dtypes)["query_id"]
    seen = queries.agg(F.max(F.size("embedding")).alias("dims"), F.count("*").alias("n")).first()
    dims = max(1, seen["dims"] or 1)
    rows = max(1, BLOCK_NUMBERS // dims)
    q_blocks = -(-seen["n"] // rows) or 1
    fits, schema = F.size("embedding") == dims, f"query_id {kinds[1]}, id {kinds[0]}, score double"
    if q_blocks == 1:
        asked = queries.where(fits).select("query_id", "embedding").toArrow()

        def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for block in gathered(batches, at_once):
                own = best_of(block, asked, k, digits)
                best = own if best is None else cut_best(pa.concat_tables([best, own]), k)
            yield from [] if best is None else best.to_batches()

        out = vectors.where(fits).select("id", "embedding", *more).mapInArrow(running, schema)
    else:
        v_blocks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // rows))

        def dealt(d: DataFrame, name: str, own: str, blocks: int, other: str, others: int, *kept: str) -> DataFrame:
            d = d.where(fits).select(name, "embedding", *kept, F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int").alias(own))
            return d.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

        v = dealt(vectors, "id", "vb", v_blocks, "qb", q_blocks, *more)
        q = dealt(queries, "query_id", "qb", q_blocks, "vb", v_blocks)
        out = v.groupBy("vb", "qb").cogroup(q.groupBy("vb", "qb")).applyInArrow(lambda x, y: best_of(x, y, k, digits), schema)
    return top_k(out, ["query_id"], [F.desc("score"), F.col("id")], k)


def fuse(dense: DataFrame, sparse: DataFrame, k: int = 60, dense_weight: float = 2.0, digits: int = 6) -> DataFrame:
    """Weighted reciprocal ranks of two rankings (query_id, id, score, rank), with the scores of both (0 if absent)."""
    d = dense.select("query_id", "id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    s = sparse.select("query_id", "id", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    rrf = F.coalesce(dense_weight / (k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("bm25_rank")), F.lit(0.0))
    j = d.join(s, ["query_id", "id"], "full").withColumn("rrf", F.round(rrf, digits))
    return j.withColumns({"dense_score": F.coalesce("dense_score", F.lit(0.0)), "bm25_score": F.coalesce("bm25_score", F.lit(0.0))})


def _order() -> list:
    return [F.desc("rrf"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), F.col("id")]


def diversify(fused: DataFrame, group: str, k: int, per_group: int = 1) -> DataFrame:
    """At most per_group rows of one paper per query, then the best k."""
    capped = top_k(fused, ["query_id", group], _order(), per_group, "group_rank").drop("group_rank")
    return top_k(capped, ["query_id"], _order(), k)


# The fields of a retrieved row.
#: A retrieved row, beside query_id: the chunk, its paper, its context, and how it was found.
RESULT = (
    "id", "paper_id", "title", "section", "section_heading", "year", "text", "char_count", "parent_chunk_id", "extraction_method",
    "citation_count", "influential_count", "dense_score", "bm25_score", "rrf", "method", "tldr",
)


def _or(d: DataFrame, name: str, default) -> Column:
    """A column or, where it is absent or null, a default."""
    return F.coalesce(F.col(name), F.lit(default)) if name in d.columns else F.lit(default)


def _meta(papers: DataFrame) -> DataFrame:
    counts = (_or(papers, c, 0).cast("long").alias(c) for c in ("citation_count", "influential_count"))
    return papers.select("paper_id", _or(papers, "title", "").alias("title"), _or(papers, "abstract", "").alias("abstract"), _or(papers, "year", 0).cast("int").alias("paper_year"), *counts, _or(papers, "tldr", "").alias("tldr"))


def expand(hits: DataFrame, chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """RESULT rows of hits (query_id, id and scores): their own chunk or, failing that, what the id says; parent text; else the paper's abstract.

    chunks may lack section_heading, year and extraction_method, papers the counts and tldr; numbers are then 0 and texts empty.
    """
    from ..functions.ids import parent_of, parse

    fields = {"section": "", "section_heading": "", "year": 0, "extraction_method": ""}
    # hits are few beside chunks and papers, of which only the rows that they name are dealt
    hits = cut(hits)
    ids = cut(hits.select("id", parent_of(F.col("id")).alias("parent")).distinct())
    named = sent(ids.select(F.explode(F.array("id", "parent")).alias("chunk_id")).where("chunk_id is not null").distinct())
    chunks = chunks.join(named, "chunk_id", "left_semi")
    own = chunks.select(F.col("chunk_id").alias("id"), F.col("paper_id").alias("own_paper"), *(_or(chunks, c, v).alias(f"own_{c}") for c, v in fields.items()))
    d = hits.join(own, "id", "left").withColumn("parsed", parse(F.col("id"))).withColumn("parent_chunk_id", parent_of(F.col("id")))
    d = d.where(F.col("own_paper").isNotNull() | (F.size(F.split("id", "::")) >= 3))
    d = d.withColumn("paper_id", F.coalesce("own_paper", "parsed.paper_id"))
    d = cut(d)
    papers = papers.join(sent(d.select("paper_id").distinct()), "paper_id", "left_semi")
    parents = chunks.where("chunk_type = 'parent'").select(
        F.col("chunk_id").alias("parent_chunk_id"), F.col("text").alias("parent_text"), F.col("section").alias("parent_section"), _or(chunks, "section_heading", "").alias("parent_section_heading")
    )
    d = d.join(parents, "parent_chunk_id", "left").join(_meta(papers), "paper_id", "left")
    text = F.when(F.col("parent_chunk_id").isNotNull(), F.coalesce("parent_text", F.lit(""))).otherwise(F.coalesce("abstract", F.lit("")))
    row = {
        "title": F.coalesce("title", F.lit("")),
        "section": F.coalesce("parent_section", "own_section", F.lit("")),
        "section_heading": F.coalesce("parent_section_heading", "own_section_heading", F.lit("")),
        "year": F.coalesce(F.col("own_year").cast("int"), F.lit(0)),
        "text": text,
        "char_count": F.length(text),
        "parent_chunk_id": F.coalesce("parent_chunk_id", F.lit("")),
        "extraction_method": F.coalesce("own_extraction_method", F.lit("")),
        "citation_count": F.coalesce("citation_count", F.lit(0)),
        "influential_count": F.coalesce("influential_count", F.lit(0)),
        **{c: _or(hits, c, 0.0).cast("double") for c in ("dense_score", "bm25_score", "rrf")},
        "method": F.lit("hybrid"),
        "tldr": F.coalesce("tldr", F.lit("")),
    }
    return d.select("query_id", "id", "paper_id", *(v.alias(c) for c, v in row.items()))


def abstract_supplement(results: DataFrame, papers: DataFrame) -> DataFrame:
    """One more RESULT row per retrieved paper with an abstract; scores are 0."""
    named = results.select("query_id", "paper_id").distinct()
    papers = papers.join(sent(named.select("paper_id").distinct()), "paper_id", "left_semi")
    d = named.join(_meta(papers).where("trim(abstract) <> ''"), "paper_id")
    row = {
        "id": F.concat("paper_id", F.lit("::abstract")),
        "paper_id": F.col("paper_id"),
        "title": F.col("title"),
        "section": F.lit("ABSTRACT"),
        "section_heading": F.lit("Abstract"),
        "year": F.col("paper_year"),
        "text": F.col("abstract"),
        "char_count": F.length("abstract"),
        "parent_chunk_id": F.lit(""),
        "extraction_method": F.lit("metadata"),
        "citation_count": F.col("citation_count"),
        "influential_count": F.col("influential_count"),
        **{c: F.lit(0.0) for c in ("dense_score", "bm25_score", "rrf")},
        "method": F.lit("abstract_supplement"),
        "tldr": F.col("tldr"),
    }
    return d.select("query_id", *(v.alias(c) for c, v in row.items()))


# How many dense, sparse and final rows a first round and a retry take.
BREADTHS = ((10, 10, 10), (20, 20, 15))


def breadth(iteration: Column, which: int) -> Column:
    """How many dense (0), sparse (1) or final (2) rows a query takes in its round."""
    return F.when(iteration == 0, BREADTHS[0][which]).otherwise(BREADTHS[1][which])


def retrieve(dense: DataFrame, sparse: DataFrame, chunks: DataFrame, papers: DataFrame, k: int = 12, include_abstracts: bool = False, rounds: DataFrame | None = None) -> DataFrame:
    """The whole: fuse, cap, expand, supplement. rounds (query_id, iteration) gives each query the breadths of its round in place of k."""
    if rounds is not None:
        rounds = rounds.select("query_id", "iteration")
        cut_ = lambda d, which: d.join(rounds, "query_id").where(F.col("rank") <= breadth(F.col("iteration"), which)).drop("iteration")
        dense, sparse, k = cut_(dense, 0), cut_(sparse, 1), max(b[2] for b in BREADTHS)
    fused = fuse(dense, sparse)
    ids = F.split("id", "::")[0]
    hits = diversify(fused.withColumn("paper_key", ids), "paper_key", k).drop("paper_key")
    out = expand(hits if rounds is None else cut_(hits, 2), chunks, papers)
    return out.unionByName(abstract_supplement(out, papers)) if include_abstracts else out


def merge_rounds(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of two rounds (query_id, id, rrf, ...), new ones winning; a query without new rows keeps its old ones."""
    both = previous.withColumn("round", F.lit(0)).unionByName(new.withColumn("round", F.lit(1)))
    kept = top_k(both, ["query_id", "id"], [F.desc("round")], 1, "r").drop("r")
    return top_k(kept, ["query_id"], [F.desc("rrf"), F.col("id")], 1 << 30).drop("round")


def coverage(query: Column, text: Column) -> Column:
    """Share of the query's distinct words, split at white space, that the text has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    return F.coalesce(F.size(F.array_intersect(words(query), words(text))) / F.greatest(F.size(words(query)), F.lit(1)), F.lit(0.0))


def rerank(pairs: DataFrame, k: int, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """The best k of each query's pool (query_id, id, query, text) by a pair score; default: share of query words found."""
    if scorer is None:
        d = pairs.select("query_id", "id", coverage(F.col("query"), F.col("text")).alias("pair_score"))
        return top_k(d, ["query_id"], [F.desc("pair_score"), F.col("id")], k)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"query_id": f.query_id, "id": f.id, "pair_score": scorer(f["query"], f.text)})

    kinds = dict(pairs.dtypes)
    d = pairs.select("query_id", "id", "query", "text").mapInPandas(run, f"query_id {kinds['query_id']}, id {kinds['id']}, pair_score double")
    return top_k(d, ["query_id"], [F.desc("pair_score"), F.col("id")], k)


def retrieval_stats(results: DataFrame) -> DataFrame:
    """Chunks and papers per query and method."""
    return results.groupBy("query_id", "method").agg(F.count("*").alias("n_chunks"), F.countDistinct("paper_id").alias("n_papers"))


def citation_cards(cited: DataFrame, papers: DataFrame, url: str) -> DataFrame:
    """Cards for (query_id, paper_id): title, first three authors, short abstract, link."""
    d = cited.join(papers, "paper_id")
    return d.select("query_id", "paper_id", "title", F.slice("authors", 1, 3).alias("authors"), F.substring("abstract", 1, 300).alias("abstract"), F.concat(F.lit(url), "paper_id").alias("url"))
