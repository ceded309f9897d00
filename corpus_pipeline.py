"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and decides for itself; all but the last return
docs' own columns, whatever they are. Rows are told apart by their doc_id and text, never by doc_id alone. Null texts count
as empty, except for language ID, which rejects them with all texts without a letter; rows without a doc_id take part
like all others and give way to rows that have one; repeated rows of one doc_id and text leave each de-duplicating stage as
one row (of those with other columns that differ, the least row); empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.byte_bpe import encode_documents, public_vocabulary
from paperloom.llm.common import table, words_of, written
from paperloom.llm.exact_dedup import build_index, digests
from paperloom.llm.language_id import UND, fitted, identify
from paperloom.llm.mixing import mix, shuffled
from paperloom.llm.ngram_join import near_duplicates

#: Below this posterior no language is clearly likelier than the others together.
LEAST_POSTERIOR = 0.5
#: Names of helper columns, unlike any column of documents.
PRED, SCORE, KEY, ROW = "__language", "__posterior", "__row_key", "__row"


def _key(*parts: str | Column) -> Column:
    return F.concat_ws(":", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts))


def _one_of_each(docs: DataFrame, key: Column, stay: DataFrame) -> DataFrame:
    """One row of docs for each key in stay (one column KEY). The texts are dealt by key once, for the join and the choice."""
    rows = docs.select(key.alias(KEY), F.struct(*docs.columns).alias(ROW)).join(stay, KEY, "left_semi")
    return rows.groupBy(KEY).agg(F.min(ROW).alias(ROW)).select(f"{ROW}.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a clear language."""
    out = identify(docs, fitted(docs), (PRED, SCORE))
    return out.where((F.col(PRED) != UND) & (F.col(SCORE) >= LEAST_POSTERIOR)).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    index = build_index(written(digests(docs), "digests"))
    own = digests(docs.withColumn(ROW, F.struct(*docs.columns)), ROW)
    stay = index.select(_key("text_sha256", "keep_id").alias(KEY))
    rows = own.select(_key("text_sha256", "doc_id").alias(KEY), ROW).join(stay, KEY, "left_semi")
    return rows.groupBy(KEY).agg(F.min(ROW).alias(ROW)).select(f"{ROW}.*")


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by near-duplicate links the one with the smallest doc_id stays."""
    rows = written(near_duplicates(docs).select("doc_id", "text_key", "component"), "near")
    first = F.min_by(F.struct("doc_id", "text_key"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    groups = rows.where("component is not null").groupBy("component").agg(first.alias("x")).select("x.*")
    alone = rows.where("component is null").select("doc_id", "text_key").distinct()
    stay = groups.unionAll(alone).select(_key("text_key", "doc_id").alias(KEY))
    return _one_of_each(docs, _key(F.xxhash64("text"), "doc_id"), stay)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents drawn to the sources' targets, some not at all and some twice, shard by shard in each shard's order."""
    name = _key(F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *docs.columns))
    keyed = docs.select(name.alias(KEY), F.struct(*docs.columns).alias(ROW))
    sizes = docs.select(name.alias("id"), "source", F.size(words_of(F.col("text"))).cast("long").alias("size"))
    drawn = mix(sizes, block_words=None).select(F.col("id").alias(KEY), "shard", "shard_order")
    # equal rows are one row here, drawn as often as they are there
    once = keyed.groupBy(KEY).agg(F.first(ROW).alias(ROW))
    return shuffled(once.join(drawn, KEY)).select(f"{ROW}.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids."""
    return encode_documents(docs, *public_vocabulary())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("mixing", mixing),
    ("byte_bpe", byte_bpe),
]

#: Language models, draws and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
