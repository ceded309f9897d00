"""Validation of chunks, coverage and embedding audits, each in a single pass or a semi/anti join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.sets import norm
from ..functions.text import alpha_share, strip

REQUIRED = ("chunk_id", "paper_id", "chunk_type", "text", "title", "section", "year")


def blank(name: str) -> Column:
    return strip(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""


LISTS = ("authors", "categories")


def no_list(chunks: DataFrame, name: str) -> Column:
    """A metadata field that should be a list and is none. Fields come as arrays, or as raw JSON in strings; absent is fine."""
    if name not in chunks.columns or dict(chunks.dtypes)[name].startswith("array"):
        return F.lit(False)
    kind = F.schema_of_variant(F.try_parse_json(name))
    return F.coalesce(F.col(name).isNotNull() & ~F.startswith(F.coalesce(kind, F.lit("")), F.lit("ARRAY")), F.lit(False))


def checks(chunks: DataFrame) -> dict[str, tuple[str, Column]]:
    """Row checks: name -> (severity, condition). Rows without text skip those on the text and what describes it."""
    text = F.coalesce("text", F.lit(""))
    full = strip(text) != ""
    year = F.coalesce(F.col("year").cast("string"), F.lit(""))
    digits = F.rlike(year, F.lit(r"^\d+$"))
    return {
        "missing_parent": ("critical", (F.col("chunk_type") == "child") & (F.coalesce("parent_chunk_id", F.lit("")) == "")),
        "empty_text": ("critical", ~full),
        "too_short": ("warning", full & (F.length(strip(text)) < 50)),
        "symbol_heavy": ("warning", full & (alpha_share(text) < 0.40)),
        "missing_title": ("warning", full & blank("title")),
        "missing_section": ("warning", full & blank("section")),
        "invalid_year": ("warning", full & ~(digits & F.coalesce(year.try_cast("int").between(2014, 2027), F.lit(False)))),
        **{f"invalid_{name}_type": ("warning", full & no_list(chunks, name)) for name in LISTS},
    }


def validate(chunks: DataFrame) -> DataFrame:
    """Tidy report: check, severity, n. Duplicate ids count each repeat; orphans are children without a parent row."""
    sums = [F.count_if(c).alias(name) for name, (_, c) in checks(chunks).items()]
    sums += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in REQUIRED]
    flat = chunks.agg(*sums)
    names = [(n, s) for n, (s, _) in checks(chunks).items()] + [(f"null_{c}", "critical") for c in REQUIRED]
    tidy = flat.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.col(n).alias("n")) for n, s in names))).alias("x")).select("x.*")
    return tidy.unionAll(between_rows(chunks))


def between_rows(chunks: DataFrame) -> DataFrame:
    """The checks of validate() that compare rows."""
    twice = chunks.groupBy("chunk_id").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n"))
    orphans = orphan_children(chunks).agg(F.count("*").alias("n"))
    add = lambda d, n: d.select(F.lit(n).alias("check"), F.lit("critical").alias("severity"), "n")
    return add(twice, "duplicate_id").unionAll(add(orphans, "orphan_child"))


def observed(chunks: DataFrame, name: str = "chunk checks") -> tuple[DataFrame, Observation]:
    """chunks with the row checks of validate() counted as they pass: whatever writes them fills the observation."""
    o = Observation(name)
    sums = [F.count_if(c).alias(n) for n, (_, c) in checks(chunks).items()] + [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in REQUIRED]
    return chunks.observe(o, *sums, F.count("*").alias("rows")), o


def write_validated(chunks: DataFrame, path: str) -> DataFrame:
    """Writes chunks by type and returns validate()'s report on them: the row checks are counted while they are written.

    Repeated ids and orphans are facts about pairs of rows: they are counted afterwards from the written ids, types and parents, not from
    the texts. The chunks are computed once.
    """
    rows, o = observed(chunks)
    rows.write.mode("overwrite").partitionBy("chunk_type").parquet(path)
    spark, seen = chunks.sparkSession, o.get
    kinds = [(n, s) for n, (s, _) in checks(chunks).items()] + [(f"null_{c}", "critical") for c in REQUIRED]
    tidy = spark.createDataFrame([(n, s, seen[n]) for n, s in kinds], "check string, severity string, n long")
    return tidy.unionAll(between_rows(spark.read.schema(chunks.schema).parquet(path)))


def orphan_children(chunks: DataFrame, null_too: bool = False) -> DataFrame:
    """Children whose parent has no row; with null_too also those that name none."""
    children = chunks.where("chunk_type = 'child'")
    if not null_too:
        children = children.where("coalesce(parent_chunk_id, '') <> ''")
    parents = chunks.where("chunk_type = 'parent'").select(F.col("chunk_id").alias("parent_chunk_id"))
    return children.join(parents, "parent_chunk_id", "left_anti")


def verdict(report: DataFrame) -> DataFrame:
    """critical, warnings and a three-way verdict of a validate() report."""
    s = report.agg(F.sum(F.when(F.col("severity") == "critical", F.col("n")).otherwise(0)).alias("critical"), F.sum(F.when(F.col("severity") == "warning", F.col("n")).otherwise(0)).alias("warnings"))
    return s.withColumn("verdict", F.when(F.col("critical") > 0, "failed").when(F.col("warnings") > 0, "passed with warnings").otherwise("passed"))


def samples(chunks: DataFrame, k: int = 5) -> DataFrame:
    """Up to k offending ids per check of validate() (the smallest; a repeated id once)."""
    rows = {n: c for n, (_, c) in checks(chunks).items()} | {f"null_{c}": F.col(c).isNull() for c in REQUIRED}
    hits = chunks.select("chunk_id", F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rows.items())), lambda x: x.isNotNull())).alias("check"))
    twice = chunks.groupBy("chunk_id").agg(F.count("*").alias("c")).where("c > 1")
    for name, found in (("duplicate_id", twice), ("orphan_child", orphan_children(chunks))):
        hits = hits.unionByName(found.select("chunk_id", F.lit(name).alias("check")))
    w = Window.partitionBy("check").orderBy("chunk_id")
    return hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("check", "r", "chunk_id")


def corpus_coverage(chunks: DataFrame, enriched: DataFrame) -> DataFrame:
    """One row: papers that have chunks, how many of them are enriched (with a summary, with references), children with odd ids or without a parent row.

    enriched: paper_id and, if it has them, tldr and reference_count.
    """
    has = {"with_tldr": F.coalesce("tldr", F.lit("")) != "" if "tldr" in enriched.columns else F.lit(False)}
    has["with_references"] = F.coalesce("reference_count", F.lit(0)) > 0 if "reference_count" in enriched.columns else F.lit(False)
    known = enriched.groupBy("paper_id").agg(F.lit(1).alias("e"), *(F.bool_or(c).alias(n) for n, c in has.items()))
    ids = chunks.select("paper_id").distinct().join(known, "paper_id", "left")
    n = ids.agg(F.count("*").alias("n_papers"), F.count("e").alias("enriched"), *(F.count_if(n).alias(n) for n in has))
    children = chunks.where("chunk_type = 'child'").agg(F.count("*").alias("n_children"), F.count_if(~F.col("chunk_id").contains("::")).alias("malformed_ids"))
    orphans = orphan_children(chunks, null_too=True).agg(F.count("*").alias("orphans"))
    out = n.crossJoin(children).crossJoin(orphans)  # three one-row tables
    return out.withColumn("coverage_percent", F.round(100.0 * F.col("enriched") / F.greatest("n_papers", F.lit(1)), 3))


def graph_internality(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Links, links into the corpus, papers with such a link, and their share of all links."""
    inside = papers.select(F.col("paper_id").alias("cited_id")).distinct().withColumn("inside", F.lit(1))
    d = edges.join(inside, "cited_id", "left")
    out = d.agg(F.count("*").alias("links"), F.count("inside").alias("internal"), F.countDistinct(F.when(F.col("inside") == 1, F.col("citing_id"))).alias("papers_with_internal"))
    return out.withColumn("ratio", F.col("internal") / F.greatest(F.col("links"), F.lit(1)))


def audit_embeddings(chunks: DataFrame, embeddings: DataFrame, dims: int, tolerance: float = 1e-3) -> DataFrame:
    """Counts, wrong dimensions, norms off one, ids missing and ids extra; over all vectors."""
    own = embeddings.agg(
        F.count("*").alias("n_vectors"),
        F.count_if(F.size("embedding") != dims).alias("wrong_dims"),
        F.count_if(F.abs(norm(F.col("embedding")) - 1) > tolerance).alias("off_norm"),
    )
    ids, vectors = chunks.select("chunk_id").distinct(), embeddings.select("chunk_id").distinct()
    missing = ids.join(vectors, "chunk_id", "left_anti").agg(F.count("*").alias("missing"))
    extra = vectors.join(ids, "chunk_id", "left_anti").agg(F.count("*").alias("extra"))
    return own.crossJoin(missing).crossJoin(extra)  # three one-row tables


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per dataset."""
    out = None
    for name, d in tables.items():
        one = d.agg(F.count("*").alias("n")).select(F.lit(name).alias("dataset"), "n")
        out = one if out is None else out.unionAll(one)
    return out
