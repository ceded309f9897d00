"""Work is spread: reports are written by all partitions, and bands deal only the rows that they can take."""

from pyspark.sql import functions as F

from paperloom.operators import chunking, corpus, evaluate, lineage
from paperloom.operators.stored_index import StoredIndex
from paperloom.sources import records


def test_reports_are_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(40).groupBy(F.col("id").cast("string").alias("paper_id")).agg(F.count("*").alias("n"))
    records.write_report(rows, f"{tmp_path}/r", "paper_id")
    files = records.list_files(spark, f"{tmp_path}/r", name=r"/(part-\d+)").select("paper_id").distinct()
    assert files.count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spark.read.json(f"{tmp_path}/r").count() == 40


def test_bands_limit_rows_before_they_are_dealt(spark):
    p = spark.range(500).select(F.col("id").cast("string").alias("paper_id"), (2000 + F.col("id") % 4).cast("int").alias("year"), F.array(F.lit("en")).alias("categories"), F.lit("x" * 200).alias("abstract"), F.col("id").alias("relevance"))
    bands = spark.createDataFrame([("a", 2000, 2001, 3), ("b", 2002, 2009, 5)], "label string, start int, end int, target int")
    out = corpus.sample_bands(p, p.where("false"), bands, ["en"])
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.year_band, int(r.paper_id)) for r in out.collect()) == [("a", 0), ("a", 1), ("a", 4), *(("b", i) for i in (2, 3, 6, 7, 10))]


def test_blocks_are_written_unsorted(spark, tmp_path):
    """The setting that lets a task keep all directories open is in force for the write alone."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before, seen = spark.conf.get(name), []

    class Watched(StoredIndex):
        @staticmethod
        def _bucket(buckets):
            seen.append(spark.conf.get(name))
            return StoredIndex._bucket(buckets)

    ix = Watched(spark, (tmp_path / "ix").as_uri(), 4)
    ix.load(spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "id long, text string"), "id", F.col("text"))
    assert "5" in seen and spark.conf.get(name) == before
    assert {r.term: r.df for r in ix.terms().collect()} == {"alpha": 1, "beta": 2}


def test_documents_are_parsed_in_small_parts(spark):
    """A batch of many documents leaves its task in parts, so the fields of few are Python objects at one time."""
    d = spark.range(300, numPartitions=1).select(F.col("id").cast("string").alias("paper_id"), F.lit("<TEI><text><body/></text></TEI>").alias("xml"))
    held = []

    class Watched:
        """A frame whose map runs here, on one batch of all rows."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            held.extend(b.num_rows for b in run(iter(d.toArrow().combine_chunks().to_batches())))

    records.structured_documents(Watched())
    assert sum(held) == 300 and max(held) <= records.PARSED
    assert records.structured_documents(d).select("paper_id").distinct().count() == 300


def test_related_pairs_put_few_papers_in_order(spark, monkeypatch):
    """Beside the tags themselves, only the buckets of drawn numbers are worked on, and repeated tags go after they are dealt."""
    tags = spark.range(60_000).select((F.col("id") % 30_000).cast("string").alias("paper_id"), F.lit("t").alias("topic"))
    kept, plans = [], []

    def watched(d):
        plans.append(d._jdf.queryExecution().executedPlan().toString())
        out = lineage.cut(d)
        kept.append(out.count())
        return out

    monkeypatch.setattr(evaluate, "cut", watched)
    pairs = evaluate.related_pairs(tags, 5, "42").collect()
    assert len(set(pairs)) == 5 and all(p.a < p.b for p in pairs)
    assert kept[0] == 30_000 and max(kept[1:]) <= 4096  # all tags once; then at most a row for each bucket
    assert plans[0].rindex("Exchange") > plans[0].rindex("HashAggregate")  # the exchange lies below both aggregates


def test_chunks_are_made_once(spark):
    """The plan makes a paper's chunks in one place, and papers without chunks give no rows."""
    rows = [("p", "an abstract", [("H", "1", "word " * 100)]), ("q", None, []), ("r", " ", None)]
    d = spark.createDataFrame(rows, "paper_id string, abstract string, sections array<struct<heading:string,section_num:string,text:string>>")
    out = chunking.hierarchical_chunks(d)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("::abstract") == 1
    assert {r.paper_id for r in out.collect()} == {"p"}
    flat = chunking.flat_chunks(d.drop("sections"), F.lit("a sentence of words. " * 20))
    assert flat.count() == 3 and chunking.flat_chunks(d.drop("sections"), F.col("abstract")).count() == 0
