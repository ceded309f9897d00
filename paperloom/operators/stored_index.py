"""A BM25 index that is written once, kept between searches, and follows added and withdrawn papers.

Postings lie in blocks, in directories by the hash of their term. BLOCK papers that were read one after another have one block number, and a
block holds one term's postings of these papers. Blocks are made where the papers are read, without a shuffle. Beside its postings a
block keeps its impacts, the shortest length for each frequency: the greatest score that any of its papers can have from
the term follows from them at any average length, and is exact for later loads too. A directory of its own lists the papers of each number.

Each load is a generation: its own postings and papers, and the whole corpus' term counts and totals as they are from then on. A
generation counts once its commit is written; what a stopped load has left is never read. Withdrawn papers are
remembered with the generation that withdrew them: postings of earlier generations leave them out.

Defined results: papers without an id are not indexed; of rows with one id the first by text is; papers without a token count
for the number and average length; an id that is there already is passed over; withdrawing an unknown id changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from .index import B, FLOOR, K1, top_k
from .lineage import MOST_SENT, cut, sent
from .retrieve import cut_best

#: Papers that share a block number.
BLOCK = 32
#: Block numbers whose papers are scored in one task.
RANGE = 32
#: Directories of terms that an index has, unless told otherwise, at most; and the form of its files, for the names of indexes that are kept.
BUCKETS, FORM = 64, 1
#: The directory of the papers themselves, beside those of the terms' hashes.
PAPERS = -1
#: Block numbers that a query's first estimate of the k-th score reads.
FIRST = 16
#: Scores are compared after rounding, so bounds give way by this much.
SLACK = 1e-5


def _raw_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def _impact(f: Column, dl: Column, average: Column) -> Column:
    """What a term's frequency and a paper's length make of its idf."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * dl / average))


def as_blocks(tokens: pa.ListArray, ids: pa.Array, number: int) -> pa.RecordBatch:
    """The blocks of some papers: a row for each term, and one without a term that lists the papers."""
    dl = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    terms = len(coded.dictionary)
    pairs, f = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(dl) + np.repeat(np.arange(len(dl)), dl), return_counts=True)
    term, paper = np.concatenate([pairs // len(dl), np.full(len(dl), terms)]), np.concatenate([pairs % len(dl), np.arange(len(dl))])
    f = np.concatenate([f, np.zeros(len(dl), np.int64)])
    order = np.lexsort((dl[paper], f, term))  # of a frequency the shortest paper comes first
    kept = np.concatenate([[True], (term[order][1:] != term[order][:-1]) | (f[order][1:] != f[order][:-1])])
    best = order[kept]
    ends = lambda t: pa.array(np.concatenate([[0], np.cumsum(np.bincount(t, minlength=terms + 1))]).astype(np.int32))
    int_ = lambda x: pa.array(x.astype(np.int32))
    impacts = pa.ListArray.from_arrays(ends(term[best]), pa.StructArray.from_arrays([int_(f[best]), int_(dl[paper[best]])], ["f", "dl"]))
    postings = pa.ListArray.from_arrays(ends(term), pa.StructArray.from_arrays([ids.take(pa.array(paper)), int_(f), int_(dl[paper])], ["id", "f", "dl"]))
    names = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([None], pa.string())])
    return pa.RecordBatch.from_arrays([names, pa.array(np.full(terms + 1, number)), int_(np.bincount(term, minlength=terms + 1)), impacts, postings], ["term", "block", "n", "impacts", "postings"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield as_blocks(part.column("w"), part.column("id"), number)
            number += 1


def _range_scores(asked: pa.Table, average: float | None, k: int, digits: int):
    """A map from blocks (term, postings) of some papers to their best k for each query: (query_id, id, score)."""
    coded = asked.column("query_id").combine_chunks().dictionary_encode()
    queries, query = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    words = asked.column("term").combine_chunks().dictionary_encode()
    order = np.argsort(words.indices.to_numpy(zero_copy_only=False), kind="stable")
    query, weight = query[order], asked.column("weight").to_numpy()[order]
    many = np.bincount(words.indices.to_numpy(zero_copy_only=False), minlength=len(words.dictionary))
    starts = np.cumsum(many) - many

    def run(blocks: pa.Table) -> pa.Table:
        blocks = blocks.combine_chunks()
        column = blocks.column("postings").combine_chunks()
        sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        held = column.flatten()
        f, dl = (held.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("f", "dl"))
        impact = f * (K1 + 1) / (f + K1 * (1 - B + B * dl / average))
        ids = held.field("id").dictionary_encode()
        paper = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        term = pc.index_in(blocks.column("term"), value_set=words.dictionary).to_numpy()
        found = [pa.table({"query_id": queries.slice(0, 0), "id": ids.dictionary.slice(0, 0), "score": pa.array([], pa.float64())})]
        scores, met = np.zeros(len(ids.dictionary) * len(queries)), np.zeros(len(ids.dictionary) * len(queries), bool)
        ends = np.cumsum(sizes)
        for t, a, z in zip(term.tolist(), (ends - sizes).tolist(), ends.tolist()):
            own = slice(starts[t], starts[t] + many[t])
            at = (paper[a:z, None] * len(queries) + query[own]).ravel()  # a term has a paper, and a query a term, once
            scores[at] += (impact[a:z, None] * weight[own]).ravel()
            met[at] = True
        hit = np.flatnonzero(met)
        rows = {"query_id": queries.take(pa.array(hit % len(queries))), "id": ids.dictionary.take(pa.array(hit // len(queries))), "score": np.round(scores[hit], digits)}
        return cut_best(pa.concat_tables([*found, pa.table(rows)]), k)

    return run


def first_texts(docs: DataFrame) -> DataFrame:
    """docs (id, text) that have an id, the first by text of those with one id."""
    d = docs.where("id is not null")
    twice = cut(d.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if twice.isEmpty():
        return d
    return d.join(twice, "id", "left_anti").unionByName(d.join(twice, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))


class StoredIndex:
    """An index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets or min(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))

    # -- generations

    def commits(self) -> list[dict]:
        """What each committed generation holds, oldest first: its own rows and blocks, and the whole corpus' totals from then on."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return []
        schema = "gen int, since int, buckets int, added long, withdrawn long, postings long, n long, length long, mean double, id_type string"
        rows = sorted((r.asDict() for r in self.spark.read.schema(schema).json(f"{self.path}/commits/*").collect()), key=lambda r: r["gen"])
        return [r for r in rows if r["gen"] >= rows[-1]["since"]]

    def _commit(self, row: dict) -> None:
        self.spark.createDataFrame([{k: v for k, v in row.items() if v is not None}]).coalesce(1).write.mode("overwrite").json(f"{self.path}/commits/{row['gen']}")

    def _table(self, row: dict, name: str) -> DataFrame:
        schemas = {
            "withdrawn": "id {0}, dl int", "terms": "term string, df long, bucket int",
            "postings": "term string, block long, n int, impacts array<struct<f:int,dl:int>>, postings array<struct<id:{0},f:int,dl:int>>, bucket int",
        }
        return self.spark.read.schema(schemas[name].format(row["id_type"])).parquet(f"{self.path}/gen-{row['gen']}/{name}")

    def _each(self, name: str, count: str) -> DataFrame | None:
        """One table of all generations that have rows in it, with their number."""
        parts = [self._table(c, name).withColumn("gen", F.lit(c["gen"])) for c in self.commits() if c[count]]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _living(self, rows: DataFrame) -> DataFrame:
        """Rows (id, gen, ...) without those of papers that a later generation withdrew."""
        gone = self._each("withdrawn", "withdrawn")
        if gone is None:
            return rows
        gone = gone.groupBy(F.col("id").alias("gone")).agg(F.max("gen").alias("last"))
        return rows.join(gone, (F.col("id") == F.col("gone")) & (F.col("gen") < F.col("last")), "left_anti")

    def papers(self) -> DataFrame | None:
        """(id, dl) of the papers in the index."""
        rows = self._each("postings", "added")
        return rows if rows is None else self._living(rows.where(F.col("bucket") == PAPERS).select("gen", F.inline("postings"))).select("id", "dl")

    # -- loads

    def load(self, docs: DataFrame, id_column: str, text: Column) -> None:
        """Adds the papers whose ids are new. Texts are read once, and only ids beside them."""
        d = first_texts(docs.select(F.col(id_column).alias("id"), text.alias("text")))
        have = self.papers()
        if have is not None:  # ids are compared before texts; few new ones go to the texts
            d = d.join(sent(cut(d.select("id").join(have.select("id"), "id", "left_anti"))), "id", "left_semi")
        row = self._next(dict(d.dtypes)["id"])
        self._write_blocks(d.select("id", tokenize(F.coalesce("text", F.lit(""))).alias("w")), row)
        own = self._table(row, "postings")
        added, length = own.where(F.col("bucket") == PAPERS).select(F.inline("postings")).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        row |= {"added": added, "n": row["n"] + added, "length": row["length"] + length}
        self._finish(row, own.where(F.col("bucket") != PAPERS).groupBy("term").agg(F.sum("n").alias("df")))

    def withdraw(self, ids: DataFrame) -> None:
        """Takes the papers of ids (id) out. Their postings are looked up, not rewritten."""
        have = self.papers()
        if have is None:
            return
        row = self._next(self.commits()[0]["id_type"])
        have.join(ids.select("id"), "id", "left_semi").write.mode("overwrite").parquet(f"{self._home(row)}/withdrawn")
        lost = self._table(row, "withdrawn")
        withdrawn, length = lost.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        row |= {"withdrawn": withdrawn, "n": row["n"] - withdrawn, "length": row["length"] - length}
        held = self.postings().select("term", "id").join(lost.select("id"), "id", "left_semi")
        self._finish(row, held.groupBy("term").agg((-F.count("*")).alias("df")))

    def compact(self) -> None:
        """Writes all generations as one, without the withdrawn papers; a paper's words are gathered again from its postings."""
        have = self.papers()
        if have is None:
            return
        last = self.commits()[-1]
        row = self._next(last["id_type"])
        row |= {"since": row["gen"], "added": row["n"]}
        words = self.postings().groupBy("id").agg(F.flatten(F.collect_list(F.array_repeat("term", F.col("f")))).alias("w"))
        whole = have.select("id").join(words, "id", "left").select("id", F.coalesce("w", F.array().cast("array<string>")).alias("w"))
        self._write_blocks(whole, row)
        self._finish(row, self._table(last, "terms").select("term", "df"), carry=False)

    def _next(self, id_type: str) -> dict:
        before = self.commits()
        last = before[-1] if before else {"gen": 0, "since": 1, "buckets": self.buckets, "n": 0, "length": 0}
        return {c: last[c] for c in ("since", "buckets", "n", "length")} | {"gen": last["gen"] + 1, "id_type": id_type, "added": 0, "withdrawn": 0}

    def _home(self, row: dict) -> str:
        return f"{self.path}/gen-{row['gen']}"

    def _write_blocks(self, tokens: DataFrame, row: dict) -> None:
        """tokens (id, w) as blocks. Tasks are as many as shuffle partitions at most, and each writes one file a directory."""
        t = row["id_type"]
        blocks = tokens.coalesce(int(self.spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(
            _blocks, f"term string, block long, n int, impacts array<struct<f:int,dl:int>>, postings array<struct<id:{t},f:int,dl:int>>"
        )
        # all directories are open at once, so blocks are not sorted by directory, which would hold or spill a task's whole share
        name, conf = "spark.sql.maxConcurrentOutputFileWriters", self.spark.conf
        before = conf.get(name)
        conf.set(name, str(row["buckets"] + 1))
        try:
            bucket = F.when(F.col("term").isNull(), PAPERS).otherwise(self._bucket(row["buckets"])).alias("bucket")
            blocks.select("*", bucket).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self._home(row)}/postings")
        finally:
            conf.set(name, before)

    def _finish(self, row: dict, change: DataFrame, carry: bool = True) -> None:
        """Term counts from the last generation's and the change in them; then the commit."""
        before = self.commits()
        if before and carry:
            change = change.unionByName(self._table(before[-1], "terms").select("term", "df"))
        terms = change.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        terms = terms.select("term", "df", self._bucket(row["buckets"])).repartition("bucket")
        terms.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self._home(row)}/terms")
        mean = self._table(row, "terms").agg(F.avg(_raw_idf(F.lit(row["n"]), F.col("df")))).first()[0]
        self._commit(row | {"mean": mean})

    @staticmethod
    def _bucket(buckets) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")

    # -- reading

    def blocks(self) -> DataFrame:
        """(bucket, term, block, n, impacts, postings, gen) of all generations; postings may name withdrawn papers."""
        rows = self._each("postings", "added")
        rows = rows if rows is not None else self._table(self.commits()[-1], "postings").withColumn("gen", F.lit(0)).where("false")
        return rows.where(F.col("bucket") != PAPERS)

    def postings(self) -> DataFrame:
        """(term, id, f, dl) of the papers in the index."""
        return self._living(self.blocks().select("term", "gen", F.inline("postings"))).drop("gen")

    def totals(self) -> dict:
        """n, avgdl, and mean, the average idf of all terms before its floor."""
        last = self.commits()[-1]
        return {"n": last["n"], "avgdl": last["length"] / last["n"] if last["n"] else None, "mean": last["mean"]}

    def terms(self) -> DataFrame:
        """(bucket, term, df, idf)."""
        t = self.totals()
        raw = _raw_idf(F.lit(t["n"]), F.col("df"))
        return self._table(self.commits()[-1], "terms").select("bucket", "term", "df", F.when(raw < 0, FLOOR * F.lit(t["mean"])).otherwise(raw).alias("idf"))

    def asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, bucket, weight) of the query terms that the index has; weight is the idf times the term's number in the query."""
        q = queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        q = q.select("*", self._bucket(self.commits()[-1]["buckets"]))
        return q.join(self.terms(), ["bucket", "term"]).select("query_id", "term", "bucket", (F.col("times") * F.col("idf")).alias("weight"))

    def _score(self, rows: DataFrame) -> DataFrame:
        """(query_id, id, s): what each posting of blocks (query_id, weight, gen, postings) adds to a score."""
        average = F.lit(self.totals()["avgdl"])
        rows = self._living(rows.select("query_id", "weight", "gen", F.inline("postings")))
        return rows.select("query_id", "id", (F.col("weight") * _impact(F.col("f"), F.col("dl"), average)).alias("s"))

    @staticmethod
    def _best(parts: DataFrame, k: int, digits: int) -> DataFrame:
        scored = parts.groupBy("query_id", "id").agg(F.round(F.sum("s"), digits).alias("score"))
        return top_k(scored, ["query_id"], [F.desc("score"), F.col("id")], k).where("score > 0")

    def search(self, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
        """(query_id, id, score, rank): bm25_search() over all stored blocks of the queries' terms.

        While the queries' terms are few enough to be sent to all executors and no paper is withdrawn, blocks meet by the range of
        papers that they are about, each range is scored in one task, and its best k per query leave it. Else every
        posting's share of a score is dealt by query and paper.
        """
        asked = cut(self.asked(queries))
        blocks, kinds = self.blocks(), dict(asked.dtypes)["query_id"]
        if self._each("withdrawn", "withdrawn") is not None or asked.limit(MOST_SENT + 1).count() > MOST_SENT:
            return self._best(self._score(blocks.join(asked, ["bucket", "term"])), k, digits)
        terms = F.broadcast(asked.select("bucket", "term").distinct())  # MOST_SENT rows at most
        found = blocks.join(terms, ["bucket", "term"]).select("gen", F.expr(f"block div {RANGE}").alias("range"), "term", "postings")
        average = self.totals()["avgdl"]
        scored = found.groupBy("gen", "range").applyInArrow(_range_scores(asked.toArrow(), average, k, digits), f"query_id {kinds}, id {self.commits()[-1]['id_type']}, score double")
        return top_k(scored, ["query_id"], [F.desc("score"), F.col("id")], k).where("score > 0")

    def pruned(self, queries: DataFrame, k: int, digits: int = 6) -> tuple[DataFrame, DataFrame]:
        """search() without the blocks that cannot reach the best k, and (query_id, postings, postings_read).

        All terms' blocks of one number are about the same papers, so the sum of their bounds bounds each of these papers'
        whole scores. The FIRST most promising numbers are scored; the k-th score among their papers is reached by k papers,
        and only numbers whose bound is not below it are read beside them.
        """
        average, place = F.lit(self.totals()["avgdl"]), ["bucket", "term", "gen", "block"]
        blocks = self.blocks()
        best = F.array_max(F.transform("impacts", lambda x: _impact(x["f"], x["dl"], average)))
        own = blocks.join(sent(cut(self.asked(queries))), ["bucket", "term"])
        # bounds alone are read here, no postings; a term of negative weight adds nothing to a paper without it
        own = cut(own.select("query_id", *place, "weight", "n", F.greatest(F.col("weight") * best, F.lit(0.0)).alias("bound")))
        stored = blocks.select(*place, "postings")
        numbers = own.groupBy("query_id", "gen", "block").agg(F.sum("bound").alias("bound"), F.sum("n").alias("n"))
        first = cut(top_k(numbers, ["query_id"], [F.desc("bound"), F.col("gen"), F.col("block")], FIRST).drop("rank"))

        def scored(some: DataFrame) -> DataFrame:
            mine = own.join(sent(some.select("query_id", "gen", "block")), ["query_id", "gen", "block"], "left_semi").select("query_id", *place, "weight")
            return self._score(stored.join(sent(cut(mine)), place)).groupBy("query_id", "id").agg(F.sum("s").alias("s"))

        seen = cut(scored(first))
        reached = top_k(seen, ["query_id"], [F.desc("s"), F.col("id")], k).where(F.col("rank") == k).select("query_id", (F.col("s") - SLACK).alias("reached"))
        rest = numbers.join(sent(first), ["query_id", "gen", "block"], "left_anti").join(reached, "query_id", "left")
        rest = cut(rest.where(F.col("reached").isNull() | (F.col("bound") >= F.col("reached"))).select(*first.columns))
        read = first.unionByName(rest).groupBy("query_id").agg(F.sum("n").alias("postings_read"))
        counts = numbers.groupBy("query_id").agg(F.sum("n").alias("postings")).join(read, "query_id", "left")
        return self._best(seen.unionByName(scored(rest)), k, digits), counts
