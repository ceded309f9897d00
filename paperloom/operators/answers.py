"""Processing of model responses as columns: JSON repair, clean-up, citations, claims, verdicts, routing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import sentences, strip
from .index import top_k
from .lineage import cut

# A citation of a paper, a numeric mark, and a citation with blanks before its bracket or before further text.
CITATION = r"\[\s*(\d{4}\.\d{4,5})\s*\]"
MARK, PADDED, TRAILED = r"\[(\d{1,3}(?:,\s*\d{1,3})*)\]", r"\[(\d{4}\.\d{4,5})\s+\]", r"\[(\d{4}\.\d{4,5})\s+(?=[^\]])"
#: Sentences that an application may word for itself: the second sub-question, and what goes before and after a gap's aspects.
MORE = "Which findings bear on this, and how do they come about: "
GAP = ("The evidence falls short on these aspects: ", ". The papers at hand leave them open.")
# Phrases that admit a gap, known question types, and the words that give a type away.
GAP_PHRASES = (
    "insufficient", "not found", "no evidence", "not available", "could not find", "not well-represented", "not fully explored",
    "remains insufficiently", "not well-covered", "not addressed",
)
QUESTION_TYPES = ("bridge", "comparison", "aggregation", "causal", "definition")
TYPE_WORDS = (
    ("comparison", ("differ", "compare", "vs", "versus", "trade-off", "difference")),
    ("aggregation", ("evolved", "evolution", "history", "over time", "from", "to 20")),
    ("causal", ("why", "cause", "led to", "result in")),
    ("definition", ("what is", "define", "definition", "formula", "how does")),
)


def tolerant_json(raw: Column) -> Column:
    """A JSON object out of a response: as it is, fenced, inside text, or cut at the last brace; null if hopeless."""
    raw = strip(raw)
    # How a response fences an object.
    fenced = F.regexp_extract(raw, r"(?s)```\s*(?:json)?\s*(\{.*?\})\s*```", 1)
    inside = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    upto = F.regexp_extract(raw, r"(?s)^(.*\})", 1)
    parsed = lambda c: F.try_parse_json(F.when(F.startswith(c, F.lit("{")) | F.startswith(c, F.lit("[")), c))
    return F.coalesce(parsed(raw), parsed(fenced), parsed(inside), parsed(upto))


def clean_subquestions(questions: Column, question_type: Column, more: str = MORE) -> Column:
    """struct(sub_questions, question_type): trimmed, at most four; a second is added unless it is a definition."""
    kind = F.when(question_type.isin(*QUESTION_TYPES), question_type).otherwise("bridge")
    good = F.slice(F.filter(F.transform(questions, strip), lambda q: q != ""), 1, 4)
    second = F.concat(F.lit(more), F.try_element_at(good, F.lit(1)))
    out = F.when((F.size(good) == 1) & (kind != "definition"), F.array_append(good, second)).otherwise(good)
    return F.struct(out.alias("sub_questions"), kind.alias("question_type"))


def infer_type(question: Column) -> Column:
    q, out = F.lower(question), None
    for name, words in TYPE_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | q.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("bridge")


def judge_subquestions(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Decisions by index: a missing or unknown one is insufficient.

    questions: query_id, sq_index; results: query_id, sq_index, decision, reason.
    """
    d = questions.join(results, ["query_id", "sq_index"], "left")
    known = F.col("decision").isin("sufficient", "insufficient")
    return d.select(
        "query_id",
        "sq_index",
        F.when(known, F.col("decision")).otherwise("insufficient").alias("decision"),
        F.coalesce("reason", F.when(F.col("decision").isNull(), "Sub-question not evaluated by critic").otherwise("No reason provided")).alias("reason"),
    )


def overall_decision(judged: DataFrame, declared: DataFrame) -> DataFrame:
    """Insufficient if any part is, or if declared so."""
    d = judged.groupBy("query_id").agg(F.bool_or(F.col("decision") == "insufficient").alias("any")).join(declared, "query_id", "left")
    bad = F.col("any") | F.coalesce(F.col("declared") == "insufficient", F.lit(False))
    return d.select("query_id", F.when(bad, "insufficient").otherwise("sufficient").alias("overall"))


def critic_context(chunks: DataFrame, full: int = 2, chars: int = 500, heading: str = "Abstracts:") -> DataFrame:
    """Per query and sub-question one text: the first two retrieved chunks at length, the rest as one-liners, and below a heading the added abstracts."""
    added = F.col("method") == "abstract_supplement"
    rank = F.row_number().over(Window.partitionBy("query_id", "sq_index", added).orderBy(F.desc("score"), "id"))
    head, title = F.concat(F.lit("["), "paper_id", F.lit("] ")), F.coalesce("title", F.lit(""))
    long = ~added & (rank <= full)
    line = F.concat(F.when(added & (rank == 1), heading + "\n").otherwise(""), head, F.when(long, F.substring("text", 1, chars)).otherwise(title))
    d = chunks.select("query_id", "sq_index", F.struct(added.alias("added"), rank.alias("rank"), line.alias("line")).alias("x"))
    return d.groupBy("query_id", "sq_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias("context"))


def expand_query(question: Column, rewrite: Column, missing: Column, tried: Column) -> Column:
    """The next query: the model's rewrite, else the question and up to three missing terms; null when all were tried.

    A query that was tried already gets an extra term: methods, techniques or a missing one.
    """
    useful = F.when((strip(F.coalesce(rewrite, F.lit(""))) != "") & (F.lower(strip(rewrite)) != F.lower(strip(question))), strip(rewrite))
    base = F.coalesce(useful, F.when(F.size(missing) > 0, F.concat_ws(" ", question, F.array_join(F.slice(missing, 1, 3), " "))))
    extra = F.concat(missing, F.array(F.lit("methods"), F.lit("techniques")))
    options = F.concat(F.array(base), F.transform(extra, lambda t: F.concat_ws(" ", base, t)))
    return F.when(base.isNotNull(), F.try_element_at(F.filter(options, lambda o: ~F.array_contains(tried, o)), F.lit(1)))


def pack_evidence(chunks: DataFrame, per_question: int = 6, overall: int = 20, chars: int = 800) -> DataFrame:
    """At most six hybrid chunks per sub-question and twenty per query, in the order of sub-questions."""
    d = top_k(chunks.where("method = 'hybrid'"), ["query_id", "sq_index"], [F.desc("score"), F.col("id")], per_question)
    d = d.withColumnRenamed("rank", "sq_rank")
    d = top_k(d, ["query_id"], [F.col("sq_index"), F.col("sq_rank")], overall)
    return d.select("query_id", "sq_index", "rank", "id", F.substring("text", 1, chars).alias("text"))


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_citations(answer: Column, listed: Column, retrieved: Column) -> Column:
    """struct(answer, citations, invalid): numeric marks gone, blanks inside brackets gone, ids outside the retrieved set stripped."""
    text = F.regexp_replace(strip(answer), MARK, "")
    text = F.regexp_replace(text, PADDED, "[$1]")
    text = squeeze(F.regexp_replace(text, TRAILED, "[$1] "))
    found = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    named = F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), strip), lambda c: c != "")
    every = F.array_sort(F.array_union(named, found))
    invalid = F.array_except(every, retrieved)
    bare = F.aggregate(invalid, text, lambda t, c: F.regexp_replace(t, F.concat(F.lit(r"\[\s*\Q"), c, F.lit(r"\E\s*\]")), F.lit("")))
    return F.struct(F.when(F.size(invalid) > 0, squeeze(bare)).otherwise(text).alias("answer"), F.array_intersect(every, retrieved).alias("citations"), invalid.alias("invalid"))


def gap_text(judged: DataFrame, wording: tuple[str, str] = GAP) -> DataFrame:
    """One sentence per query about its insufficient sub-questions (each up to 80 characters); empty if none."""
    named = F.transform(
        F.sort_array(F.collect_list(F.when(F.col("decision") == "insufficient", F.struct("sq_index", F.substring("sub_question", 1, 80).alias("q"))))), lambda x: x["q"]
    )
    d = judged.groupBy("query_id").agg(named.alias("g"))
    text = F.concat(F.lit(wording[0]), F.array_join("g", "; "), F.lit(wording[1]))
    return d.select("query_id", F.when(F.size("g") > 0, text).otherwise("").alias("gap_text"))


def coverage(judged: DataFrame) -> DataFrame:
    return judged.groupBy("query_id").agg((F.count_if(F.col("decision") == "sufficient") / F.count("*")).alias("coverage"))


def is_gap(sentence: Column) -> Column:
    hit = F.lit(False)
    for phrase in GAP_PHRASES:
        hit = hit | F.lower(sentence).contains(phrase)
    return hit


def claims(answers: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, claim_no, claim, citations): the first distinct sentences with citations that admit no gap."""
    found = lambda s: F.regexp_extract_all(s, F.lit(CITATION), F.lit(1))
    good = F.array_distinct(F.filter(F.transform(sentences(F.col("answer")), strip), lambda s: (F.size(found(s)) > 0) & ~is_gap(s)))
    d = answers.select("query_id", F.posexplode(F.slice(good, 1, most)).alias("claim_no", "claim"))
    return d.withColumn("citations", F.array_distinct(found(F.col("claim"))))


def claim_evidence(cited: DataFrame, chunks: DataFrame, per_paper: int = 3, chars: int = 300, total: int = 600) -> DataFrame:
    """Evidence per (query_id, paper_id): up to three hybrid texts joined, or a placeholder."""
    d = chunks.where("method = 'hybrid'").join(cited.select("query_id", "paper_id").distinct(), ["query_id", "paper_id"], "left_semi")
    d = top_k(d, ["query_id", "paper_id"], [F.desc("score"), F.col("id")], per_paper)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.substring("text", 1, chars).alias("t")))), lambda x: x["t"])
    e = d.groupBy("query_id", "paper_id").agg(F.substring(F.array_join(texts, " [...] "), 1, total).alias("evidence"))
    return cited.select("query_id", "paper_id").distinct().join(e, ["query_id", "paper_id"], "left").withColumn("evidence", F.coalesce("evidence", F.lit("(no evidence retrieved)")))


def claim_verdicts(judged: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Unsupported claims whose citations were all retrieved are weak.

    judged: query_id, claim_no, status, citations; retrieved: query_id, paper_ids.
    """
    d = judged.join(retrieved, "query_id", "left").withColumn("paper_ids", F.coalesce("paper_ids", F.array().cast("array<string>")))
    inside = (F.size("paper_ids") > 0) & (F.size(F.array_except("citations", "paper_ids")) == 0)
    return d.select("query_id", "claim_no", F.when((F.col("status") == "unsupported") & inside, "weak").otherwise(F.col("status")).alias("status"))


def answer_status(verdicts: DataFrame) -> DataFrame:
    """failed with an unsupported claim, needs_revision with a weak one, else passed."""
    worst = F.max(F.when(F.col("status") == "unsupported", 2).when(F.col("status") == "weak", 1).otherwise(0))
    d = verdicts.groupBy("query_id").agg(worst.alias("w"))
    return d.select("query_id", F.when(F.col("w") == 2, "failed").when(F.col("w") == 1, "needs_revision").otherwise("passed").alias("verification_status"))


def strip_unsupported(answer: Column) -> Column:
    # The marker's two forms.
    return squeeze(F.regexp_replace(F.regexp_replace(answer, r"\(UNSUPPORTED[^)]*\)", ""), r"\[/?UNSUPPORTED[^\]]*\]", ""))


def uncited_status(answer: Column) -> Column:
    """For answers without citations: any longer sentence that admits no gap needs revision."""
    factual = F.exists(sentences(answer), lambda s: ~is_gap(s) & (F.length(strip(s)) > 20))
    return F.when(factual, "needs_revision").otherwise("passed")


def next_step(overall: Column, iteration: Column, most: int = 2, has_new_query: Column | None = None) -> Column:
    done = (overall == "sufficient") | (iteration >= most)
    if has_new_query is not None:
        done = done | ~has_new_query
    return F.when(done, "finish").otherwise("expand")


def iterate(queries: DataFrame, search: Callable[[DataFrame, int], DataFrame], sufficient: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame], DataFrame], most: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rounds for all open queries at once: search, judge, rewrite, until sufficient or out of rounds.

    search(queries, round) gives rows (query_id, id, rrf); sufficient(rows) gives (query_id, ok); rewrite(queries)
    gives (query_id, query). Returns the merged rows and a trace (query_id, iteration, step, detail).
    """
    from .retrieve import merge_rounds

    open_, results, trace = queries.select("query_id", "query"), None, None
    for i in range(most):
        found = cut(search(open_, i).select("query_id", "id", "rrf"))
        results = found if results is None else merge_rounds(results, found).select("query_id", "id", "rrf")
        results = cut(results)
        step = open_.select("query_id", F.lit(i).alias("iteration"), F.lit("retrieve").alias("step"), F.col("query").alias("detail"))
        trace = step if trace is None else trace.unionAll(step)
        good = sufficient(results).where("ok").select("query_id")
        open_ = cut(rewrite(open_.join(good, "query_id", "left_anti")).select("query_id", "query"))
        if i + 1 < most and not open_.limit(1).count():
            break
    return results, trace


class Rounds:
    """Iterative retrieval that a stopped run takes up again.

    Every round leaves its queries, its merged rows and its verdicts in folders of their own below path; a round counts once its `done` mark is
    written, which comes last. run() goes on after the last round that counts: rounds that count are read, not searched again, and what a
    stopped round has left is written anew. The rows and the trace equal iterate()'s.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _there(self, i: int) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/round={i}/done/_SUCCESS")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def _table(self, i: int, name: str, rows: DataFrame | None = None) -> DataFrame:
        path = f"{self.path}/round={i}/{name}"
        if rows is not None:
            rows.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def run(self, queries: DataFrame, search: Callable[[DataFrame, int], DataFrame], sufficient: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame], DataFrame], most: int = 2) -> tuple[DataFrame, DataFrame]:
        """(rows, trace), as iterate() gives them."""
        from .retrieve import merge_rounds

        results, trace = None, None
        for i in range(most):
            if not self._there(i):
                if i == 0:
                    open_ = queries.select("query_id", "query")
                else:
                    good = self._table(i - 1, "verdicts").where("ok").select("query_id")
                    open_ = rewrite(self._table(i - 1, "queries").join(good, "query_id", "left_anti")).select("query_id", "query")
                open_ = self._table(i, "queries", open_)
                found = self._table(i, "found", search(open_, i).select("query_id", "id", "rrf"))
                merged = found if results is None else merge_rounds(results, found).select("query_id", "id", "rrf")
                merged = self._table(i, "rows", merged)
                self._table(i, "verdicts", sufficient(merged).select("query_id", "ok"))
                self._table(i, "done", self.spark.range(1))
            asked = self._table(i, "queries")
            results = self._table(i, "rows")
            step = asked.select("query_id", F.lit(i).alias("iteration"), F.lit("retrieve").alias("step"), F.col("query").alias("detail"))
            trace = step if trace is None else trace.unionAll(step)
            good = self._table(i, "verdicts").where("ok").select("query_id")
            if i + 1 < most and asked.join(good, "query_id", "left_anti").isEmpty():
                break
        return results, trace
