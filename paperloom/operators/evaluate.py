"""Retrieval evaluation, failure classification and gold-set mining."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sets import containment
from ..functions.text import strip, tokenize
from .index import top_k
from .lineage import cut, sent, stored
from .retrieve import cut_best

LOW_RECALL = 0.4
# Topics and the substrings that assign a paper to them.
TOPICS = {
    "attention": ("attention", "transformer", "self-attention", "multi-head"),
    "distillation": ("distillation", "student", "teacher", "compression"),
    "fine-tuning": ("fine-tuning", "lora", "peft", "adaptation", "finetuning"),
    "retrieval": ("retrieval", "rag", "augmented generation", "knowledge base"),
    "generation": ("generation", "language model", "llm", "gpt", "inference"),
    "alignment": ("alignment", "rlhf", "safety", "reward", "preference"),
    "efficiency": ("efficiency", "inference", "latency", "throughput", "kv-cache"),
    "multilingual": ("multilingual", "cross-lingual", "transfer", "language"),
    "interpretability": ("interpretability", "mechanistic", "circuit", "neuron"),
    "reasoning": ("reasoning", "chain-of-thought", "cot", "problem solving"),
    "augmentation": ("augmentation", "data augmentation", "synthetic"),
    "embeddings": ("embedding", "representation", "positional", "encoding"),
    "continual": ("continual", "catastrophic forgetting", "lifelong", "sequential"),
    "audio": ("audio", "speech", "acoustic", "wav2vec", "sound"),
    "mixture": ("mixture of experts", "moe", "routing", "sparse"),
}


def recall(required: Column, retrieved: Column) -> Column:
    """struct(recall, found, missed); nothing required gives 0."""
    found = F.array_sort(F.array_intersect(required, retrieved))
    n = F.size(F.array_distinct(required))
    return F.struct(
        F.when(n > 0, F.size(found) / n).otherwise(0.0).alias("recall"), found.alias("found"), F.array_sort(F.array_except(required, retrieved)).alias("missed")
    )


def recall_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.round(F.avg("recall"), 3).alias("mean_recall"), F.count_if(F.col("recall") == 1).alias("perfect"), F.count_if(F.col("recall") == 0).alias("zero"), F.count("*").alias("n")
    )


def adjusted_recall(results: DataFrame, corpus: DataFrame) -> DataFrame:
    """Citation recall over all gold papers and over those in the corpus. results: query_id, gold, cited (arrays)."""
    gold = results.select("query_id", F.explode("gold").alias("paper_id")).distinct()
    inside = gold.join(corpus.select("paper_id").distinct(), "paper_id", "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_set("paper_id")).alias("gold_in_corpus"))
    d = results.join(inside, "query_id", "left").withColumn("gold_in_corpus", F.coalesce("gold_in_corpus", F.array().cast("array<string>")))
    ratio = lambda g: F.when(F.size(g) > 0, F.size(F.array_intersect(g, F.col("cited"))) / F.size(g)).otherwise(0.0)
    d = d.select("query_id", ratio(F.array_distinct("gold")).alias("citation_recall"), ratio(F.col("gold_in_corpus")).alias("adjusted_recall"), F.size("gold_in_corpus").alias("n_in_corpus"))
    return d.withColumns({"perfect": F.col("citation_recall") == 1, "adjusted_perfect": F.col("adjusted_recall") == 1})


def top_results(hits: DataFrame, papers: DataFrame, chars: int = 50, digits: int = 4) -> DataFrame:
    """(query_id, top_results): each query's rows in order, as structs of paper_id, short title and rounded score.

    hits: query_id, paper_id, score, rank; papers: paper_id, title (a paper without a row has an empty title).
    """
    d = hits.join(papers.select("paper_id", F.substring(F.coalesce("title", F.lit("")), 1, chars).alias("title")), "paper_id", "left")
    # a scaled number is rounded, as SQL does it; rounding the printed digits differs where they end in a five
    score = F.round(F.col("score") * 10.0**digits) / 10.0**digits
    row = F.struct("rank", "paper_id", F.coalesce("title", F.lit("")).alias("title"), score.alias("score"))
    return d.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: F.struct(x["paper_id"], x["title"], x["score"])).alias("top_results"))


# The outcomes of verification.
STATUSES = ("passed", "needs_revision", "failed", "error")


def by_type(results: DataFrame) -> DataFrame:
    """Means per question type, over all rows and over those that are no errors, and how many rows have each status."""
    ok = F.col("status") != "error"
    return results.groupBy("question_type").agg(
        F.count("*").alias("n"),
        F.count_if(~ok).alias("n_errors"),
        *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES[:-1]),
        F.round(F.avg("recall"), 6).alias("mean_all"),
        F.round(F.avg(F.when(ok, F.col("recall"))), 6).alias("mean_valid"),
    )


def severity(recall_: Column) -> Column:
    return F.when(recall_ == 0, "zero").when(recall_ < LOW_RECALL, "low").otherwise("ok")


def title_overlap(results: DataFrame, titles: DataFrame) -> DataFrame:
    """Per query the missed paper whose title words the retrieved titles cover best: max_overlap, closest.

    results: query_id, retrieved, missed (arrays); titles: paper_id, title. Ties go to the smallest id.
    """
    words = titles.select("paper_id", F.array_distinct(tokenize(F.col("title"), keep_single=True)).alias("w"))
    seen = results.select("query_id", F.explode("retrieved").alias("paper_id")).join(words, "paper_id").groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("seen"))
    lost = results.select("query_id", F.explode("missed").alias("paper_id")).join(words, "paper_id").join(seen, "query_id", "left")
    o = containment(F.col("w"), F.coalesce("seen", F.array().cast("array<string>")))
    best = top_k(lost.withColumn("o", o).where("o > 0"), ["query_id"], [F.desc("o"), F.col("paper_id")], 1)
    return best.select("query_id", F.col("o").alias("max_overlap"), F.col("paper_id").alias("closest"))


def failure_hint(required: Column, missed: Column, hybrid: Column, supplement: Column, overlap: Column) -> Column:
    """Root cause by ordered rules."""
    # Labels and thresholds.
    return (
        F.when(F.size(missed) == 0, "no_issue")
        .when(F.size(hybrid) == 0, "dense_or_fusion_empty")
        .when(F.arrays_overlap(required, supplement) & ~F.arrays_overlap(required, hybrid), "hybrid_miss_abstract_recovery")
        .when(overlap < 0.2, "query_mismatch_or_sparse_vocab")
        .when(overlap < 0.5, "rerank_or_topk_limit")
        .otherwise("near_miss_expand_topk")
    )


def hint_histogram(rows: DataFrame) -> DataFrame:
    return rows.where("severity <> 'ok'").groupBy("hint").agg(F.count("*").alias("n"))


def worst_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("severity") != "zero", F.col("severity") != "low", "recall", "query_id")


def judged_answers(answers: DataFrame, chars: int = 100) -> DataFrame:
    """Answers (query_id, answer, citations) that a judge sees: long enough, without blanks at the ends, and with a citation."""
    return answers.where((F.length(strip(F.coalesce("answer", F.lit("")))) >= chars) & (F.coalesce(F.size("citations"), F.lit(0)) > 0))


def judge_contexts(rows: DataFrame, first: int = 20, per_paper: int = 3, chars: int = 600) -> DataFrame:
    """Contexts per answer: the first 20 distinct rows by (paper, chunk), then at most 3 per paper."""
    d = rows.select("query_id", "paper_id", "chunk_id", F.substring("text", 1, chars).alias("text")).distinct()
    d = top_k(d, ["query_id"], [F.col("paper_id"), F.col("chunk_id")], first)
    return top_k(d.drop("rank"), ["query_id", "paper_id"], [F.col("chunk_id")], per_paper)


def score_rollup(scores: DataFrame, *names: str) -> DataFrame:
    """Means of judge scores, NaN and null as 0, over rows without an error, and the mean of these means."""
    value = lambda c: F.round(F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)), 4)
    ok = scores.where("error is null").select(*(value(c).alias(c) for c in names))
    return ok.agg(F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(f"mean_{c}") for c in names), F.round(sum(map(F.avg, names)) / len(names), 4).alias("combined"))


def tag_topics(papers: DataFrame) -> DataFrame:
    """(paper_id, topic) for each topic one of whose substrings is in title or abstract."""
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    hit = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))
    topics = F.filter(F.array(*(F.when(hit(w), F.lit(t)) for t, w in TOPICS.items())), lambda t: t.isNotNull())
    return papers.select("paper_id", F.explode(topics).alias("topic"))


#: A prime above any number of pairs: steps of it, modulo the number of pairs, meet each number once.
STRIDE = 2**61 - 1


def related_pairs(tagged: DataFrame, n: int, seed: str) -> DataFrame:
    """n of the pairs of papers that share a topic (all, if there are fewer), in a fixed shuffled order: a, b.

    All pairs of all topics have numbers: in a topic, papers are numbered in the order of a keyed hash, and paper j has the
    pairs j (j - 1) / 2 ... with its forerunners. Numbers are drawn in steps of STRIDE and only the drawn pairs are
    looked up; a pair with several topics counts by its first. One row per topic reaches the driver.

    Papers are counted by topic and the start of their hash (bucket). Only buckets that a drawn number lies in are put in order, so
    no task sorts or joins the papers of a topic. Repeated tags go after they are dealt, as one task may read most of the tags.
    """
    key = F.md5(F.concat_ws("/", F.lit(seed), "paper_id"))
    d = tagged.select("topic", "paper_id").repartition("topic", "paper_id").distinct()
    d = cut(d.select("topic", "paper_id", key.alias("h"), F.substring(key, 1, 3).alias("bucket")))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("topic").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = d.groupBy("topic", "bucket").agg(F.count("*").alias("c")).select("topic", "bucket", "c", before.alias("before"))
    starts = cut(starts)
    topics = sorted((r["topic"], r["c"] * (r["c"] - 1) // 2) for r in starts.groupBy("topic").agg(F.sum("c").alias("c")).collect())
    inner = F.row_number().over(Window.partitionBy("topic", "bucket").orderBy("h", "paper_id"))
    upto = Window.partitionBy("topic").orderBy("r", "drawn").rowsBetween(Window.unboundedPreceding, 0)
    ends = list(accumulate(pairs for _, pairs in topics))
    total, drawn = ends[-1] if ends else 0, 0
    while True:
        drawn = min(total, max(4 * n, 4 * drawn))
        rows = []
        for i in range(drawn):
            number = i * STRIDE % total
            t = bisect_right(ends, number)
            number -= ends[t] - topics[t][1]
            j = (1 + isqrt(1 + 8 * number)) // 2
            rows.append((i, topics[t][0], number - j * (j - 1) // 2, j))
        pick = d.sparkSession.createDataFrame(rows, "i long, topic string, x long, y long")
        wanted = pick.select("topic", F.explode(F.array("x", "y")).alias("r")).distinct()
        marks = starts.select("topic", F.col("before").alias("r"), F.struct("bucket", "before").alias("b"), F.lit(False).alias("drawn"))
        marks = marks.unionByName(wanted.withColumn("drawn", F.lit(True)), allowMissingColumns=True)
        near = marks.select("topic", "drawn", F.last("b", ignorenulls=True).over(upto).alias("b")).where("drawn").select("topic", "b.*").distinct()
        numbered = d.join(sent(cut(near)), ["topic", "bucket"]).select("topic", "paper_id", (F.col("before") + inner - 1).alias("r"))
        numbered = cut(numbered.join(sent(wanted), ["topic", "r"], "left_semi"))
        one = lambda c: numbered.select("topic", F.col("paper_id").alias(f"paper_{c}"), F.col("r").alias(c))
        found = cut(pick.join(one("x"), ["topic", "x"]).join(one("y"), ["topic", "y"]))
        ours = found.select(F.explode(F.array("paper_x", "paper_y")).alias("paper_id")).distinct()
        all_topics = d.join(sent(ours), "paper_id", "left_semi").groupBy("paper_id").agg(F.collect_set("topic").alias("t"))
        own = lambda c: all_topics.select(F.col("paper_id").alias(f"paper_{c}"), F.col("t").alias(f"t{c}"))
        found = found.join(own("x"), "paper_x").join(own("y"), "paper_y").where(F.col("topic") == F.array_min(F.array_intersect("tx", "ty")))
        found = cut(found.select("i", F.least("paper_x", "paper_y").alias("a"), F.greatest("paper_x", "paper_y").alias("b")))
        if drawn == total or found.count() >= n:
            return found.orderBy("i").limit(n).select("a", "b")


# Question types that are asked about three papers; the others are asked about two.
TRIPLE_TYPES = ("bridge", "causal", "aggregation")


def quota_needs(have: DataFrame, targets: DataFrame, any_triples: bool = True) -> DataFrame:
    """(question_type, need, source): what each type lacks, and whether triples or pairs of papers serve it."""
    source = F.when(F.col("question_type").isin(*TRIPLE_TYPES) & F.lit(any_triples), "triples").otherwise("pairs")
    return targets.join(have.groupBy("question_type").agg(F.count("*").alias("have")), "question_type", "left").select(
        "question_type", F.greatest(F.col("target") - F.coalesce("have", F.lit(0)), F.lit(0)).alias("need"), source.alias("source")
    )


def accept_questions(generated: DataFrame, seen: DataFrame) -> DataFrame:
    """Questions of at least 20 characters not seen before; required papers outside the offered ones are replaced by these."""
    d = generated.where(F.length(F.trim("question")) >= 20).join(seen.select("question"), "question", "left_anti")
    inside = (F.size("required") > 0) & (F.size(F.array_except("required", "offered")) == 0)
    return d.withColumn("required", F.when(inside, F.col("required")).otherwise(F.col("offered")))


def paper_contexts(groups: DataFrame, papers: DataFrame, chars: int = 400) -> DataFrame:
    """(group, context) of (group, position, paper_id): the papers' cards in order, between lines of dashes.

    papers: paper_id, title, year, abstract and, if they have one, tldr.
    """
    # The card's form.
    tldr = F.col("tldr") if "tldr" in papers.columns else F.lit("")
    more = F.when(F.coalesce(tldr, F.lit("")) != "", F.concat(F.lit("TL;DR: "), tldr, F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("["), "paper_id", F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit(")\n"))
    card = F.concat(head, F.lit("Abstract: "), F.substring(F.coalesce("abstract", F.lit("")), 1, chars), F.lit("\n"), more)
    d = groups.join(papers.select("paper_id", card.alias("card")), "paper_id").groupBy("group").agg(F.sort_array(F.collect_list(F.struct("position", "card"))).alias("c"))
    return d.select("group", F.array_join(F.transform("c", lambda x: x["card"]), "\n---\n").alias("context"))


def gold_questions(raw: DataFrame) -> DataFrame:
    """(query_id, question_type, hops) of raw rows (query_id, question_type, type, hops, required_hops): both shapes of gold files."""
    return raw.select("query_id", F.coalesce("question_type", "type", F.lit("unknown")).alias("question_type"), F.coalesce("hops", "required_hops", F.lit(0)).alias("hops"))


def question_ids(existing: int, number: Column) -> Column:
    return F.format_string("Q%03d", (number + existing).cast("int"))


#: Words of first papers that are sent to all tasks at once; more are dealt by word. Rows that a task counts together, and results that it holds before the best are kept.
SENT_WORDS, COUNTED, HELD = 4_000_000, 64, 1 << 18


def _two_best(firsts: pa.Table, over: int):
    """A map from papers (third, words, cited) to the best two for each first paper (a, words): (query_id, id, score) for (a, third, cited)."""
    words = firsts.column("words").combine_chunks()
    flat, owner = words.flatten(), np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    vocabulary = flat.unique()
    code = pc.index_in(flat, value_set=vocabulary).to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    owner, sizes = owner[order], np.bincount(code, minlength=len(vocabulary))
    starts, names = np.cumsum(sizes) - sizes, firsts.column("a").combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, COUNTED):
                part = batch.slice(at, COUNTED)
                own = part.column("words")
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(own).to_numpy(zero_copy_only=False))
                known = pc.index_in(own.flatten(), value_set=vocabulary)
                is_known = known.is_valid().to_numpy(zero_copy_only=False)
                known, row = pc.fill_null(known, 0).to_numpy(zero_copy_only=False)[is_known], row[is_known]
                n = sizes[known]
                ends = np.cumsum(n)
                first = owner[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[known] - (ends - n), n)]
                shared = np.bincount(np.repeat(row, n) * len(words) + first, minlength=part.num_rows * len(words))
                hit = np.flatnonzero(shared > over)
                third, a = pa.array(hit // len(words)), pa.array(hit % len(words))
                rows = pa.table({"query_id": names.take(a), "id": part.column("third").take(third), "score": part.column("cited").take(third)})
                found.append(rows.filter(pc.not_equal(rows.column("query_id"), rows.column("id"))))
                if sum(t.num_rows for t in found) > HELD:
                    found = [cut_best(pa.concat_tables(found), 2)]
            if found:
                yield from cut_best(pa.concat_tables(found), 2).to_batches()

    return run


def triples(pairs: DataFrame, papers: DataFrame, over: int = 20, head: int = 256, growth: int = 16) -> DataFrame:
    """Per pair (a, b) the most cited third paper with more than `over` words in common with a; distinct unordered triples.

    papers: paper_id (unique), words (distinct array), citation_count (null counts as fewest). Third papers are met in citation
    order: first those with as many citations as the `head` most cited, then down to the `head` * `growth` most cited, and so on. A
    pair leaves as soon as it has one, which is then the best of all. While the words of the first papers still sought for are few, they
    go to every task and papers are counted where they lie, a task giving two for each first paper; else both sides meet by word.
    A pair whose triple another pair has gives no other.
    """
    wordy = papers.where(F.size("words") > over).select(F.col("paper_id").alias("third"), "words", F.coalesce("citation_count", F.lit(-1)).cast("long").alias("cited"))
    wordy = stored(wordy, "words")  # read again and again, mostly one column or few rows of it
    open_, kind = cut(pairs.select("a", "b").distinct()), dict(papers.dtypes)["paper_id"]
    n, found, high = wordy.count(), None, None
    while True:
        low = wordy.agg(F.percentile_approx("cited", max(0.0, 1 - head / max(n, 1)), 1_000_000)).first()[0] if head < n else None
        some = wordy if low is None else wordy.where(F.col("cited") >= low)
        some = some if high is None else some.where(F.col("cited") < high)
        firsts = wordy.join(sent(open_.select(F.col("a").alias("third")).distinct()), "third", "left_semi").select(F.col("third").alias("a"), "words")
        firsts = cut(firsts)
        if (firsts.agg(F.sum(F.size("words"))).first()[0] or 0) <= SENT_WORDS:
            met = some.mapInArrow(_two_best(firsts.toArrow(), over), f"query_id {kind}, id {kind}, score long").toDF("a", "third", "cited")
        else:
            words = some.select("third", "cited", F.explode("words").alias("word"))
            met = words.join(firsts.select("a", F.explode("words").alias("word")), "word").where("a <> third").groupBy("a", "third").agg(F.count("*").alias("n"), F.max("cited").alias("cited"))
            met = met.where(F.col("n") > over).select("a", "third", "cited")
        met = top_k(met, ["a"], [F.desc("cited"), F.col("third")], 2)
        best = top_k(open_.join(met.drop("rank"), "a").where("third <> b"), ["a", "b"], [F.desc("cited"), F.col("third")], 1).select("a", "b", "third")
        best = cut(best if found is None else found.unionByName(best))
        found, open_ = best, cut(open_.join(best, ["a", "b"], "left_anti"))
        if low is None or open_.isEmpty():
            break
        head, high = head * growth, low
    s = F.array_sort(F.array("a", "b", "third"))
    return found.select(s[0].alias("p1"), s[1].alias("p2"), s[2].alias("p3")).distinct()


def remaining(gold: DataFrame, results: DataFrame) -> DataFrame:
    """Resume rule: questions without a result yet."""
    return gold.join(results.select("query_id"), "query_id", "left_anti")


def with_scores(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Judge scores beside results; null where there are none."""
    return results.join(scores, "query_id", "left")
