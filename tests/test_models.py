"""Folds, greedy loops and edge fixtures against plain Python models."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.functions import ids, text
from paperloom.operators import answers, chunking, corpus, dedup, enrich, evaluate, index, quality, retrieve
from paperloom.plans import retrieval_queries
from paperloom.sources import records
from paperloom.streaming import ingest


def one(spark, column, **values):
    kinds = {str: "string", int: "long", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "z long"
    return spark.createDataFrame([tuple(values.values()) or (0,)], schema).select(column.alias("x")).first()[0]


def packed(paras, size, least, sep="\n\n"):
    out, now, n = [], [], 0
    for p in paras:
        if now and n + len(p) > size:
            out.append(sep.join(now))
            now = [now[-1], p] if len(now[-1]) <= 150 else [p]
            n = sum(map(len, now))
        else:
            now.append(p)
            n += len(p)
    return [c for c in [*out, *([sep.join(now)] if now else [])] if len(c) > least]


def test_packers(spark):
    rng = random.Random(5)
    for _ in range(12):
        paras = ["x" * rng.choice([3, 60, 149, 150, 151, 500]) for _ in range(rng.randrange(0, 12))]
        t = "\n\n".join(paras)
        assert one(spark, chunking.pack(F.col("t"), 400), t=t) == packed(paras, 400, 80)
        assert one(spark, chunking.pack(F.col("t"), 400, longer_than=100), t=t) == packed(paras, 400, 100)


def test_flat_splitter_cuts_big_paragraphs(spark):
    sentence = "Word " * 60 + "end."
    big = " ".join([sentence] * 8)
    got = one(spark, chunking.split_flat(F.col("t")), t=f"{'a' * 60}\n\n{big}\n\n{'b' * 200}")
    pieces, now, n = [], [], 0
    for s in [sentence] * 8:
        if now and n + len(s) > 1536:
            pieces.append(" ".join(now))
            now, n = [now[-1], s], len(now[-1]) + len(s)
        else:
            now.append(s)
            n += len(s)
    assert got == [*pieces, " ".join(now), "b" * 200]


def test_sections(spark):
    t = "front\n1. Introduction\nbody one\n\nMethods and more\nbody two\nReferences\n" + "Results " + "y" * 80
    got = one(spark, chunking.sections(F.col("t")), t=t)
    assert [(s["heading"], s["text"]) for s in got] == [("HEADER", "front"), ("1. Introduction", "body one"), ("Methods and more", "body two"), ("References", "Results " + "y" * 80)]
    assert one(spark, chunking.section_label(F.lit("2.1 Results"), F.lit(None), fallback=True)) == "RESULTS"
    assert one(spark, chunking.section_label(F.lit(""), F.lit("4"))) == "SECTION_4"


def test_hierarchy_counts_children_over_the_paper(spark):
    para = "p" * 390
    doc = [("p1v2", "abs", [("A", "1", "\n\n".join([para] * 5)), ("Funding", "2", para), ("B", "3", "\n\n".join([para] * 5))])]
    d = spark.createDataFrame(doc, "paper_id string, abstract string, sections array<struct<heading:string,section_num:string,text:string>>")
    rows = chunking.hierarchical_chunks(d).collect()
    children = sorted(r.chunk_id for r in rows if r.chunk_type == "child")
    parents = sorted(r.chunk_id for r in rows if r.chunk_type == "parent")
    assert [c[-4:] for c in children] == [f"{i:04d}" for i in range(len(children))] and len(parents) == 4
    assert {r.parent_chunk_id for r in rows if r.chunk_type == "child"} == set(parents)
    assert [r.chunk_id for r in rows if r.chunk_type == "abstract"] == ["p1::abstract"]


def test_cleaning(spark):
    raw = "a\n\n\n\nfoo-\nbar  é-\nx\n 12 \n###!!\n== == a\nReferences\nlost"
    assert one(spark, text.clean_flat(F.col("t")), t=raw) == "a\n\nfoobar éx\n\n\n== == a"
    assert one(spark, text.clean_fallback(F.col("t")), t="ab-\ncd\n--- a\n\nok line") == "abcd\n\nok line"
    assert one(spark, text.clean_section(F.col("t")), t=" <b>x</b>\t y ") == "x y"


def test_ids(spark):
    assert one(spark, ids.paper_id(F.col("t")), t="http://h/abs/2001.00001v3") == "2001.00001"
    got = one(spark, ids.parse(F.col("t")), t="p::parent::0007::child::0012")
    assert tuple(got) == ("p", "child", 7, 12)
    assert tuple(one(spark, ids.parse(F.col("t")), t="p::x")) == ("p", "unknown", None, None)
    assert one(spark, ids.parent_of(F.col("t")), t="p::abstract") is None


def test_greedy_chain_keeps_both_ends(spark):
    # words of titles: a and b share 9 of 10, b and c too, a and c only 8 of 12
    w = [f"w{i}" for i in range(13)]
    titles = [" ".join(w[:12]), " ".join(w[:11] + ["n1"]), " ".join(w[:10] + ["n1", "n2"])]
    rows = [(i, t, "same abstract words here") for i, t in enumerate(titles)]
    pairs = dedup.similar_pairs(spark.createDataFrame(rows, "ordinal long, title string, abstract string"), title_over=0.8).select("a", "b")
    assert sorted(map(tuple, pairs.collect())) == [(0, 1), (1, 2)]
    assert [tuple(r) for r in dedup.greedy_removals(pairs).collect()] == [(1, 0)]


@pytest.mark.parametrize("seed", range(3))
def test_greedy_rounds_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(40)}
    kept, gone = [], {}
    for x in range(25):
        near = [k for k in kept if (k, x) in edges]
        if near:
            gone[x] = min(near)
        else:
            kept.append(x)
    got = dedup.greedy_removals(spark.createDataFrame(sorted(edges), "a long, b long"))
    assert {r.ordinal: r.kept_ordinal for r in got.collect()} == gone


def test_similar_pairs_at_the_bounds(spark):
    rows = [(0, "a1 a2 a3 a4", "one two three four five"), (1, "a1 a2 a3 a4", "one two three four"), (2, "the of", "x y"), (3, "the of", "x y"), (4, "b1 b2", ""), (5, "b1 b2", "")]
    d = spark.createDataFrame(rows, "ordinal long, title string, abstract string")
    assert dedup.similar_pairs(d).count() == 0  # abstracts at 0.80 exactly, stop words only, empty abstracts


def test_tolerant_json(spark):
    get = lambda t: one(spark, F.try_variant_get(answers.tolerant_json(F.col("t")), "$.a", "int"), t=t)
    cases = ['{"a": 1}', 'x\n```json\n{"a": 1}\n```\ny', 'text {"a": 1} more', '{"a": 1} and {"b', "hopeless", ""]
    assert [get(c) for c in cases] == [1, 1, 1, 1, None, None]


def test_citation_cleanup(spark):
    a = "X [7] y [1, 2] z [2503.11108 ] and [2401.00001]."
    got = one(spark, answers.clean_citations(F.col("a"), F.lit(None).cast("array<string>"), F.array(F.lit("2503.11108"))), a=a)
    assert got["answer"] == "X y z [2503.11108] and ." and got["citations"] == ["2503.11108"] and got["invalid"] == ["2401.00001"]


def test_claims_and_verdicts(spark):
    c = "[2001.00001]"
    answer = " ".join([f"One {c}.", f"One {c}.", f"Not found {c}.", *(f"S{i} {c}." for i in range(6))])
    rows = answers.claims(spark.createDataFrame([("q", answer)], "query_id string, answer string")).orderBy("claim_no").collect()
    assert [r.claim for r in rows] == [f"One {c}.", *(f"S{i} {c}." for i in range(4))]
    judged = spark.createDataFrame([("q", 0, "unsupported", [])], "query_id string, claim_no int, status string, citations array<string>")
    have = spark.createDataFrame([("q", ["x"])], "query_id string, paper_ids array<string>")
    assert answers.claim_verdicts(judged, have).first().status == "weak"
    assert answers.claim_verdicts(judged, have.limit(0)).first().status == "unsupported"


def test_expand_query(spark):
    go = lambda rewrite, missing, tried: one(spark, answers.expand_query(F.lit("q"), F.col("r"), F.col("m"), F.col("t")), r=rewrite, m=missing, t=tried)
    assert go("better", ["x"], []) == "better"
    assert go("Q", ["x", "y", "z", "w"], []) == "q x y z"
    assert go("better", ["x"], ["better"]) == "better x"
    assert go("better", [], ["better", "better methods", "better techniques"]) is None
    assert go(None, [], []) is None


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(0, "common alpha"), (1, "common beta"), (2, "common beta"), (3, "common gamma delta"), (4, "common epsilon zeta"), (5, "eta theta")], "id long, text string")
    ix = index.bm25_index(docs, "id", F.col("text"))
    idf = {r.term: r.idf for r in ix["df"].collect()}
    assert idf["common"] > 0  # floored
    q = spark.createDataFrame([(0, "beta beta"), (1, "beta"), (2, "nothing")], "query_id long, query string")
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in index.bm25_search(ix, q, 5).collect()}
    assert got[0, 1][0] == got[1, 1][0] == 1 and got[0, 1][1] == pytest.approx(2 * got[1, 1][1], abs=1e-5) and (2, 1) not in got


def test_fusion_and_cap(spark):
    schema = "query_id long, id string, score double, rank int"
    d = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2)], schema)
    s = spark.createDataFrame([(1, "b", 5.0, 1), (1, "c", 4.0, 2)], schema)
    f = retrieve.fuse(d, s)
    got = {r.id: r.rrf for r in f.collect()}
    assert got == {"a": round(2 / 61, 6), "b": round(2 / 62 + 1 / 61, 6), "c": round(1 / 62, 6)}
    capped = retrieve.diversify(f.withColumn("paper", F.when(F.col("id") == "a", "p").when(F.col("id") == "b", "p").otherwise("r")), "paper", 5)
    assert [r.id for r in capped.orderBy("rank").collect()] == ["b", "c"]


def test_dense_ties_and_blocks(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)], "id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.id for r in retrieve.dense_search(v, q, 4).orderBy("rank").collect()] == [0, 1, 2, 3]
    odd = spark.createDataFrame([(100, [1.0]), (101, None)], v.schema)
    assert [r.id for r in retrieve.dense_search(v.unionAll(odd), q, 4).orderBy("rank").collect()] == [0, 1, 2, 3]
    assert retrieve.dense_search(v, q.limit(0), 4).count() == 0


def test_merge_keeps_old_without_new(spark):
    schema = "query_id long, id string, rrf double"
    old, new = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.4)], schema), spark.createDataFrame([(1, "a", 0.1), (1, "c", 0.3)], schema)
    got = [(r.query_id, r.id, r.rrf) for r in retrieve.merge_rounds(old, new).orderBy("query_id", "rank").collect()]
    assert got == [(1, "c", 0.3), (1, "a", 0.1), (2, "b", 0.4)]


def test_title_match_and_concepts(spark):
    q = spark.createDataFrame([("q", "a b c d e f g h i j"), ("z", " ")], "query_id string, title string")
    c = spark.createDataFrame([("q", 1, "x", "a b c d e f g"), ("q", 2, "y", "a b c d e f g h"), ("z", 1, "x", "a")], "query_id string, rank int, candidate_id string, title string")
    assert [(r.query_id, r.candidate_id) for r in enrich.match_titles(q, c).collect()] == [("q", "y")]
    rows = [([("a", 0.9), ("b", 0.1), ("c", 0.4), ("d", 0.3), ("e", 0.5), ("f", 0.9)],)]
    d = spark.createDataFrame(rows, "c array<struct<display_name:string,score:double>>")
    assert d.select(enrich.concept_tags(F.col("c")).alias("x")).first().x == ["a", "c", "e"]


def test_bands_look_at_three_times_the_need(spark):
    rows = [(f"p{i:02d}", 2020, ["x"], ("y" if i < 4 else "z") * (99 if i < 4 else 100), i) for i in range(10)]
    cand = spark.createDataFrame(rows, "paper_id string, year int, categories array<string>, abstract string, relevance int")
    bands = spark.createDataFrame([("b", 2019, 2021, 2), ("full", 2000, 2001, 0)], "label string, start int, end int, target int")
    got = corpus.sample_bands(cand, cand.limit(0), bands, ["x"])
    assert sorted(r.paper_id for r in got.collect()) == ["p04", "p05"]
    have = spark.createDataFrame([("q1", 2020, ["x"], "", 0), ("q2", 2020, ["x"], "", 0)], cand.schema)
    assert corpus.sample_bands(cand, have, bands, ["x"]).count() == 0


def test_upsert_twice_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, n int")
    empty = rows.limit(0)
    first = corpus.insert_or_ignore(empty, rows, "k", "n")
    assert sorted(map(tuple, first.collect())) == [("a", 1), ("b", 3)]
    assert corpus.insert_or_ignore(first, rows, "k", "n").count() == 0
    for _ in range(2):
        ingest.load_batch(rows.select("k"), str(tmp_path / "t"), "k")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_validator_rows(spark):
    t = "word " * 20
    rows = [
        ("1", "p", "parent", t, "T", "S", "2014", None), ("2", "p", "child", t, "T", "S", "2013", "1"), ("3", "p", "child", t, None, " ", "2027", None),
        ("4", "p", "child", " ", None, None, "x", "9"), ("5", "p", "parent", "short", "T", "S", "2028", None), ("5", "p", "parent", "1" * 60, "T", "S", "20x", None),
        ("5", "p", "abstract", t, "T", "S", "2020", None),
    ]
    d = spark.createDataFrame(rows, "chunk_id string, paper_id string, chunk_type string, text string, title string, section string, year string, parent_chunk_id string")
    got = {r.check: r.n for r in quality.validate(d).collect()}
    want = {"missing_parent": 1, "empty_text": 1, "too_short": 1, "symbol_heavy": 1, "missing_title": 1, "missing_section": 1, "invalid_year": 3, "duplicate_id": 2, "orphan_child": 1, "null_title": 2}
    assert {k: got[k] for k in want} == want
    assert quality.orphan_children(d, null_too=True).count() == 2


def test_failure_rules(spark):
    def hint(required, missed, hybrid, supplement, overlap):
        cols = [F.array(*map(F.lit, x)).cast("array<string>") for x in (required, missed, hybrid, supplement)]
        return one(spark, evaluate.failure_hint(*cols, F.lit(overlap)))

    assert hint(["a"], [], [], [], 0.0) == "no_issue"
    assert hint(["a"], ["a"], [], ["a"], 0.9) == "dense_or_fusion_empty"
    assert hint(["a", "b"], ["b"], ["c"], ["a"], 0.9) == "hybrid_miss_abstract_recovery"
    assert [hint(["a"], ["a"], ["c"], [], o) for o in (0.1, 0.2, 0.5)] == ["query_mismatch_or_sparse_vocab", "rerank_or_topk_limit", "near_miss_expand_topk"]
    assert [one(spark, evaluate.severity(F.lit(x))) for x in (0.0, 0.39, 0.4)] == ["zero", "low", "ok"]


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>Other</title><title type="main"> A Title </title></titleStmt>
<sourceDesc><biblStruct><analytic><author><persName><forename>Ann</forename><surname>One</surname></persName></author><author><persName><surname>Two</surname></persName></author></analytic></biblStruct></sourceDesc></fileDesc>
<profileDesc><abstract><p>Short abstract.</p></abstract></profileDesc></teiHeader>
<text><body><div><head n="1">Intro</head><p>First<ref>[1]</ref>part.</p><div><head n="1.1">Deep</head><p>Second.</p><div><p>Third.</p></div></div></div><div><head>Empty</head></div></body>
<back><listBibl><biblStruct><analytic><title level="a">R one</title><author><persName><surname>Three</surname></persName></author><author/></analytic><monogr><title>Journal</title><imprint><date type="published" when="2019-05-01"/></imprint></monogr></biblStruct>
<biblStruct><monogr><title>Book</title></monogr></biblStruct></listBibl></back></text></TEI>"""


def test_structured_documents(spark):
    d = spark.createDataFrame([("a", TEI), ("b", "<TEI><broken"), ("c", "no xml"), ("d", None)], "paper_id string, xml string")
    got = {r.paper_id: r for r in records.structured_documents(d).collect()}
    a = got["a"]
    assert (a.title, a.authors, a.abstract, a.status) == ("A Title", ["Ann One"], "Short abstract.", "success")
    assert [(s.path, s.heading, s.section_num, s.text) for s in a.sections] == [("0", "Intro", "1", "First [1] part.\n\nSecond.\n\nThird."), ("0.0", "Deep", "1.1", "Second.\n\nThird."), ("0.0.0", "", "", "Third.")]
    assert [(r.title, r.authors, r.year) for r in a.references] == [("R one", ["Three"], "2019"), ("Book", [], None)]
    assert {got[x].status for x in "bcd"} == {"malformed"}


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"paper_id": "a", "title": "T", "authors": ["x"]}, {"paper_id": "b"}]')
    d = records.read_records(spark, str(tmp_path / "p.json"), records.PAPERS).orderBy("paper_id")
    assert [(r.paper_id, r.title, r.authors) for r in d.collect()] == [("a", "T", ["x"]), ("b", None, None)]
    rows = [(f"{t}1", "p", t, "S", "x", None, 1) for t in ("abstract", "parent", "child")]
    chunks = spark.createDataFrame(rows, records.CHUNKS)
    records.write_chunks(chunks, str(tmp_path / "c"))
    assert records.read_chunks(spark, str(tmp_path / "c")).count() == 3
    records.write_chunks(chunks.where("chunk_type <> 'child'"), str(tmp_path / "c2"))
    with pytest.raises(FileNotFoundError):
        records.read_chunks(spark, str(tmp_path / "c2"))
    (tmp_path / "v.json").write_text('{"a": [1.0, 2.0], "b": [3.0]}')
    assert {r.chunk_id: r.embedding for r in records.read_vector_map(spark, str(tmp_path / "v.json")).collect()} == {"a": [1.0, 2.0], "b": [3.0]}
    records.write_csv(d, ["title", "paper_id"], str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["title", "paper_id"]
    records.write_report(d.limit(1), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1
    assert sorted(r.paper_id for r in records.list_files(spark, str(tmp_path / "*.json")).collect()) == ["p", "v"]


def test_stream_restart_loads_once(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    make = lambda lo, hi: spark.range(lo, hi).selectExpr("cast(id as string) k", "timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,id) ts")
    schema = "k string, ts timestamp"
    for lo, hi in ((0, 10), (5, 15)):
        make(lo, hi).write.mode("append").parquet(src)
        s = ingest.new_papers(ingest.file_stream(spark, src, schema), "k", "ts").select("k")
        ingest.start_ledger(s, out, "k", state).awaitTermination()
    assert sorted(int(r.k) for r in spark.read.parquet(out).collect()) == list(range(15))


def test_tokens(spark):
    raw = "Self-Attention is A b 2x2 é!"
    assert one(spark, text.tokenize(F.col("t")), t=raw) == [w for w in re.split(r"[^a-z0-9]+", raw.lower().replace("-", " ")) if len(w) > 1 or w == "a"]


@pytest.mark.parametrize("head", [1, 3, 256])
def test_triples_look_at_all_papers(spark, tmp_path, head, monkeypatch):
    monkeypatch.setattr(evaluate, "SENT_WORDS", 0 if head == 3 else 10**6)  # both ways to count
    monkeypatch.setattr(evaluate, "COUNTED", 7)
    rng = random.Random(head)
    some = [f"w{i}" for i in range(60)]
    docs = {i: " ".join(rng.sample(some, rng.randrange(20, 45) + i % 5)) for i in range(160)} | {50: "few words"}
    words = {i: set(t.split()) for i, t in docs.items()}
    firsts, want = [0, 50, 100, 150], set()
    for a in firsts:
        thirds = [(-len(t), str(p)) for p, t in docs.items() if p not in (a, a + 1) and len(words[p] & words[a]) > 20]
        want |= {tuple(sorted((str(a), str(a + 1), min(thirds)[1])))} if thirds else set()
    assert any(int(p) % 5 > 1 for t in want for p in t)
    rows = spark.createDataFrame([(str(i), t.split(), len(t)) for i, t in docs.items()], "paper_id string, words array<string>, citation_count long")
    pairs = spark.createDataFrame([(str(a), str(a + 1)) for a in firsts], "a string, b string")
    assert {tuple(r) for r in evaluate.triples(pairs, rows, head=head).collect()} == want
    table = [(i, t, "en", "s", len(t)) for i, t in docs.items()]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in retrieval_queries.Q["j16_triples"](spark, str(tmp_path)).collect()} == want


def test_answers_hold_whole_turns(spark, tmp_path):
    turn = "Plain words go on. " * 10 + "Far behind is [3] one more [1901.00007]"
    spark.createDataFrame([(7, 1, "assistant", turn), (7, 2, "user", "no")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    q = lambda name: retrieval_queries.Q[name](spark, str(tmp_path)).collect()
    (cleaned,), claims, (marked,) = q("i8_citations"), q("i11_claims"), q("i14_i15_markers")
    assert cleaned.answer.startswith("Plain words go on. " * 10 + "Far behind is one more [1901.00007]. Claim one") and cleaned.citations == "1901.00007"
    assert [c.claim for c in claims][:2] == ["Far behind is [3] one more [1901.00007].", "Claim one holds [1901.00007 ]."]
    assert marked.answer.startswith(turn)


def test_parents_hold_all_their_children(spark, sf):
    chunks = retrieval_queries.doc_chunks(spark, sf).select("paper_id", "chunk_type", "text").collect()
    whole = {c.paper_id: c.text for c in chunks if c.chunk_type == "parent"}
    assert any(len(t) > 300 for t in whole.values())
    assert all(c.text in whole[c.paper_id] for c in chunks if c.chunk_type == "child" and c.paper_id in whole)
