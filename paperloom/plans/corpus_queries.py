"""Queries on sources, corpus building, chunking, quality, enrichment and the manifest, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import ids, sets, text
from ..operators import chunking, corpus, dedup, enrich, manifest, quality
from ..operators.lineage import shared_folder
from ..sources import records
from .adapters import CITATIONS, PAPERS, citations, edges, papers, parts, sections, table

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def bands(spark):
    # Sampling targets per year band.
    return spark.createDataFrame([("early", 2012, 2016, 30), ("middle", 2017, 2021, 80), ("late", 2022, 2029, 500)], 'label string, start int, "end" int, target int'.replace('"', "`"))


BANDS = "bands(label, a, z, target) AS (VALUES ('early', 2012, 2016, 30), ('middle', 2017, 2021, 80), ('late', 2022, 2029, 500))"


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("a1_a7_files", f"""
WITH {PAPERS} SELECT paper_id, md5(title) AS title_md5, [lang] AS categories, 'A. ' || source AS author, list_sum([ordinal % 8, 0.5]) AS vector_sum, CASE WHEN ordinal % 2 = 0 THEN 'child' ELSE 'parent' END AS chunk_type FROM papers""")
def a1(spark, d):
    """Papers as JSON records, vectors as a JSON object, chunks by type, a CSV of titles: written first, then read and joined."""
    path = _folder(spark, "files")
    p = papers(spark, d).select("ordinal", "paper_id", "title", F.array(F.concat(F.lit("A. "), "source")).alias("authors"), "categories")
    p.drop("ordinal").write.json(f"{path}/papers")
    p.select(F.to_json(F.create_map("paper_id", F.array((F.col("ordinal") % 8).cast("float"), F.lit(0.5).cast("float")))).alias("value")).write.option("lineSep", "\n").text(f"{path}/vectors")
    kind = F.when(F.col("ordinal") % 2 == 0, "child").otherwise("parent")
    records.write_chunks(p.select(F.col("paper_id").alias("chunk_id"), kind.alias("chunk_type")), f"{path}/chunks")
    records.write_csv(p, ["paper_id", "ordinal"], f"{path}/csv")
    back = records.read_records(spark, f"{path}/papers", records.PAPERS, lines=True)
    vectors = records.read_vector_map(spark, f"{path}/vectors", lines=True)
    chunks = records.read_chunks(spark, f"{path}/chunks", ("parent", "child")).select("chunk_id", "chunk_type")
    listed = spark.read.option("header", True).csv(f"{path}/csv").select("paper_id")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return back.join(listed, "paper_id").join(vectors.withColumnRenamed("chunk_id", "paper_id"), "paper_id").join(chunks.withColumnRenamed("chunk_id", "paper_id"), "paper_id").select(
        "paper_id", F.md5("title").alias("title_md5"), "categories", F.col("authors")[0].alias("author"), total.alias("vector_sum"), "chunk_type"
    )


@query("a6_a7_files_present", """
SELECT CAST(s_suppkey AS VARCHAR) AS paper_id, count(l_orderkey) AS n, round(coalesce(sum(l_quantity), 0), 2) AS total FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey WHERE s_suppkey % 3 <> 0 GROUP BY 1""")
def a6(spark, d):
    """A JSON report per supplier, but for every third; the suppliers whose report is there, with what it says."""
    path = _folder(spark, "reports")
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("paper_id"))
    sums = s.join(table(spark, d, "lineitem"), F.col("l_suppkey") == F.col("s_suppkey"), "left").where("s_suppkey % 3 <> 0")
    sums = sums.groupBy("paper_id").agg(F.count("l_orderkey").alias("n"), F.round(F.coalesce(F.sum("l_quantity"), F.lit(0.0)), 2).alias("total"))
    records.write_report(sums, path, "paper_id")
    there = records.with_files(s.select("paper_id"), records.list_files(spark, path, name=r"/paper_id=([^/]+)/[^/]+$"))
    said = spark.read.schema("n long, total double, paper_id string").json(path)
    return there.join(said, "paper_id")


@query("a8_structured_documents", f"""
WITH {PAPERS}, x AS (SELECT *, list_filter(list_transform(string_split(abstract, chr(10)), lambda v: trim(v)), lambda v: v <> '') AS l FROM papers)
SELECT paper_id, CASE WHEN ordinal % 10 = 3 THEN 'malformed' ELSE 'success' END AS status, CASE WHEN ordinal % 10 <> 3 THEN trim(title) END AS title, CASE WHEN ordinal % 10 <> 3 THEN 'A. ' || source END AS authors,
CASE WHEN ordinal % 10 <> 3 THEN len(l) + CASE WHEN len(l) > 0 THEN 1 ELSE 0 END END AS n_paragraphs, CASE WHEN ordinal % 10 <> 3 THEN CASE WHEN len(l) > 0 THEN md5(array_to_string(l, chr(10) || chr(10)) || chr(10) || chr(10) || 'deep') ELSE '' END END AS text_md5,
CASE WHEN ordinal % 10 <> 3 THEN 'Ref ' || paper_id || '/' || CAST(year AS VARCHAR) END AS refs FROM x""")
def a8(spark, d):
    """Documents written as TEI and read again; every tenth is cut short."""
    safe = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    p = papers(spark, d)
    paras = F.filter(F.transform(F.split("abstract", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    body = F.when(F.size(paras) > 0, F.concat(F.lit('<div><head n="1">Intro</head>'), F.array_join(F.transform(paras, lambda x: F.concat(F.lit("<p>"), safe(x), F.lit("</p>"))), ""), F.lit("<div><head>Inner</head><p>deep</p></div></div>"))).otherwise("")
    xml = F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title type="main">'), safe(F.col("title")), F.lit("</title></titleStmt><sourceDesc><author><persName><forename>A.</forename><surname>"), F.col("source"),
        F.lit("</surname></persName></author></sourceDesc></fileDesc></teiHeader><text><body>"), body, F.lit("</body><back><listBibl><biblStruct><analytic><title level='a'>Ref "), F.col("paper_id"),
        F.lit("</title></analytic><monogr><imprint><date type='published' when='"), F.col("year").cast("string"), F.lit("-01'/></imprint></monogr></biblStruct></listBibl></back></text></TEI>"),
    )
    x = p.select("paper_id", F.when(F.col("ordinal") % 10 == 3, F.substring(xml, 1, 300)).otherwise(xml).alias("xml"))
    s = records.structured_documents(x)
    top = F.filter("sections", lambda v: ~F.contains(v["path"], F.lit(".")))
    refs = F.array_join(F.transform("references", lambda r: F.concat(r["title"], F.lit("/"), r["year"])), ";")
    return s.select(
        "paper_id", "status", "title", F.array_join("authors", ",").alias("authors"), F.aggregate("sections", F.lit(0), lambda a, v: a + F.when(F.contains(v["path"], F.lit(".")), 0).otherwise(F.size(v["paragraphs"]))).alias("n_paragraphs"),
        F.when(F.size(top) > 0, F.md5(top[0]["text"])).when(F.col("status") == "success", "").alias("text_md5"), F.when(F.col("status") == "success", refs).alias("refs"),
    )


@query("a9_page_assembly", f"""
WITH {PAPERS}, x AS (SELECT paper_id, list_filter(list_transform(string_split(abstract, chr(10)), lambda v: trim(v)), lambda v: v <> '') AS l FROM papers)
SELECT paper_id, md5(array_to_string(l, chr(10) || chr(10))) AS text_md5, len(l) AS page_count, length(array_to_string(l, chr(10) || chr(10))) AS char_count FROM x""")
def a9(spark, d):
    pages = papers(spark, d).select("paper_id", F.posexplode(F.split("abstract", "\n")).alias("i", "text")).select("paper_id", (F.col("i") + 1).alias("page_num"), "text")
    return records.assemble_pages(pages).select("paper_id", F.md5("full_text").alias("text_md5"), "page_count", "char_count")


@query("a10_status_summary", """
SELECT CASE WHEN n_chars < 500 THEN 'too_short' WHEN n_chars > 5000 THEN 'too_long' ELSE 'success' END AS status, count(*) AS n FROM documents GROUP BY 1""")
def a10(spark, d):
    return records.status_summary(papers(spark, d), F.when(F.col("n_chars") < 500, "too_short").when(F.col("n_chars") > 5000, "too_long").otherwise("success"))


@query("b1_append_new", f"""
WITH {PAPERS} SELECT paper_id, year FROM papers WHERE ordinal % 3 <> 0 AND year >= 2015 AND lang IN ('en', 'de')
ORDER BY year DESC, paper_id LIMIT (SELECT greatest(0, 500 - count(*)) FROM papers WHERE ordinal % 3 = 0)""")
def b1(spark, d):
    p = papers(spark, d)
    return corpus.append_new(p.where("ordinal % 3 = 0"), p, 2015, ["en", "de"], 500).select("paper_id", "year")


@query("b2_sample_bands", f"""
WITH {PAPERS}, {BANDS}, ex AS (SELECT * FROM papers WHERE ordinal % 10 = 0),
need AS (SELECT label, a, z, greatest(target - (SELECT count(*) FROM ex WHERE year BETWEEN a AND z), 0) AS need FROM bands),
s AS (SELECT p.*, label, need, row_number() OVER (PARTITION BY label ORDER BY n_chars, paper_id) AS r FROM papers p JOIN need ON year BETWEEN a AND z),
f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n_chars, paper_id) AS q FROM s
      WHERE r <= 3 * need AND ordinal % 10 <> 0 AND lang IN ('en', 'fr') AND length(abstract) >= 100)
SELECT paper_id, label AS year_band FROM f WHERE q <= need""")
def b2(spark, d):
    p = papers(spark, d).withColumn("relevance", F.col("n_chars"))
    return corpus.sample_bands(p, p.where("ordinal % 10 = 0"), bands(spark), ["en", "fr"]).select("paper_id", "year_band")


@query("b3_backfill_seeds", f"""
WITH {PAPERS} SELECT paper_id, CASE WHEN ordinal % 5 = 0 THEN 'foundational' END AS year_band, CASE WHEN ordinal % 5 = 0 THEN TRUE END AS is_seed
FROM papers WHERE ordinal % 2 = 0 OR ordinal % 5 = 0 AND ordinal % 2 <> 0""".replace("CASE WHEN ordinal % 5 = 0", "CASE WHEN ordinal % 5 = 0 AND ordinal % 2 <> 0"))
def b3(spark, d):
    p = papers(spark, d).select("paper_id", "ordinal")
    return corpus.backfill_seeds(p.where("ordinal % 2 = 0"), p, p.where("ordinal % 5 = 0")).select("paper_id", "year_band", "is_seed")


@query("b4_band_counts", f"""
WITH {PAPERS}, {BANDS}, t AS (SELECT coalesce(label, 'unknown') AS label FROM papers LEFT JOIN bands ON year BETWEEN a AND z AND label <> 'middle')
SELECT coalesce(b.label, c.label) AS label, coalesce(n, 0) AS n FROM bands b FULL JOIN (SELECT label, count(*) AS n FROM t GROUP BY 1) c ON b.label = c.label""")
def b4(spark, d):
    b = bands(spark)
    p = papers(spark, d)
    tagged = p.join(b.where("label <> 'middle'"), (p.year >= b.start) & (p.year <= b.end), "left").withColumn("year_band", F.col("label"))
    return corpus.band_counts(tagged.select("year_band"), b)


@query("b5_paper_ids", f"""
WITH {PAPERS} SELECT paper_id AS raw_no, split_part(split_part('http://x.org/abs/' || paper_id || '.0001v' || CAST(ordinal % 4 AS VARCHAR), '/abs/', 2), 'v', 1) AS paper_id FROM papers""")
def b5(spark, d):
    p = papers(spark, d)
    raw = F.concat(F.lit("http://x.org/abs/"), "paper_id", F.lit(".0001v"), (F.col("ordinal") % 4).cast("string"))
    return p.select(F.col("paper_id").alias("raw_no"), ids.paper_id(raw).alias("paper_id"))


@query("b6_keep_first", f"""
WITH {PAPERS} SELECT title, min(ordinal) AS ordinal, arg_min(source, ordinal) AS source FROM papers GROUP BY title""")
def b6(spark, d):
    return corpus.keep_first(papers(spark, d).select("title", "ordinal", "source"), "title", "ordinal")


TITLE = r"trim(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"


@query("b7_normalized_titles", f"WITH {PAPERS} SELECT paper_id, {TITLE} AS title FROM papers")
def b7(spark, d):
    return papers(spark, d).select("paper_id", text.normalize_title(F.col("title")).alias("title"))


def _words(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _sim(abstract):
    return f"""
t AS (SELECT ordinal, paper_id, list_distinct(list_filter(string_split({TITLE}, ' '), lambda w: w <> '' AND NOT list_contains({_words(text.TITLE_STOP)}, w))) AS t,
  list_distinct(list_filter(regexp_extract_all(lower({abstract}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: NOT list_contains({_words(text.ABSTRACT_STOP)}, w))) AS s FROM papers)"""


SIM, WHOLE_SIM = _sim("substr(abstract, 1, 200)"), _sim("abstract")


@query("b8_b9_similarity", f"""
WITH {PAPERS}, {SIM}, j AS (SELECT a.paper_id AS a, b.paper_id AS b, len(list_intersect(a.t, b.t)) AS ti, len(a.t) AS ta, len(b.t) AS tb,
  len(list_intersect(a.s, b.s)) AS si, len(a.s) AS sa, len(b.s) AS sb FROM t a JOIN t b ON b.ordinal = a.ordinal + 1)
SELECT a, b, CASE WHEN ta = 0 OR tb = 0 THEN 0 ELSE round(ti / (ta + tb - ti), 6) END AS title_sim,
  CASE WHEN sa = 0 OR sb = 0 THEN 0 ELSE round(si / (sa + sb - si), 6) END AS abstract_sim FROM j""")
def b8(spark, d):
    p = papers(spark, d).select("ordinal", "paper_id", text.title_tokens(F.col("title")).alias("t"), text.abstract_tokens(F.substring("abstract", 1, text.ABSTRACT_CHARS)).alias("s"))
    a, b = p.toDF("o", "a", "ta", "sa"), p.select((F.col("ordinal") - 1).alias("o"), F.col("paper_id").alias("b"), F.col("t").alias("tb"), F.col("s").alias("sb"))
    r = lambda x, y: F.round(sets.jaccard(F.col(x), F.col(y)), 6)
    return a.join(b, "o").select("a", "b", r("ta", "tb").alias("title_sim"), r("sa", "sb").alias("abstract_sim"))


GREEDY = f"""{PAPERS}, {WHOLE_SIM}, x AS (SELECT ordinal, t, s, unnest(t) AS w FROM t),
c AS (SELECT a.ordinal AS a, b.ordinal AS b, count(*) AS ti, any_value(len(a.t)) AS ta, any_value(len(b.t)) AS tb, any_value(a.s) AS sa, any_value(b.s) AS sb
      FROM x a JOIN x b ON a.w = b.w AND a.ordinal < b.ordinal GROUP BY 1, 2),
r AS (SELECT a, b, ti / (ta + tb - ti) AS ts, len(list_intersect(sa, sb)) / (len(sa) + len(sb) - len(list_intersect(sa, sb))) AS ss FROM c WHERE len(sa) > 0 AND len(sb) > 0),
e AS (SELECT * FROM r WHERE ts > 0.85 AND ss > 0.80),
l AS (SELECT list({{'b': b, 'before': before}} ORDER BY b) AS l FROM (SELECT b, list(a) AS before FROM e GROUP BY 1)),
g AS (SELECT list_reduce(l, lambda s, v: CASE WHEN len(list_filter(v.before, lambda a: NOT list_contains(s, a))) > 0 THEN list_append(s, v.b) ELSE s END, CAST([] AS BIGINT[])) AS gone FROM l),
k AS (SELECT b AS ordinal, min(a) AS kept_ordinal FROM e, g WHERE list_contains(gone, b) AND NOT list_contains(gone, a) GROUP BY 1)"""


@query("b10_near_duplicates", f"""WITH {GREEDY}
SELECT ordinal, kept_ordinal, round(ts, 3) AS title_sim, round(ss, 3) AS abstract_sim FROM k JOIN e ON b = ordinal AND a = kept_ordinal""")
def b10(spark, d):
    return dedup.near_duplicates(papers(spark, d))


@query("b11_removal_counts", f"""WITH {GREEDY}
SELECT (SELECT count(*) + count(*) FILTER (WHERE ordinal % 7 = 0) FROM papers) AS original_count, (SELECT count(*) FILTER (WHERE ordinal % 7 = 0) FROM papers) AS exact_dupes_removed,
count(*) AS near_dupes_removed, (SELECT count(*) FROM papers) - count(*) AS final_count FROM k""")
def b11(spark, d):
    p = papers(spark, d)
    return dedup.removal_counts(p.unionAll(p.where("ordinal % 7 = 0")))


@query("b10_similar_pairs", f"""
WITH {PAPERS}, {WHOLE_SIM}, x AS (SELECT ordinal, t, s, unnest(t) AS w FROM t),
c AS (SELECT a.ordinal AS a, b.ordinal AS b, count(*) AS ti, any_value(len(a.t)) AS ta, any_value(len(b.t)) AS tb, any_value(a.s) AS sa, any_value(b.s) AS sb
      FROM x a JOIN x b ON a.w = b.w AND a.ordinal < b.ordinal GROUP BY 1, 2),
r AS (SELECT a, b, ti / (ta + tb - ti) AS ts, len(list_intersect(sa, sb)) AS si, len(sa) AS la, len(sb) AS lb FROM c)
SELECT a, b FROM r WHERE ts > 0.85 AND la > 0 AND lb > 0 AND si / (la + lb - si) > 0.80""")
def b10_pairs(spark, d):
    return dedup.similar_pairs(papers(spark, d)).select("a", "b")


def _chunk_rows(spark, d, cond, method):
    return papers(spark, d).where(cond).select(F.concat("paper_id", F.lit("::abstract")).alias("chunk_id"), "paper_id", F.lit("abstract").alias("chunk_type"), F.lit(method).alias("extraction_method"))


@query("b12_merge_chunks", f"""
WITH {PAPERS} SELECT paper_id || '::abstract' AS chunk_id, paper_id, 'abstract' AS chunk_type,
CASE WHEN ordinal % 2 = 0 THEN 'structured' ELSE 'fallback' END AS extraction_method FROM papers WHERE ordinal % 2 = 0 OR ordinal % 3 = 0""")
def b12(spark, d):
    return corpus.merge_chunks(_chunk_rows(spark, d, "ordinal % 2 = 0", "structured"), _chunk_rows(spark, d, "ordinal % 3 = 0", "fallback"))


@query("b13_route", f"""
WITH {PAPERS} SELECT paper_id, CASE WHEN ordinal % 2 = 0 THEN 'primary' ELSE 'fallback' END AS route FROM papers WHERE ordinal % 4 <> 1""")
def b13(spark, d):
    p = papers(spark, d)
    return corpus.route(p, p.where("ordinal % 4 <> 1"), p.where("ordinal % 2 = 0"))


@query("b14_summary", f"""
WITH {PAPERS} SELECT 'abstract' AS chunk_type, CASE WHEN ordinal % 2 = 0 THEN 'structured' ELSE 'fallback' END AS extraction_method,
count(*) AS n_chunks, count(DISTINCT paper_id) AS n_papers FROM papers WHERE ordinal % 2 = 0 OR ordinal % 3 = 0 GROUP BY 2""")
def b14(spark, d):
    return corpus.summary(b12(spark, d))


@query("b15_with_metadata", """
SELECT CAST(e.l_orderkey AS VARCHAR) AS citing_id, CAST(e.l_partkey AS VARCHAR) AS paper_id, coalesce(p_name, '') AS title, coalesce(p_size, 0) AS year
FROM lineitem e LEFT JOIN (SELECT * FROM part WHERE p_partkey % 11 <> 0) ON l_partkey = p_partkey""")
def b15(spark, d):
    e = edges(spark, d).select("citing_id", F.col("cited_id").alias("paper_id"))
    return corpus.with_metadata(e, parts(spark, d).where("ordinal % 11 <> 0"), "paper_id", {"title": "", "year": 0})


@query("b16_insert_or_ignore", f"""
WITH {PAPERS} SELECT title, min(ordinal) AS ordinal FROM papers WHERE title NOT IN (SELECT title FROM papers WHERE ordinal % 4 = 0) GROUP BY 1""")
def b16(spark, d):
    p = papers(spark, d).select("title", "ordinal")
    return corpus.insert_or_ignore(p.where("ordinal % 4 = 0"), p, "title", "ordinal")


@query("b17_vectors_to_load", """
SELECT CAST(vec_id AS VARCHAR) AS chunk_id, label FROM embeddings JOIN documents ON vec_id = doc_id
WHERE NOT (vec_id % 3 = 0 AND vec_id % 2 = 0)""")
def b17(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "label")
    chunks = papers(spark, d).select(F.col("paper_id").alias("chunk_id"))
    ledger = e.select("chunk_id", F.when(F.col("chunk_id").cast("long") % 2 == 0, "main").otherwise("other").alias("index_name")).where("cast(chunk_id as long) % 3 = 0")
    return corpus.vectors_to_load(chunks, e, ledger, "main").select("chunk_id", "label")


@query("b18_split_vectors", """
SELECT CASE WHEN vec_id % 5 = 0 THEN 'missing id' WHEN vec_id % 7 = 0 THEN 'wrong dimension 63' END AS error, count(*) AS n FROM embeddings GROUP BY 1""")
def b18(spark, d):
    e = table(spark, d, "embeddings")
    bad = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    rows = e.select(F.when(F.col("vec_id") % 5 != 0, F.col("vec_id").cast("string")).alias("chunk_id"), bad.alias("embedding"))
    return corpus.split_vectors(rows, 64).groupBy("error").agg(F.count("*").alias("n"))


@query("b19_b20_light_metadata", f"""
WITH {PAPERS} SELECT paper_id || '::abstract' AS chunk_id, paper_id, substr(title, 1, 200) AS title, substr(source || ' ' || title, 1, 100) AS section, year,
lang AS category, n_chars AS citation_count FROM papers""")
def b19(spark, d):
    p = papers(spark, d)
    chunks = p.select(F.concat("paper_id", F.lit("::abstract")).alias("chunk_id"), "paper_id", F.concat_ws(" ", "source", "title").alias("section"))
    meta = p.select("paper_id", "title", F.concat(F.col("year").cast("string"), F.lit("-05-01")).alias("year"), F.array("lang", F.lit(None).cast("string")).alias("categories"), F.col("n_chars").cast("string").alias("citation_count"))
    return corpus.light_metadata(chunks, meta).select("chunk_id", "paper_id", "title", "section", "year", F.array_join("categories", ",").alias("category"), "citation_count")


RAW = "regexp_replace(replace(abstract, ', ', '-' || chr(10)), '\\. ', '.' || chr(10) || chr(10) || chr(10) || '12' || chr(10) || '##!!' || chr(10) || chr(10), 'g')"


def _raw():
    """Text with broken words, blank lines, number lines and symbol lines."""
    return F.regexp_replace(F.replace("abstract", F.lit(", "), F.lit("-\n")), r"\. ", ".\n\n\n12\n##!!\n\n")


def _strip(x):
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


@query("c2_clean_section", f"""
WITH {PAPERS} SELECT paper_id, md5({_strip("regexp_replace(regexp_replace(regexp_replace('<p>' || " + RAW + " || '</p>', '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), '<[^>]+>', '', 'g')")}) AS text_md5 FROM papers""")
def c2(spark, d):
    return papers(spark, d).select("paper_id", F.md5(text.clean_section(F.concat(F.lit("<p>"), _raw(), F.lit("</p>")))).alias("text_md5"))


W = r"[\p{L}\p{N}_]"
CLEAN = f"""
WITH {PAPERS}, a AS (SELECT paper_id, regexp_replace({RAW}, '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM papers),
b AS (SELECT paper_id, regexp_replace(regexp_replace(t, '({W})-\\n({W})', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g') AS t FROM a),
c AS (SELECT paper_id, regexp_replace(regexp_replace(t, '(?m)^\\s*\\d+\\s*$', '', 'g'), '(?m)^[^a-zA-Z0-9\\s]{{3,}}$', '', 'g') AS t FROM b)"""


@query("c1_clean_flat", CLEAN + f"""
SELECT paper_id, md5({_strip("regexp_replace(t, '(?s)\\n(References|Bibliography)\\n.*$', '')")}) AS text_md5 FROM c""")
def c1(spark, d):
    return papers(spark, d).select("paper_id", F.md5(text.clean_flat(_raw())).alias("text_md5"))


@query("c3_clean_fallback", f"""
WITH {PAPERS}, a AS (SELECT paper_id, regexp_replace({RAW}, '({W})-\\n({W})', '\\1\\2', 'g') AS t FROM papers),
b AS (SELECT paper_id, regexp_replace(regexp_replace(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)^\\s*\\d+\\s*$', '', 'g'), '[ \\t]+', ' ', 'g') AS t FROM a),
c AS (SELECT paper_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN trim(x) = '' THEN '' ELSE x END),
  lambda x: x = '' OR length(regexp_replace(trim(x), '\\P{{L}}', '', 'g')) / length(trim(x)) > 0.40) AS l FROM b)
SELECT paper_id, md5({_strip("array_to_string(l, chr(10))")}) AS text_md5 FROM c""")
def c3(spark, d):
    return papers(spark, d).select("paper_id", F.md5(text.clean_fallback(_raw())).alias("text_md5"))


FLAT = f"""
{PAPERS}, x AS (SELECT paper_id, title, year, list_filter(list_transform(string_split(abstract, chr(10)), lambda v: trim(v)), lambda v: length(v) > 50) AS paras FROM papers),
y AS (SELECT *, list_transform(paras, lambda p: {{'p': p, 'cut': CASE WHEN length(p) <= 1536 THEN CAST([] AS VARCHAR[]) ELSE (
  list_transform([list_reduce(string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s, v:
    CASE WHEN s.n + length(v) > 1536 AND len(s.o) > 0 THEN {{'d': list_append(s.d, array_to_string(s.o, ' ')), 'o': [s.o[-1], v], 'n': length(s.o[-1]) + length(v)}}
    ELSE {{'d': s.d, 'o': list_append(s.o, v), 'n': s.n + length(v)}} END,
    {{'d': CAST([] AS VARCHAR[]), 'o': CAST([] AS VARCHAR[]), 'n': CAST(0 AS BIGINT)}})],
    lambda s: CASE WHEN len(s.o) > 0 THEN list_append(s.d, array_to_string(s.o, ' ')) ELSE s.d END)[1]) END}}) AS ps FROM x),
f AS (SELECT *, list_reduce(ps, lambda s, q: CASE
  WHEN length(q.p) > 1536 THEN {{'d': list_concat(CASE WHEN len(s.o) > 0 THEN list_append(s.d, array_to_string(s.o, chr(10) || chr(10))) ELSE s.d END, q.cut), 'o': CAST([] AS VARCHAR[]), 'n': CAST(0 AS BIGINT)}}
  WHEN s.n + length(q.p) > 1536 AND len(s.o) > 0 THEN CASE WHEN length(s.o[-1]) <= 150
    THEN {{'d': list_append(s.d, array_to_string(s.o, chr(10) || chr(10))), 'o': [s.o[-1], q.p], 'n': length(s.o[-1]) + length(q.p)}}
    ELSE {{'d': list_append(s.d, array_to_string(s.o, chr(10) || chr(10))), 'o': [q.p], 'n': length(q.p)}} END
  ELSE {{'d': s.d, 'o': list_append(s.o, q.p), 'n': s.n + length(q.p)}} END,
  {{'d': CAST([] AS VARCHAR[]), 'o': CAST([] AS VARCHAR[]), 'n': CAST(0 AS BIGINT)}}) AS s FROM y),
l AS (SELECT paper_id, title, year, list_filter(CASE WHEN len(s.o) > 0 THEN list_append(s.d, array_to_string(s.o, chr(10) || chr(10))) ELSE s.d END, lambda c: length(c) > 150) AS c FROM f),
flat_chunks AS (SELECT paper_id, title, year, len(c) AS total_chunks, unnest(c) AS c, generate_subscripts(c, 1) - 1 AS i FROM l)"""


@query("c4_split_flat", f"WITH {FLAT} SELECT paper_id, i, md5(c) AS text_md5, length(c) AS n FROM flat_chunks")
def c4(spark, d):
    return papers(spark, d).select("paper_id", F.posexplode(chunking.split_flat(F.col("abstract"), separator="\n")).alias("i", "c")).select("paper_id", "i", F.md5("c").alias("text_md5"), F.length("c").alias("n"))


PACK = """
list_reduce(paras, lambda s, p: CASE WHEN s.n + length(p) > {size} AND len(s.o) > 0 THEN
  CASE WHEN length(s.o[-1]) <= 150 THEN {{'d': list_append(s.d, array_to_string(s.o, chr(10))), 'o': [s.o[-1], p], 'n': length(s.o[-1]) + length(p)}}
  ELSE {{'d': list_append(s.d, array_to_string(s.o, chr(10))), 'o': [p], 'n': length(p)}} END
  ELSE {{'d': s.d, 'o': list_append(s.o, p), 'n': s.n + length(p)}} END,
  {{'d': CAST([] AS VARCHAR[]), 'o': CAST([] AS VARCHAR[]), 'n': CAST(0 AS BIGINT)}})"""


@query("c5_c6_pack", f"""
WITH {PAPERS}, x AS (SELECT paper_id, list_filter(list_transform(string_split(abstract, chr(10)), lambda v: trim(v)), lambda v: v <> '') AS paras FROM papers),
f AS (SELECT paper_id, {PACK.format(size=400)} AS s FROM x),
l AS (SELECT paper_id, list_filter(CASE WHEN len(s.o) > 0 THEN list_append(s.d, array_to_string(s.o, chr(10))) ELSE s.d END, lambda c: length(c) > 80) AS c FROM f)
SELECT paper_id, len(c) AS n_chunks, md5(array_to_string(c, '|')) AS text_md5 FROM l""")
def c5(spark, d):
    p = papers(spark, d).select("paper_id", chunking.pack(F.col("abstract"), 400, separator="\n").alias("c"))
    return p.select("paper_id", F.size("c").alias("n_chunks"), F.md5(F.array_join("c", "|")).alias("text_md5"))


@query("c7_c10_sections", f"""
WITH {PAPERS}, l AS (SELECT paper_id, unnest(string_split(abstract, chr(10))) AS line, generate_subscripts(string_split(abstract, chr(10)), 1) AS i FROM papers),
h AS (SELECT *, CASE WHEN i % 7 = 0 THEN 1 ELSE 0 END AS head FROM l),
s AS (SELECT *, sum(head) OVER (PARTITION BY paper_id ORDER BY i) AS sec FROM h),
g AS (SELECT paper_id, sec, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE head = 0), ''), E' \\n\\t') AS body FROM s GROUP BY 1, 2)
SELECT paper_id, CASE WHEN sec = 0 THEN 'HEADER' ELSE '3. Results ' || CAST(sec AS VARCHAR) END AS heading, CASE WHEN sec = 0 THEN 'HEADER' ELSE 'RESULTS ' || CAST(sec AS VARCHAR) END AS label,
length(body) AS n, length(body) >= 150 AS good FROM g WHERE body <> ''""")
def c7(spark, d):
    lines = F.transform(F.split("abstract", "\n"), lambda x, i: F.when((i + 1) % 7 == 0, F.concat(F.lit("3. Results "), ((i + 1) / 7).cast("int").cast("string"))).otherwise(x))
    p = papers(spark, d).select("paper_id", F.explode(chunking.sections(F.array_join(lines, "\n"))).alias("s")).select("paper_id", "s.*")
    good = chunking.good_section(F.col("heading"), F.col("text"), fallback=True)
    return p.select("paper_id", "heading", chunking.section_label(F.col("heading"), F.lit(None), fallback=True).alias("label"), F.length("text").alias("n"), good.alias("good"))


DONE = "list_filter(CASE WHEN len(s.o) > 0 THEN list_append(s.d, array_to_string(s.o, chr(10))) ELSE s.d END, lambda c: length(c) > 80)"
LINES = "list_filter(list_transform(string_split({0}, chr(10)), lambda v: trim(v)), lambda v: v <> '')"


@query("c11_c12_hierarchical_chunks", f"""
WITH {PAPERS}, x AS (SELECT paper_id, title, string_split(abstract, chr(10)) AS l FROM papers),
s0 AS (SELECT paper_id, unnest(range(0, CAST(ceil(len(l) / 12) AS BIGINT))) AS i, l FROM x),
s1 AS (SELECT paper_id, i, {_strip("regexp_replace(regexp_replace(array_to_string(l[i * 12 + 1:i * 12 + 12], chr(10)), '[ \\t]+', ' ', 'g'), '<[^>]+>', '', 'g')")} AS t FROM s0),
p0 AS (SELECT paper_id, i, {LINES.format("t")} AS paras FROM s1 WHERE length(t) >= 100),
p1 AS (SELECT paper_id, i, {PACK.format(size=1500)} AS s FROM p0),
p2 AS (SELECT paper_id, i, unnest({DONE}) AS t, generate_subscripts({DONE}, 1) AS j FROM p1),
p3 AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY i, j) - 1 AS n FROM p2),
c0 AS (SELECT paper_id, i, n, {LINES.format("t")} AS paras FROM p3),
c1 AS (SELECT paper_id, i, n, {PACK.format(size=400)} AS s FROM c0),
c2 AS (SELECT paper_id, i, n, unnest({DONE}) AS t, generate_subscripts({DONE}, 1) AS j FROM c1),
c3 AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY n, j) - 1 AS m FROM c2)
SELECT paper_id, paper_id || '::abstract' AS chunk_id, 'abstract' AS chunk_type, 'ABSTRACT' AS section, {_strip("title")} AS text, NULL AS parent_chunk_id, length({_strip("title")}) AS char_count FROM x WHERE {_strip("title")} <> ''
UNION ALL SELECT paper_id, paper_id || '::parent::' || printf('%04d', n), 'parent', 'PART ' || CAST(i AS VARCHAR), t, NULL, length(t) FROM p3
UNION ALL SELECT paper_id, paper_id || '::parent::' || printf('%04d', n) || '::child::' || printf('%04d', m), 'child', 'PART ' || CAST(i AS VARCHAR), t, paper_id || '::parent::' || printf('%04d', n), length(t) FROM c3""")
def c11(spark, d):
    return chunking.hierarchical_chunks(sections(spark, d), separator="\n")


@query("c13_flat_chunks", f"WITH {FLAT} SELECT paper_id, i AS chunk_index, total_chunks, length(c) AS char_count, title, year FROM flat_chunks")
def c13(spark, d):
    p = papers(spark, d)
    return chunking.flat_chunks(p, F.col("abstract"), separator="\n").select("paper_id", "chunk_index", "total_chunks", "char_count", "title", "year")


@query("c14_c15_ids", f"""
WITH {PAPERS} SELECT paper_id, paper_id || '::parent::' || printf('%04d', ordinal % 50) || '::child::' || printf('%04d', ordinal % 300) AS chunk_id,
'child' AS chunk_type, CAST(ordinal % 50 AS INTEGER) AS parent_index, CAST(ordinal % 300 AS INTEGER) AS child_index, paper_id || '::parent::' || printf('%04d', ordinal % 50) AS parent_id FROM papers""")
def c15(spark, d):
    p = papers(spark, d)
    cid = ids.child_id(ids.parent_id(F.col("paper_id"), F.col("ordinal") % 50), F.col("ordinal") % 300)
    return p.select(cid.alias("chunk_id")).select("chunk_id", ids.parse(F.col("chunk_id")).alias("x"), ids.parent_of(F.col("chunk_id")).alias("parent_id")).select("chunk_id", "parent_id", "x.*")


@query("c16_chunk_stats", f"""
WITH {PAPERS}, x AS (SELECT paper_id, unnest(string_split(abstract, chr(10))) AS c FROM papers)
SELECT paper_id, count(*) AS n_chunks, CAST(floor(avg(length(c))) AS BIGINT) AS mean_chars FROM x GROUP BY 1""")
def c16(spark, d):
    x = papers(spark, d).select("paper_id", F.explode(F.split("abstract", "\n")).alias("c"))
    return x.groupBy("paper_id").agg(F.count("*").alias("n_chunks"), F.floor(F.avg(F.length("c"))).alias("mean_chars"))


def _check_rows(spark, d):
    """Lines of documents as chunks, with planted faults."""
    x = papers(spark, d).select("ordinal", "paper_id", "title", "source", "year", F.posexplode(F.split("abstract", "\n")).alias("i", "text"))
    n = F.col("ordinal") * 31 + F.col("i")
    return x.select(
        F.concat("paper_id", F.lit("::"), (F.col("i") % 40).cast("string")).alias("chunk_id"),
        "paper_id",
        F.when(n % 3 == 0, "parent").otherwise("child").alias("chunk_type"),
        F.when(n % 17 == 0, F.lit("")).otherwise(F.col("text")).alias("text"),
        F.when(n % 19 == 0, F.lit(None)).otherwise(F.col("title")).alias("title"),
        F.when(n % 23 == 0, F.lit(" ")).otherwise(F.col("source")).alias("section"),
        F.when(n % 29 == 0, F.lit("n/a")).otherwise(F.col("year").cast("string")).alias("year"),
        F.when(n % 5 != 0, F.concat("paper_id", F.lit("::"), (F.col("i") % 7).cast("string"))).alias("parent_chunk_id"),
        F.when(n % 37 == 0, '"A. Name"').when(n % 41 == 0, "no json").when(n % 2 == 0, '["A. Name", "B. Name"]').alias("authors"),
        F.when(n % 43 == 0, '{"a": 1}').otherwise("[]").alias("categories"),
    )


CHECK = f"""{PAPERS}, y AS (SELECT ordinal, paper_id, title, source, year, unnest(string_split(abstract, chr(10))) AS text, generate_subscripts(string_split(abstract, chr(10)), 1) - 1 AS i FROM papers),
z AS (SELECT *, ordinal * 31 + i AS n FROM y),
chunks AS (SELECT paper_id || '::' || CAST(i % 40 AS VARCHAR) AS chunk_id, paper_id, CASE WHEN n % 3 = 0 THEN 'parent' ELSE 'child' END AS chunk_type,
  CASE WHEN n % 17 = 0 THEN '' ELSE text END AS text, CASE WHEN n % 19 <> 0 THEN title END AS title, CASE WHEN n % 23 = 0 THEN ' ' ELSE source END AS section,
  n % 37 = 0 OR n % 41 = 0 AS bad_authors, n % 43 = 0 AS bad_categories,
  CASE WHEN n % 29 = 0 THEN 'n/a' ELSE CAST(year AS VARCHAR) END AS year, CASE WHEN n % 5 <> 0 THEN paper_id || '::' || CAST(i % 7 AS VARCHAR) END AS parent_chunk_id FROM z),
flat AS (SELECT count(*) FILTER (WHERE chunk_type = 'child' AND parent_chunk_id IS NULL) AS missing_parent, count(*) FILTER (WHERE trim(text) = '') AS empty_text,
  count(*) FILTER (WHERE trim(text) <> '' AND length(trim(text)) < 50) AS too_short,
  count(*) FILTER (WHERE trim(text) <> '' AND length(regexp_replace(text, '\\P{{L}}', '', 'g')) / length(text) < 0.40) AS symbol_heavy,
  count(*) FILTER (WHERE trim(text) <> '' AND trim(coalesce(title, '')) = '') AS missing_title,
  count(*) FILTER (WHERE trim(text) <> '' AND trim(section) = '') AS missing_section,
  count(*) FILTER (WHERE trim(text) <> '' AND (year = 'n/a' OR TRY_CAST(year AS INTEGER) NOT BETWEEN 2014 AND 2027)) AS invalid_year,
  count(*) FILTER (WHERE trim(text) <> '' AND bad_authors) AS invalid_authors, count(*) FILTER (WHERE trim(text) <> '' AND bad_categories) AS invalid_categories,
  count(*) FILTER (WHERE title IS NULL) AS null_title FROM chunks),
report AS (SELECT 'missing_parent' AS "check", 'critical' AS severity, missing_parent AS n FROM flat UNION ALL SELECT 'empty_text', 'critical', empty_text FROM flat
  UNION ALL SELECT 'too_short', 'warning', too_short FROM flat UNION ALL SELECT 'symbol_heavy', 'warning', symbol_heavy FROM flat
  UNION ALL SELECT 'missing_title', 'warning', missing_title FROM flat UNION ALL SELECT 'missing_section', 'warning', missing_section FROM flat
  UNION ALL SELECT 'invalid_authors_type', 'warning', invalid_authors FROM flat UNION ALL SELECT 'invalid_categories_type', 'warning', invalid_categories FROM flat
  UNION ALL SELECT 'invalid_year', 'warning', invalid_year FROM flat UNION ALL SELECT 'null_title', 'critical', null_title FROM flat
  UNION ALL SELECT 'null_' || c, 'critical', 0 FROM (VALUES ('chunk_id'), ('paper_id'), ('chunk_type'), ('text'), ('section'), ('year')) v(c)
  UNION ALL SELECT 'duplicate_id', 'critical', CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM chunks GROUP BY chunk_id)
  UNION ALL SELECT 'orphan_child', 'critical', count(*) FROM chunks a WHERE chunk_type = 'child' AND parent_chunk_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM chunks b WHERE b.chunk_type = 'parent' AND b.chunk_id = a.parent_chunk_id))"""


@query("d1_d10_validate", f"WITH {CHECK} SELECT * FROM report")
def d1(spark, d):
    return quality.validate(_check_rows(spark, d))


@query("d1_d10_observed", f"WITH {CHECK} SELECT * FROM report")
def d1_observed(spark, d):
    """The same report, its row checks counted while the chunks are written."""
    return quality.write_validated(_check_rows(spark, d), _folder(spark, "chunks"))


@query("d11_verdict", f"""WITH {CHECK}, v AS (SELECT part, coalesce(sum(n) FILTER (WHERE severity = 'critical'), 0)::BIGINT AS critical, coalesce(sum(n) FILTER (WHERE severity = 'warning'), 0)::BIGINT AS warnings
FROM report, (VALUES ('all'), ('warnings'), ('clean')) p(part) WHERE part = 'all' OR part = 'warnings' AND severity = 'warning' OR n = 0 GROUP BY 1)
SELECT part, critical, warnings, CASE WHEN critical > 0 THEN 'failed' WHEN warnings > 0 THEN 'passed with warnings' ELSE 'passed' END AS verdict FROM v""")
def d11(spark, d):
    """Verdicts on the whole report, on its warnings and on the checks that found nothing."""
    report = d1(spark, d)
    parts_ = {"all": F.lit(True), "warnings": (F.col("severity") == "warning") | (F.col("n") == 0), "clean": F.col("n") == 0}
    out = [quality.verdict(report.where(c)).withColumn("part", F.lit(name)) for name, c in parts_.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("d11_samples", f"""WITH {CHECK}, h AS (
SELECT 'empty_text' AS "check", chunk_id FROM chunks WHERE trim(text) = '' UNION ALL SELECT 'too_short', chunk_id FROM chunks WHERE trim(text) <> '' AND length(trim(text)) < 50
UNION ALL SELECT 'null_title', chunk_id FROM chunks WHERE title IS NULL UNION ALL SELECT 'duplicate_id', chunk_id FROM chunks GROUP BY chunk_id HAVING count(*) > 1
UNION ALL SELECT 'orphan_child', chunk_id FROM chunks a WHERE chunk_type = 'child' AND parent_chunk_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunks b WHERE b.chunk_type = 'parent' AND b.chunk_id = a.parent_chunk_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY chunk_id) AS r FROM h) SELECT * FROM r WHERE r <= 5""")
def d11s(spark, d):
    return quality.samples(_check_rows(spark, d)).where(F.col("check").isin("empty_text", "too_short", "null_title", "duplicate_id", "orphan_child"))


@query("d12_coverage", f"""
WITH {PAPERS}, l AS (SELECT CAST(doc_id AS VARCHAR) AS paper_id, quality FROM labels)
SELECT count(*) AS n_papers, count(quality) AS found, count(*) FILTER (WHERE quality = 1) AS with_quality, round(100.0 * count(quality) / count(*), 3) AS coverage_percent,
count(*) FILTER (WHERE NOT regexp_matches(paper_id, '^[0-9]+$')) AS malformed_ids FROM papers LEFT JOIN l USING (paper_id)""")
def d12(spark, d):
    lab = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("paper_id"), "quality")
    p = papers(spark, d).join(lab, "paper_id", "left")
    return p.agg(
        F.count("*").alias("n_papers"), F.count("quality").alias("found"), F.count_if(F.col("quality") == 1).alias("with_quality"),
        F.round(100.0 * F.count("quality") / F.count("*"), 3).alias("coverage_percent"), F.count_if(~F.rlike("paper_id", F.lit("^[0-9]+$"))).alias("malformed_ids"),
    )


@query("d12_corpus_coverage", f"""
WITH {CHECK}, o AS (SELECT count(*) AS orphans FROM chunks a WHERE chunk_type = 'child' AND NOT EXISTS (SELECT 1 FROM chunks b WHERE b.chunk_type = 'parent' AND b.chunk_id = a.parent_chunk_id)),
i AS (SELECT count(*) AS n_papers, count(doc_id) AS enriched, count(*) FILTER (WHERE doc_id % 3 = 0) AS with_tldr, count(*) FILTER (WHERE good) AS with_references
  FROM (SELECT DISTINCT paper_id FROM chunks) LEFT JOIN (SELECT doc_id, bool_or(quality > 0) AS good FROM labels GROUP BY doc_id) ON CAST(doc_id AS VARCHAR) = paper_id)
SELECT n_papers, enriched, with_tldr, with_references, (SELECT count(*) FROM chunks WHERE chunk_type = 'child') AS n_children, 0 AS malformed_ids, orphans, round(100.0 * enriched / greatest(n_papers, 1), 3) AS coverage_percent FROM i, o""")
def d12c(spark, d):
    tldr = F.when(F.col("doc_id") % 3 == 0, "short").otherwise("")
    lab = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("paper_id"), tldr.alias("tldr"), F.col("quality").alias("reference_count"))
    return quality.corpus_coverage(_check_rows(spark, d), lab)


@query("d13_graph_internality", """
SELECT count(*) AS links, count(p_partkey) AS internal, count(DISTINCT CASE WHEN p_partkey IS NOT NULL THEN l_orderkey END) AS papers_with_internal,
round(count(p_partkey) / greatest(count(*), 1), 6) AS ratio FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 20) ON l_partkey = p_partkey""")
def d13(spark, d):
    return quality.graph_internality(edges(spark, d), parts(spark, d).where("year > 20")).withColumn("ratio", F.round("ratio", 6))


@query("d14_embedding_audit", """
SELECT count(*) AS n_vectors, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_dims,
count(*) FILTER (WHERE abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) - 1) > 0.001) AS off_norm,
(SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS missing, count(*) FILTER (WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS extra FROM embeddings""")
def d14(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    return quality.audit_embeddings(papers(spark, d).select(F.col("paper_id").alias("chunk_id")), e, 64)


@query("d15_group_similarity", """
WITH m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x, count(*) AS n FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
g AS (SELECT label, any_value(n) AS n, sum(x * x) AS own FROM m GROUP BY 1),
t AS (SELECT i, sum(x * n) / sum(n) AS x, sum(n) AS n FROM m GROUP BY 1)
SELECT round((sum(n * n * own) - sum(n)) / (sum(n * n) - sum(n)), 4) AS same_group,
round(((SELECT sum(x * x) * max(n) * max(n) FROM t) - sum(n * n * own)) / (sum(n) * sum(n) - sum(n * n)), 4) AS cross_group FROM g""")
def d15(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    g = m.groupBy("label").agg(F.max("n").alias("n"), F.sum(F.col("x") * F.col("x")).alias("own"))
    t = m.groupBy("i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("all"))
    s = g.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.col("n") * F.col("own")).alias("w")).crossJoin(t)
    return s.select(
        F.round((F.col("w") - F.col("n")) / (F.col("nn") - F.col("n")), 4).alias("same_group"), F.round((F.col("all") * F.col("n") * F.col("n") - F.col("w")) / (F.col("n") * F.col("n") - F.col("nn")), 4).alias("cross_group")
    )


@query("d16_inventory", "SELECT 'documents' AS dataset, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def d16(spark, d):
    return quality.inventory({n: table(spark, d, n) for n in ("documents", "pages", "embeddings")})


ENRICHED = f"{CITATIONS}, enriched AS (SELECT p.*, coalesce(citation_count, 0) AS citation_count, coalesce(influential_count, 0) AS influential_count, coalesce(tldr, '') AS tldr, CASE WHEN c.paper_id IS NULL THEN 'not_found' ELSE 'found' END AS status FROM parts p LEFT JOIN citations c USING (paper_id))"


def enriched(spark, d):
    return enrich.enrich(parts(spark, d), citations(spark, d))


@query("e1_enrich", f"WITH {ENRICHED} SELECT paper_id, citation_count, influential_count, tldr, status FROM enriched")
def e1(spark, d):
    return enriched(spark, d).select("paper_id", "citation_count", "influential_count", "tldr", "status")


@query("e2_resume", f"WITH {ENRICHED} SELECT paper_id FROM enriched WHERE status <> 'found'")
def e2(spark, d):
    return enrich.still_to_do(parts(spark, d), enriched(spark, d)).select("paper_id")


@query("e3_title_match", f"""
WITH {PAPERS}, w AS (SELECT ordinal, paper_id, list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda v: v <> '') AS w FROM papers),
c AS (SELECT q.paper_id AS query_id, r, c.paper_id AS candidate_id, len(list_intersect(list_distinct(q.w), c.w)) / len(list_distinct(q.w)) AS o
      FROM w q, range(1, 5) x(r), w c WHERE c.ordinal = CASE WHEN r = 2 AND q.ordinal % 2 = 0 THEN q.ordinal ELSE q.ordinal + r END AND len(q.w) > 0)
SELECT query_id, arg_min(candidate_id, r) AS candidate_id, round(arg_min(o, r), 6) AS overlap FROM c WHERE o > 0.7 AND r <= 3 GROUP BY 1""")
def e3(spark, d):
    p = papers(spark, d).select("ordinal", "paper_id", "title")
    q = p.select(F.col("paper_id").alias("query_id"), "title", "ordinal", F.explode(F.array(*map(F.lit, range(1, 5)))).alias("rank"))
    pick = F.when((F.col("rank") == 2) & (F.col("ordinal") % 2 == 0), F.col("ordinal")).otherwise(F.col("ordinal") + F.col("rank"))
    c = q.select("query_id", "rank", pick.alias("ordinal")).join(p, "ordinal").select("query_id", "rank", F.col("paper_id").alias("candidate_id"), "title")
    return enrich.match_titles(p.select(F.col("paper_id").alias("query_id"), "title"), c).withColumn("overlap", F.round("overlap", 6))


@query("e4_concept_tags", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS score, 'c' || CAST(l_partkey AS VARCHAR) AS name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem)
SELECT l_orderkey AS paper_id, coalesce(string_agg(name, ',' ORDER BY r) FILTER (WHERE r <= 5 AND score > 0.3), '') AS tags FROM l GROUP BY 1""")
def e4(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", (F.col("l_quantity") / 50).alias("score"), F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("display_name")).alias("c"))
    g = x.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("c")).alias("c"))
    return g.select(F.col("l_orderkey").alias("paper_id"), F.array_join(enrich.concept_tags(F.col("c")), ",").alias("tags"))


@query("e5_e6_references", """
WITH l AS (SELECT l_orderkey, CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS citing_id, id AS cited_id FROM l WHERE r <= 200 AND id IS NOT NULL""")
def e5(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", F.when(F.col("l_partkey") % 3 != 0, F.concat(F.col("l_partkey").cast("string"), F.lit("v2"))).alias("id")).alias("c"))
    g = x.groupBy(F.col("l_orderkey").cast("string").alias("paper_id")).agg(F.sort_array(F.collect_list("c")).alias("references"))
    return enrich.flatten_references(g)


@query("e7_citation_spread", f"""WITH {ENRICHED}, r AS (SELECT citation_count, row_number() OVER (ORDER BY citation_count DESC) - 1 AS i, count(*) OVER () AS n FROM enriched)
SELECT max(n) AS n_papers, max(citation_count) FILTER (WHERE i = n // 2) AS upper_median, count(*) FILTER (WHERE citation_count = 0) AS n_zero FROM r""")
def e7(spark, d):
    return enrich.citation_spread(enriched(spark, d))


@query("e8_top_cited", f"WITH {ENRICHED} SELECT paper_id, citation_count FROM enriched ORDER BY citation_count DESC, ordinal LIMIT 10")
def e8(spark, d):
    return enrich.top_cited(enriched(spark, d), 10).select("paper_id", "citation_count")


@query("e9_status_counts", f"WITH {ENRICHED} SELECT status, count(*) AS n, CAST(sum(citation_count) AS BIGINT) AS citations, CAST(sum(influential_count) AS BIGINT) AS influential FROM enriched GROUP BY 1")
def e9(spark, d):
    return enrich.status_counts(enriched(spark, d))


@query("f1_f4_distributions", f"""
WITH {PAPERS}, x AS (SELECT CASE WHEN year < 2020 THEN 'old' WHEN year < 2025 THEN 'new' ELSE 'unknown' END AS year_band, CAST(year AS VARCHAR) AS year, source AS extraction_method FROM papers)
SELECT 'year_band' AS dimension, year_band AS value, count(*) AS n FROM x GROUP BY 2 UNION ALL SELECT 'year', year, count(*) FROM x GROUP BY 2 UNION ALL SELECT 'extraction_method', extraction_method, count(*) FROM x GROUP BY 2""")
def f1(spark, d):
    band = F.when(F.col("year") < 2020, "old").when(F.col("year") < 2025, "new")
    return manifest.distributions(papers(spark, d).select(band.alias("year_band"), "year", F.col("source").alias("extraction_method")))


@query("f2_chunk_totals", f"WITH {CHECK} SELECT chunk_type, count(*) AS n FROM chunks GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM chunks")
def f2(spark, d):
    return manifest.chunk_totals(_check_rows(spark, d))


@query("f3_manifest", f"""WITH {CHECK} SELECT (SELECT count(*) FROM papers) AS n_papers, (SELECT min(year) FROM papers) AS first_year, (SELECT max(year) FROM papers) AS last_year,
count(*) FILTER (WHERE chunk_type = 'abstract') AS abstract, count(*) FILTER (WHERE chunk_type = 'parent') AS parent, count(*) FILTER (WHERE chunk_type = 'child') AS child, count(*) AS total FROM chunks""")
def f3(spark, d):
    return manifest.manifest(papers(spark, d), _check_rows(spark, d), "run", "1").select("corpus.*", "chunks.*")
