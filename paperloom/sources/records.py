"""Readers and writers of the engine's datasets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

PAPERS = (
    "paper_id string, title string, authors array<string>, published string, updated string, categories array<string>, "
    "primary_category string, abstract string"
)
CHUNKS = "chunk_id string, paper_id string, chunk_type string, section string, text string, parent_chunk_id string, char_count int"


def read_records(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A JSON array of records with an explicit schema; absent fields are null. With lines, one object a line, which splits."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_chunks(spark: SparkSession, path: str, needed: tuple[str, ...] = ("abstract", "parent", "child")) -> DataFrame:
    """Chunks partitioned by type; fails if a type is absent."""
    d = spark.read.parquet(path)
    have = {r[0] for r in d.select("chunk_type").distinct().collect()}  # at most the few types
    if missing := set(needed) - have:
        raise FileNotFoundError(f"no chunks of type {sorted(missing)} in {path}")
    return d


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").partitionBy("chunk_type").parquet(path)


def read_vector_map(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(chunk_id, embedding) of a JSON object id -> list of numbers; with lines, one object a line, which splits."""
    raw = spark.read.option("wholetext", not lines).text(path)
    return raw.select(F.explode(F.from_json("value", "map<string,array<float>>")).alias("chunk_id", "embedding"))


def write_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_report(row: DataFrame, path: str, *by: str) -> None:
    """JSON reports, in a folder of its own for each value of the columns in by. Small rows make many files, so all shuffle partitions write."""
    tasks = int(row.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (row.repartition(tasks, F.xxhash64(*by)) if by else row).write.mode("overwrite").partitionBy(*by).json(path)


def list_files(spark: SparkSession, path: str, most: int | None = None, name: str = r"([^/]+?)(?:\.[A-Za-z]+)*$") -> DataFrame:
    """(path, length, paper_id) of files; contents are not read. name finds the paper's id in the path: by default the file's name."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    d = d.withColumn("paper_id", F.regexp_extract("path", name, 1))
    return d.orderBy("path").limit(most) if most else d


def with_files(papers: DataFrame, files: DataFrame) -> DataFrame:
    """The papers whose file is there."""
    return papers.join(files.select("paper_id"), "paper_id", "left_semi")


STRUCTURED = (
    "paper_id string, title string, authors array<string>, abstract string, "
    "sections array<struct<path:string,heading:string,section_num:string,paragraphs:array<string>,text:string>>, "
    "references array<struct<title:string,authors:array<string>,year:string>>, status string"
)


def _tei(xml: str | None) -> dict:
    """The fields of STRUCTURED from one TEI document; a status alone if it is no well-formed XML."""
    import xml.etree.ElementTree as tree

    try:
        root = tree.fromstring(xml or "")
    except tree.ParseError:
        return {"status": "malformed"}
    for e in root.iter():
        e.tag = str(e.tag).rpartition("}")[2]  # names without their name space
    of = lambda e, path: (e.findtext(path) or "").strip()
    whole = lambda e: " ".join(e.itertext()).strip()

    def sections(div, path: str) -> list[dict]:
        head, paragraphs = div.find("head"), [t for t in map(whole, div.iter("p")) if t]
        here = {"path": path, "heading": of(div, "head"), "section_num": head.get("n", "") if head is not None else "", "paragraphs": paragraphs, "text": "\n\n".join(paragraphs)}
        return [here] + [s for i, d in enumerate(div.findall("div")) for s in sections(d, f"{path}.{i}")]

    def reference(b) -> dict:
        title = b.find(".//title[@level='a']")
        date = b.find(".//date[@type='published']")
        return {
            "title": (title.text or "").strip() if title is not None else of(b, ".//title"),
            "authors": [n for n in (of(a, ".//surname") for a in b.iter("author")) if n],
            "year": date.get("when", "")[:4] if date is not None else None,
        }

    body, abstract, listed = root.find(".//body"), root.find(".//abstract"), root.find(".//listBibl")
    tops = [sections(d, str(i)) for i, d in enumerate(body.findall("div"))] if body is not None else []
    names = [(a.find(".//forename"), a.find(".//surname")) for f in root.iter("fileDesc") for a in f.iter("author")]
    return {
        "title": of(root, ".//titleStmt/title[@type='main']"),
        "authors": [f"{x.text} {y.text}".strip() for x, y in names if x is not None and y is not None],
        "abstract": whole(abstract) if abstract is not None else "",
        "sections": [s for top in tops if top[0]["text"] for s in top],
        "references": [reference(b) for b in listed.findall("biblStruct")] if listed is not None else [],
        "status": "success",
    }


#: Documents whose fields are Python objects at one time.
PARSED = 128


def structured_documents(xml: DataFrame) -> DataFrame:
    """STRUCTURED rows of (paper_id, xml) in TEI; malformed XML gives a status alone.

    Sections without text are left out. A section's text is that of all its paragraphs, also those of its
    subsections, which follow it as rows of their own with a longer path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PARSED):
                b = whole.slice(at, PARSED)
                rows = [{"paper_id": p, **_tei(x)} for p, x in zip(b.column("paper_id").to_pylist(), b.column("xml").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, kind)

    kind = to_arrow_schema(DataType.fromDDL(STRUCTURED))
    return xml.select("paper_id", "xml").mapInArrow(run, STRUCTURED)


def assemble_pages(pages: DataFrame) -> DataFrame:
    """Per document: trimmed non-empty pages in order, their text joined by blank lines, and counts.

    pages: paper_id, page_num, text. A document's pages meet in one row, as its text does in the end.
    """
    p = pages.select("paper_id", F.struct("page_num", F.trim(F.coalesce("text", F.lit(""))).alias("text")).alias("p"))
    d = p.groupBy("paper_id").agg(F.sort_array(F.collect_list("p")).alias("pages"))
    d = d.withColumn("pages", F.filter("pages", lambda x: x["text"] != ""))
    full = F.array_join(F.transform("pages", lambda x: x["text"]), "\n\n")
    return d.select("paper_id", full.alias("full_text"), F.size("pages").alias("page_count"), F.length(full).alias("char_count"))


def status_summary(extractions: DataFrame, status: Column | str = "status") -> DataFrame:
    return extractions.groupBy(F.col(status).alias("status") if isinstance(status, str) else status.alias("status")).agg(F.count("*").alias("n"))
