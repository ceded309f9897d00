"""Cutting text into abstract, parent and child chunks; row-local, so it runs the same on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import abstract_id, child_id, paper_id, parent_id
from ..functions.text import HEADING, clean_section, sentences, strip

PARENT, CHILD, OVERLAP = 1500, 400, 50
SKIP_STRUCTURED = "acknowledg|appendix|funding|declaration"
SKIP_FALLBACK = "references|acknowledgment|acknowledgements|appendix|funding"


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    return F.filter(F.transform(F.split(text, separator), strip), lambda p: p != "")


#: Places that a fold goes over before it puts aside what it has added.
GROUP = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def folded(items: Column, kind: str, rest: dict[str, Column], step: Callable, finish: Callable) -> Column:
    """array<kind> of what a fold over the places of items adds, in order, in time that grows with items as they do.

    step(xs, s, i) gives the next state: `done`, what s["done"] was with more at its end, and the fields of rest. finish(xs, s)
    gives an array of what the end adds. Arrays are copied when they grow, so every GROUP places done is put aside and begins empty.
    """
    none = F.array().cast(f"array<{kind}>")
    fields = lambda s: [s[c].alias(c) for c in rest]

    def whole(xs: Column) -> Column:
        n = F.size(xs)

        def group(s: Column, g: Column) -> Column:
            places = F.filter(F.transform(F.sequence(F.lit(0), F.lit(GROUP - 1)), lambda j: g * GROUP + j), lambda i: i < n)
            inner = F.aggregate(places, F.struct(none.alias("done"), *fields(s)), lambda a, i: step(xs, a, i))
            return let(inner, lambda a: F.struct(F.array_append(s["groups"], a["done"]).alias("groups"), *fields(a)))

        start = F.struct(F.array().cast(f"array<array<{kind}>>").alias("groups"), *(v.alias(c) for c, v in rest.items()))
        groups = F.sequence(F.lit(0), F.greatest(F.ceil(n / GROUP).cast("int") - 1, F.lit(0)))
        return let(F.aggregate(groups, start, group), lambda s: F.concat(F.flatten(s["groups"]), finish(xs, s)))

    return let(items, whole)


def _cut(items: Column, size: int, carried: Callable[[Column], Column], separator: str, alone: Callable[[Column], Column] | None = None, parts: Callable[[Column], Column] | None = None) -> Column:
    """Packs neighbouring items up to `size` characters. A chunk is a run of places, joined when it is closed: the state holds only
    where it begins and how long it is. The next chunk begins with the last item of the one before if carried() says so. Items
    that are alone() close a chunk and add their own parts().
    """
    chunk = lambda xs, a, z: F.array_join(F.slice(xs, a + 1, z - a), separator)

    def step(xs: Column, s: Column, i: Column) -> Column:
        x, last = F.get(xs, i), F.get(xs, i - 1)
        is_open = s["start"] < i
        full = is_open & (s["n"] + F.length(x) > size)
        carry = full & carried(last)
        closed = F.array_append(s["done"], chunk(xs, s["start"], i))
        done = F.when(full, closed).otherwise(s["done"])
        start = F.when(carry, i - 1).when(full, i).otherwise(s["start"])
        n = F.when(carry, F.length(last) + F.length(x)).when(full, F.length(x)).otherwise(s["n"] + F.length(x))
        if alone is not None:
            done = F.when(alone(x), F.concat(F.when(is_open, closed).otherwise(s["done"]), parts(x))).otherwise(done)
            start, n = F.when(alone(x), i + 1).otherwise(start), F.when(alone(x), 0).otherwise(n)
        return F.struct(done.alias("done"), start.alias("start"), n.alias("n"))

    def finish(xs: Column, s: Column) -> Column:
        return F.when(s["start"] < F.size(xs), F.array(chunk(xs, s["start"], F.size(xs)))).otherwise(F.array().cast("array<string>"))

    return folded(items, "string", {"start": F.lit(0), "n": F.lit(0)}, step, finish)


def pack(text: Column, size: int, overlap: int = OVERLAP, longer_than: int = 80, separator: str = "\n\n") -> Column:
    """Packs paragraphs up to `size` characters; a short last paragraph is carried over into the next chunk."""
    chunks = _cut(paragraphs(text, separator), size, lambda last: F.length(last) <= overlap * 3, separator)
    return F.filter(chunks, lambda c: F.length(c) > longer_than)


def split_flat(text: Column, size: int = 512, overlap: int = 50, separator: str = "\n\n") -> Column:
    """Flat chunks: as pack over paragraphs of more than 50 characters, but a paragraph above the size is cut
    at sentences, each piece beginning with the last sentence of the piece before."""
    limit = size * 3
    paras = F.filter(paragraphs(text, separator), lambda p: F.length(p) > 50)
    pieces = lambda p: _cut(sentences(p), limit, lambda _: F.lit(True), " ")
    chunks = _cut(paras, limit, lambda last: F.length(last) <= overlap * 3, "\n\n", lambda p: F.length(p) > limit, pieces)
    return F.filter(chunks, lambda c: F.length(c) > 150)


def flat_chunks(papers: DataFrame, text: Column, separator: str = "\n\n") -> DataFrame:
    """One row per flat chunk: paper_id, chunk_index, total_chunks, char_count, text and the paper's other columns."""
    d = papers.withColumn("__c", split_flat(text, separator=separator))
    d = d.select("*", F.size("__c").alias("total_chunks"), F.posexplode_outer("__c").alias("chunk_index", "chunk_text")).drop("__c")
    d = d.where("chunk_text is not null")  # not a plain posexplode(), see hierarchical_chunks()
    return d.withColumn("char_count", F.length("chunk_text"))


def sections(text: Column) -> Column:
    """array<struct(heading, text)> of raw lines; text before the first heading is HEADER."""
    kind = "struct<heading:string,text:string>"

    def closed(xs: Column, s: Column, end: Column) -> Column:
        body = strip(F.array_join(F.slice(xs, s["start"] + 1, end - s["start"]), "\n"))
        return let(body, lambda b: F.when(b != "", F.array(F.struct(s["heading"].alias("heading"), b.alias("text")))).otherwise(F.array().cast(f"array<{kind}>")))

    def step(xs: Column, s: Column, i: Column) -> Column:
        x = strip(F.get(xs, i))
        head = F.rlike(x, F.lit(HEADING)) & (F.length(x) < 80)
        return F.struct(
            F.when(head, F.concat(s["done"], closed(xs, s, i))).otherwise(s["done"]).alias("done"),
            F.when(head, i + 1).otherwise(s["start"]).alias("start"),
            F.when(head, x).otherwise(s["heading"]).alias("heading"),
        )

    return folded(F.split(text, "\n"), kind, {"start": F.lit(0), "heading": F.lit("HEADER")}, step, lambda xs, s: closed(xs, s, F.size(xs)))


def good_section(heading: Column, text: Column, fallback: bool = False) -> Column:
    """Whether a section is worth chunking."""
    skip = F.rlike(F.lower(F.coalesce(heading, F.lit(""))), F.lit(SKIP_FALLBACK if fallback else SKIP_STRUCTURED))
    return ~skip & (F.length(text) >= (150 if fallback else 100))


def section_label(heading: Column, number: Column, fallback: bool = False) -> Column:
    if fallback:
        bare = F.upper(strip(F.regexp_replace(F.coalesce(heading, F.lit("")), r"^\d+\.?\d*\.?\s+", "")))
        return F.when(bare == "", "BODY").otherwise(bare)
    return F.when(F.coalesce(heading, F.lit("")) != "", F.upper(heading)).otherwise(F.concat(F.lit("SECTION_"), F.coalesce(number.cast("string"), F.lit(""))))


def hierarchical_chunks(papers: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Abstract, parent and child chunks of (paper_id, abstract, sections array<struct(heading, section_num, text)>).

    Counters of parents and of children run over the whole paper; they are array positions, so no window is needed.
    """
    pid = paper_id(F.col("paper_id"))
    kept = F.filter(
        F.transform("sections", lambda s: F.struct(s["heading"].alias("heading"), s["section_num"].alias("section_num"), clean_section(s["text"]).alias("text"))),
        lambda s: good_section(s["heading"], s["text"]),
    )
    parents = F.flatten(
        F.transform(kept, lambda s: F.transform(pack(s["text"], PARENT, separator=separator), lambda p: F.struct(section_label(s["heading"], s["section_num"]).alias("section"), p.alias("text"))))
    )
    d = papers.withColumn("__p", parents).withColumn(
        "__c",
        F.flatten(F.transform("__p", lambda p, i: F.transform(pack(p["text"], CHILD, separator=separator), lambda c: F.struct(i.alias("parent"), p["section"].alias("section"), c.alias("text"))))),
    )
    none = F.lit(None).cast("string")

    def row(kind: str, cid: Column, section: Column, text: Column, parent: Column) -> Column:
        return F.struct(cid.alias("chunk_id"), F.lit(kind).alias("chunk_type"), section.alias("section"), text.alias("text"), parent.alias("parent_chunk_id"))

    has_abstract = strip(F.coalesce("abstract", F.lit(""))) != ""
    abstract = F.filter(F.array(row("abstract", abstract_id(pid), F.lit("ABSTRACT"), F.col("abstract"), none)), lambda _: has_abstract)
    up = lambda i: parent_id(pid, i)
    every = F.concat(
        abstract,
        F.transform("__p", lambda x, i: row("parent", up(i), x["section"], x["text"], none)),
        F.transform("__c", lambda x, i: row("child", child_id(up(x["parent"]), i), x["section"], x["text"], up(x["parent"]))),
    )
    # One pass over the papers: all chunks of a paper come out of one array. A plain explode() would first filter papers by the array's
    # size, for which Spark makes all chunks once more.
    d = d.withColumn("__x", every).select(pid.alias("paper_id"), F.explode_outer("__x").alias("x")).where("x is not null")
    return d.select("paper_id", "x.*").withColumn("char_count", F.length("text"))
