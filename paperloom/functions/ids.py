"""Hierarchical ids: paper, paper::abstract, paper::parent::0007, paper::parent::0007::child::0012."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def paper_id(raw: Column) -> Column:
    """The id in a URL or a plain id, without its version."""
    return F.split_part(F.substring_index(raw, "/abs/", -1), F.lit("v"), F.lit(1))


def abstract_id(paper: Column) -> Column:
    return F.concat(paper, F.lit("::abstract"))


def parent_id(paper: Column, index: Column) -> Column:
    return F.format_string("%s::parent::%04d", paper, index.cast("int"))


def child_id(parent: Column, index: Column) -> Column:
    return F.format_string("%s::child::%04d", parent, index.cast("int"))


def parse(chunk_id: Column) -> Column:
    """struct(paper_id, chunk_type, parent_index, child_index)."""
    p = F.split(chunk_id, "::")

    def number(name: str) -> Column:
        return F.try_element_at(p, (F.array_position(p, name) + 1).cast("int")).try_cast("int")

    kind = (
        F.when(F.array_contains(p, "child"), "child")
        .when(F.array_contains(p, "parent"), "parent")
        .when(F.array_contains(p, "abstract"), "abstract")
        .otherwise("unknown")
    )
    return F.struct(
        p[0].alias("paper_id"),
        kind.alias("chunk_type"),
        F.when(F.array_contains(p, "parent"), number("parent")).alias("parent_index"),
        F.when(F.array_contains(p, "child"), number("child")).alias("child_index"),
    )


def parent_of(chunk_id: Column) -> Column:
    """A child's parent id; null for other ids."""
    return F.when(chunk_id.contains("::child::"), F.substring_index(chunk_id, "::child::", 1))
