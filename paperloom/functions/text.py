"""Column functions on text: cleaning, tokenising, normalising. Unicode-aware, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in titles and in abstracts.
TITLE_STOP = ("a", "an", "the", "of", "in", "on", "for", "to", "and", "or", "with", "via", "using", "towards", "toward", "from", "is", "are")
ABSTRACT_STOP = ("a", "an", "the", "of", "in", "on", "for", "to", "and", "or", "with", "we", "our", "this", "that", "is", "are", "paper", "propose")

#: Fixed value: heading lines of a paper, with optional numbering.
HEADING = (
    r"(?i)^(\d+\.?\d*\.?\s+)?(Abstract|Introduction|Related Work|Background|Preliminaries|Problem Formulation|"
    r"Method|Methods|Methodology|Approach|Model|Framework|Experiment|Experiments|Experimental Setup|Evaluation|"
    r"Results|Analysis|Discussion|Conclusion|Conclusions|Future Work|References|Appendix|Acknowledgment|Acknowledgements)(\s|$)"
)

#: Characters of an abstract that b8_b9_similarity compares, as its SQL states.
ABSTRACT_CHARS = 200


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_title(title: Column) -> Column:
    bare = F.regexp_replace(F.lower(title), r"(?U)[^\w\s]", "")
    return strip(F.regexp_replace(bare, r"(?U)\s+", " "))


def title_tokens(title: Column) -> Column:
    words = F.filter(F.split(normalize_title(title), " "), lambda w: w != "")
    return F.array_except(words, F.array(*map(F.lit, TITLE_STOP)))


def abstract_tokens(abstract: Column) -> Column:
    words = F.regexp_extract_all(F.lower(abstract), F.lit(r"(?U)\w+"), F.lit(0))
    return F.array_except(words, F.array(*map(F.lit, ABSTRACT_STOP)))


def tokenize(text: Column, keep_single: bool = False) -> Column:
    """Lower-case ASCII words; one-character tokens but `a` go unless kept."""
    parts = F.split(F.replace(F.lower(text), F.lit("-"), F.lit(" ")), "[^a-z0-9]+")
    return F.filter(parts, lambda w: w != "" if keep_single else (F.length(w) > 1) | (w == "a"))


def alpha_share(text: Column) -> Column:
    """Letters among all characters; null for the empty text."""
    return F.length(F.regexp_replace(text, r"\P{L}", "")) / F.nullif(F.length(text), F.lit(0))


# The patterns of the three cleaners below.
def clean_flat(text: Column) -> Column:
    """For flat text: blank lines, line-break hyphens, blanks, number lines, symbol lines, reference list."""
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"(?mU)^\s*\d+\s*$", "")
    text = F.regexp_replace(text, r"(?mU)^[^a-zA-Z0-9\s]{3,}$", "")
    return strip(F.regexp_replace(text, r"(?s)\n(References|Bibliography)\n.*$", ""))


def clean_section(text: Column) -> Column:
    """For sections of marked-up documents."""
    text = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]+", " ")
    return strip(F.regexp_replace(text, r"<[^>]+>", ""))


def clean_fallback(text: Column, least: float = 0.40) -> Column:
    """For raw page text: also drops lines with too few letters; blank lines stay, emptied."""
    text = F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"(?mU)^\s*\d+\s*$", "")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    lines = F.transform(F.split(text, "\n"), lambda x: F.when(strip(x) == "", F.lit("")).otherwise(x))
    good = F.filter(lines, lambda x: (x == "") | (alpha_share(strip(x)) > least))
    return strip(F.array_join(good, "\n"))


def sentences(text: Column) -> Column:
    """Split after the marks that end a sentence."""
    return F.split(strip(text), r"(?U)(?<=[.!?])\s+")


def safe_year(value: Column) -> Column:
    """The first four characters as a number; 0 if they are none."""
    return F.coalesce(F.substring(value.cast("string"), 1, 4).try_cast("int"), F.lit(0))


def safe_count(value: Column) -> Column:
    """A count in full; 0 if it is none."""
    return F.coalesce(value.cast("string").try_cast("double").try_cast("long"), F.lit(0))
