import random

import pytest

WORDS = "der und thon ering tion stan blewh onst reou hand erat shing ndly thea inan oure".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


EXTRA = "score double, key string, tokens string, at string, kept string, h string, lang_pred string, size string, rank long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank, letterless, very long and tied texts, repeated rows, clashing extra columns."""
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "CHANGED", *words[61:]])
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t\x0b ", "en", "a", 5), (4, "123 456 !!! 7", "fr", "b", 13),
        (5, base, "en", "a", 1), (6, base.replace(" ", "  \n"), "de", None, 1), (7, base, None, "b", None), (7, base, None, "b", None),
        (8, near, "en", "a", 1), (9, base.upper(), "en", "a", 1), (10, prose(2, 30_000), "en", "big", 1), (11, "x" * 300_000, "de", "big", 1),
        (12, "one two", "en", "c", 7), (13, "one two", "en", "c", 7), (14, "É" * 150 + base[:400], "fr", "c", 1), (None, prose(3, 50), "en", "a", 1),
        (None, prose(3, 50), "en", "a", 1), (15, "a b c d e", "es", "", 9), (16, "a b c d", "es", "", 7), (17, "a\x1cb\u00a0c d\u2003e f g", "en", "c", 1),
    ]
    rows = [(*r, 0.5, "k", None, "x", "y", None, "zz", "s", 3) for r in rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def sf_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
