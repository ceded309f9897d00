"""URL filter: allow and block rules, and gradient-boosted trees on lexical features for the rest.

DataFrame functions alone, for rules, features, training and scoring. Labels come from the rules: a URL that a
rule fits is labelled with its verdict. Trees are grown level by level from grouped gradient histograms, and
scoring is one nested CASE expression over binned features, so a full table is judged in a single map.

Training rests on at most TRAIN_ROWS labelled URLs (those with the smallest hash). Suffix statistics are the
smoothed shares of allowed URLs in that sample per last host label and per folder that the path ends in; a training row
has those of the other half of the sample, so that it never sees its own label.

Defined results: a null url, or one without "://", has empty host and path and is judged by the trees; without
labels of both kinds the trees answer with the only kind there is (allow when there is none); repeated rows are
judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Fixed values of the contract: verdict, host, path prefix.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, RIDGE, BINS = 20, 3, 0.3, 1.0, 16
LEXICAL = ("f_length", "f_depth", "f_digits", "f_entropy", "f_params")
#: Suffix statistics and the column whose values they are counted for.
SUFFIXES = {"f_suffix": "suffix", "f_folder": "folder"}
FEATURES = (*LEXICAL, *SUFFIXES)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_verdict(rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits columns host and path; null if none does."""
    cases = []
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        cases.append(F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*cases)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.length(text)
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    share = F.transform(chars, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def last_folder(path: Column) -> Column:
    """The part before the last one: `de` of /de/6609.html and of /x/de/6609/; empty if there is none."""
    two = F.substring_index(F.rtrim(path, F.lit("/")), "/", -2)
    return F.when(F.instr(two, "/") > 0, F.substring_index(two, "/", 1)).otherwise("")


def features(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, suffix, the folder's hash, rule, label and the raw lexical features."""
    host, path = parts(F.col("url"))
    d = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    u = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    return d.withColumns(
        {
            "suffix": F.substring_index("host", ".", -1),
            "folder": F.xxhash64(last_folder(F.col("path"))),
            "hit": rule_verdict(),
            "f_length": F.length(u).cast("double"),
            "f_depth": F.length(F.regexp_replace("path", "[^/]", "")).cast("double"),
            "f_digits": F.length(F.regexp_replace(u, "[^0-9]", "")) / n,
            "f_entropy": F.coalesce(entropy(u), F.lit(0.0)),
            "f_params": F.length(F.regexp_replace(u, "[^?&=]", "")).cast("double"),
        }
    ).select(
        "page_id",
        "url",
        "host",
        "path",
        "suffix",
        "folder",
        F.col("hit.rule").alias("rule"),
        F.col("hit.verdict").alias("label"),
        *LEXICAL,
    )


def _binned(feature: str, cuts: list[float]) -> Column:
    return reduce(lambda a, c: a + (F.col(feature) > c).cast("int"), cuts, F.lit(0))


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def _leaf(tree, node: int = 1) -> Column:
    """The tree as nested CASE expressions; tree: node -> (feature, bin) or a value."""
    x = tree[node]
    if not isinstance(x, tuple):
        return F.lit(float(x))
    return F.when(F.col(f"b_{x[0]}") <= x[1], _leaf(tree, 2 * node)).otherwise(_leaf(tree, 2 * node + 1))


def _node(tree, node: int = 1) -> Column:
    """The open node that a row falls into."""
    x = tree.get(node)
    if not isinstance(x, tuple):
        return F.lit(node)
    return F.when(F.col(f"b_{x[0]}") <= x[1], _node(tree, 2 * node)).otherwise(_node(tree, 2 * node + 1))


def grow(sample: DataFrame, prior: float) -> list[dict]:
    """Boosted trees from (b_* bins, y, c count). Only histograms (nodes x features x bins) reach the driver."""
    trees: list[dict] = []
    for _ in range(TREES):
        score = F.lit(prior) + _sum([_leaf(t) for t in trees])
        p = 1 / (1 + F.exp(-score))
        now = sample.withColumns({"g": (F.col("y") - p) * F.col("c"), "h": p * (1 - p) * F.col("c")})
        tree: dict = {}
        for depth in range(DEPTH + 1):
            long = now.select(
                _node(tree).alias("node"),
                "g",
                "h",
                F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in FEATURES))).alias("x"),
            )
            cells: dict = {}
            for r in long.groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                cells.setdefault(r["node"], {}).setdefault(r["f"], []).append((r["b"], r["g"], r["h"]))
            for node in range(2**depth, 2 ** (depth + 1)):
                if node in cells:
                    tree[node] = _split(cells[node], depth < DEPTH)
                elif depth == 0 or isinstance(tree.get(node // 2), tuple):
                    tree[node] = 0.0
            if not any(isinstance(tree.get(n), tuple) for n in range(2**depth, 2 ** (depth + 1))):
                break
        trees.append(tree)
    return trees


def _split(features_: dict, may: bool):
    """(feature, last bin on the left) of the best gain, else the leaf's value."""
    g = sum(x[1] for x in features_[FEATURES[0]])
    h = sum(x[2] for x in features_[FEATURES[0]])
    value, best = RATE * g / (h + RIDGE), None
    if may:
        for f in FEATURES:
            lg = lh = 0.0
            cells = sorted(features_[f])
            for b, x, y in cells[:-1]:
                lg, lh = lg + x, lh + y
                gain = lg**2 / (lh + RIDGE) + (g - lg) ** 2 / (h - lh + RIDGE) - g**2 / (h + RIDGE)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, b)
    return (best[1], best[2]) if best and best[0] > 1e-6 else value


def judge(pages: DataFrame, train_rows: int = TRAIN_ROWS, hold_out: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' score (share of allow). Rows of hold_out take no part in training."""
    d = features(pages)
    learn = F.col("label").isNotNull() if hold_out is None else F.col("label").isNotNull() & ~F.coalesce(hold_out, F.lit(False))
    labelled = d.where(learn).select("suffix", "folder", *LEXICAL, (F.col("label") == "allow").cast("int").alias("y"), F.xxhash64("url").alias("k"))
    sample = labelled.orderBy("k", *LEXICAL).limit(train_rows)
    sample = written(sample.withColumn("half", F.pmod(F.xxhash64("k"), F.lit(2)).cast("int")).drop("k"), "urls")
    n, allowed = sample.agg(F.count("*"), F.sum("y")).first()
    if not n or allowed in (0, n):
        score = F.lit(0.0 if n and not allowed else 1.0)
    else:
        prior_share = allowed / n
        share = (F.sum("y") + 5 * prior_share) / (F.count("*") + 5)
        plain = sample
        for name, key in SUFFIXES.items():
            others = plain.groupBy(key, (1 - F.col("half")).alias("half")).agg(share.alias(name))
            sample = sample.join(others, [key, "half"], "left").withColumn(name, F.coalesce(name, F.lit(prior_share)))
            d = d.join(plain.groupBy(key).agg(share.alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(prior_share)))
        shares = [(i + 1) / BINS for i in range(BINS - 1)]
        cut_rows = sample.agg(*(F.percentile_approx(f, shares, 1000).alias(f) for f in FEATURES)).first()
        bins = {f"b_{f}": _binned(f, sorted(set(cut_rows[f]))) for f in FEATURES}
        cells = written(sample.withColumns(bins).groupBy(*bins, "y").agg(F.count("*").alias("c")), "urls")
        prior = math.log(prior_share / (1 - prior_share))
        trees = grow(cells, prior)
        d = d.withColumns(bins)
        score = 1 / (1 + F.exp(-(F.lit(prior) + _sum([_leaf(t) for t in trees]))))
    d = d.withColumn("score", score)
    verdict = F.coalesce("label", F.when(F.col("score") >= 0.5, "allow").otherwise("block"))
    return d.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
