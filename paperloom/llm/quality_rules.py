"""Quality rules and robust multivariate outliers, in DataFrame functions alone.

Counts of words, symbols, repeated lines and repeated 3-word windows come from higher-order functions on
the row. Each document's transformed statistic vector is then judged within its language and source: a
minimum-covariance-determinant fit gives centre and scatter, and the squared Mahalanobis distance is held
against a fixed quantile. There is a fit for every language and source, one for every language and one of all rows.
A group's own fit counts with weight n / (n + SHRINK), n being its judged rows, and that of its parent, shrunk in
the same way, with the rest, so no size of a group changes the rule. The scatter of all rows is shrunk towards
fixed wide deviations. The fit begins at several places in each group (medians and quartile ranges, the same with
correlations of squashed scores, small random subsets), takes two concentration steps on the most central share of the
rows from each, goes on from the one with the least determinant, and ends when no step lowers it. All
passes are grouped sums and grouped histograms, which are combined before the shuffle, so a source with a
third of all rows is no larger for one task than any other.

Defined results: null text has no words (base_failed is true below 50 words); null lang and null source are
groups of their own; a group without judged rows takes its parent's fit, and without judged rows at all distances
are null; repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rounds, table, without, words_of, written

#: Share of a group's rows that the covariance fit rests on.
CORE = 0.75
#: Starts of the fit: 0 and 1 from medians and quartile ranges, the others from random subsets of about so many rows.
STARTS, SUBSET = 5, 12
#: Concentration steps from each start, and the fall of the log determinant below which a step counts as none.
STEPS, SETTLED = 2, 1e-6
#: Judged rows at which a group's own fit and its parent's count the same.
SHRINK = 100
#: Parts that the rows of a group are dealt to where they meet its fits, as a language may hold all rows.
PARTS = 16
#: Squared distance beyond which a vector is an outlier: about the 1 - 1e-9 quantile of chi-square with 4 degrees of freedom.
CUTOFF = 47.0
#: Standard deviation added to each transformed statistic: most texts have no repeated line or window at
#: all, and without it a statistic that is constant in the core would make every other value an outlier.
#: The last one leaves room below the base rule: repeated windows alone reject from about 0.41 above the centre (47 ** 0.5 * 0.06), and 0.5 is the base rule's bound.
FLOORS = (0.05, 0.03, 0.02, 0.06)
#: Standard deviations that the scatter of all rows is shrunk towards.
PRIOR = (0.15, 0.09, 0.06, 0.18)
#: Histogram steps for the logarithm of a squared distance and for a statistic.
FINE = 64

VECTOR = ("x1", "x2", "x3", "x4")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Each window becomes one long, the high bits of its hash above its position; after a sort, equal windows
    are neighbours (and are compared word by word). The covered words follow from the gaps between
    the repeated positions.
    """
    n = F.size(words)

    def covered(bits: Column) -> Column:
        right, left = (lambda x: F.call_function("shiftright", x, bits)), (lambda x: F.call_function("shiftleft", x, bits))
        mask = left(F.lit(1).cast("long")) - 1

        def repeated(keys: Column) -> Column:
            place = lambda k: k.bitwiseAND(mask).cast("int")
            again = F.filter(F.sequence(F.lit(1), n - 3), lambda p: right(keys[p]) == right(keys[p - 1]))
            pairs = F.transform(again, lambda p: F.array(place(keys[p - 1]), place(keys[p])))
            equal = F.filter(pairs, lambda q: (words[q[0]] == words[q[1]]) & (words[q[0] + 1] == words[q[1] + 1]) & (words[q[0] + 2] == words[q[1] + 2]))
            gaps = lambda s: F.transform(s, lambda x, p: F.when(p == 0, 3).otherwise(F.least(F.lit(3), x - s[F.greatest(p - 1, F.lit(0))])))
            return _let(
                F.sort_array(F.array_distinct(F.flatten(equal))),
                lambda s: F.aggregate(gaps(s), F.lit(0).cast("long"), lambda a, x: a + x),
            )

        hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: left(right(F.xxhash64(words[i], words[i + 1], words[i + 2]))) + i)
        return _let(F.sort_array(hashes), repeated)

    return F.when(n >= 4, _let(F.length(F.bin(n.cast("long"))), covered)).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(without(x, "\t\x0b\f\r", " ")) != "")
    d = docs.select(
        "doc_id",
        "lang",
        "source",
        (F.length(text) - F.length(without(text, "#*$%&|<>"))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _let(
            words_of(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("c"), _repeat_words(w).alias("r")
            ),
        ).alias("w"),
    )
    d = d.select(
        "doc_id", "lang", "source", F.col("w.n").alias("n_words"), F.col("w.c").alias("word_chars"), "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words")
    )
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vectors(stats: DataFrame) -> DataFrame:
    """Adds the transformed vector: log word length, root of the symbol rate, rates of repeated lines and windows."""
    n = F.greatest("n_words", F.lit(1))
    return stats.withColumns(
        {
            "x1": F.log((F.col("word_chars") + 1) / n),
            "x2": F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
            "x3": F.col("n_dup_lines") / n,
            "x4": F.col("n_repeat_words") / n,
        }
    )


#: A fit's key: level 0 is a language and source, 1 a language, 2 all rows.
GROUP = ("k_level", "k_lang", "k_source")


def _join_groups(rows: DataFrame, groups: DataFrame, keys: tuple[str, ...] = GROUP, how: str = "left") -> DataFrame:
    """rows with the columns of their group's rows; keys may be null."""
    g = groups.withColumnsRenamed({k: f"g_{k}" for k in keys})
    on = [rows[k].eqNullSafe(g[f"g_{k}"]) for k in keys]
    return rows.join(g, on, how).drop(*(f"g_{k}" for k in keys))


def _key(level: int) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(level).alias("k_level"), (F.col("lang") if level < 2 else none).alias("k_lang"), (F.col("source") if level < 1 else none).alias("k_source"))


def _meet(rows: DataFrame, groups: DataFrame, keys: tuple[str, ...] = GROUP) -> DataFrame:
    """rows with their groups' rows, each part of a group's rows with a copy; rows hold `part`."""
    return _join_groups(rows, groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), (*keys, "part"), "inner")


#: A fit under way: groups may have several, one per start.
TRIAL = (*GROUP, "start")


def _quantile(rows: DataFrame, column: str, shares: dict[str, float], keys: tuple[str, ...] = GROUP) -> DataFrame:
    """Per group, for each share, the smallest histogram step of `column` at or below which that share lies."""
    bins = rows.groupBy(*keys, F.floor(F.col(column) * FINE).alias("b")).agg(F.count("*").alias("c"))
    arrays = bins.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("b", "c"))).alias("h"), F.sum("c").alias("n"))

    def at(share: float) -> Column:
        def step(s, x):
            total = s["t"] + x["c"]
            return F.struct(total.alias("t"), F.when((s["t"] < F.col("n") * share) & (total >= F.col("n") * share), x["b"]).otherwise(s["b"]).alias("b"))

        start = F.struct(F.lit(0).cast("long").alias("t"), F.lit(None).cast("long").alias("b"))
        return (F.aggregate("h", start, step)["b"] + 1) / FINE

    return arrays.select(*keys, *(at(share).alias(name) for name, share in shares.items()))


PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]
FIT = (*(f"m{i}" for i in range(4)), *(f"l{i}{j}" for i, j in PAIRS), "log_det")


def _moments(rows: DataFrame) -> DataFrame:
    """Per group and start: centre m_i and the lower Cholesky factor l_ij of the floored covariance."""
    sums = [F.avg(v).alias(f"m{i}") for i, v in enumerate(VECTOR)]
    sums += [F.covar_pop(VECTOR[i], VECTOR[j]).alias(f"c{i}{j}") for i, j in PAIRS]
    return _factor(rows.groupBy(*TRIAL).agg(*sums))


def _factor(out: DataFrame, floors: tuple[float, ...] = FLOORS, keys: tuple[str, ...] = TRIAL) -> DataFrame:
    for i, j in PAIRS:
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        cell = F.sqrt(F.greatest(rest, F.lit(0.0)) + floors[i] ** 2) if i == j else rest / F.col(f"l{j}{j}")
        out = out.withColumn(f"l{i}{j}", cell)
    log_det = F.log("l00") + F.log("l11") + F.log("l22") + F.log("l33")
    return out.withColumn("log_det", 2 * log_det).select(*keys, *FIT)


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    for i, v in enumerate(VECTOR):
        rest = F.col(v) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    total = z[0] * z[0]
    for x in z[1:]:
        total = total + x * x
    return total


def _starts(rows: DataFrame) -> DataFrame:
    """The first fits of every group, one per start."""
    mid = rows.groupBy(*GROUP).agg(F.count("*").alias("group_n"))
    for i, v in enumerate(VECTOR):
        mid = _join_groups(mid, _quantile(rows, v, {f"lo{i}": 0.25, f"m{i}": 0.5, f"hi{i}": 0.75}))
    mid = written(mid.withColumns({f"s{i}": F.greatest((F.col(f"hi{i}") - F.col(f"lo{i}")) / 1.349, F.lit(FLOORS[i])) for i in range(4)}), "mcd")
    squashed = _meet(rows, mid).select(*GROUP, *(F.tanh((F.col(v) - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"t{i}") for i, v in enumerate(VECTOR)))
    alike = squashed.groupBy(*GROUP).agg(*(F.covar_pop(f"t{i}", f"t{j}").alias(f"r{i}{j}") for i, j in PAIRS))
    both = _join_groups(mid, alike).withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))

    def cell(i: int, j: int) -> Column:
        if i == j:
            return F.col(f"s{i}") * F.col(f"s{i}")
        r = F.coalesce(F.col(f"r{i}{j}") / F.nullif(F.sqrt(F.col(f"r{i}{i}") * F.col(f"r{j}{j}")), F.lit(0.0)), F.lit(0.0))
        return F.when(F.col("start") == 1, r * F.col(f"s{i}") * F.col(f"s{j}")).otherwise(0.0)

    fits = _factor(both.withColumns({f"c{i}{j}": cell(i, j) for i, j in PAIRS}))
    turns = F.explode(F.array(*(F.lit(k) for k in range(2, STARTS))))
    luck = F.pmod(F.xxhash64(*VECTOR, "start"), F.lit(1 << 30)) / (1 << 30)
    few = _meet(rows, mid.select(*GROUP, "group_n")).withColumn("start", turns).where(luck < SUBSET / F.col("group_n"))
    return fits.unionByName(_moments(few))


def _concentrated(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """One concentration step: the moments of the share of rows that each fit finds most central."""
    near = _meet(rows, fits.select(*TRIAL, *FIT)).withColumn("ld", F.log(_distance() + 1e-9)).select(*TRIAL, "part", *VECTOR, "ld")
    edge = _quantile(near, "ld", {"edge": CORE}, TRIAL)
    return _moments(_meet(near, edge, TRIAL).where("ld <= edge"))


def mcd_fit(rows: DataFrame) -> DataFrame:
    """Per key of GROUP: centre, factor and the scale that makes the median distance that of a normal cloud."""
    steps, kept = Rounds(), Rounds()
    rows = rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int"))
    fits = steps.written(_starts(rows), "mcd")
    for _ in range(STEPS):
        fits = steps.written(_concentrated(rows, fits), "mcd")
    best = fits.groupBy(*GROUP).agg(F.min_by(F.struct("start", *FIT), F.struct("log_det", "start")).alias("x"))
    fit, moving = kept.written(best.select(*GROUP, "x.*", F.lit(True).alias("moving")), "mcd"), 1
    while moving:  # a group's determinant falls in each round that it takes part in, so this ends
        new = _concentrated(rows, fit.where("moving")).withColumnsRenamed({c: f"new_{c}" for c in FIT}).drop("start")
        both = _join_groups(fit, new)
        lower = F.coalesce(F.col("new_log_det") < F.col("log_det") - SETTLED, F.lit(False))
        fit = kept.written(both.select(*GROUP, "start", *(F.when(lower, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in FIT), lower.alias("moving")), "mcd")
        moving = fit.where("moving").count()
    fit = fit.drop("start", "moving")
    near = _meet(rows, fit).withColumn("ld", F.log(_distance() + 1e-9))
    # 3.357 is the median of chi-square with 4 degrees of freedom; the core's covariance is never scaled down
    scale = _quantile(near, "ld", {"mid": 0.5}).withColumn("scale", F.greatest(F.exp("mid") / 3.357, F.lit(1.0)))
    size = rows.groupBy(*GROUP).agg(F.count("*").alias("group_n"))
    return written(_join_groups(_join_groups(fit, scale.drop("mid")), size), "mcd")


def _scatter(fit: DataFrame) -> DataFrame:
    """A fit's scaled covariance c_ij in place of its factor, and its own weight."""
    cells = {f"c{i}{j}": F.col("scale") * sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j + 1)), F.lit(0.0)) for i, j in PAIRS}
    return fit.withColumns({**cells, "weight": F.col("group_n") / (F.col("group_n") + SHRINK)})


CENTRE, CELLS = tuple(f"m{i}" for i in range(4)), tuple(f"c{i}{j}" for i, j in PAIRS)


def shrunk(fit: DataFrame, groups: DataFrame) -> DataFrame:
    """Per row of groups (lang, source): centre and factor of its own fit, shrunk towards its language's and that of all rows."""
    part = _scatter(fit)

    def mixed(children: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        w = F.coalesce("weight", F.lit(0.0))
        both = (w * F.coalesce(c, F.lit(0.0)) + (1 - w) * F.col(f"up_{c}") for c in (*CENTRE, *CELLS))
        return children.select(*keys, *(x.alias(c) for x, c in zip(both, (*CENTRE, *CELLS), strict=True)))

    def above(d: DataFrame) -> DataFrame:
        return d.withColumnsRenamed({c: f"up_{c}" for c in (*CENTRE, *CELLS)})

    def level(k: int, keys: tuple[str, ...]) -> DataFrame:
        return part.where(F.col("k_level") == k).select(*(F.col(f"k_{c}").alias(c) for c in keys), "weight", *CENTRE, *CELLS)

    wide = {f"up_{c}": F.col(c) for c in CENTRE} | {f"up_c{i}{j}": F.lit(PRIOR[i] ** 2 if i == j else 0.0) for i, j in PAIRS}
    top = above(mixed(level(2, ()).withColumns(wide), ()))
    langs = _join_groups(groups.select("lang").distinct(), level(1, ("lang",)), ("lang",)).crossJoin(top)  # top is one row
    langs = written(above(mixed(langs, ("lang",))), "mcd")
    own = _join_groups(_join_groups(groups.select("lang", "source"), level(0, ("lang", "source")), ("lang", "source")), langs, ("lang",))
    return _factor(mixed(own, ("lang", "source")), (0.0,) * 4, ("lang", "source"))


def judge(docs: DataFrame) -> DataFrame:
    """Statistics, squared robust distance and verdict of every document."""
    stats = written(vectors(statistics(docs)), "stats")
    rows = stats.where("not base_failed").select(*VECTOR, F.explode(F.array(*(_key(k) for k in range(3)))).alias("k")).select(*VECTOR, "k.*")
    fit = mcd_fit(written(rows, "rows"))
    fits = written(shrunk(fit, stats.select("lang", "source").distinct()), "mcd")
    out = _join_groups(stats, fits, ("lang", "source")).withColumn("distance", _distance())
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("distance") > CUTOFF, F.lit(False)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
