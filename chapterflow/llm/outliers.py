"""Quality rules: robust multivariate outliers, in DataFrame functions only.

Every document has a vector of transformed statistics. For each language and
source, for each language, and for all documents, the mean and covariance of
the minimum-covariance-determinant subset are estimated: from medians and
quartiles on, each concentration step takes the ``SUBSET`` share of a group
nearest to its estimate and estimates anew. A step is one aggregation: the
moments are summed for each (group, distance class), and the classes that make
up the subset are added up, so no group meets in one task. A document is
rejected when its squared Mahalanobis distance to its finest group with enough
rows is over the cutoff, or by the fixed base rules.

Defined cases: null and empty texts have no word and fail the base rule; null
languages and sources are groups of their own; statistics without spread get a
least variance; with fewer than ``MIN_ROWS`` usable documents at all nobody is
rejected by distance; repeated rows each count and get the same verdict; an
empty table gives no row; the original columns are kept apart, so their names
cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chapterflow.llm.common import Scratch

SPACE = r"[\x20\x09-\x0D]+"
#: Share of a group in its subset, concentration steps, least rows of a group.
SUBSET, STEPS, MIN_ROWS = 0.75, 5, 100
#: Distance classes for a doubling of the squared distance.
CLASSES = 16
#: Chance of a document of a normal group to be rejected by distance.
CHANCE = 1e-9
#: Least standard deviations of the transformed statistics.
FLOORS = {"x_words": 0.4, "x_length": 0.08, "x_symbols": 0.25, "x_lines": 0.7, "x_repeats": 0.7, "x_upper": 0.25}
NAMES = list(FLOORS)
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _count(text: Column, other_than: str) -> Column:
    """Characters left when those of a class are taken out."""
    return F.length(F.regexp_replace(text, f"[{other_than}]+", "")).cast("bigint")


def repeated_words(hashes: str, windows: str, width: int = 8) -> Column:
    """Words in windows found twice or more in the text, from the windows' hashes.

    Only texts in which two windows are equal are sorted: equal neighbours in
    (hash, position) order are the repeated windows, and each adds the words
    up to the next repeated one.
    """
    return F.expr(
        f"""CASE WHEN size(array_distinct({windows})) = size({windows}) THEN 0L ELSE
        aggregate(
          array(array_sort(transform({windows}, (h, i) -> struct(h AS h, i AS i)))),
          0L, (z, s) -> aggregate(
            array(sort_array(transform(
              filter(s, (x, k) -> (k > 0 AND get(s, k - 1).h = x.h) OR (k < size(s) - 1 AND get(s, k + 1).h = x.h)), x -> x.i))),
            0L, (y, p) -> aggregate(
              sequence(0, size(p) - 1), 0L,
              (n, k) -> n + CAST(least({width}, coalesce(get(p, k + 1) - get(p, k), {width})) AS BIGINT)))) END"""
    )


def statistics(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None, full: bool = False) -> DataFrame:
    """(row, group columns, counts, base_failed, x_*): the columns in ``keep`` (default: all) go into the struct ``row``.

    ``full`` adds n_marks and n_distinct, the number of different words.
    """
    columns = docs.columns if keep is None else keep
    text = F.coalesce(F.col(text_col), F.lit(""))
    more = [_count(text, "^!?.,;:").alias("n_marks")] if full else []
    cut = docs.select(
        F.struct(*[F.col(c) for c in columns]).alias("row"),
        F.col(lang_col).alias("g_lang"),
        F.col(source_col).alias("g_source"),
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        _count(text, "^#*$%&|<>").alias("n_symbols"),
        _count(text, r"^\p{Lu}").alias("n_upper"),
        *more,
    )
    hashed = cut.withColumns(
        {
            "n_words": F.size("words").cast("bigint"),
            "word_chars": F.length(F.concat_ws("", "words")).cast("bigint"),
            "n_lines": F.size("lines").cast("bigint"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
            "hashes": F.transform("words", lambda w: F.xxhash64(w)),
        }
        | ({"n_distinct": F.size(F.array_distinct("words")).cast("bigint")} if full else {})
    ).drop("words", "lines")
    windows = hashed.withColumn("windows", F.expr("CASE WHEN size(hashes) < 8 THEN array() ELSE transform(sequence(1, size(hashes) - 7), i -> xxhash64(slice(hashes, i, 8))) END"))
    counted = windows.withColumn("n_repeat_words", repeated_words("hashes", "windows")).drop("hashes", "windows")
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    share = {"x_symbols": F.col("n_symbols") / chars, "x_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "x_repeats": F.col("n_repeat_words") / words, "x_upper": F.col("n_upper") / chars}
    return counted.withColumns(
        {"base_failed": F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"), "x_words": F.log1p("n_words"), "x_length": F.log(chars / words)}
        | {k: F.log1p(100 * v) for k, v in share.items()}
    )


def _grouped(stats: DataFrame) -> DataFrame:
    """Usable documents, once for each group that they belong to."""
    lang, source = F.coalesce("g_lang", F.lit("\0")), F.coalesce("g_source", F.lit("\0"))
    keys = F.array(F.concat(F.lit("s"), lang, F.lit("\1"), source), F.concat(F.lit("l"), lang), F.lit("a"))
    return stats.where(~F.col("base_failed")).select(F.explode(keys).alias("grp"), *NAMES)


def _with_distance(df: DataFrame) -> DataFrame:
    """``distance``: squared Mahalanobis distance by forward substitution in the struct ``p`` of mean and Cholesky factor."""
    solved = [f"z{i}" for i in range(len(NAMES))]
    for i, x in enumerate(NAMES):  # a column each: the next ones use it again and again
        rest = F.col(x) - F.col(f"p.m{i}")
        for j in range(i):
            rest = rest - F.col(f"p.c{i}_{j}") * F.col(solved[j])
        df = df.withColumn(solved[i], rest / F.col(f"p.c{i}_{i}"))
    return df.withColumn("distance", sum((F.col(z) * F.col(z) for z in solved[1:]), F.col("z0") * F.col("z0"))).drop(*solved)


def _with_factor(moments: DataFrame, scale: float) -> DataFrame:
    """(grp, n, p): mean and Cholesky factor from the sums of a group's subset; the least variances are added."""
    mean = {f"m{i}": F.col(f"s{i}") / F.col("k") for i in range(len(NAMES))}
    out = moments.withColumns(mean)
    for i, j in PAIRS:  # row by row: an entry needs those to its left and those of the row of its column
        v = scale * (F.col(f"s{i}_{j}") / F.col("k") - F.col(f"m{i}") * F.col(f"m{j}"))
        if i == j:
            v = F.greatest(v, F.lit(0.0)) + FLOORS[NAMES[i]] ** 2
        for k in range(j):
            v = v - F.col(f"c{i}_{k}") * F.col(f"c{j}_{k}")
        entry = F.sqrt(F.greatest(v, F.lit(FLOORS[NAMES[i]] ** 2 / 4))) if i == j else v / F.col(f"c{j}_{j}")
        out = out.withColumn(f"c{i}_{j}", entry)
    names = [*mean, *(f"c{i}_{j}" for i, j in PAIRS)]
    return out.select("grp", "n", F.struct(*names).alias("p"))


def chi2_cdf(x: float, df: float) -> float:
    a, y = df / 2, x / 2
    term = total = 1 / a
    for n in range(1, 500):
        term *= y / (a + n)
        total += term
    return total * math.exp(a * math.log(y) - y - math.lgamma(a)) if y > 0 else 0.0


def chi2_quantile(share: float, df: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < share else (low, mid)
    return low


def consistency(share: float, df: int) -> float:
    """What the covariance of the nearest ``share`` of normal data is multiplied by to be that of all."""
    return share / chi2_cdf(chi2_quantile(share, df), df + 2)


#: Squared distance over which a document is rejected.
CUTOFF = chi2_quantile(1 - CHANCE, len(NAMES))


def estimates(stats: DataFrame, scratch: Scratch) -> DataFrame:
    """(grp, n, p) of every group: robust mean and Cholesky factor of the covariance."""
    rows = _grouped(stats)
    quarters = rows.groupBy("grp").agg(F.count("*").alias("n"), *[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, x in enumerate(NAMES)])
    spread = {f"c{i}_{j}": (F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[NAMES[i]])) if i == j else F.lit(0.0)) for i, j in PAIRS}
    first = quarters.select("grp", "n", F.struct(*[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(len(NAMES))], *[c.alias(k) for k, c in spread.items()]).alias("p"))
    found = scratch.store("step0", first)
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(NAMES)] + [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"s{i}_{j}") for i, j in PAIRS]
    totals = [F.sum(c).alias(c) for c in ["k", *(f"s{i}" for i in range(len(NAMES))), *(f"s{i}_{j}" for i, j in PAIRS)]]
    for step in range(STEPS):
        near = _with_distance(rows.join(found, "grp")).withColumn("class", F.floor(CLASSES * F.log2(F.greatest("distance", F.lit(1e-6)))))
        moments = near.groupBy("grp", "class").agg(F.first("n").alias("n"), F.count("*").alias("k"), *sums)
        before = F.coalesce(F.sum("k").over(Window.partitionBy("grp").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        subset = moments.withColumn("before", before).where(F.col("before") < F.ceil(SUBSET * F.col("n"))).groupBy("grp").agg(F.first("n").alias("n"), *totals)
        found = scratch.store(f"step{step + 1}", _with_factor(subset, consistency(SUBSET, len(NAMES))))
    return found


def verdicts(stats: DataFrame, found: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``stats`` with ``distance`` (null: no group is large enough) and ``kept``."""
    out = stats
    for level, key in (("s", ["g_lang", "g_source"]), ("l", ["g_lang"]), ("a", [])):
        name = F.concat_ws("\1", *[F.coalesce(c, F.lit("\0")) for c in key]) if key else F.lit("")
        params = found.where((F.col("n") >= MIN_ROWS) & F.col("grp").startswith(level)).select(F.col("grp").alias(f"grp_{level}"), F.col("p").alias(f"p_{level}"))
        out = out.withColumn(f"grp_{level}", F.concat(F.lit(level), name)).join(params, f"grp_{level}", "left").drop(f"grp_{level}")
    out = _with_distance(out.withColumn("p", F.coalesce("p_s", "p_l", "p_a"))).drop("p", "p_s", "p_l", "p_a")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))


def outliers(docs: DataFrame, scratch: Scratch, keep: list[str] | None = None, cutoff: float = CUTOFF, **columns: str) -> DataFrame:
    """Statistics, distance and verdict of every row; ``row`` holds the original columns in ``keep``."""
    stats = scratch.store("stats", statistics(docs, keep=keep, **columns))
    return verdicts(stats, estimates(stats, scratch), cutoff)
