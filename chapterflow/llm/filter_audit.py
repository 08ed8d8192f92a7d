"""Interaction audit of removal filters over all orders in which they can run.

Every document is a mask of the filters that it fails. In an order, which is
a permutation of the filters with its lexicographic (Lehmer) rank, a mask is
removed at the step of its first failing filter. All orders that share their
first steps lie side by side in rank, so the orders in which a mask is removed
at a step, is kept after it, or fails its filter in vain are unions of rank
intervals that depend on the mask alone. The counts of the masks are added at
the interval starts, taken away behind the interval ends, and summed along the
ranks: documents are counted once, not once an order.

Texts are read once; only digests, ids and masks travel. Copies of a text fail
the same content filters, so a text's rows are counted by (digest, part,
labels) before the smallest id of the digest is looked up.

Defined cases: a null text is empty and a null part is the empty string; of
repeated label rows the greatest label counts, an unlabelled row is neither
good nor toxic; rows that repeat an id each count, and a row is no copy of one
with its own id; a null id is neither smaller nor larger than another, so its
row is no copy; an empty table gives no row; other columns are ignored. A very
long text is held by one task, once as text and once as words. Ties do not
occur: ranks are distinct.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD_BREAK = "[\\x20\\x09-\\x0D]+"
KINDS = ("kept", "removed", "redundant", "unique_fails")
INTERVALS = "mask int, step int, at int, kept int, removed int, redundant int, unique_fails int"


def lehmer_rank(prefix: tuple[int, ...], n: int) -> int:
    """Least lexicographic rank of the permutations of n that begin with ``prefix``."""
    rest, rank = list(range(n)), 0
    for k, x in enumerate(prefix):
        rank += rest.index(x) * factorial(n - 1 - k)
        rest.remove(x)
    return rank


def differences(n: int) -> list[tuple[int, ...]]:
    """(mask, step, rank, change of each of KINDS): what one document of a mask adds to the difference arrays.

    Bit f of a mask: filter f fails. Changes at rank n! fall away.
    """
    changes: dict[tuple[int, int, int], list[int]] = {}
    for step in range(1, n + 1):
        for prefix in permutations(range(n), step):
            lo, width = lehmer_rank(prefix, n), factorial(n - step)
            before, own = sum(1 << f for f in prefix[:-1]), 1 << prefix[-1]
            for mask in range(1 << n):
                first = not mask & before
                found = (first and not mask & own, first and bool(mask & own), not first and bool(mask & own), mask == own)
                for at, sign in ((lo, 1), (lo + width, -1)):
                    row = changes.setdefault((mask, step, at), [0] * len(KINDS))
                    for k, x in enumerate(found):
                        row[k] += sign * x
    total = factorial(n)
    return [(*key, *row) for key, row in sorted(changes.items()) if key[2] < total and any(row)]


def content_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions on a text and its words: few words, few distinct words, many capitals, odd symbols."""
    n, characters = F.size(words).cast("bigint"), F.char_length(text).cast("bigint")
    capitals = characters - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * n, "C": 100 * capitals > 3 * characters, "D": text.rlike("[#$%&*|]")}


def masks(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents, those of quality 1 and those that are toxic, by failed filters.

    ``filters`` are conditions on the columns ``text`` and ``words``, lowest
    bit first; one more bit, the highest, marks texts that a smaller id has.
    """
    filters = content_filters(F.col("text"), F.col("words")) if filters is None else filters
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(filters.values())), F.lit(0))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(part_col), F.lit("")).alias("part")
    ).withColumn("words", F.array_remove(F.split("text", WORD_BREAK), "")).select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    # a null id has no label: its rows are dealt by their text
    rows = rows.withColumn("deal", F.coalesce("doc_id", F.xxhash64("digest")))
    known = labels.groupBy(F.col("doc_id").cast("bigint").alias("label_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    joined = rows.join(known, (F.col("deal") == F.col("label_id")) & F.col("doc_id").isNotNull(), "left").fillna(0, ["good", "toxic"])
    kinds = ["digest", "part", "mask", "good", "toxic"]
    by_text = (
        joined.groupBy("deal", "doc_id", *kinds)
        .agg(F.count("*").alias("n"))
        .groupBy(*kinds)
        .agg(
            F.sum("n").alias("n"),
            F.min("doc_id").alias("least"),
            F.min_by("n", "doc_id").alias("n_least"),
            F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        )
    )
    # a text has few rows by now: its parts and labels
    firsts = F.col("n_null") + F.when(F.col("least") == F.min("least").over(Window.partitionBy("digest")), F.col("n_least")).otherwise(0)
    both = F.array(F.struct(F.lit(0).alias("copy"), "firsts"), F.struct(F.lit(1 << len(filters)).alias("copy"), (F.col("n") - F.col("firsts")).alias("firsts")))
    split = by_text.withColumn("firsts", firsts).select("part", "mask", "good", "toxic", F.explode(both).alias("x"))
    return (
        split.where("x.firsts > 0")
        .groupBy("part", (F.col("mask") + F.col("x.copy")).alias("mask"))
        .agg(F.sum("x.firsts").alias("n"), F.sum(F.col("x.firsts") * F.col("good")).alias("good"), F.sum(F.col("x.firsts") * F.col("toxic")).alias("toxic"))
    )


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """One row per part, order and step from ``masks``: what the filter of the step removes there and in all orders."""
    n = len(letters)
    orders = ["".join(o) for o in permutations(letters)]
    # of fixed size: some thousand rows, whatever the data
    table = F.broadcast(counts.sparkSession.createDataFrame(differences(n), INTERVALS))
    sums = {k: F.sum(F.col(k) * F.col("n")) for k in KINDS} | {f"{x}_lost": F.sum(F.col("removed") * F.col(x)) for x in ("good", "toxic")}
    changes = counts.join(table, "mask").groupBy("part", "step", "at").agg(*(c.alias(k) for k, c in sums.items()))
    cells = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(len(orders) * n - 1))).alias("cell"))
    ranks = cells.select("part", F.expr(f"cell div {n}").cast("int").alias("at"), (F.col("cell") % n + 1).cast("int").alias("step"))
    along = Window.partitionBy("part", "step").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranks.join(changes, ["part", "step", "at"], "left").select(
        "part", "at", "step", *(F.sum(F.coalesce(k, F.lit(0))).over(along).alias(k) for k in sums)
    )
    order = F.element_at(F.array(*map(F.lit, orders)), F.col("at") + 1)
    named = summed.withColumn("filter_order", order).withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    return named.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).select(
        "part", "filter_order", "step", *sums, "shapley"
    )
