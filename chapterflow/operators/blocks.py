"""Ordered computation inside a key without putting a whole key in one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here
a key is cut into blocks of consecutive order values, rows are shuffled by
(key, block), and what has to cross a block border (a running total, the tail
of the previous block) travels in a table with one row per block. The usual
key fits one block; a key with a third of all rows becomes many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "__block"
#: Block of the rows whose order is null.
UNORDERED = -(1 << 62)


def cut(df: DataFrame, keys: list[str], order: Column | str, size: float) -> DataFrame:
    """Number blocks of ``size`` order units; rows without an order are a block before all others.

    Rows without a key belong to no sequence and drop out. The null filter
    matters for reuse: joins infer it on one side only, and two otherwise
    equal shuffles would differ by it.
    """
    order = F.col(order) if isinstance(order, str) else order
    df = df.withColumn(BLOCK, F.coalesce(F.floor(order / size).cast("long"), F.lit(UNORDERED)))
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, BLOCK)]))


def spread(df: DataFrame, keys: list[str], order: Column | str, size: float) -> DataFrame:
    """``cut``, shuffled by key and block."""
    return cut(df, keys, order, size).repartition(*keys, BLOCK)


def block_window(keys: list[str], *order: Column | str):
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


def so_far(keys: list[str], *order: Column | str):
    return block_window(keys, *order).rowsBetween(Window.unboundedPreceding, 0)


def before(keys: list[str], *order: Column | str):
    return block_window(keys, *order).rowsBetween(Window.unboundedPreceding, -1)


def blocks_before(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def blocks_after(keys: list[str]):
    # Looking ahead runs over the reversed order: frames that end at
    # "unbounded following" are recomputed for every row.
    return Window.partitionBy(*keys).orderBy(F.col(BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1)


def _all_columns(df: DataFrame) -> Column:
    """A number that needs every column of ``df``."""
    plain = lambda t: "map<" not in t and "variant" not in t
    return F.xxhash64(*[F.col(c) if plain(t) else F.col(c).isNotNull() for c, t in df.dtypes])


def carry(
    df: DataFrame, keys: list[str], source: DataFrame | None = None, once: bool = False, **items: tuple[Column, str]
) -> DataFrame:
    """Add per-block values gathered from the key's other blocks.

    ``items`` maps an output column to (aggregate over one block, direction):
    ``sum_before``, ``max_before``, ``last_before``, ``first_after``,
    ``max_all`` or ``sum_all``. ``source`` is the table before its shuffle:
    aggregating it combines map-side and moves one row per block. ``once``
    asks for all columns of the table that is aggregated, so its shuffle is
    that of the rows, and what lies before it is computed once, not twice.
    """
    given = df if source is None else source
    whole = [F.max(_all_columns(given)).alias("__whole")] if once else []
    per_block = given.groupBy(*keys, BLOCK).agg(*[agg.alias(name) for name, (agg, _) in items.items()], *whole)
    if once:
        per_block = per_block.filter("__whole is not null")
    ways = {
        "sum_before": lambda c: F.coalesce(F.sum(c).over(blocks_before(keys)), F.lit(0)),
        "max_before": lambda c: F.max(c).over(blocks_before(keys)),
        "last_before": lambda c: F.last(c, ignorenulls=True).over(blocks_before(keys)),
        "first_after": lambda c: F.last(c, ignorenulls=True).over(blocks_after(keys)),
        "max_all": lambda c: F.max(c).over(Window.partitionBy(*keys)),
        "sum_all": lambda c: F.sum(c).over(Window.partitionBy(*keys)),
    }
    moved = per_block.select(*keys, BLOCK, *[ways[how](F.col(name)).alias(name) for name, (_, how) in items.items()])
    return df.join(moved, [*keys, BLOCK], "left")


def add_index(df: DataFrame, keys: list[str], order: list[Column | str], name: str, once: bool = False) -> DataFrame:
    """1-based position inside the key, over an already spread table.

    With ``once`` the order, too, asks for all columns (behind ``order``), so
    the rows keep them in their shuffle whatever is used later.
    """
    order = [*order, _all_columns(df)] if once else order
    df = carry(df, keys, once=once, __count=(F.count(F.lit(1)), "sum_before"))
    local = F.row_number().over(block_window(keys, *order))
    return df.withColumn(name, F.col("__count") + local.cast("long")).drop("__count")


def with_lag(
    df: DataFrame, keys: list[str], order: str, size: int, **columns: Column
) -> DataFrame:
    """Spread ``df`` and add each expression's value on the key's previous row.

    Order values may have holes: each block's last row is found by aggregation.
    """
    flat = cut(df, keys, order, size)
    rows = flat.repartition(*keys, BLOCK)
    items = {f"__tail_{n}": (F.max_by(c, F.col(order)), "last_before") for n, c in columns.items()}
    rows = carry(rows, keys, source=flat, **items)
    w = block_window(keys, order)
    first = F.row_number().over(w) == 1
    rows = rows.withColumns(
        {n: F.when(first, F.col(f"__tail_{n}")).otherwise(F.lag(c).over(w)) for n, c in columns.items()}
    )
    return rows.drop(*[f"__tail_{n}" for n in columns])


def with_neighbours(df: DataFrame, keys: list[str], order: str, size: int, **columns: Column) -> DataFrame:
    """Spread ``df`` and add ``prev_<name>`` and ``next_<name>`` of each expression."""
    flat = cut(df, keys, order, size)
    items = {f"__tail_{n}": (F.max_by(c, F.col(order)), "last_before") for n, c in columns.items()}
    items |= {f"__head_{n}": (F.min_by(c, F.col(order)), "first_after") for n, c in columns.items()}
    rows = carry(flat.repartition(*keys, BLOCK), keys, source=flat, **items)
    w = block_window(keys, order)
    first, last = F.row_number().over(w) == 1, F.lead(F.lit(True)).over(w).isNull()
    added = {f"prev_{n}": F.when(first, F.col(f"__tail_{n}")).otherwise(F.lag(c).over(w)) for n, c in columns.items()}
    added |= {f"next_{n}": F.when(last, F.col(f"__head_{n}")).otherwise(F.lead(c).over(w)) for n, c in columns.items()}
    return rows.withColumns(added).drop(*items)


def add_running_sum(df: DataFrame, keys: list[str], order: str, name: str, value: Column) -> DataFrame:
    """Inclusive running total of ``value`` along the key, over a spread table."""
    df = carry(df, keys, __sum=(F.sum(value), "sum_before"))
    local = F.coalesce(F.sum(value).over(so_far(keys, order)), F.lit(0))
    return df.withColumn(name, F.col("__sum") + local).drop("__sum")


def add_running_max(df: DataFrame, keys: list[str], order: str, name: str, value: Column) -> DataFrame:
    """Inclusive running maximum of ``value`` along the key (nulls skipped)."""
    df = carry(df, keys, __max=(F.max(value), "max_before"))
    local = F.max(value).over(so_far(keys, order))
    return df.withColumn(name, F.greatest(local, F.col("__max"))).drop("__max")


def ordered_join(sort_key: Column, text: Column, separator: str) -> Column:
    """Aggregate: texts of a (bounded) group joined in ``sort_key`` order."""
    pairs = F.array_sort(F.collect_list(F.struct(sort_key.alias("k"), text.alias("t"))))
    return F.array_join(F.transform(pairs, lambda p: p["t"]), separator)
