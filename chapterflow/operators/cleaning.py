"""What cleaning does to a corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chapterflow.functions import text as T

SHARES = (0.1, 0.5, 0.9)
#: Ranks of the percentiles are off by one part in this many at most; smaller groups are exact.
ACCURACY = 10_000


def cleaning_report(
    texts: DataFrame,
    keys: tuple[str, ...] = ("lang",),
    text_col: str = "text",
    clean: Callable[[Column], Column] = T.preprocess,
    shares: tuple[float, ...] = SHARES,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Characters before and after cleaning by group, with the mean and percentiles of the share removed.

    One scan and one aggregation: texts are cleaned where they are read, and
    each task sends sums and a mergeable quantile sketch per group, whatever
    the size of a group. Null texts are not counted; an empty text loses
    nothing. ``accuracy`` bounds the rank error of a percentile and the size
    of a sketch.
    """
    before = F.length(text_col).cast("long")
    sizes = texts.filter(F.col(text_col).isNotNull()).select(*keys, before.alias("before"), F.length(clean(F.col(text_col))).cast("long").alias("after"))
    removed = F.when(F.col("before") > 0, 1 - F.col("after") / F.col("before")).otherwise(F.lit(0.0))
    sketch = F.percentile_approx(removed, list(shares), accuracy)
    told = sizes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("before").alias("chars_before"), F.sum("after").alias("chars_after"),
        F.avg(removed).alias("mean_reduction"), sketch.alias("__sketch"),
    )
    percentiles = [F.col("__sketch")[k].alias(f"p{round(100 * share)}_reduction") for k, share in enumerate(shares)]
    return told.select(*keys, "n_docs", "chars_before", "chars_after", "mean_reduction", *percentiles)
