"""The recurrence of chapter repair, composed over blocks of chapters.

With x the repaired end before it, a chapter's repaired end is a constant
while x is low enough (its own end, or one second after its own start where
its end lies before that), else x + 1.1; and never more than the duration.
Over a block this gives a step function: the first chapter that x does not
push fixes all that follows; if x pushes all of them, each adds 1.1. So a
block is described by few thresholds with a constant each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chapterflow.operators.blocks import BLOCK

GAP_S, LEAST_S = 0.1, 1.0
#: Closer than this to a threshold, the pushes are carried out one by one.
NEAR_S = 1e-6
STEPS = "limits array<double>, pushes array<int>, starts array<double>, owns array<double>, ends array<double>, n int, duration_s double"

STEP_NAMES = [x.split()[0] for x in STEPS.split(", ")]


def _number(x: float | None, instead: float) -> float:
    return instead if x is None or math.isnan(x) else x


def _values(start_s: list, end_s: list, duration_s: list) -> list[tuple[float, float, float]]:
    """Chapters as numbers: a missing start binds nothing, a missing end or duration is without limit."""
    return [(_number(s, -math.inf), _number(e, math.inf), _number(d, math.inf)) for s, e, d in zip(start_s, end_s, duration_s, strict=True)]


def _own_end(chapter: tuple[float, float, float], before: float) -> float | None:
    """The repaired end of a chapter that the end before it does not push, or None."""
    s, e, d = chapter
    start = max(s, before + GAP_S)
    if e > start:
        return min(e, d)
    return min(start + LEAST_S, d) if start == s else None


def fold(chapters: list[tuple[float, float, float]], before: float) -> list[float]:
    """Repaired ends, one after the other."""
    out = []
    for chapter in chapters:
        own = _own_end(chapter, before)
        before = own if own is not None else min(before + GAP_S + LEAST_S, chapter[2])
        out.append(before)
    return out


def steps(chapters: list[tuple[float, float, float]]) -> tuple[list, list, list, list, list]:
    """For each chapter that some end before the block leaves unpushed first: the limit below which it does, rising;
    how many chapters are pushed before it; its start and end; and the block's last end then."""
    n = len(chapters)
    last = [0.0] * n  # the last end if chapter k is the first that is not pushed
    for k in range(n - 1, -1, -1):
        end, at = _own_end(chapters[k], -math.inf), k + 1
        while at < n:
            if _own_end(chapters[at], end) is not None:
                end = last[at]
                break
            end = min(end + GAP_S + LEAST_S, chapters[at][2])
            at += 1
        last[k] = end
    found, most = [], -math.inf
    for k, (s, e, _) in enumerate(chapters):
        limit = max(s, e) - GAP_S - k * (GAP_S + LEAST_S)
        if not found or limit > most - NEAR_S:
            found.append((limit, k, s, e, last[k]))
            most = max(most, limit)
    return tuple(map(list, zip(*found, strict=True)))


def after(before: float, limits: list, pushes: list, starts: list, owns: list, ends: list, n: int, duration: float) -> float:
    """The last end of a block behind the end ``before``."""
    for limit, k, s, e, end in zip(limits, pushes, starts, owns, ends, strict=True):
        if before < limit - NEAR_S:
            return end
        if before < limit + NEAR_S:
            reached = before
            for _ in range(k):
                reached = min(reached + GAP_S + LEAST_S, duration)
            if _own_end((s, e, duration), reached) is not None:
                return end
    for _ in range(n):
        before = min(before + GAP_S + LEAST_S, duration)
    return before


def _sorted(rows: DataFrame, names: list[str], *first: Column) -> DataFrame:
    """All rows of a block in one task, block after block, chapters in order; missing values last."""
    order = [F.col(c).asc_nulls_last() for c in ("number", "start_s", "end_s")]
    return rows.repartition(*names).sortWithinPartitions(*names, *first, *order)


def entering_ends(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., block, entering): the repaired end before every block of cut chapters, -infinity before the first."""
    types = {f.name: f.dataType for f in rows.schema.fields}
    names = [*keys, BLOCK]
    own = T.StructType([T.StructField(c, types[c]) for c in names])
    described = T.StructType([*own.fields, *T._parse_datatype_string(STEPS).fields])
    entered = T.StructType([*own.fields, T.StructField("entering", T.DoubleType())])

    def batch_of(lines: list[tuple], schema: T.StructType) -> pa.RecordBatch:
        arrow = to_arrow_schema(schema)
        columns = zip(*lines, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, values, lines = None, [], []

        def line() -> tuple:
            chapters = _values(*zip(*values, strict=True))
            return (*block, *steps(chapters), len(chapters), chapters[0][2])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*names, "start_s", "end_s", "duration_s")), strict=True):
                if row[:-3] != block:
                    if values:
                        lines.append(line())
                    block, values = row[:-3], []
                values.append(row[-3:])
            if lines:
                yield batch_of(lines, described)
                lines = []
        if values:
            yield batch_of([line()], described)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, -math.inf
        for batch in batches:
            lines = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*names, *STEP_NAMES)), strict=True):
                key, step = row[: len(keys)], row[len(names) :]
                before = before if key == last else -math.inf
                last = key
                lines.append((*row[: len(names)], before))
                before = after(before, *step)
            if lines:
                yield batch_of(lines, entered)

    per_block = _sorted(rows, names).mapInArrow(describe, described)
    return per_block.repartition(*keys).sortWithinPartitions(*names).mapInArrow(compose, entered)


def folded_ends(rows: DataFrame, entered: DataFrame, keys: list[str], schema: T.StructType) -> DataFrame:
    """Chapters with ``__end``, the repaired end, from cut rows and the end that enters each block.

    The entering end of a block lies before its chapters, in the same shuffle.
    """
    names = [*keys, BLOCK]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = -math.inf
        for batch in batches:
            chapters, ends = _values(*(batch.column(c).to_pylist() for c in ("start_s", "end_s", "duration_s"))), []
            for opens, entering, chapter in zip(batch.column("__opens").to_pylist(), batch.column("entering").to_pylist(), chapters, strict=True):
                before = entering if opens else fold([chapter], before)[0]
                ends.append(None if opens or math.isinf(before) else before)
            out = batch.select(schema.names)
            out = pa.RecordBatch.from_arrays([*out.columns, pa.array(ends, pa.float64())], names=[*schema.names, "__end"])
            yield out.filter(pc.invert(batch.column("__opens")))

    marks = entered.withColumn("__opens", F.lit(True))
    both = rows.withColumns({"__opens": F.lit(False), "entering": F.lit(None).cast("double")}).unionByName(marks, allowMissingColumns=True)
    sorted_rows = _sorted(both, names, F.col("__opens").desc())
    return sorted_rows.mapInArrow(run, T.StructType([*[T.StructField(f.name, f.dataType) for f in schema.fields], T.StructField("__end", T.DoubleType())]))
