"""Removal of repeated byte strings by column-wise suffix sorting.

A byte is removed when a string of ``LENGTH`` bytes that covers it also starts
earlier in the collection (smaller id, or same text and earlier place).

Equal strings of that length hold the same leftmost least ``GRAM``-byte gram
at the same place (winnowing), so all occurrences of a gram that is chosen
twice, each with the bytes of the strings that choose it, are a collection of
aligned segments in which every match can be seen. Every string belongs to
one segment. The
segments of a gram are sorted column by column from the right: each round
inserts one symbol of every segment before its suffix, keeps the
Burrows-Wheeler order by a stable sort of the inserted symbols, and updates
the common prefixes of neighbours from those of the round before. Neighbours
that share ``LENGTH`` bytes are equal strings; all but the first of them are
covered. Spark's sorted shuffle files are the sequential external files in
which the collection lies between the steps; a task holds the segments of few
grams at a time.

Blocks count their grams and are sent back those that repeat; equal segments
of a block are collapsed before they travel.

Defined cases: null and empty texts and texts shorter than ``LENGTH`` lose
nothing; of rows with equal ids the first by place comes earlier; null ids
come last; an empty table gives no row; columns other than id and text are
ignored; what is kept is bytes, for a cut may split a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chapterflow.llm.common import Scratch, blocks, runs, unpacked

LENGTH, GRAM = 100, 32
LEFT = LENGTH - GRAM
SPAN = LEFT + LENGTH
#: Segments that a task sorts together (more if one gram has more).
TOGETHER = 40_000
#: Bytes whose anchors are found at once.
SLICE = 512 << 10
NO_ID = (1 << 63) - 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SEGMENTS = "gram bigint, doc bigint, block bigint, at bigint, lo int, segment binary"
INTERVALS = "block bigint, start bigint, end bigint"


def _digests(data: bytes) -> np.ndarray:
    """Digest of the gram at every place."""
    h, power, width = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), _B, 1
    with np.errstate(over="ignore"):
        while width < GRAM:  # digests of strings twice as long each time
            h = h[:-width] * power + h[width:]
            power, width = power * power, 2 * width
    h ^= h >> np.uint64(31)
    h *= _A
    h ^= h >> np.uint64(29)
    return h


def _leftmost_least(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, value) of the least of every ``width`` neighbours, the leftmost of equal ones."""
    value, at, done = h, np.arange(len(h), dtype=np.int32), 1
    while done < width:
        step = min(done, width - done)
        later = value[step:] < value[:-step]
        value, at = np.where(later, value[step:], value[:-step]), np.where(later, at[step:], at[:-step])
        done += step
    return at, value


def anchors(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, digest, first, last) of the grams that are leftmost least in a string of LENGTH bytes within a text.

    first and last are the starts of the strings that choose the gram: every
    string belongs to one anchor. The data are walked in slices of strings,
    so memory does not grow with a block.
    """
    ends = np.cumsum(sizes)
    begin = ends - sizes
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
    for lo in range(0, max(0, len(data) - LENGTH + 1), SLICE):
        hi = min(len(data), lo + SLICE + LENGTH - 1)
        h = _digests(data[lo:hi])
        at, value = _leftmost_least(h, LENGTH - GRAM + 1)
        own = slice(np.searchsorted(ends, lo, side="right"), np.searchsorted(begin, hi, side="left"))
        first, last = np.maximum(begin[own], lo) - lo, np.minimum(ends[own], hi) - lo - LENGTH + 1
        steps = np.zeros(len(at) + 1, np.int32)
        valid = last > first  # strings that lie within one text
        np.add.at(steps, first[valid], 1)
        np.add.at(steps, last[valid], -1)
        start = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
        at = at[start]
        cuts = np.flatnonzero(np.diff(at, prepend=-1, append=len(h)))  # strings of one anchor follow each other
        for column, x in zip(out, (at[cuts[:-1]] + lo, value[start][cuts[:-1]].view(np.int64), start[cuts[:-1]] + lo, start[cuts[1:] - 1] + lo), strict=True):
            column.append(x)
    at, digest, first, last = map(np.concatenate, out)
    new = np.flatnonzero(np.diff(at, prepend=-1))  # an anchor whose strings lie in two slices
    return at[new], digest[new], first[new], last[np.append(new[1:], len(at))[: len(new)] - 1]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, _, sizes, data in unpacked(batches):
        found, n = np.unique(anchors(data, sizes)[1], return_counts=True)
        yield pa.record_batch({"block": pa.array(np.full(len(found), block), pa.int64()), "gram": pa.array(found), "n": pa.array(n, pa.int64())})


def _segments(left: pa.Table, right: pa.Table) -> pa.Table:
    """Segments of the repeated grams; equal ones of the block once.

    What the others span is covered; neighbouring spans are merged and come
    with a null segment, their start as place and their end as lo.
    """
    asked = np.sort(right.column("gram").to_numpy())
    out: list[list] = [[] for _ in range(6)]
    for block, ids, sizes, data in unpacked(iter(left.to_batches())) if len(asked) else ():
        at, gram, first, last = anchors(data, sizes)
        slot = np.searchsorted(asked, gram)
        slot[slot == len(asked)] = 0
        repeated = asked[slot] == gram
        at, gram, first, last = at[repeated], gram[repeated], first[repeated], last[repeated]
        doc = np.array([NO_ID if i is None else i for i in ids], np.int64)[np.searchsorted(np.cumsum(sizes), at, side="right")]
        order = np.argsort(doc, kind="stable")
        lo = first - at + LEFT
        seen, new = set(), np.zeros(len(at), bool)
        for x, f, n, k in zip(order.tolist(), first[order].tolist(), last[order].tolist(), lo[order].tolist(), strict=True):
            key = (k, data[f : n + LENGTH])
            if key not in seen:
                seen.add(key)
                new[x] = True
        own = np.flatnonzero(new)
        pieces = [data[f : n + LENGTH] for f, n in zip(first[own].tolist(), last[own].tolist(), strict=True)]
        start, end = first[~new], last[~new] + LENGTH
        apart = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]])) if len(start) else np.zeros(0, np.int64)
        start, end = start[apart], end[np.append(apart[1:], len(end))[: len(apart)] - 1]
        # covered spans have nothing to meet: they are dealt by their place
        to = np.array([hash((block, x)) for x in start.tolist()], np.int64)
        for column, x in zip(out, ((gram[own], to), (doc[own], np.zeros(len(to), np.int64)), (np.full(len(own) + len(to), block),), (at[own], start), (lo[own], end)), strict=False):
            column.append(np.concatenate(x))
        out[5] += pieces + [None] * len(to)
    columns = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out[:5]]
    return pa.table([*columns[:4], columns[4].cast(pa.int32()), pa.array(out[5], pa.binary())], names=["gram", "doc", "block", "at", "lo", "segment"])


def covered(group: np.ndarray, segments: np.ndarray, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each segment and start column: is an equal string of LENGTH bytes in a segment of its group with a smaller rank?

    group: number of each segment's group; lo, hi: first and last column at
    which a string of the text starts.
    """
    n = len(group)
    out = np.zeros((n, LEFT + 1), bool)
    order = np.argsort(group, kind="stable")
    common = np.zeros(n + 1, np.int16)  # with the suffix before it in order
    for c in range(SPAN - 1, -1, -1):
        key = (group[order].astype(np.int64) << 8) | segments[order, c]
        to = np.argsort(key, kind="stable")
        same = key[to[1:]] == key[to[:-1]]
        first, last = to[:-1][same] + 1, to[1:][same] + 1
        prefix = np.zeros(n + 1, np.int16)
        if len(first):
            least = np.minimum.reduceat(common, np.stack([first, last], axis=1).ravel())[::2]
            prefix[1:n][same] = least + 1
        order, common = order[to], prefix
        if c <= LEFT:
            starts = np.flatnonzero(common[:n] < LENGTH)
            valid = (lo[order] <= c) & (c <= hi[order])
            place = np.where(valid, rank[order], n)
            earliest = np.repeat(np.minimum.reduceat(place, starts), np.diff(np.append(starts, n)))
            out[order[valid & (place > earliest)], c] = True
    return out


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of the texts that equal earlier strings; rows come sorted by gram."""

    def done(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(held)
        block, at, lo = (t.column(c).to_numpy() for c in ("block", "at", "lo"))
        whole = t.column("segment").is_null().to_numpy()
        yield pa.record_batch([pa.array(x) for x in (block[whole], at[whole], lo[whole].astype(np.int64))], names=["block", "start", "end"])
        t = t.filter(pa.array(~whole))
        if not t.num_rows:
            return
        block, at, lo, doc, gram = (t.column(c).to_numpy() for c in ("block", "at", "lo", "doc", "gram"))
        pieces = t.column("segment").to_pylist()
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        segments = np.zeros((len(pieces), SPAN), np.uint8)
        shift = np.arange(len(pieces)) * SPAN + lo - (np.cumsum(sizes) - sizes)
        segments.ravel()[np.arange(sizes.sum()) + np.repeat(shift, sizes)] = np.frombuffer(b"".join(pieces), np.uint8)
        group = np.cumsum(np.concatenate([[False], gram[1:] != gram[:-1]]))
        rank = np.empty(len(group), np.int64)
        rank[np.lexsort((at, block, doc))] = np.arange(len(group))
        found = np.zeros((len(group), LEFT + 3), np.int8)
        found[:, 1:-1] = covered(group, segments, lo, lo + sizes - LENGTH, rank)
        change = np.diff(found, axis=1)
        (which, begin), (_, end) = np.nonzero(change == 1), np.nonzero(change == -1)
        base = at[which] - LEFT
        yield pa.record_batch([pa.array(x) for x in (block[which], base + begin, base + end - 1 + LENGTH)], names=["block", "start", "end"])

    held, size = [], 0
    for group in runs(batches, ["gram"]):
        held.append(group)
        size += group.num_rows
        if size >= TOGETHER:
            yield from done(held)
            held, size = [], 0
    if held:
        yield from done(held)


def _kept(left: pa.Table, right: pa.Table) -> pa.Table:
    out: list[tuple] = []
    start, end = (right.column(c).to_numpy() for c in ("start", "end"))
    for _, ids, sizes, data in unpacked(iter(left.to_batches())):
        begin = np.cumsum(sizes) - sizes
        steps = np.zeros(len(data) + 1, np.int64)
        np.add.at(steps, start, 1)
        np.add.at(steps, end, -1)
        gone = np.cumsum(steps)[:-1] > 0
        a = np.frombuffer(data, np.uint8)
        for i, b, n in zip(ids, begin.tolist(), sizes.tolist(), strict=True):
            own = gone[b : b + n]
            if own.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                spans = [{"start": s, "end": e} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
                out.append((i, n, spans, a[b : b + n][~own].tobytes()))
            else:
                out.append((i, n, [], data[b : b + n]))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), span, pa.binary()), strict=True)], names=["doc_id", "n_bytes", "spans", "kept"])


def deduplicated(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed spans of bytes and the bytes left of every row."""
    packed = scratch.store("blocks", blocks(docs, 4 << 20, id_col, text_col)).select("block", "ids", "sizes", "payload")
    grams = scratch.store("grams", packed.mapInArrow(_grams, "block bigint, gram bigint, n bigint"))
    repeated = grams.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    asked = scratch.store("asked", grams.join(repeated, "gram").select("block", "gram"))
    scratch.drop("grams")
    segments = packed.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_segments, SEGMENTS)
    sorted_segments = segments.repartition("gram").sortWithinPartitions("gram")
    intervals = scratch.store("intervals", sorted_segments.mapInArrow(_covered, INTERVALS))
    return packed.groupBy("block").cogroup(intervals.groupBy("block")).applyInArrow(
        _kept, "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"
    )
