"""Benchmark decontamination by the q-gram lemma.

Benchmark items and documents are normalised (lower case, runs of anything but
letters and digits become one space) and seen as UTF-8 bytes. An item is cut
into windows of ``WINDOW`` bytes, half overlapping, so that a leaked part of
an item is found as well. A text within ``e`` edits of a window of ``m`` bytes
shares at least ``m + 1 - (e + 1) q`` of its q-grams with it, all of them
within ``e`` diagonals of each other. Shared q-grams are counted in bands of
diagonals, each two half bands wide and overlapping its neighbours by one;
bands that reach the bound are verified by alignment along the band.

The documents are not shuffled. Benchmarks are met in batches of at most
``BATCH_BYTES`` normalised bytes, one pass over the documents for each, so
what the tasks are sent has a bound.

Defined cases: null and empty texts and items match nothing, nor do items of
fewer than ``Q`` normalised bytes; repeated documents and items each match;
empty tables give no row; columns other than ids and texts are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chapterflow.llm.common import texts

Q, WINDOW, SHARE = 8, 120, 0.1
BATCH_BYTES = 8 << 20
#: Normalised bytes that a task looks at together.
PIECE = 4 << 20
#: Shared q-grams that are counted at once.
HITS = 2 << 20
#: Windows and regions that are held against each other at once.
PAIRS = 4096
MATCHES = "doc_id bigint, item_id bigint, item_start bigint, start bigint, end bigint, edits int"
_OTHER = re.compile(r"[\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).strip().encode()


def windows(items: list[tuple[int, bytes]]) -> dict[bytes, list[tuple[int, int]]]:
    """Windows over the items, the last one flush with an item's end; each with the items that have it, and its first place there."""
    out: dict[bytes, dict[tuple[int, int], int]] = {}
    for k, (i, b) in enumerate(items):
        last = max(0, len(b) - WINDOW)
        for s in sorted({*range(0, last, WINDOW // 2), last}) if len(b) >= Q else ():
            out.setdefault(b[s : s + WINDOW], {}).setdefault((k, i), s)
    return {w: [(i, s) for (_, i), s in x.items()] for w, x in out.items()}


def budget(m: int) -> int:
    """Edits allowed in a window of m bytes: a share of it, as long as one q-gram must stay."""
    return min(int(SHARE * m), (m - Q) // Q)


def grams(data: bytes) -> np.ndarray:
    """The q-gram that starts at each byte, as an integer."""
    n = len(data) - Q + 1
    out = np.empty(max(n, 0), np.uint64)
    for k in range(min(Q, max(n, 0))):
        part = np.frombuffer(data, "<u8", count=(len(data) - k) // 8, offset=k)
        out[k::8] = part[: len(out[k::8])]
    return out


def banded(window: bytes, region: bytes, low: int, width: int, most: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best alignment of the whole window in the region.

    Only diagonals ``low`` to ``low + width`` (place in the region less place
    in the window) are filled. None: more than ``most`` edits.
    """
    far, k = most + 1, np.arange(width + 1)
    diagonal = low + k
    cost = np.where((diagonal >= 0) & (diagonal <= len(region)), 0, far)
    start = diagonal.copy()
    text = np.frombuffer(region, np.uint8)
    for i, c in enumerate(window):
        at = diagonal + i  # the region's byte that this byte of the window is held against
        inside = (at >= 0) & (at < len(text))
        step = cost + np.where(inside, text[np.clip(at, 0, len(text) - 1)] != c, far)
        down = np.append(cost[1:] + 1, far)  # a byte of the window that the region lacks
        better = down < step
        begun = np.where(better, np.append(start[1:], 0), start)
        cost = np.minimum(np.minimum(step, down), far)
        least = np.minimum.accumulate(cost - k)  # then bytes of the region that the window lacks
        source = np.maximum.accumulate(np.where(cost - k == least, k, 0))
        cost, start = np.minimum(least + k, far), begun[source]
        if cost.min() > most:
            return None
    ends = diagonal + len(window)
    cost = np.where((ends >= 0) & (ends <= len(region)), cost, far)
    best = int(cost.argmin())
    return (int(start[best]), int(ends[best]), int(cost[best])) if cost[best] <= most else None


def near(windows: list[bytes], regions: list[bytes], most: np.ndarray) -> np.ndarray:
    """Is each window within ``most`` edits of any part of its region?

    By bit-parallel columns of the distance tables of all pairs at once; a
    column is two 64-bit words, low word first, for windows of up to 128 bytes.
    """
    number = {w: k for k, w in enumerate(dict.fromkeys(windows))}
    which = np.array([number[w] for w in windows], np.int64)
    one = np.uint64(1)
    where = np.zeros((2, len(number), 256), np.uint64)  # for each byte, a bit for every place where a window has it
    for w, k in number.items():
        for i, c in enumerate(w):
            where[i >> 6, k, c] |= one << np.uint64(i & 63)
    sizes = np.array([len(w) for w in windows], np.int64)
    top_low = np.where(sizes <= 64, one << (np.minimum(sizes, 64) - 1).astype(np.uint64), np.uint64(0))
    top_high = np.where(sizes > 64, one << np.maximum(sizes - 65, 0).astype(np.uint64), np.uint64(0))
    longest = max(map(len, regions), default=0)
    text = np.frombuffer(b"".join(r.ljust(longest, b"\0") for r in regions), np.uint8).reshape(len(regions), longest)
    lengths = np.array([len(r) for r in regions], np.int64)
    up0, up1 = np.full(len(windows), ~np.uint64(0)), np.full(len(windows), ~np.uint64(0))
    down0, down1 = np.zeros_like(up0), np.zeros_like(up0)
    distance = sizes.copy()
    found = distance <= most
    for at in range(longest):
        eq0, eq1 = where[0, which, text[:, at]], where[1, which, text[:, at]]
        xv0, xv1 = eq0 | down0, eq1 | down1
        sum0 = (eq0 & up0) + up0
        sum1 = (eq1 & up1) + up1 + (sum0 < up0)
        xh0, xh1 = (sum0 ^ up0) | eq0, (sum1 ^ up1) | eq1
        ph0, ph1 = down0 | ~(xh0 | up0), down1 | ~(xh1 | up1)
        mh0, mh1 = up0 & xh0, up1 & xh1
        distance += ((ph0 & top_low) | (ph1 & top_high)) != 0
        distance -= ((mh0 & top_low) | (mh1 & top_high)) != 0
        found |= (distance <= most) & (at < lengths)
        ph0, ph1 = ph0 << one, (ph1 << one) | (ph0 >> np.uint64(63))
        mh0, mh1 = mh0 << one, (mh1 << one) | (mh0 >> np.uint64(63))
        up0, up1 = mh0 | ~(xv0 | ph0), mh1 | ~(xv1 | ph1)
        down0, down1 = ph0 & xv0, ph1 & xv1
    return found


class Index:
    """Postings of the windows' q-grams, sorted; a bit table screens most q-grams out."""

    BITS = 22

    def __init__(self, items: list[tuple[int, bytes]]):
        found = windows(items)
        self.windows, self.owners = list(found), list(found.values())
        self.edits = np.array([budget(len(w)) for w in self.windows], np.int64)
        self.sizes = np.array([len(w) for w in self.windows], np.int64)
        lists = [grams(w) for w in self.windows]
        gram = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        place = np.concatenate([np.arange(len(x)) for x in lists]) if lists else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.gram, self.first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[self._slot(self.gram)] = True

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return (gram * _MIX) >> np.uint64(64 - self.BITS)

    def regions(self, data: bytes) -> Iterator[tuple[int, int]]:
        """(window, band) of every band with as many shared q-grams as the bound asks for."""
        gram = grams(data)
        at = np.flatnonzero(self.table[self._slot(gram)])
        slot = np.searchsorted(self.gram, gram[at])
        slot[slot == len(self.gram)] = 0
        true = self.gram[slot] == gram[at] if len(self.gram) else np.zeros(0, bool)
        at, slot = at[true], slot[true]
        n = self.count[slot]
        pieces = np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), HITS), side="right").tolist()
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(pieces, [*pieces[1:], len(n)], strict=False):
            some = n[lo:hi]
            posting = np.repeat(self.first[slot[lo:hi]] - np.cumsum(some) + some, some) + np.arange(some.sum())
            owner = self.owner[posting]
            half = (np.repeat(at[lo:hi], some) - self.place[posting] + WINDOW) // (self.edits[owner] + 1)
            key, hits = np.unique((owner << 34) | half, return_counts=True)
            keys.append(key)
            counts.append(hits)
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        hits = np.bincount(where, weights=np.concatenate(counts), minlength=len(key))
        both = np.concatenate([key, key - 1])  # a hit counts for the band that starts at its half and for the one before
        band, where = np.unique(both, return_inverse=True)
        total = np.bincount(where, weights=np.concatenate([hits, hits]), minlength=len(band))
        owner = band >> 34
        for b in band[total >= self.sizes[owner] + 1 - (self.edits[owner] + 1) * Q].tolist():
            yield b >> 34, b & ((1 << 34) - 1)

    def matches(self, data: bytes, starts: list[int] | None = None) -> set[tuple[int, int, int, int]]:
        """(window, start, end, edits) of every verified region.

        ``starts`` are the places where the texts in ``data`` begin, with one
        byte between two of them; a region lies inside one text.
        """
        found, held, starts = set(), [], starts or [0]
        stops = [*(s - 1 for s in starts[1:]), len(data)]

        def flush() -> None:
            """The band is filled only where it can hold a match."""
            close = near([self.windows[w] for w, *_ in held], [region for *_, region in held], np.array([self.edits[w] for w, *_ in held]))
            for k in np.flatnonzero(close).tolist():
                w, begin, low, region = held[k]
                e = int(self.edits[w])
                got = banded(self.windows[w], region, low - begin - e, 4 * e + 1, e)
                if got:
                    found.add((w, begin + got[0], begin + got[1], got[2]))
            held.clear()

        for w, band in self.regions(data):
            window, e = self.windows[w], int(self.edits[w])
            low = band * (e + 1) - WINDOW
            first, end = max(0, low - e), low + 3 * e + 2 + len(window)
            for k in range(bisect_right(starts, first) - 1, bisect_left(starts, end)):
                begin = max(first, starts[k])
                region = data[begin : min(end, stops[k])]
                exact = region.find(window)
                if exact >= 0:
                    found.add((w, begin + exact, begin + exact + len(window), 0))
                elif e and len(region) >= len(window) - e:
                    held.append((w, begin, low, region))
                    if len(held) == PAIRS:
                        flush()
        if held:
            flush()
        return found


def _found(items: list[tuple[int, bytes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items)
        for b in batches:
            out = []

            def flush(held: list[tuple[int, bytes]], out: list = out) -> None:
                data = b"\0".join(x for _, x in held)
                starts = [0, *accumulate(len(x) + 1 for _, x in held[:-1])]
                for w, start, end, edits in index.matches(data, starts):
                    k = bisect_right(starts, start) - 1
                    out.extend((held[k][0], item, at, start - starts[k], end - starts[k], edits) for item, at in index.owners[w])

            held, size = [], 0
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                held.append((i, normalised(t.as_py())))
                size += len(held[-1][1])
                if size > PIECE:
                    flush(held)
                    held, size = [], 0
            flush(held)
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 5 + [pa.int32()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "item_start", "start", "end", "edits"])

    return run


def item_batches(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, bytes]]]:
    """Normalised items, in batches of at most ``BATCH_BYTES`` (or one longer item), streamed through the driver."""
    held: list[tuple[int, bytes]] = []
    for r in benchmark.select(F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col), F.lit(""))).toLocalIterator():
        item = (r[0], normalised(r[1]))
        if held and sum(len(x) for _, x in held) + len(item[1]) > BATCH_BYTES:
            yield held
            held = []
        held.append(item)
    yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, item_start, start, end, edits): every region of a document that matches a window of an item.

    Places are bytes of the normalised texts. A document without a row is clean.
    """
    plain, out = texts(docs, id_col, text_col), None
    for items in item_batches(benchmark):
        found = plain.mapInArrow(_found(items), MATCHES)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, in all their columns, whose text matches no item."""
    names, out = docs.columns, docs
    for items in item_batches(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            find = _found(items)
            for b in batches:
                rows = pa.record_batch({"doc_id": pa.array(range(b.num_rows), pa.int64()), "text": b.column(text_col).fill_null("")})
                hit = {i for found in find(iter([rows])) for i in found.column("doc_id").to_pylist()}
                yield b.filter(pa.array([i not in hit for i in range(b.num_rows)], pa.bool_()))

        out = out.select(*names).mapInArrow(run, docs.schema)
    return out
