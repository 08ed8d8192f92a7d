"""Removal of word sequences that stand more than once, found by fixed-block anchors.

A window is ``width`` consecutive words of one text; a word goes when a window
that covers it starts anywhere else as well. Every text is cut into
non-overlapping reference blocks of (width + 1) // 2 words, so each window
holds one of them whole. All reference blocks are indexed, and every rolling
window of the same length probes them: a block that no other place has is no
anchor. From each anchor the repeat is extended word by word to both sides:
the windows over the anchor whose words stand elsewhere, each found by digest,
are added up to maximal exact repeats. Copies meet as digests, one for each
packed block of texts that has them, so no pairs of copies are formed and a
passage that many documents share costs each block of texts one entry.

Digests are dealt in ranges; their number grows with the input, so a range
stays as large as it is. Probing uses 48 bits and can only propose anchors;
words go by digests of 128 bits.

Defined cases: null and empty texts and texts of fewer than ``width`` words
lose nothing; repeated rows, whatever their ids, stand more than once; null
ids stay; ties do not occur, for all copies go; an empty table gives no row;
columns other than id and text are ignored. A very long text is a block of its
own, whose words are digested piece by piece; its word digests (16 bytes a
word) are held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chapterflow.llm.common import Scratch, blocks, planes, unpacked, unplaned

#: Bytes that are digested at once, and digests that a range holds on average.
AT_ONCE, IN_RANGE = 1 << 20, 1_000_000
SENT = "range int, block bigint, kind int, n bigint, first binary, second binary, flags binary"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
GRAM, WINDOW = 0, 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _odd(n: int, seed: int) -> np.ndarray:
    """n multipliers."""
    return _mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 40)) * _GOLD) | np.uint64(1)


def words(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number of every word of the joined texts, and two digests of its bytes."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~SPACE[raw]
    begins = np.zeros(len(raw) + 1, bool)
    begins[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    starts = np.flatnonzero(inside & (begins[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (begins[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
    digests = np.zeros((2, len(starts)), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + AT_ONCE)))
        length = ends[lo:hi] - starts[lo:hi]
        first = np.cumsum(length) - length
        offset = np.arange(int(length.sum())) - np.repeat(first, length)
        letters = raw[offset + np.repeat(starts[lo:hi], length)].astype(np.uint64) + np.uint64(1)
        for k in range(2):
            digests[k, lo:hi] = _mixed(np.add.reduceat(letters * _odd(int(length.max()), k + 1)[offset], first) + length.astype(np.uint64) * _GOLD)
        lo = hi
    return doc, digests[0], digests[1]


def rolling(digests: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Digest of the ``width`` words from each place on."""
    n = max(0, len(digests) - width + 1)
    total = np.zeros(n, np.uint64)
    for k, by in enumerate(_odd(width, seed)):
        total += digests[k : k + n] * by
    return _mixed(total)


def _grams(doc: np.ndarray, digests: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the windows of ``size`` words within one text, their 48-bit digests, and whether they are reference blocks."""
    n = max(0, len(doc) - size + 1)
    at = np.flatnonzero(doc[:n] == doc[size - 1 :][:n])
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    return at, rolling(digests, size, 3)[at] >> np.uint64(16), place[at] % size == 0


def _cuts(values: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where sorted digests change range."""
    edges = [(k << bits) // ranges for k in range(1, ranges)]
    return np.concatenate([[0], np.searchsorted(values, np.array(edges, np.uint64)), [len(values)]]).astype(np.int64)


def _differenced(values: np.ndarray) -> bytes:
    return planes(np.diff(values, prepend=np.uint64(0)))


def _summed(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data, np.uint64), dtype=np.uint64)


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in SENT.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _probes(size: int, ranges: int):
    """Function for mapInArrow: the different windows of every block, flagged as reference blocks and as standing twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, sizes, data in unpacked(batches):
            doc, digests, _ = words(data, sizes)
            _, gram, reference = _grams(doc, digests, size)
            code = np.sort((gram << np.uint64(1)) | reference)
            key = code >> np.uint64(1)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(key)) - 1
            key, flags = key[first], (code[last] & np.uint64(1)).astype(bool) if len(key) else np.zeros(0, bool)
            twice, cuts = last > first, _cuts(key, 48, ranges)
            rows = []
            for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if lo < hi:
                    rows.append((k, block, GRAM, hi - lo, _differenced(key[lo:hi]), None, np.packbits(np.concatenate([flags[lo:hi], twice[lo:hi]])).tobytes()))
            yield _sent(rows)

    return run


def _anchors(table: pa.Table) -> pa.Table:
    """Of the windows of a range: for each block those that equal a reference block and stand twice."""
    rows = table.to_pylist()
    keys = [_summed(r["first"]) for r in rows]
    bits = [np.unpackbits(np.frombuffer(r["flags"], np.uint8))[: 2 * r["n"]].reshape(2, -1).astype(bool) for r in rows]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(every[order]) > 0]))
    held = np.diff(np.append(starts, len(every)))
    reference, twice = (np.logical_or.reduceat(np.concatenate([b[k] for b in bits])[order], starts) for k in range(2))
    good = np.zeros(len(every), bool)
    good[order] = np.repeat(reference & (twice | (held > 1)), held)
    out, at = [], 0
    for r, key in zip(rows, keys, strict=True):
        own = key[good[at : at + len(key)]]
        at += len(key)
        if len(own):
            out.append((r["range"], r["block"], GRAM, len(own), _differenced(own), None, None))
    return pa.Table.from_batches([_sent(out)])


class Extended:
    """The windows over the anchors of a block: their places, the different ones in order, and which stand twice in the block."""

    def __init__(self, sizes: np.ndarray, data: bytes, anchors: list[dict], width: int):
        size = (width + 1) // 2
        doc, one, two = words(data, sizes)
        self.doc = doc
        at, gram, reference = _grams(doc, one, size)
        asked = np.sort(np.concatenate([_summed(r["first"]) for r in anchors])) if anchors else np.zeros(0, np.uint64)
        at, gram = at[reference], gram[reference]
        slot = np.minimum(np.searchsorted(asked, gram), max(0, len(asked) - 1))
        at = at[asked[slot] == gram] if len(asked) else at[:0]
        place = (at[:, None] - np.arange(size)[::-1]).ravel()  # to the left: windows that end behind the anchor
        place = place[(place >= 0) & (place + width <= len(doc))]
        self.place = place[doc[place] == doc[place + width - 1]]
        first, second = (rolling(x, width, seed)[self.place] if len(self.place) else np.zeros(0, np.uint64) for x, seed in ((one, 4), (two, 5)))
        order = np.lexsort((second, first))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.first, self.second = first[order][new], second[order][new]
        self.twice = np.bincount(self.number, minlength=len(self.first)) > 1

    def cuts(self, ranges: int) -> np.ndarray:
        return _cuts(self.first, 64, ranges)


def _windows(width: int, ranges: int):
    """Function for a cogroup of blocks and anchors: digests of the different windows over the anchors."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for block, _, sizes, data in unpacked(iter(left.to_batches())) if right.num_rows else ():
            found = Extended(sizes, data, right.to_pylist(), width)
            cuts = found.cuts(ranges)
            for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if lo < hi:
                    rows.append((k, block, WINDOW, hi - lo, _differenced(found.first[lo:hi]), planes(found.second[lo:hi]), None))
        return pa.Table.from_batches([_sent(rows)])

    return run


def _repeats(table: pa.Table) -> pa.Table:
    """Of the windows of a range: for each block which ones another block has too, as bits."""
    rows = table.to_pylist()
    first = np.concatenate([_summed(r["first"]) for r in rows])
    second = np.concatenate([unplaned(r["second"], np.uint64) for r in rows])
    order = np.lexsort((second, first))
    same = (np.diff(first[order]) == 0) & (np.diff(second[order]) == 0)
    shared = np.zeros(len(first), bool)
    shared[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    out, at = [], 0
    for r in rows:
        own = shared[at : at + r["n"]]
        at += r["n"]
        if own.any():
            out.append((r["range"], r["block"], WINDOW, r["n"], None, None, np.packbits(own).tobytes()))
    return pa.Table.from_batches([_sent(out)])


def _kept(width: int, ranges: int):
    """Function for a cogroup of blocks with anchors and repeats: spans of words that go, and the words that stay."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        told, out = right.to_pylist(), []
        for _, ids, sizes, data in unpacked(iter(left.to_batches())):
            gone, bounds = np.zeros(0, bool), np.zeros(len(ids) + 1, np.int64)
            if told:
                found = Extended(sizes, data, [r for r in told if r["kind"] == GRAM], width)
                again, cuts = found.twice.copy(), found.cuts(ranges)
                for r in told:
                    if r["kind"] == WINDOW:
                        again[cuts[r["range"]] : cuts[r["range"] + 1]] |= np.unpackbits(np.frombuffer(r["flags"], np.uint8))[: r["n"]].astype(bool)
                place = found.place[again[found.number]]
                steps = np.zeros(len(found.doc) + 1, np.int32)
                np.add.at(steps, place, 1)
                np.add.at(steps, place + width, -1)
                gone = np.cumsum(steps[:-1]) > 0
                bounds = np.searchsorted(found.doc, np.arange(len(ids) + 1))
            at = 0
            for k, (i, size) in enumerate(zip(ids, sizes.tolist(), strict=True)):
                own, text = gone[bounds[k] : bounds[k + 1]], data[at : at + size].split()
                at += size
                spans = []
                if own.any():
                    edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist()
                    spans = [{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2], strict=True)]
                out.append((i, len(text), spans, b" ".join(compress(text, (~own).tolist()) if spans else text)))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        columns = list(zip(*out, strict=True)) or [()] * 4
        table = pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_words", "spans", "kept"])
        return table.set_column(3, "kept", table.column("kept").cast(pa.string()))

    return run


def deduplicated(docs: DataFrame, scratch: Scratch, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, kept): removed runs of words, as maximal repeats cover them, and the words left, joined by spaces."""
    size = (width + 1) // 2
    packed = scratch.store("blocks", blocks(docs, 4 << 20, id_col, text_col)).select("block", "ids", "sizes", "payload")
    n_bytes = packed.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda n, s: n + s))).first()[0] or 0
    ranges = 1 + n_bytes // (6 * IN_RANGE)
    probes = packed.mapInArrow(_probes(size, ranges), SENT)
    anchors = scratch.store("anchors", probes.groupBy("range").applyInArrow(_anchors, SENT))
    windows = packed.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(_windows(width, ranges), SENT)
    repeats = scratch.store("repeats", windows.groupBy("range").applyInArrow(_repeats, SENT))
    told = anchors.unionByName(repeats)
    return packed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        _kept(width, ranges), "doc_id bigint, n_words bigint, spans array<struct<start: bigint, end: bigint>>, kept string"
    )
