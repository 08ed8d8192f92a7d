"""Jaccard join of word n-gram sets by T-occurrence search.

Sets of equal content are one node. To bring sets that may link together,
each is split by hash ranges into more parts than two linking sets can differ
in, so they agree in some (a part's digest is a key; size classes keep the
number of parts to the sizes that can link). A set of m filled parts that
links with another shares all but the parts they can differ in; sets that
share fewer of their keys with any others are left out. The rest that share
keys of a size class, directly or through others, are a canopy; a canopy's
sets travel once, and large ones are split into blocks that meet pair by pair.

Within a canopy, every set is a query against an inverted index: with T the
overlap that the threshold asks for, the shortest lists are heap-merged for
what T - L of them hold, the longest L are probed by binary search
(DivideSkip), and documents that reach T stay. Only pivots are indexed: a set that links to a pivot joins its ball and
needs no other link to it. As Jaccard distance is a metric, a query farther
than twice the threshold's distance from a pivot links to none of its ball,
and only for the distances between is the ball's own index searched. So no
link between components is lost, and the copies in a ball are not paired.

Shingles and sets are told apart by 64-bit digests.

Defined cases: null and empty texts and texts without words have an empty set
and are linked with nothing; with fewer words than a shingle the whole
sequence is the one shingle; repeated rows are copies of each other; a null id
takes part and a component of null ids alone is null; an empty table gives no
row; columns other than id and text are ignored.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from chapterflow.llm.common import Scratch, lowered, runs, stars, texts
from chapterflow.llm.components import connected

#: Shingles of the sets in one block of a canopy.
BLOCK_SHINGLES = 500_000
#: Weight of the list length in the split into short and long lists; small: long lists are cheap to probe, as probes end early.
MERGE_SHARE = 0.001
#: Parts beyond half as many again as two linking sets can differ in.
SPARE = 3
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def shingles(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit digests of the word n-grams of a UTF-8 text."""
    words = lowered(data).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, min(width, len(words)), np.uint64)
    for k in range(min(width, len(words))):
        out = _mixed(out * _B + h[k : k + n])
    return np.unique(out)


class Threshold:
    """Jaccard similarity of at least num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def links(self, overlap: int, s: int, t: int) -> bool:
        return overlap * (self.num + self.den) >= self.num * (s + t)

    def least(self, s: int) -> int:
        """Smallest size that links with size s."""
        return -(-self.num * s // self.den)

    def overlap(self, s: int, low: int = 0) -> int:
        """Least overlap of a set of size s with any of size low or more that links."""
        return -(-self.num * (s + max(low, self.least(s))) // (self.num + self.den))

    def wider(self) -> Threshold:
        """Similarity of two sets that both link to a third."""
        return Threshold(max(1, 2 * self.num - self.den), self.den)


@lru_cache(maxsize=100_000)
def size_class(n: int) -> tuple[int, int]:
    """Number and largest size of the class of size n; classes are a quarter wide."""
    k, low = 0, 1
    while True:
        high = max(low, math.ceil(1.25 * low) - 1)
        if n <= high:
            return k, high
        k, low = k + 1, high + 1


@lru_cache(maxsize=10_000)
def cuts(parts: int) -> np.ndarray:
    """First digests of all hash ranges but the first."""
    return np.array([(k << 64) // parts + (1 if (k << 64) % parts else 0) for k in range(1, parts)], np.uint64)


def keys(found: np.ndarray, limit: Threshold) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Digests of the parts of a set, in every size class of a smaller set that it can link with.

    Also each class: its number, its digests, and how many of them at least
    any set that links in it shares. Empty parts count only where two linking
    sets could agree in nothing else.
    """
    n = len(found)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(found))])
    out, classes = [], []
    size = limit.least(n)
    while size <= n:
        number, high = size_class(size)
        differ = (limit.den - limit.num) * (high + high * limit.den // limit.num) // (limit.den + limit.num)
        parts = differ + differ // 2 + SPARE if differ else 1
        at = np.concatenate([[0], np.searchsorted(found, cuts(parts)), [n]])
        part = total[at[1:]] - total[at[:-1]]
        filled = at[1:] != at[:-1]
        least = int(filled.sum()) - differ
        digests = _mixed(part + _mixed(np.arange(parts, dtype=np.uint64) + (np.uint64(number) << np.uint64(40))))
        out.append(digests[filled] if least > 0 else digests)
        classes.append((number, len(out[-1]), max(1, least)))
        size = high + 1
    return np.concatenate(out).view(np.int64), classes


def node_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def _lists(lists: list, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    flat = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat).cast(kind))


def _sets(width: int, limit: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, nodes, parts, members, counts, needs = [], [], [], [], [], []
            for t in b.column("text"):
                found = shingles(t.as_buffer().to_pybytes(), width)
                n.append(len(found))
                nodes.append(node_of(found) if len(found) else None)
                digests, classes = keys(found, limit) if len(found) else (np.zeros(0, np.int64), [])
                number, count, need = np.array(classes, np.int64).reshape(-1, 3).T
                parts.append(digests)
                members.append(_mixed(np.array([nodes[-1] or 0], np.int64).view(np.uint64) ^ _mixed(number.view(np.uint64) + np.uint64(1))).view(np.int64) if len(found) else number)
                counts.append(count)
                needs.append(need)
            columns = {"keys": _lists(parts, pa.int64()), "members": _lists(members, pa.int64()), "counts": _lists(counts, pa.int32()), "needs": _lists(needs, pa.int32())}
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_shingles": pa.array(n, pa.int64()), "node": pa.array(nodes, pa.int64()), **columns})

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, member) of every part of every set."""
    for b in batches:
        members, counts = (b.column(c).flatten().to_numpy() for c in ("members", "counts"))
        yield pa.record_batch({"key": b.column("keys").flatten(), "member": pa.array(np.repeat(members, counts), pa.int64())})


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose key other rows have too; rows come sorted by key, and one is kept between batches."""
    k0, m0, joined = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for b in batches:
        if not b.num_rows:
            continue
        k, m = np.concatenate([k0, b.column("key").to_numpy()]), np.concatenate([m0, b.column("member").to_numpy()])
        same = k[1:] == k[:-1]
        before = np.concatenate([[joined], same])
        met = (before[:-1] | same) if len(same) else np.zeros(0, bool)
        yield pa.record_batch({"key": pa.array(k[:-1][met]), "member": pa.array(m[:-1][met])})
        k0, m0, joined = k[-1:], m[-1:], bool(before[-1])
    if joined:
        yield pa.record_batch({"key": pa.array(k0), "member": pa.array(m0)})


def merged(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(number, lists that hold it) of the numbers in ``least`` lists or more.

    A heap holds the next number of every list. Where fewer than ``least``
    lists begin with the smallest one, the next smallest are taken off as well
    and all of them jump by binary search to the first number that can still
    be in enough lists.
    """
    at = [0] * len(lists)
    heap = [(x[0], k) for k, x in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= least:
        number, taken = heap[0][0], []
        while heap and heap[0][0] == number:
            taken.append(heapq.heappop(heap)[1])
        if len(taken) >= least:
            yield number, len(taken)
            number += 1
        else:
            while len(taken) < least - 1 and heap:
                taken.append(heapq.heappop(heap)[1])
            if not heap:
                return
            number = heap[0][0]
        for k in taken:
            x = lists[k]
            i = at[k] = bisect_left(x, number, at[k])
            if i < len(x):
                heapq.heappush(heap, (x[i], k))


class Index:
    """Inverted lists of set numbers, in the order in which sets are added."""

    def __init__(self) -> None:
        self.lists: dict[int, list[int]] = {}
        self.members: list[int] = []
        self.low = 1 << 62

    def add(self, member: int, tokens: list[int], size: int = 0) -> None:
        """``size`` is the set's size or less: the overlap that is asked for follows from the least of them."""
        self.low = min(self.low, size)
        for t in tokens:
            self.lists.setdefault(t, []).append(len(self.members))
        self.members.append(member)

    def search(self, tokens: list[int], size: int, limit: Threshold, sizes: list[int]) -> Iterator[tuple[int, int]]:
        """(member, overlap) of every indexed set within the limit of the query, by DivideSkip."""
        found = sorted((self.lists[t] for t in tokens if t in self.lists), key=len)
        least = limit.overlap(size, self.low)
        if len(found) < least:
            return
        n_long = min(least - 1, int(least / (MERGE_SHARE * math.log2(len(found[-1]) + 1) + 1)))
        short, long = found[: len(found) - n_long], found[len(found) - n_long :]
        for number, overlap in merged(short, least - n_long):
            t = sizes[self.members[number]]
            needed = -(-limit.num * (size + t) // (limit.num + limit.den))
            if t < limit.least(size) or size < limit.least(t) or overlap < needed - n_long:
                continue
            left = n_long
            for x in long:
                if overlap + left < needed:
                    break
                at = bisect_left(x, number)
                overlap += at < len(x) and x[at] == number
                left -= 1
            if limit.links(overlap, size, t):
                yield self.members[number], overlap


def linked(sets: list[np.ndarray], limit: Threshold) -> list[tuple[int, int]]:
    """Links that connect whatever the links between the sets connect.

    Pivots are searched at the limit itself, and only those with a ball
    (centres) at the wider limit of what their ball may link with. Larger
    sets come first, so a query's overlap with an indexed set is at least
    that of two sets of its own size.
    """
    sizes, wide = [len(s) for s in sets], limit.wider()
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = n[at] > 1  # the others are in no other set
    ends = np.cumsum(sizes)
    tokens = [at[e - s : e][often[e - s : e]].tolist() for s, e in zip(sizes, ends.tolist(), strict=True)]
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    pivots, centres, balls, out = Index(), Index(), {}, []
    for q in sorted(range(len(sets)), key=lambda k: -sizes[k]):
        words, size, home = tokens[q], sizes[q], None
        for p, _ in pivots.search(words, size, limit, sizes):
            home = p if home is None else home
            if root(p) != root(q):
                parent[root(q)] = root(p)
                out.append((q, p))
        for p, _ in centres.search(words, size, wide, sizes):
            if root(p) != root(q):
                for m, _ in balls[p].search(words, size, limit, sizes):
                    parent[root(q)] = root(m)
                    out.append((q, m))
                    break
        if home is None:
            pivots.add(q, words, size)
        else:
            if home not in balls:
                balls[home] = Index()
                centres.add(home, tokens[home], sizes[home])
            balls[home].add(q, words, size)
    return out


def _links(limit: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["canopy", "i", "j"]):
            rows = dict(zip(group.column("node").to_pylist(), (s.values.to_numpy().view(np.uint64) for s in group.column("shingles")), strict=True))
            nodes = sorted(rows)
            edges = linked([rows[n] for n in nodes], limit)
            yield pa.record_batch({"a": pa.array([nodes[a] for a, _ in edges], pa.int64()), "b": pa.array([nodes[b] for _, b in edges], pa.int64())})

    return run


def _wanted_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_buffer().to_pybytes(), width) for t in b.column("text")]
            same = [len(s) > 0 and node_of(s) == n for s, n in zip(found, b.column("node").to_pylist(), strict=True)]
            lists = pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))
            yield pa.record_batch({**{c: b.column(c) for c in ("canopy", "i", "j", "node")}, "shingles": lists}).filter(pa.array(same, pa.bool_()))

    return run


def groups(docs: DataFrame, scratch: Scratch, width: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, node, component_id) of every row.

    Sets link at a Jaccard similarity of num / den (over 1/2) or more;
    component_id is the smallest id of the rows that links reach; rows with
    equal sets have the same node.
    """
    limit, plain = Threshold(num, den), texts(docs, id_col, text_col)
    found = plain.mapInArrow(_sets(width, limit), "doc_id bigint, n_shingles bigint, node bigint, keys array<bigint>, members array<bigint>, counts array<int>, needs array<int>")
    keyed = scratch.store("keyed", found)
    sets = scratch.store("sets", keyed.select("doc_id", "n_shingles", "node"))
    nodes = sets.where("node IS NOT NULL").groupBy("node").agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("doc_id"))
    parts = keyed.where("node IS NOT NULL").groupBy("node").agg(F.first(F.struct("keys", "members", "counts")).alias("x")).select("x.*")
    parts = parts.mapInArrow(_keyed, "key bigint, member bigint")
    met = scratch.store("met", parts.repartition("key").sortWithinPartitions("key").mapInArrow(_met, "key bigint, member bigint"))
    classes = keyed.select("node", F.explode(F.arrays_zip("members", "needs")).alias("x")).select("node", F.col("x.members").alias("member"), F.col("x.needs").alias("need"))
    classes = classes.join(met.groupBy("member").agg(F.count("*").alias("shared")), "member").where("shared >= need")
    near = scratch.store("near", classes.select("node", "member").distinct())
    scratch.drop("keyed")
    shared = met.join(near, "member").select("key", "member").repartition("key").sortWithinPartitions("key", "member").mapInArrow(lambda b: stars(b, "key", "member"), "a bigint, b bigint")
    canopies = connected(shared, scratch, "shared").withColumnsRenamed({"node": "member", "component": "canopy"})
    canopies = scratch.store("canopies", canopies.join(near, "member").select("node", "canopy"))
    scratch.keep("sets", "canopies")
    # blocks of a canopy: as many as its shingles ask for, all pairs of them
    members = canopies.join(nodes.select("node", "n", "doc_id"), "node")
    blocks = members.groupBy("canopy").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"))
    placed = members.join(blocks, "canopy").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.expr("CASE WHEN blocks = 1 THEN array(0L) ELSE filter(sequence(0L, blocks - 1), x -> x <> own) END")))
    placed = placed.select("canopy", "node", "doc_id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    meet = plain.join(placed, plain["doc_id"].eqNullSafe(placed["doc_id"])).drop("doc_id")
    loaded = meet.mapInArrow(_wanted_sets(width), "canopy bigint, i bigint, j bigint, node bigint, shingles array<bigint>")
    tasks = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    links = loaded.repartition(tasks, "canopy", "i", "j").sortWithinPartitions("canopy", "i", "j").mapInArrow(_links(limit), "a bigint, b bigint")
    components = connected(links, scratch, "links")
    labelled = sets.drop("keys").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = labelled.where("node IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(names, "component", "left").select(
        "doc_id", "n_shingles", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def _with_node(width: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in b.column(text_col)]
            yield b.append_column("_node", pa.array([node_of(s) if len(s) else None for s in found], pa.int64()))

    return run


def firsts(docs: DataFrame, scratch: Scratch, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, in all their columns, without those whose component has another one to stay.

    The row of a component's smallest id stays; of rows with that same id,
    all in its component stay. Rows of one id in other components are judged
    by those. Null ids stay.
    """
    found = groups(docs, scratch, width, num, den, id_col, text_col)
    found = scratch.store("found", found.select(F.col("doc_id").alias("_gone"), "node", (F.col("doc_id") != F.col("component_id")).alias("goes")).where("_gone IS NOT NULL").distinct())
    gone = found.where("goes")
    scratch.keep("found")
    # ids of which some rows go and some stay: told apart by their sets
    mixed = scratch.store("mixed", gone.join(found.where("NOT goes").select("_gone").distinct(), "_gone", "left_semi").select("_gone", "node"))
    some = docs.join(mixed.select("_gone").distinct(), docs[id_col] == F.col("_gone"), "left_semi")
    some = some.mapInArrow(_with_node(width, text_col), StructType([*docs.schema.fields, StructField("_node", LongType())]))
    some = some.join(mixed, (some[id_col] == mixed["_gone"]) & (some["_node"] == mixed["node"]), "left_anti").drop("_node")
    ids = gone.select("_gone").distinct()
    return docs.join(ids, docs[id_col] == ids["_gone"], "left_anti").unionByName(some)
