"""Language-model scores by context-tree weighting over bytes.

A text is the sequence of its lower-cased words, each followed by a space, the
last by a line feed, which is the end. Every byte is eight binary decisions,
from the highest bit on; each decision has a tree of contexts, the preceding
0 to ``depth`` bytes (zeros before the start). A node keeps how often either
bit followed its context in the training texts; its Krichevsky-Trofimov
estimate and the product of its children's weighted probabilities are mixed
half and half, which gives the posterior weight of every depth. A prediction
mixes the estimates along the context's path by these weights, down to the
deepest context that was seen in training.

Corpus-wide counts are joined block by block: every block sends the byte
strings and words it holds as packed arrays, by range of the subtree or word.
In a range the counts of all training texts are summed and the deep levels of
the trees are built subtree by subtree; the levels above are joined. Each
block gets back an array of values, in the order in which it asked. Ranges
grow in number with the input, not in size, and nothing is broadcast.

Defined cases: a null text is empty (its end alone); a null id counts as
training; repeated rows each count and each get a row; an empty table gives no
row; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chapterflow.llm.common import Scratch, blocks, lowered, planes, unpacked, unplaned

DEPTH, TOP = 5, 3
#: Strings of whole subtrees that a task works on at once.
ROWS = 200_000
#: Bytes of text of a block, and for every range of strings and words.
BLOCK_BYTES, RANGE_BYTES = 5 << 20, 16 << 20
END = b"\n"


def is_held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def token_lists(sizes: np.ndarray, data: bytes) -> Iterator[list[bytes]]:
    """The tokens of each text of a block."""
    data, at = lowered(data), 0
    for n in sizes.tolist():
        yield [*data[at : at + n].split(), END]
        at += n


def byte_strings(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and next byte of every position of all texts, as integers, and the length of each text."""
    pad = bytes(depth)
    a = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    valid = np.ones(len(a), bool)
    starts = np.concatenate([[0], np.cumsum(lengths + depth)[:-1]])
    for k in range(depth):
        valid[starts + k] = False
    code = np.zeros(len(a) - depth, np.int64)
    for k in range(depth + 1):
        code <<= 8
        code |= a[k : len(a) - depth + k]
    return code[valid[depth:]], lengths


def spelled(tokens: list[bytes]) -> bytes:
    """The scored bytes of a text: words with a space between them, then the end."""
    return b" ".join(tokens[:-1]) + END


def _range(latest: np.ndarray | Column, ranges: int):
    """The range of the latest ``TOP`` bytes of a context, of an array or a column."""
    spread = latest * 2_654_435_761
    if isinstance(spread, Column):
        return F.shiftright(spread, 16).bitwiseAND(0xFFFFFFFF) % ranges
    return ((spread >> 16) & 0xFFFFFFFF) % ranges


def _distinct(code: np.ndarray, depth: int, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The place of every string among the different ones, those in order of context, latest byte first, and byte, their order by range, and where the ranges begin."""
    which, found = pd.factorize(code)
    which = which.astype(np.int32) if len(which) < 1 << 31 else which
    ordered = (_turned(found >> 8, depth) << 8) | (found & 255)
    span = _range((found >> 8) & ((1 << (8 * min(TOP, depth))) - 1), ranges)
    order = np.lexsort((ordered, span))
    return which, ordered, order, np.searchsorted(span[order], np.arange(ranges + 1)).tolist()


def _by_range(words: list[bytes], ranges: int) -> tuple[np.ndarray, list[int]]:
    """The order of words by range, and where the ranges begin."""
    span = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % ranges
    order = np.argsort(span, kind="stable")
    return order, np.searchsorted(span[order], np.arange(ranges + 1)).tolist()


def _sent(block: int, names: list[str], cuts: list[int], *packers) -> pa.RecordBatch:
    """A row for every range that has something of the block."""
    spans = [k for k in range(len(cuts) - 1) if cuts[k] < cuts[k + 1]]
    columns = [pa.array([pack(cuts[k], cuts[k + 1]) for k in spans], pa.binary()) for pack in packers]
    return pa.record_batch([pa.array(spans, pa.int64()), pa.array([block] * len(spans), pa.int64()), *columns], names=["range", "block", *names])


def _strings(folds: int, fold: int, depth: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, sizes, data in unpacked(batches):
            code, lengths = byte_strings([spelled(t) for t in token_lists(sizes, data)], depth)
            train = np.repeat([not is_held_out(i, folds, fold) for i in ids], lengths)
            which, ordered, order, cuts = _distinct(code, depth, ranges)
            del code, data
            ordered, n = ordered[order], np.bincount(which, weights=train, minlength=len(ordered)).astype(np.uint64)[order]
            yield _sent(block, ["strings", "n"], cuts, lambda lo, hi, x=ordered: planes(np.diff(x[lo:hi], prepend=0)), lambda lo, hi, x=n: planes(x[lo:hi]))

    return run


def _words(folds: int, fold: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for block, ids, sizes, data in unpacked(batches):
            n: dict[bytes, int] = {}
            for i, tokens in zip(ids, token_lists(sizes, data), strict=True):
                if is_held_out(i, folds, fold):
                    for w in tokens:
                        n.setdefault(w, 0)
                else:
                    for w in tokens:
                        n[w] = n.get(w, 0) + 1
            found = list(n)
            order, cuts = _by_range(found, ranges)
            counts, found = np.fromiter(n.values(), np.uint64, len(n))[order], [found[k] for k in order.tolist()]
            yield _sent(block, ["words", "n"], cuts, lambda lo, hi, x=found: squeeze.compress(b" ".join(x[lo:hi])), lambda lo, hi, x=counts: planes(x[lo:hi]))

    return run


def _counted(table: pa.Table) -> pa.Table:
    """Counts of the words of a range for each block, in its order; the first row has the range's sum and number of words of training texts."""
    rows = table.to_pylist()
    words = [zstandard.ZstdDecompressor().decompressobj().decompress(r["words"]).split(b" ") for r in rows]
    total: dict[bytes, int] = {}
    for own, r in zip(words, rows, strict=True):
        for w, n in zip(own, unplaned(r["n"], np.uint64).tolist(), strict=True):
            total[w] = total.get(w, 0) + n
    values = [planes(np.fromiter(map(total.__getitem__, own), np.float64, len(own))) for own in words]
    sums = [[x] + [0] * (len(rows) - 1) for x in (sum(total.values()), sum(n > 0 for n in total.values()))]
    return pa.table([table.column("range"), table.column("block"), pa.array(values, pa.binary()), *(pa.array(x, pa.int64()) for x in sums)], names=["range", "block", "data", "total", "different"])


def _log_gamma(x, log=F.log):
    """ln of the gamma function for x > 0, of a column or (with numpy's log) an array: Stirling's series at x + 8."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + series - log(product)


def _log_pe(zeros, ones, log=F.log):
    """ln of the Krichevsky-Trofimov estimate of so many zeros and ones."""
    return _log_gamma(zeros + 0.5, log) + _log_gamma(ones + 0.5, log) - _log_gamma(zeros + ones + 1, log) - math.log(math.pi)


def _estimated(level: DataFrame) -> DataFrame:
    """Adds the weighted log probability, and the weight ``own`` of the node's estimate."""
    zeros, ones = F.col("n0").cast("double"), F.col("n1").cast("double")
    out = level.withColumn("log_pe", _log_pe(zeros, ones))
    mixed = F.greatest("log_pe", "below") + F.log1p(F.exp(-F.abs(F.col("log_pe") - F.col("below")))) - math.log(2)
    return out.withColumn("log_pw", mixed).withColumn("own", F.exp(F.col("log_pe") - math.log(2) - F.col("log_pw")))


def _sums(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(groups, weights=values, minlength=n)


class Subtrees:
    """The nodes of one decision at depths ``top`` to ``depth``, for whole subtrees of contexts.

    ``string`` and ``n`` come in order of context, latest byte first, and byte.
    Levels run from the deepest up; ``parent`` tells the place of each node's
    parent in the next level.
    """

    def __init__(self, ordered: np.ndarray, byte: np.ndarray, n: np.ndarray, k: int, depth: int, top: int):
        self.bit = (byte >> (7 - k)) & 1
        node = (1 << k) | (byte >> (8 - k))
        new = np.concatenate([[True], np.diff(ordered >> (8 - k)) != 0])
        self.leaf = np.cumsum(new) - 1
        context, node = (ordered >> 8)[new], node[new]
        size = len(node)
        self.n0, self.n1 = [_sums(n * (1 - self.bit), self.leaf, size)], [_sums(n * self.bit, self.leaf, size)]
        self.log_pe = [_log_pe(self.n0[0], self.n1[0], np.log)]
        self.log_pw, self.own, self.parent = [self.log_pe[0]], [np.ones(size)], []
        for _ in range(depth - top):
            context = context >> 8
            key, up = np.unique((context << 8) | node, return_inverse=True)
            context, node = key >> 8, key & 255
            n0, n1, below = (_sums(x[-1], up, len(key)) for x in (self.n0, self.n1, self.log_pw))
            log_pe = _log_pe(n0, n1, np.log)
            log_pw = np.logaddexp(log_pe, below) - math.log(2)
            self.parent.append(up)
            for held, x in zip((self.n0, self.n1, self.log_pe, self.log_pw, self.own), (n0, n1, log_pe, log_pw, np.exp(log_pe - math.log(2) - log_pw)), strict=True):
                held.append(x)
        self.context, self.node = context, node  # of the top level

    def kt(self, level: int) -> np.ndarray:
        return (self.n1[level] + 0.5) / (self.n0[level] + self.n1[level] + 1)

    def predicted(self, done: np.ndarray, rest: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Probability of each string's bit, from the state of the path at the top level."""
        for level in range(len(self.parent) - 1, -1, -1):
            up, kt, own = self.parent[level], self.kt(level), self.own[level]
            done, rest, last = done[up], rest[up], last[up]
            last = np.where(self.n0[level] + self.n1[level] > 0, done + rest * kt, last)
            done, rest = done + rest * own * kt, rest * (1 - own)
        return np.where(self.bit == 1, last[self.leaf], 1 - last[self.leaf])


def _turned(context: np.ndarray, depth: int) -> np.ndarray:
    """The bytes of each context in reverse."""
    out = np.zeros_like(context)
    for k in range(depth):
        out = (out << 8) | ((context >> (8 * k)) & 255)
    return out


def _totals(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The different strings of a range in order, their counts in training texts, and where the strings of each row are."""
    rows = [np.cumsum(unplaned(x, np.int64)) for x in table.column("strings").to_pylist()]
    n = np.concatenate([unplaned(x, np.uint64) for x in table.column("n").to_pylist()])
    found, which = np.unique(np.concatenate(rows), return_inverse=True)
    return found, np.bincount(which, weights=n, minlength=len(found)), np.split(which, np.cumsum([len(x) for x in rows])[:-1])


def _whole_subtrees(ordered: np.ndarray, depth: int, top: int) -> Iterator[slice]:
    """Parts of at least ``ROWS`` strings (but the last) that hold whole subtrees."""
    ends = np.append(np.flatnonzero(np.diff(ordered >> (8 * (depth - top + 1)))) + 1, len(ordered))
    at = 0
    while at < len(ordered):
        to = int(ends[min(np.searchsorted(ends, at + ROWS), len(ends) - 1)])
        yield slice(at, to)
        at = to


def _tops(depth: int, top: int):
    def run(table: pa.Table) -> pa.Table:
        found, n, _ = _totals(table)
        out = []
        for part in _whole_subtrees(found, depth, top):
            for k in range(8):
                t = Subtrees(found[part], found[part] & 255, n[part], k, depth, top)
                columns = {"n0": t.n0[-1], "n1": t.n1[-1], "log_pw": t.log_pw[-1], "own": t.own[-1]}
                out.append(pa.table({"context": pa.array(_turned(t.context, top)), "node": pa.array(t.node, pa.int32()), **{c: pa.array(x, pa.float64()) for c, x in columns.items()}}))
        return pa.concat_tables(out)

    return run


def _predicted(depth: int, top: int):
    def run(key: tuple, table: pa.Table, paths: pa.Table) -> pa.Table:
        found, n, rows = _totals(table)
        path = (paths.column("top").to_numpy() << 8) | paths.column("node").to_numpy()
        by_path = np.argsort(path)
        path = path[by_path]
        state = [paths.column(c).to_numpy()[by_path] for c in ("done", "rest", "last")]
        log10_p = np.zeros(len(found))
        for part in _whole_subtrees(found, depth, top):
            for k in range(8):
                t = Subtrees(found[part], found[part] & 255, n[part], k, depth, top)
                at = np.searchsorted(path, (_turned(t.context, top) << 8) | t.node)
                # the path at the top level has taken that level in already
                log10_p[part] += np.log10(t.predicted(*(x[at] for x in state)))
        return pa.table({"range": table.column("range"), "block": table.column("block"), "data": pa.array([planes(log10_p[x]) for x in rows], pa.binary())})

    return run


def tree_predictions(strings: DataFrame, scratch: Scratch, depth: int, ranges: int) -> DataFrame:
    """(range, block, data): log probability of the last byte of each string after the bytes before it, for every row of strings.

    Contexts that agree in their latest ``TOP`` bytes make a subtree, which one
    task holds (at most 256 ** (depth - TOP + 1) strings, many subtrees a
    task); the levels above are joined.
    """
    top = min(TOP, depth)
    tops = strings.groupBy("range").applyInArrow(_tops(depth, top), "context bigint, node int, n0 double, n1 double, log_pw double, own double")
    levels = {top: scratch.store(f"level{top}", tops)}
    for d in range(top - 1, -1, -1):
        up = levels[d + 1].groupBy(F.col("context").bitwiseAND((1 << (8 * d)) - 1).alias("context"), "node")
        level = up.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_pw").alias("below"))
        levels[d] = scratch.store(f"level{d}", _estimated(level))
    seen, kt = (F.col("n0") + F.col("n1")) > 0, (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    # done: mixed so far; rest: weight left; last: the prediction if no deeper context was seen
    path = levels[0].select("context", "node", (F.col("own") * kt).alias("done"), (1 - F.col("own")).alias("rest"), F.when(seen, kt).otherwise(0.5).alias("last"))
    for d in range(1, top + 1):
        child = levels[d].withColumn("parent", F.col("context").bitwiseAND((1 << (8 * (d - 1))) - 1))
        both = child.join(path.withColumnRenamed("context", "parent"), ["parent", "node"])
        path = both.select(
            "context",
            "node",
            (F.col("done") + F.col("rest") * F.col("own") * kt).alias("done"),
            (F.col("rest") * (1 - F.col("own"))).alias("rest"),
            F.when(seen, F.col("done") + F.col("rest") * kt).otherwise(F.col("last")).alias("last"),
        )
    state = path.select(_range(F.col("context"), ranges).alias("range"), F.col("context").alias("top"), F.col("node").cast("bigint").alias("node"), "done", "rest", "last")
    return strings.groupBy("range").cogroup(state.groupBy("range")).applyInArrow(_predicted(depth, top), "range bigint, block bigint, data binary")


def _values(table: pa.Table, of_words: bool) -> np.ndarray:
    """What the ranges sent back to a block, in order of range."""
    rows = sorted((r["range"], r["data"]) for r in table.to_pylist() if r["of_words"] == of_words)
    return np.concatenate([unplaned(data, np.float64) for _, data in rows])


def _scored(folds: int, fold: int, depth: int, ranges: int, log_all: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for _, ids, sizes, data in unpacked(iter(left.to_batches())):
            tokens = list(token_lists(sizes, data))
            words = list(dict.fromkeys(w for t in tokens for w in t))
            order, _ = _by_range(words, ranges)
            count = np.empty(len(words))
            count[order] = _values(right, True)
            base = {w: math.log10(c + 1) - log_all for w, c in zip(words, count.tolist(), strict=True)}
            unseen = {words[k] for k in np.flatnonzero(count == 0).tolist()}
            code, lengths = byte_strings([spelled(t) for t in tokens], depth)
            which, _, order, _ = _distinct(code, depth, ranges)
            del code, data
            log10_p = np.empty(len(order))
            log10_p[order] = _values(right, False)
            score = np.add.reduceat(log10_p[which], np.concatenate([[0], np.cumsum(lengths)[:-1]]))
            for i, t, s, n in zip(ids, tokens, score.tolist(), lengths.tolist(), strict=True):
                out.append((i, is_held_out(i, folds, fold), len(t), len(t) - sum(map(unseen.__contains__, t)), math.fsum(map(base.__getitem__, t)), s, n))
        columns = list(zip(*out, strict=True))
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_scored_bytes"]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def scores(docs: DataFrame, scratch: Scratch, folds: int = 7, fold: int = 2, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_scored_bytes, bits_per_byte).

    Texts whose crc32(id as text) modulo ``folds`` is ``fold`` are held out
    from training; ``depth`` is at most 6. base_score: add-one unigram model of the tokens; score: the
    weighted context trees; both log10 of the probability of the text.
    """
    packed = scratch.store("blocks", blocks(docs, BLOCK_BYTES, id_col=id_col, text_col=text_col)).select("block", "ids", "sizes", "payload")
    size = packed.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda n, x: n + x))).first()[0]
    ranges = 1 + (size or 0) // RANGE_BYTES
    words = packed.mapInArrow(_words(folds, fold, ranges), "range bigint, block bigint, words binary, n binary")
    counts = scratch.store("counts", words.groupBy("range").applyInArrow(_counted, "range bigint, block bigint, data binary, total bigint, different bigint"))
    total, distinct = counts.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("different"), F.lit(0))).first()
    strings = scratch.store("strings", packed.mapInArrow(_strings(folds, fold, depth, ranges), "range bigint, block bigint, strings binary, n binary"))
    model = scratch.store("model", tree_predictions(strings, scratch, depth, ranges))
    scratch.drop("strings", *(f"level{d}" for d in range(min(TOP, depth) + 1)))
    asked = model.withColumn("of_words", F.lit(False)).unionByName(counts.select("range", "block", "data", F.lit(True).alias("of_words")))
    # a named count, which adaptive execution does not merge: the blocks are small and the work on each is not
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = packed.repartition(tasks, "block").groupBy("block").cogroup(asked.repartition(tasks, "block").groupBy("block")).applyInArrow(
        _scored(folds, fold, depth, ranges, math.log10(total + distinct + 1)),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, n_scored_bytes bigint",
    )
    return found.withColumn("train_tokens", F.lit(total).cast("bigint")).withColumn("bits_per_byte", -F.col("score") / math.log10(2) / F.col("n_scored_bytes"))
