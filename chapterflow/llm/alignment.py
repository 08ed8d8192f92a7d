"""Alignment of a byte-level and a piece tokenizer on the same texts.

Both tokenizers cut the bytes of a text, with one space before it, into
tokens. Places where a token of each ends cut both id lists into groups: the
ends of either list are kept as a dictionary from end to index, the keys that
both dictionaries hold are sorted, and each slice between two of them is a
group. Inside a group every pair of tokens whose bytes overlap is a link.

A space after a character that is no white space is an end in both: the
byte-level tokenizer splits there before it looks at bytes, and no piece goes
on after a space. So texts are cut into fragments there, a fragment is
aligned once a task and remembered, and a text is the sequence of its
fragments.

How many documents hold an id pair linked is counted over the whole corpus:
blocks of documents count their own pairs, the counts of equal pairs are
added, compared with the highest of their first id, and sent back to the
blocks that hold the pair. Tokens and texts do not travel.

Defined cases: a null text is empty; empty texts and texts that either
tokenizer does not give back byte by byte have no tokens, zeros and an empty
digest column; repeated rows and null ids count as documents of their own;
ties for the highest count are all best; an empty table gives no row; other
columns are ignored. A very long text is one block, so a task holds its ids
and links; a fragment without any space is aligned as a whole.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, compress, count, product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chapterflow.llm.bpe import ASCII_SPACE, OTHER_SPACE, cutter, token_bytes
from chapterflow.llm.common import Scratch, planes, texts, unplaned

#: Fragments that a process remembers between blocks, fragments that are encoded in one string, and bytes of texts
#: whose new fragments are learnt together.
REMEMBERED, TOGETHER, LEARNT_BYTES = 450_000, 500, 1 << 20
TOTALS = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = "block bigint, ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, sizes array<bigint>, pairs binary, used binary"
COUNTED = "block bigint, a int, b int, n bigint"
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


@lru_cache(maxsize=2)
def byte_level(path: str):
    """The byte-level tokenizer, for which strings of special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    found.encode_special_tokens = True
    return found


@lru_cache(maxsize=2)
def pieces(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def piece_bytes(path: str) -> list[bytes]:
    """The bytes of every piece: a space for U+2581, the byte itself for a byte piece."""
    model = pieces(path)
    named = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)]


def groups(ends_a: list[int], ends_b: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """First and end index of each group in both lists: the lists cut at their common ends."""
    index_a, index_b = dict(zip(ends_a, count(1))), dict(zip(ends_b, count(1)))
    a = b = 0
    for end in sorted(index_a.keys() & index_b.keys()):
        to_a, to_b = index_a[end], index_b[end]
        yield a, to_a, b, to_b
        a, b = to_a, to_b


def links(ends_a: list[int], ends_b: list[int], a: int, to_a: int, b: int, to_b: int) -> Iterator[tuple[int, int]]:
    """Index pairs of a group whose byte ranges overlap."""
    if to_a == a + 1 or to_b == b + 1:  # one token spans the group
        yield from product(range(a, to_a), range(b, to_b))
        return
    while a < to_a and b < to_b:
        yield a, b
        ahead = ends_a[a] - ends_b[b]
        a, b = a + (ahead <= 0), b + (ahead >= 0)


class Aligner:
    """Aligned fragments, numbered; a process keeps the frequent ones between blocks of texts.

    A fragment is named without the space that it begins with. ``counts``: for
    each fragment the ids of both, groups and links, the first -1 where a
    tokenizer does not give it back. ``shown``: its groups as text.
    ``linked``: the links of all fragments as a << 32 | b. ``hits``: how often
    it was met.
    """

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b, self.cut = byte_level(path_a), pieces(path_b), cutter(path_a)
        known, self.bytes_b = token_bytes(path_a), piece_bytes(path_b)
        if any(" " in p.decode("utf-8", "replace").lstrip(" ") for p in self.bytes_b):
            raise ValueError(f"{path_b}: a piece goes on after a space, so a space ends no token")
        self.bytes_a = [known.get(i, b"") for i in range(max(known) + 1)]
        self.size_a, self.size_b = [*map(len, self.bytes_a)], [*map(len, self.bytes_b)]
        self.names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.odd = [bytes([b, 0x20]) for b in ASCII_SPACE], [c.encode() + b" " for c in OTHER_SPACE]
        self.number: dict[bytes, int] = {}
        self.counts, self.linked, self.shown, self.hits = array("q"), array("q"), [], np.zeros(0, np.int64)

    def fragments(self, data: bytes) -> list[bytes]:
        """A space and a text cut before spaces that end a token of both, each fragment without its space."""
        always, beyond_ascii = self.odd
        if not data.startswith(b" ") and not any(x in data for x in always) and (data.isascii() or not any(x in data for x in beyond_ascii)):
            return data.split(b" ")
        out: list[bytes] = []
        for f in self.cut(b" " + data):
            if out and not f.startswith(b" "):
                out[-1] += f
            else:
                out.append(f[1:])
        return out

    def byte_ids(self, fragments: list[bytes]) -> list[list[int]]:
        """Byte-level ids of each fragment; those that do not end in white space are encoded many in one string."""
        out: list[list[int]] = [[]] * len(fragments)
        texts = [" " + f.decode() for f in fragments]
        joined = [k for k, t in enumerate(texts) if not t[-1].isspace()]
        alone = [k for k, t in enumerate(texts) if t[-1].isspace()]
        for part in (joined[k : k + TOGETHER] for k in range(0, len(joined), TOGETHER)):
            ids = self.a.encode_batch_fast(["".join([texts[k] for k in part])], add_special_tokens=False)[0].ids
            ends = {e: n for n, e in enumerate(accumulate([self.size_a[i] for i in ids]), 1)}
            lo = 0
            for k, end in zip(part, accumulate([len(fragments[k]) + 1 for k in part])):
                hi = ends[end]
                out[k], lo = ids[lo:hi], hi
        for k, found in zip(alone, self.a.encode_batch_fast([texts[k] for k in alone], add_special_tokens=False), strict=True):
            out[k] = found.ids
        return out

    def piece_ids(self, fragments: list[bytes]) -> list[list[int]]:
        """Piece ids of each fragment; the model adds the space that each begins with, but to an empty string."""
        found = self.b.encode([f.decode() for f in fragments], num_threads=1) if fragments else []
        return [ids or [self.b.piece_to_id("▁")] for ids in found]

    def learn(self, fragments: list[bytes]) -> None:
        """Aligns and numbers new fragments."""
        names, bytes_a, bytes_b, size_a, size_b = self.names, self.bytes_a, self.bytes_b, self.size_a, self.size_b
        for f, a, b in zip(fragments, self.byte_ids(fragments), self.piece_ids(fragments), strict=True):
            self.number[f] = len(self.shown)
            whole = b" " + f
            if b"".join([bytes_a[i] for i in a]) != whole or b"".join([bytes_b[i] for i in b]) != whole:
                self.counts.extend((-1, -1, -1, 0))
                self.shown.append("")
                continue
            ends_a, ends_b = list(accumulate([size_a[i] for i in a])), list(accumulate([size_b[i] for i in b]))
            shown, found = [], []
            for lo_a, to_a, lo_b, to_b in groups(ends_a, ends_b):
                if to_a == lo_a + 1 and to_b == lo_b + 1:
                    i, j = a[lo_a], b[lo_b]
                    shown.append(names[i] + "|" + names[j])
                    found.append(i << 32 | j)
                    continue
                shown.append(",".join([names[i] for i in a[lo_a:to_a]]) + "|" + ",".join([names[i] for i in b[lo_b:to_b]]))
                found += [a[i] << 32 | b[j] for i, j in links(ends_a, ends_b, lo_a, to_a, lo_b, to_b)]
            self.counts.extend((len(a), len(b), len(shown), len(found)))
            self.shown.append(";".join(shown))
            self.linked.extend(found)

    def texts(self, data: bytes, sizes: list[int]) -> list[np.ndarray]:
        """The numbers of the fragments of each text; an empty text has none."""
        if len(self.number) > REMEMBERED:
            self.forget()
        out: list[np.ndarray] = []
        waiting: list[list[bytes]] = []
        at = held = 0

        def number() -> None:
            new = set(chain.from_iterable(waiting)).difference(self.number)
            if new:
                self.learn(list(new))
            out.extend(np.array(list(map(self.number.__getitem__, fragments)), np.int64) for fragments in waiting)
            waiting.clear()

        for size in sizes:
            waiting.append(self.fragments(data[at : at + size]) if size else [])
            at, held = at + size, held + size
            if held >= LEARNT_BYTES:
                number()
                held = 0
        number()
        met = np.bincount(np.concatenate([np.zeros(0, np.int64), *out]), minlength=len(self.shown))
        met[: len(self.hits)] += self.hits
        self.hits = met
        return out

    def forget(self) -> None:
        """Keeps at most half as many fragments as may be remembered, the frequent ones."""
        least = 2
        while (keep := self.hits >= least).sum() > REMEMBERED // 2:
            least *= 2
        n = np.array(self.counts, np.int64).reshape(-1, 4)
        linked = np.array(self.linked, np.int64)[np.repeat(keep, n[:, 3])]
        self.number = {f: k for k, f in enumerate(compress(self.number, keep.tolist()))}
        self.shown = list(compress(self.shown, keep.tolist()))
        self.counts, self.linked, self.hits = array("q", n[keep].tobytes()), array("q", linked.tobytes()), self.hits[keep] // 2


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, list, np.ndarray, bytes]]:
    """(block, ids, sizes, joined texts) of whole documents, up to ``block_bytes`` or one longer document."""
    part, block, ids, parts, held = TaskContext.get().partitionId(), 0, [], [], 0
    for batch in batches:
        for i, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            data = text.as_buffer().to_pybytes()
            if ids and held + len(data) > block_bytes:
                yield (part << 32) | block, ids, np.array([*map(len, parts)]), b"".join(parts)
                block, ids, parts, held = block + 1, [], [], 0
            ids.append(i.as_py())
            parts.append(data)
            held += len(data)
    if ids:
        yield (part << 32) | block, ids, np.array([*map(len, parts)]), b"".join(parts)


def _pairs_of_blocks(path_a: str, path_b: str, block_bytes: int):
    """Function for mapInArrow: every block's documents aligned, their pairs numbered within the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = aligner(path_a, path_b)
        for block, ids, sizes, data in _blocks(batches, block_bytes):
            found = memory.texts(data, sizes.tolist())
            counts = np.array(memory.counts, np.int64).reshape(-1, 4)
            whole = [bool(len(x)) and counts[x, 0].min() >= 0 for x in found]
            found = [x if ok else x[:0] for x, ok in zip(found, whole, strict=True)]
            totals = np.array([counts[x].sum(axis=0) for x in found], np.int64).reshape(-1, 4)
            shas = [hashlib.sha256(";".join([memory.shown[k] for k in x.tolist()]).encode()).hexdigest() if ok else "" for x, ok in zip(found, whole, strict=True)]
            every = np.concatenate([np.zeros(0, np.int64), *found])
            n, ends = counts[every, 3], np.cumsum(counts[:, 3])
            place = np.arange(int(n.sum())) + np.repeat(ends[every] - n - np.cumsum(n) + n, n)
            pairs, index = np.unique(np.array(memory.linked, np.int64)[place], return_inverse=True)
            doc = np.repeat(np.arange(len(found)), totals[:, 3])
            used, times = np.unique(doc * max(1, len(pairs)) + index, return_counts=True)
            doc, index = np.divmod(used, max(1, len(pairs)))
            yield pa.record_batch(
                {
                    "block": pa.array([block], pa.int64()),
                    "ids": pa.array([ids], pa.list_(pa.int64())),
                    **{c: pa.array([row], pa.list_(pa.int64())) for c, row in zip(TOTALS, totals.T, strict=True)},
                    "groups_sha256": pa.array([shas], pa.list_(pa.string())),
                    "sizes": pa.array([np.bincount(doc, minlength=len(found))], pa.list_(pa.int64())),
                    "pairs": pa.array([planes(np.diff(pairs, prepend=0))], pa.binary()),
                    "used": pa.array([planes(np.concatenate([index, times]).astype(np.uint32))], pa.binary()),
                }
            )

    return run


def _used(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a block, and for every document's pair its number in them and how often it is linked."""
    pairs, used = np.cumsum(unplaned(row["pairs"], np.int64)), unplaned(row["used"], np.uint32).reshape(2, -1)
    return pairs, used[0].astype(np.int64), used[1].astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, a, b, n): in how many documents of the block the pair is linked."""
    for batch in batches:
        for row in batch.select(["block", "pairs", "used"]).to_pylist():
            pairs, index, _ = _used(row)
            n = np.bincount(index, minlength=len(pairs))
            yield pa.record_batch(
                {"block": pa.array(np.full(len(pairs), row["block"])), "a": pa.array((pairs >> 32).astype(np.int32)), "b": pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), "n": pa.array(n)}
            )


def _scored(left: pa.Table, right: pa.Table) -> pa.Table:
    """Every document of a block with what the corpus says of its links."""
    rows = []
    told = (right.column("a").to_numpy().astype(np.int64) << 32) | right.column("b").to_numpy()
    order = np.argsort(told)
    count, best = right.column("count").to_numpy()[order], right.column("best").to_numpy(zero_copy_only=False)[order]
    for row in left.to_pylist():
        _, index, times = _used(row)
        doc = np.repeat(np.arange(len(row["ids"])), row["sizes"])
        n_best, count_sum = np.zeros((2, len(row["ids"])), np.int64)
        np.add.at(n_best, doc, times * best[index])
        np.add.at(count_sum, doc, times * count[index])
        rows += zip(row["ids"], *(row[c] for c in TOTALS), n_best.tolist(), count_sum.tolist(), row["groups_sha256"], strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * 8
    names = ["doc_id", *TOTALS, "n_best", "count_sum", "groups_sha256"]
    return pa.table([pa.array(c, pa.string() if name == "groups_sha256" else pa.int64()) for name, c in zip(names, columns, strict=True)], names=names)


def alignments(docs: DataFrame, path_a: str, path_b: str, scratch: Scratch, block_bytes: int = 2 << 20) -> DataFrame:
    """One row per document: tokens of both, groups, links, links that are their first id's best, counts, digest of the groups.

    path_a: a byte-level vocabulary of the tokenizers library; path_b: a
    sentencepiece model without normalisation and with byte pieces.
    """
    found = scratch.store("aligned", texts(docs).mapInArrow(_pairs_of_blocks(path_a, path_b, block_bytes), ALIGNED))
    counts = found.select("block", "pairs", "used").mapInArrow(_counts, COUNTED)
    totals = counts.groupBy("a", "b").agg(F.sum("n").alias("count"))
    # an id has at most as many partners as the other vocabulary has entries
    known = totals.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))
    told = scratch.store("told", counts.select("block", "a", "b").join(known, ["a", "b"]))
    return found.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_scored, RESULT)


def pairs(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = 2 << 20) -> DataFrame:
    """(a, b, documents) of all linked id pairs of the corpus."""
    counts = texts(docs).mapInArrow(_pairs_of_blocks(path_a, path_b, block_bytes), ALIGNED).select("block", "pairs", "used").mapInArrow(_counts, COUNTED)
    return counts.groupBy("a", "b").agg(F.sum("n").alias("documents"))
