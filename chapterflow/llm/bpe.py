"""BPE encoding and decoding with forced boundaries.

A byte pair that never stands inside any vocabulary token marks a certain cut:
no token can span it. Of these cuts the ones before ASCII white space are
taken, where the pre-tokenizer cuts as well and never looks across, so every
fragment is encoded on its own and the ids are concatenated.

Defined cases: a null text is empty and gives no id; repeated rows and null
ids stay; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chapterflow.llm.common import texts
from chapterflow.llm.fragments import Memo, tokenizer

ASCII_SPACE = b"\t\n\x0b\x0c\r "
#: White space beyond ASCII, as the pre-tokenizer's pattern sees it.
OTHER_SPACE = "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others take the letters from
    256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of every id; added tokens stand for their own text."""
    letters, t = byte_letters(), tokenizer(path)
    added = {i: x.content for i, x in t.get_added_tokens_decoder().items()}
    return {i: added[i].encode() if i in added else bytes(letters[c] for c in s) for s, i in t.get_vocab(with_added_tokens=True).items()}


@lru_cache(maxsize=4)
def inner_pairs(path: str) -> np.ndarray:
    """256 x 256: does the byte pair stand inside a vocabulary token?"""
    found = np.zeros((256, 256), bool)
    added = set(tokenizer(path).get_added_tokens_decoder())
    for i, b in token_bytes(path).items():
        if i not in added:  # found in the text before it is cut into words
            a = np.frombuffer(b, np.uint8)
            found[a[:-1], a[1:]] = True
    return found


@lru_cache(maxsize=4)
def cutter(path: str):
    """Function that cuts the bytes of a text into fragments at forced boundaries."""
    inner, space = inner_pairs(path), re.escape(ASCII_SPACE)
    open_ends = bytes(b for b in range(256) if b not in ASCII_SPACE and inner[b, list(ASCII_SPACE)].any())
    on = b"(?:(?<=[" + re.escape(open_ends) + b"])[" + space + b"]+[^" + space + b"]*)*" if open_ends else b""
    pattern = re.compile(b"[" + space + b"]*[^" + space + b"]+" + on + b"|[" + space + b"]+")
    odd, ends = re.compile("[" + OTHER_SPACE + "]"), tuple(c.encode() for c in OTHER_SPACE)

    def cut(data: bytes) -> list[bytes]:
        found = pattern.findall(data)
        if data.isascii() or not odd.search(data.decode()):
            return found
        joined: list[bytes] = []  # no cut between white space and white space: the pre-tokenizer looks ahead there
        for f in found:
            if joined and joined[-1].endswith(ends):
                joined[-1] += f
            else:
                joined.append(f)
        return joined

    return cut


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row, as the library encodes the whole text without added special tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, cut = Memo(path, lambda ids: np.array(ids, np.int32).tobytes()), cutter(path)
        for b in batches:
            parts = [b"".join(memo.lookup(cut(t.as_buffer().to_pybytes()))) for t in b.column("text")]
            offsets = np.zeros(len(parts) + 1, np.int64)
            np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "ids": ids})

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The columns of ``encoded`` and ``decoded``: the text of the ids, special tokens included.

    Bytes that are no UTF-8 become U+FFFD. A null list gives null.
    """
    names = [c for c in encoded.columns if c != "decoded"]
    schema = encoded.select(*names).schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        known = [table.get(i, b"") for i in range(max(table) + 1)]
        for b in batches:
            out = [None if x is None else b"".join(map(known.__getitem__, x.to_numpy(zero_copy_only=False).tolist())).decode("utf-8", "replace") for x in (s.values for s in b.column(ids_col))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*names, "decoded"])

    return encoded.select(*names).mapInArrow(run, schema)
