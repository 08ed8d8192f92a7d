"""Many short texts looked up in long ones, each long text read once.

The pieces asked of a text are hashed once. The text is walked in slices, and
one rolling hash for each length of piece is compared with all pieces of that
length at once; a hit is verified. The work on a text is its length times the
different piece lengths (at most ``LONGEST``), however many pieces there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters walked at once; longest piece.
SLICE, LONGEST = 1 << 20, 64
#: Up to this product of characters and pieces, each piece is looked up by itself.
LITTLE = 1 << 22
#: Texts whose answers go back together.
TEXTS = 64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def _rolling(characters: np.ndarray, length: int, powers: np.ndarray, inverses: np.ndarray) -> np.ndarray:
    """Hash of the ``length`` characters from each place on."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(characters * powers[: len(characters)], dtype=np.uint64)])
    return (sums[length:] - sums[:-length]) * inverses[: len(characters) - length + 1]


def first_places(text: str, pieces: list[str], step: int = SLICE) -> dict[str, int]:
    """0-based place of the first occurrence of every piece that the text has; an empty piece is at 0."""
    found = {"": 0} if "" in pieces else {}
    if max(map(len, pieces), default=0) <= LONGEST and len(text) * len(pieces) <= min(LITTLE, step * LONGEST):
        return found | {piece: place for piece in set(pieces) - {""} if (place := text.find(piece)) >= 0}
    n = min(step, max(1, len(text))) + LONGEST
    powers, inverses = _powers(_BASE, n), _powers(_INVERSE, n)
    asked: dict[int, dict[int, list[str]]] = {}
    for piece in set(pieces) - {""}:
        if len(piece) > LONGEST:
            raise ValueError(f"a piece has {len(piece)} characters, more than {LONGEST}")
        own = int(_rolling(_characters(piece), len(piece), powers, inverses)[0])
        asked.setdefault(len(piece), {}).setdefault(own, []).append(piece)
    for lo in range(0, len(text), step):
        characters = _characters(text[lo : lo + step + LONGEST - 1])
        for length, by_hash in asked.items():
            if len(characters) < length or not by_hash:
                continue
            hashes = _rolling(characters, length, powers, inverses)[:step]
            wanted = np.array(list(by_hash), np.uint64)
            at = np.flatnonzero(np.isin(hashes, wanted))
            _, first = np.unique(hashes[at], return_index=True)
            for k in np.sort(at[first]).tolist():
                key = int(hashes[k])
                for piece in by_hash.pop(key):
                    if text.startswith(piece, lo + k):
                        found[piece] = lo + k
                    elif (place := text.find(piece, lo + k)) >= 0:  # another text has the same hash
                        found[piece] = place
    return found


def locate_lists(texts: DataFrame, asked: DataFrame, key: str = "video_id", text_col: str = "text") -> DataFrame:
    """(key, pieces, places, size): for each text and each list asked of its key the first 0-based places of the
    pieces, null where absent, and the characters of the text (null for no text).

    ``asked`` is (key, lists), one row a key. Lists of a key are few against
    its text: they meet the text they are looked up in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                some = batch.slice(lo, TEXTS)
                at, pieces, places, sizes = [], [], [], []
                for i, (text, lists) in enumerate(zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)):
                    found = first_places(text or "", list({piece for pieces_ in lists for piece in pieces_ if piece is not None}))
                    at += [i] * len(lists)
                    pieces += lists
                    places += [[found.get(piece) for piece in pieces_] for pieces_ in lists]
                    sizes += [None if text is None else len(text)] * len(lists)
                out = [some.column(0).take(pa.array(at, pa.int64())), pa.array(pieces, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=[key, "pieces", "places", "size"])

    kind = texts.schema[key].dataType.simpleString()
    lists = asked.select(F.col(key).alias("__key"), "lists")
    met = texts.select(key, text_col).join(lists, F.col(key).eqNullSafe(F.col("__key"))).select(key, text_col, "lists")
    return met.mapInArrow(run, f"{key} {kind}, pieces array<string>, places array<bigint>, size bigint")


def locate(texts: DataFrame, pieces: DataFrame, key: str = "video_id", text_col: str = "text") -> DataFrame:
    """(key, piece, place): first 0-based place of each piece in the text of its key; absent pieces give no row."""
    asked = pieces.filter(F.col("piece").isNotNull()).groupBy(key).agg(F.collect_set(F.array("piece")).alias("lists"))
    found = locate_lists(texts, asked, key, text_col)
    return found.select(key, F.col("pieces")[0].alias("piece"), F.col("places")[0].alias("place")).filter("place is not null")
