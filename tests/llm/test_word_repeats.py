"""Repeated word sequences against a count of all windows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from chapterflow.llm import queries, word_repeats
from chapterflow.llm.common import Scratch

from .helpers import AWKWARD, frame, pairs


def brute(rows, width=35):
    """(id, words, spans, kept) of every row."""
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    counts = Counter(tuple(w[p : p + width]) for w in texts for p in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, texts):
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if counts[tuple(w[p : p + width])] > 1:
                gone[p : p + width] = [True] * width
        edges = [k for k in range(len(w) + 1) if (gone[k] if k < len(w) else False) != (gone[k - 1] if k else False)]
        out.append((i, len(w), list(zip(edges[::2], edges[1::2])), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def got(spark, rows, width=35):
    found = word_repeats.deduplicated(frame(spark, rows), Scratch(spark, "t"), width).collect()
    return sorted(((r.doc_id, r.n_words, [tuple(s) for s in r.spans], r.kept) for r in found), key=str)


@pytest.mark.parametrize("width, in_range", [(35, 1_000_000), (35, 50), (6, 1_000_000), (1, 50)])
def test_against_all_windows(spark, width, in_range, monkeypatch):
    monkeypatch.setattr(word_repeats, "IN_RANGE", in_range)
    rng = random.Random(width)
    pool = [rng.choices(["a", "b", "é", "中", "longer-word"], k=rng.choice([width - 1, width, width + 1, 2 * width, 3 * width])) for _ in range(20)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 6)):
            some = rng.choice(pool)
            parts += rng.choice([some, some[rng.randrange(len(some) + 1) :], [f"u{rng.random()}" for _ in range(rng.randint(0, 40))], ["x"] * rng.randint(0, width + 3)])
        rows.append((i, rng.choice([" ", "\n", "\t\x0b "]).join(parts)))
    rows += rows[:3]
    assert got(spark, rows, width) == brute(rows, width)


def test_awkward_documents(spark):
    some = " ".join(f"w{k}" for k in range(60))
    rows = [*AWKWARD, (20, some), (21, "head\x1c " + some.replace("w10 ", "w10 x ") + " tail"), (22, "x " * 34), (23, "y " * 35), (24, "z " * 36), (25, some.replace(" ", "\r\n"))]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == [] and got(spark, [(1, None), (2, "")]) == [(1, 0, [], ""), (2, 0, [], "")]


def test_words_are_told_apart():
    rng = random.Random(1)
    texts = [b"ab cd", b"a bcd", b"", b"abcd", b" x\x00y \xc3\xa9", b"x" * 3_000_000 + b" y", bytes(rng.choices(b"ab \n", k=5000))]
    import numpy as np

    doc, one, two = word_repeats.words(b"".join(texts), np.array([len(t) for t in texts]))
    flat = [(k, w) for k, t in enumerate(texts) for w in t.split()]
    assert doc.tolist() == [k for k, _ in flat]
    for digests in (one, two):
        assert len(set(digests.tolist())) == len({w for _, w in flat}) == len(set(zip(digests.tolist(), [w for _, w in flat])))


def test_one_very_long_text(spark):
    half = " ".join(f"n{k}" for k in range(1_300_000))
    (one, two) = got(spark, [(1, half), (2, "other " + half[:2000])])
    n = len(half[:2000].split()) - 1  # the last word is cut
    assert one[1] == 1_300_000 and one[2][0][0] == 0 and abs(one[2][0][1] - n) <= 1 and two[2][0][0] == 1


def test_query(spark, sf_dir):
    found = {tuple(r) for r in queries.op12_word_repeats(spark, sf_dir).collect()}
    want = brute(pairs(spark, sf_dir))
    assert found == {(i, n, sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept.encode()).hexdigest()) for i, n, spans, kept in want}
    assert any(spans for _, _, spans, _ in want)
