"""Pieces looked up in texts against ``str.find``."""

import random

import pytest

from chapterflow.operators import chapters as C
from chapterflow.operators import search


@pytest.mark.parametrize("step", [1 << 20, 64, 7])
def test_first_places(step):
    rng = random.Random(step)
    for _ in range(60):
        text = "".join(rng.choices("abá😀 ", k=rng.randrange(400)))
        pieces = ["", "zz", *(text[i : i + rng.choice([1, 3, 20, 50])] for i in (rng.randrange(len(text) + 1) for _ in range(30)))]
        assert search.first_places(text, pieces, step) == {p: text.find(p) for p in pieces if p in text}


def test_equal_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(search, "_rolling", lambda c, length, p, i: c[: len(c) - length + 1] * 0)
    assert search.first_places("abcabd", ["abd", "xyz", "bca"]) == {"abd": 3, "bca": 1}


def test_long_pieces_are_refused():
    with pytest.raises(ValueError):
        search.first_places("a", ["a" * 65])


def test_many_chapters_of_one_long_text(spark):
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(300_000))
    cuts = list(range(0, len(text), 1050))
    rows = [(1, n, text[a:b]) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))] + [(1, -1, ""), (1, -2, "no such text"), (2, 0, "x"), (3, 0, None)]
    chapters = spark.createDataFrame(rows, "video_id long, number long, transcript string")
    got = {r.number: (r.start_ratio, r.end_ratio) for r in C.estimate_ratios(chapters, spark.createDataFrame([(1, text)], "video_id long, text string")).collect()}
    assert got == {-1: (0.0, 1.0), -2: (0.0, 1.0)} | {n: (a / len(text), b / len(text)) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))}
