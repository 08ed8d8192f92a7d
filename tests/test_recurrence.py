"""Composition of blocks against the fold over all chapters."""

import math
import random
import time

import pytest

from chapterflow.operators import chapters as C
from chapterflow.operators import recurrence as R

SCHEMA = "video_id long, number long, start_s double, end_s double, duration_s double"


def random_chapters(rng, n, d):
    at, out = 0.0, []
    for _ in range(n):
        s = at + rng.choice([-9, -1, -0.1, 0, 0.05, 0.1, 1.0, 3])
        e = s + rng.choice([-3, 0, 0.5, 1.0, 1.05, 1.1, 8])
        out.append((s, e, d))
        at = max(at, e) if rng.random() < 0.7 else at
    return out


@pytest.mark.parametrize("seed", range(6))
def test_a_block_is_its_steps(seed):
    rng = random.Random(seed)
    for _ in range(150):
        block = random_chapters(rng, rng.randrange(1, 30), rng.choice([15.0, 60.0, math.inf]))
        own = R.steps(block)
        for before in [-math.inf, *own[0], *(x + 0.3 for x in own[0]), *(rng.uniform(-5, 40) for _ in range(20)), 15.0]:
            before = min(before, block[0][2])
            assert R.after(before, *own, len(block), block[0][2]) == pytest.approx(R.fold(block, before)[-1], abs=1e-9)


def test_missing_times():
    assert R.fold(R._values([None, 5.0, 1.0], [2.0, None, None], [9.0, 9.0, 9.0]), -math.inf) == [2.0, 9.0, 9.0]


@pytest.mark.parametrize("size", [8, 4096])
def test_first_chapter_reaches_the_end(spark, size):
    """Nothing behind it is free of its past."""
    rows = [(1, n, float(n), 500.0 if n == 0 else n + 0.5, 500.0) for n in range(300)]
    got = [(r.start_s, r.end_s) for r in C.repair_chapters(spark.createDataFrame(rows, SCHEMA), size=size).orderBy("number").collect()]
    ends = R.fold([r[2:] for r in rows], -math.inf)
    assert ends == [500.0] * 300 and len(got) == 300 and all(e == 500.0 for _, e in got)


def test_forty_thousand_chapters(spark):
    rng = random.Random(3)
    rows = [(1, n, *c) for n, c in enumerate(random_chapters(rng, 40_000, 1e9))]
    df = spark.createDataFrame(rows, SCHEMA).cache()
    df.count()
    begun = time.monotonic()
    got = C.repair_chapters(df).orderBy("number").collect()
    assert time.monotonic() - begun < 30 and [r.number for r in got] == list(range(40_000))
    assert all(a.end_s <= b.start_s for a, b in zip(got, got[1:])) and got[0].start_s == 0.0
