"""Repeated strings against a set of all strings."""

import hashlib
import random

import numpy as np
import pytest

from chapterflow.llm import queries, suffix_dedup
from chapterflow.llm.common import Scratch

from .helpers import AWKWARD, frame, pairs


def brute(rows):
    """(id, bytes, spans, kept) of rows in order; null ids last."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, np.int8)
        for p in range(len(b) - 99):
            s = hashlib.blake2b(b[p : p + 100], digest_size=16).digest()
            if s in seen:
                gone[p + 1 : p + 101] = 1
            seen.add(s)
        edges = np.flatnonzero(np.diff(gone))
        own = gone[1:-1].astype(bool)
        out.append((i, len(b), list(zip(edges[::2].tolist(), edges[1::2].tolist())), np.frombuffer(b, np.uint8)[~own].tobytes()))
    return out


def got(spark, rows):
    found = suffix_dedup.deduplicated(frame(spark, rows), Scratch(spark, "t")).collect()
    return sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in found), key=lambda r: (r[0] is None, r[0] or 0))


@pytest.mark.parametrize("together", [suffix_dedup.TOGETHER, 1])
def test_against_all_strings(spark, together, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    rng = random.Random(11)
    pool = ["".join(rng.choices("abcdefg é", k=rng.choice([40, 99, 100, 101, 130, 400]))) for _ in range(25)]
    rows = []
    for i in range(120):
        text = "".join(rng.choice([rng.choice(pool), rng.choice(pool)[: rng.randint(1, 300)], "".join(rng.choices("xyz", k=rng.randint(0, 150))), "ab" * rng.randint(0, 90)]) for _ in range(rng.randint(0, 7)))
        rows.append((i, text))
    assert got(spark, rows) == brute(rows)


def test_awkward_documents(spark):
    rows = [*AWKWARD, (20, "a" * 101), (21, "b" * 100), (22, "x" + "b" * 100 + "y"), (23, "c" * 100 + "d" * 150)]
    assert got(spark, rows) == brute(rows)
    assert suffix_dedup.deduplicated(frame(spark, []), Scratch(spark, "t")).count() == 0


def test_query(spark, sf_dir):
    found = {tuple(r) for r in queries.op9_suffix_dedup(spark, sf_dir).collect()}
    assert found == {(i, n, sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in brute(pairs(spark, sf_dir))}


def test_anchors_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab", k=rng.choice([0, 5, 99, 100, 101, 400, 3000]))).encode() for _ in range(60)]
    data, sizes = b"".join(texts), np.array([len(t) for t in texts])
    whole = suffix_dedup.anchors(data, sizes)
    grams = {p: int(h) for p, h in zip(*(x.tolist() for x in whole[:2]))}
    begin = 0
    for t in texts:  # every string holds one of its least grams
        for p in range(begin, begin + len(t) - 99):
            assert any(q in grams for q in range(p, p + 69))
        begin += len(t)
    for step in (1000, 137, 70):
        monkeypatch.setattr(suffix_dedup, "SLICE", step)
        assert [x.tolist() for x in suffix_dedup.anchors(data, sizes)] == [x.tolist() for x in whole]
