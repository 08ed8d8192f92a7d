"""The Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from chapterflow.llm import jaccard, queries
from chapterflow.llm.common import Scratch
from chapterflow.llm.components import connected

from .helpers import AWKWARD, frame, pairs


def brute(rows, width, num, den):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(root(k), []).append(i)
    least = {r: min((i for i in x if i is not None), default=None) for r, x in ids.items()}
    return [(i, len(s), least[root(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def variants(seed, n, size):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(n):
        base = [f"w{rng.randrange(60 + 40 * size)}" for _ in range(rng.choice([2, 5, 9, 20, size, 2 * size]))]
        chain = base
        for _ in range(rng.choice([0, 1, 3, 9])):
            chain = list(rng.choice([base, chain]))
            for _ in range(rng.choice([0, 1, 1, 2, max(1, len(base) // 40)])):
                k = rng.randrange(len(chain))
                chain[k : k + rng.choice([0, 1, 1])] = rng.choice([["new%d" % rng.randrange(99)], []])
                chain = chain or ["x"]
            rows.append((i := i + 1, " ".join(chain)))
        rows.append((i := i + 1, " ".join(base)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_links_of_near_copies(spark, width, num, den, monkeypatch):
    rows = variants(width, 60, 150)
    want = sorted(brute(rows, width, num, den))
    assert len({c for _, _, c in want}) < len(rows) * 0.8
    for block in (jaccard.BLOCK_SHINGLES, 300):  # also with canopies in many blocks
        monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
        got = jaccard.groups(frame(spark, rows), Scratch(spark, "t"), width, num, den).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_search_of_one_index():
    rng = random.Random(4)
    limit, index, sets = jaccard.Threshold(4, 5), jaccard.Index(), []
    for k in range(80):
        s = sorted(rng.sample(range(40), rng.choice([1, 3, 30, 35, 38])))
        got = dict(index.search(s, len(s), limit, [len(x) for x in sets]))
        assert got == {j: len({*s} & {*x}) for j, x in enumerate(sets) if limit.links(len({*s} & {*x}), len(s), len(x))}
        sets.append(s)
        index.add(k, s)


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5)])
def test_linked_sets_of_a_canopy(num, den):
    rng, limit = random.Random(num), jaccard.Threshold(num, den)
    for _ in range(40):
        sets, size = [], rng.choice([3, 12, 40, 90])
        for _ in range(rng.choice([1, 2, 60])):
            base = set(rng.choice(sets)) if sets and rng.random() < 0.9 else set(rng.sample(range(2 * size), size))
            for x in rng.sample(sorted(base), rng.choice([0, 0, 1, max(1, size // 20)])):
                base.discard(x)
                base |= {rng.randrange(4 * size)} if rng.random() < 0.6 or not base else set()
            sets.append(sorted(base))
        links = jaccard.linked([np.array(x, np.uint64) for x in sets], limit)
        true = [(i, j) for i in range(len(sets)) for j in range(i) if den * len({*sets[i]} & {*sets[j]}) >= num * len({*sets[i]} | {*sets[j]})]
        assert {(max(x), min(x)) for x in links} <= set(true)
        parts = []
        for edges in (links, true):
            root = list(range(len(sets)))
            for i, j in edges:
                root = [root[i] if x == root[j] else x for x in root]
            parts.append({tuple(k for k, x in enumerate(root) if x == r) for r in root})
        assert parts[0] == parts[1]


def test_query_against_all_pairs(spark, sf_dir):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in queries.op5_jaccard(spark, sf_dir).collect()}
    assert got == set(brute(pairs(spark, sf_dir), 3, 9, 10))


def test_awkward_documents(spark):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.groups(frame(spark, AWKWARD), Scratch(spark, "t"), 3, 9, 10).collect()]
    assert sorted(got, key=key) == sorted(brute(AWKWARD, 3, 9, 10), key=key)
    assert jaccard.groups(frame(spark, []), Scratch(spark, "t"), 3, 9, 10).count() == 0
    left = jaccard.firsts(frame(spark, AWKWARD), Scratch(spark, "t"))
    assert left.columns == frame(spark, []).columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9]


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("1000 - id * 3 AS a", "1000 - (id + 1) * 3 AS b").union(spark.sql("SELECT 5L, 7L"))
    got = {r.node: r.component for r in connected(edges, Scratch(spark, "t"), "e").collect()}
    assert got == {**{1000 - 3 * k: 400 for k in range(201)}, 5: 5, 7: 5}


def test_rows_of_a_repeated_id_are_judged_by_their_own_sets(spark):
    own, rest = "a long text of its own that no other row has", "what is left of a second copy"
    rows = [(1, rest), (2, own), (2, rest), (3, own + " too"), (4, ""), (4, rest), (4, None), (None, own)]
    left = jaccard.firsts(frame(spark, rows), Scratch(spark, "t"), 3, 4, 5)
    assert left.columns == frame(spark, []).columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, own), (1, rest), (2, own), (4, ""), (4, "")]
