"""Context-tree scores against a recursive version; the classifier on held-out labels."""

import collections
import math
import zlib

import numpy as np
import pytest

from chapterflow.llm import context_tree, discriminant, queries
from chapterflow.llm.common import Scratch

from .helpers import AWKWARD, frame, pairs


class Tree:
    """Counts of every context; weighted probabilities by recursion."""

    def __init__(self, texts):
        self.n = collections.defaultdict(lambda: [0, 0])
        self.children = collections.defaultdict(set)
        self.memo = {}
        for t in texts:
            for context, byte in self.positions(t):
                for node, bit in self.decisions(byte):
                    for d in range(context_tree.DEPTH + 1):
                        c = context[len(context) - d :]
                        self.n[c, node][bit] += 1
                        if d:
                            self.children[c[1:], node].add(c)

    @staticmethod
    def positions(t):
        t = bytes(context_tree.DEPTH) + t
        return [(t[i - context_tree.DEPTH : i], t[i]) for i in range(context_tree.DEPTH, len(t))]

    @staticmethod
    def decisions(byte):
        return [((1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1) for k in range(8)]

    def log_pe(self, c, node):
        a, b = self.n[c, node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def below(self, c, node):
        return sum(self.log_pw(x, node) for x in self.children[c, node])

    def log_pw(self, c, node):
        if (c, node) not in self.memo:
            pe = self.log_pe(c, node)
            self.memo[c, node] = pe if len(c) == context_tree.DEPTH else np.logaddexp(pe, self.below(c, node)) - math.log(2)
        return self.memo[c, node]

    def p(self, c, node, d=0):
        own = c[len(c) - d :]
        a, b = self.n[own, node] if (own, node) in self.n else (0, 0)
        kt = (b + 0.5) / (a + b + 1)
        deeper = d < context_tree.DEPTH and (c[len(c) - d - 1 :], node) in self.n
        if a + b == 0 or not deeper:
            return kt
        w = math.exp(self.log_pe(own, node) - math.log(2) - self.log_pw(own, node))
        return w * kt + (1 - w) * self.p(c, node, d + 1)

    def score(self, t):
        total = 0.0
        for context, byte in self.positions(t):
            for node, bit in self.decisions(byte):
                p = self.p(context, node)
                total += math.log10(p if bit else 1 - p)
        return total


def tokens(text):
    return [*context_tree.lowered((text or "").encode()).split(), b"\n"]


def brute(rows, folds, fold):
    held = {i: zlib.crc32(str(i).encode()) % folds == fold if i is not None else False for i, _ in rows}
    train = [tokens(t) for i, t in rows if not held[i]]
    c = collections.Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    tree = Tree(context_tree.spelled(t) for t in train)
    out = []
    for i, t in rows:
        t = tokens(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        out.append((i, held[i], len(t), sum(c[w] > 0 for w in t), n, base, tree.score(context_tree.spelled(t))))
    return out


def check(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-7)


def test_scores_against_recursion(spark):
    rows = [(i, " ".join("aB cab"[k % 5 :: 2] for k in range(i % 7)) + " the cat " * (i % 3)) for i in range(30)]
    rows += [(i, (t or "")[:300]) for i, t in AWKWARD]
    check(context_tree.scores(frame(spark, rows), Scratch(spark, "t")).collect(), brute(rows, 7, 2))


def test_scores_over_many_ranges(spark, monkeypatch):
    """Strings and words travel as arrays by range, in as many ranges as the texts ask for."""
    rows = [(i, " ".join("aB cab dx"[k % 5 :: 2] for k in range(i % 7)) + f" the cat {i} " * (i % 3)) for i in range(30)]
    rows += [(i, (t or "")[:300]) for i, t in AWKWARD]
    monkeypatch.setattr(context_tree, "RANGE_BYTES", 200)
    monkeypatch.setattr(context_tree, "ROWS", 50)
    kept, drop = [], Scratch.drop
    monkeypatch.setattr(Scratch, "drop", lambda self, *names: (kept.append(self.spark.read.parquet(f"{self.root}/strings").select("range").distinct().count()) if "strings" in names else None, drop(self, *names)))
    check(context_tree.scores(frame(spark, rows).coalesce(2), Scratch(spark, "t")).collect(), brute(rows, 7, 2))
    assert kept[0] > 5


def test_scores_of_awkward_tables(spark):
    assert context_tree.scores(frame(spark, []), Scratch(spark, "t")).count() == 0
    # nothing to learn from: every bit is even
    only = context_tree.scores(frame(spark, [(1, "ab")]), Scratch(spark, "t"), folds=1, fold=0).first()
    assert only.score == pytest.approx(-24 * math.log10(2)) and only.base_score == pytest.approx(0) and only.train_tokens == 0


def test_query_scores(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in queries.op3_context_tree(spark, sf_dir).collect()}
    rows = pairs(spark, sf_dir)
    assert set(got) == {i for i, _ in rows}
    assert {i for i, r in got.items() if r.held_out} == {i for i, _ in rows if zlib.crc32(b"%d" % i) % 7 == 2}
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > 1.05 * sum(r.base_score for r in held)


def auc(scores, labels):
    order = np.argsort(scores)
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    y = np.array(labels)
    return (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())


def test_classifier_on_held_out_labels(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = queries.op10_discriminant(spark, sf_dir).collect()
    assert len(got) == len(pairs(spark, sf_dir))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    print("AUC", auc([s for s, _, _ in held], [y for _, y, _ in held]), "accuracy", sum(y == p for _, y, p in held) / len(held))
    assert auc([s for s, _, _ in held], [y for _, y, _ in held]) > 0.97
    assert sum(y == p for _, y, p in held) / len(held) > 0.95


def test_classifier_matches_densities(spark, sf_dir):
    rows = discriminant.features(frame(spark, pairs(spark, sf_dir))).toPandas()
    rows["y"] = [zlib.crc32(b"%d" % i) % 2 for i in rows.doc_id]
    model = discriminant.fit(spark.createDataFrame(rows), "y")
    got = discriminant.scored(spark.createDataFrame(rows), model).toPandas()
    x = rows[discriminant.FEATURES].to_numpy()
    covs = [np.cov(x[rows.y == y].T, bias=True) for y in (0, 1)]
    n = [(rows.y == y).sum() for y in (0, 1)]
    pooled = np.diag(np.diag(sum(k * c for k, c in zip(n, covs))) / len(rows))
    logs = []
    for y in (0, 1):
        cov = (1 - discriminant.SHRINK) * covs[y] + discriminant.SHRINK * pooled + discriminant.FLOOR * np.eye(x.shape[1])
        z = x - x[rows.y == y].mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(n[y] + 1))
    assert got.score.to_numpy() == pytest.approx(1 / (1 + np.exp(np.clip(logs[0] - logs[1], -40, 40))), abs=1e-6)


def test_classifier_of_awkward_documents(spark):
    rows = discriminant.features(frame(spark, AWKWARD))
    got = discriminant.scored(rows, discriminant.fit(rows.selectExpr("*", "1 AS y"), "y")).collect()
    assert len(got) == len(AWKWARD) and {round(r.score, 9) for r in got} == {round(12 / 13, 9)}
    assert discriminant.features(frame(spark, [])).count() == 0
