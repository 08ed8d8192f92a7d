"""Quality rules against a brute-force version."""

import collections
import math
import re

import numpy as np
import pytest

from chapterflow.llm import outliers, queries
from chapterflow.llm.common import Scratch

from .helpers import AWKWARD, documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def vector(text):
    n, chars, symbols, dup, repeat = counts(text)
    lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
    upper = sum(c.isupper() for c in (text or ""))
    share = [symbols / max(chars, 1), dup / max(lines, 1), repeat / max(n, 1), upper / max(chars, 1)]
    return [math.log1p(n), math.log(max(chars, 1) / max(n, 1)), *(math.log1p(100 * x) for x in share)]


def estimate(x):
    """Concentration steps over whole arrays."""
    floors, n, p = np.array(list(outliers.FLOORS.values())), len(x), x.shape[1]
    srt = np.sort(x, axis=0)
    q = [srt[max(0, math.ceil(f * n) - 1)] for f in (0.25, 0.5, 0.75)]
    mean, factor = q[1], np.diag(np.maximum((q[2] - q[0]) / 1.349, floors))
    scale = outliers.consistency(outliers.SUBSET, p)
    for _ in range(outliers.STEPS):
        d = (np.linalg.solve(factor, (x - mean).T) ** 2).sum(axis=0)
        cls = np.floor(outliers.CLASSES * np.log2(np.maximum(d, 1e-6)))
        limit = np.sort(cls)[math.ceil(outliers.SUBSET * n) - 1]
        near = x[cls <= limit]
        mean = near.mean(axis=0)
        factor = np.linalg.cholesky(scale * np.cov(near.T, bias=True) + np.diag(floors**2))
    return mean, factor


def test_against_brute_force(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(outliers, "MIN_ROWS", 20)
    docs = documents(spark, sf_dir)
    rows = docs.collect()
    got = {r.doc_id: r for r in queries.op4_outliers(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    usable, x = [], {}
    for r in rows:
        c = counts(r.text)
        assert tuple(got[r.doc_id][k] for k in outliers.STATS) == c
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        assert got[r.doc_id].base_failed == failed
        x[r.doc_id] = vector(r.text)
        if not failed:
            usable.append(r)
    groups = collections.defaultdict(list)
    for r in usable:
        for key in ((r.lang, r.source), (r.lang,), ()):
            groups[key].append(x[r.doc_id])
    found = {k: estimate(np.array(v)) for k, v in groups.items() if len(v) >= 20}
    assert len(found) > 2
    for r in rows:
        mean, factor = next(found[k] for k in ((r.lang, r.source), (r.lang,), ()) if k in found)
        d = (np.linalg.solve(factor, np.array(x[r.doc_id]) - mean) ** 2).sum()
        assert got[r.doc_id].distance == pytest.approx(d, rel=1e-6, abs=1e-9)
        assert got[r.doc_id].kept == (not got[r.doc_id].base_failed and d <= outliers.CUTOFF)


def test_clean_documents_stay(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet")
    got = queries.op4_outliers(spark, sf_dir.replace("sf0.001", "sf0.01")).join(labels, "doc_id").where("NOT base_failed").collect()
    clean, junk = ([r.kept for r in got if r.quality == q] for q in (1, 0))
    assert sum(clean) == len(clean)
    assert sum(junk) < 0.4 * len(junk)


def test_awkward_documents(spark):
    got = outliers.outliers(frame(spark, AWKWARD), Scratch(spark, "t")).collect()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted(counts(t) for _, t in AWKWARD)
    assert all(r.kept == (not r.base_failed) and r.distance is None and r.row.keep == "z" for r in got)  # too few to judge by
    assert outliers.outliers(frame(spark, []), Scratch(spark, "t")).count() == 0


def test_equal_rows_have_no_spread(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(30))) for i in range(150)] + [(999, "### " * 10 + " ".join(f"w{k}" for k in range(30)))]
    got = {r.row.doc_id: r.kept for r in outliers.outliers(frame(spark, rows), Scratch(spark, "t")).collect()}
    assert not got.pop(999) and all(got.values())


def test_duplicate_lines_and_repeats_decide():
    """Two statistics alone, with the least variances that any group has, reach the cutoff."""
    most = (math.log1p(100) / outliers.FLOORS["x_lines"]) ** 2 + (math.log1p(30) / outliers.FLOORS["x_repeats"]) ** 2
    assert outliers.CUTOFF < most
    assert outliers.chi2_cdf(outliers.CUTOFF, len(outliers.NAMES)) == pytest.approx(1 - outliers.CHANCE, abs=1e-12)


def test_document_of_duplicate_lines_goes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "\n".join(f"w{k:04d}" for k in rng.choice(10_000, 400, replace=False))) for i in range(120)]
    few = [f"w{k:04d}" for k in rng.integers(0, 40, 350)]
    rows.append((999, "\n".join([*few, *few[:50]])))
    got = {r.row.doc_id: r for r in outliers.outliers(frame(spark, rows), Scratch(spark, "t")).collect()}
    assert not got[999].base_failed and got[999].n_dup_lines > 350
    assert not got.pop(999).kept and all(r.kept for r in got.values())
