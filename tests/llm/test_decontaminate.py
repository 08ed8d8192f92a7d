"""Decontamination against whole alignments."""

import random

import numpy as np

from chapterflow.llm import decontaminate as D
from chapterflow.llm import queries

from .helpers import AWKWARD, frame, pairs


def alignment(window, text):
    """Least edits of the window against any part of the text."""
    row = np.zeros(len(text) + 1, int)
    t = np.frombuffer(text, np.uint8)
    k = np.arange(len(text) + 1)
    for i, c in enumerate(window):
        new = np.concatenate([[i + 1], np.minimum(row[:-1] + (t != c), row[1:] + 1)])
        row = np.minimum.accumulate(new - k) + k
    return int(row.min())


def test_matches_are_those_of_whole_alignments():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(1, 6)))
    items = [(i, D.normalised(" ".join(word() for _ in range(rng.choice([3, 20, 60]))))) for i in range(12)]
    index = D.Index(items)
    hits = 0
    for _ in range(60):
        w = bytearray(rng.choice(index.windows))
        for _ in range(rng.randint(0, 16)):
            at = rng.randrange(len(w))
            rng.choice([lambda: w.__delitem__(at), lambda: w.insert(at, 120), lambda: w.__setitem__(at, 121)])()
        text = D.normalised(" ".join(word() for _ in range(rng.randint(0, 40)))) + b" " + bytes(w) + b" " + D.normalised(" ".join(word() for _ in range(rng.randint(0, 40))))
        got = {m[0]: m[3] for m in sorted(index.matches(text), key=lambda m: -m[3])}
        want = {}
        for k, window in enumerate(index.windows):
            if (edits := alignment(window, text)) <= D.budget(len(window)):
                want[k] = edits
        assert got == want
        hits += len(want)
        for k, start, end, edits in index.matches(text):
            assert alignment(index.windows[k], text[start:end]) == edits
    assert hits > 30


def test_leaks_in_the_table(spark, sf_dir):
    items = [(r.item_id, D.normalised(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = {i: D.normalised(t) for i, t in pairs(spark, sf_dir)}
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontaminate(spark, sf_dir).collect()}
    exact = {(d, i) for i, b in items for d, t in docs.items() if b in t}
    assert exact and exact <= got
    ws = D.windows(items)
    for d, i in got - exact:
        assert any(alignment(w, docs[d]) <= D.budget(len(w)) for w, owners in ws.items() if i in {k for k, _ in owners})


def test_awkward_documents(spark, monkeypatch):
    items = frame(spark, [*AWKWARD, (70, "two Three, four five six seven")]).withColumnRenamed("doc_id", "item_id")
    docs = frame(spark, [*AWKWARD, (80, "ONE two three\nfour  five six seven eight"), (81, "clean text of other words altogether")])
    got = D.contaminated(docs, items)
    pairs_ = {(r.doc_id, r.item_id) for r in got.collect()}
    assert {(80, 70), (4, 4), (4, 5), (5, 4), (7, 7), (8, 8), (None, None)} <= pairs_
    assert not any(d in (1, 2, 3, 81) or i in (1, 2, 3) for d, i in pairs_)
    kept = D.decontaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 9, 81]
    monkeypatch.setattr(D, "BATCH_BYTES", 40)  # many batches
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()} == pairs_
    assert D.decontaminated(docs, frame(spark, []).withColumnRenamed("doc_id", "item_id")).count() == docs.count()
    assert D.contaminated(frame(spark, []), items).count() == 0


def test_verdict_does_not_hang_on_the_neighbours(spark):
    text = "quick brown foxes jump over lazy dogs while seven wizards mix potions"
    items = frame(spark, [(1, text)]).withColumnRenamed("doc_id", "item_id")
    docs = [(k, text[k:]) for k in range(7)] + [(k + 10, text[: len(text) - k]) for k in range(7)]
    rows = [r for i, t in docs for r in ((100 + i, "other words of no interest"), (i, t))] + [(99, "closing words of no interest")]
    got = {r.doc_id: r for r in D.contaminated(frame(spark, rows).coalesce(1).orderBy("doc_id"), items).collect()}
    most = D.budget(len(text))
    assert set(got) == {i for i, t in docs if len(text) - len(t) <= most} and len(got) > 10
    ordered = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)  # each after a document of other words
    assert {r.doc_id for r in D.contaminated(ordered, items).collect()} == set(got)
    assert all(0 <= r.start < r.end <= len(dict(docs)[i]) for i, r in got.items())
