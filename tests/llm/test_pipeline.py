"""Every stage of the pipeline against brute force on its own input."""

import corpus_pipeline as P
from chapterflow.llm import decontaminate, fuzzy_lines, outliers, queries
from chapterflow.llm.common import Scratch
from chapterflow.llm.fragments import tokenizer

from . import test_fuzzy_lines, test_jaccard
from .helpers import AWKWARD, documents, frame


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, sf_dir, monkeypatch):
    docs, columns = documents(spark, sf_dir), documents(spark, sf_dir).columns
    scratch = Scratch(spark, "t")
    given = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.row.doc_id for r in outliers.outliers(docs, scratch).where("kept").collect()}
    one = scratch.store("1", P.quality(spark, docs, sf_dir))
    assert one.columns == columns and rows(one) == sorted((i, given[i]) for i in kept) and len(kept) < len(given)
    two = scratch.store("2", P.line_dedup(spark, one, sf_dir))
    before = rows(one)
    want = test_fuzzy_lines.brute(before)
    assert two.columns == columns and rows(two) == sorted((i, t) for (i, _), t in zip(before, want)) and want != [t for _, t in before]
    assert two.where("n_chars <> length(text)").count() == 0
    three = scratch.store("3", P.near_duplicates(spark, two, sf_dir))
    first = {i for i, _, c in test_jaccard.brute(rows(two), 5, 4, 5) if i == c}
    assert three.columns == columns and rows(three) == [r for r in rows(two) if r[0] in first]
    # copies whole, for the stage on input of its own
    copies = docs.unionByName(docs.withColumn("doc_id", docs["doc_id"] + 100_000))
    assert {r.doc_id for r in P.near_duplicates(spark, copies, sf_dir).collect()} == {i for i, _, c in test_jaccard.brute(rows(docs), 5, 4, 5) if i == c}
    four = scratch.store("4", P.decontamination(spark, three, sf_dir))
    benchmark = [decontaminate.normalised(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {i for i, t in rows(three) if any(b in decontaminate.normalised(t) for b in benchmark)}
    left = {i for i, _ in rows(four)}
    assert four.columns == columns and leaks and not leaks & left and len(left) > 0.8 * (three.count() - len(leaks))
    t = tokenizer(queries.BYTE_BPE)
    five = {r.doc_id: (r.n_tokens, list(r.ids)) for r in P.encoding(spark, four, sf_dir).collect()}
    assert five == {i: (len(e), e) for i, e in ((i, t.encode(x, add_special_tokens=False).ids) for i, x in rows(four))}


def test_awkward_and_empty(spark, sf_dir):
    for given in ([], AWKWARD):
        docs = frame(spark, given)
        for _, stage in P.STAGES[:4]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == frame(spark, []).columns
        assert P.encoding(spark, docs, sf_dir).count() == docs.count()
    assert fuzzy_lines.deduplicated(frame(spark, []), Scratch(spark, "t")).count() == 0
