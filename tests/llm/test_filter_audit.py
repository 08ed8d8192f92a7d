"""The audit against every order run one document at a time, and against SQL."""

import re
from itertools import permutations
from math import factorial

import duckdb
import pytest

from chapterflow.llm import filter_audit, queries

from .helpers import AWKWARD

LETTERS = "ABCDE"


def brute(rows, labels):
    """Runs all orders over (id, text, part) and returns the rows of the audit."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = {}
    for i, t, p in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and first[t] < i)
        own = [x for j, *x in labels if j == i and i is not None]
        parts.setdefault(p or "", []).append(({c for c, f in zip(LETTERS, fails) if f}, any(q == 1 for q, _ in own), any(x == 1 for _, x in own)))
    out = {}
    for part, docs in parts.items():
        total = dict.fromkeys(LETTERS, 0)
        for order in permutations(LETTERS):
            left = docs
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def got(spark, rows, labels):
    full = [(i, t, p, "s", 1, 7, "x", "y", "z") for i, t, p in rows]
    docs = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, part bigint, mask string, n string, digest string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    return {tuple(r) for r in filter_audit.audit(filter_audit.masks(docs, known), LETTERS).collect()}


@pytest.mark.parametrize("n", [1, 3, 5])
def test_ranks_of_a_prefix_lie_side_by_side(n):
    orders = list(permutations(range(n)))
    for k in range(n + 1):
        for prefix in permutations(range(n), k):
            at = filter_audit.lehmer_rank(prefix, n)
            assert [o for o in orders if o[:k] == prefix] == orders[at : at + factorial(n - k)]


def test_against_all_orders(spark):
    many = " ".join(f"w{k}" for k in range(300))
    rows = [(i, t, "en") for i, t in AWKWARD]
    rows += [(20, many, "de"), (21, many, "de"), (22, many, None), (20, many, "fr"), (None, many, "de"), (23, many + " $", ""), (24, many.upper(), "de"), (25, "ab " * 400, "de")]
    rows += [(26, (many + " & ") * 3, "fr"), (19, many, "fr"), (27, "x" * 40 + "#", "fr"), (28, "é\x1cÀ \x85 b", "fr")]
    labels = [(20, 1, 0), (20, 0, 1), (21, None, None), (22, 1, 1), (24, 0, 1), (None, 1, 1), (99, 1, 1), (5, 1, 0), (26, 1, None)]
    assert got(spark, rows, labels) == brute(rows, labels)


def test_no_documents(spark):
    assert got(spark, [], [(1, 1, 1)]) == set() and got(spark, [(1, None, None)], []) == brute([(1, None, None)], [])


def test_one_very_long_text(spark):
    rows = [(1, "lorem ipsum " * 1_700_000, "en"), (2, "x" * 20_000_000, "en")]
    assert got(spark, rows, []) == brute(rows, [])


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    want, found = con.sql(queries.ORACLES["op11_filter_audit"]), queries.op11_filter_audit(spark, sf_dir)
    assert {tuple(r) for r in found.select(*want.columns).collect()} == set(want.fetchall())
