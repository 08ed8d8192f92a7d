"""Token counts, encoding and sequence files against the libraries."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from chapterflow.llm import bpe, fragments, queries, sequences, token_counts
from chapterflow.llm.fragments import tokenizer

from .helpers import AWKWARD, frame, pairs


@pytest.fixture(scope="module")
def word():
    return tokenizer(queries.WORD_BPE)


@pytest.fixture(scope="module")
def byte():
    return tokenizer(queries.BYTE_BPE)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_are_the_librarys(spark, sf_dir, word):
    want = {(i, len(t.encode()), n := len(ids_of(word, t)), n > 2048) for i, t in pairs(spark, sf_dir)}
    assert {tuple(r) for r in queries.op1_token_counts(spark, sf_dir).collect()} == want


def test_counts_of_awkward_texts_and_hits(spark, tmp_path, word, monkeypatch):
    cache = str(tmp_path / "cache")
    want = sorted(((i is None, i), len((t or "").encode()), len(ids_of(word, t))) for i, t in AWKWARD)

    def got(rows):
        return sorted(((r[0] is None, r[0]), r[1], r[2]) for r in token_counts.token_counts(frame(spark, rows), queries.WORD_BPE, cache).collect())

    assert got(AWKWARD) == want
    stored = token_counts.stored_counts(spark, cache, token_counts.version(queries.WORD_BPE))
    assert stored.count() == len({" ".join((t or "").encode().split().__str__()) for _, t in AWKWARD})
    files = sorted(os.listdir(f"{cache}/tokenizer={token_counts.version(queries.WORD_BPE)}"))
    before = spark.read.parquet(cache).count()
    assert got([*AWKWARD, (90, "one  two\nthree"), (91, "not yet stored")])[-3:-1] == [((False, 90), 14, 3), ((False, 91), 14, 3)]
    assert spark.read.parquet(cache).count() == before + 1  # the new content alone was encoded
    assert set(files) < set(os.listdir(f"{cache}/tokenizer={token_counts.version(queries.WORD_BPE)}"))
    monkeypatch.setattr(token_counts, "SETTINGS", "other")
    assert got(AWKWARD) == want  # another version has counts of its own
    assert token_counts.token_counts(frame(spark, []), queries.WORD_BPE, cache).count() == 0


def test_encoding_round_trip(spark, sf_dir, byte):
    def row(i, t):
        ids = ids_of(byte, t)
        text = byte.decode(ids, skip_special_tokens=False)
        return i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    assert {tuple(r) for r in queries.op2_bpe(spark, sf_dir).collect()} == {row(i, t) for i, t in pairs(spark, sf_dir)}


def test_encoding_of_awkward_texts(spark, byte):
    got = bpe.decode(bpe.encode(frame(spark, AWKWARD), queries.BYTE_BPE), queries.BYTE_BPE).collect()
    want = [(i, ids_of(byte, t), t or "") for i, t in AWKWARD]
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))
    assert bpe.encode(frame(spark, []), queries.BYTE_BPE).count() == 0
    broken = spark.createDataFrame([([220, 447],), (None,)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(broken, queries.BYTE_BPE).collect()] == [byte.decode([220, 447], skip_special_tokens=False), None]


def test_cuts_are_forced(byte):
    inner, cut = bpe.inner_pairs(queries.BYTE_BPE), bpe.cutter(queries.BYTE_BPE)
    text = "it's  a \n\n test\xa0 of   cuts, 12 34 ! ? \x1c \x85\ny".encode()
    parts = cut(text)
    assert b"".join(parts) == text and len(parts) > 8
    assert not any(inner[a[-1], b[0]] for a, b in zip(parts, parts[1:]))


def test_sequences(spark, sf_dir, word):
    at, want = 0, set()
    for i, t in sorted(pairs(spark, sf_dir)):
        ids = [*ids_of(word, t), 2]
        want.add((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert {tuple(r) for r in queries.op6_sequences(spark, sf_dir).collect()} == want


def test_sequence_files(spark, tmp_path, word):
    folder = f"file://{tmp_path}/out"
    manifest = sequences.write_sequences(frame(spark, AWKWARD).coalesce(1), queries.WORD_BPE, folder, length=16, batch_rows=2).collect()
    rows = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    stream = [i for _, t in rows for i in [*ids_of(word, t), 2]]
    found = []
    for m in sorted(manifest):
        file = sequences.SequenceFile(m.ids_file)
        n = -(-m.n_ids // 16)
        ids = np.concatenate([file.sequence(k) for k in range(n)])
        mask = np.concatenate([file.mask(k) for k in range(n)])
        assert len(ids) == 16 * n and mask.sum() == m.n_ids and not ids[~mask].any()
        assert file.sequence(0).base is not None and isinstance(file.source, pa.MemoryMappedFile)
        assert (file.slice(5, min(70, m.n_ids - 5)) == ids[5 : min(75, m.n_ids)]).all()
        found += ids[mask].tolist()
    assert found == stream
    starts = {r.start for r in sequences.read_documents(spark, folder).collect()}
    assert starts == set(np.cumsum([0, *(len(ids_of(word, t)) + 1 for _, t in rows)])[:-1].tolist())
    empty = sequences.write_sequences(frame(spark, []), queries.WORD_BPE, f"{tmp_path}/none")
    assert empty.count() == 0 and sequences.read_documents(spark, f"{tmp_path}/none").count() == 0


def test_joined_words_have_their_own_ids():
    """Words encoded many in one string, against each on its own."""
    rng = random.Random(12)
    alphabet = [*"abcXYZ'|.-12é€Σςß́", "ﬀ", "İ", "中", "😀", "s", "'ll", "</w>", "<|endoftext|>", "｜", "¦", "\x1c", "\xa0", "　"]
    words = list({"".join(rng.choices(alphabet, k=rng.randint(1, 8))).encode() for _ in range(20_000)})
    words = [w for w in words if w.split() == [w]]
    memo = fragments.Memo(queries.WORD_BPE, tuple, separator="|")
    assert memo.separator == b"|" and [tuple(map(int, x)) for x in memo.lookup(words)] == list(fragments.Memo(queries.WORD_BPE, tuple).lookup(words))


def test_words_in_pieces(monkeypatch):
    """Words cut into marks and letters, against each on its own; every letter that is taken to pieces, also from a memo that was full."""
    rng = random.Random(13)
    letters = [c for c in map(chr, range(0x250)) if re.fullmatch(f"[{fragments.LETTERS}]", c)]
    marks = [c for c in map(chr, range(128)) if re.fullmatch(f"[{fragments.MARKS}]", c)]
    words = ["".join(rng.choices(letters + marks, k=rng.randint(1, 6))) for _ in range(5_000)] + letters + marks + ["ab" * 50, "...", "(Word).", "don't", "x1", "<|endoftext|>.", "e\u0301.", "\u0130x", "\u03a3\u03a3"]
    words += ["".join(rng.choices("aeThnr", k=rng.randint(1, 9))) + rng.choice(["", ".", ",", "!?"]) for _ in range(5_000)]
    words = [w.encode() for w in words]
    want = [np.array(x, np.uint16).tobytes() for x in fragments.Memo(queries.WORD_BPE, tuple).lookup(words)]
    assert len(letters) > 100 and len(marks) > 20 and fragments.piece_tokenizer(queries.WORD_BPE) and not fragments.piece_tokenizer(queries.BYTE_BPE)
    monkeypatch.setattr(fragments, "REMEMBERED", 700)
    memo = fragments.Words(queries.WORD_BPE, np.dtype(np.uint16))
    for at in range(0, len(words), 100):
        some = words[at : at + 100]
        assert memo.joined([some[:30], [], some[30:]]) == [b"".join(want[at : at + 30]), b"", b"".join(want[at + 30 : at + 100])]
        assert len(memo.known) < 1_500 and max(map(len, memo.known)) <= fragments.LONGEST
    encoded, run = [], memo._encode
    monkeypatch.setattr(memo, "_encode", lambda pieces: (encoded.extend(pieces), run(pieces)))
    memo.joined([[b"Zebrafinch", b"zebrafinch."], [b"(ZEBRAFINCH)", b"zebrafinch"]])
    memo.joined([[b"zebraFinch."]])
    assert encoded.count(b"zebrafinch") == 1 and set(encoded) <= {b"zebrafinch", b".", b"(", b")"}  # marks and capitals are not encoded anew
    other = fragments.Words(queries.BYTE_BPE, np.dtype(np.uint32))
    assert other.joined([words[:50]]) == [b"".join(np.array(x, np.uint32).tobytes() for x in fragments.Memo(queries.BYTE_BPE, tuple).lookup(words[:50]))]


@pytest.mark.parametrize("uri", ["hdfsx://host/a", "dbfs:/a", "abc+d:/x/y"])
def test_unknown_stores_are_refused(uri):
    with pytest.raises(Exception):
        sequences._place(uri)


def test_local_folders():
    assert [sequences._place(u)[1] for u in ("/a/b", "file:/a/b", "file:///a/b")] == ["/a/b"] * 3
