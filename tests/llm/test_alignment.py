"""The alignment against both libraries on whole texts, all token pairs compared by their bytes."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from chapterflow.llm import alignment, queries
from chapterflow.llm.bpe import byte_letters
from chapterflow.llm.common import Scratch

from .helpers import AWKWARD, frame, pairs

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPACES = "  \t\n\r\x0b\x0c\x1c\x1f\x85\xa0    　"


def tokens(texts):
    """(id, bytes) lists of both libraries for space and text; None where one does not give the bytes back."""
    byte, piece = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    byte.encode_special_tokens = True
    letters = byte_letters()
    out = []
    for t in texts:
        a = [(i, bytes(letters[c] for c in byte.id_to_token(i))) for i in byte.encode(" " + t, add_special_tokens=False).ids]
        b = []
        for i in piece.encode(t):
            name = piece.id_to_piece(i)
            b.append((i, bytes([int(name[3:5], 16)]) if piece.is_byte(i) else name.replace("▁", " ").encode()))
        whole = (" " + t).encode()
        out.append((a, b) if t and b"".join(x for _, x in a) == whole and b"".join(x for _, x in b) == whole else None)
    return out


def ranges(ids):
    out, at = [], 0
    for i, x in ids:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(rows):
    linked, told = [], []
    for found in tokens([t or "" for _, t in rows]):
        if found is None:
            linked.append([])
            told.append((0, 0, 0, ""))
            continue
        a, b = map(ranges, found)
        links, at = [], 0
        for i, lo, hi in a:
            while b[at][2] <= lo:
                at += 1
            for j, lo2, hi2 in b[at:]:
                if lo2 >= hi:
                    break
                links.append((i, j))
        common = sorted({hi for *_, hi in a} & {hi for *_, hi in b})
        groups, lo, sides = [], 0, [(side, [x for _, x, _ in side]) for side in (a, b)]
        for hi in common:
            groups.append("|".join(",".join(str(i) for i, _, _ in side[bisect_left(starts, lo) : bisect_left(starts, hi)]) for side, starts in sides))
            lo = hi
        linked.append(links)
        told.append((len(a), len(b), len(common), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(p for links in linked for p in set(links))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(n, best.get(i, 0))
    return sorted(
        ((i, na, nb, ng, len(ls), sum(counts[p] == best[p[0]] for p in ls), sum(counts[p] for p in ls), sha) for (i, _), ls, (na, nb, ng, sha) in zip(rows, linked, told)), key=str
    )


def got(spark, rows, **options):
    return sorted((tuple(r) for r in alignment.alignments(frame(spark, rows), A, B, Scratch(spark, "t"), **options).collect()), key=str)


@pytest.mark.parametrize("block_bytes", [4 << 20, 100])
def test_awkward_documents(spark, block_bytes):
    rows = [*AWKWARD, (10, "a▁b c"), (11, " lead"), (12, "trail "), (13, "it's  two   spaces"), (14, "</s> <s> <unk> <0x0A> �"), (15, "x;\r\ny ();\r z\t q"), (16, "naïve 中文字 mid▁"), (17, "\x00 \x7f")]
    assert got(spark, rows, block_bytes=block_bytes) == brute(rows)
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, "")]) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_random_documents(spark):
    rng = random.Random(5)
    words = ["the", "Straße", "naïve", "ab12", "don't", "{", "});", "中文", "😀", "á", "...", "<|endoftext|>", "▁", "e"]
    rows = [(i, "".join(rng.choice(words) if rng.random() < 0.6 else rng.choice(SPACES) * rng.randint(1, 3) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    assert got(spark, rows) == brute(rows)


def test_fragments_give_the_tokens_of_whole_texts():
    rng, aligner = random.Random(8), alignment.Aligner(A, B)
    byte, piece = alignment.byte_level(A), alignment.pieces(B)
    for _ in range(3000):
        t = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x3000, 0x30FF), *map(ord, SPACES)])) for _ in range(rng.randint(1, 25)))
        fragments = aligner.fragments(t.encode())
        assert b"".join(b" " + f for f in fragments).decode() == " " + t
        assert [i for ids in aligner.byte_ids(fragments) for i in ids] == byte.encode(" " + t, add_special_tokens=False).ids
        assert [i for ids in aligner.piece_ids(fragments) for i in ids] == piece.encode(t)
        random.shuffle(fragments)  # fragments meet other neighbours when they are encoded together
        assert aligner.byte_ids(fragments) == [byte.encode(" " + f.decode(), add_special_tokens=False).ids for f in fragments]


def test_links_are_the_overlaps_of_each_group():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 30)
        ends = [sorted({n, *(rng.randint(1, n) for _ in range(rng.randint(0, n)))}) for _ in range(2)]
        want = {(i, j) for i, e in enumerate(ends[0]) for j, f in enumerate(ends[1]) if max(([0] + ends[0])[i], ([0] + ends[1])[j]) < min(e, f)}
        assert [x for g in alignment.groups(*ends) for x in alignment.links(*ends, *g)] == sorted(want)


def test_forgetting(spark, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 2)
    rows = [(i, f"w{i} x y z {i % 3} w{i}") for i in range(30)]
    assert got(spark, rows, block_bytes=20) == brute(rows)


def test_a_very_long_text(spark):
    rows = [(1, "lorem ipsum\n" * 400_000), (2, "z" * 200_000)]
    (one, two) = got(spark, rows)
    byte, piece = tokens(["lorem ipsum\nlorem ipsum\n"])[0]
    assert one[1] == 400_000 * len(byte) // 2 and one[4] == one[5] and two[1] > 0


def test_pairs(spark):
    found = {(r.a, r.b): r.documents for r in alignment.pairs(frame(spark, [(1, "the the cat"), (2, "the"), (None, ""), (3, None)]), A, B).collect()}
    (a, b), *_ = [(x[0][0], y[0][0]) for x, y in tokens(["the"])]
    assert found[a, b] == 2 and sum(found.values()) >= 3


def test_query(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    assert sorted((tuple(r) for r in queries.op13_alignment(spark, sf_dir).collect()), key=str) == brute(rows)
