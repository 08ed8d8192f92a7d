"""Token ids of a text, one remembered fragment at a time."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from pathlib import Path

import numpy as np

#: Fragments that a memo remembers, the longest one it remembers, in bytes, and fragments encoded in one string.
REMEMBERED, LONGEST, TOGETHER = 500_000, 64, 500
#: Letters that composition leaves alone and that are one letter in lower case, and marks: the words that ``Words`` takes to pieces.
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e", re.escape(".,;:!?\"()[]{}*#$%&@/=+~^`_-")
#: The steps of a tokenizer whose words can be taken to pieces.
FOLDS = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTS = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
LEVELS = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer, without truncation and padding; loaded once a process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Memo:
    """What ``make`` gives for the ids of each fragment, remembered for short fragments.

    ``lookup`` serves one text: a fragment that is not known is encoded by the
    library, all unknown ones of the text in one call. With a ``separator``,
    a string that the library turns into one id between any two words, they
    are joined to few strings and their ids told apart at that id; fragments
    that hold the separator are left out of that. Memory is bounded: the memo
    starts anew when it is full.
    """

    def __init__(self, path: str, make: Callable[[list[int]], object], separator: str | None = None):
        self.library, self.make, self.known = tokenizer(path), make, {}
        own = [] if separator is None else self._encoded([separator])[0]
        self.separator, self.cut = (separator.encode(), own[0]) if len(own) == 1 else (None, None)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, fragments: list[bytes]) -> list:
        """Ids of fragments."""
        if self.separator is None or len(fragments) < 2:
            return self._encoded([f.decode() for f in fragments])
        out: list = [None] * len(fragments)
        joined = [k for k, f in enumerate(fragments) if self.separator not in f]
        for part in (joined[k : k + TOGETHER] for k in range(0, len(joined), TOGETHER)):
            ids = np.array(self._encoded([f" {self.separator.decode()} ".join([fragments[k].decode() for k in part])])[0], np.int64)
            cuts = np.flatnonzero(ids == self.cut).tolist()
            if len(cuts) == len(part) - 1:
                for k, lo, hi in zip(part, [-1, *cuts], [*cuts, len(ids)], strict=True):
                    out[k] = ids[lo + 1 : hi]
        alone = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(alone, self._encoded([fragments[k].decode() for k in alone]), strict=True):
            out[k] = ids
        return out

    def lookup(self, fragments: list[bytes]) -> Iterable:
        known = self.known
        missing = [f for f in set(fragments) if f not in known]
        own = {}
        if missing:
            if len(known) > REMEMBERED:
                known.clear()
                missing = list(set(fragments))
            for f, ids in zip(missing, self.encode(missing), strict=True):
                (known if len(f) <= LONGEST else own)[f] = self.make(ids)
        if own:
            return [own[f] if f in own else known[f] for f in fragments]
        return map(known.__getitem__, fragments)


@lru_cache(maxsize=4)
def piece_tokenizer(path: str):
    """The library's tokenizer for lower-case pieces with a space between them, and which ids end a piece.

    None for a tokenizer of other steps, or one that would find its own
    special strings among letters and marks.
    """
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    told = json.loads(Path(path).read_text(encoding="utf-8"))
    model = told["model"]
    suffix, steps = model.get("end_of_word_suffix"), told["pre_tokenizer"]
    known = told["normalizer"] == FOLDS and steps == {"type": "Sequence", "pretokenizers": [CUTS, LEVELS]} and told["post_processor"] is None
    plain = model["type"] == "BPE" and not model["dropout"] and not model["continuing_subword_prefix"] and suffix and re.search(f"[^{LETTERS}{MARKS}]", suffix)
    if not known or not plain or not all(re.search(f"[^{LETTERS}{MARKS} ]", t["content"]) for t in told["added_tokens"]):
        return None
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    found.normalizer = normalizers.Sequence([])
    found.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ends = np.zeros(1 + max(model["vocab"].values()), bool)
    ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
    return found, ends


class Words:
    """Ids of words without ASCII white space, as bytes of integers of one width; short words are remembered.

    A word that is new is cut into marks, letters and marks, where the
    tokenizer cuts as well; the library encodes pieces that are new, many in
    one string, and their ids are told apart at those that end a piece. Other
    words, and all words of a tokenizer of other steps, are encoded whole.
    Memory is bounded: when the memo is full it is put aside, and what is
    asked for again comes back from there.
    """

    def __init__(self, path: str, width: np.dtype):
        self.width, self.pieces = width, piece_tokenizer(path)
        self.whole = Memo(path, self._bytes, separator="|")
        self.parts = re.compile(f"([{MARKS}]*)([{LETTERS}]*)([{MARKS}]*)").fullmatch
        self.known, self.before = {}, {}

    def _bytes(self, ids) -> bytes:
        return np.array(ids, self.width).tobytes()

    def _recalled(self, words: set[bytes]) -> set[bytes]:
        """The words that are not known, once those put aside are back."""
        missing = words.difference(self.known)
        back = {w: self.before[w] for w in missing if w in self.before} if self.before else {}
        self.known.update(back)
        return missing.difference(back) if back else missing

    def _encode(self, pieces: list[bytes]) -> None:
        library, ends = self.pieces
        size = self.width.itemsize
        for at in range(0, len(pieces), TOGETHER):
            some = pieces[at : at + TOGETHER]
            ids = np.array(library.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.int64)
            cuts = (size * (np.flatnonzero(ends[ids]) + 1)).tolist()
            if len(cuts) == len(some) and cuts[-1] == size * len(ids):
                data = self._bytes(ids)
                self.known.update({p: data[lo:hi] for p, lo, hi in zip(some, [0, *cuts], cuts)})
            else:
                self._encode_whole(some)

    def _encode_whole(self, words: list[bytes]) -> None:
        self.known.update(zip(words, map(self._bytes, self.whole.encode(words)), strict=True))

    def joined(self, texts: list[list[bytes]]) -> list[bytes]:
        """The ids of the words of each text, one after the other."""
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        missing, cut, odd, pieces = self._recalled(set().union(*texts)), {}, [], set()
        for w in missing:
            found = self.parts(w.decode()) if self.pieces else None
            if found:
                cut[w] = own = [x.lower().encode() for x in found.groups() if x]
                pieces.update(own)
            else:
                odd.append(w)
        pieces = self._recalled(pieces)
        if pieces:
            self._encode(list(pieces))
        if odd:
            self._encode_whole(odd)
        known = self.known.__getitem__
        self.known.update({w: b"".join(map(known, own)) for w, own in cut.items()})
        out = [b"".join(map(known, t)) for t in texts]
        for w in {x for new in (missing, pieces) for x in new if len(x) > LONGEST}:
            del self.known[w]
        return out
