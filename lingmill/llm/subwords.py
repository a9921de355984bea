"""Subword ids by files of the `tokenizers` library, with what was encoded before kept at hand."""

from __future__ import annotations

import json
import os
from array import array
from itertools import chain, filterfalse

import numpy as np
import regex

#: Runs, and parts of runs, whose ids a Python worker keeps.
KEPT = 300_000
#: Kinds of tokenizer files: (what stands before each run, how a run splits, whether the file lower-cases).
LOWER_WORDS = ("", regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"), True)
BYTE_LEVEL = (" ", regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"), False)
_MADE: dict[tuple, Ids] = {}
#: Stands for the mark at a word's end; no text in UTF-8 has this byte.
END = b"\xff"


def byte_characters() -> dict[str, int]:
    """Byte-level files write printable bytes as themselves, the other ones as the characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def merges_by_rank(path: str):
    """The file's pair merging on bytes, without its Unicode steps: a function from a part's bytes to its ids.

    The pair whose union has the smallest id is merged first. That is the file's own order of merges, as ids follow
    it; and a union is made of the same two halves everywhere, since each token's own bytes encode to that token
    (a test holds every token of both files to this).
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix, table, ranks = model.get("end_of_word_suffix") or "", byte_characters(), {}
    for token, i in model["vocab"].items():
        body = token.removesuffix(suffix) if suffix else token
        if all(c in table for c in body):
            ranks[bytes(table[c] for c in body) + (END if len(body) < len(token) else b"")] = i
    end = END if suffix else b""
    piece = tiktoken.Encoding("ranks", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
    return lambda part: piece(part + end)


class Ids:
    """Ids of texts by a `tokenizers` file, white-space-free run by run; LOWER_WORDS drops white space, BYTE_LEVEL folds it to one space before each run.

    Each run without white space is looked up; a new one is split as the file splits it, and its parts are merged
    (see merges_by_rank). What is kept is bounded in number. Runs with characters from U+0250 on, or that may hold a
    special token, are encoded whole by the library; so are texts with the characters that str.split() takes for
    white space and the file doesn't.
    """

    def __init__(self, path: str, kind: tuple):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.merge, self.runs, self.parts = Tokenizer.from_file(path), merges_by_rank(path), {}, {}
        self.before, self.split, self.lower = kind
        self.tokenizer.encode_special_tokens = not self.lower

    @staticmethod
    def of(path: str, kind: tuple) -> Ids:
        """One for each Python worker and file."""
        if (path, kind[0]) not in _MADE:
            _MADE[path, kind[0]] = Ids(path, kind)
        return _MADE[path, kind[0]]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for a in range(0, len(texts), 2048) for e in self.tokenizer.encode_batch_fast(texts[a : a + 2048], add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if self.lower:  # fewer kinds of runs; other letters' cases may depend on what stands around them
            texts = [t.lower() if t.isascii() or max(t) < "\u0130" else t for t in texts]
        odd = [self.lower and any(c in t for c in "\x1c\x1d\x1e\x1f") for t in texts]
        return [np.frombuffer(self._encode([t])[0], "<u4") if o else x for t, o, x in zip(texts, odd, self.of_runs([[] if o else t.split() for t, o in zip(texts, odd)]))]

    def of_runs(self, split: list[list[str]]) -> list[np.ndarray]:
        added = self._learn(set(chain.from_iterable(filterfalse(self.runs.__contains__, x) for x in split)))
        out = [np.frombuffer(b"".join(map(self.runs.__getitem__, x)), "<u4") for x in split]
        self._forget(added)
        return out

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each run has, and all ids in a row."""
        added = self._learn({w for w in words if w not in self.runs})
        found = [*map(self.runs.__getitem__, words)]
        self._forget(added)
        return np.array([*map(len, found)], np.int64) // 4, np.frombuffer(b"".join(found), "<u4")

    def _part(self, part: str) -> bytes:
        if (found := self.parts.get(part)) is None:
            found = array("I", self.merge(part.encode())).tobytes()
            if len(self.parts) < KEPT // 8:  # the first ones are the common ones
                self.parts[part] = found
        return found

    def _learn(self, new: set[str]) -> list[str]:
        runs, before, lower, merge, whole = self.runs, self.before, self.lower, self.merge, []
        for r in new:
            if not r.isascii() and max(r) >= "\u0250" or lower and "<|" in r:
                whole.append(r)
                continue
            x = before + (r.lower() if lower and not r.islower() else r)
            runs[r] = array("I", merge(x.encode())).tobytes() if x.isalpha() or before and r.isalpha() else b"".join(map(self._part, self.split.findall(x)))
        runs.update(zip(whole, self._encode([before + r for r in whole])))
        return list(new)

    def _forget(self, new: list[str]) -> None:
        for x in new[max(0, len(new) - max(0, len(self.runs) - KEPT)) :]:
            del self.runs[x]
