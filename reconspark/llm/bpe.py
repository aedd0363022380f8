"""Byte-level BPE ids, equal to those of the `tokenizers` library for the same file, word by word with a bounded memory."""

from __future__ import annotations

import functools
import json
import re
import struct

import numpy as np
import tiktoken

#: How byte-level BPE cuts text before merging. Fixed value of this kind of vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNCLEAN = re.compile(r"\s\s")
CLEAN_SPACE = re.compile(r"(?<=\S) (?=\S)")
LONGEST_KEPT, MOST_KEPT = 48, 300_000
#: White space as Unicode has it; a run of so many is cut out by hand, since the pattern's look-ahead steps back over all of it.
LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(bytes of a token -> id, special token -> id) of a `tokenizers` file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    letters = byte_letters()
    return {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}, special


@functools.cache
def encoding(path: str) -> tiktoken.Encoding:
    ranks, special = vocabulary(path)
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


class Ids(dict):
    """Little-endian 32-bit ids of a piece of text that starts and ends at a clean space."""

    def __init__(self, path: str):
        self.encoding = encoding(path)
        self.special = tuple(self.encoding.special_tokens_set)
        self.held = re.compile("|".join(map(re.escape, self.special))).search if self.special else None

    def __missing__(self, piece: str) -> bytes:
        special = self.held(piece) if self.held else None
        ids = self.encoding.encode(piece, allowed_special="all") if special else self.encoding.encode_ordinary(piece)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST_KEPT:
            if len(self) > MOST_KEPT:
                self.clear()
            self[piece] = out
        return out

    def of(self, text: str | None) -> bytes:
        """A single space between other characters always starts a token, so the pieces between such spaces are independent."""
        if not text:
            return b""
        if len(text) >= 10_000 and (run := LONG_SPACE.search(text)):
            return self._around(text, run)
        first, *rest = CLEAN_SPACE.split(text) if UNCLEAN.search(text) else text.split(" ")
        get = self.__getitem__
        return (get(first) if first else b"") + b"".join([get(" " + x) for x in rest])

    def _around(self, text: str, run: re.Match) -> bytes:
        """A run of white space is one piece, but for its last character where other text follows (no special token)."""
        out, at = [], 0
        while run:
            end = run.end() if run.end() == len(text) or text.startswith(self.special, run.end()) else run.end() - 1
            own = self.encoding._encode_single_piece(text[run.start() : end])
            out += [self.of(text[at : run.start()]), np.array(own, "<u4").tobytes()]
            at, run = end, LONG_SPACE.search(text, run.end())
        return b"".join([*out, self.of(text[at:])])
