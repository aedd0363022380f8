"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots: pieces that start a word and pieces that follow. Every node has a failure link to
the node that stands for what is left of its string after its longest leading pieces are taken off, and how many pieces
those are. Reading a word then takes one step a letter, never looks back and builds no pieces: the count is the sum
of the popped counts.
"""

from __future__ import annotations

import functools
import re
from collections import deque
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconspark.llm.bpe import vocabulary

WORD = re.compile(r"\w+|[^\w\s]")
NONE, FIRST, NEXT = -1, 0, 1
MOST_KEPT = 1_000_000


class Automaton(dict):
    """word -> number of greedy longest-match pieces; 0 if the vocabulary cannot spell it. Words met before are kept up to a bound."""

    def __init__(self, first: Iterable[bytes], following: Iterable[bytes]):
        self.child: list[dict[int, int]] = [{}, {}]
        ends = {self._add(FIRST, p) for p in first if p} | {self._add(NEXT, p) for p in following if p}
        self.fail, self.pops = [NONE] * len(self.child), [0] * len(self.child)
        todo = deque([FIRST, NEXT])
        while todo:  # by depth, so that what a link leads to is known
            up = todo.popleft()
            for letter, node in self.child[up].items():
                todo.append(node)
                if node in ends:
                    self.fail[node], self.pops[node] = NEXT, 1
                    continue
                at, popped = self.fail[up], self.pops[up]
                while at != NONE and letter not in self.child[at]:
                    at, popped = self.fail[at], popped + self.pops[at]
                if at != NONE:
                    self.fail[node], self.pops[node] = self.child[at][letter], popped

    def _add(self, root: int, piece: bytes) -> int:
        at = root
        for letter in piece:
            if letter not in self.child[at]:
                self.child[at][letter] = len(self.child)
                self.child.append({})
            at = self.child[at][letter]
        return at

    def _count(self, word: bytes) -> int:
        at, n, child, fail, pops = FIRST, 0, self.child, self.fail, self.pops
        for letter in word:
            while letter not in child[at]:
                n += pops[at]
                at = fail[at]
                if at == NONE:
                    return 0
            at = child[at][letter]
        while at != NEXT:
            n += pops[at]
            at = fail[at]
            if at == NONE:
                return 0
        return n

    def __missing__(self, word: str) -> int:
        if len(self) > MOST_KEPT:
            self.clear()
        self[word] = out = self._count(word.encode("utf-8", "surrogatepass"))
        return out


@functools.cache
def automaton(path: str) -> Automaton:
    """Of a byte-level vocabulary: a token with a leading space starts a word, one without starts or follows."""
    tokens, _ = vocabulary(path)
    following = [t for t in tokens if not t.startswith(b" ")]
    return Automaton([*following, *(t[1:] for t in tokens if t.startswith(b" "))], following)


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown), a row for each row of docs.

    Words are ``\\w+`` and single other signs; a word that the vocabulary cannot spell counts as one token and is unknown.
    Null and empty texts have no words. Other columns are not read; an empty table gives an empty one.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = automaton(path).__getitem__
        for b in batches:
            rows = []
            for t in b.column(1):
                n = list(map(counts, WORD.findall(t.as_py()))) if t.is_valid else []
                bad = n.count(0)
                rows.append((len(n), sum(n) + bad, bad))
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
