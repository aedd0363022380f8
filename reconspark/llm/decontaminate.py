"""Benchmark decontamination: pigeonhole pieces find candidates, Myers' bit-parallel distance verifies them.

An item of n words may be edited in a share of them. Split into budget + 1 pieces, at least one piece is free of edits, so
every passage within the budget holds a piece word for word. The documents' word runs are looked up among the pieces,
and around each hit the distance of the whole item to the best-fitting stretch is computed, a machine word of bits (or more) at once.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconspark.llm.common import mixed

WORD = re.compile(r"\w+")
SHARE, LONGEST_PIECE, ITEMS_AT_ONCE, FILTER_BITS = 0.2, 4, 20_000, 22
#: Bytes that the bit masks of a block's items take at most, but for a single item of more.
MASK_BYTES = 64 << 20


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


def tokens(text: str | None, known: Hashes) -> np.ndarray:
    """Hashes of the words ``\\w+`` in lower case."""
    w = WORD.findall(text.lower()) if text else []
    return np.fromiter(map(known.__getitem__, w), np.uint64, len(w))


def runs(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of so many words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return mixed(reduce(lambda h, k: mixed(h) + words[k : k + n], range(1, length), words[:n]), length)


class Item:
    """An item's words, its budget of edits and the runs that start its pieces."""

    def __init__(self, item_id: int, words: np.ndarray, share: float):
        self.id, self.words, self.n = item_id, words.tolist(), len(words)
        self.budget = int(share * self.n + 1e-9)
        size, more = divmod(self.n, self.budget + 1)
        self.size = min(size, LONGEST_PIECE)
        self.starts = [i * size + min(i, more) for i in range(self.budget + 1)]
        self.keys = runs(words, self.size)[self.starts].tolist() if self.n else []
        self.masks = self._masks(self.words)
        self.mirrored = self._masks(self.words[::-1])

    @staticmethod
    def _masks(words: list[int]) -> dict[int, int]:
        out: dict[int, int] = defaultdict(int)
        for i, w in enumerate(words):
            out[w] |= 1 << i
        return dict(out)


def least_distance(masks: dict[int, int], n: int, text: list[int], anchored: bool = False) -> tuple[int, int]:
    """(least edit distance of an item of n words to a stretch of the text, words read when it is first reached).

    Stretches may start anywhere, or, anchored, at the text's first word only. Myers' recurrence: one bit for each word of the item.
    """
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best, at = full, 0, n, n, 0
    for j, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        across = (((eq & plus) + plus) ^ plus) | eq
        down = eq | minus
        up, low = minus | (full & ~(across | plus)), plus & across
        score += 1 if up & top else -1 if low & top else 0
        up, low = (up << 1) | anchored, low << 1
        plus, minus = full & (low | ~(down | up)), full & up & down
        if score < best:
            best, at = score, j
    return best, at


class Index:
    """The pieces of a block of items."""

    def __init__(self, items: list[Item]):
        self.items = [x for x in items if x.n]
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, dict[int, list[tuple[int, int]]]]] = {}
        for size in sorted({x.size for x in self.items}):
            found: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for k, x in enumerate(self.items):
                if x.size == size:
                    for start, key in zip(x.starts, x.keys, strict=True):
                        found[key].append((k, start))
            keys = np.array(sorted(found), np.uint64)
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[keys & np.uint64((1 << FILTER_BITS) - 1)] = True
            self.by_size[size] = (keys, bits, dict(found))

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item, its budget, distance, first word, words) of each item within its budget: its best stretch, the first of equal ones."""
        places: dict[int, set[int]] = defaultdict(set)
        for size, (keys, bits, found) in self.by_size.items():
            own = runs(words, size)
            near = np.flatnonzero(bits[own & np.uint64((1 << FILTER_BITS) - 1)])
            at = np.searchsorted(keys, own[near])
            at[at == len(keys)] = 0
            for p in near[keys[at] == own[near]].tolist():
                for k, start in found[int(own[p])]:
                    places[k].add(p - start)
        out = []
        for k, starts in places.items():
            item, best = self.items[k], None
            low = high = None
            for s in [*sorted(starts), None]:  # hits whose stretches overlap are verified together
                a, b = (max(0, s - item.budget), s + item.n + item.budget) if s is not None else (None, None)
                if low is not None and (s is None or a > high):
                    best = min(filter(None, (best, self._verify(item, words, low, high))), default=None)
                    low = None
                if s is not None:
                    low, high = (a, b) if low is None else (low, b)
            if best:
                out.append((item.id, item.budget, *best))
        return out

    @staticmethod
    def _verify(item: Item, words: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
        text = words[low:high].tolist()
        distance, end = least_distance(item.masks, item.n, text)
        if distance > item.budget:
            return None
        _, back = least_distance(item.mirrored, item.n, text[:end][::-1], anchored=True)
        return distance, low + end - back, back


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(doc_id, item_id, budget, distance, first_word, n_words): a row for each document and item it holds.

    An item is held if a stretch of the document's words differs from it by at most share of its words (inserted, dropped
    or replaced). Items are a stated query set: they are read in blocks of about `items_at_once` and of about MASK_BYTES (an item's masks grow
    with the square of its words), each compared with all documents, so what a task holds is bounded. Null and wordless items and documents match nothing; repeated documents repeat their
    rows; repeated items with one id count as one text each. Other columns are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    words = F.size(F.split("text", "\\s+")).cast("double")
    many, masks = items.agg(F.count("*"), F.coalesce(F.sum(words * words / 4), F.lit(0.0))).first()
    blocks = max(1, -(-many // items_at_once), math.ceil(masks / MASK_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = []
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        known = Hashes()
        index = spark.sparkContext.broadcast([(r["item_id"], tokens(r["text"], known)) for r in sorted(own.collect())])
        parts.append(rows.mapInArrow(_search(index, share), "doc_id long, item_id long, budget int, distance int, first_word long, n_words long"))
    return reduce(DataFrame.unionByName, parts)


def _search(items, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = Index([Item(i, w, share) for i, w in items.value]), Hashes()
        for b in batches:
            out = [(doc.as_py(), *m) for doc, text in zip(b.column(0), b.column(1), strict=True) for m in index.matches(tokens(text.as_py(), known))]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "budget", "distance", "first_word", "n_words"])

    return run
