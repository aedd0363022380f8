"""Document fingerprints from prefix polynomial hashes.

A text's code points c are summed to prefix arrays C[i] = c0 + c1 B + ... modulo a prime. Two of these numbers give the
hash of any span, so span equality is a look-up and the longest common extension of two places is found by binary search.

A fingerprint keeps the text's length, the hash of the whole, and the hashes of its prefixes and of its suffixes whose
lengths lie on one geometric grid. Prefix equality is monotone, so the longest common grid prefix of two fingerprints (and
suffix alike) is again found by binary search, without the texts.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Two primes below 2^31 and a base for each: products of residues fit into 64 bits.
PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
PER_OCTAVE, ROWS_AT_ONCE = 8, 256


@functools.cache
def _powers(bits: int, which: int) -> np.ndarray:
    """Powers of the base, by doubling."""
    p, out = np.uint64(PRIMES[which]), np.ones(1, np.uint64)
    for k in range(bits):
        out = np.concatenate([out, out * np.uint64(pow(BASES[which], 1 << k, PRIMES[which])) % p])
    return out


class Prefixes:
    """Prefix arrays of a text under both primes."""

    def __init__(self, text: str):
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n, self.bits = len(c), max(10, len(c).bit_length())
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * _powers(self.bits, k)[: len(c)] % np.uint64(p)) % np.uint64(p)]) for k, p in enumerate(PRIMES)]

    def span(self, start: np.ndarray | int, end: np.ndarray | int) -> np.ndarray:
        """62-bit hashes of spans, independent of where they stand: shifted to the place `2^bits - 1`, then back by a fixed power."""
        start, end = np.atleast_1d(start), np.atleast_1d(end)
        out = []
        for k, p in enumerate(PRIMES):
            q = np.uint64(p)
            raw = (self.sums[k][end] + q - self.sums[k][start]) % q
            top = (1 << self.bits) - 1
            back = np.uint64(pow(pow(BASES[k], top, p), -1, p))
            out.append(raw * _powers(self.bits, k)[top - start] % q * back % q)
        return (out[0] << np.uint64(31)) | out[1]

    def common_extension(self, at: int, other: Prefixes, there: int) -> int:
        """The length of the longest common run from two places, by binary search."""
        low, high = 0, min(self.n - at, other.n - there)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(at, at + mid)[0] == other.span(there, there + mid)[0]:
                low = mid
            else:
                high = mid - 1
        return low


#: Lengths 1, 2, ... that grow by 2^(1/8) in the long run.
GRID = np.array(sorted({math.floor(2 ** (k / PER_OCTAVE)) for k in range(40 * PER_OCTAVE)}), np.int64)


def grid(n: int) -> np.ndarray:
    return GRID[: np.searchsorted(GRID, n, "right")]


def fingerprint(text: str | None) -> str:
    """Hexadecimal: 12 digits of length, 16 of the whole text's hash, 8 for each grid prefix, then 8 for each grid suffix."""
    p = Prefixes(text or "")
    g = grid(p.n)
    zero = np.zeros(len(g), np.int64)
    low = np.uint64(0xFFFFFFFF)
    ends = np.concatenate([p.span(zero, g), p.span(p.n - g, zero + p.n)]) & low
    return f"{p.n:012x}{int(p.span(0, p.n)[0]):016x}{ends.astype('>u4').tobytes().hex()}"


def _parts(print_: str) -> tuple[int, str, str, str]:
    n = int(print_[:12], 16)
    half = 28 + 8 * len(grid(n))
    return n, print_[12:28], print_[28:half], print_[half:]


def _common(a: str, b: str) -> int:
    """How many leading 8-digit entries agree; the entries are hashes of nested spans, so agreement is monotone."""
    low, high = 0, min(len(a), len(b)) // 8
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[8 * mid - 8 : 8 * mid] == b[8 * mid - 8 : 8 * mid] else (low, mid - 1)
    return low


def likeness(a: str, b: str) -> float:
    """The share of the longer text that the longest common grid prefix and suffix cover; 1 for equal texts, both empty included."""
    (n, whole, head, tail), (m, other, head2, tail2) = _parts(a), _parts(b)
    if n == m and whole == other:
        return 1.0
    if not n or not m:
        return 0.0
    g = grid(max(n, m))
    first, last = _common(head, head2), _common(tail, tail2)
    shared = (int(g[first - 1]) if first else 0) + (int(g[last - 1]) if last else 0)
    return min(shared, n, m) / max(n, m)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the first of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bounds(rows: DataFrame, parts: int) -> list[tuple[int | None, int]]:
    """At most about `parts` bounds (id, hash), null ids first: quantiles of the ids. An id that fills several ranges, null too, is cut
    evenly by the hash of the text."""
    n, empty = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    cut = lambda m: [-(2**63) + j * 2**64 // m for j in range(1, m)]
    found: list[tuple[int | None, int]] = [(None, h) for h in cut(-(-empty * parts // n) if n else 1)] + [(None, 2**63 - 1)] * (empty > 0)
    ids = Counter(int(b) for b in rows.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts))
    for i, m in sorted(ids.items()):
        found += [(i, h) for h in [*cut(m), 2**63 - 1]]
    return found


def _range(bounds: list[tuple[int | None, int]]) -> F.Column:
    """The number of bounds below (id, hash of the text)."""
    first = sum(i is None for i, _ in bounds)
    ids, hashes = np.array([i for i, _ in bounds[first:]], np.int64), np.array([h for _, h in bounds], np.int64)
    own = np.unique(ids)

    @F.pandas_udf("int")
    def part(i: pd.Series, null: pd.Series, h: pd.Series) -> pd.Series:
        i, null, h = i.to_numpy(), null.to_numpy(), h.to_numpy()
        out = first + np.searchsorted(ids, i)
        same = np.searchsorted(ids, i, "right") > out - first
        for x in np.intersect1d(i[same], own):
            low, high = np.searchsorted(ids, x), np.searchsorted(ids, x, "right")
            at = i == x
            out[at] = first + low + np.searchsorted(hashes[first + low : first + high], h[at])
        out[null] = np.searchsorted(hashes[:first], h[null])
        return pd.Series(out.astype(np.int32))

    return part(F.coalesce("doc_id", F.lit(0).cast("long")), F.col("doc_id").isNull(), F.xxhash64("text"))


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows beside the next row by id, after the last the first; null ids first, equal ids by the hash of the text.

    One shuffle of the texts: rows are dealt to ranges of about equal numbers, as many as shuffle partitions, each a partition of its own; the
    least row of a range is also dealt, as a look-ahead, to the range before it. What the driver holds is one bound and one key for each
    range. Null ids and an id with many texts fill several ranges; equal rows stay together.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bounds = _bounds(rows, max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    placed = rows.withColumn("part", _range(bounds))
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))
    least = {r["part"]: (r["k"]["doc_id"], r["k"]["h"]) for r in placed.groupBy("part").agg(F.min(key).alias("k")).collect()}
    order = sorted(least)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    # (id, hash) of the least row of each range -> the range before it, whose look-ahead it is
    looked = spark.createDataFrame([(k[0], k[1], before[p]) for p, k in least.items()] or [(None, None, None)], "i long, h long, before int")
    marked = placed.join(F.broadcast(looked), F.col("doc_id").eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("h")), "left")
    own = F.struct("part", F.lit(False).alias("ahead"))
    both = marked.select("doc_id", "text", F.when(F.col("before").isNotNull(), F.array(own, F.struct(F.col("before").alias("part"), F.lit(True).alias("ahead")))).otherwise(F.array(own)).alias("to"))
    return both.select("doc_id", "text", F.inline("to")).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "ahead", "doc_id", F.xxhash64("text"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """Dealt rows as (ids, texts, next texts), a few at a time."""
    held: tuple | None = None  # (id, text, range, look-ahead) that waits for its next row
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_AT_ONCE):
            ids, texts, nexts = [], [], []
            for row in zip(*(c.to_pylist() for c in whole.slice(at, ROWS_AT_ONCE).columns), strict=True):
                if held and not held[3] and held[2] == row[2]:
                    ids.append(held[0])
                    texts.append(held[1])
                    nexts.append(row[1])
                if not (row[3] and held and held[3] and held[2] == row[2]):
                    held = row
            if ids:
                yield ids, texts, nexts


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_text), as dealt by _dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, nexts in _pairs(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(nexts, pa.string())], names=["doc_id", "text", "next_text"])

    return _dealt(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string, next_text string")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row of docs.

    A null text counts as empty. Equal texts have equal fingerprints; repeated ids follow each other by text. With one row
    alone the next text is its own. An empty table gives an empty one; other columns are not read.
    """
    schema = T.StructType().add("doc_id", "long").add("n_chars", "long").add("edited_text", "string").add("fingerprint", "string").add("edited_fingerprint", "string").add("near_edited", "double").add("near_next", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = ("", "")
        for ids, texts, nexts in _pairs(batches):
            rows = []
            for t, n in zip(texts, nexts, strict=True):
                e = edited(t, n)
                own = last[1] if last[1] and last[0] == t else fingerprint(t)
                other = fingerprint(n)
                last = (n, other)  # the next row is usually this one's next
                changed = fingerprint(e)
                rows.append((len(t), e, own, changed, likeness(own, changed), likeness(own, other)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c) for c in zip(*rows, strict=True))], names=schema.names)

    return _dealt(docs, id_col, text_col).mapInArrow(run, schema)
