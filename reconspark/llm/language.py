"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs, drawn from its code point. A trigram's vector binds (multiplies) those of its
letters, each permuted (rotated) by its place; a text bundles (adds) its trigrams' vectors and a language its texts'. A
document gets the language whose prototype has the largest cosine with its own vector.

Bundling is linear, so trigrams are counted first and a block of documents costs one matrix product.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reconspark.llm.common import unused

DIMENSIONS, SHARPNESS = 1024, 0.05
BLOCK_DOCS, BLOCK_CHARS = 256, 1_000_000
#: Trigrams multiplied at once, and trigrams and letters whose vectors a task keeps.
SLICE, MOST_GRAMS, MOST_LETTERS = 16_384, 60_000, 20_000


@functools.cache
def folded() -> np.ndarray:
    """By code point: its lower-case letter, or a space for what is no letter."""
    c = np.arange(0x110000, dtype="<u4")
    c[0xD800:0xE000] = 32
    low = np.char.lower(c.view("<U1")).astype("<U1").view("<u4")
    return np.where(np.char.isalpha(c.view("<U1")), low, 32).astype(np.uint32)


def letters(text: str) -> np.ndarray:
    """The letters of a text in lower case, each run of other characters as one space, with a space at both ends."""
    out = [np.full(1, 32, np.uint32)]
    for at in range(0, len(text), BLOCK_CHARS):
        x = np.concatenate([out[-1][-1:], folded()[np.frombuffer(text[at : at + BLOCK_CHARS].encode("utf-32-le", "surrogatepass"), "<u4")]])
        out.append(x[1:][(x[1:] != 32) | (x[:-1] != 32)])
        if not len(out[-1]):
            out.pop()
    if out[-1][-1] != 32:
        out.append(out[0])
    return np.concatenate(out)


def letter_vector(code: int, dimensions: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(code)).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


class Grams:
    """Vectors of the trigrams met so far, by a dense number; started anew when they become too many."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.reset()

    def reset(self) -> None:
        self.place = np.full(0x110000, -1, np.int32)
        self.signs = np.zeros((0, self.dimensions), np.int8)
        self.codes, self.places = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.vectors = np.zeros((0, self.dimensions), np.int8)

    def _number(self, x: np.ndarray) -> np.ndarray:
        new = np.unique(x[self.place[x] < 0])
        if len(new):
            self.place[new] = len(self.signs) + np.arange(len(new))
            self.signs = np.vstack([self.signs, *(letter_vector(int(c), self.dimensions)[None] for c in new)])
        return self.place[x].astype(np.int64)

    def bundled(self, texts: list[np.ndarray], mix: np.ndarray | None = None) -> np.ndarray:
        """The sum of the trigrams' vectors of each text (as letters() gives them), or mix @ these sums.

        At most SLICE trigrams are bound and multiplied at once, so memory does not grow with the number of different ones.
        """
        if len(self.codes) > MOST_GRAMS or len(self.signs) > MOST_LETTERS:
            self.reset()
        size = np.array([max(0, len(t) - 2) for t in texts])
        x = self._number(np.concatenate(texts))
        start = np.repeat(np.cumsum([0, *(len(t) for t in texts[:-1])]) - np.cumsum([0, *size[:-1]]), size) + np.arange(size.sum())
        doc = np.repeat(np.arange(len(texts)), size)
        width = int(x.max()).bit_length() if len(x) else 1
        if 3 * width <= 22:  # few letters: number the trigrams by a table instead of sorting them
            short = (x[start] << (2 * width)) | (x[start + 1] << width) | x[start + 2]
            there = np.flatnonzero(np.bincount(short, minlength=1))
            own = np.zeros(1 << (3 * width), np.int64)
            own[there] = np.arange(len(there))
            own, mask = own[short], (1 << width) - 1
            present = ((there >> (2 * width)) << 42) | ((there >> width & mask) << 21) | (there & mask)
        else:
            present, own = np.unique((x[start] << 42) | (x[start + 1] << 21) | x[start + 2], return_inverse=True)
        if len(present) > SLICE:
            order = np.argsort(own, kind="stable")
            doc, own = doc[order], own[order]
        out = np.zeros((len(texts) if mix is None else len(mix), self.dimensions), np.float32)
        for low in range(0, len(present), SLICE):
            some = present[low : low + SLICE]
            a, b = np.searchsorted(own, [low, low + len(some)]) if len(present) > SLICE else (0, len(own))
            counts = np.bincount(doc[a:b] * len(some) + own[a:b] - low, minlength=len(texts) * len(some)).reshape(len(texts), len(some)).astype(np.float32)
            out += (counts if mix is None else mix @ counts) @ self._bound(some)
        return out

    def _bound(self, present: np.ndarray) -> np.ndarray:
        """Vectors of these trigrams (ascending codes); new ones are kept as long as there is room."""
        at = np.searchsorted(self.codes, present)
        known = np.zeros(len(present), bool)
        known[at < len(self.codes)] = self.codes[at[at < len(self.codes)]] == present[at < len(self.codes)]
        out = np.empty((len(present), self.dimensions), np.int8)
        out[known] = self.vectors[self.places[at[known]]]
        new = present[~known]
        if len(new):
            a, b, c = (self.signs[(new >> s) & 0x1FFFFF] for s in (42, 21, 0))
            out[~known] = made = np.roll(a, 2, 1) * np.roll(b, 1, 1) * c
            if len(self.codes) <= MOST_GRAMS:
                codes, places = np.concatenate([self.codes, new]), np.concatenate([self.places, len(self.vectors) + np.arange(len(new))])
                order = np.argsort(codes, kind="stable")
                self.codes, self.places, self.vectors = codes[order], places[order], np.vstack([self.vectors, made])
        return out.astype(np.float32)


def _blocks(batch: pa.RecordBatch, texts: int) -> Iterator[tuple[list[int], list[np.ndarray], list[int]]]:
    """(rows with letters, their letters, their numbers of trigrams) in blocks of bounded size; a longer text comes in several
    parts that overlap by two letters."""
    rows, held, whole, size = [], [], [], 0
    for i, t in enumerate(batch.column(texts)):
        x = letters(t.as_py()) if t.is_valid else letters("")
        for at in range(0, len(x) - 2, BLOCK_CHARS):
            rows.append(i)
            held.append(x[at : at + BLOCK_CHARS + 2])
            whole.append(len(x) - 2)
            size += len(held[-1])
            if len(rows) >= BLOCK_DOCS or size >= BLOCK_CHARS:
                yield rows, held, whole
                rows, held, whole, size = [], [], [], 0
    if rows:
        yield rows, held, whole


def learn(docs: DataFrame, dimensions: int = DIMENSIONS, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """A prototype for each language: the sum of its texts' vectors, each divided by its number of trigrams.

    All rows with a language are used. Tasks add up their own texts, so what is shuffled and what reaches the driver is a
    vector for each language (and task).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = Grams(dimensions), {}
        for b in batches:
            lang = b.column(1).to_pylist()
            for rows, held, whole in _blocks(b, 0):
                names = sorted({lang[i] for i in rows})
                which = np.array([[lang[i] == n for i in rows] for n in names]) / np.array(whole, np.float32)
                for n, v in zip(names, grams.bundled(held, which), strict=True):
                    sums[n] = sums.get(n, 0) + v.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(run, "lang string, v array<double>")
    total = parts.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return {r["lang"]: np.array([p["x"] for p in r["v"]]) for r in sorted(total.collect(), key=lambda r: r["lang"])}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: all) with lang_pred, score, cosine and trigrams (their number).

    lang_pred is the language with the largest cosine (the first by name of equal ones), score its share in a softmax over
    all cosines. Null texts, texts without a letter and an empty set of prototypes: `und`, score 0, cosine 0. Columns of
    docs with these names are replaced.
    """
    kept = docs.select(*keep) if keep else docs
    kept = kept.drop("lang_pred", "score", "cosine", "trigrams")
    names, dims = list(prototypes), len(next(iter(prototypes.values()), []))
    unit = np.array([v / max(np.linalg.norm(v), 1e-12) for v in prototypes.values()], np.float32).reshape(len(names), dims)
    schema = T.StructType([*kept.schema.fields]).add("lang_pred", "string").add("score", "double").add("cosine", "double").add("trigrams", "long")
    out = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(dims)
        for b in batches:
            lang, score, cosine, trigrams = ["und"] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            own = np.zeros((b.num_rows, dims), np.float32)
            for rows, held, whole in _blocks(b, b.num_columns - 1) if names else ():
                np.add.at(own, rows, grams.bundled(held))
                trigrams[rows] = whole
            rows = np.flatnonzero(trigrams)
            if len(rows):
                cos = (own[rows] @ unit.T) / np.maximum(np.linalg.norm(own[rows], axis=1, keepdims=True), 1e-12)
                cosine[rows] = cos.max(1)
                score[rows] = 1 / np.exp((cos - cos.max(1, keepdims=True)) / SHARPNESS).sum(1)
                for i, k in zip(rows.tolist(), cos.argmax(1).tolist(), strict=True):
                    lang[i] = names[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang), pa.array(score), pa.array(cosine), pa.array(trigrams)], names=out)

    t_ = unused(docs, "__text")
    source = docs.withColumn(t_, F.col(text_col).cast("string")).select(*kept.columns, t_)
    return source.mapInArrow(run, schema)
