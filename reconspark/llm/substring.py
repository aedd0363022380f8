"""Repeated passages by hashed blocks and windows, in place of a greedy relative Lempel-Ziv parse.

A greedy parse reads its reference in sequence, and a passage that a third of all documents share would be read against all of
them; so no factor is formed or extended here. Every document is cut into blocks whose borders depend on content alone, and every block of
the corpus is indexed as a reference. Blocks that an earlier document holds whole are found by a join of their hashes. A repeated
passage usually starts and ends inside a block, so blocks that share their anchor with other blocks but not their whole content
are compared window by window. Both steps together give exactly the windows that also start in a document with a smaller id.

Blocks: of the ``window - anchor + 1`` word ``anchor``-grams in a window the one with the least hash is its anchor; the
neighbouring windows with one anchor hash are a block. Equal windows have equal anchor hashes, whatever stands around them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconspark.llm.common import Scratch, mixed, unused, words

WINDOW, ANCHOR = 50, 10
#: Odd, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


class WordHashes(dict):
    """XXH3 of each word, kept within a task up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


@functools.cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full((1 << bits) - 1, b, np.uint64))]) for b in (BASE, UNBASE))


class Parsed:
    """Prefix sums over a document's word hashes: the hash of any span takes two look-ups."""

    def __init__(self, text: str | None, known: WordHashes):
        w = words(text)
        self.n = len(w)
        h = np.fromiter(map(known.__getitem__, w), np.uint64, self.n)
        up, self.down = _powers(max(10, self.n.bit_length()))
        with np.errstate(over="ignore"):
            self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[: self.n])]) for x in (h, mixed(h))]

    def spans(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        c = self.sums[which]
        with np.errstate(over="ignore"):
            return mixed((c[end] - c[start]) * self.down[start] + (end - start).astype(np.uint64))

    def blocks(self, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each block: anchor hash, hash of its words, first window, number of windows."""
        many = self.n - window + 1
        if many <= 0:
            none = np.zeros(0, np.int64)
            return none.view(np.uint64), none.view(np.uint64), none, none
        at = np.arange(self.n - anchor + 1)
        low, wide, reach = self.spans(at, at + anchor, 0), 1, window - anchor + 1
        while wide * 2 <= reach:
            low, wide = np.minimum(low[:-wide], low[wide:]), wide * 2
        low = np.minimum(low[:many], low[reach - wide : reach - wide + many])
        at = np.arange(many)
        new = np.concatenate([[True], low[1:] != low[:-1]])
        since = at - np.maximum.accumulate(np.where(new, at, 0))
        first = np.flatnonzero(since % reach == 0)  # periodic text has one anchor hash throughout: cut it evenly
        count = np.diff(np.append(first, many))
        return low[first], self.spans(first, first + count + window - 1, 1), first, count


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _blocks(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    kind = pa.schema([("anchor", pa.int64()), ("block", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("first", pa.int32()), ("many", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            ids, keys = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            found = [Parsed(t.as_py(), known).blocks(window, anchor) for t in b.column(2)]
            size = [len(f[0]) for f in found]
            cat = [np.concatenate([f[i] for f in found]) for i in range(4)]
            yield pa.RecordBatch.from_arrays([_signed(cat[0]), _signed(cat[1]), pa.array(np.repeat(ids, size), pa.int64()), pa.array(np.repeat(keys, size), pa.int64()), pa.array(cat[2].astype(np.int32)), pa.array(cat[3].astype(np.int32))], schema=kind)

    return docs.where("doc_id is not null and text is not null").select("doc_id", "row", "text").mapInArrow(run, "anchor long, block long, doc_id long, row long, first int, many int")


def _windows(chosen: DataFrame, window: int) -> DataFrame:
    """chosen(text, blocks: array of anchor, block, owner, first, many): a row for each window of each block."""
    kind = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("anchor", pa.int64()), ("block", pa.int64()), ("owner", pa.int64()), ("step", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, rows = WordHashes(), [], 0
        for b in batches:
            for i in range(b.num_rows):
                x = b.column(1)[i].values
                anchor, block, owner, first, many = (x.field(k).to_numpy(zero_copy_only=False) for k in ("anchor", "block", "owner", "first", "many"))
                many = many.astype(np.int64)
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                start = np.repeat(first.astype(np.int64), many) + step
                p = Parsed(b.column(0)[i].as_py(), known)
                held.append([p.spans(start, start + window, 0).view(np.int64), p.spans(start, start + window, 1).view(np.int64), *(np.repeat(y, many) for y in (anchor, block, owner)), step.astype(np.int32)])
                rows += len(start)
                if rows > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=kind)
                    held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=kind)

    return chosen.select("text", "blocks").mapInArrow(run, "w1 long, w2 long, anchor long, block long, owner long, step int")


def repeated_spans(docs: DataFrame, scratch: Scratch, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs(doc_id, row, text) -> (doc_id, row, spans: array of first, words): the covered words of each row that has any."""
    blocks = scratch.save(_blocks(docs, window, anchor), "blocks")
    # Anchors that two documents hold; only their blocks can be copies or stand at a factor's border.
    met = blocks.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), (F.min("block") != F.max("block")).alias("varied"))
    met = scratch.save(met.where("low <> high").select("anchor", "varied"), "met")
    shared = scratch.save(blocks.join(met, "anchor"), "shared")
    scratch.drop("blocks")
    kinds = scratch.save(shared.groupBy("anchor", "block").agg(F.min(F.struct("doc_id", "row", "first", "many")).alias("at"), F.max("doc_id").alias("last"), F.first("varied").alias("varied")), "kinds")
    # The first holder of each block whose anchor also has other blocks: its windows are compared one by one.
    wanted = kinds.where("varied").select("at.doc_id", "at.row", F.struct("anchor", "block", F.col("at.doc_id").alias("owner"), "at.first", "at.many").alias("x")).groupBy("doc_id", "row").agg(F.collect_list("x").alias("blocks"))
    windows = scratch.save(_windows(docs.select("doc_id", "row", "text").join(wanted, ["doc_id", "row"]), window), "windows")
    least = scratch.save(windows.groupBy("w1", "w2").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).where("low <> high").select("w1", "w2", "low"), "least")
    border = windows.join(least, ["w1", "w2"]).where("low < owner").groupBy("anchor", "block").agg(F.collect_set("step").alias("steps"))
    found = scratch.save(kinds.join(border, ["anchor", "block"], "left").where("steps is not null or at.doc_id < last").select("anchor", "block", F.col("at.doc_id").alias("owner"), "steps"), "found")
    whole = F.array(F.struct(F.col("first"), (F.col("many") + window - 1).alias("words")))
    parts = F.transform("steps", lambda s: F.struct((F.col("first") + s).alias("first"), F.lit(window).alias("words")))
    covered = shared.join(found, ["anchor", "block"]).select("doc_id", "row", F.when(F.col("doc_id") > F.col("owner"), whole).otherwise(parts).alias("spans"))
    return covered.where("spans is not null").groupBy("doc_id", "row").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_words, n_removed and kept_text: each text without the words of repeated windows, joined by one space.

    A window is `window` consecutive words ``[^\\x20\\x09-\\x0D]+``; it is repeated if a row with a smaller id holds the
    same words. Judged on the input. Null and empty texts have no words and an empty kept_text; texts shorter than a
    window keep all. Rows with equal ids never count against each other; rows with a null id keep everything and count against
    nobody. Other columns pass through, but for those named like an output, which are replaced.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.xxhash64("text"))
    i_, r_, s_, t_ = (unused(docs, n) for n in ("__id", "__row", "__spans", "__text"))
    spans = repeated_spans(keyed, scratch, window, anchor).withColumnsRenamed({"doc_id": i_, "row": r_, "spans": s_})
    spans = scratch.save(spans, "spans")
    scratch.keep("spans")
    kept = docs.drop("n_words", "n_removed", "kept_text")
    on = (kept[id_col].cast("long") == spans[i_]) & (F.xxhash64(kept[text_col].cast("string")) == spans[r_])
    joined = kept.join(spans, on, "left").drop(i_, r_).withColumn(t_, F.col(text_col).cast("string"))
    schema = joined.drop(s_, t_).schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, text = [], [], []
            at, raw = b.column(b.schema.get_field_index(s_)), b.column(b.schema.get_field_index(t_))
            for i in range(b.num_rows):
                w = words(raw[i].as_py())
                total.append(len(w))
                if at[i].is_valid:
                    x = at[i].values
                    first, size = (x.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("first", "words"))
                    depth = np.bincount(first, minlength=len(w) + 1) - np.bincount(first + size, minlength=len(w) + 1)
                    gone = np.cumsum(depth)[: len(w)] > 0
                    w = [x for x, g in zip(w, gone.tolist(), strict=True) if not g]
                removed.append(total[-1] - len(w))
                text.append(b" ".join(w).decode("utf-8", "surrogatepass"))
            out = [*(b.column(b.schema.get_field_index(n)) for n in names[:-3]), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return joined.mapInArrow(run, schema)
