"""Best-fit packing of token sequences by large-item matching, planned on the histogram of lengths.

Pieces of one length are interchangeable, so the plan needs only how many there are of each: at most ``capacity`` numbers
reach the driver, whatever the size of the corpus, and the plan is a list of runs (so many pieces of a length, in so many
like sequences, from an offset). Each piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reconspark.llm.bpe import Ids
from reconspark.llm.common import Scratch

CAPACITY, END = 1024, 2


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """counts: pieces by length. Runs (length, rank of its first piece, pieces, pieces a sequence, first sequence, offset).

    Pieces above a third of the capacity go at most two to a sequence: the longest left takes the longest that fits beside
    it. The others, from the longest down, go to the smallest gap that holds them, and open a sequence only when none does.
    Like sequences are held as one group, so the work depends on the capacity alone.
    """
    left, rank = dict(counts), Counter()
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    runs, opened = [], 0

    def put(length: int, pieces: int, each: int, first: int, offset: int) -> None:
        runs.append((length, rank[length], pieces, each, first, offset))
        rank[length] += pieces
        left[length] -= pieces

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((b for b in large if b <= a and a + b <= capacity and left[b] > (a == b)), None)
            n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
            put(a, n * (1 + (a == b)), 1 + (a == b), opened, 0)
            if b not in (None, a):
                put(b, n, 1, opened, a)
            gaps[capacity - a - (b or 0)].append((opened, n))
            opened += n
    for x in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[x]:
            gap = next((g for g in range(x, capacity + 1) if gaps[g]), None)
            if gap is None:
                n = -(-left[x] // (capacity // x))
                gaps[gap := capacity].append((opened, n))
                opened += n
            first, n = gaps[gap].pop()
            each = min(gap // x, left[x])
            used = min(n, left[x] // each)
            put(x, used * each, each, first, capacity - gap)
            gaps[gap - each * x].append((first, used))
            if n > used:
                gaps[gap].append((first + used, n - used))
    return runs


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one, or full ones after a first that may be shorter."""
    head = total % capacity or min(total, capacity)
    return [(0, head), *((s, capacity) for s in range(head, total, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int, end: int, with_ids: bool) -> DataFrame:
    """A row for each piece, with its rank among the pieces of its length in this partition."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen, part = Ids(path), Counter(), TaskContext.get().partitionId()
        tail = np.array([end], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                x = ids.of(text.as_py()) + tail
                for k, (start, length) in enumerate(cut(len(x) // 4, capacity)):
                    own = x[4 * start : 4 * (start + length)]
                    rows.append((doc.as_py(), k, start, length, zlib.crc32(own), part, seen[length], own)[: 7 + with_ids])
                    seen[length] += 1
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=[c.split()[0] for c in schema.split(", ")])

    return docs.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, and on request ids as little-endian 32-bit numbers).

    A document's ids are those of its text and the end id; only documents longer than the capacity are cut. Null and empty
    texts are the end id alone. Rows with a null or repeated id are packed like others. An empty table gives an empty one.
    Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    rows = pieces(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), path, capacity, end, with_ids)
    rows = scratch.save(rows, "pieces")
    tally = scratch.save(rows.groupBy("part", "length").agg(F.count("*").alias("n")), "tally")
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(sorted(plan(counts, capacity)) or np.zeros((0, 6)), np.int64).reshape(-1, 6)
    before = tally.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = rows.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("local")).drop("part", "local", "before")
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    names = schema.names

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (runs[:, 0] << 44) + runs[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
            r = runs[np.searchsorted(key, (length << 44) + rank, "right") - 1]
            nth = rank - r[:, 1]
            out = [pa.array(r[:, 4] + nth // r[:, 3]), pa.array(r[:, 5] + nth % r[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names[:-2]), *out], names=names)

    order = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return ranked.mapInArrow(place, schema).select(*order, *["ids"] * with_ids)
