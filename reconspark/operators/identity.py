"""Which document a name or a text belongs to: unique keys, completions, longest unique boundary matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reconspark.functions import text as X
from reconspark.storage import Scratch, unbounded

#: Bits of the table of keys (8 MiB) as a power of two, bytes of a block of it, base of the hashes, characters hashed at once, rows of a batch.
TABLE_BITS, BLOCK, BASE, CHARACTERS, ROWS = 26, 4096, 0x9E3779B97F4A7C15, 200_000, 10_000
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over the whole range (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def unique_keys(codes: DataFrame, code: str = "code") -> DataFrame:
    """key, code: the keys that exactly one code has."""
    return codes.where(F.col(code).isNotNull()).select(code).distinct().groupBy(X.key(code).alias("key")).agg(F.max(code).alias(code), F.count("*").alias("__n")).where("__n = 1").drop("__n")


def complete(rows: DataFrame, group: list[str], prefix: Column, full: str) -> DataFrame:
    """Rows with `completed`: the only longer value of the group that starts with the row's prefix, else null.

    Values are joined to prefixes by equality: each value offers its beginnings, of the lengths that prefixes have in its group.
    """
    asked = rows.select(*group, prefix.alias("__p")).distinct()
    sizes = asked.groupBy(*group).agg(F.collect_set(F.length("__p")).alias("__sizes"))
    starts = rows.select(*group, full).distinct().join(sizes, group).select(*group, full, F.explode("__sizes").alias("__k")).where(F.length(full) > F.col("__k")).select(*group, F.substring(F.col(full), F.lit(1), F.col("__k")).alias("__p"), full)
    lone = starts.groupBy(*group, "__p").agg(F.when(F.min(full) == F.max(full), F.max(full)).alias("completed"))
    return rows.withColumn("__p", prefix).join(lone, [*group, "__p"], "left").drop("__p")


def _bit(hashes: np.ndarray, size: int) -> np.ndarray:
    """Places in the bit table of hashes of strings of this length."""
    return (mixed(hashes + np.uint64(size)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    of = lambda base: np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)))
    return of(BASE), of(pow(BASE, -1, 1 << 64))


def _points(strings: list[str]) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _hashes(points: np.ndarray, size: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of the strings of `size` code points that start at each place."""
    sums = np.append(np.uint64(0), np.cumsum(points * up[: len(points)]))
    return (sums[size:] - sums[:-size]) * down[: len(points) - size + 1]


def _key_table(keys: DataFrame, key: str) -> tuple[np.ndarray, list[int]]:
    """(table of 2^TABLE_BITS bits with one set for each key, the lengths of keys).

    A task sends only the bits that it sets, by blocks of the table, so what reaches the driver is the table and never the keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sizes = np.zeros(1 << TABLE_BITS - 3, np.uint8), set()
        for b in batches:
            by: dict[int, list[str]] = {}
            for k in b.column(0).to_pylist():
                by.setdefault(len(k), []).append(k)
            sizes |= {*by}
            for size, same in by.items():
                up, down = _powers(size)
                bits = _bit((_points(same).reshape(-1, size) * up[:size]).sum(1, dtype=np.uint64) * down[0], size)
                np.bitwise_or.at(table, bits >> 3, (1 << (bits & 7)).astype(np.uint8))
        blocks = table.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(1))
        found = [(int(i), blocks[i].tobytes(), None) for i in used] + [(None, None, s) for s in sorted(sizes)]
        for i in range(0, len(found), 256):
            yield pa.RecordBatch.from_pylist([dict(zip(("block", "bits", "size"), f, strict=True)) for f in found[i : i + 256]], schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            for i, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own[i] = own[i] | np.frombuffer(bits, np.uint8) if i in own else np.frombuffer(bits, np.uint8)
        yield pa.RecordBatch.from_pylist([{"block": i, "bits": v.tobytes()} for i, v in own.items()], pa.schema({"block": pa.int32(), "bits": pa.binary()}))

    schema = pa.schema({"block": pa.int32(), "bits": pa.binary(), "size": pa.int32()})
    parts = Scratch(keys.sparkSession, "bits").save(keys.select(key).mapInArrow(run, "block int, bits binary, size int"), "bits")
    table = np.zeros((1 << TABLE_BITS - 3) // BLOCK * BLOCK, np.uint8).reshape(-1, BLOCK)
    for r in parts.where("block is not null").select("block", "bits").repartition("block").mapInArrow(merge, "block int, bits binary").toLocalIterator():
        table[r["block"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return table.ravel(), sorted(r[0] for r in parts.where("size is not null").select("size").distinct().collect())


def _held(texts: DataFrame, keys: DataFrame, text: str, key: str) -> DataFrame:
    """texts with each of the keys that they contain (and the other columns of keys).

    The parts of a text that have a key's length are hashed; those whose bit is set in a table of all keys' hashes, of fixed size, are joined
    to the keys by equality, so a part that no key is costs a row at most and no task holds the keys. Many keys fill the table (10^8:
    it passes all parts), which costs rows and changes no result. Null and empty keys are in no text, null texts hold none.
    """
    asked = Scratch(texts.sparkSession, "keys", large=True).save(keys.where(F.length(key) > 0).select(key).distinct(), "keys")
    table, sizes = _key_table(asked, key)
    shared = texts.sparkSession.sparkContext.broadcast((table.tobytes(), sizes))
    schema = T.StructType([*texts.schema.fields]).add(key, "string")
    at = texts.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, sizes = shared.value
        table = np.frombuffer(raw, np.uint8)
        for b in batches:
            whole = b.column(at).to_pylist()
            for first, last in _runs([len(t or "") for t in whole]):
                some = whole[first:last]
                lengths = np.array([len(t or "") for t in some], np.int64)
                ends = np.cumsum(lengths)
                points, (up, down) = _points([t or "" for t in some]), _powers(int(ends[-1]))
                left = np.repeat(ends, lengths) - np.arange(ends[-1])
                for size in sizes:
                    if size > len(points):
                        break
                    bits = _bit(_hashes(points, size, up, down), size)
                    place = np.flatnonzero((table[bits >> 3] >> (bits & 7).astype(np.uint8) & 1 > 0) & (left[: len(bits)] >= size))
                    row = np.searchsorted(ends, place, "right")
                    start = place - (ends - lengths)[row]
                    met = sorted({(r, some[r][s : s + size]) for r, s in zip(row.tolist(), start.tolist(), strict=True)})
                    for i in range(0, len(met), ROWS):
                        rows = pa.array([first + r for r, _ in met[i : i + ROWS]], pa.int64())
                        yield pa.RecordBatch.from_arrays([*b.take(rows).columns, pa.array([k for _, k in met[i : i + ROWS]], pa.string())], names=schema.names)

    return texts.mapInArrow(run, schema).join(asked if keys.columns == [key] else unbounded(keys), key)


def _runs(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about CHARACTERS."""
    first, total = 0, 0
    for i, n in enumerate(lengths):
        total += n
        if total >= CHARACTERS or i == len(lengths) - 1:
            yield first, i + 1
            first, total = i + 1, 0


def longest_unique(texts: DataFrame, keys: DataFrame, text: str, key: str, ids: list[str]) -> DataFrame:
    """ids, key: the longest key that a text (a name, an address) contains, if no other key of that length is in it."""
    met = _held(texts.select(*ids, text), keys.select(key), text, key)
    found = met.groupBy(*ids, F.length(key).alias("__len")).agg(F.min(key).alias("__low"), F.max(key).alias("__high"))
    best = found.groupBy(*ids).agg(F.max(F.struct("__len", "__low", "__high")).alias("x"))
    return best.where("x.__low = x.__high").select(*ids, F.col("x.__low").alias(key))


def match_files(files: DataFrame, codes: DataFrame, file: str, ids: list[str], code: str = "code") -> DataFrame:
    """ids, code: the code that a file name holds as a whole; longest first, none if two equally long ones fit."""
    keys = codes.where(X.value(code).isNotNull()).select(code).distinct().select(code, X.key(code).alias("__key")).withColumn("__pattern", X.lone_key_pattern(F.col("__key")))
    names = files.withColumn("__value", F.regexp_replace(X.value(file), X.EXTENSIONS, "")).withColumn("__compact", F.regexp_replace("__value", "(?U)\\s+", "")).where("__compact is not null")
    met = _held(names.select(*ids, "__value", "__compact"), keys, "__compact", "__key").where(F.call_function("rlike", F.col("__value"), F.col("__pattern")))
    sized = met.groupBy(*ids, F.length("__key").alias("__len")).agg(F.min(code).alias("__low"), F.max(code).alias("__high"))
    return sized.groupBy(*ids).agg(F.max(F.struct("__len", "__low", "__high")).alias("x")).where("x.__low = x.__high").select(*ids, F.col("x.__low").alias(code))


def match_lines(lines: DataFrame, codes: DataFrame, line: str, page: str, ids: list[str], code: str = "code") -> DataFrame:
    """page, code: the one code that lines of a page consist of: alone, with -УЛ after it, or with a revision note."""
    found = match_files(lines.select(page, *ids, line), codes.where(F.length(X.key(code)) >= 4), line, [page, *ids], code)
    k, c = X.key(line), X.key(code)
    noted = F.substring(k, F.length(c) + 1, F.length(k)).rlike("^\\(?ИЗМ[.0-9)]+$") & k.startswith(c)
    own = found.join(lines.select(page, *ids, line), [page, *ids]).where(~c.rlike("^\\d+$") & ((k == c) | (k == F.concat(c, F.lit("-УЛ"))) | noted))
    return own.groupBy(page).agg(F.min(code).alias("__low"), F.max(code).alias(code)).where(F.col("__low") == F.col(code)).drop("__low")
