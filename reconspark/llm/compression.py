"""Quality rules on compression: zstandard ratios inside limits that depend on length.

A text that says the same over and over compresses too well, and noise (keys, encoded bytes) hardly compresses; how well clean
prose compresses depends on its length. So the limits are a band around the usual ratio of each length, and the usual ratios and
their spread are counted over the whole corpus. The same band judges whole documents and their fixed chunks, so a document
whose halves are dull and noisy in turn is found out although its ratio as a whole is usual.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reconspark.llm.common import Scratch, unused

SYMBOLS, RUN, CHUNK, LEVEL = b"#*$%&|<>", 5, 4096, 3
#: Bands of length an octave, steps of the logarithm of the ratio, and texts a band needs for figures of its own.
BANDS, STEPS, LEAST = 4, 1000, 30
#: Spreads that a clean text may be off the usual ratio; the least spread, which falls as the square root of the bytes;
#: and the share of a document's bytes that may stand in chunks off the band.
REACH, SPREAD, LEAST_SPREAD, SHARE = 4.0, 0.75, 0.01, 0.5
FACTOR = np.uint64(0x9E3779B97F4A7C15)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], run: int = RUN) -> int:
    """Words that stand in a window of `run` words which the text holds twice or more; all its places count.

    Hashes say which windows may be repeated; those are compared word by word.
    """
    many = len(words) - run + 1
    if many < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    window = hashes[:many].copy()
    for i in range(1, run):
        window *= FACTOR
        window += hashes[i : many + i]
    ranked = np.sort(window)
    if not (ranked[1:] == ranked[:-1]).any():
        return 0
    order = np.argsort(window)
    same = ranked[1:] == ranked[:-1]
    maybe = np.sort(order[np.append(same, False) | np.append(False, same)]).tolist()
    found = Counter(tuple(words[i : i + run]) for i in maybe)
    total = end = 0
    for i in maybe:
        if found[tuple(words[i : i + run])] > 1:
            total, end = total + i + run - max(i, end), i + run
    return total


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """BASE of a text in UTF-8."""
    words = raw.split()
    letters = np.frombuffer(b"".join(words), np.uint8)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(words), int(((letters & 0xC0) != 0x80).sum()), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _measured(docs: DataFrame, kept: list[str], text_col: str, chunk: int) -> DataFrame:
    """kept..., BASE, bytes and packed of the whole text, sizes and packs of its chunks (none if there is but one), and the text's hash."""
    t_, h_ = unused(docs, "__text"), unused(docs, "__hash")
    text = F.col(text_col).cast("string")
    schema = T.StructType([*docs.select(*kept).schema.fields])
    for name in (*BASE, "bytes", "packed"):
        schema = schema.add(name, "long")
    schema = schema.add("sizes", T.ArrayType(T.LongType())).add("packs", T.ArrayType(T.LongType())).add("hash", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False).compress
        for b in batches:
            base, whole, sizes, packs = [], [], [], []
            for t in b.column(b.num_columns - 2):
                raw = t.as_py() or b""
                base.append(base_counts(raw))
                whole.append((len(raw), len(pack(raw))))
                parts = [raw[i : i + chunk] for i in range(0, len(raw), chunk)] if len(raw) > chunk else []
                sizes.append([len(p) for p in parts])
                packs.append([len(pack(p)) for p in parts])
            counts = np.hstack([np.array(base, np.int64).reshape(-1, len(BASE)), np.array(whole, np.int64).reshape(-1, 2)])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (sizes, packs)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *(pa.array(c) for c in counts.T), *lists, b.column(b.num_columns - 1)], names=schema.names)

    source = docs.withColumns({t_: text.cast("binary"), h_: F.xxhash64(text)})
    return source.select(*kept, t_, h_).mapInArrow(run, schema)


def base_failed() -> Column:
    """Too short, or more than a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass
class Limits:
    """The usual ratio and its spread (as a share of the ratio) at points of length; between points both go in a straight line."""

    log2_bytes: list[float]
    usual: list[float]
    spread: list[float]

    def interval(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest ratio of texts of these lengths."""
        if not self.log2_bytes:
            return np.zeros(len(sizes)), np.full(len(sizes), np.inf)
        at = np.log2(np.maximum(sizes, 1))
        usual, wide = np.interp(at, self.log2_bytes, self.usual), REACH * np.interp(at, self.log2_bytes, self.spread)
        return usual * (1 - wide), usual * (1 + wide)


def _pooled(rows: list, least: int) -> list[list]:
    """Bands in order of length, joined with the next until there are `least` texts; what is left at the end joins the last."""
    groups, now = [], []
    for band in sorted({r["band"] for r in rows}):
        now += [r for r in rows if r["band"] == band]
        if sum(r["n"] for r in now) >= least:
            groups.append(now)
            now = []
    if groups:
        groups[-1] += now
    return groups


def _quantile(pairs: list[tuple[int, int]], share: float) -> float:
    """Lower quantile of values with counts."""
    total, seen = share * sum(n for _, n in pairs), 0
    for value, n in sorted(pairs):
        seen += n
        if seen >= total:
            return value
    return 0.0


def fit_limits(measured: DataFrame, least: int = LEAST) -> Limits:
    """The band of usual ratios, counted over all texts that pass the base rules, equal texts once.

    Two histograms reach the driver: lengths (BANDS an octave) by ratio (STEPS to a factor e), and lengths by distance from the
    medians of the first. Their size is bounded by the two grids, not by the rows. The spread is the distance that 0.16 of
    a band's texts stay below the median by, so what compresses too well does not widen it. Without `least` texts there are no limits.
    """
    texts = measured.where(~base_failed() & (F.col("bytes") > 0)).groupBy("hash").agg(F.min(F.struct("bytes", "packed")).alias("x")).select("x.*")
    octaves = F.log2("bytes")
    logs = F.ln(F.col("bytes") / F.col("packed"))
    banded = texts.withColumns({"band": F.floor(octaves * BANDS).cast("int"), "octaves": octaves, "logs": logs})

    def counted(value: Column) -> list:
        return banded.groupBy("band", F.floor(value * STEPS).cast("int").alias("step")).agg(F.count("*").alias("n"), F.sum("octaves").alias("octaves")).collect()

    groups = _pooled(counted(F.col("logs")), least)
    if not groups:
        return Limits([], [], [])
    at = [sum(r["octaves"] for r in g) / sum(r["n"] for r in g) for g in groups]
    mid = [(_quantile([(r["step"], r["n"]) for r in g], 0.5) + 0.5) / STEPS for g in groups]
    line = F.lit(mid[0])
    for k in range(1, len(at)):
        line = F.when(F.col("octaves") > at[k - 1], mid[k - 1] + (F.col("octaves") - at[k - 1]) * ((mid[k] - mid[k - 1]) / (at[k] - at[k - 1]))).otherwise(line)
    line = F.when(F.col("octaves") > at[-1], mid[-1]).otherwise(line)
    apart = _pooled(counted(F.col("logs") - line), least)
    low = [max(-(_quantile([(r["step"], r["n"]) for r in g], 0.16) + 0.5) / STEPS, LEAST_SPREAD, SPREAD / 2 ** (a / 2)) for g, a in zip(apart, at, strict=True)]
    return Limits(at, [float(np.exp(m)) for m in mid], low)


def judge(measured: DataFrame, limits: Limits, kept: list[str]) -> DataFrame:
    """kept..., BASE, ratio, chunks_off (share of the bytes in chunks off the band), base_failed and kept."""
    names = [*BASE, "ratio", "chunks_off", "base_failed", "kept"]
    schema = T.StructType([*measured.select(*kept).schema.fields])
    for name, kind in zip(names, ["long"] * len(BASE) + ["double", "double", "boolean", "boolean"], strict=True):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *_, size, pack, sizes, packs, failed = b.columns
            size, pack = (x.to_numpy(zero_copy_only=False).astype(float) for x in (size, pack))
            ratio = size / pack
            least, most = limits.interval(size)
            off = np.zeros(len(size))
            lengths = sizes.value_lengths().to_numpy(zero_copy_only=False)
            s, p = (x.flatten().to_numpy(zero_copy_only=False).astype(float) for x in (sizes, packs))
            lo, hi = limits.interval(s)
            np.add.at(off, np.repeat(np.arange(len(size)), lengths), np.where((s / p < lo) | (s / p > hi), s, 0))
            off /= np.maximum(size, 1)
            failed = failed.to_numpy(zero_copy_only=False)
            fine = ~failed & (ratio >= least) & (ratio <= most) & (off <= SHARE)
            yield pa.RecordBatch.from_arrays([*b.columns[:-5], *(pa.array(x) for x in (ratio, off, failed.astype(bool), fine.astype(bool)))], names=schema.names)

    return measured.select(*kept, *BASE, "bytes", "packed", "sizes", "packs", base_failed().alias("failed")).mapInArrow(run, schema)


def compression_rules(docs: DataFrame, chunk: int = CHUNK, least: int = LEAST, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: all) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio, chunks_off, base_failed, kept.

    Words are ``[^\\x20\\x09-\\x0D]+``; lines are split at ``\\n`` and count as repeated if they hold a word and equal an earlier line. A
    row is kept if it passes the base rules, its ratio is within the band of its length, and at most SHARE of its bytes
    stand in chunks (of `chunk` bytes) off theirs. Null and empty texts have no words, so they fail the base rules. Equal
    texts have equal results, repeated rows stay, and the verdict does not depend on ids. Columns named like an output are
    replaced. Measures are written once, without the texts unless `keep` names them.
    """
    scratch = Scratch(docs.sparkSession, "compression")
    outputs = {*BASE, "ratio", "chunks_off", "base_failed", "kept"}
    passed = [c for c in (keep or docs.columns) if c.lower() not in outputs]
    inner = {c: f"__{i}" for i, c in enumerate(passed)}  # so that no column of the rows meets one of the measures
    renamed = docs.select(*(F.col(c).alias(n) for c, n in inner.items()), F.col(text_col).cast("string").alias("text"))
    measured = scratch.save(_measured(renamed, list(inner.values()), "text", chunk), "measures")
    return judge(measured, fit_limits(measured, least), list(inner.values())).withColumnsRenamed({n: c for c, n in inner.items()})
