"""Collocations from word-id suffix arrays: phrases that occur more often than their parts would lead one to expect.

A shard is what a task has read of one language, up to a bound. Its words become numbers, numpy sorts its suffixes by prefix
doubling, and each interval of suffixes with a common prefix of n words is a phrase of n words with its count. Spark
adds the counts of all shards up by language and phrase.

Most phrases occur once, so they are not passed on as text. A first pass counts pairs of words by 64-bit keys; a phrase can be frequent
only if all pairs of words in it are. The frequent keys go into a bit table of fixed size, and the pass that reads phrases cuts each
piece of text wherever a pair is not in the table before it sorts suffixes. Equal keys of different pairs, and bits of other pairs,
let rare phrases through, which costs rows and changes no count. Longer phrases take a pass each, by those a word shorter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconspark.llm.common import Scratch, mixed

WORDS, LEAST, TOP, SCALE, COVERED = 3, 10, 2000, 1_000_000, 50
#: Words that a task sorts at once, different words it keeps numbers of, and bits of the table (8 MiB).
SHARD, KNOWN, BITS = 500_000, 1_000_000, 1 << 26
#: Letters A-Z become lower case, the signs that end a piece a full stop.
SIGNS = bytes(i + 32 if 65 <= i <= 90 else 46 if i in b".,;:!?\n\x0b\x0c\r" else i for i in range(256))


class Numbers(dict):
    """Numbers of words from 1, and the words by number. A full stop is 0."""

    def __init__(self) -> None:
        super().__init__({b".": 0})
        self.words: list[bytes] = [b"."]

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self.words)
        self.words.append(word)
        return out


def numbered(raw: bytes, known: Numbers) -> np.ndarray:
    """Words of a text as numbers, 0 between its pieces."""
    found = raw.translate(SIGNS).replace(b".", b" . ").split()
    return np.fromiter(map(known.__getitem__, found), np.int64, len(found))


def pieces(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers without the 0s, for each how many words its piece has from it on)."""
    ends = ids == 0
    place, bounds = np.flatnonzero(~ends), np.append(np.flatnonzero(ends), len(ids))
    return ids[place], bounds[np.cumsum(ends)[place]] - place


def windows(left: np.ndarray, chosen: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the words that the chosen windows of `size` words cover, left for them once pieces end where no window goes on)."""
    depth = np.zeros(len(left) + 1, np.int64)
    depth[:-1] += chosen
    depth[size - 1 :] -= chosen[: len(left) - size + 2]
    joined = np.cumsum(depth)[:-1] > 0  # with the next word
    place = np.flatnonzero(joined | np.append(False, joined[:-1]))
    last = np.flatnonzero(~joined)
    return place, last[np.searchsorted(last, place)] - place + 1


def suffixes(words: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of their suffixes, common prefix of each with the one before it, up to depth words).

    Prefix doubling: ranks of prefixes of h words, in pairs, give those of 2 h. A prefix ends where its piece does.
    """
    ranks, h = [(1, words)], 1
    order = np.argsort(words, kind="stable") if depth == 1 else np.zeros(0, np.int64)
    while h < depth:
        rank = ranks[-1][1]
        key = rank * (int(rank.max(initial=0)) + 1)
        key[:-h] += np.where(left[:-h] > h, rank[h:], 0)
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty_like(key)
        rank[order] = np.cumsum(np.append(True, key[1:] != key[:-1])[: len(key)])
        h *= 2
        ranks.append((h, rank))
    common = np.zeros(len(order), np.int64)
    one, other, now = order[1:], order[:-1], common[1:]
    for h, rank in reversed(ranks):  # as many whole steps as agree, the longest first
        inside = (now + h <= depth) & (left[one] >= now + h) & (left[other] >= now + h)
        now += h * (inside & (rank[np.where(inside, one + now, 0)] == rank[np.where(inside, other + now, 0)]))
    return order, common


def intervals(order: np.ndarray, common: np.ndarray, fits: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place, count) of each phrase of `size` words that starts at a place which fits: runs with common prefixes that long."""
    here = fits[order]
    run = np.cumsum(common < size)
    at = np.flatnonzero(here)
    first = np.flatnonzero(np.append(True, np.diff(run[at]) > 0)[: len(at)])
    return order[at[first]], np.diff(np.append(first, len(at)))


def keys(parts: list[np.ndarray]) -> np.ndarray:
    """64-bit keys of phrases from the hashes of their words (the first part: the language's)."""
    key = np.zeros(1, np.uint64)
    for part in parts:
        key = mixed(key + part)
    return key


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _shards(texts: DataFrame, schema: str, shard: Callable[[str, np.ndarray, Numbers, np.ndarray], Iterator[pa.RecordBatch]]) -> DataFrame:
    """shard(lang, numbers of its words with 0 between pieces, their words, hashes of these) over texts(lang, text as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        known, hashes, held, size = Numbers(), np.zeros(0, np.uint64), {}, 0

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal hashes, size
            new = known.words[len(hashes) :]
            hashes, size = np.append(hashes, np.fromiter(map(_hash, new), np.uint64, len(new))), 0
            for lang in sorted(held):
                yield from shard(lang, np.concatenate(held.pop(lang)), known, hashes)

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held.setdefault(lang, []).append(np.append(numbered(text.as_py() or b"", known), 0))
                size += len(held[lang][-1])
                if size > SHARD or len(known.words) > KNOWN:
                    yield from settle()
                    if len(known.words) > KNOWN:
                        known, hashes = Numbers(), np.zeros(0, np.uint64)
        yield from settle()

    return texts.mapInArrow(run, schema)


def _lang_key(lang: str) -> np.uint64:
    return np.uint64(_hash(lang.encode()))


def _pairs(texts: DataFrame) -> DataFrame:
    """(key, f): counts of pairs of words in each shard, by key."""

    def shard(lang: str, ids: np.ndarray, known: Numbers, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        words, left = pieces(ids)
        place, f = intervals(*suffixes(words, left, 2), left >= 2, 2)
        key = keys([_lang_key(lang), hashes[words[place]], hashes[words[np.minimum(place + 1, len(words) - 1)]]])
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)[: len(place)]), pa.array(f)], names=["key", "f"])

    return _shards(texts, "key long, f long", shard)


def _phrases(texts: DataFrame, step: int, sizes: range, table: np.ndarray) -> DataFrame:
    """(lang, size, phrase, f) of each shard: phrases of these sizes, all of whose parts of `step` words are in the table.

    With sizes from 2 also the words, and a row of size 0 with how many the shard has.
    """
    names = ["lang", "size", "phrase", "f"]
    bits = texts.sparkSession.sparkContext.broadcast(table)

    def rows(lang: str, size: int, phrase: pa.Array, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(f), 100_000):
            n = len(f[i : i + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, size, np.int32)), phrase[i : i + n].cast(pa.string()), pa.array(f[i : i + n])], names=names)

    def shard(lang: str, ids: np.ndarray, known: Numbers, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        words, left = pieces(ids)
        if sizes[0] == 2:
            f = np.bincount(words, minlength=1)
            some = np.flatnonzero(f)
            yield from rows(lang, 0, pa.array([b""], pa.binary()), np.array([len(words)], np.int64))
            yield from rows(lang, 1, pa.array([known.words[i] for i in some.tolist()], pa.binary()), f[some])
        at = np.flatnonzero(left >= step)
        key = keys([_lang_key(lang), *(hashes[words[at + i]] for i in range(step))])[: len(at)] & np.uint64(len(bits.value) * 64 - 1)
        there = np.zeros(len(words), bool)
        there[at] = (bits.value[(key >> np.uint64(6)).astype(np.int64)] >> (key & np.uint64(63))) & np.uint64(1) > 0
        place, left = windows(left, there, step)
        words, there = words[place], there[place]
        order, common = suffixes(words, left, sizes[-1])
        numbers, words = np.unique(words, return_inverse=True)
        text = pa.array([known.words[i] for i in numbers.tolist()], pa.binary())
        for size in sizes:
            fits = (left >= size) & there
            for i in range(1, size - step + 1):
                fits[:-i] &= there[i:]
            start, f = intervals(order, common, fits, size)
            parts = [text.take(pa.array(words[start + i])) for i in range(size)]
            yield from rows(lang, size, pa.compute.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())), f)

    return _shards(texts, "lang string, size int, phrase string, f long", shard)


def _table(keyed: DataFrame, bits: int) -> np.ndarray:
    """Bit table (bits: a power of two) of keys(key). Spark puts its 64-bit words together; at most bits / 64 of them reach the driver."""
    at = F.col("key").bitwiseAND(F.lit(bits - 1))
    words = keyed.select(F.shiftright(at, 6).alias("word"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return table


def _keyed(phrases: DataFrame) -> DataFrame:
    """Keys of phrases(lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = [int(keys([np.array([_hash(w)], np.uint64) for w in (lang.encode(), *phrase.encode().split(b" "))])[0]) for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(key, np.uint64).view(np.int64))], names=["key"])

    return phrases.select("lang", "phrase").mapInArrow(run, "key long")


def frequent_phrases(texts: DataFrame, scratch: Scratch, words: int = WORDS, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """texts(lang, text) -> lang, size, phrase, f >= least, for sizes up to `words`; size 0 has the number of words of each lang."""
    cast = texts.select("lang", F.col("text").cast("binary"))

    def added(df: DataFrame, name: str) -> DataFrame:
        total = df.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
        return scratch.save(total.where((F.col("f") >= least) | (F.col("size") == 0)), name)

    pairs = scratch.save(_pairs(cast).groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least).select("key"), "pairs")
    found = added(_phrases(cast, 2, range(2, max(2, min(words, 3)) + 1), _table(pairs, bits)), "phrases")
    for size in range(4, words + 1):
        shorter = _keyed(found.where(F.col("size") == size - 1))
        found = found.unionByName(added(_phrases(cast, size - 1, range(size, size + 1), _table(shorter, bits)), f"phrases-{size}"))
    return found


def _wide(c: Column) -> Column:
    return c.cast("decimal(16,0)")


def _ranked(rows: DataFrame, scratch: Scratch, top: int) -> DataFrame:
    """rows with rank by lang, score, a and phrase. Sorted over all tasks, so no task gets a whole language; ranks are places in
    the sorted rows less those of the languages' first."""
    place = scratch.save(rows.orderBy("lang", F.desc("score"), F.desc("a"), "phrase").withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33)
    parts = place.groupBy("lang", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("many")).collect()
    before: dict[str, int] = {}
    starts = []
    for r in sorted(parts, key=lambda r: r["part"]):
        starts.append((r["lang"], r["part"], r["first"] - before.get(r["lang"], 0)))
        before[r["lang"]] = before.get(r["lang"], 0) + r["many"]
    offsets = rows.sparkSession.createDataFrame(starts, "lang string, part long, start long")
    joined = place.withColumn("part", part).join(offsets, ["lang", "part"])
    return joined.withColumn("rank", F.col("at") - F.col("start") + 1).where(F.col("rank") <= top)


def collocations(docs: DataFrame, words: int = WORDS, least: int = LEAST, top: int = TOP, bits: int = BITS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `words` words that occur `least` times or more.

    Texts, A-Z in lower case, are split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words ``[^\\x20\\x09]+``; phrases do not cross
    pieces, overlapping occurrences count. Null lang is 'und', null text empty; repeated rows count as often as they are there, ids do not
    matter. A phrase of a occurrences, cut into parts of l and r, scores floor(SCALE * a * a / (l * r)); the lowest cut counts, of equal
    ones the first. A phrase goes if a longer frequent one that holds it has COVERED per cent of its occurrences or more.
    Ranks go by score, a and the phrase in UTF-8 order. Empty tables give no rows.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    found = frequent_phrases(texts, scratch, words, least, bits)
    total = scratch.save(found.where("size = 0").select("lang", F.col("f").alias("n")), "words")
    phrases = found.where("size > 0").select("lang", "size", "phrase", F.col("f").alias("a"))
    part = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("many"))
    split = F.split("phrase", " ")
    inner = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> concat_ws(' ', slice(split(phrase, ' '), i, m)))))")
    longer = phrases.where("size > 2").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    held = phrases.where("size > 1").join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < COVERED * F.col("a")))
    cuts = held.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), split.alias("w"), "size")
    cuts = scratch.save(cuts.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("w", 1, F.col("k"))).alias("first"), F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.col("size") - F.col("k"))).alias("rest")), "cuts")
    both = cuts.join(part.select("lang", F.col("part").alias("first"), F.col("many").alias("l")), ["lang", "first"]).join(part.select("lang", F.col("part").alias("rest"), F.col("many").alias("r")), ["lang", "rest"])
    square = F.lit(SCALE).cast("decimal(7,0)") * (_wide(F.col("a")) * _wide(F.col("a")))
    score = F.call_function("div", square, _wide(F.col("l")) * _wide(F.col("r"))).cast("long")
    scored = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("x"))
    scored = scored.select("lang", "phrase", "a", "x.l", "x.r", "x.score").join(total, "lang")
    return _ranked(scored, scratch, top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
