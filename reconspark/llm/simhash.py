"""SimHash near-duplicates by multi-index hashing: small Hamming balls in segments, then complete distances."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reconspark.llm.common import Scratch, mixed, words
from reconspark.llm.components import components

#: For each byte value, its bits from the most significant one.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
CHUNK = 1 << 16
#: Chance that a pair at the aimed distance shares no entry, at every size of the corpus.
MISS = 0.03
#: Bits of a segment at least; rows a task takes up at once; pairs compared at once; members of an entry that is not cut into blocks.
LEAST_WIDTH, HELD, PAIRS, MEMBERS = 12, 100_000, 500_000, 50_000


def fingerprint(text: str | None, shingle: int = 3, lanes: int = 1) -> list[int]:
    """lanes signed 64-bit parts: a bit is 1 if set in over half of the XXH64 (seed 42) of the shingles, repeats included.

    A-Z are lower-cased. Fewer words than a shingle: the whole sequence is one; none: all zero. Lanes after the
    first take the mixed hashes, so one pass over the text gives as many bits as wanted.
    """
    w = [x.lower() for x in words(text)]
    if not w:
        return [0] * lanes
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else iter([b" ".join(w)])
    n = max(1, len(w) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, 42) for g in grams), np.uint64, n)
    column = np.arange(8, dtype=np.int64) * 256
    out = []
    for lane in range(lanes):
        counts = np.zeros(2048, np.int64)
        for at in range(0, n, CHUNK):
            h = hashes[at : at + CHUNK]
            h = mixed(h, lane) if lane else h
            counts += np.bincount((h.astype(">u8").view(np.uint8).reshape(-1, 8) + column).ravel(), minlength=2048)
        ones = np.einsum("cv,vb->cb", counts.reshape(8, 256), BITS).ravel()
        out.append(int(np.packbits(ones * 2 > n).view(">i8")[0]))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text", tag_col: str | None = None) -> DataFrame:
    """(doc_id, f0, f1, ...): one row per row of docs. tag_col: a column of longs that goes along as tag."""
    tag = [F.col(tag_col).cast("long").alias("tag")] if tag_col else []
    kind = pa.schema([("doc_id", pa.int64()), *(("tag", pa.int64()) for _ in tag), *((f"f{i}", pa.int64()) for i in range(lanes))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [fingerprint(t.as_py(), shingle, lanes) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array([p[i] for p in parts], pa.int64()) for i in range(lanes))], schema=kind)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *tag, F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, " + "tag long, " * len(tag) + ", ".join(f"f{i} long" for i in range(lanes)))


def exact_links(classes: DataFrame, radius: int) -> DataFrame:
    """classes(rep, f0): distinct fingerprints of 64 bits. (a, b), a < b, for each two at most radius (up to 3) bits apart.

    Of two fingerprints within the radius either the high halves differ in at most radius // 2 bits or the low halves in
    at most radius - radius // 2 - 1: the balls of these sizes around both halves miss nothing.
    """
    if radius > 3:
        raise ValueError("balls of radius 0 and 1 are enumerated, so one lane serves a radius up to 3")
    half = lambda shift: F.shiftrightunsigned(F.col("f0"), shift).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    parts = [(32, radius // 2), (0, radius - radius // 2 - 1)][: 2 if radius else 1]

    def ball(shift: int, size: int) -> F.Column:
        near = [half(shift).bitwiseXOR(F.lit(1 << b).cast("long")) for b in range(32)] if size else []
        return F.array(*(F.struct(F.lit(shift).alias("part"), k.alias("key")) for k in [half(shift), *near]))

    left = classes.select(F.col("rep").alias("a"), F.col("f0").alias("fa"), F.inline(F.concat(*(ball(*p) for p in parts))))
    right = classes.select(F.col("rep").alias("b"), F.col("f0").alias("fb"), F.inline(F.concat(*(ball(s, 0) for s, _ in parts))))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= radius)
    return left.join(right, (left["part"] == right["part"]) & (left["key"] == right["key"]) & near).select("a", "b").distinct()


def ball_chance(width: int, differ: float, radius: int) -> float:
    """Chance that of `width` bits, each of which differs with this chance, at most `radius` do."""
    return sum(math.comb(width, k) * differ**k * (1 - differ) ** (width - k) for k in range(radius + 1))


def segment_bits(distinct: int, lanes: int, aim: int) -> np.ndarray:
    """Bit numbers of each segment, segments x width, for so many fingerprints of 64 * lanes bits.

    Balls of one flipped bit are drawn around both fingerprints of a pair, so a segment finds the pairs that differ in at most
    two of its bits. There are as many segments as leave a pair of `aim` differing bits unfound with chance MISS. They have
    LEAST_WIDTH bits up to 2^18 fingerprints and beyond that a bit more for each doubling, which keeps an entry at under a thousand
    strangers, and then there are more of them, so the chance stays. Segments have no bit in common while 64 * lanes bits suffice;
    further ones are cut out of further shuffles of the bits.
    """
    width, bits = max(LEAST_WIDTH, math.ceil(math.log2(max(2, distinct))) - 6), 64 * lanes
    count, per = math.ceil(math.log(MISS) / math.log(1 - ball_chance(width, aim / bits, 2))), bits // width
    r = np.random.Generator(np.random.PCG64(width))
    return np.concatenate([r.permutation(bits)[: per * width].reshape(per, width) for _ in range(-(-count // per))])[:count]


def segment_entries(numbered: DataFrame, lanes: int, segments: np.ndarray, kept: list[str]) -> DataFrame:
    """numbered(kept..., f0, ...) -> (kept..., key): a row for each segment value in the ball of one flipped bit around the
    fingerprint's own, itself included. The segment's number is in the key's upper part."""
    count, width = segments.shape
    number, step = np.arange(count, dtype=np.int64) << 40, max(1, 400_000 // (count * (1 + width)))
    masks = np.concatenate([np.zeros(1, np.int64), np.int64(1) << np.arange(width, dtype=np.int64)])
    prints = [f"f{i}" for i in range(lanes)]
    schema = T.StructType([*numbered.select(*kept).schema.fields]).add("keys", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                parts = np.stack([b.column(b.schema.get_field_index(p)).to_numpy() for p in prints], axis=1)
                bits = np.ascontiguousarray(np.unpackbits(parts.astype("<i8").view(np.uint8), axis=1, bitorder="little").T)
                own = np.repeat(number[:, None], b.num_rows, axis=1)
                for place in range(width):
                    own |= bits[segments[:, place]].astype(np.int64) << place
                keys = (own.T[:, :, None] ^ masks).ravel()
                ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * (count * len(masks)))
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in kept), pa.ListArray.from_arrays(ends, pa.array(keys))], names=schema.names)

    return numbered.select(*dict.fromkeys([*kept, *prints])).mapInArrow(run, schema).select(*kept, F.explode("keys").alias("key"))


def entry_groups(prints: np.ndarray, radius: int) -> np.ndarray:
    """The members of one entry (member x lane): for each the first member of its group over links of at most radius bits.

    All are compared, in blocks of bounded size: by two lanes first, which pass every pair within the radius but one in some
    ten thousand, and those that are not yet in one group by all lanes.
    """
    n, lanes = prints.shape
    first = np.arange(n)
    share, wide = radius / (64 * lanes), 64 * min(2, lanes)
    slack = math.ceil(wide * share + 4 * math.sqrt(wide * share * (1 - share)))
    columns = [np.ascontiguousarray(prints[:, k]) for k in range(min(2, lanes))]
    step = max(1, PAIRS // n)
    for at in range(0, n, step):
        apart = sum(np.bitwise_count(c[at : at + step, None] ^ c[None, at:]).astype(np.uint8) for c in columns)
        i, j = np.nonzero(apart <= slack)
        i, j = i[j > i] + at, j[j > i] + at
        new = first[i] != first[j]
        i, j = i[new], j[new]
        near = np.bitwise_count(prints[i] ^ prints[j]).sum(1, dtype=np.int64) <= radius
        i, j = i[near], j[near]
        while len(i):
            a, b = first[i], first[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            new = low < high
            if not new.any():
                break
            i, j = i[new], j[new]
            to = np.arange(n)
            np.minimum.at(to, high[new], low[new])
            while (to[to] != to).any():
                to = to[to]
            first = to[first]
    return first


def meetings(entries: DataFrame, lanes: int, radius: int) -> DataFrame:
    """entries(key, part, num, f0, ...) -> (x, y): members of each entry and the first member of their group.

    One shuffle by key; a task reads its entries in order and holds a bounded number. What it returns spans the groups, at most a row
    for each member, however many pairs are within the radius.
    """
    kind = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, part, num, *prints = rows
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])).tolist()
            together, x, y = np.stack(prints, axis=1).view(np.uint64), [], []
            for a, z in zip(starts, [*starts[1:], len(key)], strict=True):
                if z - a > 1:
                    first = entry_groups(together[a:z], radius)
                    moved = np.flatnonzero(first != np.arange(z - a))
                    x.append(num[a:z][moved])
                    y.append(num[a:z][first[moved]])
            if sum(map(len, x)):
                both = np.unique(np.stack([np.concatenate(x), np.concatenate(y)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], schema=kind)

        held: list[list[np.ndarray]] = []
        for b in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            held.append(rows)
            if sum(len(h[0]) for h in held) < HELD or (held[0][0][0], held[0][1][0]) == (rows[0][-1], rows[1][-1]):
                continue
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))[-1] + 1  # the last entry may go on
            yield from settle([r[:cut] for r in rows])
            held = [[r[cut:] for r in rows]]
        if held:
            yield from settle([np.concatenate(c) for c in zip(*held, strict=True)])

    dealt = entries.select("key", "part", "num", *(f"f{i}" for i in range(lanes))).repartition("key", "part").sortWithinPartitions("key", "part", "num")
    return dealt.mapInArrow(run, "x long, y long").distinct()


def wide_links(classes: DataFrame, lanes: int, radius: int, distinct: int, scratch: Scratch, aim: int | None = None) -> DataFrame:
    """classes(rep, f0, ...): distinct fingerprints of many lanes. (a, b) pairs that span the groups of those within the radius.

    Each fingerprint goes to the entries of the balls around its segments; all members of an entry are compared by complete
    distance. So two fingerprints within the radius that share an entry always end in one group; how many share one, see
    segment_bits (aim: the number of differing bits that it looks at, by default the radius). An entry of more than MEMBERS is cut
    into blocks, and each two of its blocks meet in a task of their own.
    """
    prints = [f"f{i}" for i in range(lanes)]
    numbered = scratch.save(classes.withColumn("num", F.monotonically_increasing_id()), "numbered")
    segments = segment_bits(distinct, lanes, aim or radius)
    # As many rows as keys leave each task, whatever the number of fingerprints.
    hot = segment_entries(numbered, lanes, segments, []).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MEMBERS)
    hot = scratch.save(hot.select("key", F.ceil(F.col("n") / MEMBERS).alias("blocks")), "hot")
    entries = segment_entries(numbered, lanes, segments, ["num", *prints])
    if hot.limit(1).count():
        own = F.pmod(F.xxhash64("num"), F.col("blocks"))
        square = lambda c: F.least(own, c) * F.col("blocks") + F.greatest(own, c)
        parts = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), square))
        entries = entries.join(hot, "key", "left").withColumn("part", F.explode(parts))
    else:
        entries = entries.withColumn("part", F.lit(0).cast("long"))
    met = scratch.save(meetings(entries, lanes, radius), "met")
    # A member that met several first ones keeps the least, and the others are linked to that: few of them are distinct.
    least = scratch.save(met.groupBy("x").agg(F.min("y").alias("least")), "least")
    others = met.join(least, "x").where("y <> least").select(F.col("y").alias("x"), F.col("least").alias("y")).distinct()
    met = scratch.save(least.select("x", F.col("least").alias("y")).union(others), "spanning")
    names = numbered.select("num", "rep")
    return met.join(names.withColumnsRenamed({"num": "x", "rep": "a"}), "x").join(names.withColumnsRenamed({"num": "y", "rep": "b"}), "y").select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 3, lanes: int = 1, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", tag_col: str | None = None, aim: int | None = None) -> DataFrame:
    """(doc_id, f0.., component_id): the smallest doc_id reachable over links of at most radius differing bits.

    One lane (64 bits, a radius up to 3): every such link is found. More lanes, for a lower similarity: see wide_links, also for aim.

    Copies meet in one class per fingerprint first, so the links, tables and components hold distinct fingerprints
    only and a group of copies of any size costs one row there. Null or wordless texts have fingerprint zero and are linked
    like any other; rows with a null id keep their row (their class is named by its least other id, else null).
    Rows with one id and several texts are several documents. Repeated rows give repeated rows; an empty table gives an empty one; other columns are not read.
    tag_col: a column of longs that goes along as tag; then component names each component, also where some share a component_id.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    names = [f"f{i}" for i in range(lanes)]
    prints = scratch.save(fingerprints(docs, shingle, lanes, id_col, text_col, tag_col), "prints")
    # A class is named by its least id and its fingerprint: ids that repeat under other texts stay apart.
    mark = F.col("f0") if lanes == 1 else F.xxhash64(*names)
    classes = prints.groupBy(*names).agg(F.min("doc_id").alias("id")).select(*names, F.struct("id", mark.alias("mark")).alias("rep"))
    classes = scratch.save(classes, "classes")
    named = classes.where("rep.id is not null")
    linked = exact_links(named, radius) if lanes == 1 else wide_links(named, lanes, radius, named.count(), scratch, aim)
    found = components(linked, scratch)
    owner = scratch.save(classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(*names, F.coalesce("label.id", "rep.id").alias("component_id"), *([F.coalesce("label", "rep").alias("component")] if tag_col else [])), "owner")
    scratch.keep("prints", "owner")
    return prints.join(owner, names).select("doc_id", *names, "component_id", *(["tag", "component"] if tag_col else []))
