"""How far the sources of a language differ in their words: shards summed up by DuckDB, merged by Spark.

Texts become partial counts of terms in their own task. Those are dealt into shards by language and term, so that all counts of a term meet in
one shard and a frequent language fills all of them. In each shard DuckDB adds up the counts, and, once the totals are known, the sums over
pairs of sources and the best terms of each source; Spark adds the sums of the shards and ranks.

A pair's sum runs over all terms of the language, but most terms are missing in most sources. With p0 for the probability that
a source gives a term it lacks, |p - q| summed over all terms is: for terms in both, the distance less what the two next lines add for
them; for terms of one source, the distance from the other's p0; and |p0 - q0| for each term that is left. Only the first is a sum over pairs and
terms; the second depends on the other source by its p0 alone, so it is read off running sums over the source's sorted p.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconspark.llm.common import Scratch

#: What a group must have: documents of its language a term, added counts, terms reported, and the whole of a group's probability.
LEAST_DOCS, ADDED, TOP, WHOLE = 30, 5, 50, 1_000_000_000
#: Terms of rows that a task holds before it passes its counts on, and what DuckDB may hold before it uses the disk.
HELD, MEMORY = 2_000_000, "256MB"
#: Letters A-Z become lower case, other ASCII that is no letter a space; all bytes of other characters stay.
LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def terms(raw: bytes | None) -> list[bytes]:
    """Terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a text in UTF-8, with A-Z in lower case."""
    return raw.translate(LETTERS).split() if raw else []


class Ids(dict):
    """Numbers of terms, in order of appearance."""

    def __missing__(self, term: bytes) -> int:
        self[term] = out = len(self)
        return out


def _counted(docs: DataFrame) -> DataFrame:
    """docs(lang, source, text as binary) -> partial lang, source, term, n occurrences, d rows that hold it."""
    names = ["lang", "source", "term", "n", "d"]

    def out(groups: Ids, known: Ids, held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key = np.concatenate([t + (g << 32) for g, t, _ in held])
        order = np.argsort(key)
        key, n = key[order], np.concatenate([n for *_, n in held])[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
        group, term = pa.array(key[first] >> 32), pa.array(key[first] & 0xFFFFFFFF)
        lang, source = (pa.array([g[i] for g in groups], pa.string()).take(group) for i in (0, 1))
        words = pa.array(list(known), pa.binary()).cast(pa.string()).take(term)
        sums = np.add.reduceat(n, first) if len(first) else n
        return pa.RecordBatch.from_arrays([lang, source, words, pa.array(sums), pa.array(np.diff(np.append(first, len(key))))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, known, held, size = Ids(), Ids(), [], 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                found = terms(text.as_py())
                ids, n = np.unique(np.fromiter(map(known.__getitem__, found), np.int64, len(found)), return_counts=True)
                held.append((groups[lang, source], ids, n))
                size += len(ids)
                if size > HELD or len(known) > HELD:
                    yield out(groups, known, held)
                    groups, known, held, size = Ids(), Ids(), [], 0
        if held:
            yield out(groups, known, held)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, d long")


def _in_shards(rows: DataFrame, sql: str, schema: str) -> DataFrame:
    """Deals rows by language and term, and runs SQL over each shard (as `shard`) in DuckDB, on one thread, with bounded memory."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tempfile

        first = next(batches, None)
        if first is None:
            return
        with tempfile.TemporaryDirectory() as spilled, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spilled}) as con:
            con.register("batch", first)
            con.execute(f"create table shard as select {', '.join(names)} from batch")
            for b in batches:
                con.register("batch", b)
                con.execute(f"insert into shard select {', '.join(names)} from batch")
            con.unregister("batch")
            yield from con.sql(sql).to_arrow_reader(50_000)

    return rows.repartition("lang", "term").mapInArrow(run, schema)


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(WHOLE * (count + ADDED) / (total + ADDED * kept)); decimals, since the product may pass 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    product = F.lit(WHOLE).cast("decimal(10,0)") * wide(count + ADDED)
    return F.call_function("div", product, wide(total + ADDED * kept)).cast("long") + 1


#: Of a shard of partial counts: each kept term's count by source and in all, and a mark on one row of each term.
COUNTS = """
with t as (select lang, term, source, sum(n)::bigint as n, sum(d)::bigint as d from shard group by all),
w as (select *, sum(d) over w as docs, sum(n) over w as whole, row_number() over (partition by lang, term order by source) as k from t window w as (partition by lang, term))
select lang, term, source, n, whole::bigint as whole, (k = 1)::bigint as head from w where docs >= {least}"""

#: Of a shard of p, p0 and q (the language's p) by kept term and source, rows of three kinds: a source's numbers of terms by p, its best
#: terms, and what the terms that two sources share add beyond what each adds on its own.
SUMS = """
select 'p' as kind, lang, source, '' as item, p as x, count(*)::bigint as y from shard group by lang, source, p
union all
select 'term', lang, source, term, p - q, 0 from (
  select *, row_number() over (partition by lang, source order by p - q desc, term) as k from shard where p > q) where k <= {top}
union all
select 'pair', a.lang, a.source, b.source, sum(abs(a.p - b.p) - abs(a.p - b.p0) - abs(a.p0 - b.p) + abs(a.p0 - b.p0))::bigint, 0
from shard a join shard b on a.lang = b.lang and a.term = b.term and a.source < b.source group by a.lang, a.source, b.source"""


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): each source against the others of its language, and the terms that mark it.

    Null lang, source and text are ''. A language keeps the terms that `least_docs` of its rows hold (rows are documents, so repeated
    rows count). For each kept term a source, and the language, has the share p of _share. Part `pair`: item is another source,
    value the sum of |p - q| over all kept terms, every pair ranked. Part `term`: item is a kept term that the source has, value
    what its p is above the language's, the first `top`. Ranks go by falling value, then by item in UTF-8 order. A source
    without terms is compared all the same; one that is alone in its language has no pair. Empty tables give no rows.

    The pairs within a language are the result itself, one row for either order. The shards' sums hold no more than a row a pair.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    counts = scratch.save(_in_shards(_counted(named), COUNTS.format(least=least_docs), "lang string, term string, source string, n long, whole long, head long"), "counts")
    of_lang = counts.groupBy("lang").agg(F.sum("n").alias("all_n"), F.sum("head").alias("v"))
    of_source = counts.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count("*").alias("terms"))
    found = named.groupBy("lang", "source").agg(F.count("*")).select("lang", "source")
    filled = found.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["own_n", "terms", "all_n", "v"])
    p0 = F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("own_n"), F.col("v"))).otherwise(0)
    groups = scratch.save(filled.withColumn("p0", p0.cast("long")), "groups")
    shares = counts.join(groups, ["lang", "source"]).select("lang", "term", "source", _share(F.col("n"), F.col("own_n"), F.col("v")).alias("p"), "p0", _share(F.col("whole"), F.col("all_n"), F.col("v")).alias("q"))
    sums = scratch.save(_in_shards(shares, SUMS.format(top=top), "kind string, lang string, source string, item string, x long, y long"), "sums")

    # Each source's terms against p0 of another: twice what the terms below p0 lack, besides the difference of the sums.
    points = sums.where("kind = 'p'").groupBy("lang", "source", F.col("x").alias("p")).agg(F.sum("y").alias("many"))
    points = points.select("lang", "source", F.lit("").alias("item"), "p", "many", F.lit(0).cast("long").alias("p0"), F.lit(0).cast("long").alias("v"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("p"))
    asked = groups.select("lang", "source", "p0", "v").join(other, "lang").where("source <> item").select("lang", "source", "item", "p", F.lit(0).cast("long").alias("many"), "p0", "v")
    below = Window.partitionBy("lang", "source").orderBy("p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("lang", "source")
    weight = F.col("many") * F.col("p")
    single = points.unionByName(asked).select(
        "lang", "source", "item", "p", "many", "p0", "v",
        F.sum("many").over(below).alias("under"), F.sum(weight).over(below).alias("under_p"), F.sum("many").over(whole).alias("all"), F.sum(weight).over(whole).alias("all_p"),
    ).where("v > 0 and many = 0")
    apart = F.abs(F.col("p0") - F.col("p"))
    alone = F.col("all_p") - F.col("all") * F.col("p") + 2 * (F.col("under") * F.col("p") - F.col("under_p")) - F.col("all") * apart
    # Every term adds |p0 - q0| once, which the two halves of a pair share: the half with the smaller name carries it.
    single = single.select("lang", "source", "item", (alone + F.when(F.col("source") < F.col("item"), F.col("v") * apart).otherwise(0)).alias("value"))
    empty = groups.select("lang", "source", "v").join(other.select("lang", "item"), "lang").where("source < item and v = 0").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    halves = single.unionByName(sums.where("kind = 'pair'").select("lang", "source", "item", F.col("x").alias("value"))).unionByName(empty)
    low, high = F.least("source", "item"), F.greatest("source", "item")
    pairs = halves.groupBy("lang", low.alias("a"), high.alias("b")).agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    pair = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    term = sums.where("kind = 'term'").select("lang", "source", F.lit("term").alias("part"), "item", F.col("x").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pair.withColumn("rank", F.row_number().over(order)).unionByName(best)
