"""Reconciliation of keyed tables: conflicts, propagation, first wins, anti and semi joins, comparisons, versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Levels of findings, from the gravest.
LEVELS = ["Расхождение", "Проверить", "Наблюдение"]


def unique_or_null(df: DataFrame, keys: list[str], value: str, name: str | None = None) -> DataFrame:
    """keys, value, n_distinct: the only distinct value of each group, else null. A least and a greatest value suffice to tell."""
    lone = F.when(F.min(value) == F.max(value), F.max(value)).alias(name or value)
    return df.groupBy(*keys).agg(lone, F.count_distinct(value).alias("n_distinct"))


def propagate_unique(df: DataFrame, group: str, value: str) -> DataFrame:
    """Fills null values from the only value of the rows with the same (not null) group."""
    lone = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.when(F.min(value) == F.max(value), F.max(value)).alias("__lone"))
    return df.join(lone, group, "left").withColumn(value, F.coalesce(value, "__lone")).drop("__lone")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each group. Rows meet as one aggregated struct, so a hot group is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*(F.col(c).alias(f"r{i}") for i, c in enumerate(rest))), F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order))))
    return df.groupBy(*keys).agg(row.alias("__row")).select(*keys, *(F.col(f"__row.r{i}").alias(c) for i, c in enumerate(rest))).select(*df.columns)


def missing(expected: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    return expected.join(present.select(*on), on, "left_anti")


def having(expected: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    return expected.join(present.select(*on), on, "left_semi")


def distinct_conflict(df: DataFrame, keys: list[str], value: str, order: str | None = None, separator: str = " / ") -> DataFrame:
    """keys, values: groups with several values, joined by first appearance (or, without an order, by value)."""
    each = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order or value).alias("__first"))
    several = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__first", F.col(value).cast("string").alias("v")))).alias("__all")).where(F.size("__all") > 1)
    return several.select(*keys, F.array_join(F.transform("__all", lambda x: x["v"]), separator).alias("values"))


def concat_in_order(df: DataFrame, keys: list[str], value: str, order: str, separator: str = " ") -> DataFrame:
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]), separator).alias(value))


def compare(left: DataFrame, right: DataFrame, on: list[str], a: Column, b: Column, by: list[Column]) -> DataFrame:
    """by, compared, matched: pairs in which both sides are read, and those of them that agree."""
    both = a.isNotNull() & b.isNotNull()
    return left.join(right, on).groupBy(*by).agg(F.count_if(both).alias("compared"), F.count_if(both & (a == b)).alias("matched"))


def contained(facts: DataFrame, sets: DataFrame, on: list[str], value: str, member: str, name: str = "contained") -> DataFrame:
    """facts, and whether value is among the members of its key: a semi join by key and value, no set is gathered."""
    there = sets.select(*on, F.col(member).alias(value)).distinct().withColumn(name, F.lit(True))
    return facts.join(there, [*on, value], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def select_version(candidates: DataFrame, reads: DataFrame, keys: list[str], version: str) -> DataFrame:
    """keys, version, outcome: the only version of a group; of several the only one that was read; else skipped, version null."""
    kinds = candidates.select(*keys, version).distinct()
    seen = reads.select(*keys, version).where(F.col(version).isNotNull() & (F.col(version) != "")).distinct().withColumn("__read", F.lit(1))
    group = kinds.join(seen, [*keys, version], "left").groupBy(*keys).agg(F.count("*").alias("__n"), F.max(version).alias("__only"), F.count("__read").alias("__seen"), F.max(F.when(F.col("__read") == 1, F.col(version))).alias("__match"))
    pick = F.when(F.col("__n") == 1, F.col("__only")).when(F.col("__seen") == 1, F.col("__match"))
    outcome = F.when(F.col("__n") == 1, "only").when(F.col("__seen") == 1, "matched").otherwise("skipped")
    return group.select(*keys, pick.alias(version), outcome.alias("outcome"))


def with_keyless(left: DataFrame, right: DataFrame, key: str, salts: int = 32) -> DataFrame:
    """left joined by key; rows of right without a key go to every row of left, which is what the result holds.

    Rows of left are dealt to `salts` numbers, and each keyless row is offered once under each of them, so both joins are by equality.
    """
    names = [c for c in right.columns if c != key]
    keyed = left.join(right.where(F.col(key).isNotNull()), key)
    loose = right.where(F.col(key).isNull()).select(*names, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    every = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).join(loose, "__salt")
    return keyed.select(*left.columns, *names).unionByName(every.select(*left.columns, *names))


def severity(level: Column, levels: list[str] = LEVELS) -> Column:
    return reduce(lambda c, p: c.when(level == p[1], p[0]), list(enumerate(levels))[1:], F.when(level == levels[0], 0)).otherwise(len(levels) - 1)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Rank 1 to k of each group: Spark keeps k rows of a group in each task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def replace_subset(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """old with the rows that new has again replaced by those of new."""
    return old.join(new.select(*on).distinct(), on, "left_anti").unionByName(new)


def same_ids(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """One row: whether both sides have the same ids, each once in b (a choice must cover every page exactly)."""
    both = a.select(on).distinct().withColumn("__a", F.lit(1)).join(b.groupBy(on).agg(F.count("*").alias("__b")), on, "full")
    return both.agg((F.count_if(F.coalesce((F.col("__a") == 1) & (F.col("__b") == 1), F.lit(False))) == F.count("*")).alias("same"))


def union_findings(parts: list[DataFrame]) -> DataFrame:
    """All findings, each rule's in turn; of equal (code, topic, detail) the first, with its pages."""
    all_ = reduce(DataFrame.unionByName, (p.withColumn("__rule", F.lit(i)) for i, p in enumerate(parts)))
    cols = [c for c in all_.columns if c != "__rule"]
    keys = ["code", "topic", "detail"]
    return first_wins(all_, keys, ["__rule", *(c for c in cols if c not in keys)]).select(*cols)
