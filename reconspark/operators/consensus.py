"""Voting over repeated readings of one field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses of a vote.
UNREAD, SINGLE, CONFIRMED, MAJORITY, DISPUTED = "Не распознано", "Одно чтение", "Подтверждено повторным чтением", "Большинство чтений; были альтернативы", "Спорное чтение"
LATIN_NOTE = "; чтение латинского CRC по фрагменту"


def is_blank(x: Column) -> Column:
    return x.isNull() | (F.trim(x) == "")


def consensus(reads: DataFrame, keys: list[str], value: str, seq: str, source: str | None = None) -> DataFrame:
    """keys, value, status, candidates, agreement, attempts (and sources): the vote of each group.

    One distinct value wins, confirmed by two readings or more; else a value with two readings and at least twice those of
    the runner-up. Blank readings count as attempts only. Candidates stand by falling count, equal ones by first reading. Counts
    are aggregated by value before values meet, so a group of any size costs a row for each distinct value.
    """
    v = F.when(~is_blank(F.col(value)), F.col(value))
    by_value = reads.groupBy(*keys, v.alias("__v")).agg(F.count("*").alias("__n"), F.min(seq).alias("__first"), *([F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.concat(F.col(source), F.lit(": "), F.col(value)).alias("t")))).alias("__src")] if source else []))
    told = F.when(F.col("__v").isNotNull(), F.struct((-F.col("__n")).alias("n"), F.col("__first").alias("first"), F.col("__v").alias("v")))
    sources = [F.transform(F.array_sort(F.flatten(F.collect_list(F.when(F.col("__v").isNotNull(), F.col("__src"))))), lambda x: x["t"]).alias("sources")] if source else []
    group = by_value.groupBy(*keys).agg(F.array_sort(F.collect_list(told)).alias("__all"), F.sum("__n").alias("attempts"), *sources)
    size, top = F.size("__all"), -F.get("__all", F.lit(0))["n"]
    second = -F.get("__all", F.lit(1))["n"]
    wins = (size == 1) | (top >= 2) & (top >= 2 * second)
    status = F.when(size == 0, UNREAD).when(size == 1, F.when(top >= 2, CONFIRMED).otherwise(SINGLE)).when(wins, MAJORITY).otherwise(DISPUTED)
    return group.select(
        *keys,
        F.when(F.coalesce(wins, F.lit(False)), F.get("__all", F.lit(0))["v"]).alias("value"),
        status.alias("status"),
        F.transform("__all", lambda x: x["v"]).alias("candidates"),
        F.coalesce(top, F.lit(0)).cast("long").alias("agreement"),
        F.col("attempts").cast("long").alias("attempts"),
        *(["sources"] if source else []),
    )


def stable(reads: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, stable: whether two readings or more are not blank and all of those agree."""
    v = F.when(~is_blank(F.col(value)), F.col(value))
    return reads.groupBy(*keys).agg(((F.count(v) >= 2) & (F.min(v) == F.max(v))).alias("stable")).select(*keys, F.coalesce("stable", F.lit(False)).alias("stable"))


def crc_consensus(reads: DataFrame, keys: list[str], value: str, seq: str, source: str, special: str) -> DataFrame:
    """As consensus, but the readings marked special decide alone if two of them or more are not blank."""
    every = consensus(reads, keys, value, seq, source)
    chosen = reads.where(F.col(special))
    few = chosen.groupBy(*keys).agg(F.count(F.when(~is_blank(F.col(value)), 1)).alias("__n")).where("__n >= 2")
    seen = reads.where(~is_blank(F.col(value))).groupBy(*keys, value).agg(F.min(seq).alias("__s")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__s", F.col(value).alias("v")))), lambda x: x["v"]).alias("__seen"))
    alone = consensus(chosen, keys, value, seq).select(*keys, F.struct("value", "status", "agreement", "attempts").alias("__alone"))
    both = every.join(few, keys, "left").join(alone, keys, "left").join(seen, keys, "left")
    use = F.col("__n").isNotNull()
    pick = lambda c: F.when(use, F.col(f"__alone.{c}")).otherwise(F.col(c)).alias(c)
    status = F.when(use, F.concat(F.col("__alone.status"), F.lit(LATIN_NOTE))).otherwise(F.col("status")).alias("status")
    return both.select(*keys, pick("value"), status, F.when(use, F.col("__seen")).otherwise(F.col("candidates")).alias("candidates"), pick("agreement"), pick("attempts"), "sources")


def best_sample(samples: DataFrame, keys: list[str], label: str, score: str, least: float = 0.65, lead: float = 0.12, never: str = "0") -> DataFrame:
    """keys, label: of the best score of each label the highest one, if it is high enough and leads the next by enough."""
    w = Window.partitionBy(*keys).orderBy(F.desc("__s"), F.col(label))
    ranked = samples.groupBy(*keys, label).agg(F.max(score).alias("__s")).withColumn("__next", F.lead("__s").over(w)).withColumn("__rank", F.row_number().over(w))
    good = (F.col("__s") >= least) & (F.col("__s") - F.coalesce("__next", F.lit(0.0)) >= lead) & (F.col(label) != never)
    return ranked.where((F.col("__rank") == 1) & good).select(*keys, label)
