"""Ordered rules, dimension look-ups by priority, and scores of text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cascade(rules: list[tuple[Column, str]], default: str) -> Column:
    """The label of the first rule that holds; a null condition does not hold."""
    return reduce(lambda c, r: c.when(r[0], F.lit(r[1])), rules[1:], F.when(rules[0][0], F.lit(rules[0][1]))).otherwise(F.lit(default))


def choose(override: Column, manual: Column, automatic: Column) -> Column:
    """A choice of three states: the override if made, else manual or automatic."""
    return F.coalesce(override, F.coalesce(manual, F.lit(False)) | F.coalesce(automatic, F.lit(False)))


def by_dimension(df: DataFrame, text: Column, dimension: DataFrame, keys: list[str], default: str) -> DataFrame:
    """keys, name: the name of the least priority whose pattern the text contains. dimension(priority, pattern, name) is small
    by nature (a list of organisations); it is read as one array beside each row."""
    table = dimension.agg(F.array_sort(F.collect_list(F.struct("priority", "pattern", "name"))).alias("__dim"))
    first = F.get(F.filter("__dim", lambda d: text.contains(d["pattern"])), F.lit(0))["name"]
    return df.join(F.broadcast(table)).select(*keys, F.coalesce(first, F.lit(default)).alias("name"))


def keyword_score(text: Column, keywords: str, word: str, weight: int = 25) -> Column:
    return (F.regexp_count(text, F.lit(keywords)) * weight + F.regexp_count(text, F.lit(word))).cast("long")
