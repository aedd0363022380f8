"""Medians, quantiles, fits and mask likeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value at place n/2 (from 0) of the sorted group. Ranked by window, so a group may exceed a task's memory."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).select(*keys, value, F.row_number().over(w.orderBy(value)).alias("__r"), F.count("*").over(w).alias("__n"))
    return ranked.where(F.col("__r") == F.floor(F.col("__n") / 2) + 1).select(*keys, F.col(value).alias("upper_median"))


def quantile(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """The least value that a share of its group does not exceed: equal values are counted first, then added up in order."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys)
    run = counts.select(*keys, value, F.sum("__n").over(w.orderBy(value)).alias("__run"), F.sum("__n").over(w).alias("__all"))
    return run.where(F.col("__run") >= F.ceil(F.col("__all") * share)).groupBy(*keys).agg(F.min(value).alias("quantile"))


def line_fit(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def mask_likeness(a: Column, b: Column) -> Column:
    """Shared set bits over all set bits of two arrays of booleans; 0 if none is set."""
    counted = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.struct((x & y).cast("int").alias("i"), (x | y).cast("int").alias("u"))),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("u")),
        lambda s, p: F.struct((s["i"] + p["i"]).alias("i"), (s["u"] + p["u"]).alias("u")),
        lambda s: F.when(s["u"] == 0, 0.0).otherwise(s["i"] / s["u"]),
    )
    return counted


def step_times(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Each row's time to the next of its group, in microseconds; null for the last."""
    nxt = F.lead(at).over(Window.partitionBy(*keys).orderBy(at, tie))
    return df.withColumn("micros", F.timestamp_diff("MICROSECOND", F.col(at), nxt))
