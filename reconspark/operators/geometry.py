"""Positioned words: rows, bands, labels and their values, crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconspark.storage import unbounded

WORD = "struct<text:string,x:double,y:double,width:double,height:double>"


def words(pages: DataFrame, ids: list[str], lines: str = "lines") -> DataFrame:
    """ids, line_no, word_no, text, x, y, width, height: a row for each word; lines without words give none."""
    return unbounded(pages).select(*ids, F.posexplode(lines).alias("line_no", "__line")).select(*ids, "line_no", F.posexplode("__line.words").alias("word_no", "__w")).select(*ids, "line_no", "word_no", "__w.*")


def spaced(positions: Column, least: Column | float) -> Column:
    """Of a sorted array the values that are more than least above the last value kept."""
    least = least if isinstance(least, Column) else F.lit(float(least))
    start = F.slice(positions, 1, 1)
    return F.aggregate(positions, start, lambda kept, p: F.when(p - F.element_at(kept, -1) > least, F.concat(kept, F.array(p))).otherwise(kept))


def row_clusters(ws: Column) -> Column:
    """Rows of an array of words sorted by (y, x).

    A word joins the first row whose mean centre is nearer than 0.65 of the larger of its height and the row's mean height; means
    move as words join. A row is a struct of n, the sums of centres and heights, and its words.
    """
    row = "struct<n:int,centres:double,heights:double,words:array<" + WORD + ">>"
    empty = F.array().cast(f"array<{row}>")

    def step(rows: Column, w: Column) -> Column:
        centre = w["y"] + w["height"] / 2
        fits = lambda r: F.abs(r["centres"] / r["n"] - centre) < 0.65 * F.greatest(w["height"], r["heights"] / r["n"])
        first = F.array_position(F.transform(rows, fits), True) - 1
        grown = lambda r: F.struct((r["n"] + 1).cast("int").alias("n"), (r["centres"] + centre).alias("centres"), (r["heights"] + w["height"]).alias("heights"), F.concat(r["words"], F.array(w)).alias("words"))
        new = F.struct(F.lit(1).alias("n"), centre.alias("centres"), w["height"].alias("heights"), F.array(w).alias("words"))
        return F.when(first >= 0, F.transform(rows, lambda r, i: F.when(i == first, grown(r)).otherwise(r))).otherwise(F.concat(rows, F.array(new))).cast(f"array<{row}>")

    return F.aggregate(F.transform(ws, lambda w: w.cast(WORD)), empty, step)


def cluster_rows(ws: DataFrame, ids: list[str]) -> DataFrame:
    """ids, row_no, n, text: the rows of each page, from the top; a row's words from the left, joined by a space."""
    page = ws.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("y", "x", "text", "width", "height"))).alias("ws"))
    sorted_ = F.transform("ws", lambda w: F.struct(w["text"].alias("text"), w["x"].alias("x"), w["y"].alias("y"), w["width"].alias("width"), w["height"].alias("height")))
    rows = F.array_sort(F.transform(row_clusters(sorted_), lambda r: F.struct((r["centres"] / r["n"]).alias("c"), r["n"].alias("n"), F.array_join(F.transform(F.array_sort(F.transform(r["words"], lambda w: F.struct(w["x"].alias("x"), w["text"].alias("t")))), lambda w: w["t"]), " ").alias("text"))))
    return page.select(*ids, F.posexplode(rows).alias("row_no", "r")).select(*ids, "row_no", "r.n", "r.text")


def bands(anchors: DataFrame, ids: list[str], at: str, last: Column | None = None, tie: str | None = None) -> DataFrame:
    """Anchors with band_end: the next anchor of the page, or `last`."""
    w = Window.partitionBy(*ids).orderBy(at, *([tie] if tie else []))
    return anchors.withColumn("band_end", F.coalesce(F.lead(at).over(w), *([last] if last is not None else [])))


def band_join(ws: DataFrame, banded: DataFrame, ids: list[str], centre: Column, at: str) -> DataFrame:
    """Words with the band that holds their centre; bands of a page do not overlap. An equi join by page with a range beside it."""
    return ws.join(banded, ids).where((centre >= F.col(at)) & (F.col("band_end").isNull() | (centre < F.col("band_end"))))


def nearest(labels: DataFrame, values: DataFrame, ids: list[str], distance: Column, order: list[str], keep: list[str], within: Column | None = None) -> DataFrame:
    """ids, label columns and the values nearest to each label, ties by order."""
    met = labels.join(values, ids)
    met = met if within is None else met.where(within)
    lead = F.min(F.struct(distance.alias("d"), *(F.col(c).alias(f"k{i}") for i, c in enumerate([*order, *keep])))).alias("__near")
    return met.groupBy(*labels.columns).agg(lead).select(*labels.columns, F.col("__near.d").alias("distance"), *(F.col(f"__near.k{i + len(order)}").alias(c) for i, c in enumerate(keep)))


def last_start(rows: DataFrame, starts: DataFrame, ids: list[str], at: str, start: str, keep: list[str], tie: str) -> DataFrame:
    """rows with the columns `keep` of the last start of their group at or before them (bands that follow each other without gaps).

    One sort of both sides together instead of a range join: linear in the size of a group. Rows before the first start get none.
    """
    kept = F.struct(*keep)
    a = rows.select(*ids, F.col(at).alias("__at"), F.lit(1).alias("__row"), F.lit(None).cast(starts.schema[tie].dataType).alias("__tie"), F.struct(*rows.columns).alias("__own"))
    b = starts.select(*ids, F.col(start).alias("__at"), F.lit(0).alias("__row"), F.col(tie).alias("__tie"), kept.alias("__kept"))
    w = Window.partitionBy(*ids).orderBy("__at", "__row", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__last", F.last("__kept", ignorenulls=True).over(w))
    return both.where("__row = 1 and __last is not null").select("__own.*", "__last.*")


def nearest_in_time(labels: DataFrame, values: DataFrame, ids: list[str], at: str, value_at: str, value_id: str) -> DataFrame:
    """labels with value_id and distance (microseconds) of the nearest value of their group, of equally near ones the least id.

    The neighbours before and after are found in two sorted passes; no pairs are made.
    """
    a = labels.select(*ids, F.col(at).alias("__at"), F.lit(1).alias("__row"), F.struct(*labels.columns).alias("__own"))
    b = values.select(*ids, F.col(value_at).alias("__at"), F.lit(0).alias("__row"), F.struct(F.col(value_at).alias("at"), F.col(value_id).alias("id")).alias("__value"))
    both = a.unionByName(b, allowMissingColumns=True)
    before = Window.partitionBy(*ids).orderBy("__at", "__row", F.desc("__value.id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*ids).orderBy(F.desc("__at"), "__row", F.desc("__value.id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__b", F.last("__value", ignorenulls=True).over(before)).withColumn("__a", F.last("__value", ignorenulls=True).over(after)).where("__row = 1")
    far = lambda c: F.struct(F.abs(F.timestamp_diff("MICROSECOND", F.col("__at"), F.col(f"{c}.at"))).alias("d"), F.col(f"{c}.id").alias("id"))
    best = F.array_min(F.filter(F.array(far("__b"), far("__a")), lambda x: x["id"].isNotNull()))
    return found.withColumn("__best", best).where("__best is not null").select("__own.*", F.col("__best.id").alias(value_id), F.col("__best.d").alias("distance"))


def map_crop(ws: Column, bounds: Column, scale: Column) -> Column:
    """Words read in a crop, at their places on the page."""
    return F.transform(ws, lambda w: F.struct(w["text"].alias("text"), (bounds["x"] + w["x"] / scale).alias("x"), (bounds["y"] + w["y"] / scale).alias("y"), (w["width"] / scale).alias("width"), (w["height"] / scale).alias("height")))


def merge_crop(ws: Column, bounds: Column, read: Column, scale: Column) -> Column:
    """The page's words outside a crop and those read in it, by (y, x)."""
    inside = lambda w: (w["x"] + w["width"] / 2).between(bounds["x"], bounds["x"] + bounds["w"]) & (w["y"] + w["height"] / 2).between(bounds["y"], bounds["y"] + bounds["h"])
    both = F.concat(F.filter(ws, lambda w: ~inside(w)), map_crop(read, bounds, scale))
    return F.array_sort(both, lambda a, b: F.when(a["y"] < b["y"], -1).when(a["y"] > b["y"], 1).when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(0))


def rectangle_overlap(a: Column, b: Column) -> Column:
    """The common part of two rectangles (x, y, w, h), or null."""
    x, y = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    w, h = F.least(a["x"] + a["w"], b["x"] + b["w"]) - x, F.least(a["y"] + a["h"], b["y"] + b["h"]) - y
    return F.when((w > 0) & (h > 0), F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))
