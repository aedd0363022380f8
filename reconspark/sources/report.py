"""The report of an audit as one HTML page and the comparison of two runs, written by Spark's text writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconspark.functions.text import html_escape
from reconspark.operators.reconcile import severity

HEAD = "<!DOCTYPE html><html lang='ru'><head><meta charset='utf-8'><title>Отчёт</title></head><body>"


def table_rows(df: DataFrame, part: int, title: str, order: Column) -> DataFrame:
    """(part, place, line): a table with a heading; every cell escaped, arrays joined."""
    text = lambda c: html_escape(F.array_join(F.col(c).cast("array<string>"), ", ") if dict(df.dtypes)[c].startswith("array") else F.col(c).cast("string"))
    cells = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), text(c), F.lit("</td>")) for c in df.columns), F.lit("</tr>"))
    body = df.select(F.lit(part).alias("part"), F.struct(F.lit(1).alias("k"), order.cast("string").alias("o"), cells.alias("l")).alias("place"), cells.alias("line"))
    head = f"<h2>{title}</h2><table><tr>" + "".join(f"<th>{c}</th>" for c in df.columns) + "</tr>"
    edge = lambda k, line: F.struct(F.struct(F.lit(k).alias("k"), F.lit("").alias("o"), F.lit(line).alias("l")).alias("place"), F.lit(line).alias("line"))
    ends = df.sparkSession.range(1).select(F.lit(part).alias("part"), F.inline(F.array(edge(0, head), edge(2, "</table>"))))
    return body.select("part", "place", "line").unionByName(ends)


def write_html(path: str, findings: DataFrame, inventory: DataFrame, counters: DataFrame) -> None:
    """Counters, findings from the gravest level on, and inventory. A report is one file, so its lines meet in one task at the end."""
    spark = findings.sparkSession
    grave = F.concat(severity(F.col("level")).cast("string"), F.coalesce("code", F.lit("")))
    parts = table_rows(counters, 1, "Итоги", F.lit("")).unionByName(table_rows(findings, 2, "Замечания", grave)).unionByName(table_rows(inventory, 3, "Опись", F.col("code")))
    frame = lambda part, line: spark.range(1).select(F.lit(part).alias("part"), F.struct(F.lit(0).alias("k"), F.lit("").alias("o"), F.lit(line).alias("l")).alias("place"), F.lit(line).alias("line"))
    whole = parts.unionByName(frame(0, HEAD)).unionByName(frame(9, "</body></html>"))
    whole.repartition(1).sortWithinPartitions("part", "place").select("line").write.mode("overwrite").text(path)
