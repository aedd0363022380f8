"""Scores of a report against hand labels, and the comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORRECT, WRONG, MISSING = "Верно", "Неверно", "Не распознано"


def field_status(expected: Column, actual: Column) -> Column:
    e, a = F.coalesce(expected, F.lit("")), F.coalesce(actual, F.lit(""))
    return F.when(a == e, CORRECT).when(a == "", MISSING).otherwise(WRONG)


def field_details(expected: DataFrame, pages: DataFrame, fields: list[str]) -> DataFrame:
    """photo, field, expected, actual, status: the labelled values beside what the pages say (unpivoted)."""
    actual = pages.select(F.col("id").alias("photo"), *(F.col(f).cast("string").alias(f) for f in fields)).unpivot("photo", fields, "field", "actual")
    joined = expected.select("photo", "field", F.col("value").alias("expected")).join(actual, ["photo", "field"], "left")
    return joined.withColumn("actual", F.coalesce("actual", F.lit(""))).withColumn("status", field_status(F.col("expected"), F.col("actual")))


def matches(labels: DataFrame, findings: DataFrame) -> DataFrame:
    """label_id, finding_id: same code, topic equal or among topics, and, if the label names a page, that page. A null code is empty."""
    a = labels.select(F.coalesce("code", F.lit("")).alias("code"), "label_id", F.explode(F.coalesce("topics", F.array("topic"))).alias("topic"), "photo")
    b = findings.select(F.coalesce("code", F.lit("")).alias("code"), "finding_id", "topic", "photos")
    return a.join(b, ["code", "topic"]).where(F.col("photo").isNull() | F.array_contains("photos", F.col("photo"))).select("label_id", "finding_id").distinct()


def metrics(pages: DataFrame, findings: DataFrame, known: DataFrame, negative: DataFrame, expected: DataFrame) -> DataFrame:
    """One row of counts. known, negative: label_id, code, topic, topics, photo; findings: finding_id, level, code, topic, photos."""
    has = lambda c: F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    page = pages.agg(F.count("*").alias("images"), has("CRC").alias("crc_recognized"), has("Revision").alias("revision_recognized"), has("Page").alias("pages_recognized"))
    level = findings.agg(F.count_if(F.col("level") == "Проверить").alias("warnings"), F.count_if(F.col("level") == "Расхождение").alias("discrepancies"))
    hit, false = matches(known, findings), matches(negative, findings)
    one = lambda d, c, n: d.agg(F.count_distinct(c).alias(n))
    loose = findings.join(hit.union(false).select("finding_id").distinct(), "finding_id", "left_anti").agg(F.count("*").alias("unlabelled_findings"))
    status = field_details(expected, pages, ["CRC", "Page", "Revision"]).agg(F.count("*").alias("fields_total"), *(F.count_if(F.col("status") == s).alias(n) for s, n in ((CORRECT, "fields_correct"), (WRONG, "fields_wrong"), (MISSING, "fields_missing"))))
    out = page
    for part in (level, known.agg(F.count("*").alias("known_total")), one(hit, "label_id", "known_found"), negative.agg(F.count("*").alias("negative_total")), one(false, "label_id", "false_warnings"), loose, status):
        out = out.join(F.broadcast(part))  # each part is one row
    return out


def compare_runs(runs: DataFrame, run: str, measures: list[str]) -> DataFrame:
    """measure, before, after, change: two rows of measures side by side."""
    long = runs.select(run, *(F.col(m).cast("double").alias(m) for m in measures)).unpivot(run, measures, "measure", "value")
    wide = long.groupBy("measure").pivot(run, ["before", "after"]).agg(F.first("value"))
    return wide.withColumn("change", F.col("after") - F.col("before"))
