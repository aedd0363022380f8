"""Forms on pages: boxes to read again, signing roles, and checksums bound to fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconspark.functions import text as X
from reconspark.operators import classify, geometry
from reconspark.operators.pages import _words
from reconspark.schemas import INVENTORY_KIND, IUL, TITLE

# Words that start a signing row and the names of roles, words that begin the name of the project.
ROLE_WORDS = "^(?:Г?ЛАВНЫЙ|ВЕДУЩИЙ|ЗАМЕСТИТЕЛЬ|НАЧАЛЬНИК|НОРМОКОНТРОЛЬ|РУКОВОДИТЕЛЬ|ИНЖЕНЕР)$"
PROJECT_WORDS = "^(?:СОЗДАНИЕ|ПРОЕКТНАЯ|РАЗДЕЛ|ВЫСОКОСКОРОСТНОЙ)$"
SURNAME = "^(?:[А-Яа-яЁё][.,]){0,2}[А-Яа-яЁё]{4,}[,.;]?$"
#: field, kind of page, box as shares of the page (x, y, w, h), enlargement, variants, condition on the page.
CROPS = [
    ("CRC", IUL, (0.30, 0.42, 0.42, 0.21), 2.0, 4, None),
    ("Footer", IUL, (0.65, 0.82, 0.35, 0.18), 2.0, 2, None),
    ("Roles", IUL, (0.0, 0.56, 1.0, 0.28), 1.25, 2, "book is not null"),
    ("Roles", IUL, (0.0, 0.07, 1.0, 0.65), 1.25, 2, "book is null"),
    ("Sections", IUL, (0.25, 0.28, 0.54, 0.22), 1.25, 2, "book is not null"),
    ("Roles", TITLE, (0.0, 0.65, 1.0, 0.30), 1.25, 2, None),
    ("Sections", TITLE, (0.0, 0.40, 1.0, 0.28), 1.25, 2, None),
    ("Approval", TITLE, (0.0, 0.12, 0.78, 0.18), 1.25, 2, "text like '%СОГЛАСОВАНО%'"),
    ("Inventory", INVENTORY_KIND, (0.0, 0.12, 1.0, 0.82), 1.25, 2, None),
]
LONGEST_SIDE = 3500


def crop_requests(pages: DataFrame, sizes: DataFrame, stable: DataFrame | None = None) -> DataFrame:
    """photo_id, field, variant, bounds, scale: the regions to read again. sizes: photo_id, width, height.

    Regions of fields that whole pages already read the same twice (stable: photo_id, field) are left out.
    """
    p = pages.join(sizes, "photo_id").withColumn("text", F.upper(F.coalesce("text", F.lit(""))))
    boxes = [F.when((F.col("kind") == kind) & (F.expr(when) if when else F.lit(True)), F.struct(F.lit(field).alias("field"), *(F.lit(v).alias(n) for n, v in zip("xywh", box, strict=True)), F.lit(zoom).alias("zoom"), F.lit(n).alias("n"))) for field, kind, box, zoom, n, when in CROPS]
    rows = p.select("photo_id", "width", "height", F.inline(F.array_compact(F.array(*boxes))))
    bounds = F.struct((F.col("x") * F.col("width")).cast("float").alias("x"), (F.col("y") * F.col("height")).cast("float").alias("y"), (F.col("w") * F.col("width")).cast("float").alias("w"), (F.col("h") * F.col("height")).cast("float").alias("h"))
    scale = F.least("zoom", F.lit(float(LONGEST_SIDE)) / F.greatest(F.col("w") * F.col("width"), F.col("h") * F.col("height")))
    rows = rows.select("photo_id", "field", F.explode(F.sequence(F.lit(1), "n")).alias("variant"), bounds.alias("bounds"), scale.alias("scale"))
    return rows if stable is None else rows.join(stable.select("photo_id", "field"), ["photo_id", "field"], "left_anti")


def role_name(label: Column) -> Column:
    project = label.rlike("(?:^|\\s)[ПТ]?РОЕ(?:КТ[АВ])?(?:\\s|$)")
    rules = [
        (label.contains("ИНЖЕНЕ") & project, "Главный инженер проекта"),
        (label.contains("ЛАВН") & label.contains("ИНЖЕНЕ"), "Главный инженер"),
        (label.startswith("НОРМОКОНТРОЛЬ"), "Нормоконтроль"),
        (label.contains("ЗАМЕСТИТЕЛЬ"), "Заместитель"),
        (label.contains("НАЧАЛЬНИК"), "Начальник"),
        (label.contains("ВЕДУЩИЙ"), "Ведущий инженер"),
        (label.contains("РУКОВОДИТЕЛЬ"), "Руководитель"),
    ]
    return classify.cascade(rules, "Инженер")


def roles(ocr: DataFrame, pages: DataFrame) -> DataFrame:
    """photo_id, role, name, organization, status, approval, top, bounds: the signing rows of title and IUL pages.

    A row starts at a role word that stands clear of the row above; its label is what stands left, its name the leftmost surname
    of the topmost line at the right. Approval rows (upper part of a title) are marked; they end above the words that name the project.
    bounds is where the row is signed. Nobody has looked at the strokes yet: see signatures.evidence.
    """
    kinds = pages.select("photo_id", (F.col("kind") == IUL).alias("iul"), "organization", (~(F.col("kind") == IUL) & X.fold_form("text").contains("СОГЛАСОВАНО")).alias("approved"))
    w = _words(ocr).join(kinds, "photo_id")
    upper = F.col("approved") & (F.col("y") > F.col("h") * 0.12) & (F.col("y") < F.col("h") * 0.30)
    anchor = w.where(X.fold_form("text").rlike(ROLE_WORDS) & (F.col("x") < F.col("w") * F.when(F.col("iul"), 0.28).otherwise(0.48)) & ((F.col("y") > F.col("h") * F.when(F.col("iul"), 0.05).otherwise(0.65)) | upper) & (F.col("y") < F.col("h") * 0.92))
    starts = anchor.groupBy("photo_id", "w", "h", "iul", "organization", "approved").agg(F.array_sort(F.collect_list("y")).alias("ys"))
    starts = starts.select("photo_id", "w", "h", "iul", "organization", "approved", F.explode(geometry.spaced(F.col("ys"), F.col("h") * 0.025)).alias("top"))
    rows = geometry.bands(starts, ["photo_id"], "top")
    h = F.col("h")
    rows = rows.withColumn("end", F.least(F.coalesce(F.col("band_end") - h * 0.008, h * 0.94), F.col("top") + h * 0.13)).withColumn("approval", F.col("approved") & (F.col("top") < h * 0.30))
    rows = rows.withColumn("end", F.when(F.col("approval"), F.least("end", F.col("top") + h * 0.11)).otherwise(F.col("end")))
    heading = w.where(X.fold_form("text").rlike(PROJECT_WORDS) & (F.col("y") < F.col("h") * 0.45)).select("photo_id", F.col("y").alias("hy"))
    stop = rows.where("approval").select("photo_id", "top").join(heading, "photo_id").where("hy > top").groupBy("photo_id", "top").agg(F.min("hy").alias("stop"))
    rows = rows.join(stop, ["photo_id", "top"], "left").withColumn("end", F.least("end", F.coalesce(F.col("stop") - h * 0.005, "end"))).drop("stop")
    met = rows.join(_words(ocr).select("photo_id", "text", "x", "y", "bh"), "photo_id")
    left = (F.col("x") < F.col("w") * F.when(F.col("iul"), 0.30).otherwise(0.45)) & (F.col("y") >= F.col("top") - h * 0.006) & (F.col("y") < F.least("end", F.col("top") + h * 0.07))
    low = F.when(F.col("iul"), 0.23).when(F.col("approval"), 0.22).otherwise(0.64) * F.col("w")
    high = F.when(F.col("iul"), 0.55).when(F.col("approval"), 0.75).otherwise(1.0) * F.col("w")
    right = F.col("text").rlike(SURNAME) & (F.col("x") >= low) & (F.col("x") < high) & (F.col("y") >= F.col("top") + F.when(F.col("approval"), h * 0.025).otherwise(-h * 0.012)) & (F.col("y") < F.col("end"))
    word = lambda when, *cols: F.array_sort(F.collect_list(F.when(when, F.struct(*cols))))
    block = (F.col("y") >= F.col("top") - h * 0.01) & (F.col("y") < F.col("end"))
    found = met.groupBy("photo_id", "top", "end", "w", "h", "iul", "organization", "approval").agg(word(left, "y", "x", "text").alias("label"), word(right, "y", "x", "bh", "text").alias("names"), word(block, "y", "x", "text").alias("block"))
    mean = F.aggregate("names", F.lit(0.0), lambda s, n: s + n["bh"]) / F.size("names")
    line = F.filter("names", lambda n: F.col("approval") | (n["y"] <= F.get("names", F.lit(0))["y"] + mean * 0.75))
    lead = F.get(F.array_sort(F.transform(line, lambda n: F.struct(F.when(F.col("approval"), -n["y"]).otherwise(F.lit(0.0)).alias("o"), n["x"].alias("x"), n["text"].alias("t")))), F.lit(0))["t"]
    name = X.fold_form(F.nullif(F.regexp_extract(lead, "[А-Яа-яЁё]{4,}", 0), F.lit("")))
    texts = lambda c: F.array_join(F.transform(c, lambda t: t["text"]), " ")
    side = lambda sheet, approval, title: F.when(F.col("iul"), sheet).when(F.col("approval"), approval).otherwise(title) * F.col("w")
    return found.select(
        "photo_id",
        role_name(X.fold_form(texts("label"))).alias("role"),
        F.nullif(name, F.lit("")).alias("name"),
        F.when(F.col("approval"), X.organization(texts("block"))).otherwise(F.col("organization")).alias("organization"),
        F.lit("Не определено").alias("status"),
        "approval",
        "top",
        F.struct(side(0.55, 0.07, 0.30).alias("x"), (F.col("top") - h * 0.010).alias("y"), side(0.28, 0.24, 0.34).alias("w"), (F.col("end") - F.col("top") + h * 0.008).alias("h")).alias("bounds"),
    )


def fragment_checksums(ocr: DataFrame) -> DataFrame:
    """photo_id, fragments: number of a fragment -> checksum, where a page lists several; numbers read with two sums are left out."""
    w = _words(ocr)
    marks = w.where(F.translate(X.compact("text"), "СР", "CR").rlike("^CRC32[^\\p{L}\\p{N}]*$")).select("photo_id", "w", F.col("x").alias("mx"), F.col("y").alias("my"), F.col("bh").alias("mh"), (F.col("y") - F.col("bh") * 0.25).alias("edge"))
    banded = geometry.bands(marks, ["photo_id"], "edge", tie="mx").withColumn("end", F.coalesce("band_end", F.col("my") + F.col("mh") * 4))
    met = banded.join(w.drop("w", "h"), "photo_id").where((F.col("y") >= F.col("my") - F.col("mh") * 0.7) & (F.col("y") < F.col("end")))
    left = F.col("x") < F.col("mx") - F.col("w") * 0.012
    sum_ = F.btrim(F.translate(X.digits("text"), "СВАЕ", "CBAE"), F.lit(",:;"))
    right = (F.col("x") >= F.col("mx") - F.col("w") * 0.02) & (F.col("x") < F.col("mx") + F.col("w") * 0.20) & (F.col("y") < F.col("my") + F.col("mh") * 3) & sum_.rlike("^[0-9A-F]{1,8}$")
    per = met.groupBy("photo_id", "mx", "my").agg(F.array_sort(F.collect_list(F.when(left, F.struct("y", "x", "text")))).alias("file"), F.min(F.when(right, F.struct(F.abs(F.col("y") - F.col("my")).alias("d"), "x", sum_.alias("s")))).alias("near"))
    names = F.regexp_extract_all(F.array_join(F.transform("file", lambda t: t["text"]), " "), F.lit("(?iuU)Фрагмент\\s*([\\dЗ]{1,3})(?!\\d)"), F.lit(1))
    read = per.where((F.size(names) == 1) & F.col("near").isNotNull()).select("photo_id", X.digits(names[0]).try_cast("int").alias("number"), X.pad8(F.col("near.s")).alias("sum"))
    lone = read.groupBy("photo_id", "number").agg(F.min("sum").alias("low"), F.max("sum").alias("sum")).where("low = sum and number is not null")
    return lone.groupBy("photo_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("number", "sum")))).alias("fragments"))
