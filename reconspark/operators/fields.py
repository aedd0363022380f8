"""Labelled fields of a page: codes under a header, lone title codes, footer numbers, the body of an IUL, inventory books and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconspark.functions import text as X
from reconspark.operators import geometry

# Words of labels.
CODE_LABEL = "(?iu)^(?:Обозначение(?:документа)?|Шифр)$"
NEXT_COLUMN = "(?iu)^(?:Наименование|Номер|Вид)$"
NAME_BEFORE = "(?iu)^(?:Наименование|Название)$"
LABEL_TAIL = "(?iu)^(?:документа|тома)$"
LONE_CODE = "^(?=.*\\p{L})(?=.*\\d)[\\p{L}\\p{N}][\\p{L}\\p{N}._/\\-]{3,}$"
BROKEN_FRAGMENT = "^(?:ФРАГМЕНТ|РАГМЕНТ|АГМЕНТ|ГМЕНТ|АТМЕНТ|ТМЕНТ|МЕНТ|ЕНТ)$"


def page_words(ocr: DataFrame) -> DataFrame:
    """photo_id, w, h (page), line_no, text, x, y, bw, bh (box)."""
    pages = ocr.select("photo_id", F.col("width").alias("w"), F.col("height").alias("h"), "lines")
    return geometry.words(pages, ["photo_id", "w", "h"]).select("photo_id", "w", "h", "line_no", "text", "x", "y", F.col("width").alias("bw"), F.col("height").alias("bh"))


def as_word(*extra: str) -> Column:
    return F.struct(F.col("text"), F.col("x"), F.col("y"), F.col("bw").alias("width"), F.col("bh").alias("height"))


def rows_of(ws: Column) -> Column:
    """Texts of the rows of an array of words, from the top."""
    ordered = F.array_sort(ws, lambda a, b: F.when(a["y"] < b["y"], -1).when(a["y"] > b["y"], 1).when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(0))
    text = lambda r: F.array_join(F.transform(F.array_sort(F.transform(r["words"], lambda w: F.struct(w["x"].alias("x"), w["text"].alias("t")))), lambda w: w["t"]), " ")
    return F.transform(F.array_sort(F.transform(geometry.row_clusters(ordered), lambda r: F.struct((r["centres"] / r["n"]).alias("c"), text(r).alias("t")))), lambda r: r["t"])


def codes_under_labels(ocr: DataFrame) -> DataFrame:
    """photo_id, field: the first line under a header "Обозначение" or "Шифр", up to the next column; a line that ends with a
    hyphen or slash goes on in the next, three times at most. A header "Наименование и Шифр" is none."""
    w = page_words(ocr)
    lines = w.groupBy("photo_id", "line_no").agg(F.max(F.col("y") + F.col("bh")).alias("line_end"))
    label = w.where(F.col("text").rlike(CODE_LABEL)).join(lines, ["photo_id", "line_no"]).select("photo_id", "w", "h", F.col("line_no").alias("n"), F.col("x").alias("lx"), F.col("y").alias("ly"), "line_end", F.lower("text").startswith("шифр").alias("cipher"))
    near = w.where(F.col("text").rlike(NAME_BEFORE)).select("photo_id", F.col("x").alias("nx"), F.col("y").alias("ny"))
    named = label.join(near, "photo_id").where(F.col("cipher") & (F.col("nx") < F.col("lx")) & (F.abs(F.col("ny") - F.col("ly")) < F.col("h") * 0.025)).select("photo_id", "lx", "ly")
    label = label.join(named.distinct(), ["photo_id", "lx", "ly"], "left_anti")
    other = w.where(F.col("text").rlike(NEXT_COLUMN)).select("photo_id", F.col("x").alias("ox"), F.col("y").alias("oy"))
    beside = label.join(other, "photo_id").where((F.col("ox") > F.col("lx") + F.col("w") * 0.10) & (F.abs(F.col("oy") - F.col("ly")) < F.col("h") * 0.03)).groupBy("photo_id", "lx", "ly").agg(F.min("ox").alias("ox"))
    label = label.join(beside, ["photo_id", "lx", "ly"], "left").withColumn("right", F.coalesce(F.col("ox") - F.col("w") * 0.01, F.least(F.col("w").cast("double"), F.col("lx") + F.col("w") * 0.35)))
    met = label.join(w.select("photo_id", "text", "x", "y", "bw", "bh"), "photo_id")
    met = met.where((F.col("x") >= F.greatest(F.lit(0.0), F.col("lx") - F.col("w") * 0.025)) & (F.col("x") + F.col("bw") / 2 < F.col("right")) & (F.col("y") > F.col("line_end") + 2) & (F.col("y") < F.col("line_end") + F.col("h") * 0.12) & ~F.col("text").rlike(LABEL_TAIL))
    first = met.groupBy("photo_id", "n", "w").agg(F.collect_list(as_word()).alias("ws")).select("photo_id", "n", "w", _cut_at_gap("ws").alias("ws"))
    rows = rows_of(F.col("ws"))
    value = F.aggregate(F.slice(rows, 2, 3), F.get(rows, F.lit(0)), lambda v, r: F.when(v.endswith("-") | v.endswith("/"), F.concat(v, r)).otherwise(v))
    return first.groupBy("photo_id").agg(F.min_by(value, "n").alias("__v")).select("photo_id", X.value("__v").alias("field")).where("field is not null")


def _cut_at_gap(ws: str) -> Column:
    """Words without those of the first line that stand behind a wide gap."""
    first = F.array_min(F.transform(ws, lambda v: v["y"]))
    height = F.greatest(F.lit(6.0), F.get(F.filter(ws, lambda v: v["y"] == first), F.lit(0))["height"])
    line = F.array_sort(F.transform(F.filter(ws, lambda v: v["y"] < first + height * 0.75), lambda v: F.struct(v["x"].alias("x"), (v["x"] + v["width"]).alias("end"))))
    gap = F.greatest(F.col("w") * 0.025, height * 2)
    stop = F.aggregate(line, F.lit(-1e9), lambda s, v: F.when((s < -1e8) | (v["x"] - s <= gap), v["end"]).otherwise(s))
    return F.filter(ws, lambda v: (v["y"] >= first + height * 0.75) | (v["x"] < stop))


def title_codes(ocr: DataFrame) -> DataFrame:
    """photo_id, token: the only lone word with letters and digits in the middle of the page."""
    w = page_words(ocr)
    alone = w.groupBy("photo_id", "line_no").agg(F.count("*").alias("c"), *(F.first(n).alias(n) for n in ("w", "h", "text", "x", "y"))).where("c = 1")
    fit = (F.col("y") > F.col("h") * 0.45) & (F.col("y") < F.col("h") * 0.83) & (F.col("x") > F.col("w") * 0.20) & (F.col("x") < F.col("w") * 0.75)
    seen = alone.where(fit & F.col("text").rlike(LONE_CODE) & ~F.col("text").rlike("(?i)^(?:CRC|ISBN)")).withColumn("token", X.value("text"))
    return seen.groupBy("photo_id").agg(F.min("token").alias("low"), F.max("token").alias("token")).where("low = token").drop("low")


def footer_numbers(ocr: DataFrame, label: str = "ЛИСТ") -> DataFrame:
    """photo_id, number: the topmost number of one or two digits under a label in the lower right corner."""
    w = page_words(ocr)
    mark = w.where((X.fold("text") == label) & (F.col("y") > F.col("h") * 0.77) & (F.col("x") > F.col("w") * 0.65)).groupBy("photo_id").agg(F.min_by(F.struct("x", "y", "bw", "bh"), "line_no").alias("m"))
    met = mark.join(w, "photo_id").withColumn("d", X.digits("text"))
    near = (F.col("y") > F.col("m.y") + F.col("m.bh") * 0.5) & (F.col("y") < F.col("m.y") + 150) & (F.abs(F.col("x") + F.col("bw") / 2 - F.col("m.x") - F.col("m.bw") / 2) < 45)
    return met.where(near & F.col("d").rlike("^\\d{1,2}$")).groupBy("photo_id").agg(F.min_by("d", "y").try_cast("int").alias("number"))


def iul_bodies(ocr: DataFrame) -> DataFrame:
    """photo_id, body: the rows from РАЗДЕЛ, ПОДРАЗДЕЛ, ЧАСТЬ or КНИГА to ТОМ, if they take at most half of the page."""
    w, n = page_words(ocr), X.fold("text")
    start = w.where(n.rlike("^(?:РАЗДЕЛ|ПОДРАЗДЕЛ|ЧАСТЬ|КНИГА)$") & (F.col("y") > F.col("h") * 0.25) & (F.col("x") > F.col("w") * 0.15)).groupBy("photo_id", "w", "h").agg(F.min_by(F.struct("x", "y", "bh"), "y").alias("a"))
    end = start.join(w.drop("w", "h"), "photo_id").where((n == "ТОМ") & (F.col("y") > F.col("a.y") + F.col("a.bh")) & (F.col("x") >= F.col("a.x") - F.col("w") * 0.03)).groupBy("photo_id", "w", "h", "a").agg(F.min_by(F.struct("y", "bh"), "y").alias("e")).where(F.col("e.y") - F.col("a.y") <= F.col("h") * 0.50)
    inside = (F.col("x") >= F.col("a.x") - F.col("w") * 0.02) & (F.col("x") + F.col("bw") / 2 < F.col("w") * 0.82) & (F.col("y") >= F.col("a.y") - F.col("a.bh") * 0.5) & (F.col("y") < F.col("e.y") - F.col("e.bh") * 0.25)
    return end.join(w.drop("w", "h"), "photo_id").where(inside).groupBy("photo_id").agg(F.collect_list(as_word()).alias("ws")).select("photo_id", F.array_join(rows_of(F.col("ws")), "\n").alias("body"))


def inventory_books(ocr: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with the book beside each anchor: from КНИГА, left of the marks, to the next КНИГА, ЧАСТЬ or ПОДРАЗДЕЛ.

    Rows with a band (columns at, top, bottom, continuation, column_right, as tables.banded_rows gives them) look for it there and end
    with it; a continuation without the word has all that stands right of the code column in its band, below the head of the names.
    """
    w, n = page_words(ocr), X.fold("text")
    at = ["photo_id", "code", "anchor_y"]
    extra = {"at": F.col("anchor_y"), "top": F.lit(None).cast("double"), "bottom": F.lit(None).cast("double"), "continuation": F.lit(False), "column_right": F.lit(None).cast("double")}
    placed = rows.withColumns({c: v for c, v in extra.items() if c not in rows.columns}).select(*at, *extra)
    books = w.where(n.startswith("КНИГА") & (F.col("x") > F.col("w") * 0.34)).select("photo_id", "w", "h", F.col("x").alias("kx"), F.col("y").alias("ky"))
    far = F.abs(F.col("ky") - F.col("at"))
    beside = F.when(F.col("top").isNotNull(), (F.col("ky") >= F.col("top")) & (F.col("ky") < F.col("bottom"))).otherwise(far < 85)
    own = placed.join(books, "photo_id").where(beside).groupBy(*at, "w", "h", "bottom").agg(F.min_by(F.struct("kx", "ky"), far).alias("k"))
    stops = w.where(((n.startswith("КНИГА") & (F.col("x") < F.col("w") * 0.76)) | (n.rlike("^(?:ЧАСТЬ|ПОДРАЗДЕЛ)") & (F.col("x") < F.col("w") * 0.75))) & (F.col("x") > F.col("w") * 0.34)).select("photo_id", F.col("y").alias("sy"), F.when(n.startswith("КНИГА"), 20).otherwise(15).alias("gap"))
    limit = own.join(stops, "photo_id").where(F.col("sy") > F.col("k.ky") + F.col("gap")).groupBy(*at).agg((F.min("sy") - 4).alias("limit"))
    low = F.least(F.coalesce("limit", F.col("h").cast("double")), F.coalesce("bottom", F.lit(float("inf"))))
    region = own.join(limit, at, "left").select(*at, (F.col("k.kx") - 2).alias("x0"), (F.col("w") * 0.72).alias("x1"), (F.col("k.ky") - 8).alias("y0"), low.alias("y1"))
    # A row that goes on from the page before.
    heads = w.where(n.startswith("НАИМЕНОВАНИЕ") & (F.col("x") > F.col("w") * 0.34)).groupBy("photo_id", "w").agg(F.min("y").alias("hy"))
    goes_on = placed.where("continuation and top is not null").join(own.select(*at), at, "left_anti").join(heads, "photo_id").where("hy < top")
    region = region.unionByName(goes_on.select(*at, F.col("column_right").alias("x0"), (F.col("w") * 0.72).alias("x1"), F.col("top").alias("y0"), F.col("bottom").alias("y1")))
    met = region.join(w.drop("w", "h"), "photo_id").where((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")))
    text = met.groupBy(*at).agg(F.collect_list(as_word()).alias("ws"))
    name = F.trim(F.regexp_replace(F.array_join(rows_of(F.col("ws")), " "), "(?iu)^Книга\\s*[0-9ЗзбБ]+(?:[.][0-9ЗзбБ]+)*[.,]?\\s*", ""))
    return rows.drop("book").join(text.select(*at, name.alias("book")), at, "left").select(*rows.columns)


def inventory_sections(ocr: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with the sections that the lines above each anchor (and at most 5 below it) open."""
    lines = page_words(ocr).groupBy("photo_id", "line_no").agg(F.avg("y").alias("ly"))
    texts = ocr.select("photo_id", F.posexplode("lines").alias("line_no", "line")).select("photo_id", "line_no", F.col("line.text").alias("t"))
    above = rows.select("photo_id", "code", "anchor_y").join(lines.join(texts, ["photo_id", "line_no"]), "photo_id").where(F.col("ly") <= F.col("anchor_y") + 5)
    head = above.groupBy("photo_id", "code", "anchor_y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "t"))), lambda x: x["t"]), "\n").alias("__t"))
    return rows.drop("sections").join(head.select("photo_id", "code", "anchor_y", X.sections("__t").alias("sections")), ["photo_id", "code", "anchor_y"], "left").select(*rows.columns)


def inventory_quality(rows: DataFrame) -> DataFrame:
    """photo_id, quality: how much of an inventory page was read; the better of two readings is kept by it."""
    whole = ~F.col("code").endswith("-") & ~F.col("code").endswith("/")
    return rows.groupBy("photo_id").agg((F.count_if(whole) * 10000 + F.sum(F.least(F.lit(300), F.length(X.key("code")))) * 10 + (F.count("revision") + F.count("box") + F.count("book_number")) * 10).alias("quality"))


def lists_fragments(ocr: DataFrame) -> DataFrame:
    """photo_id of pages with several checksum labels and two words or more that are "Фрагмент", whole or cut."""
    label = F.translate(X.compact("text"), "СР", "CR").rlike("^CRC32[^\\p{L}\\p{N}]*$")
    return page_words(ocr).groupBy("photo_id").agg(F.count_if(label).alias("a"), F.count_if(X.fold("text").rlike(BROKEN_FRAGMENT)).alias("b")).where("a > 1 and b >= 2").select("photo_id")
