"""Inventory tables: the code column, row bands from ruled lines, row numbers or volumes, cells, and the rows of a page.

Everything is counted by page: a page's words are gathered into short arrays or joined by page and place, never with another
page's. Ruled lines come from the scans (table_rules), words from recognised pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconspark.functions import text as X
from reconspark.operators import fields, geometry, pixels
from reconspark.schemas import INVENTORY_KIND
from reconspark.storage import Scratch, unbounded

# Words of table heads and shares of the page's width (w) and height (h), or of the head's (m).
CODE_HEAD, NAME_HEAD, BODY_WORD = "(?iu)^(?:ШИФР|ОБОЗНАЧЕНИЕ)", "(?iu)^НАИМЕНОВАНИЕ", "(?iu)^(?:Книга|Часть)$"
HEAD_WORD, GUIDE_WORD = "(?iu)^(?:ШИФР|ТОМА|ДОКУМЕНТ|\\d{1,2})$", "^[1-6З][.]?$"
VOLUME, ROW_NUMBER = "^\\d+(?:[.]\\d+){1,6}$", "^\\d{1,4}[.]?$"
HEAD_LINE_H, LEFT_W, RIGHT_W, RULE_LEFT_W, BODY_W = 0.04, 0.055, 0.015, 0.14, 0.01
VOLUME_LEFT_W, NUMBER_RIGHT_W, NUMBER_OF_LEFT, LAST_H, RULE_LAST_H, RULE_HEADS = 0.08, 0.20, 0.60, 0.95, 0.97, 7
DARK_ACROSS, SHARE_ACROSS, DARK_DOWN, SHARE_DOWN, LEAST_GAP, LEAST_GAP_H, LEAST_WIDTH = 180, 28 / 32, 175, 0.80, 4, 0.002, 15
SUFFIX_FROM_W, SUFFIX_TO_W, PREFIX_W, PREFIX_Y, SAME_CODE_Y = 0.145, 0.40, 0.1, 85, 80
VOLUME_W, SAME_ROW_Y = 0.24, 70
TKR_VOLUME, ILO_VOLUME, PREFIX = "^3\\.[0-9]{1,2}(?:\\.[0-9]{1,3}){0,3}$", "^4\\.[34]\\.[0-9]{1,2}\\.[0-9]{1,2}$", "\\d{3}-\\d{2}-\\d{4}"
BOOK_W, BOOK_Y, MARK_W, MARK_Y, NUMBER_X, NUMBER_Y, BOX_HEAD_W, BOX_W, BOX_Y, BOX_H, BOOK_NUMBER_W, BOOK_NUMBER_Y = 0.34, 85, 0.72, 60, 145, 22, 0.6, 0.06, 65, 0.024, 0.12, 20


def table_heads(ocr: DataFrame) -> DataFrame:
    """photo_id, w, h, mx, my, mw, mh, nx: the first word of the code column's head, and where the head of the names begins."""
    w = fields.page_words(ocr)
    mark = w.where(F.col("text").rlike(CODE_HEAD)).groupBy("photo_id", "w", "h").agg(F.min(F.struct("y", "line_no", "x", "bw", "bh")).alias("m"))
    mark = mark.select("photo_id", "w", "h", F.col("m.x").alias("mx"), F.col("m.y").alias("my"), F.col("m.bw").alias("mw"), F.col("m.bh").alias("mh"))
    names = w.where(F.col("text").rlike(NAME_HEAD)).select("photo_id", F.col("x").alias("nx"), F.col("y").alias("ny"))
    beside = (F.col("nx") > F.col("mx")) & (F.abs(F.col("ny") - F.col("my")) < F.col("h") * HEAD_LINE_H)
    return mark.join(names, "photo_id").where(beside).groupBy(mark.columns).agg(F.min("nx").alias("nx"))


def ruled_lines(image: np.ndarray, scale: float, head: tuple[float, ...]) -> tuple[float | None, float | None, list[float]]:
    """(rule left of the code column, rule right of it, rules across it), in page coordinates. head: w, h, mx, my, mw, mh, nx.

    A rule down is a column of pixels dark over most of the head and the rows below it; a rule across is a row of pixels dark over
    nearly the whole column. Rows of one thick rule count once.
    """
    w, h, mx, my, mw, mh, nx = head
    tall, wide, _ = image.shape
    rows = slice(max(0, int((my - mh) * scale)), max(0, int((my - mh + RULE_HEADS * mh) * scale) + 1))

    def down(start: float, end: float) -> np.ndarray:
        first = max(0, int(start * scale))
        strip = image[rows, first : min(wide - 1, int(end * scale)) + 1].astype(np.int64)
        return first + np.flatnonzero((strip.sum(2) // 3 < DARK_DOWN).mean(0) >= SHARE_DOWN) if strip.size else np.zeros(0, np.int64)

    left, right = down(mx - w * RULE_LEFT_W, mx - 3), down(mx + mw + 3, nx - 3)
    low, high = float(left[-1] / scale) if len(left) else None, float(right[0] / scale) if len(right) else None
    across: list[float] = []
    if low is not None and high is not None:
        a, b = max(0, int((low + 5) * scale)), min(wide - 1, int((high - 5) * scale))
        top = max(0, int((my + mh) * scale))
        if b - a >= LEAST_WIDTH:
            dark = (pixels.grey(image[top : int(tall * RULE_LAST_H), a : b + 1]) < DARK_ACROSS).mean(1)
            for y in ((np.flatnonzero(dark >= SHARE_ACROSS) + top) / scale).tolist():
                if not across or y - across[-1] > max(LEAST_GAP, h * LEAST_GAP_H):
                    across.append(y)
    return low, high, across


def table_rules(ocr: DataFrame, images: DataFrame) -> DataFrame:
    """photo_id, rule_left, rule_right, rules of the pages with a table head whose scan is there.

    images: photo_id, and image as of Spark's image source, of the same page at any resolution. Pictures of fewer than three channels
    and empty ones give no rules.
    """
    heads = table_heads(ocr)
    schema = "photo_id int, rule_left double, rule_right double, rules array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                photo, tall, wide, channels, data, *head = (c[row].as_py() for c in b.columns)
                image = np.frombuffer(data, np.uint8).reshape(tall, wide, channels)[..., :3]
                low, high, across = ruled_lines(image, wide / head[0], tuple(map(float, head)))
                yield pa.RecordBatch.from_arrays([pa.array([photo], pa.int32()), pa.array([low], pa.float64()), pa.array([high], pa.float64()), pa.array([across], pa.list_(pa.float64()))], names=["photo_id", "rule_left", "rule_right", "rules"])

    scans = images.select("photo_id", "image.height", "image.width", "image.nChannels", "image.data").where("nChannels >= 3 and height > 0 and width > 0")
    return scans.join(heads, "photo_id").select(*scans.columns, "w", "h", "mx", "my", "mw", "mh", "nx").mapInArrow(run, schema)


def code_columns(ocr: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """table_heads with left, right and bottom (of the head) of the code column, and the rules across it.

    Without a scan the column ends before the first word that opens a name in the body.
    """
    heads = table_heads(ocr)
    bottom = F.col("my") + F.col("mh") * 2
    if rules is None:
        body = fields.page_words(ocr).where(F.col("text").rlike(BODY_WORD)).select("photo_id", F.col("x").alias("bx"), F.col("y").alias("by"))
        first = heads.join(body, "photo_id").where((F.col("bx") > F.col("mx") + F.col("mw")) & (F.col("by") > bottom)).groupBy("photo_id").agg((F.min("bx") - F.first("w") * BODY_W).alias("__body"))
        heads = heads.join(first, "photo_id", "left").withColumns({"rule_left": F.lit(None).cast("double"), "rule_right": F.lit(None).cast("double"), "rules": F.array().cast("array<double>")})
    else:
        heads = heads.join(rules, "photo_id", "left").withColumn("__body", F.lit(None).cast("double"))
    left = F.coalesce(F.col("rule_left") + 2, F.greatest(F.lit(0.0), F.col("mx") - F.col("w") * LEFT_W))
    right = F.least(F.coalesce(F.col("rule_right") - 2, F.col("nx") - F.col("w") * RIGHT_W), F.coalesce("__body", F.lit(float("inf"))))
    out = heads.withColumns({"left": left, "right": right, "bottom": bottom, "rules": F.coalesce("rules", F.array().cast("array<double>"))})
    return out.where("right > left").drop("rule_left", "rule_right", "__body")


def _bands(numbers: Column, volumes: Column, first: Column) -> Column:
    """Bands (top, end) of a page: between rules (three or more), else from each row number to the next, else between the middles of
    neighbouring volumes; and one above them if words of the column (the topmost at `first`) stand there."""
    rules, bottom, last = F.col("rules"), F.col("bottom"), F.col("h") * LAST_H
    band = lambda top, end: F.struct(top.alias("top"), end.alias("end"))
    over = lambda limit: F.when(first < limit, F.array(band(bottom, limit))).otherwise(F.array().cast("array<struct<top:double,end:double>>"))
    between = F.transform(F.slice(rules, 1, F.greatest(F.size(rules) - 1, F.lit(0))), lambda r, i: band(r + 2, F.get(rules, i + 1) - 2))
    ruled = F.concat(F.when(F.get(rules, F.lit(0)) > bottom, over(F.get(rules, F.lit(0)) - 2)).otherwise(F.array().cast("array<struct<top:double,end:double>>")), between)
    start = lambda n: n["y"] - n["bh"]
    numbered = F.concat(over(start(F.get(numbers, F.lit(0)))), F.transform(numbers, lambda n, i: band(start(n), F.coalesce(start(F.get(numbers, i + 1)), last))))
    middle = lambda a, b: (a["y"] + b["y"]) / 2
    halves = F.transform(volumes, lambda v, i: band(F.when(i == 0, bottom).otherwise(middle(F.get(volumes, i - 1), v)), F.coalesce(middle(v, F.get(volumes, i + 1)), last)))
    return F.when(F.size(rules) >= 3, ruled).when(F.size(numbers) > 0, numbered).otherwise(halves)


def cell_text(ws: Column) -> Column:
    """The text of a cell: its rows from the top, joined without a space after a hyphen, a slash or a full stop."""
    glue = lambda whole, part: F.concat(whole, F.when((whole == "") | whole.rlike("[-/.]$"), "").otherwise(" "), part)
    return F.aggregate(fields.rows_of(ws), F.lit(""), glue)


def table_rows(ocr: DataFrame, rules: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """photo_id, code, volume, y, top, bottom, continuation, column_right: the physical rows of a page's table, whatever their codes look like.

    Bands are cut by ruled lines, row numbers or volumes; the words whose centres a band holds in the code column are its code. Head
    words and the guide row (a row of column numbers) give no row. continuation: neither a row number nor a volume begins in the band.
    """
    at = F.col("y") + F.col("bh") / 2
    column = code_columns(ocr, rules)
    w = fields.page_words(ocr).drop("w", "h").join(column, "photo_id")
    below = F.col("y") > F.col("bottom")
    inside = (F.col("x") + F.col("bw") / 2 >= F.col("left")) & (F.col("x") + F.col("bw") / 2 < F.col("right"))
    number = (F.col("x") < F.least(F.col("w") * NUMBER_RIGHT_W, F.col("left") * NUMBER_OF_LEFT)) & below & F.col("text").rlike(ROW_NUMBER)
    volume = (F.col("x") < F.col("left")) & (F.col("x") > F.col("w") * VOLUME_LEFT_W) & below & F.col("text").rlike(VOLUME)
    w = w.withColumns({"inside": inside, "number": number, "volume": volume, "centre": at}).where("inside or number or volume or text rlike '" + GUIDE_WORD + "'")
    w = (scratch or Scratch(ocr.sparkSession, "cells", large=True)).save(w.drop("w", "nx", "mx", "my", "mw", "left"), "cells")
    sorted_ = lambda when: F.array_sort(F.collect_list(F.when(when, F.struct("y", "line_no", "x", "bh"))))
    head = ["photo_id", "h", "bottom", "mh", "right", "rules"]
    pages = w.groupBy(head).agg(sorted_(F.col("number")).alias("numbers"), sorted_(F.col("volume")).alias("volumes"), F.min(F.when(F.col("inside") & below, F.col("y"))).alias("first"))
    bands = pages.select("photo_id", "bottom", "mh", "right", F.explode(_bands(F.col("numbers"), F.col("volumes"), F.col("first"))).alias("b")).select("photo_id", F.col("b.top").alias("top"), F.col("b.end").alias("end"), F.col("bottom").alias("head"), "mh", "right").where("end > top")
    kept = ["top", "end", "head", "mh", "right"]
    plain = w.select("photo_id", "line_no", "text", "x", "y", "bw", "bh", "centre", "inside", "number", "volume")
    cells = geometry.last_start(plain.where("inside"), bands, ["photo_id"], "centre", "top", kept, "end").where("centre < end")
    cells = cells.groupBy("photo_id", *kept).agg(cell_text(F.collect_list(fields.as_word())).alias("cell"), F.min("y").alias("y"), F.max("y").alias("lowest"))
    started = geometry.last_start(plain.where(F.col("number") | F.col("volume") | F.col("text").rlike(GUIDE_WORD)), bands, ["photo_id"], "y", "top", kept, "end").where("y < end")
    started = started.groupBy("photo_id", "top").agg(F.count_if("number").alias("numbers"), F.min(F.when(F.col("volume"), F.struct("y", "line_no", "text")))["text"].alias("volume"), F.count_if(F.col("text").rlike(GUIDE_WORD)).alias("guides"))
    rows = cells.join(unbounded(started), ["photo_id", "top"], "left").withColumn("code", X.value("cell"))
    high = lambda heads: F.col("lowest") < F.col("head") + F.col("mh") * heads
    title = F.col("code").rlike(HEAD_WORD) & high(2)
    guide = high(4) & (F.coalesce("guides", F.lit(0)) >= 3)
    return rows.where(F.col("code").isNotNull() & ~title & ~guide).select("photo_id", "code", "volume", "y", "top", F.col("end").alias("bottom"), ((F.coalesce("numbers", F.lit(0)) == 0) & F.col("volume").isNull()).alias("continuation"), F.col("right").alias("column_right"))


def _families(own: DataFrame, scratch: Scratch) -> DataFrame:
    """photo_id, code, tom, anchor_y: rows found by a code's suffix, then by a volume where the page has codes of its family.

    A suffix takes the nearest prefix, or the page's only one; the same code within SAME_CODE_Y is the same row. A volume within SAME_ROW_Y
    of a row may only complete that row's code.
    """
    read = F.replace(X.digits("text"), F.lit(","), F.lit("."))
    rest = lambda family: F.concat(F.lit(family), F.substr("v", F.lit(3)))
    marks = fields.page_words(own).select("photo_id", "w", "x", "y", "line_no", F.nullif(F.regexp_extract(X.code_text("text"), f"^({PREFIX})-?$", 1), F.lit("")).alias("prefix"), F.when((F.col("x") > F.col("w") * SUFFIX_FROM_W) & (F.col("x") < F.col("w") * SUFFIX_TO_W), X.inventory_suffix("text")).alias("own"), F.when(F.col("x") < F.col("w") * VOLUME_W, read).alias("v"))
    marks = marks.withColumn("volume", F.when(F.col("v").rlike(TKR_VOLUME), rest("ТКР")).when(F.col("v").rlike(ILO_VOLUME), rest("ИЛО"))).drop("v")
    # Written, since what follows reads it several times and these expressions are long.
    marks = scratch.save(marks.where("prefix is not null or own is not null or volume is not null"), "marks")
    prefix = marks.where("prefix is not null").select("photo_id", F.col("x").alias("px"), F.col("y").alias("py"), "prefix")
    every = F.array_distinct(F.regexp_extract_all(X.code_text("text"), F.lit(f"({PREFIX})"), F.lit(1)))
    lone = unbounded(own).select("photo_id", F.when(F.size(every) == 1, F.get(every, F.lit(0))).alias("lone"))
    suffix = marks.where("own is not null").select("photo_id", "w", "x", "y", "line_no", F.col("own").alias("suffix"), F.lit(True).alias("own"))
    volume = marks.where("volume is not null").select("photo_id", "w", "x", "y", "line_no", F.col("volume").alias("suffix"), F.lit(False).alias("own"))
    family = lambda c: F.substring(c, 1, 3)
    met = suffix.select("photo_id", family("suffix").alias("f")).distinct()
    volume = volume.join(met, (volume["photo_id"] == met["photo_id"]) & (family("suffix") == met["f"]), "left_semi")
    anchors = suffix.unionByName(volume)
    near = anchors.join(prefix, "photo_id").where((F.abs(F.col("px") - F.col("x")) < F.col("w") * PREFIX_W) & (F.abs(F.col("py") - F.col("y")) < PREFIX_Y))
    near = near.groupBy("photo_id", "x", "y", "suffix", "own").agg(F.min_by("prefix", F.abs(F.col("py") - F.col("y"))).alias("near"))
    coded = anchors.join(unbounded(near), ["photo_id", "x", "y", "suffix", "own"], "left").join(lone, "photo_id", "left").withColumn("code", F.concat(F.coalesce("near", "lone"), F.lit("-"), F.col("suffix"))).where("code is not null")
    # Suffixes first, each kind from the top; what the fold carries is the page's rows.
    found = coded.groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct((~F.col("own")).alias("late"), "y", "line_no", "x", "code"))).alias("found"))
    row = "array<struct<code:string,y:double>>"
    struct = lambda code, y: F.struct(code.alias("code"), y.alias("y"))

    def step(rows: Column, a: Column) -> Column:
        close = F.array_position(F.transform(rows, lambda r: F.abs(r["y"] - a["y"]) < SAME_ROW_Y), True)
        grown = F.concat(rows, F.array(struct(a["code"], a["y"])))
        completed = F.transform(rows, lambda r, i: F.when((i == close - 1) & a["code"].startswith(F.concat(r["code"], F.lit("."))), struct(a["code"], r["y"])).otherwise(r))
        known = F.exists(rows, lambda r: (r["code"] == a["code"]) & (F.abs(r["y"] - a["y"]) < SAME_CODE_Y))
        return F.when(a["late"], F.when(close > 0, completed).otherwise(grown)).when(known, rows).otherwise(grown).cast(row)

    return found.select("photo_id", F.explode(F.aggregate("found", F.array().cast(row), step)).alias("r")).select("photo_id", "r.code", X.tom("r.code").alias("tom"), F.col("r.y").alias("anchor_y"))


def pages_with_rows(ocr: DataFrame, scratch: Scratch, rules: DataFrame | None = None) -> DataFrame:
    """photo_id of the pages on which a row can be read, by its code's family or by its cell."""
    known = _families(ocr, scratch).select("photo_id")
    return known.union(table_rows(ocr, rules, scratch).select("photo_id")).distinct()


def banded_rows(ocr: DataFrame, scratch: Scratch, rules: DataFrame | None = None) -> DataFrame:
    """photo_id, code, tom, anchor_y, at, top, bottom, continuation, column_right of each row of inventory pages.

    Rows known by their code's family that stand in a band of the table take that band, whose code is theirs; bands in which none stands
    are rows of their own, with the code that the cell holds. Rows outside all bands have none (top is null).
    """
    known = scratch.save(_families(ocr, scratch), "known")
    physical = scratch.save(table_rows(ocr, rules, scratch), "physical")
    kept = ["top", "bottom", "y", "continuation", "column_right"]
    banded = geometry.last_start(known, physical, ["photo_id"], "anchor_y", "top", kept, "bottom").where("anchor_y < bottom")
    outside = known.join(banded.select("photo_id", "code", "anchor_y"), ["photo_id", "code", "anchor_y"], "left_anti")
    alone = physical.join(banded.select("photo_id", "top"), ["photo_id", "top"], "left_anti").withColumn("code", X.code_value("code"))
    rows = banded.select("photo_id", "code", "tom", "anchor_y", F.col("y").alias("at"), "top", "bottom", "continuation", "column_right")
    rows = rows.unionByName(alone.select("photo_id", "code", F.col("volume").alias("tom"), F.col("y").alias("anchor_y"), F.col("y").alias("at"), "top", "bottom", "continuation", "column_right"))
    rows = rows.unionByName(outside.withColumns({"at": F.col("anchor_y"), "continuation": F.lit(False)}), allowMissingColumns=True)
    return scratch.save(rows.withColumn("no", F.row_number().over(Window.partitionBy("photo_id").orderBy("anchor_y", "code"))), "banded")


def inventory_rows(ocr: DataFrame, pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Rows of inventory pages, as in schemas.INVENTORY: by code suffix and nearest prefix, by volume, and by the cells of the table.

    Revision, box, book number and name are read beside the anchor, or within the row's band where it has one. rules: table_rules. A
    continuation row has no book word of its own; its text goes on with the row of the same code before it (book_continuation).
    Steps are written tables, so that each starts from a short plan.
    """
    scratch = Scratch(ocr.sparkSession, "tables", large=True)
    own = unbounded(ocr.join(unbounded(pages.where(F.col("kind") == INVENTORY_KIND).select("photo_id")), "photo_id", "left_semi"))
    rows = banded_rows(own, scratch, rules)
    w = scratch.save(fields.page_words(own).withColumn("n", X.fold("text")), "words")
    key = ["photo_id", "no"]
    place = rows.select(*key, "at", "top", "bottom")
    beside = lambda reach: F.when(F.col("top").isNotNull(), (F.col("ly") >= F.col("top")) & (F.col("ly") < F.col("bottom"))).otherwise(F.abs(F.col("ly") - F.col("at")) < reach)
    label = lambda pattern, share: w.where(F.col("n").rlike(pattern) & (F.col("x") > F.col("w") * share)).select("photo_id", "w", "h", F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("bw").alias("lw"), F.col("bh").alias("lh"))
    number = lambda n: w.where(F.col("text").rlike(n)).select("photo_id", "x", "y", "bw", F.regexp_extract("text", "^([0-9]+)", 1).try_cast("int").alias("v"))
    nearest = lambda labels, reach: place.join(labels, "photo_id").where(beside(reach)).groupBy(*key).agg(F.min(F.struct(F.abs(F.col("ly") - F.col("at")).alias("d"), "ly", "lx", "lh", "w")).alias("l")).select(*key, "l.*")
    first = lambda met, when, name: met.where(when).groupBy(*key).agg(F.min_by("v", F.struct("x", "y")).alias(name))
    marks = nearest(label("^ИЗМ", MARK_W), F.lit(MARK_Y)).join(number("^\\d{1,2}$"), "photo_id")
    revision = first(marks, (F.col("x") > F.col("lx")) & (F.col("x") < F.col("lx") + NUMBER_X) & (F.abs(F.col("y") - F.col("ly")) < NUMBER_Y), "revision")
    books = nearest(label("^КНИГА", BOOK_W), F.lit(BOOK_Y))
    near = (F.col("x") > F.col("lx")) & (F.col("x") < F.col("lx") + F.col("w") * BOOK_NUMBER_W) & (F.abs(F.col("y") - F.col("ly")) < F.greatest("lh", F.lit(BOOK_NUMBER_Y)))
    book_number = first(books.join(number("^\\d{1,3}[.,]?$"), "photo_id"), near, "book_number")
    head = label("^КОРОБ", BOX_HEAD_W).groupBy("photo_id", "w", "h").agg(F.min(F.struct("ly", "lx", "lw", "lh")).alias("l")).select("photo_id", "w", "h", F.col("l.ly").alias("hy"), F.col("l.lx").alias("hx"), F.col("l.lw").alias("hw"), F.col("l.lh").alias("hh"))
    boxes = place.join(head, "photo_id").join(number("^[0-9]{1,5}$").withColumn("ly", F.col("y")), "photo_id")
    boxes = boxes.where(beside(F.greatest(F.lit(BOX_Y), F.col("h") * BOX_H)) & (F.abs(F.col("x") + F.col("bw") / 2 - F.col("hx") - F.col("hw") / 2) < F.col("w") * BOX_W) & (F.col("y") > F.col("hy") + F.col("hh")) & (F.col("v") > 0))
    box = boxes.groupBy(*key).agg(F.when(F.min("v") == F.max("v"), F.max("v")).alias("box"))
    kinds = own.select("photo_id", X.documentation_kind("text").alias("documentation_kind"))
    out = rows.join(revision, key, "left").join(box, key, "left").join(book_number, key, "left").join(unbounded(books.select(*key, F.lit(True).alias("__book"))), key, "left").join(kinds, "photo_id", "left")
    out = out.withColumn("book_continuation", F.col("continuation") & F.col("__book").isNull()).withColumn("book", F.lit(None).cast("string"))
    out = fields.inventory_books(own, scratch.save(out, "marked"))
    seq = (F.col("photo_id").cast("long") * 1_000_000 + F.round(F.col("anchor_y")).cast("long")).alias("seq")
    return out.select(seq, "code", "tom", "book", "documentation_kind", "revision", "box", "book_number", "photo_id", F.lit(None).cast("map<string,string>").alias("sections"), "anchor_y", "book_continuation")

