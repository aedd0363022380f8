"""From recognised pages to typed ones: kind, code, checksum, names, and the rows of inventory pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconspark.functions import text as X
from reconspark.operators import classify, fields, geometry, tables
from reconspark.schemas import FRAGMENT_TITLE, INVENTORY_KIND, IUL, TITLE, UNKNOWN_KIND
from reconspark.storage import Scratch, unbounded


def looks_like_iul(text: Column) -> Column:
    n, c = X.fold(text), X.compact(text)
    return F.translate(c, "СР", "CR").contains("CRC32") | c.contains("УДОСТОВЕРЯЮЩ") | c.contains("УДОСТОВЕРЯЮШ") | ((n.contains("КОНТРОЛЬНАЯ") | n.contains("CRC32")) & n.contains("ЛИСТ")) | c.contains("-УЛ")


def looks_like_inventory(text: Column, has_rows: Column) -> Column:
    n, c = X.fold(text), X.compact(text)
    heading = F.substring(n, 1, 400).rlike("(?:^| )ОПИСЬ(?: |$)")
    columns = (c.contains("ШИФР") | c.contains("ОБОЗНАЧЕНИЕ")) & c.contains("НАИМЕНОВАНИЕ")
    entries = c.rlike("ИЛ[ОO0][34ЗЧ]") | X.code_text(text).contains("ТКР") | c.rlike("(?:4\\.[34ЗЧ]|3\\.[0-9]{1,2})\\.[0-9ЗОOLIЛНБ]")
    iul = F.translate(c, "СР", "CR").contains("CRC32") | c.contains("УДОСТОВЕРЯЮ") | c.contains("-УЛ")
    return ~iul & (heading | columns) & (entries | has_rows)


def inline_code(text: Column) -> Column:
    """The value after "Обозначение документа:" or "Шифр:" on its line."""
    return X.value(F.nullif(F.regexp_extract(text, "(?iuU)(?:Обозначение\\s+документа|Шифр(?:\\s+(?:документа|тома))?)\\s*[:=]\\s*([^\\r\\n]+)", 1), F.lit("")))


def type_pages(ocr: DataFrame, overrides: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """ocr: photo_id and the columns of schemas.OCR (and optionally kind_hint, code_hint) -> pages as in schemas.PAGE.

    Order is meaning: an inventory (chosen by hand or found) first, then IUL, fragment title, title, unknown; hints fill what is open.
    rules: ruled lines of the scans (tables.table_rules), for pages that only the rows of their table show to be inventories.
    """
    cols = set(ocr.columns)
    hint = lambda c: F.col(c) if c in cols else F.lit(None).cast("string")
    p = ocr.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("kind_hint", hint("kind_hint")).withColumn("code_hint", hint("code_hint"))
    if overrides is None:
        p = p.withColumn("selected", F.lit(None).cast("boolean")).withColumn("manual", F.lit(False))
    else:
        p = p.join(unbounded(overrides.select("photo_id", "selected", "manual")), "photo_id", "left")
    t = F.col("text")
    head = _words(ocr).where(F.col("y") < F.col("h") * 0.17).groupBy("photo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "text"))), lambda w: w["text"]), " ").alias("__head"))
    p = p.join(head, "photo_id", "left")
    p = p.join(fields.codes_under_labels(ocr).withColumnRenamed("field", "__below"), "photo_id", "left").join(fields.title_codes(ocr), "photo_id", "left").join(fields.iul_bodies(ocr), "photo_id", "left")
    # Rows matter only where nothing but rows is missing.
    maybe = ocr.where(looks_like_inventory(F.col("text"), F.lit(True)) & ~looks_like_inventory(F.col("text"), F.lit(False)))
    scratch = Scratch(ocr.sparkSession, "pages", large=True)
    parsed = scratch.save(tables.pages_with_rows(maybe, scratch, rules), "rows").withColumn("__rows", F.lit(True))
    scratch.keep("rows")
    p = p.join(parsed, "photo_id", "left")
    p = p.withColumn("legacy", X.page_code(t)).withColumn("__inline", inline_code(t)).withColumn("field", F.coalesce("__inline", "__below"))
    fits = F.col("__inline").isNotNull() | F.col("legacy").isNull() | (~F.col("field").contains(" ") & X.key("field").contains(X.key("legacy")))
    p = p.withColumn("code", F.when(F.col("field").isNotNull() & fits, X.code_value("field")).otherwise(F.coalesce("legacy", "token", "code_hint")))
    p = p.withColumn("is_inventory", classify.choose(F.col("selected"), F.col("manual"), looks_like_inventory(t, F.coalesce("__rows", F.lit(False)))))
    kind = classify.cascade([(F.col("is_inventory"), INVENTORY_KIND), (looks_like_iul(t), IUL), (X.fold(t).contains("ФРАГМЕНТ"), FRAGMENT_TITLE), (X.fold(t).contains("КНИГА") & F.col("code").isNotNull(), TITLE)], UNKNOWN_KIND)
    refused = F.coalesce(~F.col("selected"), F.lit(False))
    p = p.withColumn("kind", kind)
    p = p.withColumn("kind", F.when((F.col("kind") == UNKNOWN_KIND) & F.col("kind_hint").isNotNull() & ~(refused & (F.col("kind_hint") == INVENTORY_KIND)), F.col("kind_hint")).when((F.col("kind_hint") == IUL) & (F.col("kind") == TITLE), IUL).otherwise(F.col("kind")))
    p = p.withColumn("kind", F.when(~refused & (F.col("kind_hint") == INVENTORY_KIND), INVENTORY_KIND).otherwise(F.col("kind")))
    p = p.withColumn("code", F.when(F.col("kind") != INVENTORY_KIND, F.col("code")))
    return p.select(
        "photo_id",
        "kind",
        "code",
        X.tom("code").alias("tom"),
        X.organization(F.coalesce("__head", F.lit(""))).alias("organization"),
        X.book_text(F.coalesce(F.when(F.col("kind") == IUL, F.col("body")), t), F.col("kind") == IUL).alias("book"),
        F.lit(None).cast("string").alias("chief"),
        X.page_crc(t).alias("crc"),
        F.lit(None).cast("int").alias("revision"),
        F.lit(None).cast("int").alias("page"),
        X.book_number(F.coalesce(F.when(F.col("kind") == IUL, F.col("body")), t)).alias("book_number"),
        "text",
        X.sections(F.coalesce(F.when(F.col("kind") == IUL, F.col("body")), t)).alias("sections"),
    )


def apply_readings(pages: DataFrame, readings: DataFrame) -> DataFrame:
    """Readings (photo_id, field, value) replace page fields even where they are null; `Pages` readings are dropped.

    Of several readings of a field the last by `seq`, where there is such a column, else the greatest value counts."""
    fields = {"crc": ("CRC", "string"), "page": ("Page", "int"), "revision": ("Revision", "int")}
    order = F.struct(*(c for c in ("seq", "value") if c in readings.columns))
    one = lambda c: F.max_by(F.struct(F.col("value").alias("v")), F.when(F.col("field") == fields[c][0], order)).alias(f"__{c}")
    wide = readings.where("field <> 'Pages'").groupBy("photo_id").agg(*(one(c) for c in fields))
    read = lambda c: F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}.v").try_cast(fields[c][1])).otherwise(F.col(c)).alias(c)
    return pages.join(wide, "photo_id", "left").select(*(read(c) if c in fields else c for c in pages.columns))


def revision_labels(ocr: DataFrame) -> DataFrame:
    """photo_id, w, h, lx, ly, lw, lh: the topmost label "номер ... изменения" of each page."""
    w = _words(ocr)
    n = X.fold_form("text")
    label = w.where(n.rlike("^ИЗМЕНЕНИ[ЯЙ][.:]?$")).select("photo_id", "w", "h", F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("bw").alias("lw"), F.col("bh").alias("lh"))
    above = w.where(n == "НОМЕР").select("photo_id", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("bw").alias("nw"))
    near = label.join(above, "photo_id").where((F.col("ny") <= F.col("ly") + F.col("lh")) & (F.col("ny") > F.col("ly") - F.greatest(F.col("lh") * 5, F.col("h") * 0.10)) & (F.abs(F.col("nx") + F.col("nw") / 2 - F.col("lx") - F.col("lw") / 2) < F.greatest(F.col("lw") * 1.5, F.col("w") * 0.13)))
    return near.groupBy("photo_id").agg(F.min_by(F.struct("w", "h", "lx", "ly", "lw", "lh"), F.struct("ly", "lx")).alias("l")).select("photo_id", "l.*")


def current_readings(readings: DataFrame, ocr: DataFrame, typed: DataFrame) -> DataFrame:
    """Readings without those of `Pages`, and without those of `Revision` on IUL pages that have no labelled cell for it."""
    allowed = revision_labels(ocr).select("photo_id").union(typed.where(F.col("kind") != IUL).select("photo_id"))
    return readings.where("field not in ('Pages', 'Revision')").unionByName(readings.where("field = 'Revision'").join(allowed, "photo_id", "left_semi"))


def labelled_revision(ocr: DataFrame) -> DataFrame:
    """photo_id, revision: the one number under the label "номер ... изменения"."""
    w, label = _words(ocr), revision_labels(ocr)
    n = X.fold_form("text")
    pad, top = F.greatest(F.col("lh") * 2, F.col("w") * 0.025), F.greatest(F.lit(0.0), F.col("ly") - F.greatest(F.col("lh") * 4, F.col("h") * 0.04))
    cx, cy = F.col("x") + F.col("bw") / 2, F.col("y") + F.col("bh") / 2
    inside = cx.between(F.col("lx") - pad, F.col("lx") + F.col("lw") + pad) & cy.between(top, F.col("ly") + F.col("lh") + F.greatest(F.col("lh") * 7, F.col("h") * 0.12))
    values = label.join(w.drop("w", "h").where(n.rlike("^\\d{1,2}$")), "photo_id").where((F.col("y") > F.col("ly") + F.col("lh") * 0.7) & inside)
    return values.groupBy("photo_id").agg(F.when(F.min(n) == F.max(n), F.max(n)).try_cast("int").alias("revision"))


def chiefs(ocr: DataFrame, typed: DataFrame) -> DataFrame:
    """photo_id, chief: the surname beside the role "главный инженер" (not "... проекта"); the topmost role with a name counts."""
    sheet = F.col("kind") == IUL
    w = _words(ocr).join(typed.select("photo_id", "kind"), "photo_id").withColumn("n", X.fold("text"))
    of = lambda on_sheet, else_: F.when(sheet, on_sheet).otherwise(else_)
    head = w.where(F.col("n").endswith("ЛАВНЫЙ") & (F.col("x") < F.col("w") * 0.27) & (F.col("y") > F.col("h") * of(0.14, 0.65))).select("photo_id", F.col("x").alias("cx"), F.col("y").alias("cy"))
    both = head.join(w, "photo_id")
    role = (F.col("x") < F.col("w") * 0.29) & (F.col("y") >= F.col("cy") - 12) & (F.col("y") < F.col("cy") + of(110, 55))
    name = (F.col("x") >= F.col("w") * of(0.24, 0.62)) & (F.col("x") < F.col("w") * of(0.59, 1.0)) & (F.abs(F.col("y") - F.col("cy")) < 28) & F.col("text").rlike("^[А-Яа-яЁё]{4,}$")
    starts = lambda stem: F.coalesce(F.bool_or(role & F.col("n").startswith(stem)), F.lit(False))
    found = both.groupBy("photo_id", "cx", "cy").agg(starts("ИНЖЕНЕР").alias("engineer"), starts("ПРОЕКТА").alias("project"), F.min_by("n", F.when(name, F.struct("x", "y"))).alias("name"))
    return found.where("engineer and not project and name is not null").groupBy("photo_id").agg(F.min_by("name", F.struct("cy", "cx")).alias("chief"))


def placed_checksums(ocr: DataFrame) -> DataFrame:
    """photo_id, crc: the first eight hexadecimal digits close under the first word that starts with "CRC32"."""
    w = _words(ocr)
    marker = w.where(F.translate(X.compact("text"), "СР", "CR").startswith("CRC32")).groupBy("photo_id").agg(F.min(F.struct(F.col("y").alias("my"), F.col("x").alias("mx"))).alias("m")).select("photo_id", "m.*")
    digits = F.btrim(F.translate(X.digits("text"), "СВАЕ", "CBAE"), F.lit(",:;•"))
    near = marker.join(w, "photo_id").where((F.abs(F.col("x") - F.col("mx")) < 120) & (F.col("y") >= F.col("my") - 8) & (F.col("y") < F.col("my") + 80)).withColumn("crc", digits)
    return near.where(F.col("crc").rlike("^[0-9A-F]{8}$")).groupBy("photo_id").agg(F.min_by("crc", F.struct("y", "x")).alias("crc"))


def _words(ocr: DataFrame) -> DataFrame:
    """photo_id, w, h (page), text, x, y, bw, bh (box)."""
    pages = ocr.select("photo_id", F.col("width").alias("w"), F.col("height").alias("h"), "lines")
    return geometry.words(pages, ["photo_id", "w", "h"]).select("photo_id", "w", "h", "text", "x", "y", F.col("width").alias("bw"), F.col("height").alias("bh"))
