"""The whole audit: pages and registry in, findings and counters out; and the partial re-run after pages are read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconspark.functions import text as X
from reconspark.operators import fields, forms, geometry, identity, pages, reconcile, rules, tables
from reconspark.operators import signatures as signing
from reconspark.schemas import FRAGMENT_TITLE, INVENTORY_KIND, IUL, READING, SIGNATURE, TITLE, UNKNOWN_KIND
from reconspark.storage import Scratch

# Fixed value: the share of a page's height that its head takes.
HEAD_SHARE = 0.12


def audit(ocr: DataFrame, registry: DataFrame | None = None, overrides: DataFrame | None = None, signatures: DataFrame | None = None, readings: DataFrame | None = None, seals: DataFrame | None = None, images: DataFrame | None = None) -> rules.Tables:
    """Types pages, reads inventory rows, binds codes, and readies the tables that rules work on.

    images (photo_id, image as of Spark's image source): the scans; ruled lines of inventory tables, strokes of signing rows and seals are
    read off them. signatures (photo_id, role, name, organization, status, approval): by default the signing rows that are read off the
    pages; without scans nobody has looked at their strokes. seals (photo_id, status, score): by default those found on the scans of
    titles; without scans no seal is judged.
    Typed pages and inventory rows are written tables, so that the many rules that read them start from short plans.
    """
    scratch = Scratch(ocr.sparkSession, "audit", large=True)
    ruled = None if images is None else scratch.save(tables.table_rules(ocr, images), "rules")
    typed = scratch.save(pages.type_pages(ocr, overrides, ruled), "typed")
    revision = pages.labelled_revision(ocr).withColumnRenamed("revision", "__r")
    chief = pages.chiefs(ocr, typed).withColumnRenamed("chief", "__c")
    # A label in Latin letters settles the checksum by text alone.
    placed = pages.placed_checksums(ocr.where(~X.fold("text").rlike("CRC\\s*32"))).withColumnRenamed("crc", "__p")
    typed = typed.join(revision, "photo_id", "left").join(chief, "photo_id", "left").join(placed, "photo_id", "left")
    typed = typed.withColumns({"revision": F.when(F.col("kind") == IUL, F.col("__r")), "chief": F.col("__c"), "crc": F.coalesce("crc", "__p")})
    typed = scratch.save(typed.drop("__r", "__c", "__p"), "read")
    rows = scratch.save(tables.inventory_rows(ocr, typed, ruled), "anchors")
    rows = scratch.save(completed_codes(fields.inventory_sections(ocr, rows)), "rows")
    typed = scratch.save(bind_codes(typed, rows, ocr), "bound").join(fields.footer_numbers(ocr), "photo_id", "left").withColumn("page", F.when(F.col("kind") == IUL, F.col("number"))).drop("number")
    if readings is not None:
        readings = scratch.save(pages.current_readings(readings, ocr, typed), "readings")
        typed = pages.apply_readings(typed, readings)
        kept = readings.groupBy("photo_id").agg(F.collect_list(F.struct("field", "value", "status", "candidates")).alias("readings"))
        typed = typed.join(kept, "photo_id", "left")
    else:
        typed = typed.withColumn("readings", F.lit(None).cast(f"array<{READING}>"))
    if signatures is None:
        signatures = forms.roles(ocr, typed)
        if images is not None:
            signatures = scratch.save(signatures, "roles")
            looked_at = scratch.save(signing.evidence(ocr, typed, signatures, images), "evidence")
            signatures = signing.with_status(signatures, looked_at)
            seals = seals if seals is not None else looked_at.where("seal is not null").select("photo_id", "seal.status", "seal.score")
    signed = signatures.groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct("role", "name", "organization", "status", "approval"))).alias("signatures"))
    looked = F.col("kind").isin(TITLE, IUL, FRAGMENT_TITLE)
    typed = typed.join(signed, "photo_id", "left").withColumn("signatures", F.when(looked, F.coalesce("signatures", F.array().cast(f"array<{SIGNATURE}>"))))
    if seals is not None:
        typed = typed.join(seals.select("photo_id", F.struct("status", F.col("score").cast("double").alias("score")).alias("seal")), "photo_id", "left")
    else:
        typed = typed.withColumn("seal", F.lit(None).cast("struct<status:string,score:double>"))
    typed = typed.join(forms.fragment_checksums(ocr), "photo_id", "left")
    return rules.Tables(scratch.save(typed, "pages"), rows, registry).settled(scratch)


def completed_codes(rows: DataFrame) -> DataFrame:
    """Rows whose code is cut at a hyphen or slash take the only longer code of their volume that begins with it."""
    cut = F.col("tom").isNotNull() & F.col("code").rlike("[-/]$")
    full = identity.complete(rows, ["tom"], F.col("code"), "code").withColumn("code", F.when(cut, F.coalesce("completed", "code")).otherwise(F.col("code")))
    return full.select(*rows.columns)


def bind_codes(typed: DataFrame, rows: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """Pages take known codes: that whose key alone equals the key of their own code, else the one that a line of the page consists of.

    Lines bind pages without a code, or with a code of that key; lines that stand wholly in the page's head are not read. A page that had no
    code and names a book becomes a title.
    """
    known = rows.select("code").union(typed.where("code is not null").select("code")).where("code is not null").distinct()
    lone = identity.unique_keys(known).withColumnRenamed("code", "__known")
    bound = typed.withColumn("__k", X.key("code")).join(lone.withColumnRenamed("key", "__k"), "__k", "left").withColumn("__by_key", F.when(F.col("code").isNotNull(), F.col("__known")))
    if ocr is None:
        bound = bound.withColumn("__line", F.lit(None).cast("string"))
    else:
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word_no", "text"))), lambda w: w["text"]), " ")
        words = geometry.words(ocr.select("photo_id", F.col("height").alias("h"), "lines"), ["photo_id", "h"])
        lines = words.groupBy("photo_id", "line_no", "h").agg(text.alias("line"), F.max("y").alias("low")).where(F.col("low") >= F.col("h") * HEAD_SHARE).select("photo_id", "line_no", "line")
        bound = bound.join(identity.match_lines(lines, known, "line", "photo_id", ["line_no"]).withColumnRenamed("code", "__line"), "photo_id", "left")
    fits = F.col("__line").isNotNull() & (F.col("kind") != INVENTORY_KIND) & (F.col("code").isNull() | (F.col("__k") == X.key("__line")))
    named = F.col("code").isNull() & fits & (F.col("kind") == UNKNOWN_KIND) & X.fold("text").contains("КНИГА")
    bound = bound.withColumns({"kind": F.when(named, TITLE).otherwise(F.col("kind")), "code": F.coalesce("__by_key", F.when(fits, F.col("__line")), "code")})
    return bound.withColumn("tom", X.tom("code")).select(*typed.columns)


def counters(t: rules.Tables) -> DataFrame:
    """One row: images, volumes, titles, IUL and inventory pages, checksum and revision comparisons."""
    kinds = t.pages.agg(F.count("*").alias("images"), F.count_if(F.col("kind") == TITLE).alias("titles"), F.count_if(F.col("kind") == IUL).alias("iuls"), F.count_if(F.col("kind") == INVENTORY_KIND).alias("inventory_pages"), F.count_distinct(F.when((F.col("kind") != INVENTORY_KIND), F.col("code"))).alias("groups"))
    listed = t.merged.agg(F.count("*").alias("listed"))
    rev = t.iuls.where("revision is not null").join(t.expected.select("code", "inv_revision"), "code").where("inv_revision is not null").agg(F.count("*").alias("revision_compared"), F.count_if(F.col("inv_revision") == F.col("revision")).alias("revision_matches"))
    out = kinds.join(F.broadcast(listed)).join(F.broadcast(rev))
    if t.registry is not None:
        out = out.join(F.broadcast(rules.checksums(t)[1].agg(F.count("*").alias("crc_compared"), F.count_if("matched").alias("crc_matches"))))
    only = (F.col("images") > 0) & (F.col("inventory_pages") == F.col("images"))
    return out.withColumn("inventory_only", only).withColumn("volumes", F.when(only, F.col("listed")).otherwise(F.col("groups"))).drop("listed", "groups")


def recheck(ocr: DataFrame, again: DataFrame, selected: DataFrame) -> DataFrame:
    """Pages read again replace the earlier reading if they score at least as well; all others stay byte for byte.

    ocr, again: photo_id and schemas.OCR; again may have several readings a page, of equally good ones the new, then the first by text
    counts. selected: photo_id.
    """
    both = ocr.join(selected.select("photo_id").distinct(), "photo_id", "left_semi").withColumn("__new", F.lit(0)).unionByName(again.join(selected.select("photo_id").distinct(), "photo_id", "left_semi").withColumn("__new", F.lit(1)))
    both = both.withColumn("__rank", -(X.score("text") * 2 + F.col("__new")))
    best = reconcile.first_wins(both, ["photo_id"], ["__rank", "text"]).drop("__new", "__rank")
    return reconcile.replace_subset(ocr, best, ["photo_id"])
