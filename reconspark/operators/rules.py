"""The rules: each turns the reconciled tables into findings (level, code, topic, detail, photos)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconspark.functions import text as X
from reconspark.operators import identity, reconcile
from reconspark.schemas import FRAGMENT_TITLE, INVENTORY_KIND, IUL, TITLE, UNKNOWN_KIND
from reconspark.storage import Scratch

GRAVE, CHECK, NOTE = reconcile.LEVELS
# Topics (in the rules below), organisations that rules name, roles, and the limit of seal evidence.
MAKER, DESIGNER = "Росжелдорпроект", "Ленгипротранс"
CHIEF, PROJECT_CHIEF = "Главный инженер", "Главный инженер проекта"
SEAL_LIMIT, VERIFIED = 0.60, "Найдены"


@dataclass
class Tables:
    """pages and inventory as in schemas, inventory as read (before first wins); registry with row, file and checksum, or None."""

    pages: DataFrame
    inventory: DataFrame
    registry: DataFrame | None = None

    def __post_init__(self):
        self.merged, self.box_conflicts, self.kind_conflicts = merge_inventory(self.inventory)
        grouped = self.pages.where(F.col("code").isNotNull() & (F.col("kind") != INVENTORY_KIND))
        self.titles, self.iuls = grouped.where(F.col("kind") == TITLE), grouped.where(F.col("kind") == IUL)
        self.groups = grouped.groupBy("code").agg(F.min("photo_id").alias("first"), F.array_sort(F.collect_list(F.when(F.col("kind") == TITLE, F.col("photo_id")))).alias("titles"), F.count_if(F.col("kind") == IUL).alias("iuls"))
        self.grouped = grouped
        title_book = self.titles.where(F.trim(F.coalesce("book", F.lit(""))) != "").groupBy("code").agg(F.min_by("book", "photo_id").alias("title_book"), F.min("photo_id").alias("title_page"))
        inv = self.merged.select("code", F.when(F.trim(F.coalesce("book", F.lit(""))) != "", F.col("book")).alias("inv_book"), F.col("photo_id").alias("inv_photo"), F.col("revision").alias("inv_revision"), F.col("book_number").alias("inv_number"), F.col("sections").alias("inv_sections"))
        self.expected = self.groups.select("code", "titles").join(inv, "code", "left").join(title_book, "code", "left").withColumn("expected", F.coalesce("inv_book", "title_book"))
        if self.registry is not None:
            codes = self.merged.select("code").union(self.pages.where("code is not null").select("code")).distinct()
            self.bound = self.registry.join(identity.match_files(self.registry.select("row", "file"), codes, "file", ["row"]), "row")


    def settled(self, scratch: Scratch) -> Tables:
        """With the tables that many rules read written, so that each rule's plan is short."""
        for name in ("merged", "groups", "expected", *(["bound"] if self.registry is not None else [])):
            setattr(self, name, scratch.save(getattr(self, name), name))
        return self


def finding(df: DataFrame, level: Column | str, code: Column | str, topic: Column | str, detail: Column, photos: Column) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(lit(level).alias("level"), (F.col(code) if isinstance(code, str) else code).alias("code"), lit(topic).alias("topic"), detail.alias("detail"), F.array_compact(photos).cast("array<int>").alias("photos"))


def merge_inventory(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one row a code, conflicts of boxes, conflicts of kinds).

    Kinds spread within one box number; continuations from later pages are appended to the first row's book; a box or kind
    that differs within a code is null and a conflict.
    """
    rows = reconcile.propagate_unique(rows, "box", "documentation_kind")
    first = reconcile.first_wins(rows, ["code"], ["seq"])
    more = rows.where(F.col("book_continuation") & (F.trim(F.coalesce("book", F.lit(""))) != "")).select("code", F.col("seq").alias("s"), F.col("photo_id").alias("p"), F.col("book").alias("b"))
    tail = first.select("code", "seq", "photo_id").join(more, "code").where((F.col("s") > F.col("seq")) & (F.col("p") > F.col("photo_id")))
    tail = tail.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "b"))), lambda x: x["b"]), " ").alias("__tail"))
    lone = rows.groupBy("code").agg(F.when(F.min("box") == F.max("box"), F.max("box")).alias("__box"), F.when(F.min("documentation_kind") == F.max("documentation_kind"), F.max("documentation_kind")).alias("__kind"), F.array_sort(F.collect_set("photo_id")).alias("photos"))
    merged = first.join(tail, "code", "left").join(lone, "code")
    merged = merged.withColumn("book", F.when(F.col("__tail").isNotNull(), F.trim(F.concat(F.coalesce("book", F.lit("")), F.lit(" "), F.col("__tail")))).otherwise(F.col("book"))).withColumn("box", F.col("__box")).withColumn("documentation_kind", F.col("__kind")).drop("__tail", "__box", "__kind")
    conflict = lambda column: reconcile.distinct_conflict(rows, ["code"], column, "seq").join(lone.select("code", "photos"), "code")
    return merged, conflict("box"), conflict("documentation_kind")


def inventory_conflicts(t: Tables) -> list[DataFrame]:
    """R1, R2."""
    return [
        finding(t.box_conflicts, CHECK, "code", "Разные номера короба в описи", F.concat("values", F.lit(". Короб не заносится в реестр, пока номер не выбран.")), F.col("photos")),
        finding(t.kind_conflicts, CHECK, "code", "Разные виды документации в описи", F.concat("values", F.lit(". Вид не заносится в реестр, пока он не выбран.")), F.col("photos")),
    ]


def unread_inventory(t: Tables) -> list[DataFrame]:
    """R3."""
    empty = t.pages.where(F.col("kind") == INVENTORY_KIND).join(t.inventory.select("photo_id"), "photo_id", "left_anti")
    return [finding(empty, CHECK, F.lit(None).cast("string"), "Строки описи не распознаны", F.lit("Лист отнесён к описям, но ни одного шифра на нём не прочитано: нужен более чёткий снимок."), F.array("photo_id"))]


def missing_volumes(t: Tables) -> list[DataFrame]:
    """R4; silent where all pages are inventory."""
    other = t.pages.agg(F.count_if(F.col("kind") != INVENTORY_KIND).alias("__others"))
    gone = t.merged.join(t.groups.select("code"), "code", "left_anti").join(F.broadcast(other)).where("__others > 0")
    return [finding(gone, CHECK, "code", "Нет фотографий тома", F.lit("Опись называет этот шифр, а листов с ним в наборе нет."), F.array("photo_id"))]


def book_numbers(t: Tables) -> list[DataFrame]:
    """R5."""
    read = t.titles.union(t.iuls).where("book_number is not null").groupBy("code").agg(F.min("book_number").alias("low"), F.max("book_number").alias("high"), F.count("*").alias("n"), F.array_sort(F.collect_list("photo_id")).alias("p"))
    bad = read.where("low = high").join(t.expected.select("code", "inv_number", "inv_photo"), "code").where("inv_number <> low")
    detail = F.concat(F.lit("В описи книга "), F.col("inv_number").cast("string"), F.lit(", на листах комплекта книга "), F.col("low").cast("string"))
    return [finding(bad, F.when(F.col("n") >= 2, GRAVE).otherwise(CHECK), "code", "Номер книги в описи / комплекте", detail, F.concat("p", F.array("inv_photo")))]


def book_names(t: Tables) -> list[DataFrame]:
    """R6, R7."""
    named = t.iuls.where("book is not null").join(t.expected, "code").where(F.col("expected").isNotNull() & X.different("expected", "book"))
    by = named.groupBy("code", "expected", "inv_photo", F.get("titles", F.lit(0)).alias("title")).agg(F.array_sort(F.collect_list(F.struct("photo_id", "book"))).alias("all"))
    names = F.array_join(F.array_distinct(F.transform("all", lambda x: x["book"])), "»; «")
    detail = F.concat(F.lit("Ожидалось «"), F.col("expected"), F.lit("», в листе стоит «"), names, F.lit("»"))
    six = finding(by, GRAVE, "code", "Название книги в ИУЛ", detail, F.concat(F.transform("all", lambda x: x["photo_id"]), F.array(F.coalesce("inv_photo", "title"))))
    title = t.titles.where("book is not null").join(t.expected, "code").where(F.col("expected").isNotNull() & X.different("expected", "book"))
    detail = F.concat(F.lit("Ожидалось «"), F.col("expected"), F.lit("», на титуле прочитано «"), F.col("book"), F.lit("»"))
    return [six, finding(title, CHECK, "code", "Название на титуле", detail, F.array("photo_id", "inv_photo"))]


def chiefs(t: Tables) -> list[DataFrame]:
    """R8."""
    a = t.titles.where((F.col("organization") == DESIGNER) & F.col("chief").isNotNull()).select("code", "organization", F.col("chief").alias("a"), F.col("photo_id").alias("p"))
    b = t.iuls.where("chief is not null and (book is not null or crc is not null)").select("code", "organization", F.col("chief").alias("b"), F.col("photo_id").alias("q"))
    bad = a.join(b, ["code", "organization"]).where(X.different("a", "b"))
    return [finding(bad, GRAVE, "code", "Главный инженер: титул / ИУЛ", F.concat(F.lit("На титуле "), F.col("a"), F.lit(", в листе "), F.col("b")), F.array("p", "q"))]


def checksums(t: Tables) -> tuple[list[DataFrame], DataFrame]:
    """R9, R10, and the pages compared: photo_id, matched."""
    sums = t.bound.select("code", "row", "file", X.registry_normal("checksum").alias("sum"))
    parts = t.iuls.select("code", "photo_id", "crc", F.explode_outer("fragments").alias("number", "read"))
    named = sums.where(F.col("sum").rlike("^[0-9A-F]{1,8}$")).select("code", X.fragment("file").try_cast("int").alias("number"), X.pad8(F.col("sum")).alias("sum"), "row").where("number is not null")
    lone = named.groupBy("code", "number").agg(F.min("sum").alias("low"), F.max("sum").alias("sum"), F.min("row").alias("row")).where("low = sum")
    bound = parts.where("number is not null").join(lone, ["code", "number"])
    bad = bound.where("read <> sum").groupBy("code").agg(F.array_sort(F.collect_set(F.concat(F.lit("Фрагмент "), F.col("number").cast("string"), F.lit(": в листе "), F.col("read"), F.lit(", в реестре "), F.col("sum"), F.lit(" (строка "), F.col("row").cast("string"), F.lit(")")))).alias("all"), F.array_sort(F.collect_set("photo_id")).alias("p"))
    note = ". Каждая сумма отнесена к файлу своего фрагмента; верную даст пересчёт по исходному файлу."
    nine = finding(bad, CHECK, "code", "CRC32: привязка к файлам фрагментов", F.concat(F.array_join("all", "; "), F.lit(note)), F.col("p"))
    loose = t.iuls.where("crc is not null").join(bound.select("photo_id").distinct(), "photo_id", "left_anti").select("code", "photo_id", "crc")
    padded = sums.where("sum <> ''").select("code", X.pad8(F.col("sum")).alias("sum"), "row")
    listed = padded.groupBy("code", "sum").agg(F.min("row").alias("row")).groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "sum"))), lambda x: x["sum"]), ", ").alias("listed"))
    checked = reconcile.contained(loose.join(sums.select("code").distinct(), "code", "left_semi"), padded.withColumnRenamed("sum", "member"), ["code"], "crc", "member", "matched").join(listed, "code", "left")
    detail = F.concat(F.lit("ИУЛ: "), F.col("crc"), F.lit("; Excel: "), F.coalesce("listed", F.lit("")), F.lit(". Сверьте сумму со снимком."))
    ten = finding(checked.where("not matched"), CHECK, "code", "CRC32 не совпадает", detail, F.array("photo_id"))
    return [nine, ten], checked.select("photo_id", "matched").unionByName(bound.select("photo_id", (F.col("read") == F.col("sum")).alias("matched")))


def revisions(t: Tables) -> list[DataFrame]:
    """R11."""
    bad = t.iuls.where("revision is not null").join(t.expected.select("code", "inv_revision", "inv_photo"), "code").where("inv_revision <> revision")
    detail = F.concat(F.lit("В описи изменение "), F.col("inv_revision").cast("string"), F.lit(", в листе изменение "), F.col("revision").cast("string"))
    return [finding(bad, GRAVE, "code", "Номер изменения", detail, F.array("inv_photo", "photo_id"))]


def groups(t: Tables) -> list[DataFrame]:
    """R12, R13, R14."""
    with_crc = t.iuls.where("crc is not null")
    pages = with_crc.groupBy("code").agg(F.array_sort(F.collect_set("photo_id")).alias("p"))
    twelve = reconcile.distinct_conflict(with_crc, ["code"], "crc", "photo_id").join(pages, "code")
    approved = t.titles.where((F.col("organization") == MAKER) | F.exists(F.coalesce("signatures", F.array()), lambda s: s["approval"] & (s["organization"] == MAKER))).select("code")
    fourteen = t.groups.join(t.iuls.where(F.col("organization") == MAKER).select("code"), "code", "left_semi").join(approved, "code", "left_anti")
    return [
        finding(twelve, CHECK, "code", "Разные CRC32 на листах ИУЛ", F.concat("values", F.lit(". Одна из сумм могла быть прочитана неверно.")), F.col("p")),
        finding(t.groups.where("iuls = 0"), CHECK, "code", "ИУЛ не найден", F.lit("У шифра есть титульный лист, а листа с подписями и суммой нет."), F.col("titles")),
        finding(fourteen, CHECK, "code", "Титул Росжелдорпроекта не найден", F.lit("Среди листов шифра нет титула изготовителя: он не загружен либо не узнан."), F.array("first")),
    ]


def roles(t: Tables) -> list[DataFrame]:
    """R15, R16."""
    title = t.titles.select("code", F.col("photo_id").alias("p"), F.col("organization").alias("own"), F.inline("signatures")).where(((F.col("role") == CHIEF) & ~F.col("approval")) | (F.col("role") == PROJECT_CHIEF))
    title = title.select("code", "p", "own", "role", "organization", F.col("name").alias("a"))
    # A signature counts with the organisation of its page.
    iul = t.iuls.select("code", F.col("photo_id").alias("q"), "organization", F.inline(F.transform("signatures", lambda s: F.struct(s["role"].alias("role"), s["name"].alias("b")))))
    sheets = t.iuls.groupBy("code", "organization").agg(F.min("photo_id").alias("sheet"))
    lacking = title.join(iul.select("code", "organization", "role"), ["code", "organization", "role"], "left_anti").join(iul.select("code", "organization", F.col("b").alias("a")), ["code", "organization", "a"], "left_anti").join(sheets, ["code", "organization"])
    detail = F.concat(F.lit("Роль «"), F.col("role"), F.lit("» с титула не встретилась в листе организации "), F.col("organization"))
    met = title.join(iul, ["code", "organization", "role"]).where(X.different("b", "a") & ~((F.col("role") == CHIEF) & (F.col("own") == DESIGNER)))
    other = F.concat("organization", F.lit(": на титуле "), F.col("a"), F.lit(", в листе "), F.col("b"))
    return [finding(lacking, CHECK, "code", "Состав подписантов ИУЛ", detail, F.array("p", "sheet")), finding(met, CHECK, "code", F.concat("role", F.lit(": титул / ИУЛ")), other, F.array("p", "q"))]


def section_names(t: Tables) -> list[DataFrame]:
    """R17, R18."""
    of = lambda df, value, page: df.select("code", F.col("photo_id").alias(page), F.explode("sections").alias("field", value))
    iul = of(t.iuls.where("book is not null"), "b", "q")
    seventeen = of(t.titles, "a", "p").join(iul, ["code", "field"]).where(X.different("a", "b"))
    first = F.concat("field", F.lit(": на титуле «"), F.col("a"), F.lit("», в листе «"), F.col("b"), F.lit("»"))
    listed = t.expected.select("code", F.col("inv_photo").alias("p"), F.explode("inv_sections").alias("field", "a"))
    eighteen = listed.join(of(t.titles, "b", "q").union(iul.select("code", "q", "field", "b")), ["code", "field"]).where(X.different("a", "b"))
    second = F.concat("field", F.lit(": в описи «"), F.col("a"), F.lit("», в документе «"), F.col("b"), F.lit("»"))
    return [finding(seventeen, CHECK, "code", "Название раздела / части", first, F.array("p", "q")), finding(eighteen, CHECK, "code", "Раздел / часть: опись и документ", second, F.array("p", "q"))]


def page_rules(t: Tables) -> list[DataFrame]:
    """R19 to R25. Pages without a list of signatures were not examined for them and are left out of R20 to R22; an empty list was."""
    p, signed = t.pages, F.size(F.coalesce("signatures", F.array()))
    examined = F.col("signatures").isNotNull()
    evidence = p.where((F.col("kind") == TITLE) & ((signed > 0) | (F.col("seal.score") > SEAL_LIMIT))).select("code", "organization", F.col("photo_id").alias("other"))
    bare = p.where((F.col("kind") == TITLE) & (signed == 0) & ~F.coalesce("text", F.lit("")).rlike("(?iu)(?:Главный|Заместитель|Начальник)\\s"))
    # Another page than the cover itself: the least or the greatest page with evidence. A row a key, so that no two sides of a hot key meet.
    others = evidence.groupBy("code", "organization").agg(F.min("other").alias("low"), F.max("other").alias("high"))
    same = F.col("x.code").eqNullSafe(F.col("e.code")) & F.col("x.organization").eqNullSafe(F.col("e.organization"))
    cover = bare.alias("x").join(others.alias("e"), same).where("low <> photo_id or high <> photo_id").select("photo_id")
    seal = p.where((F.col("kind") == TITLE) & (F.col("seal.score") <= SEAL_LIMIT)).join(cover, "photo_id", "left_anti")
    open_ = F.filter("signatures", lambda s: ~s["status"].startswith(VERIFIED))
    rows = F.array_join(F.transform(open_, lambda s: F.concat(s["role"], F.lit(" ("), F.coalesce(s["name"], F.lit("имя не прочитано")), F.lit("): "), s["status"])), "; ")
    r = p.select("photo_id", "code", F.inline(F.transform("readings", lambda v: F.struct(v["field"].alias("field"), v["value"].alias("value"), v["status"].alias("status"), v["candidates"].alias("candidates"))))).withColumn("label", X.field_label("field"))
    disputed = F.size(F.coalesce("candidates", F.array())) > 0
    shape = F.concat(F.lit("Значение «"), F.col("value"), F.lit("» предложено по форме цифр; его следует подтвердить по снимку."))
    two = F.concat(F.lit("Чтения графы «"), F.col("label"), F.lit("» разошлись: "), F.array_join("candidates", " / "))
    none = F.concat(F.lit("Графа «"), F.col("label"), F.lit("» не прочитана ни разу; заполнена ли она, видно на снимке."))
    page = F.array("photo_id")
    return [
        finding(seal, CHECK, "code", "Печать на титуле", F.concat("seal.status", F.lit(". Оценивается только круглый оттиск.")), page),
        finding(p.where((F.col("kind") == FRAGMENT_TITLE) & examined & (signed == 0)), NOTE, "code", "Титул фрагмента", F.lit("Титул одного из фрагментов без подписных строк; нужны ли они, решают правила комплекта."), page),
        finding(p.where(F.size(F.coalesce(open_, F.array())) > 0), CHECK, "code", "Подписи: проверка отдельных строк", F.concat(rows, F.lit(". По штрихам не видно, чья это подпись.")), page),
        finding(p.where((F.col("kind") == IUL) & examined & (signed == 0)), CHECK, "code", "Подписная таблица не распознана", F.lit("Подписных строк на листе прочитать не удалось; это не значит, что подписей нет."), page),
        finding(r.where(F.col("status").startswith("Предложено по форме цифры")), CHECK, "code", F.concat(F.lit("Проверьте чтение: "), F.col("label")), shape, page),
        finding(r.where("value is null"), CHECK, "code", F.concat(F.when(disputed, "Разные результаты чтения: ").otherwise("Не удалось прочитать: "), F.col("label")), F.when(disputed, two).otherwise(none), page),
        finding(p.where((F.col("kind") == UNKNOWN_KIND) | ((F.col("kind") != INVENTORY_KIND) & F.col("code").isNull())), CHECK, "code", "Документ не распознан уверенно", F.lit("Вид листа или шифр не определены однозначно."), page),
    ]


def all_findings(t: Tables) -> DataFrame:
    """Every rule's findings, of equal ones the first."""
    parts = [*inventory_conflicts(t), *unread_inventory(t), *missing_volumes(t), *book_numbers(t), *book_names(t), *chiefs(t)]
    if t.registry is not None:
        parts += checksums(t)[0]
    parts += [*revisions(t), *groups(t), *roles(t), *section_names(t), *page_rules(t)]
    return reconcile.union_findings(parts)
