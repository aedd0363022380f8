"""Queries over documents made from the driver's tables, with answers that are known from how they were made.

Every customer stands for one document: an inventory page with a row, a title, a sheet of signatures and checksum (IUL) and a line of the
registry. What is wrong with it depends on the key modulo 26, a kind of fault for each rule, so SQL can state the findings
without repeating the rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconspark.functions import text as X
from reconspark.operators import consensus, evaluate, geometry, identity, pages, reconcile, rules, tables
from reconspark.plans import audit
from reconspark.schemas import FRAGMENT_TITLE, INVENTORY, INVENTORY_KIND, IUL, PAGE, READING, SIGNATURE, TITLE, UNKNOWN_KIND
from reconspark.storage import Scratch

RIGHT, WRONG = "Пояснительная записка", "Генеральный план участка"
DOCUMENTS = "documents as (select c_custkey as k, c_custkey % 26 as d, 'D-' || lpad(cast(c_custkey as varchar), 7, '0') as code from customer)"


def base(t) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 26).alias("d"), F.concat(F.lit("D-"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("code"))


def _of(df: DataFrame, schema: str, values: dict) -> DataFrame:
    """The columns of a schema, null where no value is given."""
    empty = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*(F.coalesce(values.get(f.name, F.lit(None)), F.lit(None)).cast(f.dataType).alias(f.name) if f.name in values else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.fields))


def document_tables(t) -> rules.Tables:
    """Pages, inventory rows and registry of the made documents."""
    b = base(t)
    d, k = F.col("d"), F.col("k")
    on = lambda *kinds: d.isin(*kinds)
    photo = lambda j: k * 10 + j
    crc = F.lpad(F.hex("k"), 8, "0")
    signature = lambda role, name, status="Найдены штрихи": F.struct(F.lit(role).alias("role"), F.lit(name).alias("name"), F.lit(rules.MAKER).alias("organization"), F.lit(status).alias("status"), F.lit(False).alias("approval"))
    none = F.array().cast(f"array<{SIGNATURE}>")
    plain = F.array(signature("Разработал", "Иванов"))
    title_signed = F.when(on(15, 16), F.array(signature("Разработал", "Иванов"), signature(rules.CHIEF, "Орлов"))).otherwise(plain)
    iul_signed = F.when(on(16), F.array(signature("Разработал", "Иванов"), signature(rules.CHIEF, "Кузнецов"))).when(on(21), F.array(signature("Разработал", "Иванов", "Не найдены"))).when(on(22), none).otherwise(plain)
    reading = lambda field, value, status, candidates: F.struct(F.lit(field).alias("field"), F.lit(value).cast("string").alias("value"), F.lit(status).alias("status"), F.array(*map(F.lit, candidates)).cast("array<string>").alias("candidates"), F.array().cast("array<string>").alias("sources"), F.lit(1).alias("agreement"), F.lit(1).alias("attempts"))
    reads = F.when(on(23), F.array(reading("Revision", "3", "Предложено по форме цифры", []))).when(on(24), F.array(reading("CRC", None, "Не прочитано", []), reading("Page", None, "Разные", ["1", "2"]))).otherwise(F.array().cast(f"array<{READING}>"))
    section = lambda name: F.create_map(F.lit("РАЗДЕЛ"), F.lit(name))
    book = lambda wrong: F.when(on(wrong), F.lit(WRONG)).otherwise(F.lit(RIGHT))
    number = F.when(on(5), 2).otherwise(1)
    title = {
        "photo_id": photo(1), "kind": F.lit(TITLE), "code": F.col("code"), "organization": F.when(on(8), rules.DESIGNER).when(on(14), "Гипротранссвязь").otherwise(rules.MAKER), "book": book(7), "chief": F.when(on(8), "Петров"), "book_number": number, "text": F.lit("Титул"),
        "sections": F.when(on(17), section("1. Общие данные")).when(on(18), section("2. Смета расходов")), "signatures": title_signed, "seal": F.when(on(19), F.struct(F.lit("Круглая форма не найдена").alias("status"), F.lit(0.5).alias("score"))),
    }
    sheet = {
        "photo_id": photo(2), "kind": F.lit(IUL), "code": F.col("code"), "organization": F.when(on(8), rules.DESIGNER).otherwise(rules.MAKER), "book": book(6), "chief": F.when(on(8), "Сидоренко"), "crc": F.when(on(10), "12345678").otherwise(crc), "revision": F.when(on(11), 2), "book_number": number, "text": F.lit("ИУЛ"),
        "sections": F.when(on(17), section("2. Смета расходов")), "signatures": iul_signed, "readings": reads, "fragments": F.when(on(9), F.create_map(F.lit(1), F.lit("0000AAAA"))),
    }
    page = lambda where, j, **more: _of(b.where(where), PAGE, {"photo_id": photo(j), "signatures": plain} | more)
    there = ~on(4)
    parts = [
        _of(b.where(there), PAGE, title),
        _of(b.where(there & ~on(13)), PAGE, sheet),
        _of(b.where(on(12)), PAGE, sheet | {"photo_id": photo(3), "crc": F.lit("ABCDEF01")}),
        page(F.lit(True), 0, kind=F.lit(INVENTORY_KIND)),
        page(on(3), 5, kind=F.lit(INVENTORY_KIND)),
        page(on(20), 4, kind=F.lit(FRAGMENT_TITLE), code=F.col("code"), signatures=none),
        page(on(25), 7, kind=F.lit(UNKNOWN_KIND)),
    ]
    row = {"seq": (k * 10).cast("int"), "code": F.col("code"), "book": F.lit(RIGHT), "documentation_kind": F.lit("ПД"), "revision": F.when(on(11), 1), "box": k, "book_number": F.lit(1), "photo_id": photo(0), "sections": F.when(on(18), section("1. Общие данные")), "anchor_y": F.lit(0.0), "book_continuation": F.lit(False)}
    again = {"seq": (k * 10 + 1).cast("int"), "box": F.when(on(1), -k).otherwise(k), "documentation_kind": F.when(on(2), "ИИ").otherwise("ПД")}
    inventory = _of(b, INVENTORY, row).unionByName(_of(b.where(on(1, 2)), INVENTORY, row | again))
    file = lambda where, j, name, total: b.where(where).select((k * 10 + j).cast("int").alias("row"), F.concat("code", F.lit(name)).alias("file"), total.alias("checksum"))
    registry = file(F.lit(True), 0, ".pdf", F.when(on(10), "87654321").otherwise(crc)).unionByName(file(on(9), 1, " Фрагмент 1.pdf", F.lit("BBBB")))
    union = reduce(DataFrame.unionByName, parts)
    scratch = Scratch(b.sparkSession, "known", large=True)
    return rules.Tables(scratch.save(union, "pages"), scratch.save(inventory, "inventory"), scratch.save(registry, "registry")).settled(scratch)


#: kind of fault, level, code or not, topic, pages of the finding by their number within the document.
FAULTS = [
    (1, "Проверить", "Разные номера короба в описи", [0]),
    (2, "Проверить", "Разные виды документации в описи", [0]),
    (4, "Проверить", "Нет фотографий тома", [0]),
    (5, "Расхождение", "Номер книги в описи / комплекте", [1, 2, 0]),
    (6, "Расхождение", "Название книги в ИУЛ", [2, 0]),
    (7, "Проверить", "Название на титуле", [1, 0]),
    (8, "Расхождение", "Главный инженер: титул / ИУЛ", [1, 2]),
    (9, "Проверить", "CRC32: привязка к файлам фрагментов", [2]),
    (10, "Проверить", "CRC32 не совпадает", [2]),
    (11, "Расхождение", "Номер изменения", [0, 2]),
    (12, "Проверить", "Разные CRC32 на листах ИУЛ", [2, 3]),
    (12, "Проверить", "CRC32 не совпадает", [3]),
    (13, "Проверить", "ИУЛ не найден", [1]),
    (14, "Проверить", "Титул Росжелдорпроекта не найден", [1]),
    (15, "Проверить", "Состав подписантов ИУЛ", [1, 2]),
    (16, "Проверить", "Главный инженер: титул / ИУЛ", [1, 2]),
    (17, "Проверить", "Название раздела / части", [1, 2]),
    (18, "Проверить", "Раздел / часть: опись и документ", [0, 1]),
    (19, "Проверить", "Печать на титуле", [1]),
    (20, "Наблюдение", "Титул фрагмента", [4]),
    (21, "Проверить", "Подписи: проверка отдельных строк", [2]),
    (22, "Проверить", "Подписная таблица не распознана", [2]),
    (23, "Проверить", "Проверьте чтение: Номер изменения", [2]),
    (24, "Проверить", "Не удалось прочитать: CRC32", [2]),
    (24, "Проверить", "Разные результаты чтения: Лист", [2]),
]
#: Findings without a code: of equal ones the first stays.
LOOSE = [(3, "Проверить", "Строки описи не распознаны", 5), (25, "Проверить", "Документ не распознан уверенно", 7)]
_VALUES = ", ".join(f"({d}, '{level}', '{topic}', [{', '.join(map(str, pages))}])" for d, level, topic, pages in FAULTS)
FINDINGS = f"""with {DOCUMENTS}, faults(d, level, topic, pages) as (values {_VALUES}),
found as (select level, code, topic, array_to_string(list_transform(pages, lambda p: cast(k * 10 + p as varchar)), ',') as photos from documents join faults using (d)
{' '.join(f"union all select '{level}', null, '{topic}', cast(min(k) * 10 + {j} as varchar) from documents where d = {d} having count(*) > 0" for d, level, topic, j in LOOSE)})
"""


def rule_findings(t) -> DataFrame:
    """All 25 rules over the made documents."""
    found = rules.all_findings(document_tables(t))
    return found.select("level", "code", "topic", F.array_join(F.transform("photos", lambda p: p.cast("string")), ",").alias("photos"))


def audit_counters(t) -> DataFrame:
    return audit.counters(document_tables(t)).select(*(F.col(c).cast("long").alias(c) for c in ("images", "titles", "iuls", "inventory_pages", "volumes", "revision_compared", "revision_matches", "crc_compared", "crc_matches")))


COUNTERS = f"""with {DOCUMENTS} select
count(*) + count(*) filter (d <> 4) + count(*) filter (d not in (4, 13)) + count(*) filter (d in (3, 12, 20, 25)) as images,
count(*) filter (d <> 4) as titles, count(*) filter (d not in (4, 13)) + count(*) filter (d = 12) as iuls, count(*) + count(*) filter (d = 3) as inventory_pages,
count(*) filter (d <> 4) as volumes, count(*) filter (d = 11) as revision_compared, cast(0 as bigint) as revision_matches,
count(*) filter (d not in (4, 13)) + count(*) filter (d = 12) as crc_compared, count(*) filter (d not in (4, 9, 10, 13)) as crc_matches from documents"""


CODES = """c as (select p_partkey as k, 1 + p_partkey % 9 as n, 1 + p_partkey % 8 as m, p_partkey % 2 = 0 as even,
lpad(cast(p_partkey % 1000 as varchar), 3, '0') || '-' || lpad(cast(p_partkey % 100 as varchar), 2, '0') || '-' || lpad(cast(p_partkey % 10000 as varchar), 4, '0') as pre from part)"""


def _dealt(df: DataFrame) -> DataFrame:
    """Rows that cost much more than their bytes, dealt to all cores: a file of a few MB is read by one or two tasks."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "k")


def _codes(t) -> DataFrame:
    k = F.col("p_partkey")
    pad = lambda modulus, width: F.lpad((k % modulus).cast("string"), width, "0")
    return _dealt(t("part").select(k.alias("k"), (1 + k % 9).alias("n"), (1 + k % 8).alias("m"), (k % 2 == 0).alias("even"), F.concat_ws("-", pad(1000, 3), pad(100, 2), pad(10000, 4)).alias("pre")))


def _join(*parts) -> F.Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def code_forms(t) -> DataFrame:
    """Codes of both families as they come, with look-alikes, in lines, in file names and taken apart."""
    n, m, pre = (F.col(c) for c in ("n", "m", "pre"))
    raw = F.when(F.col("even"), _join(pre, "-ИЛ0З.", n, ".", m)).otherwise(_join(pre, "-ткр", n, ",", m))
    suffix = F.when(F.col("even"), _join("ИЛО3.", n, ".", m)).otherwise(_join("ТКР", n, ".", m))
    made = _join(pre, " Том 4.3.", n, ".", m)
    c = _codes(t).withColumn("raw", raw)
    return c.select(
        "k", X.compact("raw").alias("compact"), X.code_text("raw").alias("code_text"), X.legacy_code("raw").alias("legacy"), X.find_code(_join("Лист 1\n", F.col("raw"), "\nконец")).alias("found"),
        X.code_value("raw").alias("code_value"), X.document_code(_join(F.col("raw"), ".pdf")).alias("document"), X.page_code(made).alias("page"), X.tom(X.legacy_code("raw")).alias("tom"), X.inventory_suffix(suffix).alias("suffix"),
        X.is_base_volume(_join(F.col("raw"), F.when(F.col("n") > 4, "-УЛ").otherwise(""), ".pdf"), "raw").alias("base"),
    )


CODE_FORMS = f"""with {CODES}, s as (select *, case when even then 'ИЛО3.' || n || '.' || m else 'ТКР' || n || '.' || m end as suffix from c)
select k, pre || '-' || case when even then 'ИЛОЗ.' || n || '.' || m else 'ТКР' || n || ',' || m end as compact, pre || '-' || case when even then 'ИЛОЗ.' || n || '.' || m else 'ТКР' || n || ',' || m end as code_text,
pre || '-' || suffix as legacy, pre || '-' || suffix as found, pre || '-' || suffix as code_value, pre || '-' || suffix as document, pre || '-ИЛО3.' || n || '.' || m as page,
case when even then '4.3.' else '3.' end || n || '.' || m as tom, suffix, n <= 4 as base from s"""


def text_forms(t) -> DataFrame:
    """Normalisers and parsers of text."""
    k, n, m = (F.col(c) for c in ("k", "n", "m"))
    kind = F.when(m == 1, "Стадия ПРОЕКТНАЯ ДОКУМЕНТАЦИЯ и инженерные изыскания").when(F.col("even"), "Опись. Стадия ПРОЕКТНАЯ ДОКУМЕНТАЦИЯ").otherwise("Инженерно-технические изыскания. Инженерные изыскания")
    owner = F.when(n < 3, "АО «Ленгипротранс»").when(n < 5, "Гипро-Транспуть").when(n < 7, "ПАО гипротранссвязь").otherwise("ООО Ромашка")
    return _codes(t).select(
        "k", X.fold_form(_join(" ёлка —  ", k, "  Тест ")).alias("folded"), X.value(F.when(n == 1, " Без шифра ").otherwise(_join("«Шифр  ", k, "»"))).alias("value"), X.key(F.when(n == 1, "Не определено").otherwise(_join("«Шифр  ", k, "»"))).alias("squeezed"),
        X.registry_text(_join("  Файл ", k, " ")).alias("registry_text"), X.registry_normal(_join("  Файл \t", k, " ")).alias("registry_normal"), X.html_escape(_join("<", k, "&\"'>")).alias("escaped"), X.fragment(_join("Том фрагмент 0", m, ".pdf")).alias("fragment"),
        X.field_label(F.when(n < 3, "CRC").when(n < 6, "Page").otherwise("Box")).alias("label"), X.organization(owner).alias("organization"), X.documentation_kind(kind).alias("kind"),
        X.book_text(_join("Книга 1. Отчет о  работе ", k, "\nТом 4"), F.lit(False)).alias("book"), X.book_number(_join("Книга ", m, ". Отчет")).alias("number"),
        X.score(_join("ПРОЕКТ ", F.repeat(F.lit("слово "), m.cast("int")))).cast("long").alias("score"), X.clear_orientation(F.repeat(F.lit("ДОКУМЕНТ "), (n * 3).cast("int"))).alias("upright"),
        X.append_lines(F.lit("а\nб"), _join("б\nв", k, "\nв", k)).alias("appended"), X.page_crc(_join("Лист CRC32: ", F.lpad(F.hex("k"), 8, "0"))).alias("page_crc"), X.crc(_join("СRС 32 - 1", F.lpad(F.hex("k"), 6, "0"))).alias("padded"),
        X.code_text(_join("ткр", n)).alias("latin"),
    )


TEXT_FORMS = f"""with {CODES} select k, 'ЕЛКА — ' || k || ' ТЕСТ' as folded, case when n > 1 then 'ШИФР ' || k end as value, case when n > 1 then 'ШИФР' || k else '' end as squeezed,
'Файл ' || k as registry_text, 'ФАЙЛ ' || k as registry_normal, '&lt;' || k || '&amp;&quot;&#39;&gt;' as escaped, cast(m as varchar) as fragment,
case when n < 3 then 'CRC32' when n < 6 then 'Лист' else 'Box' end as label, case when n < 3 then 'Ленгипротранс' when n < 5 then 'Росжелдорпроект' when n < 7 then 'Гипротранссвязь' else 'Не определено' end as organization,
case when m = 1 then null when even then 'ПД' else 'ИИ' end as kind, 'Отчет о работе ' || k as book, cast(m as int) as number, cast(25 + 1 + m as bigint) as score, n >= 5 as upright,
'а' || chr(10) || 'б' || chr(10) || 'в' || k as appended, lpad(upper(to_hex(k)), 8, '0') as page_crc, '01' || lpad(upper(to_hex(k)), 6, '0') as padded, 'ТКР' || n as latin from c"""


def section_forms(t) -> DataFrame:
    """Section headings of a text, and their merge by length."""
    k, m = F.col("k"), F.col("m")
    found = X.sections(_join("Раздел 1. Общие  данные ", k, "\nЧасть 2. Смета расхо-\nдов\nГлавный инженер"))
    old, new = F.create_map(F.lit("A"), F.lit("1234567890"), F.lit("B"), F.lit("b")), F.create_map(F.lit("A"), F.repeat(F.lit("x"), (m + 3).cast("int")), F.lit("C"), F.lit("c"))
    merged = X.merge_sections(old, new)
    return _codes(t).select("k", F.size(found).cast("long").alias("headings"), found["РАЗДЕЛ"].alias("part"), found["ЧАСТЬ"].alias("piece"), merged["A"].alias("a"), merged["B"].alias("b"), merged["C"].alias("c"))


SECTION_FORMS = f"""with {CODES} select k, cast(2 as bigint) as headings, '1. Общие данные ' || k as part, '2. Смета расходов' as piece,
case when m + 3 >= 8.5 then repeat('x', cast(m + 3 as int)) else '1234567890' end as a, 'b' as b, 'c' as c from c"""


def date_forms(t) -> DataFrame:
    """Date cells in each of the formats, times of day, and the key of a registry row."""
    day, form = F.date_add(F.to_date("o_orderdate"), 3653), F.col("o_orderkey") % 7
    shown = F.when(form == 0, F.date_format(day, "dd.MM.yyyy")).when(form == 1, F.date_format(day, "d.M.yyyy")).when(form == 2, F.date_format(day, "dd.MM.yy")).when(form == 3, F.date_format(day, "yyyy-MM-dd")).when(form == 4, F.date_format(day, "dd/MM/yyyy")).when(form == 5, F.date_format(day, "dd.MM.yyyy HH:mm")).otherwise(X.serial_of(day).cast("string"))
    hour = (F.col("o_orderkey") % 24).cast("int")
    clock = F.when(form < 3, F.concat(hour.cast("string"), F.lit(":05"))).when(form < 6, (hour / 24).cast("string")).otherwise(" позже  ")
    key = X.registry_key(F.concat(F.lit("Том "), F.col("o_orderkey").cast("string"), F.lit(".pdf")), F.lit("pdf"), F.lit("abcd"), shown, clock)
    return t("orders").select("o_orderkey", X.date_serial(shown).alias("serial"), X.time_key(clock).alias("clock"), F.replace(key, F.lit("\u001f"), F.lit("|")).alias("row_key"))


DATE_FORMS = """with o as (select o_orderkey, cast(date_diff('day', date '1899-12-30', cast(o_orderdate as date)) + 3653 as int) as serial, o_orderkey % 7 as form, lpad(cast(o_orderkey % 24 as varchar), 2, '0') as h from orders),
c as (select *, case when form < 3 then h || ':05:00' when form < 6 then h || ':00:00' else 'ПОЗЖЕ' end as clock from o)
select o_orderkey, serial, clock, 'ТОМ ' || o_orderkey || '|PDF|ABCD|' || serial || '|' || clock as row_key from c"""


def line_codes(t) -> DataFrame:
    """The code that a page's lines consist of: alone, as a sheet, or with a revision note; none where two do."""
    b = base(t)
    lines = b.select("k", F.posexplode(F.array(F.lit("Лист 1"), F.concat("code", F.element_at(F.array(F.lit(""), F.lit("-УЛ"), F.lit(" (Изм. 2)"), F.lit(" и другие")), (F.col("k") % 4 + 1).cast("int"))), F.when(F.col("d") == 0, F.lit("D-0000001")).otherwise(F.lit("конец")))).alias("line_no", "line"))
    return identity.match_lines(lines, b.select("code"), "line", "k", ["line_no"])


LINE_CODES = f"""with {DOCUMENTS} select k, case when d = 0 then 'D-0000001' else code end as code from documents
where (k % 4 < 3 and (d <> 0 or k = 1)) or (k % 4 = 3 and d = 0)"""


def crc_votes(t) -> DataFrame:
    """Checksums read several times: special readings decide alone where two of them are there."""
    e = t("events").select("user_id", "event_id", F.col("event_type").alias("value"), F.lit("s").alias("source"), (F.col("event_id") % 5 == 0).alias("special"))
    return consensus.crc_consensus(e, ["user_id"], "value", "event_id", "source", "special").select("user_id", "value", "agreement", "attempts")


CRC_VOTES = """with e as (select user_id, event_id, event_type v, event_id % 5 = 0 s from events),
few as (select user_id from e where s group by 1 having count(*) >= 2),
used as (select user_id, event_id, v from e where s and user_id in (select user_id from few) union all select user_id, event_id, v from e where user_id not in (select user_id from few)),
r as (select user_id, v, count(*) n, min(event_id) f from used group by all),
k as (select *, row_number() over w rn, lead(n) over w nx, count(*) over p c, sum(n) over p t from r window p as (partition by user_id), w as (partition by user_id order by n desc, f))
select user_id, case when c = 1 or (n >= 2 and n >= 2 * nx) then v end as value, cast(n as bigint) as agreement, cast(t as bigint) as attempts from k where rn = 1"""


def choice_covers(t) -> DataFrame:
    """Whether a choice covers every page once, and the three states of a choice by hand."""
    p = t("pages")
    same = reconcile.same_ids(p, p.select("page_id"), "page_id").withColumnRenamed("same", "all")
    twice = reconcile.same_ids(p, p.select("page_id").union(p.where("page_id = 1").select("page_id")), "page_id").withColumnRenamed("same", "twice")
    less = reconcile.same_ids(p, p.where("page_id > 1").select("page_id"), "page_id").withColumnRenamed("same", "less")
    return same.join(twice).join(less)


CHOICE_COVERS = 'select true as "all", not exists (select 1 from pages where page_id = 1) as twice, not exists (select 1 from pages where page_id <= 1) as less from (select 1)'


def label_matches(t) -> DataFrame:
    """Known findings of hand labels and the rules' findings that answer them, and the labelled fields beside the pages'."""
    b = base(t).where("d in (1, 5, 6)")
    labels = b.select(F.col("k").alias("label_id"), "code", F.lit("Название книги в ИУЛ").alias("topic"), F.when(F.col("d") == 5, F.array(F.lit("Номер книги в описи / комплекте"), F.lit("x"))).alias("topics"), F.when(F.col("d") == 6, F.col("k") * 10 + F.col("k") % 2 * 2).cast("int").alias("photo"))
    found = b.select((F.col("k") + 1).alias("finding_id"), "code", F.when(F.col("d") == 5, "Номер книги в описи / комплекте").otherwise("Название книги в ИУЛ").alias("topic"), F.array((F.col("k") * 10 + 2).cast("int"), (F.col("k") * 10).cast("int")).alias("photos"))
    return evaluate.matches(labels, found)


LABEL_MATCHES = f"with {DOCUMENTS} select k as label_id, k + 1 as finding_id from documents where d in (1, 5, 6)"


def rectangles(t) -> DataFrame:
    """Common parts of rectangles, and words of a crop at their places on the page."""
    k = F.col("p_partkey").cast("double")
    box = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    lit = lambda v: F.lit(float(v))
    common = geometry.rectangle_overlap(box(lit(0), lit(0), lit(100), lit(50)), box(k, lit(10), lit(20), lit(100)))
    word = lambda text, x: F.struct(F.lit(text).alias("text"), x.alias("x"), lit(30).alias("y"), lit(10).alias("width"), lit(8).alias("height"))
    merged = geometry.merge_crop(F.array(word("old", k), word("far", k + 1000)), box(k - 5, lit(20), lit(50), lit(40)), F.array(word("new", lit(4))), lit(2))
    return t("part").select("p_partkey", common["x"].alias("x"), common["w"].alias("w"), common["h"].alias("h"), F.array_join(F.transform(merged, lambda v: F.concat_ws(" ", v["text"], v["x"].cast("int").cast("string"), v["width"].cast("int").cast("string"))), ",").alias("words"))


RECTANGLES = """select p_partkey, case when p_partkey < 100 then cast(p_partkey as double) end as x, case when p_partkey < 100 then cast(least(100, p_partkey + 20) - p_partkey as double) end as w, case when p_partkey < 100 then 40.0::double end as h,
'far ' || (p_partkey + 1000) || ' 10,new ' || (p_partkey - 3) || ' 5' as words from part"""

def _ocr(t) -> DataFrame:
    """Recognised pages: titles, sheets, inventory pages, fragment titles and letters in turn."""
    k, m, code = F.col("k"), F.col("m"), F.col("code")
    c = _codes(t).withColumn("code", _join(F.col("pre"), "-ИЛО3.7.", F.col("m"))).withColumn("g", k % 5)
    word = lambda text, x, y: F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(90.0).alias("width"), F.lit(25.0).alias("height"))
    lines = lambda *ws: F.array(F.struct(F.lit("").alias("text"), F.array(*ws).alias("words")))
    g = F.col("g")
    book = _join("Книга ", m, ". Отчет ", k, "\nТом 4.3.7.", m)
    text = F.when(g == 0, _join(code, "\n", book)).when(g == 1, _join("Информационно-удостоверяющий лист\n", code, "\n", book, "\nCRC32 ", F.lpad(F.hex("k"), 8, "0"))).when(g == 2, "Опись\nШифр тома Наименование\nИЛО3.7").when(g == 3, _join("Фрагмент 2\n", code)).otherwise("Письмо без номера")
    listed = lines(word(_join(F.col("pre"), "-"), 260, 600), word(_join("ИЛОЗ.7.", m), 260, 630), word("Изм.", 900, 630), word(m.cast("string"), 960, 632), word("Короб", 800, 300), word((k % 90 + 1).cast("string"), 800, 640))
    found = F.when(g == 0, lines(word("Ленгипротранс", 40, 50))).when(g == 1, lines(word("АО", 40, 50), word("Желдорпроект", 200, 50), word("Изменения", 600, 500), word("Номер", 600, 460), word(m.cast("string"), 620, 560))).when(g == 2, listed).otherwise(lines(word("Лист", 40, 1500)))
    return c.select(k.cast("int").alias("photo_id"), F.concat(k.cast("string"), F.lit(".jpg")).alias("file"), text.alias("text"), F.lit("ru").alias("language"), F.lit(1200).alias("width"), F.lit(2200).alias("height"), found.alias("lines"))


def page_kinds(t) -> DataFrame:
    """Kind, code, volume, organisation, book and checksum of recognised pages, with choices made by hand for some."""
    ocr = _ocr(t)
    choices = ocr.select("photo_id", F.when(F.col("photo_id") % 50 == 4, True).when(F.col("photo_id") % 50 == 2, False).alias("selected"), F.lit(False).alias("manual"))
    return pages.type_pages(ocr, choices).select("photo_id", "kind", "code", "tom", "organization", "book", "crc", "book_number")


_PAGES = f"""with {CODES}, p as (select *, k % 5 g, case when k % 50 = 4 then '{INVENTORY_KIND}' when k % 50 = 2 then '{UNKNOWN_KIND}'
when k % 5 = 0 then '{TITLE}' when k % 5 = 1 then '{IUL}' when k % 5 = 2 then '{INVENTORY_KIND}' when k % 5 = 3 then '{FRAGMENT_TITLE}' else '{UNKNOWN_KIND}' end kind, pre || '-ИЛО3.7.' || m as code from c)
"""
PAGE_KINDS = _PAGES + """select cast(k as int) as photo_id, kind, case when g in (0, 1, 3) then code end as code, case when g in (0, 1, 3) then '4.3.7.' || m end as tom,
case g when 0 then 'Ленгипротранс' when 1 then 'Желдорпроект' else 'Не определено' end as organization, case when g in (0, 1) then 'Отчет ' || k end as book, case when g = 1 then lpad(upper(to_hex(k)), 8, '0') end as crc, case when g in (0, 1) then cast(m as int) end as book_number from p"""


def inventory_read(t) -> DataFrame:
    """Rows of inventory pages: code from suffix and nearest prefix, revision and box beside the anchor."""
    ocr = _ocr(t)
    typed = Scratch(ocr.sparkSession, "known", large=True).save(pages.type_pages(ocr).select("photo_id", "kind"), "typed")
    return tables.inventory_rows(ocr, typed).select("seq", "code", "tom", "revision", "box", "photo_id")


INVENTORY_READ = _PAGES + "select k * 1000000 + 630 as seq, code, '4.3.7.' || m as tom, cast(m as int) as revision, cast(k % 90 + 1 as int) as box, cast(k as int) as photo_id from p where g = 2"


def table_read(t) -> DataFrame:
    """Rows of tables whose codes are of no family: by row numbers (with a guide row under the head) or by volumes, codes wrapped in their cells."""
    k, n, m = F.col("k"), F.col("n").cast("string"), F.col("m").cast("string")
    word = lambda text, x, y: F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(90.0).alias("width"), F.lit(25.0).alias("height"))
    every = [word("Шифр", 260, 300), word("Наименование", 600, 300), word("K-", 260, 600), word(_join(k, "/А"), 260, 640), word("СП", 260, 800), word(_join(n, "-", m), 360, 800)]
    every += [word("Книга", 600, 600), word(_join(n, "."), 705, 600), word("Отчет", 800, 600), word("Изм.", 970, 600), word(m, 1070, 600)]
    numbered = [word("3", 270, 440), word("4", 650, 440), word("5", 990, 440), word("1.", 30, 600), word("2.", 30, 800)]
    volumes = [word(_join("5.", n), 130, 600), word(_join("6.", n), 130, 800)]
    lines = F.array(F.struct(F.lit("").alias("text"), F.concat(F.array(*every), F.when(F.col("even"), F.array(*volumes)).otherwise(F.array(*numbered))).alias("words")))
    ocr = _codes(t).select(k.cast("int").alias("photo_id"), F.lit("a").alias("file"), F.lit("Опись").alias("text"), F.lit("ru").alias("language"), F.lit(1200).alias("width"), F.lit(2200).alias("height"), lines.alias("lines"))
    rows = tables.inventory_rows(ocr, ocr.select("photo_id", F.lit(INVENTORY_KIND).alias("kind")))
    return rows.select("photo_id", "code", "tom", "book", "revision", "book_number", "anchor_y", "book_continuation")


TABLE_READ = """with c as (select p_partkey as k, 1 + p_partkey % 9 as n, 1 + p_partkey % 8 as m, p_partkey % 2 = 0 as even from part)
select cast(k as int) as photo_id, 'K-' || k || '/А' as code, case when even then '5.' || n end as tom, 'Отчет' as book, cast(m as int) as revision, cast(n as int) as book_number, 600.0::double as anchor_y, false as book_continuation from c
union all select cast(k as int), 'СП ' || n || '-' || m, case when even then '6.' || n end, null, null, null, 800.0::double, false from c"""


def revision_read(t) -> DataFrame:
    """The number under the label of a change, and readings of other passes that replace page fields."""
    ocr = _ocr(t)
    typed = pages.type_pages(ocr).join(pages.labelled_revision(ocr).withColumnRenamed("revision", "__r"), "photo_id", "left").withColumn("revision", F.col("__r")).drop("__r")
    read = lambda field, value, seq: ocr.where("photo_id % 15 = 1").select("photo_id", F.lit(field).alias("field"), F.lit(value).cast("string").alias("value"), F.lit(seq).alias("seq"))
    readings = read("Revision", "7", 1).union(read("Revision", "8", 2)).union(read("CRC", None, 1)).union(read("Pages", "3", 1)).union(read("Page", "5", 1))
    return pages.apply_readings(typed, readings).where(F.col("kind") == IUL).select("photo_id", "revision", "crc", "page")


REVISION_READ = _PAGES + "select cast(k as int) as photo_id, cast(case when k % 15 = 1 then 8 else m end as int) as revision, case when k % 15 <> 1 then lpad(upper(to_hex(k)), 8, '0') end as crc, cast(case when k % 15 = 1 then 5 end as int) as page from p where g = 1"


def page_words(t) -> DataFrame:
    """Words of pages, one row each."""
    return geometry.words(_ocr(t).select("photo_id", "lines"), ["photo_id"]).select("photo_id", F.col("line_no").cast("long").alias("line_no"), F.col("word_no").cast("long").alias("word_no"), "text", "x", "y")


PAGE_WORDS = _PAGES + """, w as (select k, case g when 0 then [('Ленгипротранс', 40, 50)] when 1 then [('АО', 40, 50), ('Желдорпроект', 200, 50), ('Изменения', 600, 500), ('Номер', 600, 460), (cast(m as varchar), 620, 560)]
when 2 then [(pre || '-', 260, 600), ('ИЛОЗ.7.' || m, 260, 630), ('Изм.', 900, 630), (cast(m as varchar), 960, 632), ('Короб', 800, 300), (cast(k % 90 + 1 as varchar), 800, 640)] else [('Лист', 40, 1500)] end as ws from p)
select cast(k as int) as photo_id, cast(0 as bigint) as line_no, cast(i - 1 as bigint) as word_no, ws[i][1] as text, cast(ws[i][2] as double) as x, cast(ws[i][3] as double) as y from w, unnest(range(1, len(ws) + 1)) u(i)"""

QUERIES = {
    "rule_findings": (rule_findings, FINDINGS + "select * from found"), "audit_counters": (audit_counters, COUNTERS), "code_forms": (code_forms, CODE_FORMS), "text_forms": (text_forms, TEXT_FORMS), "section_forms": (section_forms, SECTION_FORMS),
    "date_forms": (date_forms, DATE_FORMS), "line_codes": (line_codes, LINE_CODES), "crc_votes": (crc_votes, CRC_VOTES), "choice_covers": (choice_covers, CHOICE_COVERS), "label_matches": (label_matches, LABEL_MATCHES), "rectangles": (rectangles, RECTANGLES),
    "page_kinds": (page_kinds, PAGE_KINDS), "inventory_read": (inventory_read, INVENTORY_READ), "revision_read": (revision_read, REVISION_READ), "table_read": (table_read, TABLE_READ), "page_words": (page_words, PAGE_WORDS),
}
