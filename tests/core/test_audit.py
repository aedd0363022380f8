"""Small page sets with known findings."""

import json

from pyspark.sql import functions as F

from reconspark.operators import pages, reconcile, rules
from reconspark.plans import audit
from reconspark.schemas import INVENTORY, OCR, PAGE

W, H = 1200, 2200


def page(photo_id, text):
    lines = [{"text": t, "words": [{"text": w, "x": 40.0 + 90 * j, "y": 400.0 + 35 * i, "width": 80.0, "height": 22.0} for j, w in enumerate(t.split())]} for i, t in enumerate(text.split("\n"))]
    return photo_id, json.dumps({"file": f"p{photo_id}.jpg", "text": text, "language": "ru", "width": W, "height": H, "lines": lines}, ensure_ascii=False)


def word(text, x, y):
    return {"text": text, "x": float(x), "y": float(y), "width": 90.0, "height": 25.0}


def frame(spark, rows):
    return spark.createDataFrame(rows, "photo_id int, j string").select("photo_id", F.from_json("j", OCR).alias("o")).select("photo_id", "o.*")


TITLE = "Книга 1. Шумозащитные экраны\n123-45-6789-ИЛО3.7.1\nТом 4.3.7.1"


def iul(name):
    return f"Информационно-удостоверяющий лист\n123-45-6789-ИЛОЗ.7.1\nКнига 1. {name}\nТом 4.3.7.1\nCRC32 АВ12СD34"


def topics(t, *some):
    """Findings by topic: of all rules, or of some."""
    parts = [d for rule in some for d in rule(t)]
    return {r["topic"]: r for r in (reconcile.union_findings(parts) if parts else rules.all_findings(t)).collect()}


def test_title_and_iul_disagree(spark):
    t = audit.audit(frame(spark, [page(1, TITLE), page(2, iul("Ограждения"))]))
    got = {r["photo_id"]: r for r in t.pages.collect()}
    assert got[1]["kind"] == "Титул" and got[2]["kind"] == "ИУЛ"
    assert got[1]["code"] == got[2]["code"] == "123-45-6789-ИЛО3.7.1" and got[2]["crc"] == "AB12CD34"
    found = topics(t)
    assert found["Название книги в ИУЛ"]["level"] == "Расхождение" and found["Название книги в ИУЛ"]["photos"] == [2, 1]
    c = audit.counters(t).first()
    assert (c["volumes"], c["titles"], c["iuls"]) == (1, 1, 1)


def test_title_and_iul_agree(spark):
    # No signing rows can be read off the sheet; nothing else is wrong.
    assert topics(audit.audit(frame(spark, [page(1, TITLE), page(2, iul("Шумозащитные экраны"))]))).keys() == {"Подписная таблица не распознана"}


def test_signing_rows_are_read_and_seals_judged(spark):
    """R19 and R22 in the audit itself: a sheet with a signing row is not reported, a title with a weak seal is."""
    signed = json.loads(page(2, iul("Шумозащитные экраны"))[1])
    signed["lines"].append({"text": "Нормоконтроль Иванов", "words": [word("Нормоконтроль", 60, 900), word("Иванов", 420, 900)]})
    seals = spark.createDataFrame([(1, "Круглая форма не найдена", 0.4)], "photo_id int, status string, score double")
    t = audit.audit(frame(spark, [page(1, TITLE), (2, json.dumps(signed, ensure_ascii=False))]), seals=seals)
    found = topics(t)
    assert found["Печать на титуле"]["photos"] == [1] and "Подписная таблица не распознана" not in found
    assert found["Подписи: проверка отдельных строк"]["photos"] == [2]
    unseen = rules.Tables(t.pages.withColumn("signatures", F.lit(None).cast(dict(t.pages.dtypes)["signatures"])), t.inventory)
    assert not {"Подписная таблица не распознана", "Подписи: проверка отдельных строк", "Титул фрагмента"} & topics(unseen, rules.page_rules).keys()


def test_inventory_without_heading_words(spark):
    """Columns of an inventory and rows that can be read make a page an inventory, though its text names no code."""
    ws = [word("123-45-6789-", 260, 600), word("ИЛО3.7.1", 260, 630)]
    row = (1, json.dumps({"file": "a", "text": "Шифр Наименование", "language": "ru", "width": W, "height": H, "lines": [{"text": "x", "words": ws}]}, ensure_ascii=False))
    assert audit.audit(frame(spark, [row])).pages.first()["kind"] == "Опись"


def test_inventory_page(spark):
    ws = [word("123-45-6789-", 260, 600), word("ИЛО3.7.1", 260, 630), word("Изм.", 900, 630), word("2", 960, 632), word("Короб", 800, 300), word("22", 800, 640)]
    text = "Опись\nШифр тома Наименование\n123-45-6789-\nИЛО3.7.1"
    row = (1, json.dumps({"file": "a", "text": text, "language": "ru", "width": W, "height": H, "lines": [{"text": "x", "words": ws}]}, ensure_ascii=False))
    t = audit.audit(frame(spark, [row]))
    p, (r,) = t.pages.first(), t.merged.collect()
    assert p["kind"] == "Опись" and p["code"] is None
    assert (r["code"], r["tom"], r["revision"], r["box"]) == ("123-45-6789-ИЛО3.7.1", "4.3.7.1", 2, 22)
    assert "Нет фотографий тома" not in topics(t, rules.missing_volumes) and audit.counters(t).first()["inventory_only"]


def test_cut_codes_are_completed_and_lines_bind_pages(spark):
    """A code cut at a hyphen takes the only longer one of its volume; a page whose line is a known code takes it and becomes a title."""
    rows = spark.createDataFrame([(1, "ABC-", "5.1"), (2, "ABC-17", "5.1"), (3, "ABC-", "5.2"), (4, "X/", "5.3"), (5, "X/1", "5.3"), (6, "X/2", "5.3"), (7, "ABC-", None)], "seq int, code string, tom string")
    assert {r["seq"]: r["code"] for r in audit.completed_codes(rows).collect()} == {1: "ABC-17", 2: "ABC-17", 3: "ABC-", 4: "X/", 5: "X/1", 6: "X/2", 7: "ABC-"}
    ws = [word("Шифр", 260, 300), word("Наименование", 600, 300), word("1.", 30, 600), word("СП-12/Б", 260, 600), word("2.", 30, 800), word("СП-14", 260, 800)]
    listed = (1, json.dumps({"file": "a", "text": "Опись Шифр Наименование ТКР", "language": "ru", "width": W, "height": H, "lines": [{"text": "", "words": ws}]}, ensure_ascii=False))
    t = audit.audit(frame(spark, [listed, page(2, "Книга 3. Отчет\nСП-12/Б (Изм. 2)"), page(3, "Книга 4. Смета\nсм. СП-12/Б и другие"), page(4, "Письмо\nСП-14\nСП-12/Б")]))
    got = {r["photo_id"]: (r["kind"], r["code"]) for r in t.pages.collect()}
    assert got == {1: ("Опись", None), 2: ("Титул", "СП-12/Б"), 3: ("Не определено", None), 4: ("Не определено", None)}


def test_override_has_three_states(spark):
    o = frame(spark, [page(1, "Опись\nИЛО3"), page(2, "Книга"), page(3, "Текст")])
    choice = spark.createDataFrame([(1, False, False), (3, True, False)], "photo_id int, selected boolean, manual boolean")
    assert {r["photo_id"]: r["kind"] == "Опись" for r in audit.audit(o, overrides=choice).pages.collect()} == {1: False, 2: False, 3: True}
    assert audit.audit(o).pages.where("photo_id = 1").first()["kind"] == "Опись"


def inventory(spark, rows):
    return spark.createDataFrame([(i, "K-1", None, b, k, None, box, n, i, None, 0.0, c) for i, (b, k, box, n, c) in enumerate(rows, 1)], "seq int, code string, tom string, book string, documentation_kind string, revision int, box int, book_number int, photo_id int, sections map<string,string>, anchor_y double, book_continuation boolean")


def test_boxes_and_kinds_conflict(spark):
    merged, boxes, kinds = rules.merge_inventory(inventory(spark, [("Первая", "ПД", 22, None, False), ("часть", None, 23, None, True)]))
    (r,) = merged.collect()
    assert r["box"] is None and r["book"] == "Первая часть" and boxes.first()["values"] == "22 / 23" and not kinds.count()
    merged, _, _ = rules.merge_inventory(inventory(spark, [(None, "ПД", 22, None, False), (None, None, 22, None, False)]))
    assert merged.first()["box"] == 22 and merged.first()["documentation_kind"] == "ПД"


def test_registry_checksum(spark):
    registry = spark.createDataFrame([(7, "123-45-6789-ИЛО3.7.1.pdf", "DEADBEEF"), (8, "other.pdf", "AB12CD34")], "row int, file string, checksum string")
    t = audit.audit(frame(spark, [page(1, TITLE), page(2, iul("Шумозащитные экраны"))]), registry=registry)
    sums = lambda t: rules.checksums(t)[0]
    assert topics(t, sums)["CRC32 не совпадает"]["detail"].startswith("ИУЛ: AB12CD34; Excel: DEADBEEF")
    same = registry.withColumn("checksum", F.lit("ab12cd34"))
    t = audit.audit(frame(spark, [page(1, TITLE), page(2, iul("Шумозащитные экраны"))]), registry=same)
    assert "CRC32 не совпадает" not in topics(t, sums) and audit.counters(t).first()["crc_matches"] == 1


def test_unread_and_disputed_readings(spark):
    readings = spark.createDataFrame([(2, "Page", None, "Не распознано", []), (2, "CRC", None, "Спорное чтение", ["A", "B"]), (2, "Pages", None, "Не распознано", [])], "photo_id int, field string, value string, status string, candidates array<string>")
    t = audit.audit(frame(spark, [page(1, TITLE), page(2, iul("Шумозащитные экраны"))]), readings=readings)
    found = topics(t, rules.page_rules)
    assert "Не удалось прочитать: Лист" in found and "Разные результаты чтения: CRC32" in found and "Не удалось прочитать: Листов" not in found
    assert t.pages.where("photo_id = 2").first()["crc"] is None  # a disputed reading erases the page's own


def test_readings_of_a_cell_that_is_not_there_are_dropped(spark):
    """A Revision reading counts on an IUL page with a labelled cell only, and on pages of other kinds; Pages readings never."""
    sheet = json.loads(page(2, iul("Ограждения"))[1])
    sheet["lines"].append({"text": "", "words": [word("Номер", 600, 1460), word("изменения", 600, 1500), word("2", 620, 1560)]})
    ocr = frame(spark, [page(1, iul("Ограждения")), (2, json.dumps(sheet, ensure_ascii=False)), page(3, "x")])
    typed = spark.createDataFrame([(1, "ИУЛ"), (2, "ИУЛ"), (3, "Титул")], "photo_id int, kind string")
    readings = spark.createDataFrame([(i, f, "3") for i in (1, 2, 3) for f in ("Revision", "Pages", "CRC")], "photo_id int, field string, value string")
    assert sorted((r["photo_id"], r["field"]) for r in pages.current_readings(readings, ocr, typed).collect()) == [(1, "CRC"), (2, "CRC"), (2, "Revision"), (3, "CRC"), (3, "Revision")]


def test_covers_beside_a_signed_title_need_no_seal(spark):
    """A bare title is left alone if another title of its code and organization is signed or sealed; without a code too."""
    signed = [("Разработал", "Иванов", "X", "Найдены", False)]
    row = lambda i, code, who=(), score=0.4, text="Титул": (i, "Титул", code, None, "X", None, None, None, None, None, None, text, None, list(who), ("Круглая форма не найдена", score), None, None)
    rows = [row(1, "A"), row(2, "A", signed, 0.7), row(3, None), row(4, None, (), 0.9), row(5, "B"), row(6, "C", (), 0.9), row(7, "A", (), 0.4, "Главный инженер")]
    t = rules.Tables(spark.createDataFrame(rows, PAGE), spark.createDataFrame([], INVENTORY))
    assert sorted(r["photos"][0] for r in rules.page_rules(t)[0].collect()) == [5, 7]


def test_recheck_keeps_the_rest(spark):
    o = frame(spark, [page(1, TITLE), page(2, "x")])
    again = frame(spark, [page(1, "y"), page(2, TITLE)])
    got = {r["photo_id"]: r["text"] for r in audit.recheck(o, again, spark.createDataFrame([(2,), (2,)], "photo_id int")).collect()}
    assert got == {1: TITLE, 2: TITLE}
    same = audit.recheck(o, again.limit(0), spark.createDataFrame([], "photo_id int"))
    assert sorted(r["text"] for r in same.collect()) == sorted([TITLE, "x"])
