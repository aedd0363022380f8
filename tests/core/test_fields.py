"""Labelled codes, lone codes, bodies and books of small pages."""

import json

from reconspark.operators import fields, reconcile
from reconspark.plans import audit

from .test_audit import frame, word
from .test_forms import ocr


def lines(spark, rows):
    return frame(spark, [(1, json.dumps({"file": "a", "text": "\n".join(" ".join(w["text"] for w in r) for r in rows), "language": "ru", "width": 1200, "height": 2200, "lines": [{"text": " ".join(w["text"] for w in r), "words": r} for r in rows]}, ensure_ascii=False))])


def test_code_under_a_label_wraps(spark):
    o = lines(spark, [[word("Обозначение", 100, 300), word("Наименование", 600, 300)], [word("ABC-", 100, 360), word("Здание", 620, 360)], [word("Ω/7", 100, 400)], [word("другое", 100, 440)]])
    assert fields.codes_under_labels(o).first()["field"] == "ABC-Ω/7"
    o = lines(spark, [[word("Наименование", 20, 300), word("и", 110, 300), word("Шифр", 150, 300), word("объекта", 250, 300)], [word("нечто", 150, 360)]])
    assert fields.codes_under_labels(o).count() == 0


def test_lone_title_code(spark):
    o = lines(spark, [[word("ЭОМ-17.02", 500, 1200)], [word("CRC32", 500, 1300)], [word("обычный", 400, 1400), word("текст1", 500, 1400)]])
    assert fields.title_codes(o).first()["token"] == "ЭОМ-17.02"
    o = lines(spark, [[word("AB-17", 500, 1200)], [word("AB-18", 500, 1300)]])
    assert fields.title_codes(o).count() == 0


def test_body_rows_in_reading_order(spark):
    ws = [word("Книга", 300, 800), word("8.", 400, 800), word("подстанция.", 520, 842), word("Тяговая", 400, 847), word("Учёт", 400, 900), word("Том", 300, 1000)]
    assert fields.iul_bodies(ocr(spark, ws)).first()["body"] == "Книга 8.\nТяговая подстанция.\nУчёт"


def test_footer(spark):
    assert fields.footer_numbers(ocr(spark, [word("Лист", 900, 1800), word("З", 910, 1850), word("7", 910, 1900)])).first()["number"] == 3


def test_books_of_inventory_rows(spark):
    ws = [word("Книга", 500, 600), word("1.", 600, 600), word("Первая", 700, 602), word("книга", 520, 630), word("Книга", 500, 700), word("2.", 600, 700), word("Вторая", 700, 700)]
    rows = spark.createDataFrame([(1, "A", 600.0, None, None), (1, "B", 700.0, None, None)], "photo_id int, code string, anchor_y double, book string, sections map<string,string>")
    got = {r["code"]: r["book"] for r in fields.inventory_books(ocr(spark, ws), rows).collect()}
    assert got["B"] == "Вторая" and got["A"].startswith("Первая")


def test_labelled_code_beats_other_codes(spark):
    o = lines(spark, [[word("Обозначение", 100, 300), word("документа:", 200, 300), word("АЛЬФА", 320, 300)], [word("см.", 100, 400), word("123-45-6789-ИЛО4.1.1", 200, 400)]])
    assert audit.audit(o).pages.first()["code"] == "АЛЬФА"


def test_choice_covers_every_page(spark):
    a = spark.createDataFrame([(1,), (2,)], "id int")
    for b, same in (([1, 2], True), ([1], False), ([1, 2, 2], False), ([1, 3], False)):
        assert reconcile.same_ids(a, spark.createDataFrame([(x,) for x in b], "id int"), "id").first()["same"] is same
