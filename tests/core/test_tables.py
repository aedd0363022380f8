"""Inventory tables: ruled, numbered and volume bands, guide rows, three ways to a row, continuations."""

import json

import numpy as np
from pyspark.sql import functions as F

from reconspark.functions import text as X
from reconspark.operators import fields, rules, tables
from reconspark.operators import pages as typing
from reconspark.plans import audit
from reconspark.storage import Scratch

from .test_audit import H, W, frame, page, word

IMAGE = "photo_id int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def picture(spark, images):
    rows = [(i, ("x", a.shape[0], a.shape[1], a.shape[2], 16, bytearray(np.ascontiguousarray(a).tobytes()))) for i, a in images.items()]
    return spark.createDataFrame(rows, IMAGE)


def blank(h=H, w=W):
    return np.full((h, w, 3), 255, np.uint8)


def grid(image, xs, ys, x0, x1, y0, y1):
    for x in xs:
        image[y0 : y1 + 1, x - 1 : x + 2] = 0
    for y in ys:
        image[y - 1 : y + 2, x0 : x1 + 1] = 0
    return image


def inventory(photo_id, suffix, heading="Опись", more=(), drop=lambda w: False, text=None):
    ws = [word("Шифр", 260, 300), word("тома", 360, 300), word("Наименование", 600, 300), word("документа", 800, 300), word("123-45-6789-", 260, 600), word(suffix, 260, 640)]
    ws += [word("Книга", 600, 600), word("10.", 705, 600), word("Тестовое", 760, 600), word("здание", 600, 640), word("Изм.", 970, 600), word("2", 1070, 600)]
    ws = [w for w in ws if not drop(w)] + list(more)
    text = text if text is not None else heading + "\nШифр тома\nНаименование документа\n123-45-6789-\n" + suffix
    return photo_id, json.dumps({"file": "a", "text": text, "language": "ru", "width": W, "height": H, "lines": [{"text": heading, "words": []}, {"text": "", "words": ws}]}, ensure_ascii=False)


def test_ruled_cells_whatever_the_code(spark):
    """A code wrapped within a cell, a row without a readable number, a guide row; at the page's size and at half of it."""
    more = [word("3", 270, 440), word("4", 650, 440), word("5", 990, 440), word("1.", 30, 600), word("ABC-", 260, 600), word("Ω/7", 260, 700), word("007", 260, 1000)]
    ocr = frame(spark, [inventory(i, "Ω/7", more=more, drop=lambda w: w["y"] > 350) for i in (1, 2)])
    full = grid(blank(), (230, 550), (400, 550, 900, 1200), 230, 550, 250, 1200)
    ruled = tables.table_rules(ocr, picture(spark, {1: full, 2: grid(blank(H // 2, W // 2), (115, 275), (200, 275, 450, 600), 115, 275, 125, 600)}))
    got = {r["photo_id"]: r for r in ruled.collect()}
    assert [round(y / 10) for y in got[1]["rules"]] == [40, 55, 90, 120] == [round(y / 10) for y in got[2]["rules"]]
    assert abs(got[1]["rule_left"] - 231) <= 2 and abs(got[1]["rule_right"] - 549) <= 2
    rows = tables.table_rows(ocr, ruled).orderBy("photo_id", "y").collect()
    assert [(r["photo_id"], r["code"], r["continuation"]) for r in rows] == [(i, c, k) for i in (1, 2) for c, k in (("ABC-Ω/7", False), ("007", True))]
    assert ocr.join(tables.table_rules(ocr, picture(spark, {1: blank()})), "photo_id").select("rule_left", "rule_right", "rules").first() == (None, None, [])


ARBITRARY = ["ЭОМ-ABC/17.02", "007", "АЛЬФА", "Я", "СП / Договор №7", "PREFIX-123-45-6789-ИЛО4.1.1-SUFFIX", "Ω/PLAN-07"]


def listed(ocr):
    """The inventory rows of pages that are inventories."""
    return tables.inventory_rows(ocr, ocr.select("photo_id", F.lit("Опись").alias("kind")))


def test_any_code_in_a_numbered_row(spark):
    """Through the whole audit: pages are inventories, and their rows have the codes as values."""
    ocr = frame(spark, [inventory(20 + i, code, more=[word("1.", 30, 600)], drop=lambda w: w["text"] == "123-45-6789-") for i, code in enumerate(ARBITRARY)])
    t = audit.audit(ocr)
    want = spark.createDataFrame([(20 + i, c) for i, c in enumerate(ARBITRARY)], "i int, c string").select("i", X.value("c").alias("v")).collect()
    assert sorted((r["photo_id"], r["code"], r["revision"], r["book_number"], r["book"], r["book_continuation"]) for r in t.inventory.collect()) == [(r["i"], r["v"], 2, 10, "Тестовое здание", False) for r in want]
    assert {r["kind"] for r in t.pages.collect()} == {"Опись"} and audit.counters(t).first()["inventory_only"]


def test_bands_of_numbers_and_of_volumes(spark):
    """A row from each number's top to the next, one above the first; between volumes the middle parts them."""
    cells = [word("Ж-1", 260, 460), word("К-2", 260, 600), word("(а)", 260, 640), word("Л-3", 260, 800)]
    numbered = inventory(1, "", more=[*cells, word("1", 30, 590), word("2", 30, 790)], drop=lambda w: w["y"] > 350)
    volumes = inventory(2, "", more=[*cells[1:], word("5.1", 130, 600), word("5.2", 130, 800)], drop=lambda w: w["y"] > 350)
    got = [(r["photo_id"], r["code"], r["volume"], r["continuation"]) for r in tables.table_rows(frame(spark, [numbered, volumes])).orderBy("photo_id", "y").collect()]
    assert got == [(1, "Ж-1", None, True), (1, "К-2 (А)", None, False), (1, "Л-3", None, False), (2, "К-2 (А)", "5.1", False), (2, "Л-3", "5.2", False)]
    assert tables.table_rows(frame(spark, [page(1, "Шифр без имени"), page(2, "")])).count() == 0


def test_codes_by_suffix_by_volume_and_by_cell_are_one_list(spark):
    """A suffix and its cell are one row; a volume completes a code, or recovers a missed one of its family; another code has a row of its own."""
    more = [word("1.", 30, 600), word("2.", 30, 700), word("СП-12", 260, 700), word("3.", 30, 800), word("4.3.7.1.2", 130, 640)]
    ocr = frame(spark, [inventory(1, "ИЛО3.7.1", more=more), inventory(2, "ИЛО3.7.1", more=[word("4.3.9.1", 130, 900)]), inventory(3, "ТкР12.1", more=[word("3.12.1.9", 130, 640), word("4.3.9.1", 130, 900)])])
    rows = listed(ocr)
    better = {r["photo_id"]: r["quality"] for r in fields.inventory_quality(rows).collect()}
    rows = rows.orderBy("photo_id", "anchor_y").collect()
    assert [(r["photo_id"], r["code"], r["tom"]) for r in rows] == [(1, "123-45-6789-ИЛО3.7.1", "4.3.7.1"), (1, "СП-12", None), (2, "123-45-6789-ИЛО3.7.1", "4.3.7.1"), (2, "123-45-6789-ИЛО3.9.1", "4.3.9.1"), (3, "123-45-6789-ТКР12.1.9", "3.12.1.9")]
    assert better[1] > 20000 > better[3] > 10000


def test_boxes_and_stages_of_pages(spark):
    """Pages that go on: one box and one stage; a box read twice differently stays open; a wrapped volume; a page chosen by hand."""
    box = lambda n: [word("Короба", 1150, 300), word(n, 1150, 600)]
    pages = [inventory(3, "ИЛО3.7.1", "Проектная документация", box("22")), inventory(4, "ИЛО4.1.2", "", box("22")), inventory(5, "ИЛО3.7.1", "Проектная документация", box("23"))]
    pages += [inventory(6, "ИЛО4Л.1О", "", [word("4.4.1.", 150, 600), word("О", 150, 640)]), inventory(7, "ИЛО3.7.1", "", text="123-45-6789-ИЛО3.7.1"), inventory(8, "TkP12.l.9", "Опись. Стадия: Проектная документация", box("13"))]
    rows = listed(frame(spark, pages))
    got = {r["photo_id"]: r for r in rows.collect()}
    assert {i: (r["code"], r["tom"]) for i, r in got.items() if i > 5} == {6: ("123-45-6789-ИЛО4.1.10", "4.4.1.10"), 7: ("123-45-6789-ИЛО3.7.1", "4.3.7.1"), 8: ("123-45-6789-ТКР12.1.9", "3.12.1.9")}
    assert got[8]["box"] == 13 and got[8]["documentation_kind"] == "ПД"
    merged, _, _ = rules.merge_inventory(rows.where("photo_id < 5"))
    assert sorted((r["code"], r["box"], r["documentation_kind"], r["revision"]) for r in merged.collect()) == [("123-45-6789-ИЛО3.7.1", 22, "ПД", 2), ("123-45-6789-ИЛО4.1.2", 22, "ПД", 2)]
    merged, boxes, _ = rules.merge_inventory(rows.where("photo_id in (3, 5)"))
    assert [r["box"] for r in merged.collect()] == [None] and boxes.count() == 1


def test_text_that_goes_on_across_a_page_break(spark):
    """The first band of the second page has no number and no book word: its text is joined to the row of the same code."""
    first = inventory(1, "", more=[word("1.", 30, 600), word("Ж-1", 260, 600)], drop=lambda w: w["text"] in ("123-45-6789-", ""))
    second = inventory(2, "", more=[word("Ж-1", 260, 450), word("и", 600, 450), word("пристройка", 700, 450), word("2.", 30, 600), word("К-2", 260, 600)], drop=lambda w: w["y"] > 350)
    read = listed(frame(spark, [first, second]))
    rows = {(r["photo_id"], r["code"]): r for r in read.collect()}
    assert [(k, rows[k]["book_continuation"]) for k in sorted(rows)] == [((1, "Ж-1"), False), ((2, "Ж-1"), True), ((2, "К-2"), False)]
    assert rows[2, "Ж-1"]["book"] == "и пристройка"
    merged, _, _ = rules.merge_inventory(read)
    assert {r["code"]: r["book"] for r in merged.collect()}["Ж-1"] == "Тестовое здание и пристройка"


def test_rows_show_that_a_page_is_an_inventory(spark):
    """No heading and no code of a known family: ruled rows alone make the page an inventory."""
    more = [word("ABC-", 260, 600), word("Ω/7", 260, 700)]
    ocr = frame(spark, [inventory(1, "", "", more=more, drop=lambda w: w["y"] > 350, text="Шифр Наименование")])
    full = grid(blank(), (230, 550), (400, 900, 1200), 230, 550, 250, 1200)
    ruled = tables.table_rules(ocr, picture(spark, {1: full}))
    assert typing.type_pages(ocr, rules=ruled).first()["kind"] == "Опись"
    assert typing.type_pages(ocr).first()["kind"] == "Не определено"


def test_no_step_broadcasts_pages_or_words(spark, monkeypatch):
    """However small they are estimated: at 60 times sf0.1 these tables filled the driver."""
    plans, save = [], Scratch.save
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: (plans.append(shown(df)), save(self, df, name))[1])
    plans.append(shown(listed(frame(spark, [inventory(1, "ИЛО3.7.1")]))))
    assert len(plans) > 5 and [p for p in plans if "Broadcast" in p] == []
