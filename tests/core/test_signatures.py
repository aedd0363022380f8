"""Strokes in signing cells, seals, and pictures made upright and flat."""

import json

import numpy as np
from pyspark.sql import functions as F

from reconspark.operators import forms, pixels, rules, signatures
from reconspark.plans import audit

from .test_audit import frame, word
from .test_tables import picture


def line(image, points, width=4, colour=(0, 0, 0)):
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        n = int(max(abs(x1 - x0), abs(y1 - y0))) * 2 + 1
        for x, y in zip(np.linspace(x0, x1, n), np.linspace(y0, y1, n), strict=True):
            image[int(y) - width // 2 : int(y) + width // 2 + 1, int(x) - width // 2 : int(x) + width // 2 + 1] = colour
    return image


def sheet(strokes=True, colour=(0, 0, 0)):
    image = np.full((2000, 1000, 3), 255, np.uint8)
    for y in (1300, 1500, 1700):
        line(image, [(10, y), (990, y)])
    for x in (10, 270, 550, 830, 990):
        line(image, [(x, 1300), (x, 1700)])
    return line(image, [(580, 1450), (610, 1350), (660, 1430), (700, 1360), (770, 1410)], colour=colour) if strokes else image


WORDS = [("Главный", 35, 1320), ("инженер", 125, 1320), ("Александров", 290, 1320), ("Главный", 35, 1520), ("инженер", 125, 1520), ("проекта", 35, 1560), ("Иванов", 290, 1520)]


def signing_page(photo_id, text="Информационно-удостоверяющий лист\n123-45-6789-ИЛО3.7.1\nCRC32 AB12CD34"):
    ws = [word(*w) for w in WORDS]
    return photo_id, json.dumps({"file": "a", "text": text, "language": "ru", "width": 1000, "height": 2000, "lines": [{"text": "", "words": ws}]}, ensure_ascii=False)


def test_components_by_flood_fill():
    r = np.random.default_rng(1)
    for _ in range(25):
        m = r.random((r.integers(1, 20), r.integers(1, 20))) < r.random()
        number, many = signatures.components(m)
        seen, k = np.full(m.shape, -1), 0
        for start in map(tuple, np.argwhere(m)):
            todo = [start] if seen[start] < 0 else []
            while todo:
                y, x = todo.pop()
                if 0 <= y < m.shape[0] and 0 <= x < m.shape[1] and m[y, x] and seen[y, x] < 0:
                    seen[y, x] = k
                    todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
            k += bool(seen[start] == k)
        assert many == k and len({*zip(number[m].tolist(), seen[m].tolist(), strict=True)}) == k


def test_strokes_by_kind():
    box = (560, 1310, 820, 1490)
    assert signatures.strokes(sheet(), box, [])[0] == signatures.BLACK
    assert signatures.strokes(sheet(colour=(200, 60, 30)), box, [])[0] == signatures.COLOURED
    assert signatures.strokes(sheet(False), box, []) == (signatures.EMPTY, 0, 0)
    assert signatures.strokes(sheet(), (560, 1310, 565, 1490), [])[0] == signatures.CUT_OFF
    assert signatures.strokes(sheet(), box, [(570, 1320, 810, 1480)])[0] == signatures.EMPTY  # a printed word covers it
    dots = sheet(False)
    dots[1400:1405, 600:606] = dots[1400:1405, 700:706] = 0
    assert signatures.strokes(dots, box, [])[0] == signatures.UNCLEAR
    assert signatures.strokes(line(sheet(False), [(556, 1400), (825, 1400)]), box, [])[0] == signatures.EMPTY  # a ruled line
    assert signatures.strokes(sheet(), box, [], (0.9, 690, 1400, 300))[0] == signatures.EMPTY  # inside a seal
    dark = pixels.grey(sheet()) < signatures.CELL_RULE
    found, located = signatures.cell(dark, (550, 1300, 830, 1500))
    assert located and all(abs(a - b) <= 6 for a, b in zip(found, (553, 1303, 827, 1497), strict=True))


def test_signing_rows_of_scans(spark):
    """Files of pictures to findings: the row without strokes is reported, the other is not; without scans both are."""
    ocr = frame(spark, [signing_page(1), signing_page(2)])
    images = picture(spark, {1: sheet(), 2: sheet(False)})
    t = audit.audit(ocr, images=images)
    status = {(r["photo_id"], s["role"]): s["status"] for r in t.pages.collect() for s in r["signatures"]}
    assert status == {(1, "Главный инженер"): signatures.BLACK, (1, "Главный инженер проекта"): signatures.EMPTY, (2, "Главный инженер"): signatures.EMPTY, (2, "Главный инженер проекта"): signatures.EMPTY}
    details = {r["photos"][0]: r["detail"] for r in rules.page_rules(t)[2].collect()}
    assert "проекта (ИВАНОВ): Ячейка выглядит пустой" in details[1] and "АЛЕКСАНДРОВ" not in details[1] and "АЛЕКСАНДРОВ" in details[2]
    whole = spark.createDataFrame([(1, "ИУЛ", None, "x")], "photo_id int, kind string, organization string, text string")
    roles = forms.roles(ocr.where("photo_id = 1"), whole)
    small = signatures.evidence(ocr, whole, roles, picture(spark, {1: sheet()[::2, ::2]})).first()
    assert [r["status"] for r in small["rows"]] == [signatures.BLACK, signatures.EMPTY] and small["seal"] is None


def test_seals_of_scans(spark):
    image = np.full((900, 700, 3), 255, np.uint8)
    y, x = np.mgrid[0:900, 0:700]
    image[np.abs(np.hypot(x - 350, y - 740) - 80) < 4] = (160, 40, 30)
    row = lambda i: (i, json.dumps({"file": "a", "text": "Книга 1", "language": "ru", "width": 700, "height": 900, "lines": []}, ensure_ascii=False))
    ocr = frame(spark, [row(1), row(2)])
    typed = spark.createDataFrame([(i, "Титул", None, "Книга 1") for i in (1, 2)], "photo_id int, kind string, organization string, text string")
    found = signatures.evidence(ocr, typed, forms.roles(ocr, typed), picture(spark, {1: image, 2: np.full((900, 700, 3), 255, np.uint8)}))
    seal = {r["photo_id"]: r["seal"]["score"] for r in found.collect()}
    assert seal[1] > 0.6 and seal[2] == 0


def photographed(corners, h=1000, w=800):
    """A sheet with a cross in it, seen as a quadrilateral on a dark table."""
    flat = np.full((900, 640, 3), 235, np.uint8)
    flat[440:460, 100:540] = flat[200:700, 310:330] = 20
    ground = np.full((h, w, 3), 60, np.uint8)
    seen = pixels.warp(flat, pixels.homography(corners, np.array([(0, 0), (640, 0), (640, 900), (0, 900)], float)), w, h)
    y, x = np.mgrid[0:h, 0:w]
    inside = np.ones((h, w), bool)
    for a, b in zip(corners, np.roll(corners, -1, 0), strict=True):
        inside &= (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0
    return np.where(inside[..., None], seen, ground), flat


def test_a_slanted_sheet_is_flattened():
    corners = np.array([(90.0, 40.0), (700.0, 40.0), (740.0, 960.0), (50.0, 960.0)])
    image, _ = photographed(corners)
    found = pixels.paper_corners(image)
    assert found is not None and np.abs(found - corners).max() < 8
    flat, note = pixels.rectify(image)
    assert note == pixels.STRAIGHTENED
    dark = pixels.grey(flat) < 90
    inner = dark[20:-20, 20:-20]
    rows, columns = np.flatnonzero(inner.mean(1) > 0.5), np.flatnonzero(inner.mean(0) > 0.4)
    assert len(rows) and len(columns)  # the cross is upright again
    for strip in (inner[:, 150:200], inner[:, 450:500]):
        assert abs(np.flatnonzero(strip.mean(1) > 0.9).mean() - rows.mean()) < 2
    for strip in (inner[220:270], inner[600:650]):
        assert abs(np.flatnonzero(strip.mean(0) > 0.9).mean() - columns.mean()) < 2
    straight = np.full((1000, 800, 3), 60, np.uint8)
    straight[40:960, 80:720] = 235
    assert pixels.paper_corners(straight) is None and pixels.rectify(straight)[1] == pixels.KEPT
    noise = np.random.default_rng(1).integers(0, 255, (300, 200, 3), dtype=np.uint8)
    assert pixels.paper_corners(noise) is None
    black = np.zeros((300, 200, 3), np.uint8)
    black[50:250, 40:140] = 255
    cut = pixels.flattened(black, np.array([(40, 50), (139, 50), (139, 249), (40, 249)], float))
    assert cut.shape[:2] == (199, 99) and cut.min() > 200


def test_pictures_in_a_frame(spark, tmp_path):
    """Upright, bounded, portrait in two turns; the turn with the better reading; slopes of lines; from files with orientation tags."""
    image = np.random.default_rng(2).integers(0, 255, (60, 100, 3), dtype=np.uint8)
    got = {r["turn"]: np.frombuffer(r["image"]["data"], np.uint8).reshape(r["image"]["height"], r["image"]["width"], 3) for r in pixels.prepare_pages(picture(spark, {1: image})).collect()}
    assert (got[0] == np.rot90(image, -1)).all() and (got[180] == np.rot90(got[0], 2)).all()
    turned = spark.createDataFrame([("x", 6)], "origin string, orientation int")
    six = pixels.prepare_pages(picture(spark, {1: image}), turned).where("turn = 0").first()["image"]
    assert (np.frombuffer(six["data"], np.uint8).reshape(100, 60, 3) == np.rot90(image, -1)).all()
    read = spark.createDataFrame([(1, 0, 10), (1, 180, 30)], "photo_id int, turn int, score int")
    assert pixels.best_turns(pixels.prepare_pages(picture(spark, {1: image})), read).first()["turn"] == 180
    words = [[word(f"слово{j}", 100 + 200 * j, 300 + 100 * i + 200 * j * 0.02) for j in range(4)] for i in range(5)]
    page = (1, json.dumps({"file": "a", "text": "", "language": "ru", "width": 1000, "height": 1400, "lines": [{"text": "", "words": w} for w in words]}, ensure_ascii=False))
    ocr = frame(spark, [page])
    assert abs(pixels.line_slopes(ocr).first()["slope"] - 0.02) < 1e-9
    ruled = np.full((1400, 1000, 3), 255, np.uint8)
    line(ruled, [(100, 300), (900, 316)])
    out = pixels.rectify_pages(picture(spark, {1: ruled}), ocr).first()
    level = pixels.grey(np.frombuffer(out["image"]["data"], np.uint8).reshape(1400, 1000, 3)) < 128
    assert out["note"] == "Выровнен наклон 1.1°" and abs(np.flatnonzero(level[:, 200]).mean() - np.flatnonzero(level[:, 800]).mean()) < 2
    assert pixels.enhance_pages(picture(spark, {1: ruled})).first()["image"]["width"] == 1000
    try:
        pixels.prepare_pages(picture(spark, {1: image}).withColumn("image", F.col("image").withField("height", F.lit(1_000_000)))).collect()
        raise AssertionError("a picture over the limit")
    except Exception as e:
        assert "pixels" in str(e)


def test_empty_and_odd_pictures(spark):
    ocr = frame(spark, [signing_page(1)])
    typed = spark.createDataFrame([(1, "ИУЛ", None, "x")], "photo_id int, kind string, organization string, text string")
    grey = picture(spark, {1: np.zeros((10, 10, 1), np.uint8)})
    assert signatures.evidence(ocr, typed, forms.roles(ocr, typed), grey).count() == 0 and pixels.enhance_pages(grey).count() == 0
    kept = signatures.with_status(forms.roles(ocr, typed), signatures.evidence(ocr, typed, forms.roles(ocr, typed), grey)).collect()
    assert {r["status"] for r in kept} == {"Не определено"}
