"""Finished checks and hand labels read back, chief engineers and checksums by place."""

import json

import pytest

from reconspark.operators import pages
from reconspark.plans import audit
from reconspark.sources import files
from tests.core.test_audit import H, TITLE, W, frame, iul, page, topics, word


def finished(folder, photos, drop=(), **ocr):
    """A folder of a finished check, without the files in drop."""
    assets = folder / "assets"
    assets.mkdir(parents=True)
    (folder / "Результаты.json").write_text(json.dumps({"Photos": photos}, ensure_ascii=False), encoding="utf-8")
    for p in photos or []:
        stem = f"p{p['Id']:04d}"
        body = {"file": "a", "text": "текст", "language": "ru", "width": 10, "height": 20, "lines": []} | ocr
        for name, content in ((f"{stem}.jpg", "x"), (f"{stem}.json", json.dumps(body, ensure_ascii=False))):
            if name not in drop:
                (assets / name).write_text(content, encoding="utf-8")
    return str(folder)


def test_a_finished_check_is_read(spark, tmp_path):
    root = finished(tmp_path / "a", [{"Id": 2, "ImageFile": ""}, {"Id": 1, "ImageFile": "P0001.jpg"}])
    (tmp_path / "a/assets/p0002-processed.jpg").write_text("x")
    got = {r["photo_id"]: r for r in files.read_prior(spark, root).collect()}
    assert {k: r["image_file"] for k, r in got.items()} == {1: "P0001.jpg", 2: "p0002-processed.jpg"}
    assert got[1]["text"] == "текст" and got[2]["height"] == 20


@pytest.mark.parametrize(
    ("photos", "drop", "ocr"),
    [
        (None, (), {}),
        ([], (), {}),
        ([{"Id": 1}, {"Id": 1}], (), {}),
        ([{"Id": 1001}], (), {}),
        ([{"Id": 1, "ImageFile": "p0002.jpg"}], (), {}),
        ([{"Id": 1}], ("p0001.jpg",), {}),
        ([{"Id": 1}, {"Id": 2}], ("p0002.json",), {}),
        ([{"Id": 1}], (), {"width": 0}),
        ([{"Id": 1}], (), {"lines": None}),
    ],
)
def test_a_damaged_check_is_an_error(spark, tmp_path, photos, drop, ocr):
    with pytest.raises(Exception, match="saved pages|page id|page [0-9]+: "):
        files.read_prior(spark, finished(tmp_path / "a", photos, drop, **ocr)).collect()


def test_hand_labels_are_read(spark, tmp_path):
    gold = {"Name": "a", "KnownFindings": [{"Code": "A", "Topics": ["t", "u"], "Photo": 3}, {"Topic": "t"}], "Fields": [{"Photo": "1", "Field": "CRC", "Value": None}, {"Photo": 2, "Field": "Page", "Value": 4}]}
    (tmp_path / "gold.json").write_text(json.dumps(gold), encoding="utf-8")
    known, negative, expected = files.read_gold(spark, str(tmp_path / "gold.json"))
    assert sorted(known.collect()) == [(0, "A", None, ["t", "u"], 3), (1, None, "t", None, None)]
    assert negative.count() == 0 and sorted(expected.collect()) == [(1, "CRC", ""), (2, "Page", "4")]


def role(y, name, x, last="инженер"):
    return [word("Главный", 60, y), word(last, 160, y), word(name, x, y + 5)]


def more(row, *words, text=""):
    o = json.loads(row[1])
    o["text"] += text
    o["lines"].append({"text": "x", "words": list(words)})
    return row[0], json.dumps(o, ensure_ascii=False)


def test_chief_engineers_differ(spark):
    owner = word("Ленгипротранс", 500, 50)
    title = more(page(1, TITLE), owner, *role(H * 0.8, "Петров", W * 0.7))
    sheet = more(page(2, iul("Шумозащитные экраны")), owner, *role(H * 0.5, "Сидоренко", W * 0.4))
    t = audit.audit(frame(spark, [title, sheet]))
    assert {r["photo_id"]: r["chief"] for r in t.pages.collect()} == {1: "ПЕТРОВ", 2: "СИДОРЕНКО"}
    assert topics(t)["Главный инженер: титул / ИУЛ"]["photos"] == [1, 2]


def test_which_words_make_a_chief(spark):
    high, project, short = role(H * 0.5, "Петров", W * 0.7), [*role(H * 0.7, "Петров", W * 0.7), word("проекта", 200, H * 0.7 + 30)], role(H * 0.7, "Лис", W * 0.7)
    second = [*short, *role(H * 0.8, "Орлов", W * 0.7), *role(H * 0.9, "Петров", W * 0.7)]
    rows = [more(page(i, TITLE), *ws) for i, ws in enumerate([high, project, short, second, []], 1)]
    typed = spark.createDataFrame([(i, "Титул") for i in range(1, 6)], "photo_id int, kind string")
    assert [tuple(r) for r in pages.chiefs(frame(spark, rows), typed).collect()] == [(4, "ОРЛОВ")]


def test_checksum_below_its_label(spark):
    label, value = word("СРС32", 600, 900), word("АВ12СD34:", 610, 940)
    blank = "Информационно-удостоверяющий лист\n123-45-6789-ИЛОЗ.7.1"
    rows = [more(page(1, blank), label, value), more(page(2, blank), label, word("АВ12СD34", 610, 990)), more(page(3, blank), value), more(page(4, blank), label, value, text="\nCRC32 нет")]
    got = {r["photo_id"]: r["crc"] for r in audit.audit(frame(spark, rows)).pages.collect()}
    assert got == {1: "AB12CD34", 2: None, 3: None, 4: None}
