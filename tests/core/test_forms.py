"""Roles, fragment checksums, crops, pixels, geometry, stream."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from reconspark.operators import forms, geometry, pixels
from reconspark.streaming import pages as stream

from .test_audit import H, W, frame, word


def ocr(spark, ws, text=""):
    return frame(spark, [(1, json.dumps({"file": "a", "text": text, "language": "ru", "width": W, "height": H, "lines": [{"text": text, "words": ws}]}, ensure_ascii=False))])


def test_roles_of_an_iul(spark):
    ws = [word("Главный", 100, 500), word("инженер", 200, 500), word("проекта", 100, 530), word("Иванов", 400, 505), word("Нормоконтроль", 100, 700), word("А.Б.Петров", 420, 702)]
    kinds = spark.createDataFrame([(1, "ИУЛ", "Желдорпроект", "")], "photo_id int, kind string, organization string, text string")
    got = [(r["role"], r["name"]) for r in forms.roles(ocr(spark, ws), kinds).orderBy("top").collect()]
    assert got == [("Главный инженер проекта", "ИВАНОВ"), ("Нормоконтроль", "ПЕТРОВ")]


def test_fragment_checksums(spark):
    ws = [word("Фрагмент", 300, 600), word("1", 400, 600), word("CRC32", 700, 600), word("ABC1234", 800, 602), word("Фрагмент", 300, 700), word("2", 400, 700), word("CRC32", 700, 700), word("1234ABCD", 800, 701)]
    assert forms.fragment_checksums(ocr(spark, ws)).first()["fragments"] == {1: "0ABC1234", 2: "1234ABCD"}


def test_crops_skip_stable_fields(spark):
    pages = spark.createDataFrame([(1, "ИУЛ", None, "x"), (2, "Опись", None, "x")], "photo_id int, kind string, book string, text string")
    sizes = spark.createDataFrame([(1, W, H), (2, W, H)], "photo_id int, width int, height int")
    got = forms.crop_requests(pages, sizes)
    assert {(r["photo_id"], r["field"]): r["count"] for r in got.groupBy("photo_id", "field").count().collect()} == {(1, "CRC"): 4, (1, "Footer"): 2, (1, "Roles"): 2, (2, "Inventory"): 2}
    stable = spark.createDataFrame([(1, "CRC")], "photo_id int, field string")
    assert forms.crop_requests(pages, sizes, stable).where("field = 'CRC'").count() == 0


def test_rows_as_by_a_plain_fold(spark):
    r = random.Random(4)
    ws = [(1, 0, i, f"w{i}", float(r.randrange(500)), float(r.randrange(60)), 10.0, float(r.randrange(6, 14))) for i in range(40)]
    rows = []
    for w in sorted(ws, key=lambda w: (w[5], w[4], w[3])):
        c = w[5] + w[7] / 2
        for row in rows:
            if abs(sum(v[5] + v[7] / 2 for v in row) / len(row) - c) < 0.65 * max(w[7], sum(v[7] for v in row) / len(row)):
                row.append(w)
                break
        else:
            rows.append([w])
    want = sorted(" ".join(v[3] for v in sorted(row, key=lambda v: (v[4], v[3]))) for row in rows)
    got = geometry.cluster_rows(spark.createDataFrame(ws, "id int, line_no int, word_no int, text string, x double, y double, width double, height double"), ["id"])
    assert sorted(x["text"] for x in got.collect()) == want


def test_crop_words_go_back(spark):
    df = spark.sql("select array(named_struct('text','a','x',10D,'y',10D,'width',4D,'height',4D), named_struct('text','b','x',90D,'y',90D,'width',4D,'height',4D)) ws, named_struct('x',0D,'y',0D,'w',50D,'h',50D) b, array(named_struct('text','A','x',20D,'y',24D,'width',8D,'height',8D)) r")
    got = df.select(geometry.merge_crop(F.col("ws"), F.col("b"), F.col("r"), F.lit(2.0)).alias("m")).first()["m"]
    assert [(w["text"], w["x"], w["y"]) for w in got] == [("A", 10.0, 12.0), ("b", 90.0, 90.0)]


def test_paper_becomes_white_and_ink_stays():
    image = np.full((200, 300, 3), 180, np.uint8)
    image[:, :, :] = np.linspace(165, 200, 300, dtype=np.uint8)[None, :, None]
    image[90:100, 50:250] = 30
    out = pixels.enhance(image)
    assert out[20, 20].min() > 225 and out[20, 280].min() > 225 and out[95, 150].max() < 60


def test_a_ring_is_found_and_a_line_is_not():
    image = np.full((900, 700, 3), 255, np.uint8)
    y, x = np.mgrid[0:900, 0:700]
    ring = np.abs(np.hypot(x - 350, y - 740) - 80) < 4
    assert pixels.seal(image)[1] == 0
    image[ring] = (160, 40, 30)
    status, score, cx, cy, radius = pixels.seal(image)
    assert status == pixels.SEAL_STATUS[0] and abs(cx - 350) < 12 and abs(cy - 740) < 12 and abs(radius - 80) < 8
    line = np.full((900, 700, 3), 255, np.uint8)
    line[740:744] = 0
    assert pixels.seal(line)[0] == pixels.SEAL_STATUS[2]


def test_identity_warp():
    image = np.random.default_rng(1).integers(0, 255, (20, 30, 3), dtype=np.uint8)
    assert (pixels.warp(image, np.eye(3), 30, 20) == image).all()


def test_pages_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"file": "a", "text": "123-45-6789-ИЛО4.1.1 CRC32: ABCD1234", "width": 1, "height": 1, "lines": []}, ensure_ascii=False))
    stream.run(stream.read_pages(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    r = spark.read.parquet(f"{tmp_path}/out").first()
    assert (r["code"], r["crc"], r["iul"]) == ("123-45-6789-ИЛО4.1.1", "ABCD1234", True)
