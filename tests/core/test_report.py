"""The HTML report, and pictures turned upright."""

import struct

import numpy as np

from reconspark.operators import pixels
from reconspark.sources import report


def test_report_is_ordered_and_escaped(spark, tmp_path):
    f = spark.createDataFrame([("Проверить", "B", "t", "<b>", [1, 2]), ("Расхождение", "C", "u", "d", [3])], "level string, code string, topic string, detail string, photos array<int>")
    inv = spark.createDataFrame([("K-1", 22)], "code string, box int")
    report.write_html(f"{tmp_path}/r", f, inv, spark.createDataFrame([(2,)], "images int"))
    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(f"{tmp_path}/r").collect())
    assert text.startswith("<!DOCTYPE html>") and text.rstrip().endswith("</html>")
    assert text.index("Расхождение") < text.index("Проверить") and "&lt;b&gt;" in text and "<td>1, 2</td>" in text and text.index("Итоги") < text.index("Замечания") < text.index("Опись")


def jpeg(orientation, order="<"):
    tag = b"II*\0" if order == "<" else b"MM\0*"
    entry = struct.pack(f"{order}HHIHH", 0x0112, 3, 1, orientation, 0)
    tiff = tag + struct.pack(f"{order}IH", 8, 1) + entry + bytes(4)
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"


def test_orientation_is_read_and_applied():
    assert [pixels.exif_orientation(jpeg(k, o)) for k in (1, 3, 6, 8) for o in "<>"] == [1, 1, 3, 3, 6, 6, 8, 8]
    assert pixels.exif_orientation(b"\xff\xd8\xff\xda") == 1 and pixels.exif_orientation(b"PNG") == 1
    image = np.zeros((2, 3, 3), np.uint8)
    image[0, 0] = 255
    assert pixels.oriented(image, 3)[1, 2, 0] == 255 and pixels.oriented(image, 6)[0, 1, 0] == 255 and pixels.oriented(image, 8)[2, 0, 0] == 255


def test_prepared_is_portrait_and_bounded():
    a, b = pixels.prepared(np.random.default_rng(0).integers(0, 255, (300, 4400, 3), dtype=np.uint8))
    assert a.shape == (2200, 150, 3) and (np.rot90(b, 2) == a).all()
