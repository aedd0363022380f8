"""Evidence of signatures and seals: strokes in the cells of signing rows, after printed words and ruled lines are taken out.

A picture is one row; a page's words and signing rows travel with it as short arrays, and what comes back is a status for each row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconspark.operators import fields, pixels
from reconspark.schemas import IUL

# Statuses, thresholds of grey and of shares, sizes of strokes in pixels of a picture of at most LONGEST.
COLOURED, BLACK, EMPTY, UNCLEAR, CUT_OFF = "Найдены цветные рукописные штрихи", "Найдены чёрные рукописные штрихи", "Ячейка выглядит пустой", "Недостаточно признаков подписи", "Область обрезана"
LONGEST, LEAST_SIDE, PRINTED, MARGIN = 1400, 8, re.compile("[А-Яа-я0-9]{2}"), 2
RULE, CELL_RULE, ROW_SHARE, COLUMN_SHARE = 115, 120, 0.70, 0.75
PAPER_SHARE, PAPER_STEP, INK, BELOW_PAPER = 0.85, 5, 150, 45
SEAL_SURE, SEAL_REACH = 0.52, 1.07
STROKE, STROKE_WIDTH, STROKE_HEIGHT, STROKE_RATIO = 6, 4, 3, 30
HAND, HAND_WIDTH, HAND_HEIGHT, HAND_LEAST, HAND_RATIO = 30, 0.10, 0.12, 6, 18
LEAST_BLUE, LEAST_INK = 20, 8
CELL_UP, CELL_DOWN, CELL_NEAR, CELL_TALL, CELL_LOW, PAGE_SHARE, SIDE_SHARE = 30, 40, 15, 25, 25, 0.50, 0.55
SIDES_FROM, SIDES_TO, LEFT_TO, CELL_WIDE, INSET = 0.43, 0.93, 0.68, 0.12, 3


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """(number of its component for each pixel of the mask, -1 outside; how many). Pixels that share a side are connected.

    Runs of neighbouring pixels in a row are the elements; union-find joins those of neighbouring rows that overlap.
    """
    padded = np.pad(mask, ((0, 0), (1, 1))).astype(np.int8)
    change = np.diff(padded, axis=1)
    row, start = np.nonzero(change == 1)
    end = np.nonzero(change == -1)[1]  # as many, in the same order
    parent = list(range(len(row)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] < end[j] and start[j] < end[i]:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    roots, number = np.unique([find(i) for i in range(len(row))], return_inverse=True)
    out = np.full(mask.shape, -1, np.int64)
    out[mask] = np.repeat(number, end - start)
    return out, len(roots)


def paper(grey: np.ndarray) -> int:
    """The level that PAPER_SHARE of every fifth pixel stays below."""
    levels = np.sort(grey[::PAPER_STEP, ::PAPER_STEP], axis=None)
    return int(levels[min(len(levels) - 1, int(len(levels) * PAPER_SHARE))])


def cell(dark: np.ndarray, box: tuple[int, int, int, int]) -> tuple[tuple[int, int, int, int], bool]:
    """(box of the table cell around a signing row, whether rules were found). box: left, top, right, bottom; dark: rules of the page."""
    h, w = dark.shape
    left, top, right, bottom = box
    ys = np.arange(max(0, top - CELL_UP), min(h, bottom + CELL_DOWN))
    ys = ys[dark[ys, 5 : w - 5].mean(1) > PAGE_SHARE]
    high, low = ys[ys <= top + CELL_NEAR], None
    y0 = int(high.max()) if len(high) else top
    low = ys[(ys > y0 + CELL_TALL) & (ys >= bottom - CELL_LOW)]
    y1 = int(low.min()) if len(low) else bottom
    xs = np.arange(int(w * SIDES_FROM), int(w * SIDES_TO))
    strip = dark[max(0, y0 + 3) : max(0, min(h, y1 - 3))]
    xs = xs[strip[:, xs].mean(0) > SIDE_SHARE] if len(strip) else xs[:0]
    near = xs[xs < w * LEFT_TO]
    x0 = int(near.max()) if len(near) else left
    far = xs[xs > x0 + w * CELL_WIDE]
    x1 = int(far.min()) if len(far) else right
    return (max(0, x0 + INSET), max(0, y0 + INSET), min(w, x1 - INSET), min(h, y1 - INSET)), bool(len(ys) and len(xs))


def strokes(image: np.ndarray, box: tuple[int, int, int, int], printed: list[tuple[int, int, int, int]], seal: tuple[float, int, int, int] | None = None) -> tuple[str, int, int]:
    """(status, blue pixels, black pixels) of the strokes in a box of a picture.

    Blue ink counts wherever it is; black ink not on printed words (their boxes), nor on lines that run nearly through the box. On titles
    the disc of a sure seal (score, x, y, radius) is left out. Specks, dots and long thin lines are no strokes.
    """
    left, top, right, bottom = box
    part = image[top:bottom, left:right]
    h, w = part.shape[:2]
    if h < LEAST_SIDE or w < LEAST_SIDE:
        return CUT_OFF, 0, 0
    grey, blue = pixels.grey(part), pixels.blue(part)
    black = (grey < min(INK, paper(grey) - BELOW_PAPER)) & ~blue
    rule = (grey < RULE) & ~blue
    black[rule.mean(1) > ROW_SHARE] = False
    black[:, rule.mean(0) > COLUMN_SHARE] = False
    for x0, y0, x1, y1 in printed:
        black[max(0, y0 - top) : max(0, y1 - top), max(0, x0 - left) : max(0, x1 - left)] = False
    ink = blue | black
    if seal and seal[0] > SEAL_SURE:
        y, x = np.mgrid[top:bottom, left:right]
        ink &= np.hypot(x - seal[1], y - seal[2]) >= seal[3] * SEAL_REACH
    ink[[0, -1]] = False
    ink[:, [0, -1]] = False
    number, many = components(ink)
    y, x = np.nonzero(ink)
    own = number[y, x]
    size, coloured = np.bincount(own, minlength=many), np.bincount(own, weights=blue[y, x], minlength=many).astype(np.int64)
    extent = lambda v: np.array([np.full(many, 1 << 30), np.full(many, -1)])
    bounds = []
    for v in (x, y):
        low, high = extent(v)
        np.minimum.at(low, own, v)
        np.maximum.at(high, own, v)
        bounds.append(high - low + 1)
    wide, tall = bounds
    fits = (size >= STROKE) & (wide >= STROKE_WIDTH) & (tall >= STROKE_HEIGHT) & (wide <= tall * STROKE_RATIO)
    hand = fits & (size - coloured >= HAND) & (wide > w * HAND_WIDTH) & (tall > max(HAND_LEAST, h * HAND_HEIGHT)) & (wide < tall * HAND_RATIO)
    blues, blacks = int(coloured[fits].sum()), int((size - coloured)[fits].sum())
    return COLOURED if blues >= LEAST_BLUE else BLACK if hand.any() else EMPTY if blues + blacks < LEAST_INK else UNCLEAR, blues, blacks


EVIDENCE = "photo_id int, seal struct<status:string,score:double>, rows array<struct<top:double,status:string,blue:int,black:int,table_cell:boolean>>"


def evidence(ocr: DataFrame, typed: DataFrame, roles: DataFrame, images: DataFrame) -> DataFrame:
    """photo_id, seal (of titles), rows: what the picture of each page shows of its signing rows (forms.roles, by top).

    typed: photo_id, kind; images: photo_id and image as of Spark's image source. Pages without a picture of three channels give no row.
    """
    words = fields.page_words(ocr).groupBy("photo_id").agg(F.collect_list(F.when(F.char_length("text") >= 2, F.struct("text", "x", "y", "bw", "bh"))).alias("words"))
    signed = roles.groupBy("photo_id").agg(F.collect_list(F.struct("top", "bounds.x", "bounds.y", "bounds.w", "bounds.h")).alias("rows"))
    title = F.col("kind").startswith("Титул")
    scans = images.select("photo_id", "image.height", "image.width", "image.nChannels", "image.data").where("nChannels >= 3 and height > 0 and width > 0")
    pages = typed.select("photo_id", (F.col("kind") == IUL).alias("sheet"), title.alias("title")).join(ocr.select("photo_id", F.col("width").alias("w")), "photo_id").join(signed, "photo_id", "left").where("rows is not null or title")
    met = scans.join(pages, "photo_id").join(words, "photo_id", "left").select("photo_id", "height", "width", "nChannels", "data", "sheet", "title", "w", "rows", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                photo, tall, wide, channels, data, sheet, title, page_wide, rows, words = (c[at].as_py() for c in b.columns)
                image = pixels.resized(np.frombuffer(data, np.uint8).reshape(tall, wide, channels)[..., :3], LONGEST)
                k, found = image.shape[1] / page_wide, pixels.seal(image) if title else None
                boxed = lambda x, y, w, h, m=0, k=k: (round(x * k - m), round(y * k - m), round((x + w) * k + m), round((y + h) * k + m))
                printed = [boxed(v["x"], v["y"], v["bw"], v["bh"], MARGIN) for v in words or [] if v and PRINTED.search(v["text"])]
                dark = (pixels.grey(image) < CELL_RULE) & ~pixels.blue(image) if sheet else None
                out = []
                for r in sorted(rows or [], key=lambda r: r["top"]):
                    x0, y0, x1, y1 = boxed(r["x"], r["y"], r["w"], r["h"])
                    box, located = (max(0, x0), max(0, y0), min(image.shape[1], x1), min(image.shape[0], y1)), False
                    if sheet and box[2] - box[0] >= LEAST_SIDE and box[3] - box[1] >= LEAST_SIDE:
                        box, located = cell(dark, box)
                    status, blue, black = strokes(image, box, printed, found[1:] if found else None)
                    out.append({"top": r["top"], "status": status, "blue": blue, "black": black, "table_cell": located})
                seal = {"status": found[0], "score": found[1]} if found else None
                kinds = (pa.int32(), pa.struct([("status", pa.string()), ("score", pa.float64())]), pa.list_(pa.struct([("top", pa.float64()), ("status", pa.string()), ("blue", pa.int32()), ("black", pa.int32()), ("table_cell", pa.bool_())])))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((photo, seal, out), kinds, strict=True)], names=["photo_id", "seal", "rows"])

    return met.mapInArrow(run, EVIDENCE)


def with_status(roles: DataFrame, found: DataFrame) -> DataFrame:
    """roles with the status that evidence gives their rows; rows of pages without a picture keep theirs."""
    seen = found.select("photo_id", F.inline("rows")).select("photo_id", "top", F.col("status").alias("__status"))
    return roles.join(seen, ["photo_id", "top"], "left").withColumn("status", F.coalesce("__status", "status")).select(*roles.columns)
