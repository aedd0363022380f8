"""Raster operators over Spark's image source (three channels, blue first), a picture a row, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Weights of grey, tiles and thresholds of illumination and seals.
GREY = np.array([29, 150, 77])
BLUE_OVER_RED, BLUE_OVER_GREEN, LEAST_BLUE = 12, 6, 55
TILE, STRIDE, PAPER_SHARE, LEAST_PAPER = 96, 3, 0.90, 60
POINTS, QUARTER = 48, 12
FOUND, PERHAPS = 0.60, 0.45
SEAL_STATUS = ("Найден круговой контур печати", "Возможна круглая печать; требуется просмотр", "Круглая печать не подтверждена")


def grey(image: np.ndarray) -> np.ndarray:
    return (image.astype(np.int64) @ GREY) >> 8


def blue(image: np.ndarray) -> np.ndarray:
    """Ink that is more blue than red and green, and not black."""
    b, g, r = (image[..., i].astype(np.int64) for i in range(3))
    return (b > r + BLUE_OVER_RED) & (b > g + BLUE_OVER_GREEN) & (b > LEAST_BLUE)


def enhance(image: np.ndarray, colour: bool = True) -> np.ndarray:
    """Evens out illumination: the paper's level of each tile, interpolated, becomes white; light shadows fade, ink deepens."""
    h, w, _ = image.shape
    ny, nx = -(-h // TILE), -(-w // TILE)
    paper = np.empty((ny, nx, 3))
    for y in range(ny):
        for x in range(nx):
            cell = image[y * TILE : (y + 1) * TILE : STRIDE, x * TILE : (x + 1) * TILE : STRIDE].reshape(-1, 3)
            rank = max(0, int(np.ceil(len(cell) * PAPER_SHARE)) - 1)
            paper[y, x] = np.maximum(LEAST_PAPER, np.sort(cell, axis=0)[rank])
    at = lambda size, n: np.clip(np.arange(size) / TILE - 0.5, 0, n - 1)
    py, px = at(h, ny), at(w, nx)
    y0, x0 = py.astype(int), px.astype(int)
    y1, x1 = np.minimum(ny - 1, y0 + 1), np.minimum(nx - 1, x0 + 1)
    fy, fx = (py - y0)[:, None, None], (px - x0)[None, :, None]
    rows = (1 - fy) * paper[y0] + fy * paper[y1]
    level = rows[:, x0] + (rows[:, x1] - rows[:, x0]) * fx
    deficit = np.maximum(0, 255 * (level - image) / level - 3)
    ink = np.where(deficit <= 10, deficit**2 / 10, 10 + (deficit - 10) * 2.1)
    out = np.clip(np.rint(255 - ink), 0, 255).astype(np.uint8)
    return out if colour else np.repeat(grey(out)[..., None], 3, 2).astype(np.uint8)


def ring_scores(mask: np.ndarray, cx: np.ndarray, cy: np.ndarray, radius: np.ndarray, tolerance: int) -> np.ndarray:
    """The share of 48 directions in which ink lies on each circle, or 0 if a quarter of it has fewer than three."""
    angle = np.arange(POINTS) * np.pi / (POINTS / 2)
    hit = np.zeros((len(cx), POINTS), bool)
    for d in range(-tolerance, tolerance + 1):
        x = (cx[:, None] + np.cos(angle) * (radius[:, None] + d)).astype(int)
        y = (cy[:, None] + np.sin(angle) * (radius[:, None] + d)).astype(int)
        inside = (x >= 0) & (y >= 0) & (x < mask.shape[1]) & (y < mask.shape[0])
        hit |= inside & mask[np.where(inside, y, 0), np.where(inside, x, 0)]
    quarters = hit.reshape(len(cx), 4, QUARTER).sum(2)
    return np.where(quarters.min(1) < 3, 0.0, hit.sum(1) / POINTS)


def seal(image: np.ndarray) -> tuple[str, float, int, int, int]:
    """(status, score, x, y, radius) of the best circle in the lower part: six coarse candidates, each refined."""
    h, w, _ = image.shape
    step, least, most = max(10, w // 80), max(20, w // 25), w // 5
    mask = blue(image) | (grey(image) < 95)
    mask[: int(h * 0.58)] = False
    cy, cx, r = (a.ravel() for a in np.meshgrid(np.arange(int(h * 0.68), h - least, step), np.arange(least, w - least, step), np.arange(least, most + 1, max(6, step // 2)), indexing="ij"))
    whole = (cx - r >= 0) & (cx + r < w) & (cy - r >= 0) & (cy + r < h)
    cx, cy, r = cx[whole], cy[whole], r[whole]
    if not len(cx):
        return SEAL_STATUS[2], 0.0, 0, 0, 0
    coarse = ring_scores(mask, cx, cy, r, step // 2 + 2)
    best = (0.0, 0, 0, 0)
    for i in np.argsort(-coarse, kind="stable")[:6]:
        if coarse[i] < 0.35:
            break
        dy, dx, dr = (a.ravel() for a in np.meshgrid(np.arange(-step, step + 1, 2), np.arange(-step, step + 1, 2), np.arange(-(step // 2), step // 2 + 1, 2), indexing="ij"))
        fine = ring_scores(mask, cx[i] + dx, cy[i] + dy, r[i] + dr, 3)
        k = int(fine.argmax())
        best = max(best, (float(fine[k]), int(cx[i] + dx[k]), int(cy[i] + dy[k]), int(r[i] + dr[k])), key=lambda b: b[0])
    status = SEAL_STATUS[0 if best[0] > FOUND else 1 if best[0] > PERHAPS else 2]
    return status, *best


def warp(image: np.ndarray, matrix: np.ndarray, width: int, height: int) -> np.ndarray:
    """Projective transform: matrix takes target to source coordinates; bilinear, white outside."""
    y, x = np.mgrid[0:height, 0:width]
    u, v, t = np.einsum("ij,jyx->iyx", matrix, np.stack([x, y, np.ones_like(x)]).astype(float))
    u, v = u / t, v / t
    inside = (u >= 0) & (v >= 0) & (u <= image.shape[1] - 1) & (v <= image.shape[0] - 1)
    u, v = np.where(inside, u, 0), np.where(inside, v, 0)
    x0, y0 = u.astype(int), v.astype(int)
    x1, y1 = np.minimum(x0 + 1, image.shape[1] - 1), np.minimum(y0 + 1, image.shape[0] - 1)
    fx, fy = (u - x0)[..., None], (v - y0)[..., None]
    top, low = image[y0, x0] * (1 - fx) + image[y0, x1] * fx, image[y1, x0] * (1 - fx) + image[y1, x1] * fx
    return np.where(inside[..., None], np.rint(top * (1 - fy) + low * fy), 255).astype(np.uint8)


def ink(image: np.ndarray) -> tuple[int, int]:
    """(blue, dark) pixels of a signing cell, ruled lines left out."""
    g, b = grey(image), blue(image)
    dark = (g < np.minimum(150, np.percentile(g, 85, method="lower") - 45)) & ~b
    ruled = (g < 115) & ~b
    dark[ruled.mean(1) > 0.70] = False
    dark[:, ruled.mean(0) > 0.75] = False
    return int(b.sum()), int(dark.sum())


def seals(images: DataFrame) -> DataFrame:
    """images of Spark's image source -> origin, status, score, x, y, radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for origin, h, w, c, data in zip(*(col.to_pylist() for col in b.columns), strict=True):
                rows.append((origin, *seal(np.frombuffer(data, np.uint8).reshape(h, w, c)[..., :3])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()], strict=True)], names=["origin", "status", "score", "x", "y", "radius"])

    return images.select(F.col("image.origin"), "image.height", "image.width", "image.nChannels", "image.data").where("nChannels >= 3").mapInArrow(run, "origin string, status string, score double, x int, y int, radius int")


LONGEST_SIDE = 2200


def exif_orientation(data: bytes) -> int:
    """The orientation tag of a JPEG file, 1 where there is none."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            tiff = data[at + 10 : at + 2 + size]
            order = "little" if tiff[:2] == b"II" else "big"
            first = int.from_bytes(tiff[4:8], order)
            for k in range(int.from_bytes(tiff[first : first + 2], order)):
                entry = tiff[first + 2 + 12 * k : first + 14 + 12 * k]
                if int.from_bytes(entry[:2], order) == 0x0112:
                    return int.from_bytes(entry[8:10], order)
            return 1
        if marker == 0xDA:
            break
        at += 2 + size
    return 1


def oriented(image: np.ndarray, orientation: int) -> np.ndarray:
    return np.rot90(image, {3: 2, 6: -1, 8: 1}.get(orientation, 0))


def resized(image: np.ndarray, longest: int = LONGEST_SIDE) -> np.ndarray:
    """At most `longest` on its longer side, bilinear; smaller pictures stay."""
    h, w, _ = image.shape
    scale = min(1.0, longest / max(h, w))
    if scale == 1.0:
        return image
    width, height = max(1, int(w * scale)), max(1, int(h * scale))
    return warp(image, np.array([[(w - 1) / max(1, width - 1), 0, 0], [0, (h - 1) / max(1, height - 1), 0], [0, 0, 1]]), width, height)


def prepared(image: np.ndarray, orientation: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Upright, bounded and in portrait: as it is and turned by 180 degrees, for the two readings of a page."""
    out = resized(oriented(image, orientation))
    out = np.rot90(out, -1) if out.shape[1] > out.shape[0] else out
    return out, np.rot90(out, 2)


def orientations(files: DataFrame) -> DataFrame:
    """files of the binaryFile source -> origin, orientation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([exif_orientation(c.as_py()) for c in b.column(1)], pa.int32())], names=["origin", "orientation"])

    return files.select("path", "content").mapInArrow(run, "origin string, orientation int")


# Fixed values of rectification: the picture that edges are sought in, paper's grey, gaps in a row, shares of width and height, degrees.
EDGE_SIDE, EDGE_STEP, PAPER_GREY, GAP, WIDE, ROWS, TALL, ENDS, CROOKED, SLANTED, GROWN = 800, 4, 145, 19, 0.70, 30, 0.65, 0.08, 0.025, 0.025, 3
LINES, LINE_WIDTH, STEEPEST, LEAST_ANGLE, MOST_ANGLE = 4, 0.25, 0.10, 0.35, 5.0
KEPT, STRAIGHTENED, TURNED = "Геометрия сохранена", "Выровнена перспектива границ листа", "Выровнен наклон {:.1f}°"


def bright_span(row: np.ndarray) -> tuple[int, int]:
    """(first, last) pixel of the widest stretch of a row of a mask that no gap of GAP pixels and more interrupts."""
    at = np.flatnonzero(row)
    if not len(at):
        return 0, 0
    parts = np.split(at, np.flatnonzero(np.diff(at) > GAP) + 1)
    best = max(parts, key=lambda p: p[-1] - p[0])
    return int(best[0]), int(best[-1])


def edge(y: np.ndarray, x: np.ndarray) -> tuple[float, float, float]:
    """Least squares x = a + b y: (a, b, mean distance)."""
    b, a = np.polyfit(y, x, 1) if len(np.unique(y)) > 1 else (0.0, float(x.mean()))
    return float(a), float(b), float(np.abs(x - a - b * y).mean())


def paper_corners(image: np.ndarray) -> np.ndarray | None:
    """Corners of a sheet on a darker ground (left top, right top, right bottom, left bottom), or None.

    None where too few rows are wide and bright, edges are crooked, they hardly slant, or the sheet leaves the picture at one side.
    """
    small = resized(image, EDGE_SIDE)
    h, w, _ = small.shape
    spans = np.array([(y, *bright_span(row)) for y, row in zip(range(0, h, EDGE_STEP), grey(small[::EDGE_STEP]) > PAPER_GREY, strict=True)]).reshape(-1, 3)
    spans = spans[spans[:, 2] - spans[:, 1] > w * WIDE]
    if len(spans) < ROWS or spans[-1, 0] - spans[0, 0] < h * TALL:
        return None
    top, bottom = int(spans[0, 0]), int(spans[-1, 0])
    inner = spans[(spans[:, 0] > top + (bottom - top) * ENDS) & (spans[:, 0] < bottom - (bottom - top) * ENDS)]
    left, right = edge(inner[:, 0], inner[:, 1]), edge(inner[:, 0], inner[:, 2])
    if max(left[2], right[2]) > w * CROOKED:
        return None
    x0, x1 = (max(0.0, left[0] + left[1] * y - GROWN) for y in (top, bottom))
    x2, x3 = (min(w - 1.0, right[0] + right[1] * y + GROWN) for y in (top, bottom))
    if abs(x0 - x1) + abs(x2 - x3) < w * SLANTED or (x0 < 2 and x1 < 2) or (x2 > w - 3 and x3 > w - 3):
        return None
    return np.array([(x0, top), (x2, top), (x3, bottom), (x1, bottom)]) * (image.shape[1] / w)


def homography(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """The projective matrix that takes four target points to four source points."""
    rows, right = [], []
    for (x, y), (u, v) in zip(target, source, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0).reshape(3, 3)


def flattened(image: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """The quadrilateral of a picture as a rectangle whose sides are the longer of the opposite ones."""
    side = lambda a, b: float(np.hypot(*(corners[a] - corners[b])))
    width, height = max(1, int(max(side(0, 1), side(3, 2)))), max(1, int(max(side(0, 3), side(1, 2))))
    return warp(image, homography(np.array([(0, 0), (width, 0), (width, height), (0, height)], float), corners), width, height)


def turned(image: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about its middle against the slope of its lines; the size stays."""
    h, w, _ = image.shape
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    x, y = (w - 1) / 2, (h - 1) / 2
    return warp(image, np.array([[c, -s, x - c * x + s * y], [s, c, y - s * x - c * y], [0, 0, 1]]), w, h)


def rectify(image: np.ndarray, slope: float | None = None) -> tuple[np.ndarray, str]:
    """(picture, note): with the sheet's perspective undone, or else turned by the slope of its lines, or as it is."""
    corners = paper_corners(image)
    if corners is not None:
        return flattened(image, corners), STRAIGHTENED
    degrees = float(np.degrees(np.arctan(slope))) if slope is not None else 0.0
    if LEAST_ANGLE <= abs(degrees) <= MOST_ANGLE:
        return turned(image, degrees), TURNED.format(degrees)
    return image, KEPT


def line_slopes(ocr: DataFrame) -> DataFrame:
    """photo_id, slope: the upper median slope of the page's wide lines, where there are LINES at least."""
    words = F.filter("line.words", lambda v: F.char_length(v["text"]) > 2)
    ends = ocr.select("photo_id", "width", F.explode("lines").alias("line")).select("photo_id", "width", F.array_sort(F.transform(words, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))).alias("v")).where(F.size("v") >= 3)
    ends = ends.select("photo_id", "width", F.get("v", F.lit(0)).alias("a"), F.element_at("v", -1).alias("b")).where(F.col("b.x") - F.col("a.x") >= F.greatest(F.col("width") * LINE_WIDTH, F.lit(1e-9)))
    slope = (F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x"))
    page = ends.where(F.abs(slope) < STEEPEST).groupBy("photo_id").agg(F.array_sort(F.collect_list(slope)).alias("s")).where(F.size("s") >= LINES)
    return page.select("photo_id", F.get("s", (F.size("s") / 2).cast("int")).alias("slope"))


PREPARED = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
MOST_PIXELS = 45_000_000


def _pictures(images: DataFrame, extra: list[str], change, names: list[tuple[str, str]]) -> DataFrame:
    """images(photo_id, image, extra...) -> photo_id, image, names: change(picture, extras) yields (picture, values...).

    A picture of more than MOST_PIXELS is an error; those of fewer than three channels are left out.
    """
    fields_ = ["photo_id", "image.origin", "image.height", "image.width", "image.nChannels", "image.data"]
    size = F.col("image.height").cast("long") * F.col("image.width")
    checked = images.where((F.col("image.nChannels") >= 3) & F.assert_true(size <= MOST_PIXELS, F.lit(f"a picture has more than {MOST_PIXELS} pixels")).isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                photo, origin, h, w, c, data, *more = (column[at].as_py() for column in b.columns)
                for picture, *values in change(np.frombuffer(data, np.uint8).reshape(h, w, c)[..., :3], *more):
                    image = {"origin": origin, "height": picture.shape[0], "width": picture.shape[1], "nChannels": 3, "mode": 16, "data": np.ascontiguousarray(picture).tobytes()}
                    kind = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])
                    yield pa.RecordBatch.from_arrays([pa.array([photo], pa.int32()), pa.array([image], kind), *(pa.array([v]) for v in values)], names=["photo_id", "image", *(n for n, _ in names)])

    return checked.select(*fields_, *extra).mapInArrow(run, f"photo_id int, image {PREPARED}" + "".join(f", {n} {t}" for n, t in names))


def prepare_pages(images: DataFrame, orientation: DataFrame | None = None) -> DataFrame:
    """photo_id, image, turn: each picture upright, of at most LONGEST_SIDE and in portrait (turn 0), and turned by 180 degrees (turn 180).

    images: photo_id, image as of Spark's image source. orientation: origin, orientation (orientations); without it pictures are upright.
    """
    tagged = images.withColumn("__o", F.lit(1)) if orientation is None else images.join(orientation.withColumnsRenamed({"origin": "__origin", "orientation": "__o"}), F.col("image.origin") == F.col("__origin"), "left").withColumn("__o", F.coalesce("__o", F.lit(1)))

    def change(picture: np.ndarray, o: int):
        yield from zip(prepared(picture, o), (np.int32(0), np.int32(180)), strict=True)

    return _pictures(tagged, ["__o"], change, [("turn", "int")])


def best_turns(prepared_: DataFrame, read: DataFrame, score: str = "score") -> DataFrame:
    """Of the two turns of a page the one whose reading scores more, of equal ones the first. read: photo_id, turn, score."""
    best = read.groupBy("photo_id").agg(F.max_by("turn", F.struct(F.col(score), -F.col("turn"))).alias("turn"))
    return prepared_.join(best, ["photo_id", "turn"], "left_semi")


def rectify_pages(images: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """photo_id, image, note: sheets with their perspective undone, else turned by the slope that the page's lines show."""
    tagged = images.withColumn("__s", F.lit(None).cast("double")) if ocr is None else images.join(line_slopes(ocr).withColumnRenamed("slope", "__s"), "photo_id", "left")
    return _pictures(tagged, ["__s"], lambda picture, s: [rectify(picture, s)], [("note", "string")])


def enhance_pages(images: DataFrame, colour: bool = True) -> DataFrame:
    """photo_id, image: pictures with evened illumination."""
    return _pictures(images, [], lambda picture: [(enhance(picture, colour),)], [])
