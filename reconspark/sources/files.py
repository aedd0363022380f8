"""File sources: recognised pages as JSON, directories and ZIP archives of scans, with their limits; and JSON sinks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reconspark.schemas import OCR

EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp", ".pdf"]
MOST_FILES, MOST_ENTRIES, ENTRY_BYTES, ARCHIVE_BYTES = 1000, 1000, 150_000_000, 2_000_000_000
# Fixed value: the file of a finished check.
RESULTS = "Результаты.json"


def extension(path) -> F.Column:
    return F.lower(F.regexp_extract(path, "(\\.[^./\\\\]+)$", 1))


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    """Pages of recognised text, one JSON document a file or a line; pages that cannot be used have valid = false."""
    pages = spark.read.schema(OCR).option("multiLine", True).json(path)
    return pages.withColumn("valid", (F.col("width") >= 1) & (F.col("height") >= 1) & F.col("lines").isNotNull())


def scan(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """Scans under a folder (or one file), by path in any case: (path, length, modificationTime, content)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(extension(F.col("path")).isin(EXTENSIONS))
    return (found if with_content else found.drop("content")).orderBy(F.lower("path"))


def scan_zip(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, content, sha256) of the scans in ZIP archives; an archive over a limit is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in zip(b.column(0), b.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    items = sorted((i for i in z.infolist() if not i.is_dir() and any(i.filename.lower().endswith(e) for e in EXTENSIONS)), key=lambda i: i.filename.lower())
                    if len(items) > MOST_ENTRIES or any(i.file_size > ENTRY_BYTES for i in items) or sum(i.file_size for i in items) > ARCHIVE_BYTES:
                        raise ValueError(f"{archive.as_py()}: more than {MOST_ENTRIES} entries, {ENTRY_BYTES} bytes in one or {ARCHIVE_BYTES} in all")
                    for i in items:
                        yield pa.RecordBatch.from_arrays([pa.array([archive.as_py()]), pa.array([i.filename]), pa.array([z.read(i)], pa.binary())], names=["archive", "name", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, name string, content binary").withColumn("sha256", F.sha2("content", 256))


def within_limits(files: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """files, or an error if there are more than the limit; checked in the plan."""
    total = files.agg(F.count("*").alias("__n")).select(F.assert_true(F.col("__n") <= most, F.lit(f"more than {most} files")).alias("__ok"))
    return files.join(F.broadcast(total)).where(F.col("__ok").isNull()).drop("__ok")


def drop_copies(files: DataFrame, content: str = "content", order: str = "path", explicit: str | None = None) -> DataFrame:
    """The first of files with equal content. If only some were named explicitly, just their groups are merged and the mark moves to the survivor."""
    marked = files.withColumn("__x", F.col(explicit) if explicit else F.lit(True)).withColumn("__sha", F.sha2(content, 256)).withColumn("__len", F.length(content))
    groups = marked.groupBy("__len", "__sha").agg(F.min(order).alias("__first"), F.bool_or("__x").alias("__any"))
    kept = marked.join(groups, ["__len", "__sha"]).where(~F.col("__any") | (F.col(order) == F.col("__first")))
    return (kept.withColumn(explicit, F.col("__any")) if explicit else kept).drop("__x", "__sha", "__len", "__first", "__any")


def _passed(rows: DataFrame, problem: Column) -> DataFrame:
    """rows, or an error where there is a problem; checked in the plan."""
    ok = F.when(problem.isNull(), F.lit(True)).otherwise(F.raise_error(problem).cast("boolean"))
    return rows.withColumn("__ok", ok).where("__ok").drop("__ok")


def read_prior(spark: SparkSession, root: str) -> DataFrame:
    """Pages of a finished check, in the folder that holds its results and assets: photo_id, image_file and schemas.OCR.

    Reading it is an error if there is no list of pages or an empty one, ids are beyond 1 to 1000 or repeat, an image has another page's name,
    or a page lacks its image, its original or usable recognised text.
    """
    assets = spark.read.format("binaryFile").load(f"{root}/assets").select(F.lower(F.regexp_extract("path", "([^/]+)$", 1)).alias("name"))
    has = lambda pages, name, column: pages.join(assets.select(F.col("name").alias("__name"), F.lit(True).alias(column)), F.lower(name) == F.col("__name"), "left").drop("__name")
    report = spark.read.schema("Photos array<struct<Id:int,ImageFile:string>>").option("multiLine", True).json(f"{root}/{RESULTS}")
    listed = _passed(report, F.when(F.col("Photos").isNull() | (F.size("Photos") == 0), "the report has no saved pages"))
    listed = _passed(listed, F.when(F.size(F.array_distinct("Photos.Id")) < F.size("Photos"), "repeated page id"))
    pages = listed.select(F.inline_outer("Photos")).select(F.col("Id").alias("photo_id"), F.nullif("ImageFile", F.lit("")).alias("image_file"))
    pages = _passed(pages, F.when(F.coalesce(~F.col("photo_id").between(1, 1000), F.lit(True)), "page id beyond 1 to 1000"))
    stem = F.format_string("p%04d", F.col("photo_id"))
    pages = has(pages, F.concat(stem, F.lit("-processed.jpg")), "__processed")
    pages = pages.withColumn("image_file", F.coalesce("image_file", F.concat(stem, F.when(F.col("__processed"), "-processed.jpg").otherwise(".jpg"))))
    pages = has(has(pages, F.col("image_file"), "__image"), F.concat(stem, F.lit(".jpg")), "__original")
    own = F.lower("image_file").isin(F.concat(stem, F.lit(".jpg")), F.concat(stem, F.lit("-processed.jpg")))
    ocr = spark.read.schema(OCR).option("multiLine", True).option("pathGlobFilter", "p*.json").json(f"{root}/assets")
    ocr = ocr.select(F.regexp_extract("_metadata.file_name", "^p(\\d{4})\\.json$", 1).try_cast("int").alias("photo_id"), "*", F.lit(True).alias("__ocr"))
    pages = pages.join(ocr, "photo_id", "left")
    usable = F.coalesce(F.col("__ocr") & (F.col("width") >= 1) & (F.col("height") >= 1) & F.col("lines").isNotNull(), F.lit(False))
    problem = F.when(~own, "image of another page").when(F.col("__image").isNull() | F.col("__original").isNull(), "no image").when(~usable, "no usable recognised text")
    return _passed(pages, F.concat(F.lit("page "), F.col("photo_id").cast("string"), F.lit(": "), problem)).drop("__processed", "__image", "__original", "__ocr")


def read_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hand labels as evaluate.metrics takes them: known and negative (label_id, code, topic, topics, photo), expected (photo, field, value)."""
    label = "array<struct<Code:string,Topic:string,Topics:array<string>,Photo:string>>"
    gold = spark.read.schema(f"KnownFindings {label}, NegativeChecks {label}, Fields array<struct<Photo:string,Field:string,Value:string>>").option("multiLine", True).json(path)
    rows = lambda c: gold.select(F.posexplode(c).alias("label_id", "x")).select("label_id", F.col("x.Code").alias("code"), F.col("x.Topic").alias("topic"), F.col("x.Topics").alias("topics"), F.col("x.Photo").try_cast("int").alias("photo"))
    expected = gold.select(F.inline("Fields")).select(F.col("Photo").try_cast("int").alias("photo"), F.col("Field").alias("field"), F.coalesce("Value", F.lit("")).alias("value"))
    return rows("KnownFindings"), rows("NegativeChecks"), expected


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Pages, inventory, findings, counters, choices and timings as JSON, a folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
