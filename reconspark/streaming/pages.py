"""A folder of recognised pages as a stream: the same typing as in batch, file by file as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconspark.functions import text as X
from reconspark.operators.pages import looks_like_iul
from reconspark.schemas import OCR


def read_pages(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    return spark.readStream.schema(OCR).option("maxFilesPerTrigger", files_at_once).json(path)


def typed(pages: DataFrame) -> DataFrame:
    """file, code, tom, crc, iul: what one page says by itself; no state is kept."""
    code = X.page_code("text")
    return pages.select("file", code.alias("code"), X.tom(code).alias("tom"), X.page_crc("text").alias("crc"), looks_like_iul(F.coalesce("text", F.lit(""))).alias("iul"))


def run(pages: DataFrame, output: str, checkpoint: str):
    """Appends typed pages to a table as they arrive; restarts where it stopped."""
    return typed(pages).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
