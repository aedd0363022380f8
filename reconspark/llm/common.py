"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reconspark.storage import Scratch, shared_root  # noqa: F401

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``bytes.split`` cuts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mixed(x: np.ndarray, step: int = 0) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit values: spreads close values over the whole range."""
    with np.errstate(over="ignore"):
        x = x + MIX[0] * np.uint64(step + 1)
        x = (x ^ (x >> np.uint64(30))) * MIX[1]
        x = (x ^ (x >> np.uint64(27))) * MIX[2]
        return x ^ (x >> np.uint64(31))


def fold(column: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id, written as text, leaves this remainder (false for a null id)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, sample: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text, label) of at most `sample` labelled rows: the texts with the least hashes under the ids with the least.

    Ids and texts are bounded each, so an id with any number of texts brings no more. Equal texts count once, with the larger label;
    rows with a null label are left out.
    """
    chosen = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("text"), F.xxhash64(text).alias("id")).join(F.broadcast(chosen), "__id")
    texts = rows.groupBy("id").agg(F.max("label").alias("label")).orderBy("id").limit(sample)
    return rows.select("id", "text").join(F.broadcast(texts), "id").groupBy("id", "label").agg(F.first("text").alias("text")).select("id", "text", "label")


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem
