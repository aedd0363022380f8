"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset and everything runs in one process (tests) a new local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="reconspark-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def unbounded(df: DataFrame) -> DataFrame:
    """df for joins that shuffle both sides. Estimates from file sizes are far too small for tables that compress well or of which few columns
    are left, and a broadcast would pass such a table whole through the driver."""
    return df.hint("merge")


_watched: list[list[Scratch]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Deletes at the end what Scratch objects that are made within have written: for callers that save the result themselves."""
    made: list[Scratch] = []
    _watched.append(made)
    try:
        yield
    finally:
        _watched.remove(made)
        for scratch in made:
            scratch.keep()


class Scratch:
    """Written tables cut lineage and survive lost executors. large: they may be of any size, so no join broadcasts them (see unbounded)."""

    def __init__(self, spark: SparkSession, name: str, large: bool = False):
        self.spark, self.path, self.names, self.large = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}", [], large
        for made in _watched:
            made.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        self.names.append(name)
        saved = self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")
        return unbounded(saved) if self.large else saved

    def keep(self, *names: str) -> None:
        """Deletes all saved tables but these: what a lazy result still reads."""
        for name in {*self.names} - {*names}:
            self.drop(name)

    def drop(self, name: str) -> None:
        self.names = [n for n in self.names if n != name]
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
