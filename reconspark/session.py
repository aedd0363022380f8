"""Session helpers: a local builder for tests and benches, and shipping this package to executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Gives executors this package by addPyFile, once an application, wherever the driver was started."""
    if (app := spark.sparkContext.applicationId) not in _shipped:
        root = Path(__file__).resolve().parent
        stem = Path(tempfile.mkdtemp(prefix="reconspark-code-")) / "reconspark_code"
        spark.sparkContext.addPyFile(shutil.make_archive(str(stem), "zip", root.parent, root.name))
        _shipped.add(app)
    return spark


def local(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and benches share."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "6g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    }
    return ship(SparkSession.builder.master(f"local[{cores}]").config(map=settings | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate())
