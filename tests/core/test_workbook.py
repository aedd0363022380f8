"""The workbook as a data source: reads as before, writes all or nothing."""

import pytest

from reconspark.sources import registry as R
from reconspark.sources import workbook as W

from .test_registry import ROWS, book

EDITS = [(7, "I", "Петров, Иванов", "text"), (7, "L", "22", "number"), (8, "T", "Примечание", "text")]


@pytest.fixture()
def source(spark, tmp_path):
    W.register(spark)
    (tmp_path / "a.xlsx").write_bytes(book(ROWS))
    return f"{tmp_path}/a.xlsx"


def edits(spark, rows=EDITS):
    return spark.createDataFrame(rows, "row int, column string, value string, kind string").repartition(3)


def write(spark, source, target, rows=EDITS, mode="append", **options):
    edits(spark, rows).write.format("registry_xlsx").options(source=source, **options).mode(mode).save(str(target))


def test_reads_a_workbook_and_a_folder(spark, source, tmp_path):
    want = R.read_registry(spark, source).drop("file").orderBy("row").collect()
    got = spark.read.format("registry_xlsx").load(source)
    assert got.columns[:2] == ["row", "file"] and got.drop("file").orderBy("row").collect() == want and len(want) == 3
    (tmp_path / "b.XLSX").write_bytes(book(ROWS))
    assert spark.read.format("registry_xlsx").load(str(tmp_path)).groupBy("file").count().count() == 2
    with pytest.raises(Exception, match="missing"):
        spark.read.format("registry_xlsx").load(f"{tmp_path}/missing.xlsx").count()


def test_writes_a_copy_and_refuses(spark, source, tmp_path):
    """Cells are filled, the rest stays; whatever is refused leaves neither the copy nor a part of it."""
    before = (tmp_path / "a.xlsx").read_bytes()
    write(spark, source, tmp_path / "copy.xlsx", sha256=W.digest(source))
    rows = {r["row"]: r for r in spark.read.format("registry_xlsx").load(f"{tmp_path}/copy.xlsx").collect()}
    assert (rows[7]["c9"], rows[7]["c12"], rows[7]["c20"], rows[8]["c20"]) == ("Петров, Иванов", "22", "Прежнее замечание", "Примечание")
    assert (tmp_path / "copy.xlsx").read_bytes() == R.save_copy(before, sorted(EDITS)) and (tmp_path / "a.xlsx").read_bytes() == before
    listed = {p.name for p in tmp_path.iterdir()}
    for message, target, rows, more in (
        ("replace its source", source, EDITS, {}),
        ("has changed", tmp_path / "new.xlsx", EDITS, {"sha256": "0" * 64}),
        ("two values", tmp_path / "new.xlsx", [*EDITS, (7, "I", "x", "text")], {}),
        ("longer than", tmp_path / "new.xlsx", [(7, "I", "x" * 40000, "text")], {}),
        ("copy.xlsx", tmp_path / "copy.xlsx", EDITS, {}),
    ):
        with pytest.raises(Exception, match=message):
            write(spark, source, target, rows, **more)
    assert {p.name for p in tmp_path.iterdir()} == listed
    write(spark, source, tmp_path / "copy.xlsx", EDITS[:1], mode="overwrite")
    assert spark.read.format("registry_xlsx").load(f"{tmp_path}/copy.xlsx").where("row = 8 and c20 is null").count() == 1
