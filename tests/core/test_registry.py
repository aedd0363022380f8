"""A small workbook: read, plan, fill, refuse."""

import io
import zipfile
from datetime import date

import pytest

from reconspark.schemas import PAGE
from reconspark.sources import registry as R

HEAD = {"C": "Наименование файла", "H": "Контрольная сумма", "I": "Проверил", "J": "Дата проверки", "L": "Короб", "S": "Ошибки в описи", "T": "Примечание"}
CODE = "123-45-6789-ИЛО4.1.1"


def book(rows, formula=False, system=""):
    def cell(address, v):
        return f'<c r="{address}"><f>1+1</f><v>2</v></c>' if v == "=" else f'<c r="{address}" t="inlineStr"><is><t>{v}</t></is></c>'

    body = "".join(f'<row r="{n}">' + "".join(cell(f"{c}{n}", v) for c, v in sorted(r.items())) + "</row>" for n, r in {5: HEAD, **rows}.items())
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{R.REL[1:-1]}"><workbookPr {system}/><sheets><sheet name="{R.SHEET}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("docProps/app.xml", "<kept/>")
    return out.getvalue()


ROWS = {7: {"C": f"{CODE}.pdf", "D": "pdf", "H": "A1B2C3D4", "I": "Петров", "S": "Прежняя ошибка описи", "T": "Прежнее замечание"}, 8: {"C": "123-45-6789-ИЛО4.1.2.pdf", "H": "FFEEDDCC"}, 9: {"C": f"{CODE}-Л1_x.pdf", "H": "00000000"}}


def tables(spark, tmp_path, rows=ROWS, crc="A1B2C3D4"):
    data = book(rows)
    (tmp_path / "r.xlsx").write_bytes(data)
    pages = spark.createDataFrame([(1, "Титул", CODE, *[None] * 14), (2, "ИУЛ", CODE, None, None, None, None, crc, *[None] * 9)], PAGE)
    return data, R.read_registry(spark, f"{tmp_path}/r.xlsx"), pages, spark.createDataFrame([(CODE,)], "code string")


def test_plan_and_fill(spark, tmp_path):
    data, reg, pages, codes = tables(spark, tmp_path)
    rows, skipped = R.plan(reg, codes, pages)
    assert [tuple(r) for r in rows.collect()] == [(7, CODE, "")] and skipped.count() == 0
    findings = spark.createDataFrame([(0, "Расхождение", CODE, "Номер изменения", "a", [2], True), (1, "Расхождение", CODE, "CRC32 не совпадает", "b", [2], False), (2, "Проверить", None, "Строки описи не распознаны", "c", [1], True)], "finding_id int, level string, code string, topic string, detail string, photos array<int>, confirmed boolean")
    inventory = spark.createDataFrame([], "code string, documentation_kind string, box int")
    cells = {r["column"]: r["value"] for r in R.edits(reg, rows, findings, pages, inventory, "Иванов", date(2025, 12, 9)).collect()}
    assert cells["I"] == "Петров, Иванов" and cells["J"] == "46000" and set(cells) == {"I", "J", "S", "T"}
    assert cells["S"] == "Прежняя ошибка описи\nРасхождение: Номер изменения. a"
    assert cells["T"].splitlines() == ["Прежнее замечание", "Расхождение: Номер изменения. a", "Проверить: CRC32 не совпадает. b", "Общая проверка — Расхождение: Строки описи не распознаны. c"]
    copy = R.save_copy(data, [(7, c, v, "text" if c in "IST" else "date") for c, v in cells.items()])
    again = dict(R.cells(copy, R.SHEET))
    assert again[7][9] == "Петров, Иванов" and again[7][10] == "46000" and again[8] == dict(R.cells(data, R.SHEET))[8]
    assert zipfile.ZipFile(io.BytesIO(copy)).read("docProps/app.xml") == b"<kept/>"


@pytest.mark.parametrize("crc, kept", [("A1B2C3D4", [7]), (None, [])])
def test_versions(spark, tmp_path, crc, kept):
    rows = {**ROWS, 8: {"C": f"{CODE}.pdf", "H": "FFEEDDCC"}}
    _, reg, pages, codes = tables(spark, tmp_path, rows, crc)
    got, skipped = R.plan(reg, codes, pages)
    assert sorted(r["row"] for r in got.collect()) == kept and skipped.count() == 1 - len(kept)


def test_refusals():
    with pytest.raises(ValueError, match="formula"):
        R.save_copy(book({7: {"C": "x", "J": "="}}), [(7, "J", "1", "number")])
    with pytest.raises(ValueError, match="longer"):
        R.save_copy(book(ROWS), [(7, "T", "x" * 40000, "text")])
    with pytest.raises(ValueError, match="no sheet"):
        list(R.cells(book(ROWS), "other"))


def test_dates_of_the_1904_system():
    data = book({7: {"C": "x"}}, system='date1904="1"')
    copy = R.save_copy(data, [(7, "J", "46000", "date")])
    raw = zipfile.ZipFile(io.BytesIO(copy)).read("xl/worksheets/sheet1.xml").decode()
    assert "44538" in raw and dict(R.cells(copy, R.SHEET))[7][10] == "46000.0"
