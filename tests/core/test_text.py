"""Literal cases of the normalisers and parsers."""

import pytest
from pyspark.sql import functions as F

from reconspark.functions import text as X

CASES = [
    (X.fold, " аё–б  в", "АЕ-Б В"),
    (X.fold, None, ""),
    (X.digits, "ЗОЛН", "30111"),
    (X.legacy_code, "123-45-6789-ИЛОЗ.7.1", "123-45-6789-ИЛО3.7.1"),
    (X.document_code, "123-45-6789-TkP12.l.9.pdf", "123-45-6789-ТКР12.1.9"),
    (X.legacy_code, "123-45-6789-ТКР12Л.11", "123-45-6789-ТКР12.1.11"),
    (X.legacy_code, "nothing here", None),
    (X.find_code, "том\n123-45-6789-\nИЛО4.1.2", "123-45-6789-ИЛО4.1.2"),
    (X.page_code, "123-45-6789\nТом 4.З.7.1", "123-45-6789-ИЛО3.7.1"),
    (X.tom, "123-45-6789-ИЛО3.7.1", "4.3.7.1"),
    (X.tom, "123-45-6789-ТКР12.1.9", "3.12.1.9"),
    (X.code_value, "ЭОМ-ABC/17.02", "ЭОМ-ABC/17.02"),
    (X.code_value, " «альфа» ", "АЛЬФА"),
    (X.code_value, "Без шифра", None),
    (X.value, "Ω/PLAN-07", "Ω/PLAN-07"),
    (X.key, "СП / Договор №7", "СП/ДОГОВОРNO7"),
    (X.crc, "CRC32: АВСD1234", "ABCD1234"),
    (X.crc, "CRC32: ABC1234", "0ABC1234"),
    (X.crc, "ABC1234", None),
    (X.page_crc, "CRC32 АВ12СD34", "AB12CD34"),
    (X.page_number, "Лист 1", 1),
    (X.page_number, "Лист З", 3),
    (X.page_number, "Лист", None),
    (X.page_number, "1 3", None),
    (X.page_number, "Лист 0", None),
    (X.documentation_kind, "Инженерные изыскания", "ИИ"),
    (X.documentation_kind, "Документация по планировке территории", "ДПТ"),
    (X.documentation_kind, "Проектная документация и инженерные изыскания", None),
    (X.documentation_kind, "Проектная документация стадия инженерные изыскания", "ИИ"),
    (X.book_number, "книга 12", 12),
    (X.fragment, "Фрагмент 02.pdf", "2"),
    (X.valid_surname, "=1+1", False),
    (X.valid_surname, "О'Нил-Петров", True),
    (X.date_serial, "09.12.2025", 46000),
    (X.date_serial, "46000,7", 46000),
    (X.date_serial, "1.2.1999", None),
    (X.date_serial, "2025-12-09T10:11:12", 46000),
    (X.time_key, "9:05", "09:05:00"),
    (X.time_key, "0.5", "12:00:00"),
    (X.organization, "АО «Ленгипротранс»", "Ленгипротранс"),
    (X.organization, "гипр... транспуть", "Росжелдорпроект"),
    (X.organization, "x", "Не определено"),
    (X.inventory_suffix, "ИЛО3.7.1", "ИЛО3.7.1"),
]


@pytest.mark.parametrize("batch", [CASES[i : i + 8] for i in range(0, len(CASES), 8)])
def test_literal_cases(spark, batch):
    df = spark.createDataFrame([tuple(c[1] for c in batch)], ", ".join(f"c{i} string" for i in range(len(batch))))
    got = df.select(*(f(F.col(f"c{i}")).alias(f"r{i}") for i, (f, _, _) in enumerate(batch))).first()
    for i, (f, given, expected) in enumerate(batch):
        assert got[i] == expected, (f.__name__, given)


def test_two_argument_functions(spark):
    df = spark.createDataFrame([("Шумозащитные экраны", "Ограждения", "a\nb\nb", "b\nc\nc", "123-45-6789-ИЛО4.1.1-Л1_x.pdf", "123-45-6789-ИЛО4.1.1-ИЗМ.2.pdf", "123-45-6789-ИЛО4.1.1")], "a string, b string, c string, d string, n string, m string, k string")
    r = df.select(X.different("a", "b"), X.different("a", "a"), X.append_lines("c", "d"), X.is_base_volume("n", "k"), X.is_base_volume("m", "k"), X.registry_key("m", F.lit("pdf"), F.lit("a1"), F.lit("09.12.2025"), F.lit("9:05"))).first()
    assert tuple(r)[:5] == (True, False, "a\nb\nb\nc", False, True)
    assert r[5] == "123-45-6789-ИЛО4.1.1-ИЗМ.2\x1fPDF\x1fA1\x1f46000\x1f09:05:00"


def test_sections(spark):
    text = "Раздел 4. Здания\nПодраздел 4. Сети\nЧасть 1. Экраны\nКнига 2"
    r = spark.createDataFrame([(text,)], "t string").select(X.sections("t")).first()[0]
    assert len(r) == 3 and r["ЧАСТЬ"].startswith("1.")


def test_section_merge(spark):
    r = spark.sql("select map('A','1234567890','B','x') a, map('A','123','C','z') b").select(X.merge_sections("a", "b")).first()[0]
    assert r == {"A": "1234567890", "B": "x", "C": "z"} or r["B"] is None


def test_long_expressions_stand_once_in_a_plan(spark):
    """Text is folded once for a kind, and the pattern of sections is applied once for each of its groups."""
    texts = spark.createDataFrame([("Опись. Стадия ПРОЕКТНАЯ ДОКУМЕНТАЦИЯ",)], "t string")
    plan = lambda c: texts.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(X.documentation_kind("t")).count("upper(") == 1 and plan(X.organization("t")).count("upper(") == 1
    assert plan(X.sections("t")).count("regexp_extract_all(") == 3


def test_made_codes_are_dealt_to_all_cores(spark):
    from reconspark.plans import known

    parts = known._codes(lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")).rdd.getNumPartitions()
    assert parts >= spark.sparkContext.defaultParallelism
