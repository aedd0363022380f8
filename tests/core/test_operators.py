"""Votes, versions, names: literal cases and invariants."""

import random

from pyspark.sql import functions as F

from reconspark.operators import consensus, evaluate, identity, reconcile

READS = "k string, seq int, source string, value string, special boolean"


def vote(spark, values, special=()):
    df = spark.createDataFrame([("k", i, f"s{i}", v, i in special) for i, v in enumerate(values)], READS)
    return df, consensus.consensus(df, ["k"], "value", "seq", "source").first()


def test_votes(spark):
    cases = [
        (["1234ABCD", "1234ABCE"], None, consensus.DISPUTED),
        (["1234ABCE", "1234ABCD", "1234ABCD"], "1234ABCD", consensus.MAJORITY),
        (["A", " ", None], "A", consensus.SINGLE),
        (["A", "A"], "A", consensus.CONFIRMED),
        ([None, ""], None, consensus.UNREAD),
        (["A", "A", "B", "B", "B"], None, consensus.DISPUTED),
    ]
    for values, value, status in cases:
        _, r = vote(spark, values)
        assert (r["value"], r["status"], r["attempts"]) == (value, status, len(values)), values
    _, r = vote(spark, ["1234ABCE", "1234ABCD", "1234ABCD"])
    assert r["candidates"] == ["1234ABCD", "1234ABCE"] and r["sources"] == ["s0: 1234ABCE", "s1: 1234ABCD", "s2: 1234ABCD"]


def test_votes_do_not_depend_on_order(spark):
    r = random.Random(1)
    for _ in range(3):
        values = [r.choice(["A", "B", None]) for _ in range(6)]
        _, a = vote(spark, values)
        _, b = vote(spark, r.sample(values, 6))
        assert (a["value"], a["status"]) == (b["value"], b["status"])


def test_special_readings(spark):
    df, _ = vote(spark, ["1234ABCD", "1234ABCD", None, None], special={2, 3})
    assert consensus.crc_consensus(df, ["k"], "value", "seq", "source", "special").first()["value"] == "1234ABCD"
    df, _ = vote(spark, ["X", "X", "1", "2"], special={2, 3})
    got = consensus.crc_consensus(df, ["k"], "value", "seq", "source", "special").first()
    assert got["value"] is None and got["candidates"] == ["X", "1", "2"] and got["status"].endswith(consensus.LATIN_NOTE)


def test_stable(spark):
    rows = [("a", 0, "", v, False) for v in ("2", None, "2")] + [("b", 0, "", v, False) for v in ("2", "2", "3")] + [("c", 0, "", v, False) for v in (None, "2", None)]
    got = {r["k"]: r["stable"] for r in consensus.stable(spark.createDataFrame(rows, READS), ["k"], "value").collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_file_names(spark):
    codes = spark.createDataFrame([(c,) for c in ("ABC-12", "ABC-1", "007", "СП / Договор №7", "Ω/PLAN-07", "X-1", "X-2")], "code string")
    names = ["ABC-12.pdf", "ABC-120.pdf", "ABC-12.3.pdf", "abc - 12 rev.pdf", "Договор СП / Договор №7.docx", "Ω/PLAN-07.pdf", "X-1 X-2.pdf", "007.dwg"]
    files = spark.createDataFrame(list(enumerate(names)), "id int, file string")
    got = {r["id"]: r["code"] for r in identity.match_files(files, codes, "file", ["id"]).collect()}
    assert got == {0: "ABC-12", 3: "ABC-12", 4: "СП / Договор №7", 5: "Ω/PLAN-07", 7: "007"}


def test_lines(spark):
    codes = spark.createDataFrame([("АЛЬФА",), ("1234",), ("БЕТА-1",)], "code string")
    lines = spark.createDataFrame([(1, 0, "Альфа"), (1, 1, "текст"), (2, 0, "Альфа-УЛ"), (3, 0, "1234"), (4, 0, "см. Альфа"), (5, 0, "Бета-1 (Изм.2)"), (6, 0, "Альфа"), (6, 1, "Бета-1")], "page int, n int, line string")
    got = {r["page"]: r["code"] for r in identity.match_lines(lines, codes, "line", "page", ["n"]).collect()}
    assert got == {1: "АЛЬФА", 2: "АЛЬФА", 5: "БЕТА-1"}


def test_keys_held_as_by_brute_force(spark):
    """Texts of any length and alphabet, null and empty ones, keys of many lengths, some longer than any text."""
    r = random.Random(5)
    made = lambda n: "".join(r.choice("abЖ𝒳\u0000") for _ in range(n))
    texts = [(i, r.choice([None, "", made(r.randrange(60))])) for i in range(300)] + [(300, made(20_000)), (301, made(identity.CHARACTERS + 1)), (302, made(9))]
    keys = [*{made(r.randrange(1, 6)) for _ in range(200)}, None, "", made(90)]
    got = identity._held(spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame([(k,) for k in keys], "k string"), "t", "k")
    assert sorted((x["id"], x["k"]) for x in got.collect()) == sorted((i, k) for i, t in texts if t for k in keys if k and k in t)


def test_texts_are_read_once_however_many_keys(spark):
    keys = spark.range(300_000).select(F.format_string("%010d", "id").alias("k"))
    held = identity._held(spark.createDataFrame([(1, "x0000299999y"), (2, "9999999999")], "id int, t string"), keys, "t", "k")
    assert held._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [(r["id"], r["k"]) for r in held.collect()] == [(1, "0000299999")]


def test_best_sample_needs_score_and_lead(spark):
    rows = [("a", "1", 0.9), ("a", "2", 0.7), ("b", "1", 0.9), ("b", "2", 0.85), ("c", "3", 0.5), ("d", "0", 0.9)]
    got = consensus.best_sample(spark.createDataFrame(rows, "k string, label string, score double"), ["k"], "label", "score").collect()
    assert [(r["k"], r["label"]) for r in got] == [("a", "1")]


def test_findings_keep_the_first(spark):
    f = lambda p: spark.createDataFrame([("Проверить", None, "t", "d", [p])], "level string, code string, topic string, detail string, photos array<int>")
    assert [r["photos"] for r in reconcile.union_findings([f(3), f(1)]).collect()] == [[3]]


def test_scores_against_labels(spark):
    pages = spark.createDataFrame([(1, "ABCDEF00", None, "3")], "id int, CRC string, Page string, Revision string")
    findings = spark.createDataFrame([(0, "Проверить", "K", "t", [1]), (1, "Расхождение", "K", "u", [2]), (2, "Проверить", None, "v", [1])], "finding_id int, level string, code string, topic string, photos array<int>")
    label = "label_id int, code string, topic string, topics array<string>, photo int"
    known = spark.createDataFrame([(0, "K", None, ["x", "t"], 1), (1, "K", "u", None, 1)], label)
    negative = spark.createDataFrame([(0, "", "v", None, None)], label)
    expected = spark.createDataFrame([(1, "CRC", "ABCDEF00"), (1, "Page", "1"), (1, "Revision", "2")], "photo int, field string, value string")
    r = evaluate.metrics(pages, findings, known, negative, expected).first().asDict()
    assert (r["known_found"], r["false_warnings"], r["unlabelled_findings"]) == (1, 1, 1)
    assert (r["fields_correct"], r["fields_missing"], r["fields_wrong"]) == (1, 1, 1) and r["warnings"] == 2


def test_keyless_findings_go_to_every_row(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "row int, code string")
    f = spark.createDataFrame([("a", "x"), (None, "y")], "code string, topic string")
    assert sorted((r["row"], r["topic"]) for r in reconcile.with_keyless(rows, f, "code").collect()) == [(1, "x"), (1, "y"), (2, "y")]
    assert reconcile.with_keyless(rows, f.where(F.lit(False)), "code").count() == 0
