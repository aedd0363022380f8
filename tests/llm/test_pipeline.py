"""The stages in order, on planted rows."""

import random
import zlib

import corpus_pipeline as P


def test_stages(spark, tmp_path):
    r = random.Random(2)
    prose = lambda n: " ".join(r.choice(["the", "of", "and", "reading", "mention", "water", "under", "stone"]) + str(r.randrange(50)) * 0 + r.choice("abcdefgh") * r.randrange(3) for _ in range(n))
    item, passage = prose(40), prose(80)
    clean = [(i, prose(150)) for i in range(20)]
    rows = [*clean, (20, clean[3][1]), (21, clean[4][1] + " end"), (22, "123 ### !!"), (23, None), (24, passage + " " + prose(120)), (25, prose(120) + " " + passage), (26, prose(60) + " " + item + " " + prose(60))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({x["doc_id"] for x in docs.select("doc_id").collect()})
        if k < 4:
            assert docs.columns == P.COLUMNS
        if k == 2:
            text = {x["doc_id"]: x["text"] for x in docs.collect()}
    everyone = set(range(20))
    assert kept[0] == everyone | {20, 21, 24, 25, 26}
    assert kept[1] == everyone | {24, 25, 26}
    assert kept[2] == kept[1] and len(text[25].split()) == 120 and text[24] == rows[24][1]
    assert kept[3] == everyone | {24, 25} and kept[4] == kept[3]
    assert "sequence_id" in docs.columns and P.ORACLE_SQL is None and len(P.STAGES) == 5


def made(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_null_and_repeated_ids_lose_no_clean_text(spark):
    r = random.Random(5)
    a, b, c, d, e, f = (" ".join(f"w{r.randrange(10**6)}" for _ in range(120)) for _ in range(6))
    rows = [(3, a), (5, a + " end"), (5, b), (7, c), (7, d), (7, d), (None, e), (None, e), (None, f), (None, a), (9, a)]
    got = P.near_copies(spark, made(spark, [(*x, "en") for x in rows]), "")
    assert got.columns == P.COLUMNS
    assert sorted((x["doc_id"] or 0, x["text"]) for x in got.collect()) == sorted([(3, a), (5, b), (7, c), (7, d), (0, e), (0, f)])


def test_items_and_passages_in_rows_without_an_id_of_their_own(spark, tmp_path):
    """A benchmark item and a repeated passage in null-id and repeated-id rows: nothing clean is lost, nothing planted kept."""
    r = random.Random(6)
    prose = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    item, passage, lone = prose(40), prose(70), prose(60)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    bad = [prose(30) + " " + item + " " + prose(30) for _ in range(2)]
    clean = [prose(90) for _ in range(4)]
    rows = [(None, bad[0]), (5, bad[1]), (5, clean[0]), (6, clean[1]), (None, clean[2]), (None, None), (7, clean[3]), (7, clean[3])]
    got = P.decontamination(spark, made(spark, [(*x, "en") for x in rows]), str(tmp_path)).collect()
    assert sorted(((x["doc_id"] or 0, x["text"] or "") for x in got)) == sorted((i or 0, t or "") for i, t in rows if t not in bad)

    own = [prose(80) for _ in range(8)]
    rows = [(3, f"{own[0]} {passage}"), (None, f"{own[1]} {passage}"), (None, f"{passage} {own[2]}"), (5, f"{passage} {own[3]}"), (5, f"{own[4]} {passage}"), (None, f"{lone} {own[5]}"), (None, f"{lone} {own[6]}"), (9, own[7])]
    got = [x["text"] for x in P.passages(spark, made(spark, [(*x, "en") for x in rows]), "").collect()]
    assert len(got) == len(rows) and sum(passage in t for t in got) == 1 and rows[0][1] in got
    assert sum(lone in t for t in got) == 1 and all(any(o in t for t in got) for o in own)


def test_letters_stay_where_no_language_is_learned(spark):
    held_out = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = [(i, t, lang) for i, (t, lang) in zip(held_out, [("one text", None), ("слова", None), ("12 !", None), (None, None)], strict=False)]
    assert {x["text"] for x in P.language(spark, made(spark, rows), "").collect()} == {"one text", "слова"}
    assert P.language(spark, made(spark, [(i, t, "en") for i, t, _ in rows]), "").count() == 2


def test_a_wrong_language_is_mended_and_noise_goes(spark):
    r = random.Random(11)
    say = lambda words, n=80: " ".join(r.choice(words.split()) for _ in range(n))
    en = lambda: say("the water under stone reading and mention which through mighty thought")
    de = lambda: say("der fluss durch schönes gebirge nicht über zwischen straße entwicklung und")
    rows = [(i, en(), "en") for i in range(30)] + [(100 + i, de(), "de") for i in range(30)]
    rows += [(200, de(), "en"), (201, en(), None), (202, " ".join("".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(9)) for _ in range(60)), None), (203, "und", "en")]
    got = {x["doc_id"]: x["lang"] for x in P.language(spark, made(spark, rows), "").collect()}
    assert got.keys() == {i for i, *_ in rows} - {202}
    assert got[200] == "de" and got[201] == "en" and all(got[i] == "en" and got[100 + i] == "de" for i in range(30))


def test_whole_run_on_odd_and_empty_tables(spark, tmp_path):
    r = random.Random(12)
    prose = lambda n: " ".join(r.choice("water stone reading mention under over never always".split()) + r.choice("abcdefgh") * r.randrange(3) for _ in range(n))
    a, b, c = prose(90), prose(90), prose(90)
    rows = [(1, a), (1, b), (None, c), (None, c), (2, a), (3, None), (4, ""), (5, "12 !!"), (6, prose(3000)), (7, "word")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, score double, spans string, component long, __id string, trigrams int"
    full = [(i, t, "en", None, len(t or ""), 1, 0.5, "x", 3, "y", 4) for i, t in rows]
    for name, some in (("full", full), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, prose(12)), (None, "x"), (2, None)][: 3 * len(some)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = P.run(spark, f"{tmp_path}/full").collect()
    assert sorted({x["doc_id"] or 0 for x in got}) == [0, 1, 6, 7]
    assert sum(x["piece"] == 0 for x in got) == 5  # a, b, c, the long one and the single word
    none = P.run(spark, f"{tmp_path}/none")
    assert none.count() == 0 and "sequence_id" in none.columns
