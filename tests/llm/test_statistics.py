"""Operators 11 to 13: against their SQL and against plain counts, on the tables, on odd rows and on planted ones."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from reconspark.llm import collocations as C
from reconspark.llm import compression, divergence
from reconspark.llm import queries as Q
from tests.oracle import compare

from . import fixtures


@pytest.mark.parametrize("name", ["op11_collocations", "op12_divergence"])
def test_queries_against_sql(spark, name):
    compare(spark, Q.queries()[name], Q.oracle_sql()[name], "/root/testdata/sf0.001")


def against_sql(spark, df, tmp_path, name):
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect(config={"temp_directory": ""})
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = [tuple(r[n] for n in names) for r in Q.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want.fetchall(), key=str)
    return [dict(zip(names, r, strict=True)) for r in got]


def prose_rows(seed, n, words=40):
    """Rows of a small vocabulary with every kind of sign, repeated rows, null texts, languages, sources and ids."""
    r = random.Random(seed)
    vocabulary = ["The", "the", "of", "and", "Stone", "water", "été", "ß", "x1", "a'b", "ÄÖ", "don t", "中文"]
    signs = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", ";", ": ", "\x0b", " ? "]
    rows = [(i, "".join(r.choice(vocabulary) + r.choice(signs) for _ in range(r.randrange(words))), r.choice(["en", "de", None, "en"]), r.choice(["a", "b", "ç", None, "hot", "hot"])) for i in range(n)]
    rows += [(None, "the water of the stone", "en", "a"), (None, None, None, None), (1, "", "fr", "lone"), (2, "12 34", "en", "numbers"), *rows[:3], *rows[:3]]
    return [(i, t, lang, source, 1, 2, "x") for i, t, lang, source in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n long, p long, term string"


@pytest.mark.parametrize("name", ["op11_collocations", "op12_divergence"])
def test_odd_rows_against_sql(spark, tmp_path, name):
    got = against_sql(spark, spark.createDataFrame(prose_rows(3, 400), SCHEMA).repartition(5), tmp_path, name)
    assert len(got) > 50
    none = spark.createDataFrame([], SCHEMA)
    assert against_sql(spark, none, tmp_path, name) == []


def test_languages_without_kept_terms_have_pairs_of_value_zero(spark, tmp_path):
    rows = [(i, "one two", "en", s, 1, 2, "x") for i, s in enumerate("abb")]
    got = against_sql(spark, spark.createDataFrame(rows, SCHEMA), tmp_path, "op12_divergence")
    assert {(r["part"], r["value"]) for r in got} == {("pair", 0)} and len(got) == 2


def test_shares_beyond_64_bits(spark):
    """A count times 10^9 and a square times 10^6 pass 64 bits."""
    big = 4_000_000_000_000
    row = spark.range(1).select(divergence._share(F.lit(big), F.lit(3 * big), F.lit(7)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (big + 5) // (3 * big + 35)


def test_suffix_arrays_by_brute_force():
    r = np.random.default_rng(5)
    for depth in (1, 2, 3, 5):
        ids = r.integers(0, 4, 300)
        words, left = C.pieces(ids)
        order, common = C.suffixes(words, left, depth)
        suffix = [tuple(words[i : i + min(depth, left[i])].tolist()) for i in order]
        assert sorted(order.tolist()) == list(range(len(words)))
        for a, b, n in zip(suffix, suffix[1:], common[1:].tolist(), strict=False):
            assert n == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        for size in range(1, depth + 1):
            place, f = C.intervals(order, common, left >= size, size)
            got = {tuple(words[p : p + size].tolist()): n for p, n in zip(place.tolist(), f.tolist(), strict=True)}
            assert got == Counter(tuple(words[i : i + size].tolist()) for i in range(len(words)) if left[i] >= size) and len(got) == len(place)


def test_windows_keep_chosen_phrases_and_part_the_rest():
    left = np.array([6, 5, 4, 3, 2, 1, 3, 2, 1])
    place, rest = C.windows(left, np.array([1, 0, 0, 1, 0, 0, 0, 0, 0], bool), 3)
    assert place.tolist() == [0, 1, 2, 3, 4, 5] and rest.tolist() == [3, 2, 1, 3, 2, 1]
    assert C.windows(left, np.zeros(9, bool), 3)[0].tolist() == []


@pytest.mark.parametrize(("words", "bits", "shard"), [(3, 64, 50), (4, 1 << 16, 2_000_000)])
def test_phrases_by_brute_force(spark, monkeypatch, words, bits, shard):
    """A bit table that is full, tiny shards and longer phrases change no count."""
    monkeypatch.setattr(C, "SHARD", shard)
    r = random.Random(9)
    texts = [" ".join(r.choice("abcde") for _ in range(30)) + r.choice([".", " a b c d e. a b c d e"]) for _ in range(60)]
    docs = spark.createDataFrame([(t, r.choice(["en", "de"])) for t in texts], "text string, lang string")
    from reconspark.llm.common import Scratch

    got = {(r["lang"], r["phrase"]): r["f"] for r in C.frequent_phrases(docs, Scratch(spark, "test"), words, 10, bits).where("size > 0").collect()}
    want = Counter()
    for row in docs.collect():
        for piece in row["text"].split("."):
            w = piece.split()
            want.update((row["lang"], " ".join(w[i : i + m])) for m in range(1, words + 1) for i in range(len(w) - m + 1))
    assert got == {k: n for k, n in want.items() if n >= 10}


def plain_counts(text):
    words = (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(inside)


def test_counts_by_brute_force(spark):
    rows = fixtures.odd_rows(4) + [(100, "a b c d e a b c d e"), (101, "x x x x x x x"), (102, "one\nline\n one\none\n\n \nline"), (103, "| # | ## <b> été a"), (104, "w " * 200_000)]
    df = fixtures.frame(spark, rows)
    got = compression.compression_rules(df)
    assert set(df.columns) < set(got.columns) and got.count() == len(rows)
    for r in got.collect():
        n = plain_counts(r["text"])
        assert tuple(r[c] for c in compression.BASE) == n
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r["base_failed"] and r["kept"])
    assert compression.compression_rules(fixtures.empty(spark)).count() == 0
    assert compression.compression_rules(df.where("doc_id < 3")).where("kept").count() == 0


def test_verdict_follows_the_limits(spark):
    """Ratios recomputed one by one against the fitted band; equal texts count once in the fit."""
    import zstandard

    r = random.Random(8)
    vocabulary = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    noise = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(8)) for _ in range(n))
    few = vocabulary[:6]
    dull = lambda n: " ".join(r.choice(few) + str(i) for i in range(n))
    rows = [(i, prose(r.randrange(60, 900))) for i in range(400)] + [(1000 + i, noise(300)) for i in range(5)] + [(2000 + i, dull(900)) for i in range(5)]
    rows += [(3000, noise(460) + " " + dull(800)), (3001, None)] + [(4000 + i, rows[0][1]) for i in range(900)]
    docs = fixtures.frame(spark, rows)
    got = {x["doc_id"]: x for x in compression.compression_rules(docs, keep=["doc_id"]).collect()}
    clean = [got[i]["kept"] for i in range(400)]
    assert np.mean(clean) > 0.99 and not any(got[i]["kept"] for i in [*range(1000, 1005), *range(2000, 2005), 3000, 3001])
    kept = docs.select(F.col("doc_id"), "text")
    limits = compression.fit_limits(compression._measured(kept, ["doc_id"], "text", compression.CHUNK))
    pack = zstandard.ZstdCompressor(level=compression.LEVEL, write_checksum=False, write_content_size=False).compress
    for i, t in rows:
        raw = (t or "").encode()
        parts = [raw[k : k + 4096] for k in range(0, len(raw), 4096)] if len(raw) > 4096 else []
        inside = lambda p: (lambda x, lo, hi: lo[0] <= x <= hi[0])(len(p) / len(pack(p)), *limits.interval(np.array([len(p)])))
        off = sum(len(p) for p in parts if not inside(p)) / max(1, len(raw))
        assert got[i]["kept"] == (not got[i]["base_failed"] and inside(raw) and off <= compression.SHARE)


def test_quality_labels_and_clean_documents(spark):
    d = Q.op13_compression(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r["quality"]: r["kept"] for r in d.collect()}
    assert kept[1] > 0.99 and kept[0] < 0.5
