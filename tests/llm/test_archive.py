"""Operator 3: exact round trips."""

import hashlib
from collections import Counter

import pytest

from reconspark.llm import archive

SCHEMA = "page_id long, url string, html string, record string, place string"


def test_round_trip(spark):
    big = "<p>" + "x\r\n\r\n" * 400
    rows = [(1, "http://a/b c", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "é", None), (None, "n", big), (6, "w", "WARC/1.1\r\n\r\nfiledesc://"), (7, "x", "y" * 999), (8, "x", "y" * 999), (9, "x", "é" * 500), (10, "x", "é" * 500), (2, None, big)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    got = archive.archive_round_trip(df).collect()
    most = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            most[h] = max(i, most.get(h, i))
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        to = most.get(h) if most.get(h) != i else None
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if to is not None else "response", to] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    ids = {r["page_id"]: r["record_id"] for r in got if r["record_type"] == "response"}
    assert all(r["refers_to_record"] == ids[r["refers_to"]] for r in got if r["record_type"] == "revisit")
    assert archive.archive_round_trip(df.limit(0)).count() == 0


def test_small_tables_are_written_in_both_versions(spark, tmp_path):
    df = spark.range(40).selectExpr("id page_id", "'u' url", "'text' html").repartition(4)
    archive.write_arc(df, f"{tmp_path}/arc")
    got = archive.read_arc(spark, f"{tmp_path}/arc").collect()
    assert {r["version"] for r in got} == {1, 2} and sorted(r["page_id"] for r in got) == list(range(40))


@pytest.mark.parametrize("version", [1, 2])
def test_header_lines_by_version(version):
    data = archive.arc_record(version, "f.arc", "http://x/ y", "20200102030405", 7, b"body")
    got = archive.parse_arc(data, version)
    assert got["url"] == "http://x/%20y" and got["date"] == "20200102030405" and archive.http_parts(got["block"])[2] == b"body"
    fields, block = archive.parse_warc(archive.convert(got, 7, None, "p"))
    assert fields["warc-date"] == "2020-01-02T03:04:05Z" and fields["warc-type"] == "response" and block == got["block"]
    fields, block = archive.parse_warc(archive.convert(got, 7, 9, "p"))
    assert fields["warc-type"] == "revisit" and fields["warc-profile"] == archive.REVISIT_PROFILE and b"body" not in block


def test_damaged_records_are_named():
    data = archive.arc_record(1, "f.arc", "u", "20200102030405", 7, b"body")
    with pytest.raises(ValueError, match="no record of ARC version 1"):
        archive.parse_arc(data[:-4], 1)
    with pytest.raises(ValueError, match="cut short"):
        list(archive.members(archive.squeeze(data)[:-3]))


def test_members_skip_padding():
    parts = [b"", b"a" * 70_000, b"\x00\x00"]
    data = b"\x00".join(archive.squeeze(p) for p in parts) + b"\x00\x00"
    assert [m[2] for m in archive.members(data)] == parts


@pytest.mark.parametrize("name", ["op3_warc", "op4_substring"])
def test_query_equals_its_sql(spark, name):
    from reconspark.llm import queries
    from tests.oracle import compare

    compare(spark, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.01")
