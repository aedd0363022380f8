"""Operators 4, 5 and 9 against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from reconspark.llm import prefix, simhash, substring
from reconspark.llm.components import components
from reconspark.llm.common import Scratch

from . import fixtures


def brute_kept(rows):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for p in range(len(w) - 49) if i is not None else ():
            k = tuple(w[p : p + 50])
            first[k] = min(i, first.get(k, i))
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - 49) if i is not None else ():
            if first[tuple(w[p : p + 50])] < i:
                gone |= set(range(p, p + 50))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return Counter(out)


def test_repeats_as_by_brute_force(spark):
    rows = fixtures.odd_rows()
    got = substring.remove_repeats(fixtures.frame(spark, rows))
    assert set(fixtures.frame(spark, rows).columns) < set(got.columns)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()) == brute_kept(rows)
    assert substring.remove_repeats(fixtures.empty(spark)).count() == 0


def brute_print(t):
    w = (t or "").encode().lower().split()
    g = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_groups_as_by_brute_force(spark, radius):
    rows = fixtures.odd_rows(2)
    prints = [(i, brute_print(t)) for i, t in rows]
    up = {p: p for _, p in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in list(up):
        for b in list(up):
            if (a ^ b).bit_count() <= radius:
                up[find(a)] = find(b)
    named = {p for i, p in prints if i is not None}
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    want = Counter((i, p, least[find(p)] if p in named else None) for i, p in prints)
    got = simhash.near_duplicates(fixtures.frame(spark, rows), radius=radius)
    assert Counter((r["doc_id"], r["f0"] % 2**64, r["component_id"]) for r in got.collect()) == want
    assert simhash.near_duplicates(fixtures.empty(spark)).count() == 0


def test_links_at_every_distance(spark):
    """Fingerprints that differ in one to four bits of either half or of both."""
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(6)]
    prints = set(base)
    for b in base:
        for k in (1, 2, 3, 4):
            for _ in range(12):
                x = b
                for bit in r.sample(range(64), k):
                    x ^= 1 << bit
                prints.add(x)
    signed = [(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(sorted(prints))]
    by = dict(signed)
    for radius in (1, 2, 3):
        got = {(x["a"], x["b"]) for x in simhash.exact_links(spark.createDataFrame(signed, "rep long, f0 long"), radius).collect()}
        assert got == {(a, b) for a in by for b in by if a < b and ((by[a] ^ by[b]) % 2**64).bit_count() <= radius}


def test_wide_fingerprints_find_near_copies(spark):
    r = random.Random(6)
    rows = []
    for g in range(20):
        w = [f"w{r.randrange(10**6)}" for _ in range(200)]
        rows.append((10 * g, " ".join(w)))
        for k in (1, 2):
            v = list(w)
            v[r.randrange(200)] = "edited"
            v[r.randrange(200)] = "twice"
            rows.append((10 * g + k, " ".join(v)))
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, lanes=8, radius=102, aim=82).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}


@pytest.mark.parametrize("members, pairs", [(50_000, 500_000), (20, 100)])
def test_hub_in_the_middle_of_the_ids(spark, monkeypatch, members, pairs):
    """Texts edited from one hub are often near to it alone; strangers stand at both ends of the ids."""
    monkeypatch.setattr(simhash, "MEMBERS", members)
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    monkeypatch.setattr(simhash, "HELD", 5000)
    r = random.Random(8)
    hub = [f"w{r.randrange(10**6)}" for _ in range(300)]
    rows = [(500, " ".join(hub))] + [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(300))) for i in (*range(50), *range(950, 1000))]
    for i in (*range(400, 500), *range(501, 601)):
        w = list(hub)
        for k in r.sample(range(300), 7):
            w[k] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, lanes=8, radius=102, aim=82).collect()
    bits = {x["doc_id"]: [x[f"f{k}"] % 2**64 for k in range(8)] for x in got}
    near = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(bits[a], bits[b], strict=True)) <= 102
    reached, todo = {500}, [500]
    while todo:
        a = todo.pop()
        new = {b for b in bits if b not in reached and near(a, b)}
        reached |= new
        todo += new
    label = {x["doc_id"]: x["component_id"] for x in got}
    assert len(reached) > 150 and all(label[i] == i for i in label if i not in reached)
    assert sum(label[i] == label[500] for i in reached) >= 0.93 * len(reached)


@pytest.mark.parametrize("apart, least, distinct", [(82, 0.94, 1000), (82, 0.94, 10**7), (82, 0.94, 10**10), (102, 0.86, 1000)])
def test_pairs_are_found_alike_at_every_size(spark, apart, least, distinct):
    r = random.Random(distinct)
    rows = []
    for i in range(400):
        a = r.getrandbits(512)
        b = a
        for k in r.sample(range(512), apart):
            b ^= 1 << k
        for j, x in enumerate((a, b)):
            rows.append((2 * i + j, *(x >> 64 * k & 2**64 - 1 for k in range(8))))
    signed = [(i, *(x - 2**64 if x >= 2**63 else x for x in f)) for i, *f in rows]
    classes = spark.createDataFrame(signed, "rep long, " + ", ".join(f"f{k} long" for k in range(8)))
    got = {tuple(sorted((x["a"], x["b"]))) for x in simhash.wide_links(classes, 8, 102, distinct, Scratch(spark, "test"), aim=82).collect()}
    assert got <= {(2 * i, 2 * i + 1) for i in range(400)} and len(got) >= least * 400


def test_segments_are_apart_and_balls_complete(spark):
    for distinct in (2, 10**6, 10**7):
        s = simhash.segment_bits(distinct, 8, 82)
        assert len(set(s.ravel().tolist())) == s.size and s.max() < 512
    segments = simhash.segment_bits(10**6, 2, 20)[:3]
    one = spark.createDataFrame([(7, 5, -9)], "num long, f0 long, f1 long")
    got = {x["key"] for x in simhash.segment_entries(one, 2, segments, ["num"]).collect()}
    bit = lambda k: ((5, 2**64 - 9)[k // 64] >> k % 64) & 1
    want = set()
    for j, places in enumerate(segments.tolist()):
        value = sum(bit(k) << i for i, k in enumerate(places))
        want |= {(j << 40) | v for v in (value, *(value ^ (1 << i) for i in range(len(places))))}
    assert got == want


def test_groups_of_an_entry_as_by_brute_force(monkeypatch):
    r = np.random.default_rng(5)
    for pairs in (7, 10**6):
        monkeypatch.setattr(simhash, "PAIRS", pairs)
        for _ in range(30):
            n = int(r.integers(2, 60))
            base = r.integers(0, 2**64, (4, 3), np.uint64)
            prints = base[r.integers(0, 4, n)]
            for i in range(n):
                for k in r.integers(0, 192, r.integers(0, 30)):
                    prints[i, k // 64] ^= np.uint64(1 << int(k) % 64)
            want = list(range(n))
            for _ in range(n):
                for i in range(n):
                    for j in range(n):
                        if np.bitwise_count(prints[i] ^ prints[j]).sum() <= 24:
                            want[i] = want[j] = min(want[i], want[j])
            assert simhash.entry_groups(prints, 24).tolist() == want


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(200)] + [(300, 301), (301, 300), (5, 5)]
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(201)} | {300: 300, 301: 300}


def test_next_and_edited_texts(spark):
    rows = fixtures.odd_rows(3)
    order = sorted(((i is not None, i or 0, t or "") for i, t in rows), key=lambda x: x[:2])
    got = prefix.compare_with_edits(fixtures.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    keys, texts, following = sorted({x[:2] for x in order}), defaultdict(set), defaultdict(set)
    for x in order:
        texts[x[:2]].add(x[2])
    for x in order:  # rows with one id follow each other in some order
        following[x] |= texts[x[:2]] | texts[keys[(keys.index(x[:2]) + 1) % len(keys)]]
    for r in got:
        key = (r["doc_id"] is not None, r["doc_id"] or 0)
        fits = [(t, n) for (a, b, t), ns in following.items() if (a, b) == key for n in ns if prefix.edited(t, n) == r["edited_text"] and prefix.fingerprint(t) == r["fingerprint"]]
        assert fits and r["edited_fingerprint"] == prefix.fingerprint(r["edited_text"]) and r["n_chars"] == len(fits[0][0])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert prefix.compare_with_edits(fixtures.empty(spark)).count() == 0
    one = prefix.compare_with_edits(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one["edited_text"] == "abab" and one["near_next"] == 1.0


def test_null_and_hot_ids_fill_several_ranges(spark):
    """Every row once, ids in order, in one cycle, over more ranges than there are distinct ids."""
    rows = [(None, f"n{k}") for k in range(60)] + [(7, f"h{k}") for k in range(60)] + [(k, f"t{k}") for k in range(100, 130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bounds = prefix._bounds(docs, 8)
    assert len({i for i, _ in bounds if i is None}) == 1 and sum(i is None for i, _ in bounds) >= 3 and sum(i == 7 for i, _ in bounds) >= 3
    got = prefix.with_next(docs, "doc_id", "text").collect()
    by, ids = {r["text"]: r["next_text"] for r in got}, {t: i for i, t in rows}
    assert len(got) == len(rows) and by.keys() == set(by.values()) == ids.keys()
    start = next(t for t in by if ids[by[t]] is None and ids[t] is not None)
    seen, at = [], by[start]
    for _ in rows:
        seen.append(at)
        at = by[at]
    assert len(set(seen)) == len(rows) and [ids[t] is None for t in seen] == [True] * 60 + [False] * 90
    assert [ids[t] for t in seen[60:]] == sorted(ids[t] for t in seen[60:])


@settings(max_examples=100, deadline=None)
@given(st.text("ab", max_size=60), st.text("ab", max_size=60), st.text("abc", max_size=30))
def test_likeness_by_brute_force(head, tail, middle):
    a, b = head + tail, head + middle + tail
    p = next(k for k in range(len(a) + 1) if a[: k + 1] != b[: k + 1] or k == min(len(a), len(b)))
    s = next(k for k in range(len(a) + 1) if a[len(a) - k - 1 :] != b[len(b) - k - 1 :] or k == min(len(a), len(b)))
    step = lambda n: max([0, *(int(g) for g in prefix.GRID if g <= n)])
    want = 1.0 if a == b else min(step(p) + step(s), len(a), len(b)) / max(len(a), len(b))
    assert prefix.likeness(prefix.fingerprint(a), prefix.fingerprint(b)) == pytest.approx(want)


@settings(max_examples=60, deadline=None)
@given(st.text("abé😀", max_size=40), st.text("abé😀", max_size=40), st.data())
def test_common_extension(a, b, data):
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    k = 0
    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
        k += 1
    assert prefix.Prefixes(a).common_extension(i, prefix.Prefixes(b), j) == k
    assert (prefix.fingerprint(a) == prefix.fingerprint(b)) == (a == b)
    assert prefix.likeness(prefix.fingerprint(a), prefix.fingerprint(a)) == 1.0
