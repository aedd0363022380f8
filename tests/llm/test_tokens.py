"""Operators 2 and 7 against the tokenizer library and brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from reconspark.llm import bpe, packing, tokencount

from . import fixtures

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_the_library():
    library, own, r = Tokenizer.from_file(PATH), bpe.Ids(PATH), random.Random(3)
    signs = [*"ab é\n\t .,'s12 　ñ中\r😀\x1c\x85", "<|endoftext|>", "  ", "   ", "'ll", " ", " "]
    for _ in range(4000):
        s = "".join(r.choice(signs) for _ in range(r.randrange(24)))
        assert np.frombuffer(own.of(s), "<u4").tolist() == library.encode(s, add_special_tokens=False).ids, repr(s)


def test_long_runs_of_white_space_equal_the_library(spark):
    library, own = Tokenizer.from_file(PATH), bpe.Ids(PATH)
    same = lambda s: np.frombuffer(own.of(s), "<u4").tolist() == library.encode(s, add_special_tokens=False).ids
    for sign in ("\n", " ", "\t", "\xa0", "\r\n", " \n"):
        run = sign * (2_000_000 // len(sign))
        assert same(run)
    for run in ("\n" * 20_000, " " * 12_345, "\u3000 " * 9000):
        assert all(same(t) for t in (run, "a" + run + "b", "a" + run + "<|endoftext|>" + run, run + ".", "x " + run + "  y z" + run + "\x1c" + run))
    assert packing.pack(spark.createDataFrame([(1, "\n" * 2_000_000)], "doc_id long, text string")).agg({"length": "sum"}).first()[0] == len(library.encode("\n" * 2_000_000, add_special_tokens=False).ids) + 1


def test_pack_is_gapless_and_whole(spark):
    rows, library = fixtures.odd_rows(5), Tokenizer.from_file(PATH)
    got = packing.pack(fixtures.frame(spark, rows), with_ids=True).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % 1024 or min(len(ids), 1024)
        for k, (s, e) in enumerate([(0, head), *((s, s + 1024) for s in range(head, len(ids), 1024))]):
            want[i, k, s, e - s, zlib.crc32(ids[s:e].tobytes()), ids[s:e].tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 1024
    assert packing.pack(fixtures.empty(spark)).count() == 0


def test_plan_is_valid_and_tight():
    r = random.Random(8)
    for capacity in (7, 30, 1024):
        for _ in range(60):
            counts = {r.randrange(1, capacity + 1): r.randrange(1, 40) for _ in range(r.randrange(1, 40))}
            runs = packing.plan(counts, capacity)
            bins, ranks = {}, Counter()
            for length, rank, n, each, first, offset in runs:
                assert rank == ranks[length]
                ranks[length] += n
                for k in range(n):
                    bins.setdefault(first + k // each, []).append((offset + k % each * length, length))
            assert ranks == Counter(counts)
            for v in bins.values():
                v.sort()
                assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and sum(n for _, n in v) <= capacity
                assert sum(3 * n > capacity for _, n in v) <= 2
            total = sum(k * v for k, v in counts.items())
            assert len(bins) <= 11 / 9 * max(-(-total // capacity), sum(v for k, v in counts.items() if 2 * k > capacity)) * 1.25 + 2


def greedy(word, first, following):
    at = n = 0
    while at < len(word):
        known = following if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


def test_automaton_as_greedy():
    r = random.Random(5)
    for _ in range(600):
        some = lambda: {bytes(r.choice(b"abc") for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 9))}
        first, following = some(), some()
        automaton = tokencount.Automaton(first, following)
        for _ in range(10):
            w = "".join(r.choice("abc") for _ in range(r.randrange(1, 12)))
            assert automaton[w] == greedy(w.encode(), first, following)


def test_counts_of_texts(spark):
    rows = fixtures.odd_rows(6)
    tokens, _ = bpe.vocabulary(PATH)
    following = {t for t in tokens if not t.startswith(b" ")}
    first = following | {t[1:] for t in tokens if t.startswith(b" ")}
    want = Counter()
    for i, t in rows:
        n = [greedy(w.encode(), first, following) for w in tokencount.WORD.findall(t or "")]
        want[i, len(n), sum(n) + n.count(0), n.count(0)] += 1
    assert Counter(tuple(r) for r in tokencount.count_tokens(fixtures.frame(spark, rows)).collect()) == want
    assert tokencount.count_tokens(fixtures.empty(spark)).count() == 0
