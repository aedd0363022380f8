"""Operators 1, 8 and 10: held-out accuracy and odd rows; operator 6 against brute force."""

import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reconspark.llm import decontaminate, language, quality, toxicity
from reconspark.llm import queries as Q

from . import fixtures

SF = "/root/testdata/sf0.01"


def with_labels(spark, query, label):
    return query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("held_out", "score", "predicted", F.col(label).alias("y")).toPandas()


def auc(d):
    rank, p = d.score.rank(), d.y == 1
    return (rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


def test_quality_on_held_out_rows(spark):
    d = with_labels(spark, Q.op1_quality, "quality")
    held = d[d.held_out]
    assert auc(held) > 0.95 and (held.predicted == held.y).mean() > 0.93 and d.score.between(0, 1).all()


def test_context_and_edits_of_hits():
    """A quoted or reported insult scores below a direct one, an edited one between a clean text and the exact one; a far mark changes nothing."""
    model = toxicity.Toxicity(["idiot", "worthless", "clown*"], [6.0, 6.0, 6.0], [4.0, 4.0, 4.0], np.array([0.5, 0.6, 0.5]), -3.0, frozenset({"idiom"}))
    automaton = toxicity.Automaton(model.terms)
    score = lambda t: float(np.dot(toxicity.measure(t, automaton, model), model.weights) + model.bias)
    far = " ".join(f"w{chr(97 + k % 26)}" for k in range(60))
    assert score("you idiot") > score('he wrote on a wall: you idiot') > score('They used "you idiot" there') > score('He said "you idiot" there') > score("a stone")
    assert score("you idiot") > score("you idiott") > score("a stone") == score("an idiom") == score("") == score(None)
    assert score("you idiot, worthless clowns") > score("you idiot, wortless clowns") > score("you idiot")
    assert score(f'stray " mark {far} you idiot {far}') == score("you idiot") == score(f'"one" {far} you idiot {far} "two"')
    assert score('"one" you idiot "two"') == score("you idiot") and score("„du idiot“ ging") == score("« idiot » allait") < score("idiot")
    misspelled = lambda t: toxicity.measure(t, automaton, model, misspelled=True)
    assert misspelled("you idiot") == toxicity.measure("you idiott", automaton, model)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_score(text, model):
    """The score by its definition: every word against every term, every window by itself."""
    tokens, hits = re.findall(r"[^\W\d_]+|\s\"|[\"“”„«»‹›]", " " + (text or "").lower()), []
    for i, t in enumerate(tokens):
        best = None
        for k, term in enumerate(model.terms):
            stem, name = term.endswith("*"), term.rstrip("*")
            edits = min(distance(t[:n], name) for n in range(len(t) + 1)) if stem else distance(t, name)
            if edits <= toxicity.budget(len(name)):
                best = min(filter(None, (best, (edits, stem, k))))
        if best and not (best[0] and t in model.benign):
            w = (model.near if best[0] else model.exact)[best[2]]
            before = next((t2 for t2 in reversed(tokens[max(0, i - 20) : i]) if t2 in toxicity.OPENING | toxicity.CLOSING), "")
            after = next((t2 for t2 in tokens[i : i + 21] if t2 in toxicity.OPENING | toxicity.CLOSING), "")
            w *= 0.25 if before in toxicity.OPENING and after in toxicity.CLOSING else 1
            hits.append((i, w * (0.5 if set(tokens[max(0, i - 10) : i + 11]) & toxicity.REPORTING else 1)))
    total = sum(w for _, w in hits)
    dense = max((sum(w for j, w in hits if i <= j <= i + 20) for i, _ in hits), default=0)
    x = np.log1p(total) * model.weights[0] + max((w for _, w in hits), default=0) * model.weights[1] + np.log1p(dense) * model.weights[2] + model.bias
    return 1 / (1 + np.exp(-x))


def test_toxicity_by_brute_force(spark):
    """The learned model over texts with planted edits: the query's scores are those of the definition; misspelled insults are predicted."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn_toxicity(docs, labels)
    r, texts = random.Random(3), [None, "", "a stone", *(x["text"][:2000] for x in docs.orderBy("doc_id").limit(25).collect())]
    insults = [t for t in model.terms if not t.endswith("*") and len(t) >= 5]
    assert "clown" in insults and "worthless" in insults
    for term in insults:
        k = r.randrange(1, len(term))
        texts += [f"you {term[:k]}{term[k + 1:]} there", f"you {term[:k]}q{term[k:]}", f'he said "{term}" to me', f"the {term} and the {term}"]
    got = toxicity.score_toxicity(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    for x in got:
        assert x["score"] == pytest.approx(plain_score(x["text"], model), abs=1e-9)
    near = toxicity.score_toxicity(spark.createDataFrame([("you are a clwn",), ("worthles",), ("disgustng",), ("a stone",)], "text string"), model).collect()
    assert [x["score"] >= 0.7 for x in near] == [True, True, True, False]


def test_few_clean_rows_are_predicted_toxic(spark):
    """Held out, at ten times the rows: at most one label-0 row in a hundred, and most toxic ones."""
    sf = "/root/testdata/sf0.1"
    d = Q.op10_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    p = {x["toxic"]: x["p"] for x in d}
    assert p[0] < 0.01 and p[1] > 0.8


def test_an_id_of_many_texts_brings_no_more_rows(spark):
    from reconspark.llm.common import labelled_sample

    docs = spark.range(500).selectExpr("7L as doc_id", "concat('text ', id) as text").unionByName(spark.range(20).selectExpr("id as doc_id", "concat('other ', id) as text"))
    labels = spark.range(10).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    got = labelled_sample(docs, labels, "quality", 30, "doc_id", "text").collect()
    assert len(got) == 30 and len({x["id"] for x in got}) == 30
    assert labelled_sample(docs, labels, "quality", 1000, "doc_id", "text").count() == 510


def test_learned_weights_never_reward_a_hit():
    r = np.random.default_rng(4)
    x = r.random((300, 3))
    w, bias = toxicity.fit(x, (x[:, 0] - x[:, 1] + 0.1 * r.standard_normal(300) > 0).astype(float))
    assert w[0] > 1 and w[1] == 0 and (w >= 0).all() and np.isfinite(bias)


def test_words_of_copies_are_no_terms(spark):
    r = random.Random(2)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    family = prose(30) + " xylophone zephyr " + prose(30)
    rows = [(i, f"{prose(20)} idiot {prose(20)}", 1) for i in range(12)] + [(20 + i, f"{family} {prose(1)} xylophone", 1) for i in range(12)] + [(40 + i, prose(40), 0) for i in range(60)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")
    terms = toxicity.learn_toxicity(docs, labels).terms
    assert any("idiot".startswith(t.rstrip("*")) for t in terms) and not any("zephyr".startswith(t.rstrip("*")) for t in terms)


def test_attention_gradient():
    r = np.random.default_rng(0)
    x, first, y = r.random((9, quality.FEATURES)).astype(np.float32), np.array([0, 2, 3]), np.array([1, 0, 1], np.float32)
    m = quality.Attention.new()
    m.parts = {k: v.astype(np.float64) for k, v in m.parts.items()}
    loss = lambda: -np.mean(y * np.log(f := m.forward(x, first)["y"]) + (1 - y) * np.log(1 - f))
    g = m.gradient(x, first, y)
    for k in m.parts:
        i = np.unravel_index(r.integers(m.parts[k].size), m.parts[k].shape)
        m.parts[k][i] += 1e-5
        up = loss()
        m.parts[k][i] -= 2e-5
        down = loss()
        m.parts[k][i] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(g[k][i], abs=1e-4)


def test_language_on_held_out_rows(spark):
    d = Q.op8_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = d[d.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and d.score.between(0, 1).all()


def test_toxicity_on_held_out_rows(spark):
    d = with_labels(spark, Q.op10_toxicity, "toxic")
    held = d[d.held_out]
    assert auc(held) > 0.85 and (held.predicted == held.y).mean() > 0.95 and d.score.between(0, 1).all()


def test_odd_rows(spark):
    rows = fixtures.odd_rows(7)
    df, none = fixtures.frame(spark, rows), fixtures.empty(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8, 60)] + [(9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.learn_quality(df, labels)
    for m in (model, quality.learn_quality(none, labels.limit(0))):
        got = quality.score_quality(df, m).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["passages"] >= 1 for r in got)
    assert quality.score_quality(none, model).count() == 0
    tox = toxicity.learn_toxicity(df, labels)
    for m in (tox, toxicity.learn_toxicity(none, labels.limit(0))):
        got = toxicity.score_toxicity(df, m).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_toxicity(none, tox).count() == 0
    protos = language.learn(df)
    got = {r["doc_id"]: r for r in language.identify(df, protos).collect()}
    assert {got[i]["lang_pred"] for i in (0, 1, 2, 6)} == {"und"} and got[3]["lang_pred"] == "en" and set(df.columns) - {"score"} < set(language.identify(df, protos).columns)
    assert language.learn(none) == {} and {r["lang_pred"] for r in language.identify(df, {}).collect()} == {"und"}
    assert language.identify(none, protos).count() == 0


def test_grams_by_table_and_by_sorting_agree():
    few, many = language.Grams(64), language.Grams(64)
    texts = [language.letters("Abc abd, été"), language.letters("abc")]
    many._number(np.arange(0x4E00, 0x4E00 + 200))  # so many letters that trigrams are sorted
    a, b = few.bundled(texts), many.bundled(texts)
    assert np.allclose(a, b)


def test_profiles_by_brute_force_in_slices_and_parts(monkeypatch):
    """The sum of bound trigrams, however texts are sliced; a repeated run with small bounds drops no trigram."""
    texts = ["Été, le 3 mai: déjà", "中文和日本語が混じる文 中文", "x", "the then there " * 9]
    want = []
    for t in texts:
        x, total = language.letters(t), np.zeros(64)
        for i in range(len(x) - 2):
            v = [language.letter_vector(int(c), 64) for c in x[i : i + 3]]
            total += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        want.append(total)
    for slice_, most in ((16_384, 60_000), (3, 5)):
        monkeypatch.setattr(language, "SLICE", slice_)
        monkeypatch.setattr(language, "MOST_GRAMS", most)
        grams = language.Grams(64)
        for _ in range(2):
            assert np.allclose(grams.bundled([language.letters(t) for t in texts]), want)
    plain = language.letters("ab 中!! d" * 40)
    monkeypatch.setattr(language, "BLOCK_CHARS", 7)
    assert (language.letters("ab 中!! d" * 40) == plain).all()


def test_profile_of_a_long_text_of_many_letters_is_bounded():
    """Two million random Chinese letters, nearly all trigrams distinct: below 1 GB in a process of its own."""
    code = (
        "import resource, numpy as np, pyarrow as pa; from reconspark.llm import language as L;"
        "t = ''.join(map(chr, np.random.default_rng(1).integers(0x4E00, 0x9FA5, 2_000_000)));"
        "g = L.Grams(1024); b = pa.RecordBatch.from_arrays([pa.array([t])], names=['t']);"
        "own = sum(g.bundled(held) for _, held, _ in L._blocks(b, 0)); assert np.abs(own).sum() > 0;"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300)
    assert int(out.stdout.split()[-1]) < 1024


def _next(before, i, x, b):
    row = [i]
    for j, y in enumerate(b, 1):
        row.append(min(before[j - 1] + (x != y), before[j] + 1, row[-1] + 1))
    return row


def test_near_terms_are_met_by_the_automaton():
    terms, r = ["idiot", "worthless", "clown*", "bad"], random.Random(3)
    automaton = toxicity.Automaton(terms)
    for _ in range(3000):
        t = r.choice(terms).rstrip("*")
        w = list(t + r.choice(["", "", "xyz"]))
        for _ in range(r.randrange(4)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randrange(2)] = r.choice(["", "q", "i"])
        w = "".join(w)
        words = [(0, d) for x in terms if not x.endswith("*") and (d := distance(x, w)) <= toxicity.budget(len(x))]
        stems = [(1, d) for x in terms if x.endswith("*") and (d := min(distance(x[:-1], w[:k]) for k in range(len(w) + 1))) <= toxicity.budget(len(x) - 1)]
        best = min(words + stems, key=lambda x: (x[1], x[0]), default=None)
        assert (automaton[w] and automaton[w][:2]) == best, w


def test_contamination_as_by_brute_force(spark):
    r = random.Random(9)
    word = lambda: f"w{r.randrange(60)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 3, 5, 8, 20, 40, 70])] + [(90, None), (91, " ,. "), (4, "w1 w2 w3 w4 w5 w6")]
    rows = [(0, None), (1, ""), (2, "w1")]
    for i in range(3, 40):
        t = (items[r.randrange(7)][1]).split()
        for _ in range(r.randrange(1 + len(t) // 3)):
            k = r.randrange(len(t) + 1)
            t[k : k + r.randrange(2)] = r.choice([[], [word()]])
        rows.append((i, " ".join([word() for _ in range(r.randrange(30))] + t + [word() for _ in range(r.randrange(30))]).upper()))
    rows.append(rows[10])
    got = decontaminate.contaminated(fixtures.frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), items_at_once=3)
    cut = lambda t: re.findall(r"\w+", (t or "").lower())
    want = Counter()
    for i, t in rows:
        for k, item in items:
            p, best = cut(item), None
            row = [0] * (len(cut(t)) + 1)
            for n, x in enumerate(p, 1):
                row = _next(row, n, x, cut(t))
            best = min(row)
            if p and best <= int(0.2 * len(p) + 1e-9):
                want[i, k, best] += 1
    found = got.collect()
    assert Counter((x["doc_id"], x["item_id"], x["distance"]) for x in found) == want
    by = dict(rows)
    for x in found:
        stretch = cut(by[x["doc_id"]])[x["first_word"] : x["first_word"] + x["n_words"]]
        assert x["distance"] in [distance(cut(t), stretch) for k, t in items if k == x["item_id"]]
    assert decontaminate.contaminated(fixtures.empty(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0
