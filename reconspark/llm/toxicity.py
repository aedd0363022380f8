"""Toxicity from Levenshtein automata intersected with a lexicon trie, weighed in context.

The lexicon is learned from labelled documents: whole words, and stems that stand for all words starting with them. A
word of a text runs through the product of the lexicon's trie and the Levenshtein automata of its terms; the product is
made deterministic only as far as texts need it, so a common word costs a step for each of its first letters. A hit is worth
what its term tells of the label; a misspelled one what is left of that once the other words so near the term are counted. Each is
weighed by its window before hits are added up: in quotation marks and beside a word that reports what others say it counts
less. A document's score never falls with a hit more, an edit less, or a quotation mark less.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reconspark.llm.common import Scratch, labelled_sample, unused

TOKEN = re.compile(r"[^\W\d_]+|\s\"|[\"“”„«»‹›]")
#: A straight mark after white space opens, any other closes; a high one at the left of a word closes what a low one opened.
OPENING, CLOSING = frozenset([*(f'{c}"' for c in " \t\n\r\f\v\xa0"), *"“„«‹"]), frozenset('"”“»›')
#: Words that report what others say, in the languages of the corpus.
REPORTING = frozenset("said says wrote quoted quote called calling word term dijo palabra llamó wort sagte nannte dit mot appelé".split())
STEMS, WINDOW, MOST_KEPT = range(4, 8), 20, 500_000
#: What quotation marks and a reporting word leave of a hit's weight.
QUOTED, REPORTED = 0.25, 0.5
FEATURES = ("sum", "strongest", "dense")
#: Label-1 documents that hold a term, and different words that stand before it in them, at least; their share of all that hold it;
#: and the number of terms that chance may bring in, over all candidates together.
LEAST, PRECISION, BY_CHANCE = 4, 0.8, 0.05


def budget(length: int) -> int:
    """Edits allowed to a term of this length."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Automaton(dict):
    """word -> (0 whole word or 1 stem, edits, number of the term) of its best term, or None. Terms ending in * are stems."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, int, int]]] = [[]]
        self.most = [0]
        for number, term in enumerate(terms):
            stem, text, at = term.endswith("*"), term.rstrip("*"), 0
            self.most[0] = max(self.most[0], budget(len(text)))
            for c in text:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(0)
                at = self.children[at][c]
                self.most[at] = max(self.most[at], budget(len(text)))
            self.ends[at].append((int(stem), budget(len(text)), number))
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> tuple[frozenset, dict, tuple | None, tuple | None]:
        """(pairs of node and edits, steps, best whole word if the text ends here, best stem reached here)."""
        todo, all_ = list(pairs), set(pairs)
        while todo:  # a letter of the term may be missing
            node, edits = todo.pop()
            for child in self.children[node].values():
                pair = (child, edits + 1)
                if pair[1] <= self.most[child] and pair not in all_:
                    all_.add(pair)
                    todo.append(pair)
        word = min(((0, e, k) for n, e in all_ for s, most, k in self.ends[n] if not s and e <= most), default=None)
        stem = min(((1, e, k) for n, e in all_ for s, most, k in self.ends[n] if s and e <= most), default=None)
        return frozenset(all_), {}, word, stem

    def _step(self, state: tuple, letter: str) -> tuple | None:
        out = set()
        for node, edits in state[0]:
            if edits < self.most[node]:
                out.add((node, edits + 1))
            for c, child in self.children[node].items():
                e = edits + (c != letter)
                if e <= self.most[child]:
                    out.add((child, e))
        if not out:
            return None
        key = frozenset(out)
        if key not in self.states:
            self.states[key] = self._state(out)
        return self.states[key]

    def __missing__(self, word: str) -> tuple[int, int, int] | None:
        if not hasattr(self, "states") or len(self.states) > 100_000:
            self.states: dict = {}
            self.start = self._state({(0, 0)})
        if len(self) > MOST_KEPT:
            self.clear()
        state, stem = self.start, None
        for letter in word:
            if letter not in state[1]:
                state[1][letter] = self._step(state, letter)
            state = state[1][letter]
            if state is None:
                break
            if state[3] and (stem is None or state[3] < stem):
                stem = state[3]
        found = [x for x in (state[2] if state else None, stem) if x]
        self[word] = out = min(found, key=lambda x: (x[1], x[0], x[2]), default=None)
        return out


@dataclass
class Toxicity:
    """Terms, what a hit of each is worth exact and misspelled, weights of FEATURES, and words that are no misspelled terms."""

    terms: list[str] = field(default_factory=list)
    exact: list[float] = field(default_factory=list)
    near: list[float] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    bias: float = -3.0
    benign: frozenset[str] = frozenset()


def weigh(tokens: list[str], automaton: Automaton, model: Toxicity, misspelled: bool = False) -> list[tuple[int, float]]:
    """(place, weight) of each hit. A hit is quoted if, within WINDOW tokens, the last mark before it opens and the next one closes; it
    is reported if a reporting word stands within half a window. misspelled: as if each hit had an edit (words too short for one are none)."""
    hits = [(i, h[1], h[2]) for i, t in enumerate(tokens) if (h := automaton[t]) and not (h[1] and t in model.benign)]
    if misspelled:
        hits = [(i, 1, k) for i, _, k in hits if budget(len(tokens[i]))]
    if not hits:
        return []
    marks = np.array([i for i, t in enumerate(tokens) if t in OPENING or t in CLOSING], np.int64)
    cues = np.array([i for i, t in enumerate(tokens) if t in REPORTING], np.int64)
    out = []
    for i, edits, number in hits:
        weight, k = (model.near if edits else model.exact)[number], int(np.searchsorted(marks, i))
        if 0 < k < len(marks) and i - marks[k - 1] <= WINDOW and marks[k] - i <= WINDOW and tokens[marks[k - 1]] in OPENING and tokens[marks[k]] in CLOSING:
            weight *= QUOTED
        near = np.searchsorted(cues, [i - WINDOW // 2, i + WINDOW // 2 + 1])
        out.append((i, weight * REPORTED if near[1] > near[0] else weight))
    return out


def measure(text: str | None, automaton: Automaton, model: Toxicity, misspelled: bool = False) -> list[float]:
    """FEATURES of a text: logarithm of the sum of its hits' weights, the largest weight, logarithm of the largest sum in a window."""
    hits = weigh(TOKEN.findall(" " + text.lower()), automaton, model, misspelled) if text else []
    if not hits:
        return [0.0] * len(FEATURES)
    at, w = np.array([i for i, _ in hits]), np.array([x for _, x in hits])
    total = np.concatenate([[0.0], np.cumsum(w)])
    dense = (total[np.searchsorted(at, at + WINDOW, "right")] - total[:-1]).max()
    return [float(np.log1p(w.sum())), float(w.max()), float(np.log1p(dense))]


def choose(good: dict[str, int]) -> list[str]:
    """Terms, from the number of documents with label 1 of each candidate: without stems that a longer form explains, and
    without what a chosen stem covers."""
    longer: dict[str, int] = defaultdict(int)
    for t, p in good.items():
        stem, whole = t.rstrip("*"), not t.endswith("*")
        for k in {len(stem) - 1, min(len(stem), STEMS[-1])} if whole else {len(stem) - 1}:
            longer[stem[:k] + "*"] = max(longer[stem[:k] + "*"], p)
    chosen: list[str] = []
    stems: set[str] = set()
    for t in sorted((t for t, p in good.items() if not (t.endswith("*") and longer[t] >= 0.95 * p)), key=lambda t: (len(t.rstrip("*")), not t.endswith("*"), t)):
        text = t.rstrip("*")
        if not any(text[:k] in stems for k in STEMS if k <= len(text)):
            chosen.append(t)
            if t.endswith("*"):
                stems.add(text)
    return chosen


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 3000) -> tuple[np.ndarray, float]:
    """Logistic regression with weights that are not negative, by projected gradient steps: a hit never makes a text cleaner."""
    w, bias = np.zeros(x.shape[1]), 0.0
    scale = np.maximum(x.max(0), 1e-9)
    x, rate = x / scale, 4.0 / (1 + x.shape[1])
    for _ in range(steps):
        g = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30))) - y
        w = np.maximum(w - rate * (x.T @ g / len(y) + ridge * w), 0)
        bias -= rate * g.mean()
    return w / scale, float(bias)


def _forms(word: str) -> list[str]:
    """A word and its stems, as candidates."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)] if len(word) >= 3 else []


def beyond_chance(share: float, candidates: int) -> F.Column:
    """True where yes of yes + no is so far above this share that chance brings in less than BY_CHANCE of so many candidates (Chernoff's bound)."""
    n = F.col("yes") + F.col("no")
    q = F.col("yes") / n
    rest = F.when(q < 1, (1 - q) * F.ln((1 - q) / F.lit(1 - share))).otherwise(0.0)
    return (q > share) & (n * (q * F.ln(q / F.lit(share)) + rest) >= float(np.log(max(1, candidates) / BY_CHANCE)))


def learn_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 8000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Toxicity:
    """Fits on at most `sample` labelled rows, equal texts once: see labelled_sample.

    Counts of words and stems are added up by Spark. A term's share of label 1 must be beyond chance, however many candidates there
    are, and it must stand after LEAST different words, since words that only copies of one document share always have the
    same neighbours. An exact hit is worth the logarithm of the term's odds against those of all rows; a misspelled one
    the same with the label-0 rows that hold a neighbour of the term counted against it. The terms and the near hits of the sample reach the
    driver. A near hit that a label-0 row of the sample holds is a word of its own, not a misspelled term. The weights are fitted on
    the rows and on copies of the label-1 rows with every hit misspelled; a row is measured by what the others tell of its terms, and each half of the rows with the words of the other half, so near hits by accident are as frequent as they will be in new texts. Without labelled documents, or with one label only, the lexicon is empty and every score low.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.save(labelled_sample(docs, labels, label_col, sample, id_col, text_col), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = (Counter(), Counter())
            for t, label in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                seen[label > 0].update({f for w in set(TOKEN.findall((t.as_py() or "").lower())) for f in _forms(w)})
            terms = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())], names=["term", "yes", "no"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [TOKEN.findall((t.as_py() or "").lower()) for t in b.column(0)]
            found = list({(f, before) for t in tokens for before, w in zip(["", *t], t, strict=False) for f in _forms(w)})
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)] or [pa.array([], pa.string())] * 2, names=["term", "before"])

    model, all_rows = Toxicity(), rows.agg(F.count("*"), F.count_if(F.col("label") > 0)).first()
    if 0 < all_rows[1] < all_rows[0]:
        total = rows.select("text", "label").mapInArrow(count, "term string, yes long, no long").groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        total = scratch.save(total.where((F.col("yes") + F.col("no")) >= LEAST), "terms")
        told = total.where((F.col("yes") >= LEAST) & (F.col("yes") / (F.col("yes") + F.col("no")) >= PRECISION) & beyond_chance(all_rows[1] / all_rows[0], total.count()))
        held = rows.where("label > 0").select("text").mapInArrow(places, "term string, before string").join(told, "term")
        free = held.groupBy("term").agg(F.first("yes").alias("yes"), F.first("no").alias("no"), F.count_distinct("before").alias("ways")).where(F.col("ways") >= LEAST)
        found = {r["term"]: (r["yes"], r["no"]) for r in free.collect()}
        model.terms = choose({t: yes for t, (yes, _) in found.items()})
    if model.terms:
        half = F.pmod("id", F.lit(2)).cast("int")
        near = _neighbours(rows.where(F.col("label") == 0).select(half.alias("half"), "text"), model.terms)
        words, beside = (set(), set()), [0] * len(model.terms)
        for word, number, h, n in near:
            words[h].add(word)
            beside[number] += n
        prior = (all_rows[0] - all_rows[1] + 0.5) / (all_rows[1] + 0.5)

        def worth(label: int | None = None) -> dict[str, list[float]]:
            """For new texts, or for a row of the sample with this label: what its terms are worth by the other rows."""
            odds = lambda yes, no: max(0.0, float(np.log((max(0, yes - (label == 1)) + 0.5) / (max(0, no - (label == 0)) + 0.5) * prior)))
            return {"exact": [odds(*found[t]) for t in model.terms], "near": [odds(found[t][0], found[t][1] + n) for t, n in zip(model.terms, beside, strict=True)]}

        measured = []
        for h in (0, 1):
            for label, misspelled in ((0, False), (1, False), (1, True)):
                own = replace(model, benign=frozenset(words[1 - h]), **worth(label))
                part = rows.where((half == h) & ((F.col("label") > 0) == F.lit(label > 0)))
                measured += _measured(part.select("id", "label", "text"), own, ["id", "label"], misspelled).collect()
        model = replace(model, **worth())
        measured.sort(key=lambda r: tuple(r))
        model.benign = frozenset(words[0] | words[1])
        model.weights, model.bias = fit(np.array([r["features"] for r in measured]), np.array([r["label"] > 0 for r in measured], float))
    scratch.keep()
    return model


def _neighbours(rows: DataFrame, terms: list[str]) -> list[tuple[str, int, int, int]]:
    """rows(half, text) -> (word, number of its term, half, rows that hold it) of each near hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(terms)
        for b in batches:
            near = [(w, h[2], half) for half, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for w in sorted(set(TOKEN.findall((t.as_py() or "").lower()))) if (h := automaton[w]) and h[1]]
            columns = [pa.array(c, k) for c, k in zip(zip(*near, strict=True), (pa.string(), pa.int32(), pa.int32()), strict=True)] if near else [pa.array([], k) for k in (pa.string(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "number", "half"])

    counted = rows.mapInArrow(run, "word string, number int, half int").groupBy("word", "number", "half").count()
    return sorted(tuple(r) for r in counted.collect())


def _measured(docs: DataFrame, model: Toxicity, kept: list[str], misspelled: bool = False) -> DataFrame:
    """docs(kept..., text) -> kept..., features."""
    schema = T.StructType([*docs.select(*kept).schema.fields]).add("features", T.ArrayType(T.DoubleType()))
    out = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(model.terms)
        for b in batches:
            found = [measure(t.as_py(), automaton, model, misspelled) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.float64()))], names=out)

    return docs.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, model: Toxicity, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: all) with score: the chance of label 1, and hits: whether the lexicon has a hit.

    Whole texts are scored; null and empty ones have no hit. Columns of these names are replaced.
    """
    kept = (docs.select(*keep) if keep else docs).drop("score", "hits", "features")
    t_ = unused(docs, "__text")
    source = docs.withColumn(t_, F.col(text_col).cast("string")).select(*kept.columns, t_)
    sums = sum((F.get("features", F.lit(i)) * F.lit(float(w)) for i, w in enumerate(model.weights)), F.lit(model.bias))
    return _measured(source, model, kept.columns).select(*kept.columns, (1 / (1 + F.exp(-sums))).alias("score"), (F.get("features", F.lit(1)) > 0).alias("hits"))
