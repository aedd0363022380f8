"""Quality by attention-based multiple-instance learning.

A document is a bag of passages, and only the document has a label. Each passage is encoded, a gated attention unit
weighs the passages, and the weighted sum of their codes is scored. The three parts are learned together from document
labels, so a document is judged by those of its passages that tell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reconspark.llm.common import labelled_sample, unused

PASSAGE_BYTES, BLOCK_BYTES, TRAINING_PASSAGES = 512, 2_000_000, 64
#: Kinds of bytes: lower case, upper case, digit, space, line end, and signs by use; then UTF-8 lead and following bytes.
KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", ".", ",", "!?", "|", "\"'()[]{}<>", "#$%&*@^~", "-_/\\:;=+`", "\t\v\f"]
LEAD, FOLLOW, OTHER, WIDTH = 13, 14, 15, 16


def byte_kinds() -> np.ndarray:
    kinds = np.full(256, OTHER, np.int64)
    for k, signs in enumerate(KINDS):
        kinds[list(signs.encode())] = k
    kinds[0x80:0xC0], kinds[0xC0:] = FOLLOW, LEAD
    return kinds


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features: passage x 258, first passage of each text). Every text has a passage at least; passages cover it whole.

    A passage's features are the square roots of the shares of its pairs of neighbouring byte kinds, the share of its
    words that it has more than once, and its length against a full passage.
    """
    kinds, raw = byte_kinds(), [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw])
    many = np.maximum(1, -(-sizes // PASSAGE_BYTES))
    first = np.cumsum(many) - many
    k = kinds[np.frombuffer(b"".join(raw), np.uint8)]
    starts = np.cumsum(sizes) - sizes
    at = np.arange(len(k)) - np.repeat(starts, sizes)
    passage = np.repeat(first, sizes) + at // PASSAGE_BYTES
    inner = at + 1 < np.repeat(sizes, sizes)
    here = np.flatnonzero(inner)
    pairs = np.bincount(passage[here] * WIDTH**2 + k[here] * WIDTH + k[here + 1], minlength=many.sum() * WIDTH**2).reshape(-1, WIDTH**2).astype(np.float32)
    length = np.bincount(passage, minlength=many.sum())
    again = np.zeros(many.sum(), np.float32)
    for r, f, m in zip(raw, first, many, strict=True):
        for j in range(m):
            w = r[j * PASSAGE_BYTES : (j + 1) * PASSAGE_BYTES].split()
            again[f + j] = 1 - len(set(w)) / len(w) if w else 0
    out = np.sqrt(pairs / np.maximum(pairs.sum(1, keepdims=True), 1))
    return np.hstack([out, again[:, None], (length / PASSAGE_BYTES).astype(np.float32)[:, None]]), first


FEATURES = WIDTH**2 + 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Attention:
    """Passage code h = tanh(E x + e); attention softmax of w (tanh(V h) * sigmoid(U h)); score sigmoid(c z + b), z the weighted sum of h."""

    parts: dict[str, np.ndarray]

    @staticmethod
    def new(features: int = FEATURES, code: int = 32, gate: int = 16, seed: int = 7) -> Attention:
        r = np.random.Generator(np.random.PCG64(seed))
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        return Attention({"E": g(features, code) * 3, "e": np.zeros(code, np.float32), "V": g(code, gate), "U": g(code, gate), "w": g(gate), "c": g(code), "b": np.zeros(1, np.float32)})

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.parts
        many = np.diff(np.append(first, len(x)))
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (v * u) @ p["w"]
        a = np.exp(s - np.repeat(np.maximum.reduceat(s, first), many))
        a /= np.repeat(np.add.reduceat(a, first), many)
        z = np.add.reduceat(a[:, None] * h, first)
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "many": many, "y": _sigmoid(z @ p["c"] + p["b"])}

    def gradient(self, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.parts, self.forward(x, first)
        d = ((f["y"] - label) / len(label)).astype(np.float32)
        dz = np.repeat(d[:, None] * p["c"], f["many"], 0)
        da = (dz * f["h"]).sum(1)
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), f["many"]))
        dv, du = ds[:, None] * p["w"] * f["u"] * (1 - f["v"] ** 2), ds[:, None] * p["w"] * f["v"] * f["u"] * (1 - f["u"])
        dh = (f["a"][:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ ds, "c": f["z"].T @ d, "b": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, first: np.ndarray, label: np.ndarray, epochs: int = 25, least: int = 600, batch: int = 128, rate: float = 4e-3, decay: float = 1e-5, seed: int = 11) -> Attention:
        """Adam over batches of whole bags; few bags are gone through more often, so that the steps are at least `least`."""
        batch = min(batch, max(16, len(first) // 8))
        epochs = max(epochs, -(-least * batch // len(first)))
        r, ends = np.random.Generator(np.random.PCG64(seed)), np.append(first, len(x))
        m, q, t = {k: 0 * v for k, v in self.parts.items()}, {k: 0 * v for k, v in self.parts.items()}, 0
        for epoch in range(epochs):
            order, now = r.permutation(len(first)), rate * (1 - epoch / epochs)
            for at in range(0, len(order), batch):
                bags = order[at : at + batch]
                many = ends[bags + 1] - ends[bags]
                own = np.cumsum(many) - many
                rows = np.repeat(ends[bags] - own, many) + np.arange(many.sum())
                t += 1
                for k, g in self.gradient(x[rows].astype(np.float32), own, label[bags]).items():
                    g = g + decay * self.parts[k]
                    m[k], q[k] = 0.9 * m[k] + 0.1 * g, 0.999 * q[k] + 0.001 * g * g
                    self.parts[k] = (self.parts[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(q[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def learn_quality(docs: DataFrame, labels: DataFrame, sample: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Attention:
    """Fits on at most `sample` labelled rows, equal texts once: see labelled_sample.

    For fitting alone, at most TRAINING_PASSAGES evenly spaced passages of a text are taken; scoring reads all. An id with several
    texts labels each of them. Rows with a null label are left out. Without labelled documents the model is the untrained one.
    """
    rows = labelled_sample(docs, labels, label_col, sample, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1):
                x, _ = encode([t.as_py()])
                pick = np.unique(np.linspace(0, len(x) - 1, min(len(x), TRAINING_PASSAGES)).astype(int))
                out.append(x[pick].astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), pa.array(out, pa.binary())], names=["id", "label", "x"])

    bags = sorted(rows.mapInArrow(run, "id long, label int, x binary").collect(), key=lambda r: (r["id"], r["label"], bytes(r["x"])))
    model = Attention.new()
    if not bags:
        return model
    x = [np.frombuffer(r["x"], np.float16).reshape(-1, FEATURES) for r in bags]
    many = np.array([len(v) for v in x])
    return model.fit(np.vstack(x), np.cumsum(many) - many, np.array([r["label"] for r in bags], np.float32))


def score_quality(docs: DataFrame, model: Attention, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: all) with score: the chance of label 1, and passages: how many were weighed.

    Whole texts are scored; null and empty ones are a bag of one empty passage. Columns of these names are replaced.
    """
    kept = (docs.select(*keep) if keep else docs).drop("score", "passages")
    schema = T.StructType([*kept.schema.fields]).add("score", "double").add("passages", "long")
    out = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, passages, block, size = [], [], [], 0
            texts = b.column(b.num_columns - 1).to_pylist()
            for i, t in enumerate(texts):
                block.append(t)
                size += len(t or "")
                if size > BLOCK_BYTES or i == len(texts) - 1:
                    x, first = encode(block)
                    f = model.forward(x, first)
                    score.append(f["y"].astype(np.float64))
                    passages.append(f["many"])
                    block, size = [], 0
            if texts:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(score)), pa.array(np.concatenate(passages).astype(np.int64))], names=out)

    t_ = unused(docs, "__text")
    return docs.withColumn(t_, F.col(text_col).cast("string")).select(*kept.columns, t_).mapInArrow(run, schema)
