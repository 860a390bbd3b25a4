"""Operator 4, a quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of `WORDS` words. Each passage is encoded from the shares of kinds of characters in
it and the variety and length of its words, through a tanh layer; gated attention (tanh and sigmoid layers, multiplied)
weighs the passages, and the weighted mean of their encodings gives the document's logit. Everything is learnt from
document labels by Adam on the cross-entropy, weighed so that the sampled classes count as in all labels.

The labelled rows to learn from are a bounded sample (`per_class` ids of each class at most). Every passage of
every text is scored. Only the text enters a score. A text without words (or null) is one passage of mean encoding
input. Without labels of both classes every score is the share of label 1, or 0.5 with no label at all. Repeated
rows get a score each; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from verdict.llm.common import labelled_sample

WORDS = 64
#: Kinds of bytes by ASCII value: 0 other symbols, 1 small, 2 capital, 3 digit, 4 white space, 5 full stop or comma,
#: 6 other sentence punctuation, 7 beyond ASCII.
_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[32, 9, 10, 11, 12, 13]], _KIND[128:] = 1, 2, 3, 4, 7
_KIND[[ord(c) for c in ".,"]], _KIND[[ord(c) for c in "!?;:'\"()-"]] = 5, 6
_KINDS, FEATURES = 8, 14


def passages(text: str | None) -> np.ndarray:
    """The features of a text's passages, one row each; a text without words has none."""
    raw = (text or "").encode()
    words = raw.lower().split()
    if not words:
        return np.zeros((0, FEATURES), np.float32)
    kinds = _KIND[np.frombuffer(raw, np.uint8)]
    space = kinds == 4
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    edges = np.append(starts[::WORDS], len(raw))
    n = len(edges) - 1
    lengths = np.diff(edges)
    own = kinds[edges[0] :].astype(np.int64) + np.repeat(np.arange(n) * _KINDS, lengths)
    counts = np.bincount(own, minlength=n * _KINDS).reshape(n, _KINDS)
    out = np.empty((n, FEATURES), np.float32)
    out[:, :_KINDS] = np.sqrt(counts / lengths[:, None])
    for i in range(n):
        part = words[i * WORDS : (i + 1) * WORDS]
        k, distinct = len(part), len(set(part))
        repeats = sum(map(bytes.__eq__, part, part[1:]))
        out[i, 8:] = distinct / k, repeats / k, np.log(k), lengths[i] / k / 10, (k - distinct) / k * np.log(k), out[i, 6] * out[i, 2]
    return out


class Attention:
    """The parameters of the model, its score of bags of passages and its training."""

    def __init__(self, hidden: int = 16, gate: int = 8, seed: int = 1):
        draw = np.random.default_rng(seed).normal
        shape = {"W": (FEATURES, hidden), "w": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "a": (gate,), "c": (hidden,), "b": (1,)}
        self.p = {k: draw(0, 0.3, s) if k not in "wb" else np.zeros(s) for k, s in shape.items()}
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.constant: float | None = None

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        """x: passages of all bags, bag after bag; first: where each bag begins."""
        p, counts = self.p, np.diff(np.append(first, len(x)))
        bag = np.repeat(np.arange(len(first)), counts)
        h = np.tanh(x @ p["W"] + p["w"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        s = (t * g) @ p["a"]
        e = np.exp(s - np.maximum.reduceat(s, first)[bag])
        attention = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(attention[:, None] * h, first)
        logit = np.clip(z @ p["c"] + p["b"], -30, 30)
        return {"h": h, "t": t, "g": g, "attention": attention, "z": z, "bag": bag, "score": 1 / (1 + np.exp(-logit))}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rounds: int = 400, rate: float = 0.02, batch: int = 200, seed: int = 2) -> Attention:
        if len(set(y.tolist())) < 2:
            self.constant = float(y[0]) if len(y) else 0.5
            return self
        whole = np.concatenate(bags)
        if len(whole):
            self.mean, self.scale = whole.mean(0), whole.std(0) + 1e-3
        draw = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for i in range(1, rounds + 1):
            own = draw.choice(len(bags), min(batch, len(bags)), replace=False)
            x, first = self.packed([bags[k] for k in own])
            pace = rate * (1 - 0.9 * i / rounds)
            for k, g in self.gradients(x, first, y[own], weight[own] / weight[own].sum()).items():
                g = g + 1e-4 * self.p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                self.p[k] = self.p[k] - pace * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)
        return self

    def gradients(self, x, first, y, weight) -> dict[str, np.ndarray]:
        """Of the weighted cross-entropy by each parameter."""
        p, f = self.p, self.forward(x, first)
        d = (f["score"] - y) * weight
        dz = d[:, None] * p["c"]
        on = dz[f["bag"]]
        gain = (on * f["h"]).sum(1)
        ds = f["attention"] * (gain - np.add.reduceat(f["attention"] * gain, first)[f["bag"]])
        dt, dg = ds[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * p["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["attention"][:, None] * on + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ dh, "w": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ d, "b": d.sum(keepdims=True)}

    def packed(self, bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Standardised passages of all bags and where each bag begins; an empty bag has one mean passage."""
        rows = [(b - self.mean) / self.scale if len(b) else np.zeros((1, FEATURES)) for b in bags]
        return np.concatenate(rows), np.cumsum([0, *map(len, rows[:-1])])

    def score(self, bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The score of each bag, and which of its passages weighs most."""
        if not bags:
            return np.zeros(0), np.zeros(0, int)
        x, first = self.packed(bags)
        f = self.forward(x, first)
        most = [int(part.argmax()) for part in np.split(f["attention"], first[1:])]
        return (f["score"] if self.constant is None else np.full(len(bags), self.constant)), np.array(most)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, label: str = "quality", per_class: int = 2500, **columns) -> Attention:
    """A model from the labelled rows of docs for which learn (a column over labels) holds."""
    sample, stands_for = labelled_sample(docs, labels, label, learn, {0: per_class, 1: per_class}, **columns)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [passages(x.as_py()).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["label", "bag"])

    rows = sorted((r["label"], bytes(r["bag"])) for r in sample.mapInArrow(features, "label int, bag binary").collect())
    y = np.array([r[0] for r in rows], np.float64)
    bags = [np.frombuffer(r[1], np.float32).reshape(-1, FEATURES) for r in rows]
    return Attention().fit(bags, y, np.array([stands_for[int(v)] for v in y]))


def score(docs: DataFrame, model: Attention, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, score (0 to 1), predicted (1 from 0.5 on) and top_passage, the passage (from 0) of the most attention."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                scores, top = shared.value.score([passages(x.as_py()) for x in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32()), pa.array(top, pa.int64())], [id_column, "score", "predicted", "top_passage"])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, score double, predicted int, top_passage long")


def keep_good(docs: DataFrame, model: Attention, *, text_column: str = "text") -> DataFrame:
    """The rows of docs that the model does not reject, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                scores, _ = shared.value.score([passages(x.as_py()) for x in part.column(at)])
                yield part.filter(pa.array(scores >= 0.5))

    return docs.mapInArrow(run, docs.schema)
