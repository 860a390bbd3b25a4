"""Operator 3, toxicity: a linear-chain conditional random field tags toxic spans; its marginals score documents.

Tokens are runs of letters, digits and underscores. Labels are of documents, so labelled tokens are derived: a word
is an offender if it occurs in toxic documents of the sample far more often than chance allows (a binomial bound
over all words counted) and hardly in others; offenders in toxic documents are labelled 1, all other tokens 0.
The field has the tags clean and toxic, a weight for each word of its lexicon (in lower case), one for all other
words, and a weight for each pair of neighbouring tags; Adam fits it to the log-likelihood of windows around
occurrences of lexicon words and of windows without any.

Forward-backward gives each token's marginal over the whole text. All words outside the lexicon have the same
potentials, so a stretch of them is one power of the transition matrix: the result is that of the full recursion,
at the cost of the lexicon words. A document's score is a logistic function of the expected number of toxic tokens
and of the largest marginal; spans are runs of neighbouring tokens with a marginal of at least 0.5.

Learning takes a bounded sample of labelled rows (`per_class`); scoring takes every whole text and nothing but the
text. A null or empty text, or one without tokens, has no offender and gets the score of such texts. Without
labels of both classes every score is the share of label 1, or 0 with no label. Repeated rows get a score each; an
empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import checkpoint, labelled_sample

TOKEN = re.compile(r"\w+")
WINDOW, LEXICON = 6, 4096

SPANS = "array<struct<start: int, end: int, marginal: double>>"


class Field:
    """Weights: emission of each lexicon word and of all others (for toxic over clean), and the tags' transitions."""

    def __init__(self, lexicon: list[str]):
        self.lexicon = {w: i for i, w in enumerate(lexicon)}
        self.emission = np.zeros(len(lexicon) + 1)  # the last is that of all other words
        self.transition = np.zeros((2, 2))
        self.calibration = np.zeros(3)
        self.constant: float | None = None

    # Training, on windows of one length: word numbers (the last number: another word) and tags.

    def marginals(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of windows (rows): each token's probability of toxic, and the expected transitions of all windows."""
        n, length = words.shape
        t = np.exp(self.transition)
        potential = np.stack([np.ones(words.shape), np.exp(self.emission[words])], 2)
        forward, back = np.empty((n, length, 2)), np.ones((n, length, 2))
        forward[:, 0] = potential[:, 0]
        for i in range(length):
            if i:
                forward[:, i] = (forward[:, i - 1] @ t) * potential[:, i]
            forward[:, i] /= forward[:, i].sum(1, keepdims=True)
        for i in range(length - 2, -1, -1):
            back[:, i] = (potential[:, i + 1] * back[:, i + 1]) @ t.T
            back[:, i] /= back[:, i].sum(1, keepdims=True)
        both = forward * back
        pair = forward[:, :-1, :, None] * t * (potential * back)[:, 1:, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        return both[:, :, 1] / both.sum(2), pair

    def fit(self, words: np.ndarray, tags: np.ndarray, weight: np.ndarray, rounds: int = 150, rate: float = 0.1) -> Field:
        weight = weight / weight.sum()
        steps = np.array([[((tags[:, :-1] == a) & (tags[:, 1:] == b)).sum(1) for b in (0, 1)] for a in (0, 1)])
        seen_steps = (steps * weight).sum(2)
        m, v = [0.0, 0.0], [0.0, 0.0]
        for i in range(1, rounds + 1):
            toxic, pair = self.marginals(words)
            emission = np.bincount(words.ravel(), ((tags - toxic) * weight[:, None]).ravel(), minlength=len(self.emission)) - 1e-6 * self.emission
            transition = seen_steps - (pair.sum(1) * weight[:, None, None]).sum(0) - 1e-6 * self.transition
            for k, (g, to) in enumerate(((emission, self.emission), (transition, self.transition))):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                to += rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-10)
        return self

    # Tagging whole texts.

    def prepare(self) -> Field:
        """Powers of the step over another word: longer stretches are put together from these."""
        t = np.exp(self.transition)
        step = t * np.array([1.0, np.exp(self.emission[-1])])
        powers = [np.eye(2)]
        for _ in range(128):
            x = powers[-1] @ step
            powers.append(x / x.sum())
        self.powers = [p.ravel().tolist() for p in powers]
        self.t = t.ravel().tolist()
        self.odds = np.exp(self.emission).tolist()
        return self

    def _over(self, n: int) -> list[float]:
        """The step over n other words, scaled."""
        if n < len(self.powers):
            return self.powers[n]
        whole, rest = divmod(n, len(self.powers) - 1)
        x, square = np.array(self.powers[rest]).reshape(2, 2), np.array(self.powers[-1]).reshape(2, 2)
        while whole:
            if whole & 1:
                x = x @ square
                x /= x.sum()
            square = square @ square
            square /= square.sum()
            whole >>= 1
        return x.ravel().tolist()

    def tag(self, hits: list[tuple[int, int]], n: int) -> list[float]:
        """The marginals of the lexicon words in a text of n tokens; hits: (place, word), in order of place."""
        t00, t01, t10, t11 = self.t
        forward, last, a, b = [], -1, 1.0, 0.0
        for place, word in hits:
            odds = self.odds[word]
            if last < 0 and place == 0:
                a, b = 1.0, odds
            else:
                if last < 0:  # the first token is another word
                    a, b, gap = 1.0, self.odds[-1], place - 1
                else:
                    gap = place - last - 1
                if gap:
                    p00, p01, p10, p11 = self._over(gap)
                    a, b = a * p00 + b * p10, a * p01 + b * p11
                a, b = a * t00 + b * t10, (a * t01 + b * t11) * odds
            a, b = a / (a + b), b / (a + b)
            forward.append((a, b))
            last = place
        out, after = [0.0] * len(hits), n
        x, y = 1.0, 1.0
        for i in range(len(hits) - 1, -1, -1):
            place, _ = hits[i]
            if after < n:  # the word at `after` is hits[i + 1]
                odds = self.odds[hits[i + 1][1]]
                y *= odds
                x, y = t00 * x + t01 * y, t10 * x + t11 * y
            gap = after - place - 1
            if gap:
                p00, p01, p10, p11 = self._over(gap)
                x, y = p00 * x + p01 * y, p10 * x + p11 * y
            x, y = x / (x + y), y / (x + y)
            a, b = forward[i]
            out[i] = b * y / (a * x + b * y)
            after = place
        return out

    def find(self, text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]], int]:
        """The lexicon words of a text: (place, word) and (start, end) of each, and how many tokens there are."""
        known, hits, spans, n = self.lexicon.get, [], [], 0
        for n, m in enumerate(TOKEN.finditer(text), 1):  # noqa: B007
            word = known(m[0].lower())
            if word is not None:
                hits.append((n - 1, word))
                spans.append(m.span())
        return hits, spans, n

    def read(self, text: str | None) -> tuple[float, list[dict]]:
        """The score of a text and its spans."""
        text = text or ""
        if self.constant is not None or not self.lexicon or self.lexicon.keys().isdisjoint(TOKEN.findall(text.lower())):
            return self.score([]), []
        hits, at, n = self.find(text)
        toxic, spans, last = self.tag(hits, n), [], -2
        for (place, _), (start, end), p in zip(hits, at, toxic, strict=True):
            if p >= 0.5:
                if spans and place == last + 1:
                    spans[-1]["end"], spans[-1]["marginal"] = end, max(p, spans[-1]["marginal"])
                else:
                    spans.append({"start": start, "end": end, "marginal": p})
                last = place
        return self.score(toxic), spans

    def features(self, toxic: list[float]) -> tuple[float, float, float]:
        return 1.0, float(np.log1p(sum(toxic))), max(toxic, default=0.0)

    def score(self, toxic: list[float]) -> float:
        if self.constant is not None:
            return self.constant
        x = float(np.dot(self.calibration, self.features(toxic)))
        return 1 / (1 + float(np.exp(-max(-30.0, min(30.0, x)))))

    def calibrate(self, marginals: list[list[float]], y: np.ndarray, weight: np.ndarray) -> None:
        """Newton's method for the logistic function of the features."""
        x, weight = np.array([self.features(t) for t in marginals]), weight / weight.sum()
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ self.calibration, -30, 30)))
            g = x.T @ ((y - p) * weight) - 1e-4 * self.calibration
            h = (x * (p * (1 - p) * weight)[:, None]).T @ x + 1e-4 * np.eye(3)
            self.calibration = self.calibration + np.linalg.solve(h, g)


def offenders(sample: DataFrame) -> list[str]:
    """The words labelled toxic: none of which chance would put into so many toxic documents of the sample.

    sample: (label, text). With p the share of toxic documents among those that a common word is in, a word in k
    toxic and m other documents passes if p**k times all words counted is below 0.1 and m is at most a tenth of k.
    """
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.update((w, label) for w in set(TOKEN.findall(text.as_py().lower())) if len(w) <= 64)
            words, labels = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(labels, pa.int32()), pa.array(found.values(), pa.int64())], ["word", "label", "n"])

    counted = sample.mapInArrow(distinct, "word string, label int, n long")
    n = lambda v: F.coalesce(F.sum(F.when(F.col("label") == v, F.col("n"))), F.lit(0))
    words = checkpoint(counted.groupBy("word").agg(n(1).alias("toxic"), n(0).alias("other")))
    whole = words.agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"), F.count(F.lit(1)).alias("words")).first()
    if not whole["toxic"] or not whole["other"]:
        return []
    share = whole["toxic"] / (whole["toxic"] + whole["other"])
    rare = F.col("toxic") * float(np.log(share)) + float(np.log(whole["words"])) < float(np.log(0.1))
    passed = words.where(rare & (F.col("other") * 10 <= F.col("toxic")))
    return [r["word"] for r in passed.orderBy(F.col("toxic").desc(), "word").limit(LEXICON).collect()]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, label: str = "toxic", per_class: dict[int, int] | None = None, **columns) -> Field:
    """A field from the labelled rows of docs for which learn (a column over labels) holds."""
    per_class = per_class or {0: 6000, 1: 3000}
    sample, stands_for = labelled_sample(docs, labels, label, learn, per_class, **columns)
    sample = checkpoint(sample)
    field = Field(offenders(sample))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [field.find(x.as_py()) for x in batch.column(1)]
            places = pa.array([[p for p, _ in hits] for hits, _, _ in found], pa.list_(pa.int32()))
            words = pa.array([[w for _, w in hits] for hits, _, _ in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), places, words, pa.array([n for *_, n in found], pa.int32())], ["label", "places", "words", "n"])

    rows = sample.mapInArrow(occurrences, "label int, places array<int>, words array<int>, n int").collect()
    rows = sorted((r["label"], list(zip(r["places"], r["words"], strict=True)), r["n"]) for r in rows)
    y = np.array([r[0] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        field.constant = float(y[0]) if len(y) else 0.0
        return field
    weight = np.array([stands_for[int(v)] for v in y])
    if field.lexicon:
        field.fit(*_windows(rows, weight, len(field.lexicon)))
    field.prepare()
    field.calibrate([field.tag(hits, n) for _, hits, n in rows], y, weight)
    return field


def _windows(rows: list, weight: np.ndarray, other: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of one length around each first occurrence not yet in one, and one without occurrences for each text."""
    length = 2 * WINDOW + 1
    words, tags, weights = [], [], []
    for (label, hits, n), w in zip(rows, weight, strict=True):
        if n >= length and not hits:
            words.append([other] * length)
            tags.append([0] * length)
            weights.append(w)
        until = -1
        at = [place for place, _ in hits]
        for place in at:
            if place < until:
                continue
            start = max(0, place - WINDOW)
            until = start + length
            own, tag = [other] * length, [0] * length
            for p, x in hits[bisect_left(at, start) : bisect_left(at, until)]:
                own[p - start], tag[p - start] = x, label
            words.append(own)
            tags.append(tag)
            weights.append(w)
    return np.array(words), np.array(tags), np.array(weights)


def score(docs: DataFrame, field: Field, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, score (0 to 1), predicted (1 from 0.5 on) and spans (character offsets and largest marginal)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = dict(docs.dtypes)[id_column]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = shared.value.read
        for batch in batches:
            found = [read(x.as_py()) for x in batch.column(1)]
            scores = np.array([s for s, _ in found], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array([s for _, s in found], span)], [id_column, "score", "predicted", "spans"])

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, score double, predicted int, spans {SPANS}")


def keep_clean(docs: DataFrame, field: Field, *, text_column: str = "text") -> DataFrame:
    """The rows of docs that the field does not reject, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(field), docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = shared.value.read
        for batch in batches:
            yield batch.filter(pa.array([read(x.as_py())[0] < 0.5 for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
