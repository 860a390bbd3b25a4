"""Operator 13, language identification by interpolated Kneser-Ney models of characters, one for each language.

Letters in lower case (marks belong to them) are the characters; any run of others is one space. The `letters` most frequent
of the languages' letters have a number each, all others share one, so an n-gram is an integer. A model gives the last
character of an n-gram the discounted share of its count among those of its context, plus the mass taken off times the
probability by the shorter context, where counts are those of distinct characters before; below single characters
all are equally likely. The n-grams that any language has are kept in sorted arrays of hashes, one for each order, beside
the logarithm of the whole probability in each language; contexts likewise, beside the mass that they hand down. A text is looked up
from the highest order down; characters found at an order are done for all languages at once.

Prediction: the language of the lowest cross-entropy per character, ties to the first by code point. The score is its
share among all languages at a sharpness fitted to pieces of text that were not counted. Rejection: for each language
these pieces' cross-entropies, less their mean and times the root of their lengths, have a quantile (`reject` lie
above); a text above that of its language (longer ones taken at the longest piece's length) is `rejected`: its language is
probably none of those learnt.

Every language of the rows is learnt (unless `languages` asks for the most frequent alone), from about `characters` characters of each
(fewer where there are more than 16 languages, but at least `LEAST_WINDOWS` windows), in windows that a hash of their own content
picks from all rows, copies once. A language whose windows all fall to calibration is counted by them. Totals and letters are counted over
all rows. Languages lie in arrays by `BLOCK`; where all these would pass `CELLS` cells, the rarest n-grams are left out, of each
language never its most frequent ones.

A text that is null or has no letter is `und`, with score 0, no cross-entropy, and rejected; so is every text where nothing
could be learnt. Rows with a null language teach nothing; a null id is held out by `fold`. Texts are taken whole. Repeated
rows are scored each, an empty table gives no rows, other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import checkpoint, mix

ORDER, BITS = 5, 12
OTHER = (1 << BITS) - 1
CELLS, BLOCK = 1 << 25, 16
#: Characters of a window for learning, and of the pieces that windows for calibration are cut into, in turn.
WINDOW, PIECES, LEAST_WINDOWS = 1024, (24, 100, 400, 500), 8
#: Characters that are scored at once.
CHUNK = 1 << 19


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its letter in lower case (0: no letter or mark), and whether it is a letter."""
    lower, letter = np.zeros(sys.maxunicode + 1, np.uint32), np.zeros(sys.maxunicode + 1, bool)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            small = chr(c).lower()
            lower[c], letter[c] = ord(small) if len(small) == 1 else c, kind == "L"
    return lower, letter


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each followed by a line end, and where each text begins."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32), np.cumsum(sizes) - sizes


def spelled(texts: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of all texts as numbers (0: space), how many each text has, and whether it has a letter.

    codes: a number for each code point. A text has no space at its beginning and one at its end.
    """
    points, start = _code_points(texts)
    own = codes[points]
    keep = own > 0
    keep[1:] |= own[:-1] > 0  # the first of a run of others
    kept = np.add.reduceat(keep, start, dtype=np.int64)
    return own[keep], kept, np.logical_or.reduceat(_letters()[1][points], start)


class HashArray:
    """Integers as sorted 64-bit hashes (one to one), found by their first bits and a few steps."""

    def __init__(self, keys: np.ndarray):
        hashes = mix(keys.astype(np.uint64))
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        edges = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift
        self.start = np.append(np.searchsorted(self.hashes, edges), len(keys)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is in the sorted array; -1 where it is not."""
        wanted = mix(keys)
        bucket = (wanted >> self.shift).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        found = np.full(len(keys), -1, np.int32)
        open_ = np.flatnonzero(at < end)
        at, end, wanted = at[open_], end[open_], wanted[open_]
        while len(open_):
            hit = self.hashes[at] == wanted
            found[open_[hit]] = at[hit]
            at = at + 1
            go = ~hit & (at < end)
            open_, at, end, wanted = open_[go], at[go], end[go], wanted[go]
        return found


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (BITS * n)) - 1)


def ngrams(own: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The n-gram of the highest order that ends at each character; spaces stand before a text."""
    before = ORDER - 1
    padded = np.zeros(len(own) + before * len(kept), np.uint64)
    place = np.arange(len(own)) + np.repeat(before * np.arange(1, len(kept) + 1), kept)
    padded[place] = own
    keys = padded[place]
    for j in range(1, ORDER):
        keys = keys | (padded[place - j] << np.uint64(BITS * j))
    return keys


class KneserNey:
    """One language's model from the n-grams of the highest order and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, letters: int):
        self.floor = 1.0 / (letters + 2)  # a space, the letters, all others
        self.levels: list[tuple] = []
        for n in range(ORDER, 0, -1):
            context, at = np.unique(keys >> np.uint64(BITS), return_inverse=True)
            ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            total, kinds = np.bincount(at, counts), np.bincount(at)
            self.levels.append((keys, (counts - discount) / total[at], context, discount * kinds / total))
            keys, counts = np.unique(keys & _mask(n - 1), return_counts=True)

    def probability(self, keys: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Of the last character of each n-gram after the others."""
        if n == 0:
            return np.full(len(keys), self.floor)
        own, share, context, _ = self.levels[ORDER - n]
        at = np.searchsorted(own, keys).clip(max=len(own) - 1)
        return np.where(own[at] == keys, share[at], 0.0) + self.handed_down(keys >> np.uint64(BITS), n) * self.probability(keys & _mask(n - 1), n - 1)

    def handed_down(self, contexts: np.ndarray, n: int) -> np.ndarray:
        _, _, context, mass = self.levels[ORDER - n]
        at = np.searchsorted(context, contexts).clip(max=len(context) - 1)
        return np.where(context[at] == contexts, mass[at], 1.0)


class Model:
    """The models of all languages in sorted hash arrays, with what calibration found."""

    def __init__(self, languages: list[str], letters: list[int], windows: list[list[np.ndarray]], held: list[list[np.ndarray]], reject: float = 0.005):
        """windows, held: for each language the windows to count and those to calibrate by."""
        counted = []
        for own in windows:
            whole = np.concatenate([np.zeros(0, np.uint16), *own])
            counted.append(np.unique(ngrams(whole, np.array([len(w) for w in own], np.int64)), return_counts=True))
        known = [i for i, (keys, _) in enumerate(counted) if len(keys)]
        self.languages, self.letters = [languages[i] for i in known], letters
        counted, least = [counted[i] for i in known], 1
        blocks = [counted[i : i + BLOCK] for i in range(0, len(counted), BLOCK)]
        while sum(len(own) * sum(int((c >= least).sum()) for _, c in own) for own in blocks) * ORDER > CELLS and any((c < least).sum() < len(c) for _, c in counted):
            least += 1
        kept = [c >= min(least, c.max()) for _, c in counted]
        models = [KneserNey(k[x], c[x], len(letters)) for (k, c), x in zip(counted, kept, strict=True)]
        self.floor = -np.log(len(letters) + 2.0)
        self.blocks: list[list[tuple]] = []
        for first in range(0, len(models), BLOCK):
            own, tables = models[first : first + BLOCK], []
            for n in range(ORDER, 0, -1):
                grams, contexts = (np.unique(np.concatenate([m.levels[ORDER - n][j] for m in own])) for j in (0, 2))
                found, above = HashArray(grams), HashArray(contexts)
                log = np.log(np.stack([m.probability(grams, n) for m in own], 1))[found.order].astype(np.float32)
                down = np.log(np.stack([m.handed_down(contexts, n) for m in own], 1))[above.order].astype(np.float32)
                tables.append((found, log, above, down))
            self.blocks.append(tables)
        self.sharpness, self.mean, self.spread, self.most = 1.0, np.zeros(len(models)), np.ones(len(models)), np.full(len(models), np.inf)
        if models:
            self._calibrate([held[languages.index(x)] for x in self.languages], reject)

    @functools.cached_property
    def codes(self) -> np.ndarray:
        """The number of each code point's character."""
        lower = _letters()[0]
        number = np.full(sys.maxunicode + 1, OTHER, np.uint16)
        number[0] = 0
        number[self.letters] = np.arange(1, len(self.letters) + 1)
        return number[lower]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "codes"}

    def _logs(self, keys: np.ndarray) -> np.ndarray:
        return np.concatenate([self._block_logs(tables, keys) for tables in self.blocks], 1)

    def _block_logs(self, tables: list[tuple], keys: np.ndarray) -> np.ndarray:
        out = np.zeros((len(keys), tables[0][1].shape[1]), np.float32)
        rest = np.arange(len(keys))
        for n, (found, log, above, down) in zip(range(ORDER, 0, -1), tables, strict=True):
            at = found.find(keys)
            hit = at >= 0
            out[rest[hit]] += log[at[hit]]
            rest, keys = rest[~hit], keys[~hit]
            if not len(rest):
                return out
            context = above.find(keys >> np.uint64(BITS))
            has = context >= 0
            out[rest[has]] += down[context[has]]
            keys = keys & _mask(n - 1)
        out[rest] += self.floor
        return out

    def entropies(self, own: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """Cross-entropy per character of each text in each language; NaN without characters."""
        keys, end = ngrams(own, kept), np.cumsum(kept)
        total = np.zeros((len(kept), len(self.languages)))
        for start in range(0, len(keys), CHUNK):
            logs = self._logs(keys[start : start + CHUNK])
            first = int(np.searchsorted(end, start, "right"))
            last = int(np.searchsorted(end, start + len(logs), "left"))
            inside = np.arange(first, last + 1)
            inside = inside[kept[inside] > 0]
            edge = np.maximum(end[inside] - kept[inside], start) - start
            total[inside] += np.add.reduceat(logs, edge, dtype=np.float64)
        with np.errstate(invalid="ignore", divide="ignore"):
            return -total / kept[:, None]

    def _calibrate(self, held: list[list[np.ndarray]], reject: float) -> None:
        pieces, truth = [], []
        for i, windows in enumerate(held):
            for w in windows:
                at = 0
                for size in PIECES:
                    if len(w) - at >= min(size, 20):
                        pieces.append(w[at : at + size])
                        truth.append(i)
                    at += size
        if not pieces:
            return
        kept, truth = np.array([len(p) for p in pieces], np.int64), np.array(truth)
        h = self.entropies(np.concatenate(pieces), kept)
        trials = [(float(-np.log(self.shares(h, kept, b)[np.arange(len(h)), truth].clip(1e-12)).mean()), b) for b in 2.0 ** np.arange(-6, 6)]
        self.sharpness = min(trials)[1]
        for i in range(len(self.languages)):
            own, n = h[truth == i, i], kept[truth == i]
            if len(own) >= 20:  # fewer tell nothing: no text is rejected
                self.mean[i] = np.average(own, weights=n)
                self.spread[i] = ((own - self.mean[i]) * np.sqrt(n)).std() or 1.0
                self.most[i] = np.quantile((own - self.mean[i]) * np.sqrt(n) / self.spread[i], 1 - reject)

    def shares(self, h: np.ndarray, kept: np.ndarray, sharpness: float) -> np.ndarray:
        x = -sharpness * np.sqrt(kept)[:, None] * (h - h.min(1)[:, None])
        e = np.exp(x)
        return e / e.sum(1)[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, cross-entropy, rejected) of each text."""
        own, kept, letter = spelled([t or "" for t in texts], self.codes)
        if not self.languages or not len(own):
            return [("und", 0.0, None, True)] * len(texts)
        h = self.entropies(own, kept)
        h[~letter] = 0.0
        best, share = h.argmin(1), self.shares(h, kept, self.sharpness).max(1)
        lowest = h[np.arange(len(h)), best]
        far = (lowest - self.mean[best]) * np.sqrt(np.minimum(kept, max(PIECES))) / self.spread[best] > self.most[best]
        return [(self.languages[b], float(s), float(x), bool(f)) if y else ("und", 0.0, None, True) for b, s, x, f, y in zip(best, share, lowest, far, letter, strict=True)]


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """The texts in parts of about CHUNK characters, each with the place of its first."""
    part, first, size = [], 0, 0
    for i, x in enumerate(column):
        part.append(x.as_py())
        size += len(part[-1] or "")
        if size >= CHUNK:
            yield first, part
            part, first, size = [], i + 1, 0
    if part:
        yield first, part


def fit(docs: DataFrame, learn: Column, *, text_column: str = "text", lang_column: str = "lang", languages: int | None = None, letters: int = 4000, characters: int = 1_000_000, calibration: int = 8, reject: float = 0.005) -> Model:
    """A model from the rows for which learn holds. letters: at most 4094. One of `calibration` windows is not counted."""
    known = docs.where(learn & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, _ = _letters()
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, part in _parts(batch.column(1)):
                points, start = _code_points(part)
                own = lower[points]
                of = np.unique(names[first : first + len(part)], return_inverse=True)
                language = np.repeat(of[1], np.diff(np.append(start, len(points))))[own > 0].astype(np.uint64)
                pairs, n = np.unique(language << np.uint64(32) | own[own > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(of[0][(pairs >> np.uint64(32)).astype(int)].tolist(), pa.string()), pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "letter", "n"])

    counted = checkpoint(known.mapInArrow(count, "lang string, letter int, n long").groupBy("lang", "letter").agg(F.sum("n").alias("n")))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    if languages is not None:
        totals = totals.orderBy(F.col("total").desc(), "lang").limit(languages)
    total = {r["lang"]: r["total"] for r in totals.collect()}
    share = F.sum(F.col("n") / F.col("total"))
    alphabet = [r["letter"] for r in counted.join(F.broadcast(totals), "lang").groupBy("letter").agg(share.alias("share")).orderBy(F.col("share").desc(), "letter").limit(min(letters, OTHER - 1)).collect()]
    names = sorted(total)
    rate = [min(1.0, min(characters, max(16 * characters / len(names), LEAST_WINDOWS * WINDOW)) / total[x]) for x in names]
    model = Model([], alphabet, [], [])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, codes = {x: i for i, x in enumerate(names)}, model.codes
        for batch in batches:
            of, taken = batch.column(0).to_pylist(), []
            for first, part in _parts(batch.column(1)):
                own, kept, _ = spelled(part, codes)
                for i, text in enumerate(np.split(own, np.cumsum(kept)[:-1])):
                    language = number.get(of[first + i], -1)
                    for at in range(0, len(text) if language >= 0 else 0, WINDOW):
                        window = text[at : at + WINDOW].tobytes()
                        if xxhash.xxh3_64_intdigest(window) < rate[language] * 2.0**64:
                            taken.append((language, window))
            taken = sorted(set(taken))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in taken], pa.int32()), pa.array([x[1] for x in taken], pa.binary())], ["lang", "window"])

    drawn = known.mapInArrow(draw, "lang int, window binary").distinct().collect() if names else []
    windows, held = [[] for _ in names], [[] for _ in names]
    for language, window in sorted((r["lang"], bytes(r["window"])) for r in drawn):
        apart = xxhash.xxh3_64_intdigest(window, 1) % calibration == 0
        (held if apart else windows)[language].append(np.frombuffer(window, np.uint16))
    windows = [own or spare for own, spare in zip(windows, held, strict=True)]
    return Model(names, alphabet, windows, held, reject)


def predict(docs: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, lang_pred, score, cross_entropy (nats a character) and rejected of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in _parts(batch.column(1)):
                lang, score, entropy, rejected = zip(*shared.value.predict(part), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())], [id_column, "lang_pred", "score", "cross_entropy", "rejected"])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")
