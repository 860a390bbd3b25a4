"""What several operators of this subpackage share: reading tables, checkpoints, folds, word splitting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdict.functions.checkpoints import checkpoint
from verdict.sources.tables import table

__all__ = ["WORD", "checkpoint", "fold", "hashed_words", "labelled_sample", "mix", "most_frequent", "table", "unused", "words"]

#: Words are runs of anything but these bytes; bytes.split() splits on the same six.
WORD = r"[^\x20\x09-\x0D]+"


def fold(doc_id: Column, modulus: int, held: int) -> Column:
    """Whether a row is held out: crc32 of its id as text, modulo `modulus`, equals `held`. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == held, F.lit(True))


def unused(columns: list[str], name: str) -> str:
    """A name like `name` that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z in lower case (bytes.lower and bytes.split know ASCII only)."""
    return (text or "").encode().lower().split()


_draw = np.random.default_rng(17)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LETTER = _draw.integers(1, 2**64, 256, np.uint64, endpoint=False)  # a number for each byte, A-Z that of a-z
_LETTER[65:91] = _LETTER[97:123]
_SHORT = 64


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit integers with all bits stirred, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts end to end (A-Z as a-z, nulls empty) as 64-bit hashes, and how many each text has.

    Bytes of words of up to 64 bytes are taken in together, the first of all words, the second of those that have one, and
    so on; longer ones are hashed one by one.
    """
    texts = pc.fill_null(texts, "").cast(pa.string())  # 32-bit offsets, whatever the session sends
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or edges[0] == edges[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[edges[0] : edges[-1]]
    edges -= edges[0]
    solid = ~_SPACE[data]
    some = np.flatnonzero(np.diff(edges))
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    begin[edges[some]], end[edges[some + 1] - 1] = solid[edges[some]], solid[edges[some + 1] - 1]
    start = np.flatnonzero(begin)
    length = np.flatnonzero(end) + 1 - start
    order = np.argsort(np.minimum(length, _SHORT + 1).astype(np.uint8), kind="stable")[::-1]
    at, size = start[order], length[order]
    longer = len(size) - np.cumsum(np.bincount(np.minimum(size, _SHORT + 1), minlength=_SHORT + 2))  # words of more than so many bytes
    h = np.zeros(len(size), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(_SHORT):
            n = int(longer[j])
            if not n:
                break
            h[:n] = (h[:n] + _LETTER[data[at[:n] + j]]) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(int(longer[_SHORT])):
        h[i] = xxhash.xxh3_64_intdigest(data[at[i] : at[i] + size[i]].tobytes().lower())
    out = np.empty_like(h)
    out[order] = mix(h ^ size.astype(np.uint64))
    return out, np.diff(np.searchsorted(start, edges))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: dict[int, int], *, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, dict[int, float]]:
    """(label, text) of a bounded sample of labelled rows, and how many labelled rows each sampled one stands for.

    learn: over labels, the rows that may be learnt from. per_class: the most ids taken of each class, by the order
    of a hash of the id, so the same ids come each time. An id with several labels has the largest; labels other
    than 0 and 1, null ids and null labels are left out. The ids are few, so they are broadcast.
    """
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    taken = None
    for value, most in sorted(per_class.items()):
        own = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        taken = own if taken is None else taken.unionByName(own)
    ids = taken.withColumnRenamed("doc_id", "_id")
    sample = docs.select(F.col(id_column).alias("_doc"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    sample = sample.join(F.broadcast(ids), F.col("_doc") == F.col("_id")).select("label", "text")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    return sample, {v: max(1.0, counts.get(v, 0) / most) for v, most in per_class.items()}


def most_frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """At most `most` rows of counts: all whose n reaches a bound that a histogram of n gives. (The next lower step would be too many.)"""
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(n)) - 4, F.lit(0)))
    level = (F.floor(F.col(n) / unit) * unit).cast("long")  # five leading bits
    least, taken = None, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.col("level").desc()).collect():  # a few hundred rows
        taken += r["count"]
        if taken > most:
            break
        least = r["level"]
    return counts.where(F.lit(False)) if least is None else counts.where(F.col(n) >= least)
