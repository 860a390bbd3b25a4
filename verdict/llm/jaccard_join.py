"""Operator 2, an n-gram Jaccard join by signature trees: documents whose sets of word shingles overlap enough link.

1. Each text gives its set of shingles (64-bit hashes of `width` words). Equal sets are one class; the rest works on
   classes, so copies are never expanded.
2. Classes are routed to groups, by `BANDS` keys of `ROWS` minima each under random hashes of their sets. Two classes
   at the threshold share no key with a probability of (1 - 0.75**3)**32, or 2e-8. The groups of all keys with the
   same smallest class, their leader, are one, so a class is sent once for each of its leaders, not for each key.
3. In a group a signature tree holds, for each node, the OR of its members' bitmaps (a bit for each range of hashes, at
   least `LOAD` bits for each shingle of the smaller sets), their AND, and the range of their set sizes. A traversal
   of pairs of nodes drops a pair when no member of one can overlap one of the other enough: each bit that all of one
   side have and none of the other has is a shingle that is not shared. In leaves the same bound is taken for each
   pair of classes.
4. Pairs that pass are held against each other by their whole sets, exactly, in the same task. Only pairs that join two
   components are, so a group gives at most one link less than it has members, whatever its size.

A group beyond `block` classes (or `most` shingles) is cut into blocks. A first round compares each block with itself and the
first one. Where that leaves the members of a large group in several components, a second round compares the other
pairs of blocks, if they hold more than one component between them. Small groups need no second round.

Null and empty texts have no shingle and link with nothing; a text of fewer words than `width` has one. Each row has the
component of its own text, also where rows repeat a doc_id. Rows with a null doc_id link as others do; a
component's id is the smallest that is not null, null if none has an id. Texts of any length are taken whole. Other
columns are ignored, whatever their names. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.llm.common import checkpoint, hashed_words, unused
from verdict.operators.components import components as connected_components

BANDS, ROWS, LOAD, LEAF = 32, 3, 8, 32
MOST_SENT = 100_000

_draw = np.random.default_rng(2)
_A = _draw.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(0, 2**63, BANDS * ROWS, np.uint64)
_P = _draw.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * _P[60]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _P[61]
    x = (x ^ (x >> np.uint64(29))) * _P[62]
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles. Windows are hashed over all texts at once; those across two texts are left out."""
    ids, counts = hashed_words(texts)
    stirred = _mix(ids)

    def windows(first: int, n: int, k: int) -> np.ndarray:
        total = np.full(n, k, np.uint64) * _P[63]
        for i in range(k):
            total += stirred[first + i : first + i + n] * _P[i % 60]
        return _mix(total)

    whole = windows(0, max(0, len(ids) - width + 1), width)
    out, start = [], 0
    for n in counts.tolist():
        out.append(np.unique(whole[start : start + n - width + 1]) if n >= width else windows(start, 1, n) if n else np.zeros(0, np.uint64))
        start += n
    return out


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.string()), width)[0]


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most 1,000 rows and (but for one long text) 4 MB of text each."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            end = min(start + 1000, max(start + 1, int(np.searchsorted(upto, before + 4_000_000, "right"))))
            yield batch.slice(start, end - start)
            start = end


def sketch(own: np.ndarray) -> tuple[int, int, list[int]]:
    """Of a set: two fingerprints of the whole set and the band keys."""
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint64)
    for i in range(0, len(own), 1024):
        least = np.minimum(least, ((own[i : i + 1024, None] * _A + _B) >> np.uint64(32)).min(0))
    keys = _mix((least.reshape(BANDS, ROWS) * _P[:ROWS]).sum(1, dtype=np.uint64) + _BAND)
    signed = lambda x: int(x.astype(np.int64))
    return signed(own.sum(dtype=np.uint64)), signed((_mix(own) * (own | np.uint64(1))).sum(dtype=np.uint64)), keys.astype(np.int64).tolist()


def enough(shared: np.ndarray, a: int, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (a + b - shared)


def scale(n: int) -> int:
    """The number of address bits of a bitmap for n shingles."""
    return max(6, (LOAD * n - 1).bit_length())


def bitmap(own: np.ndarray, address: int) -> np.ndarray:
    bits = np.zeros(1 << address, bool)
    bits[own >> np.uint64(64 - address)] = True
    return np.packbits(bits).view(np.uint64)


class SignatureTree:
    """A binary tree over sets in order of size: each node is a run of them."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray):
        self.sizes, self.bits = sizes, bitmaps
        self.nodes: list[tuple] = []  # first, end, OR, AND, children or None
        self.root = self._build(0, len(sizes))

    def _build(self, first: int, end: int) -> int:
        if end - first <= LEAF:
            own = self.bits[first:end]
            node = (first, end, np.bitwise_or.reduce(own), np.bitwise_and.reduce(own), None)
        else:
            middle = first + max(LEAF, (end - first) // 2 // LEAF * LEAF)
            a, b = self._build(first, middle), self._build(middle, end)
            node = (first, end, self.nodes[a][2] | self.nodes[b][2], self.nodes[a][3] & self.nodes[b][3], (a, b))
        self.nodes.append(node)
        return len(self.nodes) - 1

    def pruned(self, a: int, b: int, percent: int) -> bool:
        """Whether no set under node a can link with one under node b."""
        (a0, a1, a_or, a_and, _), (b0, b1, b_or, b_and, _) = self.nodes[a], self.nodes[b]
        small, large = (self.sizes[a0], self.sizes[a1 - 1]), (self.sizes[b0], self.sizes[b1 - 1])
        if 100 * small[1] < percent * large[0] or 100 * large[1] < percent * small[0]:
            return True
        overlap = min(small[1] - int(np.bitwise_count(a_and & ~b_or).sum()), large[1] - int(np.bitwise_count(b_and & ~a_or).sum()))
        return (100 + percent) * overlap < percent * int(small[0] + large[0])

    def pairs(self, a: int, b: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of sets of two leaves (or of one) that the bound allows."""
        (a0, a1, *_), (b0, b1, *_) = self.nodes[a], self.nodes[b]
        x, y, n, m = self.bits[a0:a1], self.bits[b0:b1], self.sizes[a0:a1, None], self.sizes[None, b0:b1]
        both = np.stack([np.bitwise_count(one & y).sum(1, dtype=np.int64) for one in x])
        only_x = np.bitwise_count(x).sum(1, dtype=np.int64)[:, None] - both
        only_y = np.bitwise_count(y).sum(1, dtype=np.int64)[None] - both
        overlap = np.minimum(n - only_x, m - only_y)
        fit = (100 + percent) * overlap >= percent * (n + m)
        if a == b:
            fit &= np.triu(np.ones(fit.shape, bool), 1)
        i, j = np.nonzero(fit)
        return i + a0, j + b0

    def leaves(self, percent: int, done) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets that the bounds allow, those of two leaves at a time; done: a function of two runs of sets
        that says whether their pairs are of no use."""
        stack = [(self.root, self.root)]
        while stack:
            a, b = stack.pop()
            (a0, a1, _, _, left), (b0, b1, _, _, right) = self.nodes[a], self.nodes[b]
            if done(slice(a0, a1), slice(b0, b1)) or (a != b and self.pruned(a, b, percent)):
                continue
            if left is None and right is None:
                yield self.pairs(a, b, percent)
            elif a == b:
                stack += [(left[0], left[1]), (left[1], left[1]), (left[0], left[0])]
            elif right is None or (left is not None and a1 - a0 >= b1 - b0):
                stack += [(x, b) for x in reversed(left)]
            else:
                stack += [(a, x) for x in reversed(right)]


class Group:
    """Sets of one group, their components, and the links found that join two of these."""

    def __init__(self, sets: list[np.ndarray], component: np.ndarray, percent: int, sides: np.ndarray | None = None):
        self.order = np.argsort([len(x) for x in sets], kind="stable")
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(x) for x in self.sets], np.int64)
        self.component, self.percent = np.unique(component[self.order], return_inverse=True)[1], percent
        self.sides = None if sides is None else sides[self.order]  # only pairs of two sides count
        self.found: list[tuple[int, int]] = []

    def links(self) -> list[tuple[int, int]]:
        """Pairs of linked sets (by their place in the input) such that each joins two components anew."""
        scales = np.array([scale(int(n)) for n in self.sizes])
        for own in np.unique(scales):  # linked sets differ by one scale at most
            at = np.flatnonzero((scales == own) | (scales == own + 1))
            if len(at) < 2 or (self.component[at] == self.component[at[0]]).all():
                continue
            if len(at) <= 4:
                i, j = np.triu_indices(len(at), 1)
                self.test(at[i], at[j])
                continue
            tree = SignatureTree(self.sizes[at], np.stack([bitmap(self.sets[k], int(own)) for k in at]))
            for i, j in tree.leaves(self.percent, lambda x, y: self.settled(at[x], at[y])):  # noqa: B023
                lower = scales[at[i]] == own
                self.test(at[i[lower]], at[j[lower]])
        return [(int(self.order[i]), int(self.order[j])) for i, j in self.found]

    def settled(self, x: np.ndarray, y: np.ndarray) -> bool:
        one = self.component[x[0]]
        return bool((self.component[x] == one).all() and (self.component[y] == one).all())

    def test(self, i: np.ndarray, j: np.ndarray) -> None:
        """Takes up the pairs i, j that link, each set of i against all of its j by their whole sets."""
        apart = self.component[i] != self.component[j]
        if self.sides is not None:
            apart &= self.sides[i] != self.sides[j]
        i, j = i[apart], j[apart]
        for one in np.unique(i):
            own, others = self.sets[one], j[i == one]
            others = others[self.component[others] != self.component[one]]
            others = others[100 * self.sizes[np.minimum(one, others)] >= self.percent * self.sizes[np.maximum(one, others)]]
            for start in range(0, len(others), 256):
                part = others[start : start + 256]
                part = part[self.component[part] != self.component[one]]
                if not len(part):
                    continue
                whole = np.concatenate([self.sets[k] for k in part])
                at = np.searchsorted(own, whole)
                hit = own[np.minimum(at, len(own) - 1)] == whole
                shared = np.add.reduceat(hit.astype(np.int64), np.cumsum([0, *self.sizes[part[:-1]]]))
                for k in part[enough(shared, len(own), self.sizes[part], self.percent)]:
                    if self.component[k] != self.component[one]:
                        self.component[self.component == self.component[k]] = self.component[one]
                        self.found.append((int(one), int(k)))


def _units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in the first columns, from batches that are sorted by them."""
    key, run = None, []
    for batch in batches:
        columns = [c.to_pylist() if not pa.types.is_binary(c.type) else list(c) for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:keys] != key:
                if len(run) > 1:
                    yield run
                key, run = row[:keys], []
            run.append(row)
    if len(run) > 1:
        yield run


def _linked(units: DataFrame, percent: int) -> DataFrame:
    """(a, b), links of classes, from rows (leader, low, high, k, side, component, own): the blocks low and high of a leader's group.

    With low 0 all pairs of these blocks count, else those between the two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches, 3):
            sets = [np.frombuffer(r[6].as_buffer(), np.uint64) for r in unit]
            sides = np.array([r[4] for r in unit]) if unit[0][1] else None
            found = Group(sets, np.array([r[5] for r in unit], np.int64), percent, sides).links()
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([unit[i][3] for i in x], pa.int64()) for x in (a, b)], ["a", "b"])

    columns = ["leader", "low", "high", "k", "side", "component", "own"]
    tasks = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), units.sparkSession.sparkContext.defaultParallelism)
    dealt = units.select(*columns).repartition(tasks, "leader", "low", "high").sortWithinPartitions("leader", "low", "high")
    return dealt.mapInArrow(run, "a long, b long")


def _filter(places: DataFrame) -> tuple[bytes, int]:
    """A bitmap of hashes (h), and how many bits it has: 16 for each, from 2**16 to 2**27 (16 MB)."""
    bits = 1 << min(27, max(16, (16 * places.count()).bit_length()))
    place = F.pmod("h", F.lit(bits))
    parts = places.groupBy(F.floor(place / 32768).alias("at")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(32768))).alias("bits"))
    out = bytearray(bits // 8)
    for r in parts.collect():
        out[r["at"] * 4096 : (r["at"] + 1) * 4096] = r["bits"]
    return bytes(out), bits


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(k, own): the whole sets of the wanted classes (k, h: the row that stands for each). docs: (h, text).

    Texts are not shuffled: a broadcast filter of bounded size passes the wanted rows and some others, whose sets the
    join drops.
    """
    passed, bits = _filter(wanted)
    shared = docs.sparkSession.sparkContext.broadcast(passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            place = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((marks[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)))
            for part in _parts([batch], 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in shingle_sets(part.column(1), width)], pa.binary())], ["h", "own"])

    own = docs.select("h", "text", F.pmod("h", F.lit(bits)).alias("place")).mapInArrow(run, "h long, own binary")
    return wanted.join(own.groupBy("h").agg(F.first("own").alias("own")), "h").select("k", "own")


def _hashed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, text and h, which tells apart rows of other ids or texts."""
    slim = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    return slim.withColumn("h", F.xxhash64("doc_id", "text"))


def classes_of(docs: DataFrame, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """Every row (doc_id, h, n, k: its set's size and fingerprint, null without words) and the classes (k, n, doc_id, h, keys).

    docs: (doc_id, text, h). A class's doc_id is its smallest, its h that of a row of this id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "h", "n", "f", "g", "keys"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        for part in _parts(batches, 2):
            rows = [(len(own), *(sketch(own) if len(own) else (0, 0, []))) for own in shingle_sets(part.column(2), width)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    found = docs.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, n long, f long, g long, keys array<long>")
    rows = checkpoint(found.select("doc_id", "h", "n", F.when(F.col("n") > 0, F.xxhash64("n", "f", "g")).alias("k"), "keys"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "keys")).alias("first")
    classes = rows.where(F.col("k").isNotNull()).groupBy("k", "n").agg(first)
    return rows.drop("keys"), checkpoint(classes.select("k", "n", "first.doc_id", "first.h", "first.keys"))


def linked_rows(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 75, block: int = 2048, most: int = 4_000_000) -> DataFrame:
    """doc_id, h (tells apart rows of other ids or texts), n_shingles, component (null without words), component_id and kept_h of every row.

    percent: documents link when 100 * |intersection| >= percent * |union|. component_id: the smallest doc_id of the
    component; kept_h: the h of a row of this id.
    """
    hashed = _hashed(docs, id_column, text_column)
    rows, classes = classes_of(hashed, width)
    keyed = classes.select(F.explode("keys").alias("key"), "k", "n", "h")
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min("k").alias("leader")).where("count > 1").drop("count")
    routes = checkpoint(keyed.join(counts, "key").select("leader", "k", "n", "h").distinct())
    sets = checkpoint(_sets(hashed, routes.select("k", "h").distinct(), width))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / most)).cast("int")
    # Few groups need more than one block, so their list is mostly small enough to send everywhere; else it is joined.
    large = checkpoint(routes.groupBy("leader").agg(blocks.alias("blocks")).where("blocks > 1"))
    joined = routes.join(F.broadcast(large) if large.count() <= MOST_SENT else large, "leader", "left")
    side = F.pmod(F.xxhash64("k", "leader"), F.col("blocks")).cast("int")
    placed = checkpoint(joined.withColumn("blocks", F.coalesce("blocks", F.lit(1))).select("leader", "k", "blocks", side.alias("side")))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).when(F.col("side") == 0, F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array("side"))
    first = placed.join(sets, "k").select("leader", F.lit(0).alias("low"), F.explode(others).alias("high"), "k", "side", F.col("k").alias("component"), "own")
    links = checkpoint(_linked(first, percent))
    parts = connected_components(links)
    beyond = placed.where("blocks > 2 and side > 0").join(parts.withColumnRenamed("node", "k"), "k", "left").withColumn("component", F.coalesce("component", "k"))
    of_block = beyond.groupBy("leader", "side").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    of_block = checkpoint(of_block.join(of_block.groupBy("leader").agg(F.min("x").alias("_x"), F.max("y").alias("_y")).where("_x <> _y"), "leader"))
    if not of_block.isEmpty():
        low, high = (of_block.select("leader", F.col("side").alias(s), F.col("x").alias(f"x_{s}"), F.col("y").alias(f"y_{s}")) for s in ("low", "high"))
        pairs = low.join(high, "leader").where("low < high and least(x_low, x_high) <> greatest(y_low, y_high)").select("leader", "low", "high")
        units = pairs.withColumn("side", F.explode(F.array("low", "high"))).join(beyond, ["leader", "side"]).join(sets, "k")
        parts = connected_components(links.unionByName(_linked(units, percent)))
    known = classes.join(parts.withColumnRenamed("node", "k"), "k", "left").withColumn("component", F.coalesce("component", "k"))
    least = known.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("least"))
    known = known.select("k", "component").join(least, "component").select("k", "component", F.col("least.doc_id").alias("component_id"), F.col("least.h").alias("kept_h"))
    whole = rows.join(known, "k", "left")
    return whole.select("doc_id", "h", F.col("n").alias("n_shingles"), "component", F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "kept_h")


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to) of every row."""
    return linked_rows(docs, **how).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """The rows of docs, with all their columns, but one of each component: a row of its smallest id.

    Rows without words all stay. Of rows that repeat an id and text (with words), one stays.
    """
    found = linked_rows(docs, id_column=id_column, text_column=text_column, **how).where("component is not null").select("h", "kept_h")
    found = checkpoint(found.groupBy("h").agg(F.first("kept_h").alias("kept_h"), F.count(F.lit(1)).alias("count")))
    h, again = unused(docs.columns, "h"), unused(docs.columns, "again")
    own = docs.withColumn(h, F.xxhash64(F.col(f"`{id_column}`").cast("long"), F.col(f"`{text_column}`")))
    kept = own.join(found.where("h <> kept_h").select(F.col("h").alias(h)), h, "left_anti")
    repeated = found.where("h = kept_h and count > 1").select(F.col("h").alias(h), F.lit(True).alias(again))
    if repeated.isEmpty():
        return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
    marked, row = kept.join(repeated, h, "left"), F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    first = F.min_by(row, F.xxhash64(F.to_json(row))).alias("row")  # the same on every run; rows of one hash are equal
    single = marked.where(again).groupBy(h).agg(first).select("row.*")
    whole = marked.where(F.col(again).isNull()).select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(single)
    return whole.select(*(F.col(f"`{c}`") for c in docs.columns))
