"""Operator 5, byte-level BPE encoding and decoding by a file of ranks.

Two tiers resolve a pre-token (a match of the split pattern). A minimal perfect hash over the vocabulary gives
the rank of a pre-token that is a token itself: each bucket of keys has one displacement that sends its keys to
slots of their own, as many slots as keys, and the key stored in the slot is compared. Other pre-tokens are merged
from their bytes: the bytes form a linked list, a heap yields the pair of lowest rank, leftmost first, until no
neighbours form a token. Each worker remembers what it has resolved, up to `cache_pieces` entries.

Encoding gives the ids as little-endian unsigned 32-bit integers in one binary value, decoding gives bytes.
Null text encodes as empty. Repeated rows are encoded each, an empty table gives none, and columns other than those kept are
ignored. Bytes that no token spells raise an error (files of ranks hold all 256 bytes).
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MASK, _GOLD, _MIX = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9

_state: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """The file of ranks: one base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if rank}


def _slot(h: int, displacement: int, n: int) -> int:
    x = ((h ^ (displacement * _GOLD & _MASK)) * _MIX) & _MASK
    return (x ^ (x >> 31)) * n >> 64


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys, n slots, one displacement for each bucket of about two keys."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 2)
        hashes = {k: xxhash.xxh3_64_intdigest(k) for k in keys}
        members: list[list[bytes]] = [[] for _ in range(self.buckets)]
        for k in keys:
            members[hashes[k] % self.buckets].append(k)
        self.slots: list[bytes | None] = [None] * self.n
        self.displacement = [0] * self.buckets
        for b in sorted(range(self.buckets), key=lambda b: (-len(members[b]), b)):
            if len(members[b]) < 2:
                break
            hs, d = [hashes[k] for k in members[b]], 1
            while True:
                to = [_slot(h, d, self.n) for h in hs]
                if len(set(to)) == len(to) and all(self.slots[t] is None for t in to):
                    break
                d += 1
            self.displacement[b] = d
            for k, t in zip(members[b], to, strict=True):
                self.slots[t] = k
        free = (i for i, k in enumerate(self.slots) if k is None)
        for b, own in enumerate(members):  # a bucket of one key names its slot
            if len(own) == 1:
                t = next(free)
                self.displacement[b], self.slots[t] = -t - 1, own[0]

    def find(self, key: bytes) -> int:
        """The slot of a key, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displacement[h % self.buckets]
        t = -d - 1 if d < 0 else _slot(h, d, self.n)
        return t if self.slots[t] == key else -1


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ranks of a piece: neighbours are merged in order of rank, leftmost first, from single bytes on."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n))
    alive = bytearray(b"\x01") * (n + 1)
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not alive[i] or middle >= stop or end[middle] != stop:  # one of the two has merged since
            continue
        alive[middle] = 0
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i and (r := get(piece[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class _Packed(dict):
    """Pre-token -> its ids as bytes: the perfect hash, then the merges; remembered up to a number of entries."""

    def __init__(self, ranks: dict[bytes, int], perfect: PerfectHash, cache_pieces: int):
        super().__init__()
        self.ranks, self.find, self.most = ranks, perfect.find, cache_pieces
        self.by_slot = [struct.pack("<I", ranks[k]) for k in perfect.slots]

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        slot = self.find(raw)
        ids = self.by_slot[slot] if slot >= 0 else struct.pack(f"<{len(x)}I", *x) if (x := merge_bytes(raw, self.ranks)) else b""
        if len(raw) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


def _codec(context, ranks_path: str, pattern: str, cache_pieces: int):
    """A function that gives each worker its codec. The ranks and the hash over them are broadcast: both are of the vocabulary's size."""
    ranks = read_ranks(ranks_path)
    shared, key = context.broadcast((ranks, PerfectHash(list(ranks)))), (ranks_path, pattern, len(ranks), cache_pieces)

    def get():
        if _state.get("key") != key:
            own, perfect = shared.value
            _state.update(key=key, packed=_Packed(own, perfect, cache_pieces), split=regex.compile(pattern).findall, spelled={r: k for k, r in own.items()})
        return _state["packed"], _state["split"], _state["spelled"]

    return get


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",), cache_pieces: int = 600_000) -> DataFrame:
    """The columns `keep` of every row, n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded (binary).

    decoded comes from the ids alone, by the tokens' spellings: the round trip of the row.
    """
    get = _codec(docs.sparkSession.sparkContext, ranks_path, pattern, cache_pieces)
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, split, spelled = get()
        ids_of, spell = packed.__getitem__, spelled.__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, 500):  # what is held at once stays small
                part = batch.slice(start, 500)
                ids, back = [], []
                for text in part.column(n_keep):
                    x = b"".join(map(ids_of, split(text.as_py() or "")))
                    ids.append(x)
                    back.append(b"".join(map(spell, memoryview(x).cast("I"))))
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keep], n, pa.array(ids, pa.binary()), pa.array(back, pa.binary())], [*keep, "n_tokens", "ids", "decoded"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return docs.select(*keep, text_column).mapInArrow(run, f"{schema}, n_tokens long, ids binary, decoded binary")


def decode(encoded: DataFrame, ranks_path: str, *, ids_column: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and decoded (binary) from packed ids; null ids decode to null, an id without a token raises KeyError."""
    get = _codec(encoded.sparkSession.sparkContext, ranks_path, r"\X", 1)
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = get()[2].__getitem__
        for batch in batches:
            back = [None if x is None else b"".join(map(spell, memoryview(x).cast("I"))) for x in batch.column(n_keep).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(back, pa.binary())], [*keep, "decoded"])

    kinds = dict(encoded.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return encoded.select(*keep, ids_column).mapInArrow(run, f"{schema}, decoded binary")


def digests(encoded: DataFrame, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """n_tokens with the SHA-256 of ids and of decoded bytes, lower-case hex."""
    return encoded.select(*keep, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
