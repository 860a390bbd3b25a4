"""Operator 11, alignment of two tokenizers over the same bytes by galloping intersection of their tokens' ends.

Each text, with a space before it, is encoded by a byte-level BPE (A) and, without the space, by a SentencePiece model that
adds it (B). Tokens become bytes, their running lengths two ascending lists of ends. The shorter list drives: a run of its ends
gallops through the longer one by doubling steps until it is passed, then each end is found by binary search inside
that stretch. The common ends cut both texts into groups; the ranks where they stand in either list say which tokens
a group has, so tokens overlap as ranges and nothing is searched token by token. Texts are aligned many at a time: a text's end is
common to both lists, so the lists of several texts follow each other.

Links are the pairs of an A and a B token occurrence of one group. A document keeps its distinct pairs with how often each occurs;
a large group is expanded in parts. What it has is written to a table once, so no text is encoded twice. The number of documents that
hold a pair linked is counted over all documents, and looked up in two tiers: a broadcast table of the most frequent pairs
(at most `hot_pairs`, by a histogram of the counts), and a join for the rest, whose counts are small, hence no key is hot.
The highest count of each A id is a list of the vocabulary's length.

Where the file of A merges in the order of its ids (read from the file), A's tokens come from a faster library with the same ranks;
texts with characters on which the two may split differently go to A's own. Special strings in a text are plain text in both.
Texts that are null or empty, or whose joined A or B bytes differ from the space and the text, have no tokens: counts are 0, the
groups empty. Repeated rows and ids, and null ids, are documents each. Long texts are taken whole. An empty table has no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdict.functions.checkpoints import written
from verdict.llm.common import most_frequent
from verdict.llm.token_counts import PLAIN, tiered

#: Ends of the shorter list that gallop together; characters aligned at once; links expanded at once.
RUN, CHARACTERS, LINKS = 1024, 1 << 19, 1 << 21

_state: dict = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    printable = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Tokenizer A."""

    def __init__(self, file: bytes, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file.decode())
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        letters, vocabulary = byte_letters(), self.tokenizer.get_vocab(with_added_tokens=True)
        added = {x["content"] for x in json.loads(file)["added_tokens"]}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if token in added or any(c not in letters for c in token) else bytes(letters[c] for c in token)
        self.fast = None
        if self._by_rank(json.loads(file)):
            ranks = {self.bytes[i]: i for t, i in vocabulary.items() if t not in added}
            self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.odd = regex.compile(PLAIN).search

    @staticmethod
    def _by_rank(file: dict) -> bool:
        """Whether merging in the order of ids is what the file says: a byte-level BPE, all bytes, merges in the order of what they make."""
        if not tiered(json.dumps(file).encode()):
            return False
        model = file["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"].get(a + b, -1) for a, b in pairs]
        plain = not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        return plain and all(c in model["vocab"] for c in byte_letters()) and len(set(model["vocab"]) - {x["content"] for x in file["added_tokens"]}) == 256 + len(pairs) and made == sorted(set(made)) and min(made, default=256) >= 256

    def encode(self, text: str) -> np.ndarray:
        if self.fast and not self.odd(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """Tokenizer B."""

    def __init__(self, file: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int64)


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values that two ascending lists share stand in either."""
    at, found = 0, [(np.zeros(0, np.int64),) * 2]
    for first in range(0, len(short), RUN):
        run, step = short[first : first + RUN], RUN
        while at + step < len(long) and long[at + step] < run[-1]:
            step *= 2
        stretch = long[at : at + step + 1]
        place = np.searchsorted(stretch, run)
        inside = place < len(stretch)
        inside[inside] = stretch[place[inside]] == run[inside]
        found.append((first + np.flatnonzero(inside), at + place[inside]))
        at += int(place[-1])
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def intersect(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranks of common ends in a and in b; the shorter list drives."""
    if len(a) <= len(b):
        return gallop(a, b)
    j, i = gallop(b, a)
    return i, j


class Aligner:
    """Both tokenizers and the tables over their ids; one for each Python worker."""

    def __init__(self, file_a: bytes, pattern: str, file_b: bytes):
        self.a, self.b = Encoder(file_a, pattern), Pieces(file_b)
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        digits = len(str(max(len(self.size_a), len(self.size_b))))
        rows = [f"{i}{end}".encode() for n, ends in ((len(self.size_a), ",|"), (len(self.size_b), (",", ";", ""))) for end in ends for i in range(n)]
        self.spelled = np.array(rows, f"S{digits + 1}").view(np.uint8).reshape(len(rows), digits + 1)
        self.width = (self.spelled > 0).sum(1)

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of a text, None where it has no tokens."""
        if not text:
            return None
        whole = f" {text}".encode()
        b = self.b.encode(text)
        if int(self.size_b[b].sum()) != len(whole) or b"".join(map(self.b.bytes.__getitem__, b.tolist())) != whole:
            return None
        a = self.a.encode(f" {text}")
        if int(self.size_a[a].sum()) != len(whole) or (not self.a.fast and b"".join(map(self.a.bytes.__getitem__, a.tolist())) != whole):
            return None
        return a, b

    def align(self, texts: list[str | None]) -> dict:
        """Counts, groups as bytes, and distinct pairs with their times, for each text."""
        own = [self.tokens(t) for t in texts]
        full = [i for i, x in enumerate(own) if x]
        n = {k: np.zeros(len(texts), np.int64) for k in ("a", "b", "groups", "links", "pairs")}
        out = {"n": n, "groups": [b""] * len(texts), "pairs": np.zeros(0, np.int64), "times": np.zeros(0, np.int64)}
        if not full:
            return out
        n["a"][full], n["b"][full] = ([len(own[i][j]) for i in full] for j in (0, 1))
        a, b = (np.concatenate([own[i][j] for i in full]) for j in (0, 1))
        last_a, last_b = intersect(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)  # tokens of each group
        closing = np.searchsorted(last_a, np.cumsum(n["a"][full]) - 1)  # the last group of each text
        n["groups"][full] = np.diff(closing, prepend=-1)
        first = np.append(0, closing[:-1] + 1)
        n["links"][full] = np.add.reduceat(in_a * in_b, first)
        self._spell(out, full, a, b, last_a, last_b, in_a, in_b, closing)
        text_of_group = np.repeat(np.arange(len(full)), n["groups"][full])
        text, out["pairs"], out["times"] = self._pairs(a, b, last_b, in_a, in_b, text_of_group)
        n["pairs"][full] = np.bincount(text, minlength=len(full))
        return out

    def _spell(self, out, full, a, b, last_a, last_b, in_a, in_b, closing) -> None:
        group_a, group_b = np.repeat(np.arange(len(in_a)), in_a), np.repeat(np.arange(len(in_b)), in_b)
        row_a, row_b = a.copy(), b + 2 * len(self.size_a)
        row_a[last_a] += len(self.size_a)
        row_b[last_b] += len(self.size_b)
        row_b[last_b[closing]] += len(self.size_b)
        merged = np.empty(len(a) + len(b), np.int64)
        merged[np.arange(len(a)) + (last_b - in_b + 1)[group_a]] = row_a
        merged[np.arange(len(b)) + (last_a + 1)[group_b]] = row_b
        letters = self.spelled[merged].ravel()
        letters = letters[letters > 0].tobytes()
        ends = np.cumsum(self.width[merged])[last_a[closing] + last_b[closing] + 1].tolist()
        for i, begin, end in zip(full, [0, *ends[:-1]], ends, strict=True):
            out["groups"][i] = letters[begin:end]

    def _pairs(self, a, b, last_b, in_a, in_b, text_of_group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times) of all links, by text and pair. A token of A meets all of B in its group."""
        group = np.repeat(np.arange(len(in_a)), in_a)
        meets = in_b[group]
        first_b, text = (last_b - in_b + 1)[group], text_of_group[group]
        upto, one = np.cumsum(meets), len(self.size_a) * len(self.size_b)
        keys, times, start = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while start < len(a):
            stop = max(start + 1, int(np.searchsorted(upto, upto[start] - meets[start] + LINKS, "right")))
            m = meets[start:stop]
            inside = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            found, n = np.unique(np.repeat(text[start:stop] * one + a[start:stop] * len(self.size_b), m) + b[np.repeat(first_b[start:stop], m) + inside], return_counts=True)
            if len(keys):
                found, at = np.unique(np.concatenate([keys, found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([times, n])).astype(np.int64)
            keys, times, start = found, n, stop
        return keys // one, keys % one, times


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """The texts in parts of about CHARACTERS, each with the place of its first."""
    part, first, size = [], 0, 0
    for i, x in enumerate(column):
        part.append(x.as_py())
        size += len(part[-1] or "")
        if size >= CHARACTERS:
            yield first, part
            part, first, size = [], i + 1, 0
    if part:
        yield first, part


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def align(docs: DataFrame, path_a: str, pattern: str, path_b: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups, pairs and times of every row, and `row`, which tells rows apart within one run.

    groups: `a1,a2|b1;a3|b2,b3`, the ids of each group. pairs: the distinct linked pairs as a * (size of B's vocabulary) + b, ascending;
    times: how many links each has. The files are read on the driver and broadcast (their size is a vocabulary's).
    """
    context = docs.sparkSession.sparkContext
    files, key = context.broadcast((_read(path_a), _read(path_b))), (path_a, pattern, path_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _state.get("key") != key:
            _state.update(key=key, aligner=Aligner(files.value[0], pattern, files.value[1]))
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for first, part in _parts(batch.column(1)):
                x = _state["aligner"].align(part)
                n, ends = x["n"], np.append(0, np.cumsum(x["n"]["pairs"])).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[k], kind)) for k, kind in (("pairs", pa.int64()), ("times", pa.int32()))]
                rows = pa.array(np.arange(row, row + len(part)), pa.int64())
                row += len(part)
                yield pa.RecordBatch.from_arrays([rows, batch.column(0).slice(first, len(part)), *(pa.array(n[k]) for k in ("a", "b", "groups", "links")), pa.array([g.decode() for g in x["groups"]], pa.string()), *lists], ["row", id_column, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(id_column, text_column).mapInArrow(run, f"row long, `{id_column}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair and n, the number of documents that hold it linked."""
    return aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def link_report(docs: DataFrame, path_a: str, pattern: str, path_b: str, *, id_column: str = "doc_id", text_column: str = "text", hot_pairs: int = 1 << 20) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    n_best: links whose pair's count is the highest of its A id. count_sum: the counts of all links together.
    """
    context = docs.sparkSession.sparkContext
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = align(docs, path_a, pattern, path_b, id_column=id_column, text_column=text_column)
    aligned = written(aligned.withColumn("groups_sha256", digest).drop("groups"))
    counts = written(pair_counts(aligned))
    pieces = len(Pieces(_read(path_b)).bytes)
    highest = counts.groupBy(F.floor(F.col("pair") / pieces).alias("a")).agg(F.max("n").alias("n")).toPandas()  # a row for each id of A at most
    best = np.zeros(int(highest["a"].max()) + 1 if len(highest) else 1, np.int64)
    best[highest["a"].to_numpy(np.int64)] = highest["n"]
    hot = most_frequent(counts, hot_pairs).select("pair", "n").toPandas().sort_values("pair")
    tables = context.broadcast((best, hot["pair"].to_numpy(np.int64), hot["n"].to_numpy(np.int64)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, hot, hot_n = tables.value
        for b in batches:
            pairs, times = (b.column(j).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for j in (1, 2))
            of = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
            at = np.searchsorted(hot, pairs).clip(max=max(0, len(hot) - 1))
            hit = hot[at] == pairs if len(hot) else np.zeros(len(pairs), bool)
            n = hot_n[at[hit]]
            count_sum, n_best = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(count_sum, of[hit], n * times[hit])
            np.add.at(n_best, of[hit], times[hit] * (n == best[pairs[hit] // pieces]))
            ends = np.append(0, np.cumsum(np.bincount(of[~hit], minlength=b.num_rows))).astype(np.int32)
            rest = pa.StructArray.from_arrays([pa.array(pairs[~hit]), pa.array(times[~hit]), pa.array(best[pairs[~hit] // pieces])], ["pair", "times", "best"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_best), pa.array(count_sum), pa.ListArray.from_arrays(ends, rest)], ["row", "n_best", "count_sum", "rest"])

    found = aligned.select("row", "pairs", "times").mapInArrow(look_up, "row long, n_best long, count_sum long, rest array<struct<pair:long,times:long,best:long>>")
    rare = found.select("row", F.inline("rest")).join(counts, "pair")
    rare = rare.select("row", (F.col("times") * (F.col("n") == F.col("best")).cast("long")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    totals = found.select("row", "n_best", "count_sum").unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    facts = aligned.select("row", id_column, "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return facts.join(totals, "row").select(id_column, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
