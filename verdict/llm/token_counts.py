"""Operator 1, token counts: a broadcast table of frequent pre-token lengths, then caches in the workers.

A byte-level BPE tokenizer splits a text into pre-tokens and merges bytes inside each alone, so a text has as
many tokens as its pre-tokens have together. Tier 1 is a broadcast table, pre-token -> number of tokens, of the
`hot_pieces` most frequent pre-tokens in a bounded sample of rows. Tier 2 is a cache in each Python worker that
encodes what tier 1 lacks with the tokenizer's own library and keeps it, up to `cache_pieces` entries. No
pre-token is shuffled. The sample only decides what is looked up fast: counts are the same with any table.

Texts that the plain split could treat otherwise than the library go to the library whole: those with the string
of an added token, and those with characters outside PLAIN, for which the split's Unicode tables may be of
another version. Tokenizers of other kinds (word BPE, SentencePiece) encode whole texts in the workers.

Null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each. Other columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters on which the split below and the tokenizer's own agree (tests/llm checks each).
PLAIN = r"[^\x00-՗؀-ۿऀ-૿Ḁ-῿ -⁯₠-₿℀-⯿　-㏿一-鿯가-힣＀-￯]"

_state: dict = {}


class _Lengths(dict):
    """Pre-token -> number of tokens: the broadcast table, then what this worker has encoded."""

    def __init__(self, hot: dict[str, int], tokenizer, cache_pieces: int):
        super().__init__(hot)
        self.hot, self.tokenizer, self.most = hot, tokenizer, len(hot) + cache_pieces

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
                self.update(self.hot)
            self[piece] = n
        return n


class _Counter:
    """Counts the tokens of texts; one for each Python worker."""

    def __init__(self, file: bytes, kind: str, pattern: str, hot: dict[str, int], cache_pieces: int):
        self.tiers = False
        if kind == "model":
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
            self.whole = lambda text: len(self.model.encode(text))
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(file.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.whole = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
        self.tiers = tiered(file)
        if self.tiers:
            added = [x["content"] for x in json.loads(file)["added_tokens"]]
            odd = "|".join([PLAIN, *map(regex.escape, added)])
            self.odd, self.split = regex.compile(odd).search, regex.compile(pattern).findall
            self.length = _Lengths(hot, tokenizer, cache_pieces)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.tiers or self.odd(text):
            return self.whole(text)
        return sum(map(self.length.__getitem__, self.split(text)))


def tiered(file: bytes) -> bool:
    """Whether a tokenizer file is a byte-level BPE that counts pre-token by pre-token."""
    x = json.loads(file)
    pre = x.get("pre_tokenizer") or {}
    return x["model"]["type"] == "BPE" and x.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


def _hot_pieces(docs: DataFrame, text: str, pattern: str, file, hot_pieces: int, sample_rows: int, seed: int) -> dict[str, int]:
    """The most frequent pre-tokens of about `sample_rows` rows from all over the table, with their lengths.

    A few tasks count whole texts and return `hot_pieces` entries each at most, so what reaches the driver is bounded.
    """
    rows = docs.count()
    if not rows:
        return {}
    tasks = 8

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        found, split = Counter(), regex.compile(pattern).findall
        for batch in batches:
            for x in batch.column(0).to_pylist():
                found.update(split(x))
        top = [(p, n) for p, n in found.most_common(hot_pieces) if len(p) <= 64]
        sizes = [len(e.ids) for e in Tokenizer.from_str(file.value.decode()).encode_batch([p for p, _ in top], add_special_tokens=False)]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64()), pa.array(sizes, pa.int32())], ["piece", "n", "length"])

    sample = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).sample(min(1.0, sample_rows / rows), seed)
    found, length = Counter(), {}
    for piece, n, size in sample.repartition(tasks).mapInArrow(count, "piece string, n long, length int").collect():
        found[piece] += n
        length[piece] = size
    return {p: length[p] for p, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:hot_pieces]}


def token_counts(docs: DataFrame, tokenizer_path: str, pattern: str, *, id_column: str = "doc_id", text_column: str = "text", limit: int = 512, hot_pieces: int = 32768, sample_rows: int = 4000, cache_pieces: int = 400_000, seed: int = 1) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    tokenizer_path: a .json of the tokenizers library or a SentencePiece .model; it is read on the driver and
    broadcast (its size is that of a vocabulary). pattern: the split of a byte-level tokenizer.
    """
    context = docs.sparkSession.sparkContext
    kind = "model" if tokenizer_path.endswith(".model") else "json"
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    file = context.broadcast(content)
    hot = _hot_pieces(docs, text_column, pattern, file, hot_pieces, sample_rows, seed) if kind == "json" and tiered(content) else {}
    table, key = context.broadcast(hot), (tokenizer_path, pattern, len(hot), cache_pieces, seed, id(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _state.get("key") != key:
            _state.update(key=key, counter=_Counter(file.value, kind, pattern, table.value, cache_pieces))
        count = _state["counter"].count
        for batch in batches:
            texts = batch.column(1)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n_tokens = [count(x.as_py()) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], [id_column, "n_bytes", "n_tokens", "over_limit"])

    kind_of_id = dict(docs.dtypes)[id_column]
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind_of_id}, n_bytes long, n_tokens long, over_limit boolean")
