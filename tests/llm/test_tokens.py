import base64
import hashlib
import struct

import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from verdict.llm import byte_bpe, token_counts

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " ", "\n\n\n  x", "The cat's 12 hats, they'll go!", "<|endoftext|> and <|endoftext|>", "été ça ñandú größer", "a" * 5000, "word " * 20000,
    "日本語のテキスト ελληνικά русский", "՘Ᲊ\U0001e030 odd letters", "😀👩‍👩‍👧 emoji", "tab\tnew\r\nline\x85\x1c end", "x" * 70 + " " * 90 + "'s", "�​ zero width", "same", "same",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "extra", 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string, n_bytes int")


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_are_the_library_s(docs):
    t = Tokenizer.from_file(JSON)
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs, JSON, P.PATTERN, hot_pieces=5, cache_pieces=3).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((text or "").encode()), n > 512), text


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_count_whole_texts(docs, name):
    path = P.path(name)
    if name.endswith(".model"):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda x: len(m.encode(x))
    else:
        t = Tokenizer.from_file(path)
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, path, P.PATTERN).collect()}
    assert got == {i: count(x or "") for i, x in enumerate(TEXTS)}


def test_plain_characters_split_alike():
    pre, split = Tokenizer.from_file(JSON).pre_tokenizer, regex.compile(P.PATTERN)
    odd = regex.compile(token_counts.PLAIN)
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000 or odd.search(chr(c)):
            continue
        s = f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)}-{chr(c)}"
        assert [m.span() for m in split.finditer(s)] == [x for _, x in pre.pre_tokenize_str(s)], hex(c)


def test_encoding_and_decoding(spark, docs, encoding):
    encoded = byte_bpe.encode(docs.drop("n_tokens"), RANKS, P.PATTERN, cache_pieces=4)
    got = {r["doc_id"]: r for r in byte_bpe.digests(encoded).collect()}
    back = {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode(encoded, RANKS).collect()}
    for i, text in enumerate(TEXTS):
        ids = encoding.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
        assert back[i] == (text or "").encode()
    none = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert byte_bpe.decode(none, RANKS).first()["decoded"] is None


def test_empty_tables(docs):
    empty = docs.where("false")
    assert token_counts.token_counts(empty, JSON, P.PATTERN).count() == 0
    assert byte_bpe.encode(empty.drop("n_tokens"), RANKS, P.PATTERN).count() == 0


def test_perfect_hash():
    keys = [str(i).encode() for i in range(3000)] + [b""]
    perfect = byte_bpe.PerfectHash(keys)
    assert sorted(perfect.slots) == sorted(keys)
    assert all(perfect.slots[perfect.find(k)] == k for k in keys)
    assert perfect.find(b"none") == -1
    assert byte_bpe.PerfectHash([]).find(b"x") == -1


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=30))
def test_merges_are_the_library_s(text):
    ranks = test_merges_are_the_library_s.__dict__.setdefault("ranks", byte_bpe.read_ranks(RANKS))
    encoding = test_merges_are_the_library_s.__dict__.setdefault("encoding", tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    own = [i for piece in regex.findall(P.PATTERN, text) for i in byte_bpe.merge_bytes(piece.encode(), ranks)]
    assert own == encoding.encode_ordinary(text)
