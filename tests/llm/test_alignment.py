import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from verdict.llm import registry
from verdict.llm import token_alignment as ta

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  two  spaces ", "\n\n\n  x", "The cat's 12 hats, they'll go!", "<|endoftext|> and </s> <s> <unk> <0x41>", "été ça ñandú größer", "a" * 3000, "word " * 3000,
    "日本語のテキスト ελληνικά русский", "՘Ᲊ\U0001e030 odd letters", "😀👩‍👩‍👧 emoji", "tab\tnew\r\nline\x85\x1c end", "x" * 70 + " " * 90 + "'s", "�​ zero width", "same", "same", "▁ low line ▁▁", "nul \x00 byte",
    "q7Zr9xKp2Lw8Tn4Vb6" * 40, "................................" * 9, "ﬁ Å ½ full－width", " lead",
]


@pytest.fixture(scope="module")
def plain():
    """Both libraries, and the bytes of their tokens, as they are documented."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = ta.byte_letters()
    name = {i: x for x, i in t.get_vocab().items()}

    def tokens(text):
        if not text:
            return [], []
        a = [(i, bytes(letters[c] for c in name[i])) for i in t.encode(f" {text}", add_special_tokens=False).ids]
        b = [(i, bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()) for i in m.encode(text)]
        whole = f" {text}".encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    return tokens


def brute(rows, tokens):
    """Groups, links and counts by walking both lists."""
    docs, held = [], Counter()
    for i, text in rows:
        a, b = tokens(text)
        ends = [np.cumsum([len(x) for _, x in t]).tolist() for t in (a, b)]
        groups, x, y = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(end, x) + 1, ends[1].index(end, y) + 1
            groups.append(([t for t, _ in a[x:p]], [t for t, _ in b[y:q]]))
            x, y = p, q
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        held.update(set(links))
        docs.append((i, a, b, groups, links))
    best = {}
    for (p, _), n in held.items():
        best[p] = max(best.get(p, 0), n)
    out = []
    for i, a, b, groups, links in docs:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n long, row string, pair string")
    return sorted((tuple(r) for r in ta.link_report(df.repartition(3), A, P.PATTERN, B, **how).collect()), key=repr)


@pytest.mark.parametrize("hot", [1 << 20, 40, 0])
def test_agrees_with_walking(spark, plain, hot):
    rng = random.Random(hot)
    vocabulary = "the and größe naïve token 12345 alignment of misaligned; über x_y.z camelCase".split()
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))) for i in range(40)] + [(5, "again"), (5, "again"), (None, "no id"), (None, None)]
    assert run(spark, rows, hot_pairs=hot) == brute(rows, plain)


def test_parts_do_not_matter(plain, monkeypatch):
    with open(A, "rb") as a, open(B, "rb") as b:
        aligner = ta.Aligner(a.read(), P.PATTERN, b.read())
    whole = aligner.align(TEXTS)
    monkeypatch.setattr(ta, "LINKS", 50)
    monkeypatch.setattr(ta, "RUN", 3)
    again = aligner.align(TEXTS)
    assert whole["groups"] == again["groups"]
    for k in ("pairs", "times"):
        assert (whole[k] == again[k]).all()
    assert (whole["times"].sum(), len(whole["pairs"])) == (whole["n"]["links"].sum(), whole["n"]["pairs"].sum())


def test_ids_are_the_library_s(plain):
    """The faster library is used, and gives what the file's own gives."""
    with open(A, "rb") as a:
        encoder = ta.Encoder(a.read(), P.PATTERN)
    assert encoder.fast is not None
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    for text in filter(None, TEXTS):
        assert encoder.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 400), unique=True), st.lists(st.integers(0, 400), unique=True), st.integers(1, 9))
def test_galloping(x, y, run):
    before, ta.RUN = ta.RUN, run
    try:
        a, b = np.array(sorted(x), np.int64), np.array(sorted(y), np.int64)
        i, j = ta.intersect(a, b)
        assert a[i].tolist() == b[j].tolist() == sorted(set(x) & set(y))
    finally:
        ta.RUN = before


def test_empty_table_and_query(spark, plain, small):
    assert run(spark, [(1, None)]) == [(1, 0, 0, 0, 0, 0, 0, "")]
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ta.link_report(df, A, P.PATTERN, B).count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in registry.op11_token_alignment(spark, small).collect()), key=repr) == brute(rows, plain)
