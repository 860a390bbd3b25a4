import base64
import hashlib
import re
import struct
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_pairs import brute

import corpus_pipeline
from verdict.llm import chat_format, mixing, quality_mil, toxicity_crf
from verdict.llm.common import fold

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello <|im_end|>"),
    (2, 0, "system", "be kind"), (2, 1, "user", "hi"), (2, 2, "assistant", "other \\n \\ text"),
    (3, 0, "system", "be kind"), (4, 0, None, None), (5, 1, "user", ""), (5, 0, "assistant", "<"), (5, 0, "assistant", "<"), (5, None, "role\nwith line", "x"),
    (None, 0, "user", "no id"), (6, 0, "system", "be kind"), (6, 1, "user", "hi"), (6, 2, "assistant", "hello <|im_end|>"), (7, 0, "assistant", "long " * 40000),
]


@pytest.mark.parametrize("pack_chars", [10, 65536])
def test_chat_round_trip(spark, pack_chars):
    turns = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, leaf string")
    packs = chat_format.format_conversations(turns, pack_chars=pack_chars)
    got = {r["conv_id"]: r for r in chat_format.read_back(packs).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for conv in {t[0] for t in TURNS}:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in TURNS if t[0] == conv))
        loss = "".join(x for *_, role, x in own if role == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for *_, r, x in own))
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), sha(loss))
    assert len(got) == 8
    assert chat_format.read_back(chat_format.format_conversations(turns.where("false"))).count() == 0


def test_shared_turns_are_emitted_once(spark):
    rows = [(i, 0, "system", "shared") for i in range(20)] + [(i, 1, "user", f"own {i}") for i in range(20)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    packs = chat_format.format_conversations(turns).collect()
    assert sum(p["text"].count("shared") for p in packs) == len(packs) <= 4
    for p in packs:
        for n in p["nodes"]:
            parent = p["nodes"][n["parent"]] if n["parent"] >= 0 else None
            assert n["position"] == (parent["position"] + parent["end"] - parent["start"] if parent else 0)
            assert parent is None or parent["end"] <= n["start"]


def mixture(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, size string, _extra int")


def test_mix_keeps_its_promises(spark):
    rows = [(i, "w " * (i % 40), ["a", "b", None, "é"][i % 7 % 4]) for i in range(2000)] + [(5000, None, "a"), (5001, "giant " * 20000, "b"), (7, "w w w", "a"), (7, "w w w", "a"), (None, "q q", "a")]
    docs = mixture(spark, rows)
    out = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    assert len(out) == len(rows)
    total = sum(r["size"] for r in out)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in out)
    assert 1.5 * total - 20000 <= sum(r["taken"] for r in out) <= 1.5 * total
    copies = mixing.apply_mix(docs)
    assert copies.columns == docs.columns
    assert copies.count() == sum(r["taken"] // r["size"] for r in out if r["size"])
    for empty in (docs.where("false"), docs.where("text is null")):
        assert all(r["taken"] == 0 and r["target"] == 0 for r in mixing.mix(empty).collect())


def test_mix_takes_clashing_columns_and_many_ranges(spark):
    names = ["_row", "_key", "_size", "_tie", "_source", "_range", "_rank", "_first", "_second", "_offset", "_of", "_at", "_total", "_target", "_copy", "col"]
    docs = mixture(spark, [(i, "w " * (i % 9), "hot" if i % 3 else f"s{i % 5}") for i in range(500)]).drop("size", "_extra")
    plain = sorted(tuple(r) for r in mixing.apply_mix(docs).collect())
    wide = mixing.apply_mix(docs.select("*", *(F.lit(1).alias(n) for n in names)))
    assert wide.columns == [*docs.columns, *names]
    assert sorted(tuple(r)[:3] for r in wide.collect()) == plain
    ranges = spark.createDataFrame([("a", f"{i:03x}", i % 7) for i in range(4096)] + [(None, "0ff", 5)], "_source string, _range string, _sum long")
    got = {(r["_source"], r["_range"]): r["_offset"] for r in mixing._offsets(ranges, 2).collect()}
    assert got == {("a", f"{i:03x}"): sum(j % 7 for j in range(i)) for i in range(4096)} | {(None, "0ff"): 0}


def test_targets_reshare_what_is_left(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 1)], "_source string, _total long")
    got = {r["_source"]: r["_target"] for r in mixing.targets(sizes, (3, 1, 2), 1.5, 2).collect()}
    budget, weights, cap = 1.5 * 2011, {"a": 3, "b": 1, "c": 2, None: 3}, {"a": 20, "b": 2000, "c": 2000, None: 2}
    want, full = {}, set()
    while True:
        left = budget - sum(cap[s] for s in full)
        want = {s: cap[s] if s in full else left * weights[s] / sum(w for t, w in weights.items() if t not in full) for s in weights}
        over = {s for s in want if s not in full and want[s] > cap[s]}
        if not over:
            break
        full |= over
    assert got == pytest.approx(want)


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    extra = docs.limit(3).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.unionByName(extra)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mix", "tokenise"]

    good = corpus_pipeline.quality(spark, docs, small)
    model = quality_mil.fit(docs, labels, ~fold(F.col("doc_id"), 3, 1))
    assert good.columns == docs.columns
    assert good.count() == quality_mil.score(docs, model).where("predicted = 1").count()

    clean = corpus_pipeline.toxicity(spark, docs, small)
    field = toxicity_crf.fit(docs, labels, ~fold(F.col("doc_id"), 5, 0))
    assert clean.columns == docs.columns
    assert clean.count() == toxicity_crf.score(docs, field).where("predicted = 0").count()

    once = corpus_pipeline.near_duplicates(spark, docs, small)
    rows = [(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()]
    want = {i for i, (_, c) in brute(rows).items() if i == c}
    kept = [r["doc_id"] for r in once.collect()]
    assert once.columns == docs.columns
    assert sorted(i for i in kept if i is not None) == sorted(want)
    assert kept.count(None) == 0  # a copy of a document that has an id

    mixed = corpus_pipeline.mix(spark, docs, small)
    assert mixed.columns == docs.columns

    ids = {r["doc_id"]: r for r in corpus_pipeline.tokenise(spark, docs.limit(50), small).collect()}
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in docs.limit(50).collect():
        own = encoding.encode_ordinary(r["text"])
        assert ids[r["doc_id"]]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(own)}I", *own)).hexdigest()


def test_pipeline_runs(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert out.count() > 0


def plain_mix(rows):
    """How often each row is taken: all items of all sources in order of finish time, until the budget is spent."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = {}
    for (_, _, s), n in zip(rows, sizes, strict=True):
        total[s] = total.get(s, 0) + n
    ranks = {s: i for i, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    weights, budget, full = {s: (3, 1, 2)[i % 3] for s, i in ranks.items()}, 1.5 * sum(total.values()), set()
    while True:
        left = budget - sum(2 * total[s] for s in full)
        open_ = sum(w for s, w in weights.items() if s not in full)
        target = {s: 2 * total[s] if s in full else left * w / open_ for s, w in weights.items()}
        over = {s for s in target if s not in full and target[s] > 2 * total[s]}
        if not over:
            break
        full |= over
    items = {}
    for s in total:
        sent = 0
        own = [i for i, r in enumerate(rows) if r[2] == s]
        for i in sorted(own, key=lambda i: (hashlib.md5(str(rows[i][0] if rows[i][0] is not None else rows[i][1] or "").encode()).hexdigest(), sizes[i], rows[i][1] or "")):
            sent += sizes[i]
            for before in (0, total[s]):
                if sizes[i]:
                    items.setdefault(((before + sent) / target[s], ranks[s]), []).append(i)
    taken, spent = [0] * len(rows), 0
    for at in sorted(items):
        spent += sum(sizes[i] for i in items[at])
        if spent > budget:
            break
        for i in items[at]:
            taken[i] += 1
    return taken


@pytest.mark.parametrize("rows", [[], [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "de", "t", 11), (None, None, None, None, None), (2, "a b c d e f g", "en", None, 13)]])
def test_pipeline_without_rows_or_labels(spark, tmp_path, rows):
    """Without labels both classifiers keep all; one of the copies stays, rows without words go, on each run the same."""
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = [sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) for _ in range(2)]
    assert out[0] == out[1]
    assert {r[0] for r in out[0]} == ({1, 2} if rows else set())


def test_mix_stage_agrees_with_a_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    want = Counter()
    for row, n in zip(rows, plain_mix(rows), strict=True):
        want[row] += n
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.mix(spark, docs, small).collect())
    assert got == +want and 1 < max(got.values()) <= 2
