import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdict.llm import language_id as lid
from verdict.llm import registry
from verdict.llm.common import fold

SAMPLES = {
    "de": "der die das und nicht ist ein eine zu haben werden für größe über straße schön".split(),
    "en": "the of and to in that it with for was on are as they at be this have from".split(),
    "ru": "и в не на что тот быть он весь этот как она к у они мы за вы так".split(),
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(SAMPLES[lang]) for _ in range(n)).capitalize() + "."


def characters(text):
    """A text's characters, spelled plainly: letters in lower case, one space for each run of others after a letter, one at the end."""
    out = []
    for c in text + "\n":
        if c.isalpha():
            out.append(c.lower())
        elif out and out[-1] != " ":
            out.append(" ")
    return out


def plain_model(texts, letters, order=5):
    """Interpolated Kneser-Ney by dictionaries: a function from a text to the sum of logarithms."""
    grams = Counter()
    for t in texts:
        c = [" "] * (order - 1) + characters(t)
        grams.update(tuple(c[i - order + 1 : i + 1]) for i in range(order - 1, len(c)))
    levels, own = {}, grams
    for n in range(order, 0, -1):
        total, kinds = defaultdict(int), defaultdict(int)
        for g, k in own.items():
            total[g[:-1]] += k
            kinds[g[:-1]] += 1
        ones, twos = sum(k == 1 for k in own.values()), sum(k == 2 for k in own.values())
        levels[n] = (own, total, kinds, ones / (ones + 2 * twos) if ones and twos else 0.5)
        own = Counter(g[1:] for g in own)

    def probability(g, n):
        if n == 0:
            return 1 / (letters + 2)
        own, total, kinds, d = levels[n]
        lower = probability(g[1:], n - 1)
        h = g[:-1]
        return (max(own[g] - d, 0) / total[h] + d * kinds[h] / total[h] * lower) if total[h] else lower

    def score(text):
        c = [" "] * (order - 1) + characters(text)
        return sum(math.log(probability(tuple(c[i - order + 1 : i + 1]), order)) for i in range(order - 1, len(c)))

    return score


def trained(texts, held=None):
    """A model of whole short texts, as fit makes it."""
    letters = sorted({ord(c) for own in texts.values() for t in own for c in characters(t) if c != " "})
    names, blank = sorted(texts), lid.Model([], letters, [], [])
    cut = lambda own: [x for t in own for x in np.split(*(lambda s: (s[0], np.cumsum(s[1])[:-1]))(lid.spelled([t], blank.codes)))]
    return lid.Model(names, letters, [cut(texts[x]) for x in names], [cut((held or {}).get(x, [])) for x in names]), letters


def test_probabilities_are_kneser_ney():
    rng = random.Random(5)
    texts = {x: [sentence(rng, x, rng.randint(1, 12)) for _ in range(12)] for x in SAMPLES}
    model, letters = trained(texts)
    plain = {x: plain_model(texts[x], len(letters)) for x in SAMPLES}
    tries = [sentence(rng, x, 9) for x in SAMPLES] + ["Straßen, 12 größer!", "x", "qzq wv", "это 7 the größe", "a1b2"]
    own, kept, _ = lid.spelled(tries, model.codes)
    h = model.entropies(own, kept)
    for i, t in enumerate(tries):
        assert kept[i] == len(characters(t))
        for j, x in enumerate(model.languages):
            assert h[i, j] == pytest.approx(-plain[x](t) / kept[i], rel=1e-5), (t, x)


def test_a_model_sums_to_one():
    rng = random.Random(6)
    model, letters = trained({"en": [sentence(rng, "en", 8) for _ in range(9)]})
    n = len(letters) + 2
    for context in (0, 1 << 12 | 2, 5 << 36 | 3, 4095):
        keys = (np.uint64(context) << np.uint64(12)) | np.append(np.arange(n - 1, dtype=np.uint64), np.uint64(lid.OTHER))
        assert np.exp(model._logs(keys)[:, 0].astype(float)).sum() == pytest.approx(1, rel=1e-4)


def test_chunks_and_batches_do_not_matter(monkeypatch):
    rng = random.Random(7)
    model, _ = trained({x: [sentence(rng, x, 9) for _ in range(9)] for x in SAMPLES})
    tries = [sentence(rng, rng.choice(list(SAMPLES)), rng.randint(1, 90)) for _ in range(25)] + [None, "", "12"]
    whole = model.predict(tries)
    monkeypatch.setattr(lid, "CHUNK", 37)
    assert [x[0] for x in whole] == [x[0] for x in model.predict(tries)]
    for t, x in zip(tries, whole, strict=True):
        one = model.predict([t])[0]
        assert one[0] == x[0] and one[1] == pytest.approx(x[1], abs=1e-6) and one[2] == (None if x[2] is None else pytest.approx(x[2], rel=1e-5))


def test_hash_array():
    for keys in ([], [5], list(range(0, 90000, 7))):
        a = lid.HashArray(np.array(keys, np.uint64))
        tries = np.array([*keys, 1, 2, 2**63], np.uint64)
        got = a.find(tries)
        assert (got[: len(keys)] >= 0).all() and (got[len(keys) :] == -1).all()
        assert (np.array(keys, np.uint64)[a.order][got[: len(keys)]] == tries[: len(keys)]).all()


def table(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", 0.5, "k") for i, t, x in rows], "doc_id long, text string, lang string, source string, score double, letter string")


def test_odd_rows(spark):
    rng = random.Random(8)
    rows = [(3 * i + j, sentence(rng, x, 12), x) for i in range(150) for j, x in enumerate(SAMPLES)]
    odd = [(None, "the of and they", None), (1000, None, "en"), (1001, "", "en"), (1002, "12 34 !?", "de"), (1003, "with this have from " * 20000, None), (1003, "with this have from", None), (1004, "中文 日本語", None), (1005, "́́", None), (1006, "Größe\x00über die Straße", "de")]
    df = table(spark, rows + odd)
    model = lid.fit(df, ~fold(F.col("doc_id"), 3, 1))
    assert model.languages == ["de", "en", "ru"]
    got = lid.predict(df, model).collect()
    assert len(got) == len(rows) + len(odd)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r["score"] <= 1
        by[r["doc_id"]].append(r)
    assert [r["lang_pred"] for r in by[None]] == ["en"]
    for i in (1000, 1001, 1002, 1005):
        assert tuple(by[i][0])[1:] == ("und", 0.0, None, True)
    assert {r["lang_pred"] for r in by[1003]} == {"en"} and len(by[1003]) == 2
    assert by[1004][0]["lang_pred"] in model.languages
    assert by[1006][0]["lang_pred"] == "de" and not by[1006][0]["rejected"]
    right = {(i, t): x for i, t, x in rows}
    for r in by.values():
        for x in r:
            assert x["lang_pred"] in ("und", *model.languages)
    agree = sum(x["lang_pred"] == lang for (i, _), lang in right.items() for x in by[i] if len(by[i]) == 1)
    assert agree == sum(len(by[i]) == 1 for i, _ in right)


def test_bounded_learning(spark):
    rng = random.Random(9)
    df = table(spark, [(i, sentence(rng, x, 60), x) for i in range(300) for x in SAMPLES])
    few = lid.fit(df, F.lit(True), languages=2, letters=10, characters=20000)
    assert len(few.languages) == 2 and len(few.letters) == 10
    whole = lid.fit(df, F.lit(True))
    lang, score, entropy, rejected = whole.predict(["中文日本語中文日本語 中文日本語"])[0]
    assert lang in whole.languages and rejected
    assert not whole.predict([sentence(rng, "de", 20)])[0][3]
    assert lid.fit(df, F.lit(True), characters=20000).predict(["they have this from that"])[0][0] == "en"


def test_every_language_is_learnt(spark):
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 700)]
    of = {f"l{i:02}": "".join(alphabet[10 * i : 10 * i + 10]) for i in range(70)}
    rng = random.Random(10)
    rows = [(i, " ".join("".join(rng.choices(own, k=4)) for _ in range(9)), x) for i, (x, own) in enumerate((y for y in of.items() for _ in range(1 if y[0] == "l69" else 6)))]
    model = lid.fit(table(spark, rows), F.lit(True))
    assert model.languages == sorted(of)
    assert [x[0] for x in model.predict([t for _, t, _ in rows])] == [x for *_, x in rows]


def test_nothing_to_learn_from(spark):
    df = table(spark, [(1, "some text", None), (2, None, "en"), (3, "77", "de")])
    for learn in (F.lit(True), F.lit(False)):
        got = {r["doc_id"]: tuple(r)[1:] for r in lid.predict(df, lid.fit(df, learn)).collect()}
        assert set(got.values()) == {("und", 0.0, None, True)}
    assert lid.predict(df.where("false"), lid.fit(df.where("false"), F.lit(True))).count() == 0


def test_held_out_accuracy(spark):
    """The query itself, on rows that taught nothing."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    got = registry.op13_language_id(spark, folder).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"] and r["text"]]
    right = sum(r["lang_pred"] == r["lang"] for r in held)
    assert right >= 0.97 * len(held)
    assert sum(r["rejected"] for r in held) <= 0.1 * len(held)
