import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdict.llm import pitman_yor, quality_mil, registry, toxicity_crf
from verdict.llm.common import fold, hashed_words, words

SCHEMA = "doc_id long, text string, score string, spans string, label int"


def field_of(rng, words):
    f = toxicity_crf.Field([f"w{i}" for i in range(words)])
    f.emission, f.transition = rng.normal(size=words + 1), rng.normal(size=(2, 2))
    return f.prepare()


def test_marginals_agree_with_all_taggings():
    rng = np.random.default_rng(1)
    f = field_of(rng, 3)
    for _ in range(30):
        words = rng.integers(0, 4, 7)
        total = np.zeros(7)
        z = 0.0
        for tags in itertools.product((0, 1), repeat=7):
            e = sum(f.emission[w] * t for w, t in zip(words, tags, strict=True)) + sum(f.transition[a, b] for a, b in itertools.pairwise(tags))
            z += np.exp(e)
            total += np.exp(e) * np.array(tags)
        hits = [(i, int(w)) for i, w in enumerate(words) if w < 3]
        np.testing.assert_allclose(f.tag(hits, 7), [total[i] / z for i, _ in hits], atol=1e-9)
        np.testing.assert_allclose(f.marginals(words[None])[0][0], total / z, atol=1e-9)


def test_long_stretches():
    f = field_of(np.random.default_rng(2), 1)
    words = np.ones((1, 1000), int)
    words[0, [0, 3, 700]] = 0
    np.testing.assert_allclose(f.tag([(0, 0), (3, 0), (700, 0)], 1000), f.marginals(words)[0][0][[0, 3, 700]], atol=1e-9)


def test_windows_hold_every_hit():
    hits = [(3 * i, i % 2) for i in range(1000)]
    words, tags, _ = toxicity_crf._windows([(1, hits, 3000)], np.ones(1), 2)
    assert (words < 2).sum() >= tags.sum() >= len(hits)
    far = [(i * 100, 0) for i in range(500)]
    assert len(toxicity_crf._windows([(1, far, 50000)], np.ones(1), 2)[0]) == len(far)


def test_attention_gradients():
    rng = np.random.default_rng(3)
    model = quality_mil.Attention()
    bags = [rng.normal(size=(n, quality_mil.FEATURES)) for n in (1, 4, 2)] + [np.zeros((0, quality_mil.FEATURES))]
    y, w = np.array([1.0, 0, 1, 0]), np.full(4, 0.25)
    x, first = model.packed(bags)

    def loss():
        p = model.forward(x, first)["score"]
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    for k, g in model.gradients(x, first, y, w).items():
        at = tuple(0 for _ in g.shape)
        kept = model.p[k][at]
        model.p[k][at] = kept + 1e-5
        up = loss()
        model.p[k][at] = kept - 1e-5
        down = loss()
        model.p[k][at] = kept
        assert (up - down) / 2e-5 == pytest.approx(g[at], abs=1e-7)


@pytest.mark.parametrize(("name", "label", "least"), [("op3_toxicity", "toxic", 0.93), ("op4_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.01"
    scored = registry.queries()[name](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    rows = scored.where("held_out").select("doc_id", "score", "predicted", label).collect()
    modulus, held = (5, 0) if label == "toxic" else (3, 1)
    assert rows and all(zlib.crc32(str(r["doc_id"]).encode()) % modulus == held for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] == r[label] for r in rows) / len(rows) >= least


@pytest.mark.parametrize("module", [toxicity_crf, quality_mil])
def test_odd_texts_and_labels(spark, module):
    texts = [None, "", " \n ", "word", "x" * 100_000, "a b c " * 20_000, "same text", "same text", "### $$$"]
    docs = spark.createDataFrame([(i, t, "s", "t", 1) for i, t in enumerate(texts)] + [(None, "no id", "s", "t", 1)], SCHEMA)
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 1), (3, 1, None), (6, None, None), (None, 1, 1), (8, 7, 7)], "doc_id long, quality int, toxic int")
    for use in (labels, labels.where("false"), labels.where("doc_id = 0")):
        model = module.fit(docs, use, F.lit(True))
        out = module.score(docs, model).collect()
        assert len(out) == len(texts) + 1
        assert all(0 <= r["score"] <= 1 for r in out)
        assert module.score(docs.where("false"), model).count() == 0
    keep = module.keep_clean if module is toxicity_crf else module.keep_good
    assert keep(docs, model).columns == docs.columns


def test_spans_are_the_offenders(spark):
    rng = np.random.default_rng(5)
    plain = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(240):
        own = list(rng.choice(plain, 30))
        if i % 3 == 0:
            own[int(rng.integers(0, 30))] = "Vile"
            own[int(rng.integers(0, 30))] = "awful"
        rows.append((i, " ".join(own), None, None, int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = docs.select("doc_id", F.col("label").alias("toxic"))
    field = toxicity_crf.fit(docs, labels, ~fold(F.col("doc_id"), 5, 0))
    for r in toxicity_crf.score(docs.withColumnRenamed("label", "predicted"), field).collect():
        text = rows[r["doc_id"]][1]
        assert r["predicted"] == rows[r["doc_id"]][4]
        assert {w for s in r["spans"] for w in text[s["start"] : s["end"]].lower().split()} <= {"vile", "awful"}
        assert bool(r["spans"]) == bool(r["predicted"])


def test_lm_counts_and_probabilities(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(["the", "a", "Of", "x", "yy", "zzz"], rng.integers(0, 40))) for _ in range(80)] + [None, "", "new words here", "big " * 30_000]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_known int")
    train = ~fold(F.col("doc_id"), 5, 1)
    got = {r["doc_id"]: r for r in pitman_yor.score(docs, train).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    words = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(texts)}
    count = {}
    for i, ws in words.items():
        for w in ws:
            count[w] = count.get(w, 0) + (not held[i])
    count = {w: c for w, c in count.items() if c}
    n, v = sum(count.values()), len(count)
    for i, ws in words.items():
        base = sum(np.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in count for w in ws), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def test_lm_every_context_sums_to_one(spark, monkeypatch):
    """The scores of one and two words give, for every context, the probabilities of all that may follow it."""
    monkeypatch.setattr(pitman_yor, "BUCKET", 60)
    monkeypatch.setattr(pitman_yor, "HOT", 6)
    rng = np.random.default_rng(8)
    vocabulary = ["the", "a", "x", "yy", "zzz", "q", "r", "s"]
    texts = [(None, " ".join(rng.choice(vocabulary, 12, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.03, 0.02]))) for _ in range(60)]
    every = [*vocabulary, "unknown"]
    asked = ["", *every, *(f"{a} {b}" for a in every for b in every)]
    docs = spark.createDataFrame(texts + list(enumerate(asked)), "doc_id long, text string")
    out = pitman_yor.score(docs, F.col("doc_id").isNull()).where("doc_id is not null").collect()
    p = {asked[r["doc_id"]]: 10 ** r["score"] for r in out}
    # With y(a) the probability of a first word a: y(a) = sum over b of p(a b) / p(b) * y(b) + p(a).
    n = len(every)
    m = np.array([[p[f"{a} {b}"] / p[b] for b in every] for a in every])
    y = np.linalg.solve(np.eye(n) - m, np.array([p[a] for a in every]))
    assert y.sum() + p[""] == pytest.approx(1, abs=1e-4)


def sequential_sampler(texts, sweeps, burn, discount, root_discount, seed):
    """A plain sampler of the same model, one customer at a time with everything up to date; mean probabilities by pair."""
    rng = np.random.default_rng(seed)
    tokens = [(a, b) for t in texts for a, b in itertools.pairwise(["", *t.split(), ""])]
    known = sorted({b for _, b in tokens})
    base = 1 / (len(known) + 1)
    rooms, root = {}, {}

    def p_root(w):
        k, t = sum(map(sum, root.values())), sum(map(len, root.values()))
        own = root.get(w, [])
        return (sum(own) - root_discount * len(own) + (pitman_yor.STRENGTH_ROOT + root_discount * t) * base) / (pitman_yor.STRENGTH_ROOT + k)

    def sit(tables, d, fresh):
        x = rng.random() * (sum(tables) - d * len(tables) + fresh)
        for i, n in enumerate(tables):
            x -= n - d
            if x < 0:
                tables[i] += 1
                return False
        tables.append(1)
        return True

    def leave(tables):
        i = rng.choice(len(tables), p=np.array(tables) / sum(tables))
        tables[i] -= 1
        if not tables[i]:
            del tables[i]
            return True
        return False

    def add(u, w):
        own = rooms.setdefault(u, {})
        if sit(own.setdefault(w, []), discount, (pitman_yor.STRENGTH + discount * sum(map(len, own.values()))) * p_root(w)):
            t = sum(map(len, root.values()))
            sit(root.setdefault(w, []), root_discount, (pitman_yor.STRENGTH_ROOT + root_discount * t) * base)

    for u, w in tokens:
        add(u, w)
    total = {}
    for i in range(sweeps):
        for u, w in tokens:
            if leave(rooms[u][w]):
                leave(root[w])
            add(u, w)
        if i >= burn:
            for u in rooms:
                c, t = sum(map(sum, rooms[u].values())), sum(map(len, rooms[u].values()))
                for w in known:
                    own = rooms[u].get(w, [])
                    q = (sum(own) - discount * len(own) + (pitman_yor.STRENGTH + discount * t) * p_root(w)) / (pitman_yor.STRENGTH + c)
                    total[u, w] = total.get((u, w), 0) + q / (sweeps - burn)
    return total


def test_lm_agrees_with_a_sequential_sampler(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["the", "a", "b", "c", "d"]
    texts = [" ".join(rng.choice(words, 8, p=[0.5, 0.2, 0.1, 0.1, 0.1])) for _ in range(40)]
    monkeypatch.setattr(pitman_yor, "_discounted", lambda one, two: 0.6)
    docs = spark.createDataFrame([(None, t) for t in texts] + list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score(docs, F.col("doc_id").isNull(), burn_in=20, samples=40).where("doc_id is not null").collect()}
    p = sequential_sampler(texts, 150, 30, 0.6, 0.6, 1)
    want = [sum(np.log10(p[x]) for x in itertools.pairwise(["", *t.split(), ""])) for t in texts]
    np.testing.assert_allclose([got[i] for i in range(len(texts))], want, rtol=0.02)  # samples of both vary by about 0.01


def test_seating_keeps_the_distribution_of_tables():
    """Tables of one pair of four customers, after sweeps, against the probabilities of all seatings."""
    d, fresh, n = 0.4, 0.7, 20_000
    s = pitman_yor.Seating(np.full(n, 4))
    draw = np.random.default_rng(1)
    for _ in range(12):
        s.sweep(d, lambda pairs, emptied: np.full(len(pairs), fresh), lambda pairs, x: None, draw)
    assert len(s.sizes) == s.t.sum() and s.sizes.sum() == 4 * n
    # Partitions of four customers in t tables: the weight is fresh per table and (1 - d)(2 - d)... within each.
    rise = {1: 1.0, 2: 1 - d, 3: (1 - d) * (2 - d), 4: (1 - d) * (2 - d) * (3 - d)}
    weight = {1: fresh * rise[4], 2: fresh**2 * (4 * rise[3] + 3 * rise[2] ** 2), 3: fresh**3 * 6 * rise[2], 4: fresh**4}
    got = np.bincount(s.t, minlength=5)[1:] / n
    np.testing.assert_allclose(got, [weight[t] / sum(weight.values()) for t in range(1, 5)], atol=0.02)
    begun = pitman_yor.Seating(np.array([2, 70, 5000])).seat(d, np.array([0.1, 3.0, 50.0]), draw)
    assert np.add.reduceat(begun.sizes, np.cumsum(begun.t) - begun.t).tolist() == [2, 70, 5000] and begun.sizes.min() >= 1


def test_root_seats_all_customers_of_frequent_words():
    """The tables of words with so many customers against the distribution by the plain recurrence."""
    d, w, n, draw = 0.8, 1.5, 4000, np.random.default_rng(5)
    s = {1: 1.0}
    for c in range(1, 600):
        s = {t: (s.get(t - 1, 0) * w + max(c - t * d, 0) * s.get(t, 0)) / c for t in range(1, c + 2) if t < 40}
    want = np.array([s[t] for t in range(1, 40)]) / sum(s.values())
    got = pitman_yor._root_seats(np.concatenate((np.full(n, 600), [0, 1, 100_000])), d, w, draw)
    assert got[-3:-1].tolist() == [0, 1] and 1 <= got[-1] < 40
    share = np.bincount(got[:n].astype(int), minlength=40)[1:40] / n
    assert np.abs(share - want).max() < 0.03
    shares = np.diff(pitman_yor._table_shares(np.array([2, 600]), d, w, 100), prepend=0)
    assert np.abs(shares[1] - want[: shares.shape[1]]).max() < 1e-9 and abs(shares[0][0] - (1 - d) / (1 - d + w)) < 1e-9


def test_lm_hot_pairs_and_dealt_contexts(spark, monkeypatch):
    """A pair and a context of a third of all tokens: counts are whole, and the score is that of one bucket."""
    rng = np.random.default_rng(5)
    texts = [" ".join(["ha", "ho"] * 15 + list(rng.choice([f"w{i}" for i in range(30)], 10))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    whole = {r["doc_id"]: r for r in pitman_yor.score(docs, F.col("doc_id") % 5 != 1, burn_in=5, samples=25).collect()}
    monkeypatch.setattr(pitman_yor, "BUCKET", 300)
    dealt = {r["doc_id"]: r for r in pitman_yor.score(docs, F.col("doc_id") % 5 != 1, burn_in=5, samples=25).collect()}
    for i, r in whole.items():
        assert dealt[i][:4] == r[:4] and dealt[i]["base_score"] == pytest.approx(r["base_score"], rel=1e-9)
        assert dealt[i]["score"] == pytest.approx(r["score"], rel=0.02)


def test_lm_without_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = pitman_yor.score(docs, F.lit(False)).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert pitman_yor.score(docs.where("false"), F.lit(True)).count() == 0


def test_lm_has_a_restaurant_for_every_preceding_word(spark):
    n = 200
    texts = [(None, f"x{i} y{i}") for i in range(n) for _ in range(5)]
    asked = [(i, f"x{i} y{i}") for i in range(n)] + [(n + i, f"x{i} y{(i + 1) % n}") for i in range(n)]
    docs = spark.createDataFrame(texts + asked, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score(docs, F.col("doc_id").isNull()).where("doc_id is not null").collect()}
    assert len(got) == 2 * n
    assert all(got[i] > got[n + i] + 0.5 for i in range(n))


def test_hashed_words_are_those_of_words():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    letters = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", " ", "A", "z", "É", "ß", "漢", "-"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(400)] + [None, "", "   ", "x" * 10_000 + " " + "X" * 64 + " " + "x" * 65, "x" * 64, "X" * 65]
    array = pa.array(["cut off", *texts], pa.string()).slice(1)
    hashes, counts = hashed_words(array)
    plain = [words(t) for t in texts]
    assert counts.tolist() == [len(own) for own in plain]
    seen = {}
    for word, h in zip([w for own in plain for w in own], hashes.tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    assert [len(x) for x in hashed_words(pa.array([], pa.string()))] == [0, 0]
    large = hashed_words(array.cast(pa.large_string()))  # as a session with large variable types sends them
    assert (large[0] == hashes).all() and (large[1] == counts).all()


def test_lm_numbers_of_hot_words():
    hashes = np.unique(np.random.default_rng(3).integers(2, 2**63, 5000, np.uint64))
    m = pitman_yor.Shared(hashes[:3000])
    codes = m.numbered(np.concatenate((hashes, hashes[:5])))
    assert codes[:3000].tolist() == list(range(3000)) and codes[-5:].tolist() == list(range(5))
    assert (codes[3000:-5] == hashes[3000:] | np.uint64(1 << 63)).all()
