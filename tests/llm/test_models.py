"""Learned scores: exactness where it can be computed, and accuracy on rows held out."""

import math
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pytest

from spindrift.llm import langid, lattice, quality, toxicity
from spindrift.llm.sampling import labelled

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    from spindrift.llm.shared import table

    return {n: table(spark, SF, n) for n in ("documents", "labels")}


def held(i, m):
    return zlib.crc32(str(i).encode()) % m == 2


# --- language ------------------------------------------------------------------


def plain_length(model, j, text):
    data, bits = langid.START + text.lower(), 0.0
    for i in range(langid.ORDER, len(data)):
        for order in range(langid.ORDER, -1, -1):
            context, gram = (int.from_bytes(data[i - order : e], "big") for e in (i, i + 1))
            at = np.nonzero(model.contexts[order] == context)[0]
            if not len(at) or not model.totals[order][at[0], j]:
                continue
            n, d = model.totals[order][at[0], j], model.kinds[order][at[0], j]
            where = np.nonzero(model.grams[order] == gram)[0]
            c = model.counts[order][where[0], j] if len(where) else 0
            if c:
                bits += math.log2((n + d) / c)
                break
            bits += math.log2((n + d) / d)
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact(monkeypatch):
    model = langid.ContextTrees({"a": [b"the cat sat on the mat", b"the hat"], "b": ["größe über tür".encode(), b""], "c": []})
    texts = [b"", b"the bat", "über the größe €".encode(), b"x" * 50, b"the cat " * 40]
    want = [[plain_length(model, j, t) for j in range(3)] for t in texts]
    assert np.allclose(model.code_lengths(texts), want, rtol=1e-5)
    monkeypatch.setattr(langid, "PIECE", 16)
    monkeypatch.setattr(langid, "TABLE_BYTES", 20 * 8)  # grams collide
    model.forget()
    assert np.allclose(model.code_lengths(texts), want, rtol=1e-5)


def test_conditional_code_is_no_better_than_a_code():
    model = langid.ContextTrees({"a": [b"abracadabra " * 5]})
    grams = np.array([int.from_bytes(b"abra", "big") << 8 | b for b in range(256)], np.uint64)
    assert np.exp2(-model.lengths(grams)[:, 0]).sum() <= 1 + 1e-9


def test_language(spark, tables):
    docs = tables["documents"]
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == held(r["doc_id"], 4) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in out]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    english = [(i, "the quick brown fox and the dog", "en", "x") for i in range(20)]
    german = [(i + 50, "der schnelle braune fuchs und der hund", "de", "x") for i in range(20)]
    odd = [(100, None, "en", "x"), (101, "", None, "x"), (102, "123 !?", "de", "x"), (None, "the dog", "en", "x"), (103, "und der hund " * 50_000, None, "x"), (103, "the fox", None, "x")]
    docs = spark.createDataFrame(english + german + odd, "doc_id long, text string, lang string, score string")
    got = [(r["doc_id"], r["lang_pred"], r["held_out"]) for r in langid.identify(docs).collect()]
    assert len(got) == 46
    assert {(i, p) for i, p, _ in got if i is None or i >= 100} == {(100, "und"), (101, "und"), (102, "und"), (None, "en"), (103, "de"), (103, "en")}
    assert all(h for i, _, h in got if i is None)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 43
    assert langid.identify(docs.limit(0)).count() == 0
    unknown = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r["lang_pred"] for r in langid.identify(unknown).collect()} == {"und"}


def test_sample_is_bounded(spark):
    docs = spark.range(5000).selectExpr("id doc_id", "concat('a', id) text", "if(id % 3 = 0, 'x', 'y') lang")
    rows = langid.training_sample(docs, max_docs=50).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in rows} == {"x": 50, "y": 50}


# --- quality and toxicity ------------------------------------------------------


@pytest.mark.parametrize(("score", "label", "cut", "least"), [(quality.quality, "quality", 0.7, 0.98), (toxicity.toxicity, "toxic", 0.3, 0.97)])
def test_labels_held_out(tables, score, label, cut, least):
    truth = {r["doc_id"]: r[label] for r in tables["labels"].collect()}
    rows = score(tables["documents"], tables["labels"]).collect()
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= cut) for r in rows)
    out = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) >= least
    assert all(r["held_out"] == held(r["doc_id"], 4) for r in rows)


@pytest.mark.parametrize(("score", "label"), [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_label_edges(spark, score, label):
    docs = spark.createDataFrame([(1, "a b", "k"), (1, "a b", "k"), (2, None, "k"), (None, "c", "k"), (3, "", "k"), (4, "w " * 200_000 + "x" * 20_000, "k")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (3, 1), (3, 0), (9, 0)], f"doc_id long, {label} int")
    # one kind of label was seen, so every text is like it: null, empty and very long ones too
    rows = score(docs, labels).collect()
    assert len(rows) == 6 and all(r["predicted"] == 1 and 0.3 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (2, 3)}
    assert len(empty) == 1 and len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    rows = score(docs, labels.limit(0)).collect()
    assert len(rows) == 6 and {r["predicted"] for r in rows} == {int(label == "quality")}
    assert score(docs.limit(0), labels).count() == 0


def test_scores_of_odd_texts(spark):
    words = "the house by the river has a garden and three rooms for rent near old town".split()
    rng = np.random.default_rng(4)
    texts = [(i, " ".join(rng.choice(words, 40)) + (" you vile stupid worm" if i % 2 else "") + (" ||| !!! $$$" * 9 if i % 2 else "")) for i in range(400)]
    odd = [(1000, None), (1001, ""), (1002, "the house " * 150_000), (1003, "x" * 1_000_000), (1004, "the house"), (1004, "the house")]
    docs = spark.createDataFrame(texts + odd, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    for score, cut, worse in ((quality.quality, 0.7, 0), (toxicity.toxicity, 0.3, 1)):
        rows = score(docs, labels).collect()
        assert len(rows) == 406 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= cut) for r in rows)
        assert all(r["predicted"] == (worse if r["doc_id"] % 2 else 1 - worse) for r in rows if r["doc_id"] < 400)
        by_id = {}
        for r in rows:
            by_id.setdefault(r["doc_id"], set()).add(r["score"])
        assert by_id[1000] == by_id[1001] and len(by_id[1004]) == 1


def test_weights_are_the_optimum_of_bradley_terry():
    rng = np.random.default_rng(6)
    gap = rng.normal(size=(200, 5)) + [0.8, -0.3, 0, 0, 0.1]

    def loss(w, ridge):
        return sum(math.log1p(math.exp(-sum(a * b for a, b in zip(g, w, strict=True)))) for g in gap.tolist()) / len(gap) + ridge / 2 * sum(b * b for b in w)

    for ridge in (quality.RIDGE, 0.1):
        best = quality.preferences(gap, ridge)
        for k in range(5):
            step = np.eye(5)[k] * 1e-4
            assert abs(loss(best + step, ridge) - loss(best - step, ridge)) / 2e-4 < 1e-6
        assert all(loss(best, ridge) < loss(best + 0.05 * rng.normal(size=5), ridge) for _ in range(20))


def test_content_counts_runs_of_bytes(monkeypatch):
    def plain(data):
        tally = Counter((int.from_bytes(data.lower()[i : i + 3], "big") * 0x9E3779B1 & 0xFFFFFFFF) >> 24 for i in range(len(data) - 2))
        return [math.sqrt(tally[k] / max(sum(tally.values()), 1)) for k in range(quality.BUCKETS)]

    texts = [b"", b"a", b"ab", b"abc", b"The cat, the CAT", "größe".encode() * 9]
    want = [plain(t) for t in texts]
    assert np.allclose([quality.content(t) for t in texts], want)
    monkeypatch.setattr(quality, "PART", 4)
    assert np.allclose([quality.content(t) for t in texts], want)


def test_gradients_of_the_joint_model():
    model = toxicity.SubwordSoftmax([], np.zeros(0))
    model.vectors, model.out, model.bias = model.vectors.astype(float), model.out.astype(float), np.array([0.2, -0.1])
    words = [b"alpha", b"alphas", b"a", "größe".encode(), b"beta"]
    owner, bucket = toxicity.ordered_ngrams(words)
    begin = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))]
    bags, labels = [np.array([0, 1, 1]), np.array([2]), np.array([3, 4, 0, 2])], np.array([1, 0, 1])

    def loss():
        total = 0.0
        for bag, y in zip(bags, labels, strict=True):
            mean = sum(sum(model.vectors[b] for b in bucket[begin[w] : begin[w + 1]]) / (begin[w + 1] - begin[w]) for w in bag) / len(bag)
            logit = [sum(mean[d] * model.out[d, k] for d in range(toxicity.WIDTH)) + model.bias[k] for k in (0, 1)]
            total += math.log(sum(map(math.exp, logit))) - logit[y]
        return total

    def slope(values, at):
        kept, both = values[at], []
        for step in (1e-5, -1e-5):
            values[at] = kept + step
            both.append(loss())
        values[at] = kept
        return (both[0] - both[1]) / 2e-5

    by_out, by_bias, rows, by_vector = model.gradients(bags, labels, begin, bucket)
    assert sorted(rows) == sorted(set(bucket.tolist()))
    assert np.allclose(by_out, [[slope(model.out, (d, k)) for k in (0, 1)] for d in range(toxicity.WIDTH)], atol=1e-5)
    assert np.allclose(by_bias, [slope(model.bias, k) for k in (0, 1)], atol=1e-5)
    for r in range(0, len(rows), 5):
        assert np.allclose(by_vector[r], [slope(model.vectors, (rows[r], d)) for d in range(toxicity.WIDTH)], atol=1e-5)


def test_ranking_orders_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality.FEATURES) + quality.BUCKETS))
    label = (x[:, 0] + 0.1 * rng.normal(size=400) > -1).astype(int)
    model = quality.PairwiseRanker(x, label)
    s = model.score(x)
    assert (s[label == 1][:, None] > s[label == 0][None, :]).mean() > 0.98
    assert ((s >= quality.THRESHOLD) == label).mean() > 0.95


def test_every_pair_counts(spark):
    rng = np.random.default_rng(11)
    z = rng.normal(size=(90, 6)) * [1, 2, 1, 0.5, 3, 1]
    label = (z[:, 0] - z[:, 1] + rng.normal(size=90) > 0.7).astype(int)
    gap = (z[label == 1][:, None] - z[label == 0][None, :]).reshape(-1, 6)
    for ridge in (quality.RIDGE, 0.1):
        found = quality.all_pairs(lambda step: reduce(quality.added, [step(z[k : k + 40], label[k : k + 40]) for k in (0, 40, 80)]), 6, ridge)
        assert np.abs(found - quality.preferences(gap, ridge)).max() < 1e-4
    x = rng.normal(size=(300, len(quality.FEATURES) + quality.BUCKETS))
    label = (x[:, 0] + rng.normal(size=300) > 0.5).astype(int)
    model = quality.PairwiseRanker(x, label)
    kept = quality.PairwiseRanker.of_table(spark.createDataFrame([(int(k), v.tobytes()) for k, v in zip(label, x, strict=True)], "label int, x binary").repartition(5))
    assert np.allclose(model.weights, kept.weights, atol=1e-5) and abs(model.threshold - kept.threshold) < 1e-4 and model.quantile == kept.quantile


@pytest.mark.parametrize("taken", [0, quality.TAKEN])
def test_quality_learns_from_every_label(spark, taken):
    # more labels than the sample of 6000 that was learned from before
    docs = spark.range(9000).selectExpr("id as doc_id", "concat('w', id, if(id % 2 = 0, ' fine words', ' POOR !!')) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) as quality")
    rows = labelled(docs, labels, "quality")
    assert rows.count() == sum(not held(k, 4) for k in range(9000)) > 6000
    model = quality.fit(docs, labels, taken)
    assert model.score(np.array([quality.features(t) for t in (b"w1 fine words", b"w1 POOR !!")])).round().tolist() == [1, 0]


def test_misspellings_share_vectors():
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(300)]
    texts, labels = [], []
    for k in range(600):
        words = list(rng.choice(plain, 60))
        if k % 4 == 0:
            words[int(rng.integers(60))] = "worthless"
        texts.append(" ".join(words).encode())
        labels.append(int(k % 4 == 0))
    model = toxicity.SubwordSoftmax(texts, np.array(labels), steps=400)
    seen = model.score(texts)
    assert ((seen >= 0.3) == np.array(labels)).mean() > 0.97
    clean = " ".join(rng.choice(plain, 60))
    assert (model.score([f"{clean} {w}".encode() for w in ("wortthless", "worthles", "w0rthless")]) > model.score([clean.encode()])).all()


def test_best_bag():
    values = np.array([0, 1, 5, -2.0])
    assert toxicity.best_bag(values) == (1.0, 0)
    assert toxicity.best_bag(np.zeros(0)) == (0.0, 0)


# --- likelihood ----------------------------------------------------------------


def plain_marginal(model, data):
    """Sum over all segmentations, by trying each."""
    weight = dict(zip(model.pieces, np.exp(model.logs), strict=True))

    def rest(at):
        return 1.0 if at == len(data) else sum(weight[data[at:e]] * rest(e) for e in range(at + 1, len(data) + 1) if data[at:e] in weight)

    return rest(0)


def test_forward_sums_all_segmentations():
    pieces = [b" ", b"a", b"b", b"ab", b"aba", b" a", b"ba", *[bytes([k]) for k in range(256) if k not in b" ab"]]
    rng = np.random.default_rng(0)
    p = rng.random(len(pieces))
    model = lattice.Lattice(pieces, np.log(p / p.sum()))
    words = [b"ababa", b"a", b"bbbb", b"abc", b"ab", b"ababa"]
    assert np.allclose(model.words(words), [math.log(plain_marginal(model, b" " + w)) for w in words])
    assert model.text(b"AB  a\tabc", -1.0) == pytest.approx((model.words([b"ab", b"a", b"abc"]).sum() - 1) / math.log(10))
    counts = np.zeros(len(pieces))
    text = np.frombuffer(b" aba", np.uint8)[None, :]
    model.expected(text, np.ones(1), counts)
    sizes = np.array([len(x) for x in pieces])
    assert counts @ sizes == pytest.approx(4)  # every byte is covered once
    assert model.words([b"x" * 5000])[0] < -5000 and np.isfinite(model.words([b"x" * 5000])).all()


def test_training_raises_likelihood(spark):
    words = spark.createDataFrame([(w.encode(), c, c) for w, c in (("abab", 50), ("aba", 20), ("b", 5), ("q", 0))], "word binary, c long, n long")
    pieces = [b" ", b"a", b"b", b"ab", b" a", *[bytes([k]) for k in range(256) if k not in b" ab"]]
    weights = np.array([50, 20, 5])

    def total(rounds):
        model, end = lattice.train(words, 10, pieces, rounds)
        assert np.exp(model.logs).sum() + math.exp(end) == pytest.approx(1)
        return weights @ model.words([b"abab", b"aba", b"b"])

    assert total(1) < total(2) < total(4)


def test_scores(spark, tables):
    docs = tables["documents"].limit(150).select("doc_id", "text")
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 1, ""), (None, "the of")], "doc_id long, text string")
    docs = docs.unionByName(extra).selectExpr("doc_id", "text", "'x' word", "1 row", "2 log")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    learned = Counter()
    ends = 0
    for i, t in rows:
        if i is not None and not held(i, 7):
            learned.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(learned.values()) + ends, len(learned) + 1
    learned[None] = ends
    for hot in (50, lattice.HOT):
        got = lattice.score(docs, hot=hot).collect()
        assert len(got) == len(rows)
        by_id = {r["doc_id"]: r for r in got}
        for i, t in rows:
            words = [*(t or "").encode().lower().split(), None]
            r = by_id[i]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(learned[w] > 0 for w in words), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((learned[w] + 1) / (n + v + 1)) for w in words))
            assert r["held_out"] == (i is None or held(i, 7)) and r["score"] < 0
    assert lattice.score(docs.limit(0)).count() == 0


def test_expected_pieces_of_a_very_long_word(monkeypatch):
    rng = np.random.default_rng(31)
    pieces = [bytes([b]) for b in range(97, 103)] + [b"ab", b"abc", b"fed", b"cafe" * 6]
    model = lattice.Lattice(pieces, np.log(rng.dirichlet(np.ones(len(pieces)))))
    assert model.longest == 24
    text = rng.integers(97, 103, (1, 3000)).astype(np.uint8)
    text[0, 100:124] = np.frombuffer(b"cafe" * 6, np.uint8)
    found, kept = np.zeros(len(pieces)), np.zeros(len(pieces))
    model.expected(text, np.ones(1), found)
    monkeypatch.setattr(lattice, "KEPT", 10_000)
    model.expected(text, np.ones(1), kept)
    assert found == pytest.approx(kept) and sum(n * len(p) for n, p in zip(found, pieces, strict=True)) == pytest.approx(3000)
