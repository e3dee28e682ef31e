"""SimHash groups, near copies, embedding links and components against brute force."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.llm import copies, cosine, simhash
from spindrift.llm.graph import connected_components

CLASH = ["id", "fp", "rep", "key", "component", "h", "v", "node"]


def roots(n, links):
    label = list(range(n))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_forest(links):
    a, b = (np.array([x[k] for x in links], int) for k in (0, 1))
    assert simhash._forest(a, b, 31).tolist() == roots(31, links)


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(k, k + 1) for k in range(300, 360)] + [(500, k) for k in range(501, 620)] + [(500, 501)] * 5
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*links, (None, 3), (4, None), (7, 7)], "a long, b long")).collect()}
    want = roots(620, links)
    assert got == {k: want[k] for k in {x for p in links if p[0] != p[1] for x in p}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("matches", range(1, 9))
def test_covering(matches):
    subsets = [set(c) for c in simhash.covering_positions(matches)]
    assert all(any(s <= set(q) for s in subsets) for q in combinations(range(8), matches))


def plain_print(text, words=4):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    grams = [b" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) & (2**64 - 1) == plain_print(text)


def test_spark_hash_is_the_same(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("ä b c d"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest("ä b c d".encode(), 42)


def texts_like(rng, n):
    base = [" ".join(f"w{k}" for k in rng.integers(0, 500, 300)) for _ in range(n // 6)]
    out = []
    for t in base:
        words = t.split()
        for _ in range(6):
            some = words.copy()
            for k in rng.integers(0, len(some), rng.integers(0, 3)):
                some[k] = "x"
            out.append(" ".join(some))
    return out


def test_near_duplicates(spark):
    texts = [*texts_like(np.random.default_rng(2), 120), None, "", "  ", "One", "one ", "a b", "same words here now", "SAME words here\nnow", "long " * 40_000]
    ids = list(range(10, 10 + len(texts)))
    rows = [(i, t, "e", 1) for i, t in zip(ids, texts)] + [(10, texts[0], "e", 1), (None, texts[0], "e", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, id int")
    prints = [plain_print(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = {(ids[k], f"{prints[k]:016x}", ids[r]) for k, r in enumerate(roots(len(texts), links))}
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert set(got) == want | {(None, f"{prints[0]:016x}", None)} and len(got) == len(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_long_lists_are_split_without_loss(spark):
    rng = np.random.default_rng(3)
    prints = [int(p) for p in (rng.integers(0, 2**20, 300).astype(np.uint64) | np.uint64(0xABCDEF << 40)).view(np.int64)]
    nodes = spark.createDataFrame([(p, k) for k, p in enumerate(dict.fromkeys(prints))], "fp long, rep long")
    own = list(dict.fromkeys(prints))
    links = [(a, b) for a, b in combinations(range(len(own)), 2) if ((own[a] ^ own[b]) & (2**64 - 1)).bit_count() <= 4]
    for cell in (16, 4096):
        found = connected_components(simhash.candidate_edges(nodes, 4, cell))
        got = {r["node"]: r["component"] for r in found.collect()}
        want = roots(len(own), links)
        assert [got.get(k, k) for k in range(len(own))] == want


def test_copies_are_dropped(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in rng.integers(0, 9000, 400)]
    near = words.copy()
    near[7], near[300] = "x", "y"  # ten of 396 shingles: 0.95
    far = words[:200] + [f"z{k}" for k in range(200)]
    texts = [" ".join(w) for w in (words, near, far)] + [None, "", "a b c", "a b c", "b c a"]
    docs = spark.createDataFrame([(k, t, "s", 2) for k, t in enumerate(texts)] + [(0, texts[0], "s", 2), (None, "q", "s", 2)], "doc_id long, text string, rep string, key int")
    kept = copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [0, 2, 3, 5, 7] and kept.count() == 6
    assert copies.keep_one(docs.limit(0)).count() == 0


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in rng.integers(0, 9000, 300)]
    texts = []
    for k in range(400):
        own = words.copy()
        own[int(rng.integers(300))] = f"x{k}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for cell in (50, 4096):
        groups = copies.near_copies(docs, cell=cell)
        assert groups.select("component").distinct().count() == 1 and groups.count() == 400


def grams(text):
    tokens = text.split()
    return {tuple(tokens[k : k + 5]) for k in range(max(1, len(tokens) - 4))}


def groups_by_force(texts, similarity=0.8):
    sets = [grams(t) for t in texts]
    return roots(len(sets), [(a, b) for a, b in combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])])


def groups_found(spark, texts, **more):
    found = copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **more)
    got = {r["rep"]: r["component"] for r in found.collect()}
    return [got[k] for k in range(len(texts))]


def test_copies_within_a_template_are_found(spark):
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    shared, texts = word(186), []
    for _ in range(60):
        own = word(28)  # all share 182 of 210 shingles: 0.76; these two 195: 0.87
        texts += [" ".join(shared + own), " ".join(shared + own[:13] + word(15))]
    order = rng.permutation(len(texts))
    texts = [texts[k] for k in order]
    want = groups_by_force(texts)
    assert len(set(want)) == 60
    assert groups_found(spark, texts, cell=50) == want


@pytest.mark.parametrize("sizes", [{}, {"cell": 40, "cell_texts": 64}])
def test_groups_of_a_dense_template(spark, sizes):
    rng = np.random.default_rng(10)
    base, texts = [f"w{k}" for k in rng.integers(0, 10**9, 240)], []
    for k in range(400):  # two of these share 0.77 on average, a few of them 0.8 and more
        own = base.copy()
        for n, place in enumerate(rng.choice(240, 3 + k % 2, replace=False)):
            own[place] = f"x{k}.{n}"
        texts.append(" ".join(own))
    want = groups_by_force(texts)
    assert 1 < len(set(want)) < 200
    assert groups_found(spark, texts, **sizes) == want


def test_texts_of_one_id_are_no_copies(spark):
    rows = [(7, "alpha beta gamma delta epsilon zeta", 2), (7, "one two three four five six", 1), (8, "one two three four five six", 3), (9, "one two", 5), (9, "one two", 4), (9, "one two", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int")
    assert sorted(tuple(r) for r in copies.keep_one(docs).collect()) == [(7, rows[0][1], 2), (7, rows[1][1], 1), (9, "one two", 4)]


def test_very_long_copies(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, long[: len(long) // 2])], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in copies.keep_one(docs).collect()) == [1, 3]


def test_copies_at_the_border_are_found(spark):
    rng = np.random.default_rng(9)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    texts = []
    for n in (8, 9, 10, 12, 16, 20, 24, 28, 44, 104, 204):  # words; so many shingles and four
        for _ in range(30):
            own = word(n)
            texts += [" ".join(own), " ".join(own + word((n - 4) // 4))]
    want = groups_by_force(texts)
    assert len(set(want)) == len(texts) // 2
    assert groups_found(spark, texts) == want


def test_embedding_links(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(15, 24))
    x = [list(map(float, c + s * rng.normal(size=24))) for c in centres for s in (0, 0, 0.05, 0.2, 0.4, 0.6)]
    x += [[0.0] * 24, None, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [float("inf")] * 24, [1e200] * 24, [1e-200] * 24, [1.0, 1.0]]
    rows = [(k, v, "l", 3) for k, v in enumerate(x)] + [(0, x[0], "l", 3), (None, x[0], "l", 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string, v int")
    good = [k for k, v in enumerate(x) if v is not None and None not in v and np.isfinite(v).all() and any(v)]

    def cos(a, b):
        a, b = np.array(x[a]) / max(map(abs, x[a])), np.array(x[b]) / max(map(abs, x[b]))
        return a @ b / np.sqrt((a @ a) * (b @ b)) if len(a) == len(b) else -1

    links = [(a, b) for a, b in combinations(good, 2) if cos(a, b) >= 0.9]
    linked = {k: sum(k in p for p in links) for k in range(len(x))}
    want = roots(len(x), links)
    for cell in (5, 2048):
        got = cosine.near_duplicates(table, cell=cell).collect()
        assert len(got) == len(rows)
        seen = {r["vec_id"]: r for r in got if r["vec_id"] is not None}
        same = [r for r in got if r["vec_id"] is None]
        assert [(r["n_links"], r["component_id"], r["kept"]) for r in same] == [(0, None, False)]
        for k in range(len(x)):
            more = 1 if k == 0 or (0, k) in links else 0  # row 0 comes twice
            assert (seen[k]["n_links"], seen[k]["component_id"], seen[k]["kept"]) == (linked[k] + more, want[k], k == want[k]), k
    assert cosine.near_duplicates(table.limit(0)).count() == 0


def test_tables_for_recall():
    bits, tables = cosine.plan_tables(10_000, 0.9)
    agree = (1 - np.arccos(0.9) / np.pi) ** bits
    assert 1 - (1 - agree) ** tables >= 0.999


@pytest.mark.parametrize("scale", [1e-300, 1.0, 1e300])
def test_keys_do_not_depend_on_the_batch(scale):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 48)), rng.integers(-2, 3, (300, 48)) + 0.0]) * scale
    x = x[np.abs(x).max(axis=1) > 0]
    whole = cosine._keys(x, 9, 23, 23)
    for k in (0, 7, 450):
        assert (cosine._keys(x[k : k + 1], 9, 23, 23) == whole[k]).all() and (cosine._keys(x[k : k + 5], 9, 23, 4) == whole[k : k + 5, :4]).all()
    near = cosine._keys(x + rng.normal(size=x.shape) * scale * 1e-3, 9, 23, 23)
    assert (near == whole).mean() > 0.9 and len(np.unique(whole[:, 0])) > 200


def test_byte_index_of_near_copies(spark):
    rng = np.random.default_rng(12)
    one = rng.integers(0, 1 << 63, (200, copies.SIGNATURE)).astype(np.int64)
    frame = spark.createDataFrame([tuple(map(int, r)) for r in one], ", ".join(f"fp{k} long" for k in range(copies.SIGNATURE)))
    plain = one.view(np.uint8).reshape(len(one), -1)
    half = plain.shape[1] // 2
    keys = np.array([r["keys"] for r in frame.select(F.array(*copies.byte_keys()).alias("keys")).collect()])
    assert (keys == ((np.arange(half) << 16) + (plain[:, :half].astype(int) << 8) + plain[:, half:])).all() and copies._from_bytes(keys).all()
    i, j = rng.integers(0, 200, (2, 500))
    assert (copies._shared(list(one.view(np.uint64).T), i, j) == (plain[i] == plain[j]).sum(axis=1)).all()
    pairs = []
    for k in range(60):
        words = [f"w{n}" for n in rng.integers(0, 10**9, 150)]
        pairs += [" ".join(words), " ".join([*words[:140], *(f"x{k}.{n}" for n in range(5)), *words[140:]])]
    docs = spark.createDataFrame(list(enumerate(pairs)), "doc_id long, text string")
    # the posting lists alone, without those of least shingles, connect near copies and nothing else
    pairs = []
    for k in range(60):
        words = [f"w{n}" for n in rng.integers(0, 10**9, 150)]
        pairs += [" ".join(words), " ".join([*words[:140], *(f"x{k}.{n}" for n in range(5)), *words[140:]])]
    sets = [copies.shingles(t.encode()) for t in pairs]
    signs = np.array([copies.signature(x) for x in sets])
    plain = signs.view(np.uint8).reshape(len(signs), -1).astype(int)
    posted = sorted((p << 16 | int(plain[n, p]) << 8 | int(plain[n, p + half]), n) for n in range(120) for p in range(half))
    key, node = (np.array([r[c] for r in posted]) for c in (0, 1))
    columns = {"key": key, "cell": 0 * key, "node": node, "part": node, "shingled": np.array([len(x) for x in sets])[node]} | {f"fp{k}": signs[node, k].view(np.int64) for k in range(copies.SIGNATURE)}
    links = [(a, b) for out in copies._close(pa.table(columns).to_batches(1000), 0.8) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    assert roots(120, links) == [k - k % 2 for k in range(120)] == groups_by_force(pairs)
    # members of a list that share the bytes of its key alone are let go before their bits are looked at
    few = np.where(np.arange(copies.SIGNATURE * 8) % half == 0, plain[0], plain[0] ^ 1).astype(np.uint8).view(np.uint64)
    columns = {"key": key[:1].repeat(2) * 0 + (int(plain[0, 0]) << 8 | int(plain[0, half])), "cell": np.zeros(2, int), "node": np.arange(2), "part": np.arange(2), "shingled": np.full(2, 50)}
    columns |= {f"fp{k}": np.array([signs[0, k], few[k]]).view(np.int64) for k in range(copies.SIGNATURE)}
    assert not [r for out in copies._close(pa.table(columns).to_batches(), 0.8) for r in out.to_pylist()]
    hashed = columns | {"key": np.full(2, 1 << 40)}
    assert [r for out in copies._close(pa.table(hashed).to_batches(), 0.8) for r in out.to_pylist()] == [{"a": 1, "b": 0}]
