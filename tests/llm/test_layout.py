"""Mixing, packing, archives, nearest neighbours and the pipeline."""

import base64
import hashlib
import os
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import forest, mixing, packing, warc
from spindrift.llm.prefix import running_sum

SF = "/root/testdata/sf0.001"


def test_running_sum(spark):
    rows = [("a" if k % 3 else "b" if k % 2 else None, (k * 7) % 50, k % 5) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, o long, n long")
    got = running_sum(df, ["g", "o"], "n", "before", group="g").collect()
    assert len(got) == 400
    for g in ("a", "b", None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: (r["before"], r["n"] > 0))
        assert [r["o"] for r in own if r["n"]] == sorted(r["o"] for r in own if r["n"])
        at = 0
        for r in own:
            assert r["before"] == at
            at += r["n"]
    assert running_sum(df.limit(0), ["o"], "n", "before").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12))
def test_period_is_pfair(shares):
    slots, total = mixing.period(shares), sum(shares)
    assert sorted(s for own in slots for s in own) == list(range(total))
    for a, own in zip(shares, slots, strict=True):
        assert len(own) == a
        for j, s in enumerate(own):
            assert j * total // a <= s < -(-(j + 1) * total // a)
        placed = np.searchsorted(own, np.arange(total + 1))
        assert (np.abs(placed - np.arange(total + 1) * a / total) < 1).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 30)), min_size=1, max_size=6))
def test_phases_place_every_block(given_):
    shares, blocks = zip(*given_, strict=True)
    taken = [set() for _ in shares]
    slots = set()
    for p in mixing.phases(list(shares), list(blocks)):
        for b in range(p["from"], p["to"]):
            j = b - p["from"]
            slots.add(p["begin"] + j // p["share"] * p["total"] + p["slots"][j % p["share"]])
            taken[p["source"]].add(b)
    assert [len(t) for t in taken] == list(blocks) and slots == set(range(sum(blocks)))


def edf_by_force(shares, blocks):
    """Slot of every block, one slot at a time: of the released blocks the one due first."""
    done, out, begin, slot = [0] * len(shares), {}, 0, 0
    base = done.copy()
    mixed = [i for i in range(len(shares)) if blocks[i] and shares[i]] or [i for i in range(len(shares)) if blocks[i]]
    while mixed:
        share = {i: Fraction(shares[i] or 1) / sum(shares[k] or 1 for k in mixed) for i in mixed}
        due = {i: -(-(done[i] - base[i] + 1) // share[i]) for i in mixed if (done[i] - base[i]) // share[i] <= slot - begin}
        i = min(due, key=lambda k: (due[k], k))
        out[i, done[i]] = slot
        done[i] += 1
        slot += 1
        if done[i] == blocks[i]:  # the others go on from here
            base, begin = done.copy(), slot
            left = [k for k in range(len(shares)) if done[k] < blocks[k]]
            mixed = [k for k in left if shares[k]] or left
    return out


def test_whole_shares():
    assert mixing.whole_shares([1.0] * 3) == [1, 1, 1] and mixing.whole_shares([0.5, 0.3, 0.2]) == [5, 3, 2]
    assert mixing.whole_shares([0.0, 2.0, 1.0]) == [0, 2, 1] and mixing.whole_shares([0.0, 0.0]) == [0, 0]
    assert mixing.whole_shares([1.0, 1e-5], 100) == [100, 1]
    with pytest.raises(ValueError, match="negative"):
        mixing.whole_shares([1.0, -1.0])


@pytest.mark.parametrize("weights", [{}, {"a": 3.0, "b": 0.5, "c": 0.0}, {"a": 0.0, "b": 0.0, "c": 0.0, None: 0.0}])
def test_slots_equal_earliest_deadline_first(spark, weights):
    rows = [(k, s, "x" * (30 + k % 40)) for k, s in enumerate("a" * 60 + "b" * 25 + "c" * 9)] + [(100 + k, None, "y" * 50) for k in range(5)]
    got = mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string, text string"), weights, block_bytes=100).collect()
    names = [None, "a", "b", "c"]
    blocks = [1 + max(r["block"] for r in got if r["source"] == n) for n in names]
    want = edf_by_force(mixing.whole_shares([weights.get(n, 1.0) for n in names]), blocks)
    assert len(got) == len(rows) and all(r["slot"] == want[names.index(r["source"]), r["block"]] for r in got)


def test_too_many_sources_are_refused(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'s' || id as source", "'t' as text")
    with pytest.raises(ValueError, match="sources"):
        mixing.schedule(docs)


def test_mixing(spark):
    rows = [(k, f"s{k % 3}" if k % 10 else None, "x" * (k % 70), 1) for k in range(300)] + [(5, "s2", "xxxxx", 1)] * 3 + [(None, "s1", None, 1), (7, "s9", "y" * 5000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, slot int")
    got = mixing.schedule(docs, {"s1": 3.0, None: 0.5}, block_bytes=200).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    assert len({(r["source"], r["block"]) for r in got}) == len({r["slot"] for r in got})
    mixed = mixing.in_order(docs, block_bytes=200)
    assert mixed.columns == docs.columns and sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))
    assert mixing.schedule(docs.limit(0)).count() == 0 and mixing.in_order(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("bits", "dimensions"), [(2, 2), (3, 2), (2, 3), (2, 4)])
def test_hilbert_curve_visits_neighbours(bits, dimensions):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    keys = packing.hilbert_key(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("abé ÀİßſŉǅΣσς'.,!?<|>_ \t\n\x1c\xa0́"))), max_size=60))
def test_words_give_the_ids_of_the_text(tokenizer, text):
    words = test_words_give_the_ids_of_the_text.__dict__.setdefault("words", packing.WordIds(tokenizer.to_str()))
    assert np.frombuffer(words.of(text.encode()), words.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing(spark, tokenizer):
    texts = ["the cat sat", None, "", "x " * 9000, "the cat sat", "Größe! <|endoftext|> ok", "dog"] * 3
    docs = spark.createDataFrame([(k, t, "b", 0) for k, t in enumerate(texts)] + [(None, "null id", "b", 0), (3, "again", "b", 0)], "doc_id long, text string, begin string, row int")
    ids = [(r["doc_id"], [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in docs.collect()]
    for length in (64, 4096):
        rows = packing.pack(docs, length=length).collect()
        assert sum(r["length"] for r in rows) == sum(len(x) for _, x in ids)
        sequences = {}
        for r in rows:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            assert any(r["doc_id"] == i and len(x) == r["doc_tokens"] and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for i, x in ids)
        for number, pieces in sequences.items():
            at = 0
            for offset, size in sorted(pieces):
                assert offset == at
                at += size
            assert at == length or number == max(sequences)
    assert packing.pack(docs.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", "日", "😀", "WARC/1.1\r\n", "WARC/", "1.1\r\n", "\r\n\r\n"]), max_size=30), st.integers(4, 20))
def test_pieces_of_a_payload(parts, chunk):
    payload = "".join(parts).encode()
    got = [bytes(p) for p in warc.pieces(payload, chunk)]
    assert b"".join(got) == payload and all(warc.MAGIC not in p and len(p) <= chunk for p in got)
    for p in got:
        p.decode()


def test_archive_round_trip(spark, tmp_path):
    big = "WARC/1.1\r\n" + "é€ <p>" * 5000
    rows = [(4, "u\r\nv", big, 1), (2, "http://a/ b", big, 1), (9, None, None, 1), (8, "e", "", 1), (3, "c", "x\r\n\r\ny", 1), (3, "c", "x\r\n\r\ny", 1), (None, "n", "z", 1), (5, "d", big + "!", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    for chunk in (50, 1 << 16):
        path = str(tmp_path / str(chunk))
        got = {}
        for r in warc.archive(pages, path, chunk=chunk).collect():
            got.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]))
        for page, _, html, _ in rows:
            data = (html or "").encode()
            assert all(x[2:] == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode()) for x in got[page])
        kinds = {k: sorted(x[:2] for x in v) for k, v in got.items()}
        assert kinds == {4: [("revisit", 2)], 2: [("response", None)], 9: [("revisit", 8)], 8: [("response", None)], 3: [("response", None), ("revisit", 3)], None: [("response", None)], 5: [("response", None)]}
    sized = warc.archive(pages, min_bytes=10).where("payload_bytes < 10").collect()
    assert {r["record_type"] for r in sized} == {"response"}
    assert warc.archive(pages.limit(0)).count() == 0


def test_damage_is_noticed(spark, tmp_path):
    page = next(warc.records(1, "u", b"hello", warc.base32(hashlib.sha1(b"hello").digest()), 1, None, False))
    (tmp_path / "x.warc").write_bytes(page.replace(b"hello", b"hellp") + b"\r\n")
    with pytest.raises(Exception, match="damaged"):
        warc.read(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("size", [1e-9, 1.0, 1e9, 1e150])
def test_nearest_of_vectors_of_any_size(spark, size):
    x = np.random.default_rng(21).normal(size=(300, 6)) * size
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in forest.nearest(table, k=5, every=30, share=99.0, leaf=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    near = (x / size) @ (x / size).T
    for q in range(0, 300, 30):
        near[q, q] = -np.inf
        assert got[q] == np.argsort(-near[q], kind="stable")[:5].tolist()


def test_nearest_of_vectors_of_two_lengths(spark):
    rows = [(k, [float(k), 1.0, 2.0][: 2 + k % 2]) for k in range(12)]
    got = forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2, every=5, share=99.0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 2), (0, 2, 4), (5, 1, 11), (5, 2, 9), (10, 1, 8), (10, 2, 6)]


def test_leaves_leave_one_queue_by_their_keys():
    rng = np.random.default_rng(22)
    trees = forest.Forest(rng.normal(size=(400, 5)), leaves=16, trees=3)
    x, sizes = rng.normal(size=(20, 5)), rng.integers(1, 9, sum(trees.leaves)).astype(float)
    for q, visited in zip(x, trees.search(x, sizes, 60.0), strict=True):
        keys = []
        for directions, cuts, children, _ in trees.trees:  # all leaves of a tree, in their numbering
            own, todo = {}, [(0, 0.0)]
            while todo:
                node, key = todo.pop()
                if node < 0:
                    own[-1 - node] = key
                    continue
                gap = float(q @ directions[node] - cuts[node])
                todo += [(int(children[node][side]), key + (gap**2 if (gap >= 0) != bool(side) else 0.0)) for side in (0, 1)]
            keys += [own[k] for k in range(len(own))]
        order = sorted(keys[k] for k in range(len(keys)))[: len(visited)]
        assert [keys[k] for k in visited] == pytest.approx(order)
        assert sizes[visited].sum() >= 60 > sizes[visited[:-1]].sum()


def test_archives_of_long_urls_and_payloads(spark, tmp_path):
    long = "WARC/1.1" + "é\r\nWARC/1.1\r\n" * 200_000 + "x" * 20_000_000
    rows = [(1, "http://a.at/" + "u" * 1_000_000, "<p>"), (2, "http://a.at/WARC/1.1", "ends in WARC/1.1"), (3, "c", long), (4, None, "WARC/1.1"), (5, "e", "WARC/1.1\r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"]) for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert got == {k: (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response") for k, _, h in rows}


def nearest_by_force(ids, x, k, every):
    out = {}
    for a in np.nonzero(ids % every == 0)[0]:
        scores = np.einsum("ij,j->i", x, x[a])
        order = [b for b in np.lexsort((ids, -scores)) if ids[b] != ids[a]][:k]
        out[int(ids[a])] = [(int(ids[b]), float(scores[b])) for b in order]
    return out


def test_search_of_everything_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-2, 3, (150, 6)).astype(float)  # many ties
    x[100:130] = x[0]
    x[~x.any(axis=1), 0] = 1
    ids = rng.permutation(1000)[:150]
    rows = [(int(i), v.tolist(), "r") for i, v in zip(ids, x)] + [(2000, [0.0] * 6, "r"), (2020, None, "r"), (2040, [float("nan")] * 6, "r"), (None, x[3].tolist(), "r"), (int(ids[0]), x[0].tolist(), "r")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string")
    got = {}
    for r in forest.nearest(table, k=7, every=5, share=99.0, leaf=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == nearest_by_force(ids, x, 7, 5)
    few = forest.nearest(table.where(f"vec_id in ({ids[0]}, {ids[1]}, {ids[2]})"), k=20, every=1).groupBy("query_id").count().collect()
    assert {r["count"] for r in few} == {2}
    assert forest.nearest(table.limit(0)).count() == 0


def test_recall(spark):
    from spindrift.llm.shared import table

    rows = table(spark, SF, "embeddings")
    pdf = rows.toPandas()
    want = nearest_by_force(pdf.vec_id.to_numpy(), np.stack(pdf.embedding).astype(float), 20, 20)
    found = forest.nearest(rows).collect()
    assert len(found) == 20 * len(want)
    assert np.mean([r["vec_id"] in dict(want[r["query_id"]]) for r in found]) >= 0.9


def test_packing_keeps_the_mixture(spark, tmp_path):
    rng = np.random.default_rng(3)
    name = lambda k: f"s{max(0, k % 6 - 3)}"  # noqa: E731  # s0 has two thirds of the rows
    rows = [(k, name(k), " ".join(f"{name(k)}word{w}" for w in rng.integers(0, 9, 6))) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixing.in_order(docs, block_bytes=400).write.parquet(str(tmp_path / "mixed"))
    length, window = 64, 2048
    pieces = packing.pack(spark.read.parquet(str(tmp_path / "mixed")), length=length, window=window).collect()
    assert {r["doc_id"] for r in pieces} == set(range(900))
    tokens = {}
    for r in pieces:
        by = tokens.setdefault((r["sequence_id"] * length + r["offset"]) // window, {})
        by[name(r["doc_id"])] = by.get(name(r["doc_id"]), 0) + r["length"]
    # s1 and s2 have a sixth each, so all three last for the first half
    even = [tokens[k] for k in sorted(tokens)][: len(tokens) // 2 - 1]
    assert len(even) >= 3
    for by in even:
        assert all(abs(by.get(s, 0) - window / 3) < window / 6 for s in ("s0", "s1", "s2")), by


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "quality classifier", "SimHash near-dedup", "mixing to target weights", "packing"]
    last = pipeline.run(spark, SF).collect()
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        before, kept = kept, spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        assert kept.columns == docs.columns and kept.join(before, "doc_id", "left_anti").count() == 0, name
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in kept.collect()}
    assert 100 < kept.count() < docs.count()
