"""Search over small corpora, and the index on disk."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spindrift.operators.index import Index, ordinals
from spindrift.operators.retrieval import Corpus, edits, may_be_near, within

TEXTS = ["Trnava house buy energy_class A", "flat in Trnava, to rent", "house house garden", "", None, "Bratislava flat", "big red house by the sea"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").cache()


def brute(query, kind, k=5):
    bags = [Counter(re.findall(r"\w+", (t or "").lower())) for t in TEXTS]
    scores, sets = Counter(), []
    for term in re.findall(r"\w+", query.lower()):
        has = {i for i, b in enumerate(bags) if b[term]}
        if not has:
            continue
        n, df = len(TEXTS), len(has)
        weight = {"classic": math.log(n / df), "smooth": math.log(1 + n / (1 + df))}.get(kind, math.log((n - df + 0.5) / (df + 0.5) + 1e-10))
        for i in has:
            scores[i] += bags[i][term] * weight
        sets.append(has)
    common = set.intersection(*sets) if sets else set()
    return sorted(((i, round(scores[i], 6)) for i in common), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("kind", ["classic", "smooth", "anything"])
@pytest.mark.parametrize("query", ["house", "Trnava HOUSE", "house nowhere", "house house flat", "flat", "", "nowhere"])
def test_tfidf(docs, query, kind):
    got = [(r["doc_id"], r["score"]) for r in Index.build(docs).search(query, kind).orderBy("rank").collect()]
    assert got == [(i, pytest.approx(s)) for i, s in brute(query, kind)]


def test_index_on_disk(spark, docs, tmp_path):
    index = Index.build(docs)
    index.save(str(tmp_path))
    again = Index.load(spark, str(tmp_path))
    assert [tuple(r) for r in again.search("house").collect()] == [tuple(r) for r in index.search("house").collect()]
    assert [r["text"] for r in again.show("garden").collect()] == ["house house garden"]
    assert index.posted.agg(F.sum("tf")).first()[0] == index.stats.first()["total_tokens"]
    plan = again.posted.where(F.col("term").isin(["a", "b"]))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [a,b])" in plan


@pytest.fixture(scope="module")
def corpus(docs):
    return Corpus(docs)


def test_documents_without_ids(spark, tmp_path):
    rows = spark.range(0, 50, 1, 7).selectExpr("'word ' || id as text")
    rows.write.parquet(str(tmp_path / "in"))
    read = spark.read.parquet(str(tmp_path / "in"))
    made = ordinals(read).collect()
    assert [r["doc_id"] for r in made] == list(range(50))
    assert [r["text"] for r in made] == [r["text"] for r in read.collect()]
    assert ordinals(read.where("text = 'word 31'")).first()["doc_id"] == 0 and ordinals(read.limit(0)).count() == 0
    assert Index.build(read, id_col=None).search("31").first()["doc_id"] == next(r["doc_id"] for r in made if r["text"] == "word 31")


def test_corpus_on_disk(spark, docs, corpus, tmp_path):
    Corpus(docs, path=str(tmp_path / "c"))
    again = Corpus.load(spark, str(tmp_path / "c"))
    assert (again.n, again.mean) == (corpus.n, corpus.mean) == (len(TEXTS), pytest.approx(sum(len(re.findall(r"\w+", t or "")) for t in TEXTS) / len(TEXTS)))
    for query in ("house trnava", "hosue"):
        assert [tuple(r) for r in again.search(query).collect()] == [tuple(r) for r in corpus.search(query).collect()]
    empty = Corpus(docs.limit(0))
    assert empty.search("house").count() == empty.search_phrase("red house").count() == empty.search_keyword("+house fl*").count() == 0


def test_searches_read_their_terms_only(corpus):
    plan = corpus.search_phrase("big red")._jdf.queryExecution().toString()
    assert "In(term, [big,red])" in plan and "text" not in plan.split("== Physical Plan ==")[1]
    assert "StringStartsWith(term,tr)" in corpus.search_keyword("tr*")._jdf.queryExecution().toString()


def ids(rows):
    return [r["doc_id"] for r in rows.orderBy("rank").collect()]


def test_every_word_must_be_found(corpus):
    assert ids(corpus.search("house trnava")) == [0]
    assert ids(corpus.search("hosue tranva")) == [0]
    assert ids(corpus.search("house nowhere")) == []
    assert set(ids(corpus.search("flat"))) == {1, 5}


def test_phrases(corpus):
    assert ids(corpus.search_phrase("red house")) == [6]
    assert ids(corpus.search_phrase("big house")) == []
    assert ids(corpus.search_phrase("big house", slop=1)) == [6]
    assert ids(corpus.search_phrase("house red", slop=1)) == []
    assert ids(corpus.search_phrase("house red", slop=2)) == [6]
    assert ids(corpus.search_phrase("house house")) == [2]
    assert ids(corpus.search_phrase_aware("red house"))[0] == 6


@pytest.mark.parametrize(
    ("query", "found"),
    [
        ("garden flat", {1, 2, 5}),
        ("+flat -trnava", {5}),
        ("house AND trnava", {0}),
        ("flat NOT rent", {5}),
        ('"red house"', {6}),
        ('"big house"~1', {6}),
        ("gardn~1", {2}),
        ("tr*", {0, 1}),
        ("fl?t", {1, 5}),
        ("(house OR flat) AND trnava", {0, 1}),
        ("-house", set()),
        ("", set()),
        ("((house", {0, 2, 6}),
    ],
)
def test_keyword_queries(corpus, query, found):
    assert set(ids(corpus.search_keyword(query, 10))) == found


def test_filters_and_ranges(spark):
    rows = spark.createDataFrame([(1, "Flat in Nitra", "Nitra", "100 000 €"), (2, "Flat in Kosice", "Kosice", "50 000 €"), (3, "House", "Nitra", "NaN")], "id long, title string, city string, price string")
    corpus = Corpus.of_listings(rows, "id", ["title", "city", "price"])
    assert ids(corpus.search_range("price", 50000, 99999)) == [2]
    assert ids(corpus.search_with_filters("flat", {"city": "nitra"})) == [1]
    assert ids(corpus.search_with_filters("flat", {"city": "nitra"}, strict=True)) == []
    assert ids(corpus.search_with_filters("", {"price_range": (1, 10**6)})) == [1, 2]
    assert corpus.stored(corpus.search("house")).first()["price"] == "NaN"


def test_edit_distance(spark):
    words = ["abcd", "acbd", "abc", "abcde", "xbcd", "abdc", "badc", "zzzz", "ab"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    for limit in (1, 2):
        got = {r["w"]: r["d"] for r in rows.select("w", edits(F.col("w"), "abcd", limit).alias("d")).collect()}
        assert got == {w: within(w, "abcd", limit) for w in words}
        near = {r["w"] for r in rows.where(may_be_near(F.col("w"), "abcd", limit)).collect()}
        assert near >= {w for w, d in got.items() if d is not None}
    assert within("acbd", "abcd", 1) == 1 and within("badc", "abcd", 2) == 2
