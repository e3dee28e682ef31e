"""Full-text retrieval over a stored index: BM25, fuzzy terms, phrases, filters and parsed queries.

Scores are BM25 as published (Robertson and Zaragoza, 2009) with k1 = 1.2 and
b = 0.75; clauses of a query add up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions.text import labelled_text, terms
from spindrift.operators.index import query_terms, ranked, sorted_by_term
from spindrift.operators.listings import typed
from spindrift.sources.package import ship
from spindrift.sources.shared import discard, scratch

K1, B = 1.2, 0.75
#: What a posting has besides its term and document.
POSTING = T.StructType([T.StructField("tf", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("places", T.ArrayType(T.IntegerType()))])
#: Terms that a fuzzy term stands for at most.
EXPANSIONS = 50


def within(a: str, b: str, limit: int) -> int | None:
    """Edit distance with swaps of neighbours (each place changed once), if at most ``limit``."""
    if abs(len(a) - len(b)) > limit:
        return None
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if min(row) > limit:
            return None
        before, last = last, row
    return last[-1] if last[-1] <= limit else None


def edits(term: Column, wanted: str, limit: int) -> Column:
    """The distance of a term from ``wanted``; null beyond ``limit``.

    One edit is found natively: a swap of neighbours gives one of few strings.
    """
    near = F.abs(F.length(term) - len(wanted)) <= limit
    if limit <= 1:
        swaps = sorted({wanted[:i] + wanted[i + 1] + wanted[i] + wanted[i + 2 :] for i in range(len(wanted) - 1)} - {wanted})
        plain = F.levenshtein(term, F.lit(wanted), limit)
        one = F.when(plain >= 0, plain)
        return F.when(near, F.coalesce(one, F.when(term.isin(swaps), 1) if swaps else F.lit(None).cast("int")))

    @F.pandas_udf("int")
    def distance(words: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else within(w, wanted, limit) for w in words], dtype="Int32")

    return F.when(near, distance(term))


def may_be_near(term: Column, wanted: str, limit: int) -> Column:
    """True for all terms within ``limit`` edits of ``wanted``, and for few others.

    A swap of neighbours is two plain edits, so plain distances are at most
    twice as large. All of it runs natively.
    """
    return (F.abs(F.length(term) - len(wanted)) <= limit) & (F.levenshtein(term, F.lit(wanted), 2 * limit) >= 0)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of each of ``(doc_id, terms)``, with the term's places in order."""
    for batch in batches:
        lists = batch.column("terms")
        length = np.diff(lists.offsets.to_numpy())  # a null has no terms
        term = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(length)), length)
        place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        code = term.indices.to_numpy()
        order = np.lexsort((place, code, row))
        row, code, place = row[order], code[order], place[order]
        heads = np.nonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])][: len(row)])[0]
        ends = np.r_[heads, len(row)].astype(np.int32)
        columns = [
            term.dictionary.take(pa.array(code[heads])),
            batch.column("doc_id").take(pa.array(row[heads])),
            pa.array(np.diff(ends), pa.int32()),
            pa.array(length[row[heads]].astype(np.int32)),
            pa.ListArray.from_arrays(ends, pa.array(place, pa.int32())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "doc_id", "tf", "n_tokens", "places"])


class Corpus:
    """A stored full-text index: written once, opened by every search.

    ``Corpus(docs)`` writes one and opens it; ``Corpus.load`` opens one that
    is there. The folder holds the documents without their text, a row for each term of
    a document with its places, the vocabulary with document frequencies, and
    one row of statistics. Ids are those of one document each. Postings and vocabulary are in the order of terms,
    so a search reads its own terms and skips the rest of the files.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None):
        spark = docs.sparkSession
        ship(spark)
        path = path or scratch(spark, "corpus")
        self._write(docs.withColumnsRenamed({id_col: "doc_id", text_col: "text"}), path)
        self._open(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Corpus:
        ship(spark)
        corpus = cls.__new__(cls)
        corpus._open(spark, path)
        return corpus

    @staticmethod
    def _write(docs: DataFrame, path: str) -> None:
        cut = docs.select("doc_id", terms(F.col("text")).alias("terms"))
        posted = cut.mapInArrow(_places, T.StructType([T.StructField("term", T.StringType()), docs.schema["doc_id"], *POSTING.fields]))
        # ranges are found from a sample, which would cut all texts a second time
        spark = docs.sparkSession
        posted.write.mode("overwrite").parquet(f"{path}/unsorted")
        sorted_by_term(spark.read.parquet(f"{path}/unsorted"), "term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        discard(spark, f"{path}/unsorted")
        counted = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        sorted_by_term(counted, "term").write.mode("overwrite").parquet(f"{path}/vocabulary")
        docs.withColumn("n_tokens", F.greatest(F.coalesce(F.size(terms(F.col("text"))), F.lit(0)), F.lit(0))).drop("text").write.mode("overwrite").parquet(f"{path}/docs")
        stats = spark.read.parquet(f"{path}/docs").agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("mean"))
        stats.write.mode("overwrite").parquet(f"{path}/stats")

    def _open(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.docs, self.posted, self.vocabulary = (spark.read.parquet(f"{path}/{part}") for part in ("docs", "postings", "vocabulary"))
        row = spark.read.parquet(f"{path}/stats").first()
        self.n, self.mean = row["n"], row["mean"] or 1.0

    @classmethod
    def of_listings(cls, rows: DataFrame, id_col: str, fields: list[str], path: str | None = None) -> Corpus:
        """Listings by the text of their fields, with their numbers."""
        there = [f for f in fields if f in rows.columns]
        return cls(typed(rows).withColumn("text", labelled_text(there)), id_col, "text", path)

    def _bm25(self, tf: Column, df: Column, length: Column) -> Column:
        weight = F.log(1 + (F.lit(float(self.n)) - df + 0.5) / (df + 0.5))
        return weight * tf / (tf + K1 * (1 - B + B * length / F.lit(float(self.mean))))

    def frequencies(self, wanted: list[str]) -> dict[str, int]:
        """How many documents each of a query's terms is in; a row for each term."""
        if not wanted:
            return {}
        return {r["term"]: r["df"] for r in self.vocabulary.where(F.col("term").isin(sorted(set(wanted)))).collect()}

    def _postings(self, wanted: list[str]) -> DataFrame:
        return self.posted.where(F.col("term").isin(sorted(set(wanted))) if wanted else F.lit(False))

    def scores(self, wanted: list[tuple[int, str, float]], docs: DataFrame | None = None) -> DataFrame:
        """``(doc_id, clause, score)`` for ``(clause, term, weight)``."""
        known = self.frequencies([t for _, t, _ in wanted])
        there = [(c, t, w, known[t]) for c, t, w in wanted if t in known]
        weights = self.spark.createDataFrame(there, "clause int, term string, weight double, df long")
        found = self._postings([t for _, t, _, _ in there]).select("term", "doc_id", "tf", "n_tokens")
        if docs is not None:
            found = found.join(docs.select("doc_id"), "doc_id", "left_semi")
        score = F.col("weight") * self._bm25(F.col("tf"), F.col("df"), F.col("n_tokens"))
        # a row for each term of the query
        return found.join(F.broadcast(weights), "term").groupBy("doc_id", "clause").agg(F.sum(score).alias("score"))

    def expand(self, term: str, limit: int) -> list[tuple[str, float]]:
        """Terms within ``limit`` edits and their weights, the nearest first.

        Only terms of the vocabulary that may be so near are looked at closely.
        """
        n = edits(F.col("term"), term, limit)
        boost = 1 - F.col("n") / F.least(F.length("term"), F.lit(max(1, len(term))))
        near = self.vocabulary.select("term").where(may_be_near(F.col("term"), term, limit)).withColumn("n", n).where("n is not null").withColumn("boost", boost)
        return [(r["term"], r["boost"]) for r in near.where("boost > 0").orderBy(F.desc("boost"), "term").limit(EXPANSIONS).collect()]

    def clauses(self, query: str, fuzzy_edits: int) -> list[tuple[int, str, float]]:
        """Each word of a query as itself and, from four letters on, as what is near it."""
        out = []
        for clause, term in enumerate(query.lower().split()):
            out.append((clause, term, 1.0))
            if len(term) > 3:
                out += [(clause, t, w) for t, w in self.expand(term, fuzzy_edits)]
        return out

    def search(self, query: str, top_n: int = 10, fuzzy_edits: int = 1, docs: DataFrame | None = None) -> DataFrame:
        """Documents that have every word of a query, or one within few edits of it."""
        return ranked(self._all_words(query, fuzzy_edits, docs), top_n)

    def _all_words(self, query: str, fuzzy_edits: int, docs: DataFrame | None = None) -> DataFrame:
        words = len(query.lower().split())
        found = self.scores(self.clauses(query, fuzzy_edits), docs)
        return found.groupBy("doc_id").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("found")).where(F.col("found") == words).drop("found")

    def search_phrase_aware(self, query: str, top_n: int = 10, fuzzy_edits: int = 1, slop: int = 5) -> DataFrame:
        """As ``search``, with the words' phrase adding to the score where it is."""
        found = self._all_words(query, fuzzy_edits)
        words = query.lower().split()
        if len(words) > 1:
            bonus = self._phrase(words, slop).withColumnRenamed("score", "bonus")
            found = found.join(bonus, "doc_id", "left").select("doc_id", (F.col("score") + F.coalesce("bonus", F.lit(0.0))).alias("score"))
        return ranked(found, top_n)

    def search_with_filters(self, query: str = "", filters: dict | None = None, top_n: int = 10, fuzzy_edits: int = 1, strict: bool = False) -> DataFrame:
        """As ``search`` over the documents that pass all filters.

        ``<column>_range`` with a pair is an inclusive range of the column's
        number; others are equal values, compared in lower case (``strict``
        compares the lower-cased value with the column as it is). Without a
        query each filter counts 1.
        """
        rows = self.docs
        for name, value in (filters or {}).items():
            if name.endswith("_range") and isinstance(value, tuple):
                column = F.col(f"{name.removesuffix('_range')}_num")
                rows = rows.where(column.between(int(value[0]), int(value[1])))
            else:
                column = F.col(name).cast("string")
                rows = rows.where((column if strict else F.lower(column)) == str(value).lower())
        if not query:
            return ranked(rows.select("doc_id", F.lit(float(len(filters or {}))).alias("score")), top_n)
        return ranked(self._all_words(query, fuzzy_edits, rows), top_n)

    def search_range(self, column: str, low, high, top_n: int = 10) -> DataFrame:
        """Documents whose number lies in an inclusive range; all score 1."""
        rows = self.docs.where(F.col(f"{column}_num").between(int(low), int(high)))
        return ranked(rows.select("doc_id", F.lit(1.0).alias("score")), top_n)

    def search_fuzzy(self, term: str, max_edits: int = 2, top_n: int = 5) -> DataFrame:
        found = self.scores([(0, t, w) for t, w in self.expand(term, max_edits)])
        return ranked(found.select("doc_id", "score"), top_n)

    def search_phrase(self, phrase: str, slop: int = 0, top_n: int = 5) -> DataFrame:
        """Documents that have the words in order, with at most ``slop`` moves."""
        return ranked(self._phrase(phrase.lower().split(), slop), top_n)

    def _phrase(self, words: list[str], slop: int) -> DataFrame:
        """Occurrences are those of the first word near which all others are in place.

        The place of word ``i`` is its position less ``i``; the places of an
        occurrence lie within ``slop`` of each other.
        """
        if not words:
            return self.spark.createDataFrame([], "doc_id long, score double")
        known = self.frequencies(words)

        def places(word: str, i: int) -> Column:
            # a document has one row for a term
            return F.first(F.when(F.col("term") == word, F.transform("places", lambda p: p - i)), ignorenulls=True)

        lists = [places(w, i).alias(f"p{i}") for i, w in enumerate(words)]
        placed = self._postings(words).groupBy("doc_id").agg(F.first("n_tokens").alias("n_tokens"), *lists)
        for i in range(len(words)):
            placed = placed.where(F.col(f"p{i}").isNotNull())

        def holds(low: Column) -> Column:
            each = [F.exists(f"p{i}", lambda p: p.between(low, low + slop)) for i in range(1, len(words))]
            return reduce(lambda x, y: x & y, each, F.lit(True))

        hits = F.filter("p0", lambda a: F.exists(F.sequence(a - slop, a), holds))
        counted = placed.select("doc_id", "n_tokens", F.size(hits).alias("tf")).where("tf > 0")
        weight = sum(_idf(self.n, known.get(t, 0)) for t in words)
        tf = F.col("tf")
        score = F.lit(weight) * tf / (tf + K1 * (1 - B + B * F.col("n_tokens") / F.lit(float(self.mean))))
        return counted.select("doc_id", score.alias("score"))

    def search_keyword(self, query: str, top_n: int = 5) -> DataFrame:
        """A query with AND, OR, NOT, + and -, quotes, ``~``, ``*``, ``?`` and brackets.

        Clauses without an operator are optional, one of them at least must
        hold if none is required.
        """
        leaves: list[tuple] = []
        tree = Parser(query).parse()
        condition = self._condition(tree, leaves, True)
        if not leaves:
            return ranked(self.docs.where("false").select("doc_id", F.lit(0.0).alias("score")), top_n)
        parts = [self._leaf(kind, text, extra).select("doc_id", F.lit(number).alias("leaf"), (F.col("score") if counts else F.lit(0.0)).alias("score")) for number, (kind, text, extra, counts) in enumerate(leaves)]
        flags = [F.max(F.col("leaf") == i).alias(f"l{i}") for i in range(len(leaves))]
        found = reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.sum("score").alias("score"), *flags)
        return ranked(found.where(condition).select("doc_id", "score"), top_n)

    def _condition(self, node: tuple, leaves: list, counts: bool) -> Column:
        if node[0] != "bool":
            leaves.append((node[0], node[1], node[2], counts))
            return F.coalesce(F.col(f"l{len(leaves) - 1}"), F.lit(False))
        must, should, but = [], [], []
        for occur, child in node[1]:
            made = self._condition(child, leaves, counts and occur != "-")
            (must if occur == "+" else but if occur == "-" else should).append(made)
        held = reduce(lambda x, y: x & y, must) if must else reduce(lambda x, y: x | y, should, F.lit(False))
        return reduce(lambda x, y: x & ~y, but, held)

    def _leaf(self, kind: str, text: str, extra: int | None) -> DataFrame:
        if kind == "phrase":
            return self._phrase(query_terms(text), extra or 0)
        if kind == "wild":
            shape = "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in text.lower()) + "$"
            begin = re.split(r"[*?]", text.lower())[0]  # what it begins with is found by the order of terms
            return self.posted.where(F.col("term").startswith(begin) & F.col("term").rlike(shape)).select("doc_id").distinct().withColumn("score", F.lit(1.0))
        if kind == "fuzzy":
            return self.scores([(0, t, w) for t, w in self.expand(text.lower(), extra if extra is not None else 2)]).select("doc_id", "score")
        words = query_terms(text)
        return self.scores([(0, t, 1.0) for t in words]).groupBy("doc_id").agg(F.sum("score").alias("score"))

    def stored(self, hits: DataFrame) -> DataFrame:
        """Hits with all columns of their documents; absent values read ``N/A``."""
        columns = [c for c in self.docs.columns if c not in ("doc_id", "n_tokens")]
        texts = [F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("N/A")).alias(c) for c in columns]
        return hits.join(self.docs.select("doc_id", *texts), "doc_id").orderBy("rank")


def _idf(n: int, df: int) -> float:
    return log(1 + (n - df + 0.5) / (df + 0.5))


class Parser:
    """Recursive descent over a keyword query.

    Nodes are ``(kind, text, extra)`` or ``("bool", [(occur, node)])`` with
    ``+`` required, ``-`` excluded and a blank for optional.
    """

    TOKENS = re.compile(r'\s*(?:(\()|(\))|([+\-!])(?=\S)|"([^"]*)"(?:~(\d+))?|(&&|\|\|)|([^\s()"]+))')

    def __init__(self, query: str):
        self.tokens = [m.groups() for m in self.TOKENS.finditer(query)]
        self.at = 0

    def parse(self) -> tuple:
        node = self._clauses()
        while self.at < len(self.tokens):  # closing brackets too many are passed over
            self.at += 1
            more = self._clauses()
            node = ("bool", node[1] + more[1])
        return node

    def _clauses(self) -> tuple:
        out: list[list] = []
        joint = None
        while self.at < len(self.tokens) and not self.tokens[self.at][1]:
            _, _, sign, _, _, symbol, word = self.tokens[self.at]
            if word in ("AND", "OR") or symbol:
                joint = "AND" if word == "AND" or symbol == "&&" else "OR"
                self.at += 1
                continue
            occur = " "
            if sign or word == "NOT":
                occur = "+" if sign == "+" else "-"
                self.at += 1
                if self.at >= len(self.tokens) or self.tokens[self.at][1]:
                    break
            child = self._one()
            if child is None:
                continue
            if joint == "AND":
                if out and out[-1][0] == " ":
                    out[-1][0] = "+"
                occur = "+" if occur == " " else occur
            joint = None
            out.append([occur, child])
        return ("bool", [tuple(x) for x in out])

    def _one(self) -> tuple | None:
        opened, _, _, quoted, slop, _, word = self.tokens[self.at]
        self.at += 1
        if opened:
            node = self._clauses()
            self.at += 1
            return node
        if quoted is not None:
            return ("phrase", quoted, int(slop or 0))
        if word is None:
            return None
        fuzzy = re.fullmatch(r"(.+?)~([0-2])?(?:\.\d+)?", word)
        if fuzzy:
            return ("fuzzy", fuzzy[1], int(fuzzy[2]) if fuzzy[2] else 2)
        if "*" in word or "?" in word:
            return ("wild", word, None)
        return ("term", word, None) if query_terms(word) else None
