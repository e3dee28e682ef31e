"""The inverted index: postings, statistics and ranked TF-IDF search."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.text import terms

_WORD = re.compile(r"\w+")


def query_terms(query: str) -> list[str]:
    """Terms of a query, by the rule that texts are cut with."""
    return _WORD.findall(query.lower())


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(term, doc_id, tf)``: how often each term is in each document."""
    each = docs.select(F.col(id_col).alias("doc_id"), F.explode(terms(F.col(text_col))).alias("term"))
    return each.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(term, doc_id, pos)``: every occurrence, counted from 0."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(terms(F.col(text_col))).alias("pos", "term")).select("term", "doc_id", "pos")


def ordinals(rows: DataFrame, name: str = "doc_id") -> DataFrame:
    """``rows`` with their place, from 0, in the order in which they are read.

    Each partition is counted and begins where those before it end, so no row
    is moved.
    """
    at = F.monotonically_increasing_id()
    part = F.shiftright(at, 33)
    counts = {r["part"]: r["n"] for r in rows.select(part.alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, before = [], 0
    for k in range(max(counts, default=-1) + 1):  # a number for each partition
        starts.append(before)
        before += counts.get(k, 0)
    start = F.element_at(F.lit(starts or [0]), (part + 1).cast("int"))
    return rows.withColumn(name, (start + at.bitwiseAND(F.lit((1 << 33) - 1))).cast("long"))


def sorted_by_term(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` in files by ranges of terms, so that reads of a few terms skip the
    rest by the ranges that Parquet keeps. A frequent term may fill several files."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)`` of every document; 0 if it has no term."""
    return docs.select(F.col(id_col).alias("doc_id"), F.greatest(F.coalesce(F.size(terms(F.col(text_col))), F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"))


def document_frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: documents, and the mean, least and most terms of one."""
    n = F.col("n_tokens")
    return lengths(docs, id_col, text_col).agg(
        F.count(F.lit(1)).alias("num_docs"), F.avg(n).alias("avg_tokens"), F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"), F.coalesce(F.sum(n), F.lit(0)).alias("total_tokens")
    )


def vocabulary_size(posted: DataFrame) -> DataFrame:
    return posted.agg(F.count_distinct("term").alias("n_terms"))


def idf(df: Column, n: int, kind: str = "classic") -> Column:
    """Classic, smooth, or (under any other name) probabilistic weight of a term."""
    if kind == "classic":
        return F.log(F.lit(float(n)) / F.greatest(df, F.lit(1)))
    if kind == "smooth":
        return F.log(1 + F.lit(float(n)) / (1 + df))
    return F.log((F.lit(float(n)) - df + 0.5) / (df + 0.5) + 1e-10)


@dataclass
class Index:
    """An index over ``docs(doc_id, text)``."""

    docs: DataFrame
    posted: DataFrame
    stats: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, id_col: str | None = "doc_id", text_col: str = "text") -> Index:
        """An index of ``docs``; without an id column a document's id is the place of its row."""
        if id_col is None:
            docs, id_col = ordinals(docs), "doc_id"
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        return cls(rows, postings(rows), statistics(rows))

    def save(self, path: str) -> None:
        """Write the index, with postings in the order of terms."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        sorted_by_term(self.posted, "term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(*[spark.read.parquet(f"{path}/{part}") for part in ("docs", "postings", "stats")])

    def size(self) -> int:
        """Documents; of files, this is read from their metadata."""
        return self.docs.count()

    def search(self, query: str, idf_type: str = "classic", top_n: int = 5) -> DataFrame:
        """``(rank, doc_id, score)`` of the best documents for one query."""
        return self.search_many([query], idf_type, top_n).drop("query_id")

    def search_many(self, queries: list[str], idf_type: str = "classic", top_n: int = 5) -> DataFrame:
        """``(query_id, rank, doc_id, score)`` for many queries in one job.

        A document must have every term of a query that any document has;
        terms unknown to the corpus are passed over. The score is the sum of
        term frequency times weight, with repeated terms counted again. Equal
        scores are ranked by document id.
        """
        spark = self.docs.sparkSession
        asked = [(i, t, n) for i, q in enumerate(queries) for t, n in Counter(query_terms(q)).items()]
        wanted = spark.createDataFrame(asked, "query_id int, term string, qtf int")
        rows = self.posted.where(F.col("term").isin(sorted({t for _, t, _ in asked}))) if asked else self.posted.where("false")
        known = document_frequencies(rows).withColumn("idf", idf(F.col("df"), self.size(), idf_type))
        weighted = wanted.join(known, "term")
        needed = weighted.groupBy("query_id").agg(F.count(F.lit(1)).alias("needed"))
        scored = (
            rows.join(weighted, "term")
            .groupBy("query_id", "doc_id")
            .agg(F.sum(F.col("tf") * F.col("idf") * F.col("qtf")).alias("score"), F.count(F.lit(1)).alias("found"))
            .join(needed, "query_id")
            .where(F.col("found") == F.col("needed"))
        )
        return ranked(scored, top_n, ["query_id"])

    def show(self, query: str, idf_type: str = "classic", top_n: int = 5) -> DataFrame:
        """Hits with their texts, in rank order."""
        return self.search(query, idf_type, top_n).join(self.docs, "doc_id").orderBy("rank")


def ranked(scored: DataFrame, top_n: int, within: list[str] | None = None) -> DataFrame:
    """The best rows by rounded score, ties by document id, with their rank."""
    rows = scored.withColumn("score", F.round("score", 6))
    if within:
        order = Window.partitionBy(*within).orderBy(F.desc("score"), "doc_id")
        rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
        return rows.select(*within, "rank", "doc_id", "score")
    best = rows.orderBy(F.desc("score"), "doc_id").limit(top_n)
    # a window over the few rows of the limit
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))).select("rank", "doc_id", "score")
