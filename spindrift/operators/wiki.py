"""City articles: choice, facts and the join to listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import fixed as X
from spindrift.functions import infobox
from spindrift.functions.patterns import MISSING
from spindrift.schemas import CITY_FIELDS


def articles(dump: DataFrame) -> DataFrame:
    """Pages of the article namespace whose titles can name a city."""
    low = F.lower("title")
    plain = ~F.col("title").contains("(")
    for words in X.EXCLUDED_TITLES:
        plain = plain & ~low.contains(words)
    return dump.where((F.col("ns") == 0) & plain)


def city_names(listings: DataFrame) -> DataFrame:
    """Each city that listings name, once, as a key for titles."""
    name = F.lower(F.trim("city"))
    return listings.where(F.col("city").isNotNull() & ~F.trim("city").isin("", MISSING)).select(name.alias("city_key")).distinct()


def match_cities(dump: DataFrame, listings: DataFrame) -> DataFrame:
    """``(title, content, last_updated)`` of the articles on cities that listings name.

    Names are made distinct before the join, so it cannot repeat an article;
    whether they are sent to every task is left to their measured size.
    """
    found = articles(dump).join(city_names(listings), F.lower(F.trim("title")) == F.col("city_key"), "leftsemi")
    return latest(found.select("title", F.col("revision.text._VALUE").alias("content"), F.col("revision.timestamp").alias("last_updated")))


def latest(pages: DataFrame) -> DataFrame:
    """One page for each title: the last updated, of those the first by content."""
    order = Window.partitionBy("title").orderBy(F.col("last_updated").desc_nulls_last(), "content")
    return pages.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def repeated_titles(pages: DataFrame) -> DataFrame:
    return pages.groupBy("title").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def facts(pages: DataFrame) -> DataFrame:
    """The key of each city and its nineteen facts.

    Values are cleaned in arrays, by one expression for all of them, so the
    plan stays small enough to be compiled.
    """
    content = F.col("content")
    raw = pages.select(infobox.normalize(F.col("title")).alias("title_norm"), "content", F.transform(infobox.raw_values(content), infobox.clean).alias("raw"))
    found = infobox.columns(content, F.col("raw"))
    last = raw.select("title_norm", F.transform(F.array(*[found[c] for c in CITY_FIELDS]), infobox.final_clean).alias("facts"))
    return last.select("title_norm", *[F.element_at("facts", i + 1).alias(c) for i, c in enumerate(CITY_FIELDS)])


def enrich(listings: DataFrame, cities: DataFrame, unique: bool = False) -> DataFrame:
    """Listings with the facts of their city; all listings are kept.

    With ``unique`` a key that several articles share gives the facts of the
    first of them only, so no listing is repeated.
    """
    if unique:
        order = Window.partitionBy("title_norm").orderBy(*CITY_FIELDS)
        cities = cities.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
    left = listings.withColumn("city_norm", infobox.normalize(F.col("city")))
    return left.join(cities, F.col("city_norm") == F.col("title_norm"), "left").drop("city_norm", "title_norm")
