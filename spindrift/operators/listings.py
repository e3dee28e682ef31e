"""Listing records from pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import listing
from spindrift.functions.text import whole_number
from spindrift.schemas import LISTING_FIELDS, NUMERIC_FIELDS

#: What a page is reported with if its address has no city in it.
NO_CITY = "'NoneType' object has no attribute 'group'"


def extract_listings(pages: DataFrame, path_col: str = "path", html_col: str = "html", earlier: bool = False) -> DataFrame:
    """One record of strings for each page, and the error of those that have none.

    All fields are native expressions over one scan, so pages are read once
    and never leave the JVM. A page whose city cannot be read is kept
    with nulls and an error. A null page reads like an empty one.
    """
    rows = pages.select(F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    # in steps, so that what many fields need is worked out once for a page
    html, land = F.col("html"), F.col("land")
    rows = rows.withColumn("land", listing.country(html))
    rows = rows.withColumns(listing.shared(html, land, earlier))
    given = [F.col(c) for c in ("path", "html", "land", "offer", "paid", "where")]
    found = (listing.earlier_columns if earlier else listing.columns)(*given)
    read = rows.select("path", *[found[c].alias(c) for c in LISTING_FIELDS])
    if earlier:
        return read
    failed = F.col("city").isNull()
    return read.select("path", *[F.when(~failed, F.col(c)).alias(c) for c in LISTING_FIELDS], F.when(failed, F.lit(NO_CITY)).alias("error"))


def nullified(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The ways a value can be missing (sentinels, blanks) become null."""
    names = columns or [c for c, kind in rows.dtypes if kind == "string"]
    absent = ["nan", "unknown", "none", ""]
    return rows.withColumns({c: F.when(~F.lower(F.trim(c)).isin(absent), F.col(c)) for c in names})


def typed(rows: DataFrame) -> DataFrame:
    """With a whole number beside each numeric column that is there."""
    return rows.withColumns({f"{c}_num": whole_number(F.col(c)) for c in NUMERIC_FIELDS if c in rows.columns})


def merged(*pages: DataFrame) -> DataFrame:
    """Pages of several crawls together; nothing is dropped."""
    out = pages[0]
    for more in pages[1:]:
        out = out.unionByName(more)
    return out
