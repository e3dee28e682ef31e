"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

#: Fields of a listing, in their order.
LISTING_FIELDS = [
    "title", "property_type", "offer_type", "address", "area", "rooms", "energy_class", "year_built", "condition", "city",
    "price", "price_per_m2", "rent_price", "monthly_costs", "deposit", "availability", "rental_term", "land_area", "source_country", "source_url",
]
#: Facts about a city, in their order.
CITY_FIELDS = [
    "population", "area_km2", "elevation_m", "country", "coordinates", "timezone", "postal_code", "website", "mayor", "founded",
    "climate", "rivers", "mountains", "historic_sites", "universities", "nicknames", "airports", "languages", "twin_cities",
]
#: Listing and city columns that are also kept as whole numbers.
NUMERIC_FIELDS = ["price", "area", "rooms", "year_built", "price_per_m2", "rent_price", "deposit", "population", "elevation_m"]
#: Columns whose text is their own name when they say yes.
FLAG_FIELDS = ["train_station", "sports_facilities"]
#: Columns that full-text search covers by default.
TEXT_FIELDS = [
    "title", "property_type", "offer_type", "address", "location", "city", "condition", "energy_class", "year_built", "price", "area", "rooms",
    "price_per_m2", "rent_price", "deposit", "availability", "source_country", "population", "universities", "historic_sites",
    "train_station", "shopping_centers", "hospitals", "parks", "sports_facilities", "nicknames", "elevation_m",
]


def strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


PAGE = strings(["path", "html"])
LISTING = strings(["path", *LISTING_FIELDS, "error"])
ENRICHED = strings(["path", *LISTING_FIELDS, "error", *CITY_FIELDS])
WIKI_DUMP = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("ns", T.LongType()),
        T.StructField("revision", T.StructType([T.StructField("timestamp", T.TimestampType()), T.StructField("text", T.StructType([T.StructField("_VALUE", T.StringType())]))])),
    ]
)
WIKI_CITY = T.StructType([T.StructField("title", T.StringType()), T.StructField("content", T.StringType()), T.StructField("last_updated", T.TimestampType())])
CRAWL_JOB = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("root_url", "country", "property_url_regex", "validation_pattern", "page_naming", "property_url_regex_full")] + [T.StructField("max_saves", T.IntegerType())]
)
CRAWL_JOBS = T.StructType([T.StructField("scrape_params", T.ArrayType(CRAWL_JOB))])
CRAWL_STATE = T.StructType(
    [
        T.StructField("scrape_param", CRAWL_JOB),
        T.StructField("downloaded_count", T.LongType()),
        T.StructField("visited", T.ArrayType(T.StringType())),
        T.StructField("queue_items", T.ArrayType(T.StringType())),
    ]
)
#: A state in lines: one of the job and its count, and one for each URL. A state in one line fits as well.
CRAWL_STATE_LINES = T.StructType([*CRAWL_STATE, T.StructField("url", T.StringType()), T.StructField("seen", T.BooleanType()), T.StructField("place", T.LongType())])
LEDGER = T.StructType(
    [
        T.StructField("property_url", T.StringType()),
        T.StructField("saved", T.BooleanType()),
        T.StructField("date_saved", T.TimestampType()),
        T.StructField("date_visited", T.TimestampType()),
        T.StructField("html_path", T.StringType()),
        T.StructField("country", T.StringType()),
    ]
)
#: Saves of a crawl that names no cap.
DEFAULT_SAVES = 500
