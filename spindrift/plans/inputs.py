"""Inputs in the forms the engine reads, made from the typed tables.

The tables hold no listings and no articles, so pages are written out from
typed columns; what must be read from them again is then known exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.schemas import WIKI_DUMP


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing page for each part: Slovak or Austrian, for sale or to let."""
    k, size = F.col("p_partkey"), F.col("p_size")
    paid = F.floor("p_retailprice")
    per = F.floor(F.col("p_retailprice") / size)
    town = k % 25
    slovak = _joined(
        "<html><head><title>Byt ", k, " nehnutelnosti.sk</title></head><body>",
        '<p class="MuiTypography-root MuiTypography-h3 mui-15163pd x">', paid, " €", F.when(k % 4 == 1, " / mes.").otherwise(""), "</p>",
        '<p class="MuiTypography-root MuiTypography-label2">', per, " €/m²</p>",
        '<p class="MuiTypography-root z MuiTypography-noWrap">Ulica ', size, ", Mesto", town, ", okres Stred</p>",
        "<p>", size, " m²</p><p>", size % 7 + 1, " izb</p><p>Rok výstavby: ", size + 1950, "</p><p>Novostavba</p>",
        "<p>Depozit: ", size, "00 €</p><p>Mesačné náklady: ", size, " €</p><p>Pozemok: ", size * 10, " m</p>",
        '<div class="Indicator-indicator-aA6"><b>x</b><span>B</span></div><p>Doba nájmu: 1 rok</p><p>Voľný od: 1.', size % 12 + 1, ".2025</p></body></html>",
    )
    address = F.when(k % 20 == 19, F.lit("12345678")).otherwise(_joined("Gasse ", size, ", ", town + 1000, " Mesto", town))
    austrian = _joined(
        "<html><head><title>", F.when(k % 4 == 2, "Wohnung ").otherwise("Haus "), k, " immowelt.at</title></head><body>",
        '<span class="Costs-label-x">', F.when(k % 4 == 2, "Kaufpreis").otherwise("Miete"), '</span><span class="Costs-price-x">', paid, " €</span>",
        "<span>Preis pro m²</span>", '<span class="Costs-price-y">', per, " €</span>",
        '<script>{"addressString":"', address, '","availableFrom":"2025-', size % 12 + 1, '"}</script>',
        "<p>", size, ",5 m2</p><p>", size % 5 + 1, " Zimmer</p><p>Baujahr ", size + 1900, "</p><p>Altbau</p><p>Energie C</p>",
        "<p>Kaution: ", size, ".000 €</p><p>Nebenkosten: ", size, " €</p><p>Grundstücksfläche ", size * 3, " m</p><p>Mietdauer: 5 Jahre</p></body></html>",
    )
    part = table(spark, sf_dir, "part")
    return part.select(_joined("pages/", k, ".html").alias("path"), F.when(k % 4 < 2, slovak).otherwise(austrian).alias("html"))


#: What reading the pages must give, from the same columns and without patterns.
LISTINGS_SQL = """
SELECT 'pages/' || p_partkey || '.html' AS path,
  CASE WHEN bad THEN NULL WHEN sk THEN 'Byt ' || p_partkey || ' nehnutelnosti.sk' WHEN p_partkey % 4 = 2 THEN 'Wohnung ' || p_partkey || ' immowelt.at' ELSE 'Haus ' || p_partkey || ' immowelt.at' END AS title,
  CASE WHEN bad THEN NULL WHEN p_partkey % 4 < 3 THEN 'flat' ELSE 'house' END AS property_type,
  CASE WHEN bad THEN NULL WHEN p_partkey % 2 = 0 THEN 'buy' ELSE 'rent' END AS offer_type,
  CASE WHEN bad THEN NULL WHEN sk THEN 'Ulica ' || p_size || ', Mesto' || town || ', okres Stred' ELSE 'Gasse ' || p_size || ', ' || (town + 1000) || ' Mesto' || town END AS address,
  CASE WHEN bad THEN NULL WHEN sk THEN '' || p_size ELSE p_size || ',5' END AS area,
  CASE WHEN bad THEN NULL WHEN sk THEN '' || (p_size % 7 + 1) ELSE '' || (p_size % 5 + 1) END AS rooms,
  CASE WHEN bad THEN NULL WHEN sk THEN 'B' ELSE 'C' END AS energy_class,
  CASE WHEN bad THEN NULL WHEN sk THEN '' || (p_size + 1950) ELSE '' || (p_size + 1900) END AS year_built,
  CASE WHEN bad THEN NULL WHEN sk THEN 'Novostavba' ELSE 'Altbau' END AS condition,
  CASE WHEN bad THEN NULL WHEN sk THEN ' Mesto' || town ELSE ' ' || (town + 1000) || ' Mesto' || town END AS city,
  CASE WHEN bad THEN NULL WHEN p_partkey % 2 = 0 THEN paid || ' €' ELSE 'NaN' END AS price,
  CASE WHEN bad THEN NULL WHEN sk THEN per || ' €/m²' ELSE per || ' €' END AS price_per_m2,
  CASE WHEN bad THEN NULL WHEN p_partkey % 2 = 1 THEN paid || ' €' ELSE 'NaN' END AS rent_price,
  CASE WHEN bad THEN NULL ELSE '' || p_size END AS monthly_costs,
  CASE WHEN bad THEN NULL WHEN sk THEN p_size || '00' ELSE p_size || '.000' END AS deposit,
  CASE WHEN bad THEN NULL WHEN sk THEN '1.' || (p_size % 12 + 1) || '.2025' ELSE '2025-' || (p_size % 12 + 1) END AS availability,
  CASE WHEN bad THEN NULL WHEN sk THEN ': 1 rok' ELSE ': 5 Jahre' END AS rental_term,
  CASE WHEN bad THEN NULL WHEN sk THEN '' || p_size * 10 ELSE '' || p_size * 3 END AS land_area,
  CASE WHEN bad THEN NULL WHEN sk THEN 'Slovakia' ELSE 'Austria' END AS source_country,
  CASE WHEN bad THEN NULL ELSE p_partkey || '.html' END AS source_url,
  CASE WHEN bad THEN '''NoneType'' object has no attribute ''group''' END AS error
FROM (SELECT *, p_partkey % 4 < 2 AS sk, p_partkey % 25 AS town, p_partkey % 20 = 19 AS bad, CAST(floor(p_retailprice) AS BIGINT) AS paid, CAST(floor(p_retailprice / p_size) AS BIGINT) AS per FROM part)
"""


def wiki_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article on a city for each nation, some unfit by title or namespace, each in two revisions."""
    n = F.col("n_nationkey").cast("long")
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.withColumn("revision_no", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    title = F.when(n % 8 == 7, _joined("List of Mesto", n)).when(n % 8 == 6, _joined("Mesto", n, " (disambiguation)")).otherwise(_joined("Mesto", n))
    content = _joined(
        "{{Infobox settlement\n| population_total = ", n * 1000 + F.col("revision_no"), "<ref>z</ref>\n| area_km2 = {{x|1}}\n| area = ", n + 10,
        "\n| elevation = ", n * 7, "&nbsp;m\n| subdivision_name = [[", F.col("r_name"), "]]\n| leader_name = '''", F.col("n_name"), "'''\n| nickname = a", n, ",b;c\n| postcode = ", n + 80000,
        "\n| website = [http://m", n, ".example]\n| established_date = 1", n + 100, "\n| timezone = CET\n| language = sk,de\n}}\n",
        "It lies on the Dunaj River under Mount Krivan. See Stary Castle, Novy Church, Maly Museum and Hlavna Square, ",
        "Slavic University, University of Nitra and Letisko International Airport.",
    )
    stamp = (F.lit("2020-01-01 00:00:00").cast("timestamp").cast("long") + F.col("revision_no") * 86400).cast("timestamp")
    revision = F.struct(stamp.alias("timestamp"), F.struct(content.alias("_VALUE")).alias("text"))
    return rows.select(title.alias("title"), F.when(n % 9 == 8, 1).otherwise(0).cast("long").alias("ns"), revision.cast(WIKI_DUMP["revision"].dataType).alias("revision"))


#: The articles that fit, with their keys.
ARTICLES_SQL = "SELECT n_nationkey AS n, 'Mesto' || n_nationkey AS title, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 8 < 6 AND n_nationkey % 9 <> 8"
FACTS_SQL = f"""
SELECT lower(title) AS title_norm, (n * 1000 + 1) || 'z' AS population, 'x' AS area_km2, (n * 7) || ' m' AS elevation_m, r_name AS country, CAST(NULL AS VARCHAR) AS coordinates,
  'CET' AS timezone, '' || (n + 80000) AS postal_code, 'http://m' || n || '.example' AS website, n_name AS mayor, '1' || (n + 100) AS founded, CAST(NULL AS VARCHAR) AS climate,
  'Dunaj' AS rivers, 'Krivan' AS mountains, 'See Stary, Novy, Maly, Hlavna' AS historic_sites, 'Slavic, University of Nitra' AS universities,
  'a' || n || ', b, c' AS nicknames, 'Letisko International' AS airports, 'sk, de' AS languages, CAST(NULL AS VARCHAR) AS twin_cities
FROM ({ARTICLES_SQL})
"""


def link_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer that links to two others; some are interesting."""
    c = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    n = customers.count()
    html = _joined('<a href="/p', (c * 2) % n, '">a</a><a href="/p', (c * 3 + 1) % n, '">b</a>', F.when(c % 3 == 0, "<p>PLOCHA bytu</p>").otherwise(""))
    return customers.select(_joined("https://www.example.at/p", c).alias("url"), html.alias("html"))


#: Pages by the level at which they are first reached from page 1, to the last level.
#: The queue of a breadth-first walk is kept as a list, so that a page is gone through once.
REACHED_SQL = """
WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer),
{walk}
"""


def walk_sql(start: int, without: str = "") -> str:
    """``first(c, depth)``: pages in the order of levels, each level the links of the one before without what is known."""
    left = f"list_filter(list_distinct(flatten(list_transform(level, lambda c: CASE WHEN c < n THEN [(c * 2) % n, (c * 3 + 1) % n] ELSE [] END))), lambda t: NOT list_contains(known, t){without})"
    return f"""walk(level, known, depth, n) AS (
  SELECT [CAST({start} AS BIGINT)], [CAST({start} AS BIGINT)], 0, n FROM n
  UNION ALL
  SELECT next, list_concat(known, next), depth + 1, n FROM (SELECT {left} AS next, known, depth, n FROM walk) WHERE len(next) > 0
), first AS (SELECT unnest(level) AS c, depth FROM walk)"""
