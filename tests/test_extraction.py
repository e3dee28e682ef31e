"""Edge rows of the listing, infobox, number, text and link expressions."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions import infobox, listing, urls
from spindrift.functions.text import folded, terms, whole_number
from spindrift.operators.listings import extract_listings, nullified


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


HEAD = '<p class="MuiTypography-root MuiTypography-h3 mui-15163pd a">'


@pytest.mark.parametrize(
    ("html", "field", "value"),
    [
        ("class A++ x", "energy_class", "A"),
        ('<div class="Indicator-indicator-aA6"><i/><span> A+ </span>', "energy_class", "A+"),
        (f"nehnutelnosti.sk {HEAD}350 000 €</p>", "price", "350 000 €"),
        (f"nehnutelnosti.sk {HEAD}500 €<!-- x --> / mes.</p>", "offer_type", "rent"),
        (f"nehnutelnosti.sk {HEAD}500 €&nbsp;/ month</p>", "rent_price", "500 €"),
        ('immowelt.at <span class="Costs-label-1"> Monatliche  Kosten </span>', "offer_type", "rent"),
        ("Kaution: 1.500 €", "deposit", "1.500"),
        ("Kaution: € 500", "deposit", ""),
        ("Mietdauer</span><b>5 Jahre</b>", "rental_term", "/span>"),
        ("Available from: soon<", "availability", "soon"),
        ('"availableFrom" : "now"', "availability", "now"),
        ("apartmány", "property_type", "unknown"),
        ("apartmán", "property_type", "flat"),
        ("rodinný dům", "property_type", "house"),
        ("www.sreality.cz", "source_country", "Czechia"),
        ("nothing", "title", "NaN"),
        ("<TITLE> a </TITLE>", "title", "a"),
        ("Rok 2020 výstavby 1999", "year_built", "1999"),
        ("3 izb", "rooms", "3"),
    ],
)
def test_fields(spark, html, field, value):
    rows = extract_listings(spark.createDataFrame([("d/a.html", html)], "path string, html string"))
    assert rows.first()[field] == value


@pytest.mark.parametrize(
    ("address", "land", "value"),
    [
        ("Ulica 1, Trnava, okres Trnava", "Slovakia", " Trnava"),
        ("Trnava", "Slovakia", "Trnava"),
        ("1010 Wien", "Austria", " Wien"),
        ("Gasse 1, 1010 Wien", "Austria", " 1010 Wien"),
        ("a, b, c", "Austria", " c"),
        ("a, b, c, d", "Austria", "NaN"),
        ("1010", "Austria", None),
        ("", "Unknown", None),
    ],
)
def test_city(spark, address, land, value):
    assert one(spark, listing.city(F.col("a"), F.col("l")), a=address, l=land) == value


def test_page_without_city_is_an_error_row(spark):
    html = 'willhaben.at "addressString":"1010"'
    row = extract_listings(spark.createDataFrame([("x.html", html), ("y.html", None)], "path string, html string")).orderBy("path").collect()
    assert row[0]["error"] and row[0]["title"] is None and row[0]["path"] == "x.html"
    assert row[1]["error"] is None and row[1]["title"] == "NaN"


def test_nullified(spark):
    rows = spark.createDataFrame([("NaN", " x "), ("Unknown", ""), ("nan", None)], "a string, b string")
    assert [tuple(r) for r in nullified(rows).collect()] == [(None, " x "), (None, None), (None, None)]


@pytest.mark.parametrize(
    ("text", "value"),
    [("350 000 €", 350000), ("1,5", 15), ("2 500 €/m²", None), ("3.500,00 €", 3), ("12d", None), ("", None), ("-7.9", -7), ("1e3", 1000), ("9" * 30, None)],
)
def test_whole_number(spark, text, value):
    assert one(spark, whole_number(F.col("t")), t=text) == value


def test_folded(spark):
    assert one(spark, folded(F.col("t")), t="čšžÁ") == "čšžÁ cszÁ"


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x24F), max_size=40))
def test_terms_as_python_finds_them(spark, text):
    assert one(spark, terms(F.col("t")), t=text) == re.findall(r"\w+", text.lower().replace("̇", " ")) or "İ" in text


@pytest.mark.parametrize(("name", "key"), [("Pezinok, okres Pezinok", "pezinok"), (" A-B", "a"), ("Nitra (mesto)", "nitra"), ("X – Y", "x")])
def test_normalize(spark, name, key):
    assert one(spark, infobox.normalize(F.col("t")), t=name) == key


@pytest.mark.parametrize(
    ("text", "value"),
    [("| a = \n| b = 5", " "), ("| b = 5|", "5"), ("| c = 1", None), ("| coordinates = {{coord|48|8}}", None)],
)
def test_infobox_value(spark, text, value):
    assert one(spark, infobox.value(F.col("t"), "a", "b"), t=text) == value


def test_template_is_cut_at_its_bar(spark):
    assert one(spark, infobox.value(F.col("t"), "coordinates"), t="| coordinates = {{coord|48|8}}") == "{{coord"


@pytest.mark.parametrize(
    ("base", "link"),
    [(b, l) for b in ("http://a.b/c/d?x=1#f", "https://a.b", "http://a.b/c/") for l in ("e", "/e/../f", "?y=2", "#z", "", "http://q/r", "//h/i", "../g", "./g/.", "../../../g?p=1/../2")],
)
def test_resolve_as_the_standard_library(spark, base, link):
    from urllib.parse import urljoin

    assert one(spark, urls.resolve(F.col("b"), F.col("l")), b=base, l=link) == urljoin(base, link)


@pytest.mark.parametrize(("html", "value"), [("", 1), ("?page=3 &strana=12 /seite-7", 12), ("PAGE=5", 1), ("/page=5", 5)])
def test_last_page(spark, html, value):
    assert one(spark, urls.last_page(F.col("h")), h=html) == value


def test_file_name(spark):
    assert one(spark, urls.file_name(F.col("u")), u='https://a/b?c*"<>|\\') == "https___a_b_c______"
