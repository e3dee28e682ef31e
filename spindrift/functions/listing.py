"""Fields of a listing page as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions import fixed as X
from spindrift.functions.patterns import EXACT, LINE, MISSING, PAGE, first_group, first_present, let, or_missing, strip

HARD_SPACE = "\u00a0"


def country(html: Column) -> Column:
    """The first country one of whose portals the page names."""
    low, found = F.lower(html), F.lit(None).cast("string")
    for name, portals in reversed(X.PORTALS.items()):
        named = F.lit(False)
        for portal in portals:
            named = named | low.contains(portal)
        found = F.when(named, F.lit(name)).otherwise(found)
    return F.coalesce(found, F.lit("Unknown"))


def property_type(html: Column) -> Column:
    low = F.lower(html)
    return F.when(low.rlike(EXACT + X.FLAT_WORDS), "flat").when(low.rlike(EXACT + X.HOUSE_WORDS), "house").otherwise("unknown")


def _austrian_offer(html: Column) -> Column:
    label = F.lower(first_group(html, PAGE + X.AT_OFFER))
    return F.when(label.contains("kaufpreis"), "buy").when(label.contains("miete") | label.contains("monatliche"), "rent")


def offer_type(html: Column, land: Column, earlier: bool = False) -> Column:
    """``buy``, ``rent`` or missing, by the price line of the country's portals."""
    rent = X.EARLIER_SK_RENT if earlier else X.SK_HEAD + X.SK_RENT_TAIL
    buy = X.EARLIER_SK_BUY if earlier else X.SK_HEAD + X.SK_BUY_TAIL
    slovak = F.when(html.rlike(PAGE + rent), "rent").when(html.rlike(PAGE + buy), "buy")
    said = F.when(land == "Austria", _austrian_offer(html)).when(land == "Slovakia", slovak)
    if earlier:
        said = said.when(F.lower(land) == "czech republic", F.when(html.rlike(PAGE + X.CZ_RENT_WORDS), "rent").when(html.rlike(PAGE + X.CZ_BUY_WORDS), "buy"))
    return or_missing(said)


def offer_by_words(html: Column) -> Column:
    low = F.lower(html)
    return F.when(low.rlike(EXACT + X.RENT_WORDS), "rent").when(low.rlike(EXACT + X.BUY_WORDS), "buy").otherwise("unknown")


def field(html: Column, pattern: str) -> Column:
    return or_missing(strip(first_group(html, LINE + pattern)))


def address(html: Column, land: Column, earlier: bool = False) -> Column:
    austrian = F.when(land == "Austria", strip(first_group(html, EXACT + X.AT_ADDRESS)))
    other = F.replace(strip(first_group(html, PAGE + X.SK_ADDRESS)), F.lit(HARD_SPACE), F.lit(" "))
    return or_missing(F.when(land == "Austria", austrian).otherwise(other) if earlier else F.coalesce(austrian, other))


def energy_class(html: Column, earlier: bool = False) -> Column:
    found = F.coalesce(first_group(html, PAGE + X.ENERGY_SPAN), first_group(html, EXACT + X.ENERGY_WORD))
    return or_missing(F.upper(found) if earlier else found)


def _spaced(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(HARD_SPACE), F.lit(" ")), F.lit("&nbsp;"), F.lit(""))


def price(html: Column, land: Column, earlier: bool = False) -> Column:
    if earlier:
        slovak, other = PAGE + X.EARLIER_SK_PRICE, PAGE + X.EARLIER_AT_PRICE
    else:
        slovak, other = LINE + X.SK_PRICE, PAGE + X.AT_PRICE
    found = F.when(land == "Slovakia", first_group(html, slovak)).otherwise(first_group(html, other))
    return or_missing(_spaced(strip(found) if earlier else found))


def price_per_m2(html: Column, land: Column, earlier: bool = False) -> Column:
    if earlier:
        slovak, other = PAGE + X.EARLIER_SK_PRICE_M2, PAGE + X.EARLIER_AT_PRICE_M2
    else:
        slovak, other = EXACT + X.SK_PRICE_M2, PAGE + X.AT_PRICE_M2
    found = F.when(land == "Slovakia", first_group(html, slovak)).otherwise(first_group(html, other))
    return or_missing(_spaced(strip(found) if earlier else found))


def availability(html: Column, earlier: bool = False) -> Column:
    pattern = PAGE + X.AVAILABILITY
    whole = F.regexp_substr(html, F.lit(pattern))
    found = first_present(F.regexp_extract(whole, pattern, 1), F.regexp_extract(whole, pattern, 2))
    return or_missing(strip(found) if earlier else found)


def city_part(where: Column, land: Column) -> Column:
    """The part of an address that names the city, as it stands."""

    def part(parts: Column) -> Column:
        n = F.size(parts)
        other = F.when(n == 3, parts[2]).when(n == 2, parts[1]).when(n == 1, parts[0]).otherwise(MISSING)
        return F.when(land == "Slovakia", F.when(n == 3, parts[1]).otherwise(parts[0])).otherwise(other)

    return let(F.split(where, ","), part)


def city(where: Column, land: Column) -> Column:
    """The city from its first non-digit on (outside Slovakia); null if all is digits."""

    def read(given: Column) -> Column:
        part = city_part(given["where"], given["land"])
        return F.when(given["land"] == "Slovakia", part).otherwise(F.regexp_substr(part, F.lit(EXACT + r"[^\d].*")))

    return _spaced(let(F.struct(where.alias("where"), land.alias("land")), read))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def shared(html: Column, land: Column, earlier: bool = False) -> dict[str, Column]:
    """What several fields of a page are read from."""
    return {"offer": offer_type(html, land, earlier), "paid": price(html, land, earlier), "where": address(html, land, earlier)}


def columns(path: Column, html: Column, land: Column, offer: Column, paid: Column, where: Column) -> dict[str, Column]:
    """The twenty fields of a page by the current pattern pack."""
    return {
        "title": field(html, X.TITLE),
        "property_type": property_type(html),
        "offer_type": offer,
        "address": where,
        "area": field(html, X.AREA),
        "rooms": field(html, X.ROOMS),
        "energy_class": energy_class(html),
        "year_built": field(html, X.YEAR),
        "condition": field(html, X.CONDITION),
        "city": city(where, land),
        "price": F.when(offer == "buy", paid).otherwise(MISSING),
        "price_per_m2": price_per_m2(html, land),
        "rent_price": F.when(offer == "rent", paid).otherwise(MISSING),
        "monthly_costs": field(html, X.MONTHLY_COSTS),
        "deposit": field(html, X.DEPOSIT),
        "availability": availability(html),
        "rental_term": field(html, X.RENTAL_TERM),
        "land_area": field(html, X.LAND_AREA),
        "source_country": land,
        "source_url": basename(path),
    }


def earlier_columns(path: Column, html: Column, land: Column, offer: Column, paid: Column, where: Column) -> dict[str, Column]:
    """The same fields by the earlier pattern pack, which names no city."""
    found = columns(path, html, land, offer, paid, where) | {name: field(html, pattern) for name, pattern in X.EARLIER.items()}
    return found | {
        "energy_class": energy_class(html, True),
        "year_built": or_missing(strip(first_group(html, PAGE + X.EARLIER_YEAR))),
        "city": F.lit(MISSING),
        "price_per_m2": price_per_m2(html, land, True),
        "availability": availability(html, True),
    }
