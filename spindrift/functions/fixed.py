"""Word lists and patterns that results must agree with.

All values below are fixed: they define which text of a page or article is
taken. They are regular expressions in Java's dialect, to be read with the
flags that ``patterns`` puts in front of them.
"""

from __future__ import annotations

# --- fixed values: listing pages, current pattern pack -----------------------
PORTALS = {"Slovakia": ["nehnutelnosti.sk"], "Czechia": ["sreality.cz"], "Austria": ["immobilienscout24.at", "immowelt.at", "willhaben.at"]}
FLAT_WORDS = r"\b(byt|wohnung|flat|apartment|apartmán)\b"
HOUSE_WORDS = r"\b(dom|haus|family house|dům|rodinný dům|rodinný dom)\b"
AT_OFFER = r"""<span[^>]*class\s*=\s*["']Costs-label-[^"']*["'][^>]*>\s*(Kaufpreis|Miete|Monatliche\s+Kosten)\s*</span>"""
SK_HEAD = r"""<p[^>]*class\s*=\s*["']MuiTypography-root\s+MuiTypography-h3\s+mui-15163pd[^"']*["'][^>]*>"""
SK_RENT_TAIL = r"[^<]*€(?:&nbsp;|\s|<!--.*?-->)*\s*/\s*(?:mes\.|mesačne|month)"
SK_BUY_TAIL = r"[^<]*\d+[.,]?\d*\s*(?:€|EUR)(?!\s*/\s*(?:mes\.|mesačne))"
TITLE = r"<title>(.*?)</title>"
AREA = r"([\d.,]+)\s*(?:m²|m2)"
ROOMS = r"([0-9]+)\s*(?:Zimmer|izb|rooms?|kk)"
YEAR = r"(?:Baujahr|Rok.*výstavby|Year built).*?([12][0-9]{3})"
CONDITION = r"(Novostavba|Pôvodný stav|Kompletná rekonštrukcia|Čiastočná rekonštrukcia|Neubau|Altbau|Renoviert)"
MONTHLY_COSTS = r"(?:Nebenkosten|Mesačné náklady).*?([0-9\s.,]+)"
DEPOSIT = r"(?:Kaution|Depozit).*?([0-9\s.,]+)"
RENTAL_TERM = r"(?:Mietdauer|Doba nájmu).*?([^<\n\r]+)"
LAND_AREA = r"(?:Grundstücksfläche|Pozemok|Gartenfläche).*?([0-9.,]+)"
AT_ADDRESS = r'"addressString"\s*:\s*"([^"]+)"'
SK_ADDRESS = r"""<p[^>]*class=["']MuiTypography-root[^"']*MuiTypography-noWrap[^"']*["'][^>]*>\s*([A-ZÄÖÜĽŠČŽÁÉÍÓÚÝŤĎŇa-zäöüľščžáéíóúýťďň0-9.,\- ]{10,200})\s*</p>"""
ENERGY_SPAN = r"""<div[^>]*class\s*=\s*["']Indicator-indicator-aA6["'][^>]*>.*?<span[^>]*>\s*(A\+\+|A\+|A0|A1|A2|A|B|C|D|E|F|G)\s*</span>"""
ENERGY_WORD = r"\b(A\+\+|A\+|A0|A1|A2|A|B|C|D|E|F|G)\b"
SK_PRICE = r"<p[^>]*MuiTypography-h3[^>]*>\s*([0-9\.\s,&nbsp;]+€)"
AT_PRICE = r"""<span[^>]*class\s*=\s*["']Costs-label-[^"']*["'][^>]*>\s*(?:Kaufpreis|Miete|Monatliche\s+Kosten)\s*</span>.*?<span[^>]*class\s*=\s*["']Costs-price-[^"']*["'][^>]*>\s*([0-9.,\s]+€)\s*</span>"""
SK_PRICE_M2 = r"<p[^>]*MuiTypography-label2[^>]*>\s*([0-9\.,\s]+€/m²)"
AT_PRICE_M2 = r"""<span[^>]*>\s*(?:Kaufpreis|Preis).*?pro.*?m²\s*</span>.*?<span[^>]*Costs-price-[^"']*[^>]*>\s*([0-9.,\s]+€)\s*</span>"""
AVAILABILITY = r""""availableFrom"\s*:\s*"([^"]+)"|(?:Verfügbar\s*ab|Voľný\s*od|Available\s*from)\s*[:\-]?\s*([^\n\r<"]{1,50})"""

# --- fixed values: listing pages, earlier pattern pack -----------------------
EARLIER = {
    "area": r"(?:Wohnfläche|Gesamtfläche|Užitná\s*plocha|Plocha(?:\s*(?:bytu|domu))?|Nutzfläche|plocha)[\s\S]{0,300}?([\d,.]+)\s*(?:m²|m2)",
    "land_area": r"(?:Grundstücksfläche|Pozemok)\s*[:\-]?\s*([0-9]+[,\.]?[0-9]*)\s*m",
    "monthly_costs": r"(?:Nebenkosten|Mesačné náklady|Monthly costs)\s*[:\-]?\s*([0-9\s.,]+)",
    "deposit": r"(?:Kaution: €|Depozit)\s*[:\-]?\s*([0-9\s.,]+)",
    "rental_term": r"(?:Mietdauer|Doba nájmu|Rental term)\s*[:\-]?\s*([^<\n\r]+)",
}
EARLIER_YEAR = r"(?:Baujahr|Rok\s*výstavby|Year\s*built)(?:\s|&nbsp;|<!--.*?-->|<[^>]+>){0,10}([12][0-9]{3})"
EARLIER_SK_RENT = r"""<p[^>]*class\s*=\s*["']MuiTypography-root[^"']*["'][^>]*>[^<]*€(?:\s*/\s*(?:mes\.|mesačne|month))"""
EARLIER_SK_BUY = r"""<p[^>]*class\s*=\s*["']MuiTypography-root[^"']*["'][^>]*>[^<]*\d+[.,]?\d*\s*(?:€|EUR)(?!\s*/\s*(?:mes\.|mesačne))"""
EARLIER_SK_PRICE = r"""<p[^>]*class\s*=\s*["']MuiTypography-root\s+MuiTypography-h3[^"']*["'][^>]*>\s*([0-9\.\s,&nbsp;]+€)"""
EARLIER_AT_PRICE = r"""<div[^>]*class\s*=\s*["']Costs-row-[^"']*["'][^>]*>[^<]*?<span[^>]*>\s*(?:Kaufpreis|Miete|Monatliche(?:\s|&nbsp;|<!--.*?-->)*Kosten)\s*</span>.*?<span[^>]*class\s*=\s*["']Costs-price-[^"']*["'][^>]*>\s*([0-9.,\s]+€)\s*</span>"""
EARLIER_SK_PRICE_M2 = r"""<p[^>]*class\s*=\s*["']MuiTypography-root\s+MuiTypography-label2[^"']*["'][^>]*>\s*([0-9\.\,\s,&nbsp;]+€/m²)"""
EARLIER_AT_PRICE_M2 = r"""<div[^>]*class\s*=\s*["']Costs-row-[^"']*["'][^>]*>[^<]*?<span[^>]*>\s*(?:Kaufpreis|Preis)(?:\s|&nbsp;|<!--.*?-->)*pro(?:\s|&nbsp;|<!--.*?-->)*m²\s*</span>.*?<span[^>]*class\s*=\s*["']Costs-price-[^"']*["'][^>]*>\s*([0-9.,\s]+€)\s*</span>"""
RENT_WORDS = r"\b(miete|mieten|rent|na prenájom|for rent|pronájem|na pronájem)\b"
BUY_WORDS = r"\b(predaj|verkauf|kaufen|for sale|na predaj|prodej|na prodej)\b"
CZ_RENT_WORDS = r"(?:měsíčně|pronájem|nájem)\b"
CZ_BUY_WORDS = r"(?:prodej|koupě|cena)\b"

# --- fixed values: encyclopedia articles -------------------------------------
INFOBOX = {
    "population": ["population_total", "population", "pop"],
    "area_km2": ["area_total_km2", "area_km2", "area"],
    "elevation_m": ["elevation_m", "elevation"],
    "country": ["country", "subdivision_name"],
    "timezone": ["timezone", "timezone1", "utc_offset"],
    "postal_code": ["postal_code", "postcode"],
    "website": ["website", "url"],
    "mayor": ["leader_name", "mayor", "leader_name1"],
    "founded": ["established_date", "founded"],
    "climate": ["climate", "climate_type", "Köppen"],
    "coordinates": ["coordinates", "coord"],
    "rivers": ["river", "rivers"],
    "nicknames": ["nickname", "nicknames"],
    "languages": ["official_language", "languages", "language"],
    "twin_cities": ["twin_cities", "sister_cities", "twin1"],
}
PROSE = {
    "rivers": [r"(?:the\s+)?([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\s+River", r"River\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})"],
    "mountains": [r"(?:Mount|Mt\.)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+Mountain"],
    "historic_sites": [
        r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:Castle|Cathedral|Palace)",
        r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:Church|Fort|Fortress)",
        r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:Monument|Memorial|Museum)",
        r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:Old Town|Square)",
    ],
    "universities": [r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+University", r"University\s+of\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"],
    "airports": [r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:International\s+)?Airport"],
}
#: Replacements that take wiki markup off a value, in order.
MARKUP = [
    (r"\{\{[^{}]*\}\}", ""), (r"\{\{[^{}]*\}\}", ""), (r"\{\{.*?\}\}", ""), (r"<[^>]*>", ""),
    (r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2"), (r"\[\[([^\]]+)\]\]", "$1"), (r"'{2,}", ""),
    (r"&[a-zA-Z]+;", " "), (r"&#[0-9]+;", " "), (r"[{}]", ""), (r"[\[\]]", ""), (r"\s+", " "),
]
LEFTOVERS = [(r"\{\{[^}]*\}\}", ""), (r"[\[\]{}]", ""), (r"<[^>]*>", ""), (r"\s+", " "), (r"^[,\s]+|[,\s]+$", "")]
NAME_TAIL = r"[,\(\)\-–].*"
EXCLUDED_TITLES = ["(disambiguation)", "history of", "list of"]

# --- fixed values: text, numbers and links -----------------------------------
FOLDED, PLAIN = "áäéíóôúýčďľňŕšťž", "aaeioouycdlnrstz"
LAST_PAGE = r"(?:[?&](?:page|strana)=|/(?:seite|strana|page)[=-])(\d{1,5})"
PAGE_PARAM = r"[?&](page|seite|strana)="
RESERVED = r'[\\/*?:"<>|]'
