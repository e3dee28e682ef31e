"""Facts of an encyclopedia article as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions import fixed as X
from spindrift.functions.patterns import first_present


def normalize(name: Column) -> Column:
    """A city's name without what follows a comma, bracket or dash, in lower case."""
    return F.lower(F.trim(F.regexp_replace(name, X.NAME_TAIL, "")))


def value(content: Column, *names: str) -> Column:
    """The value of the first infobox field that has one, up to a bar or line end."""
    return first_present(*[F.regexp_extract(content, rf"\|\s*{name}\s*=\s*([^\|\n]+)", 1) for name in names])


def _replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def clean(text: Column) -> Column:
    """Without templates, tags, links, emphasis, entities and brackets."""
    return _replaced(text, X.MARKUP)


def final_clean(text: Column) -> Column:
    return _replaced(text, X.LEFTOVERS)


def _found(content: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(content, pattern, 1), F.lit(""))


def prose(content: Column, kind: str) -> list[Column]:
    """The first match of each pattern of a kind; null where there is none."""
    return [_found(content, p) for p in X.PROSE[kind]]


def raw_values(content: Column) -> Column:
    """The infobox values of an article as they stand, in the order of ``INFOBOX``."""
    return F.array(*[value(content, *aliases) for aliases in X.INFOBOX.values()])


def columns(content: Column, cleaned: Column) -> dict[str, Column]:
    """The nineteen facts of an article, from its text and its cleaned infobox values."""
    found = {name: F.element_at(cleaned, i + 1) for i, name in enumerate(X.INFOBOX)}
    found["rivers"] = F.concat_ws(", ", found["rivers"], *prose(content, "rivers"))
    found["mountains"] = F.concat_ws(", ", *prose(content, "mountains"))
    found["historic_sites"] = F.concat_ws(", ", *prose(content, "historic_sites"))
    named, of = prose(content, "universities")
    found["universities"] = F.concat_ws(", ", named, F.concat(F.lit("University of "), of))
    found["airports"] = F.coalesce(*prose(content, "airports"), F.lit(""))
    for name in ("nicknames", "languages", "twin_cities"):
        found[name] = F.regexp_replace(found[name], "[,;]", ", ")
    return found
