"""Terms, indexed texts and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions import fixed as X
from spindrift.schemas import FLAG_FIELDS

#: A term: letters, digits and underscores of any script.
TERM = r"[\p{L}\p{N}_]+"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def folded(text: Column) -> Column:
    """The text, then the text again without diacritics."""
    return F.concat(text, F.lit(" "), F.translate(text, X.FOLDED, X.PLAIN))


def sentence_text(columns: list[str]) -> Column:
    """``field is value`` of all fields that are not missing."""
    parts = []
    for c in columns:
        value = F.trim(F.col(c).cast("string"))
        parts.append(F.when((value != "") & (F.lower(value) != "nan"), F.concat(F.lit(f"{c} is "), value)))
    return F.concat_ws(" ", *parts)


def labelled_text(columns: list[str], flags: list[str] = FLAG_FIELDS) -> Column:
    """``field: value`` of all fields that are not missing, and the names of flags that say yes."""
    parts = []
    for c in columns:
        raw = F.col(c).cast("string")
        value = F.trim(raw)
        there = ~raw.isin("NaN", "nan", "", "None") & ~value.isin("", "NaN", "nan")
        if c in flags:
            parts.append(F.when(there & (F.lower(value) == "yes"), F.lit(c.replace("_", " "))))
        else:
            parts.append(F.when(there, F.concat(F.lit(f"{c}: "), value)))
    return folded(F.concat_ws(" ", *parts))


def whole_number(text: Column) -> Column:
    """The number in a text of digits, towards zero; null if it is anything else.

    Commas, euro signs and spaces are taken out first, so ``1,5`` is 15.
    """
    bare = F.trim(F.regexp_replace(text.cast("string"), "[,€ ]", ""))
    number = bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(number, bare.try_cast("double")).try_cast("long")
