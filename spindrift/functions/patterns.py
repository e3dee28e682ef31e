"""Regular expressions as column expressions.

Python's classes are Unicode classes and its dot stops at a line feed only;
the flags here make Java's do the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ignore case; the dot stops at line feeds.
LINE = "(?diU)"
#: Ignore case; the dot takes everything.
PAGE = "(?isU)"
#: Heed case; the dot stops at line feeds.
EXACT = "(?dU)"
MISSING = "NaN"


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without a match, so an empty group is not one.

    The match is cut out first and its group is read from it, which looks at
    the whole text once.
    """
    return F.regexp_extract(F.regexp_substr(text, F.lit(pattern)), pattern, group)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def first_present(*texts: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def or_missing(text: Column) -> Column:
    return F.coalesce(text, F.lit(MISSING))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is used in it.

    A filter that the optimizer moves below a projection repeats what the
    projection names; a bound value stays one.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
