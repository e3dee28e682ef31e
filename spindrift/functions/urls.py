"""Links and names of pages as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions import fixed as X


def links(html: Column, pattern: str) -> Column:
    """The first group of every match, each once."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)))


def resolve(base: Column, link: Column) -> Column:
    """A link as seen from a page, by RFC 3986; empty links are the page itself."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*/.*/|[A-Za-z][A-Za-z0-9+.-]*://[^/]*/)", 1)
    root = F.when(folder == "", F.concat(site, F.lit("/"))).otherwise(folder)
    target = F.regexp_extract(link, r"^([^?#]*)", 1)
    rest = F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    joined = F.when(target.startswith("/"), target).otherwise(F.concat(F.substr(root, F.length(site) + 1), target))
    joined = F.concat(site, _without_dots(joined), rest)
    return (
        F.when(link == "", base)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("?"), F.concat(page, link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), link))
        .otherwise(joined)
    )


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` parts taken; a fold keeps the parts so far."""
    parts = F.slice(F.split(path, "/"), 2, 1 << 20)
    last = F.element_at(parts, -1)
    done = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda kept, part: F.when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(part == ".", kept).otherwise(F.concat(kept, F.array(part))),
    )
    open_end = F.when(last.isin(".", "..") & (F.size(done) > 0), "/").otherwise("")
    resolved = F.concat(F.lit("/"), F.array_join(done, "/"), open_end)
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), resolved).otherwise(path)


def site(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def last_page(html: Column) -> Column:
    """The largest page number that links name; 1 without any."""
    numbers = F.transform(F.regexp_extract_all(html, F.lit("(?i)" + X.LAST_PAGE), F.lit(1)), lambda n: n.cast("int"))
    return F.coalesce(F.array_max(numbers), F.lit(1))


def page_parameter(html: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(html, "(?i)" + X.PAGE_PARAM, 1), F.lit("")), F.lit("page"))


def file_name(name: Column) -> Column:
    """A name in which characters that file systems reserve are underscores."""
    return F.regexp_replace(name, X.RESERVED, "_")


def is_interesting(html: Column, pattern: str) -> Column:
    """Whether a page holds the pattern anywhere, in any case."""
    return html.rlike("(?iU)" + pattern)


def starts_like(url: Column, pattern: str) -> Column:
    """Whether a URL begins with the pattern; an empty pattern fits all."""
    return url.rlike(f"^(?:{pattern})")
