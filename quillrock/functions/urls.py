"""Addresses as columns: their parts, references resolved against a base, and safe ASCII forms."""

from __future__ import annotations

import re
from urllib.parse import quote, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"


def dotless(path: Column) -> Column:
    """A path without its "." and ".." segments, as a fold over its segments; ".." at the root is dropped."""
    parts = F.split(path, "/", -1)
    step = lambda kept, x: (
        F.when(x == ".", kept).when((x == "..") & (F.size(kept) > 1), F.slice(kept, 1, F.size(kept) - 1)).when(x == "..", kept).otherwise(F.concat(kept, F.array(x)))
    )
    # a last "." or ".." stands for the folder itself
    done = F.aggregate(parts, F.array().cast("array<string>"), step, lambda kept: F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept))
    whole = F.array_join(done, "/")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.when(path.startswith("/") & ~whole.startswith("/"), F.concat(F.lit("/"), whole)).otherwise(whole)).otherwise(path)


def resolve(base: Column, href: Column) -> Column:
    """The absolute address of a reference found at `base`: whole, by scheme, by host, by query, by fragment or by folder.

    Below a folder, runs of slashes count as one.
    """
    root = F.regexp_extract(base, r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"(?s)^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1)
    tail = F.regexp_extract(href, r"(?s)^[^?#]*(.*)$", 1)
    own = F.regexp_extract(href, r"(?s)^([^?#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    return (
        F.when(href.rlike(SCHEME), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), href))
        .when(href == "", base)
        .when(href.startswith("#"), F.concat(root, path, query, href))
        .when(href.startswith("?"), F.concat(root, path, href))
        .when(href.startswith("/"), F.concat(root, dotless(own), tail))
        .otherwise(F.concat(root, dotless(F.regexp_replace(F.concat(folder, own), "//+", "/")), tail))
    )


def unquote(c: Column) -> Column:
    """Percent codes as UTF-8 text; a plus stays, and so does a percent sign that begins no code."""
    safe = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(c.contains("%"), F.try_url_decode(safe)).otherwise(c)


#: Marks that stay as they are in a path and in a query (fixed values).
PATH_MARKS, QUERY_MARKS = "/%:@!$&'()*+,;=~-._", "=&%:/?@!$'()*+,;~-._"


@F.pandas_udf(StringType())
def to_uri(s: pd.Series) -> pd.Series:
    """The ASCII form in which an address is asked for: the host by IDNA, other parts by percent codes; null for what is no address."""

    def one(url):
        if url is None or (url.isascii() and not re.search(r"[^!-~]|[\"<>\\^`{|}\[\]]", url)):
            return url
        try:
            p = urlsplit(url)
            return urlunsplit(p._replace(netloc=p.netloc if p.netloc.isascii() else p.netloc.encode("idna").decode(), path=quote(p.path, PATH_MARKS), query=quote(p.query, QUERY_MARKS)))
        except (ValueError, UnicodeError):
            return None

    return s.map(one)
