"""URL allow-list and content digests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXCERPT_CHARS = 500  # Fixed value: characters of a citation excerpt.


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Lower-cased scheme, lower-cased host without user and port, and path
    ('/' when empty)."""
    part = lambda group: F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)", group)
    authority = F.regexp_replace(part(2), r"^.*@", "")
    host = F.when(authority.startswith("["), F.regexp_extract(authority, r"^\[([^\]]*)", 1)).otherwise(
        F.regexp_replace(authority, r":.*$", "")
    )
    return F.lower(part(1)), F.lower(host), F.when(part(3) == "", F.lit("/")).otherwise(part(3))


def is_allowed(url: Column, allowed: Iterable[tuple[str, str]]) -> Column:
    """True for an https URL whose host is, or is below, an allowed host and
    whose path has that host's prefix.  A plain predicate: no join."""
    scheme, host, path = url_parts(url)
    match = F.lit(False)
    for name, prefix in allowed:
        match = match | (((host == name) | host.endswith(f".{name}")) & path.startswith(prefix))
    return F.coalesce((scheme == "https") & match, F.lit(False))


def keep_allowed(pages: DataFrame, allowed: Iterable[tuple[str, str]], url: str = "url") -> DataFrame:
    return pages.where(is_allowed(F.col(url), allowed))


def citation(text: Column) -> Column:
    """STRUCT<sha256, excerpt> of a fetched text."""
    return F.struct(F.sha2(text, 256).alias("sha256"), F.substring(text, 1, EXCERPT_CHARS).alias("excerpt"))
