"""URL operators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def transport(url: Column) -> Column:
    """sse where the path ends in /sse, else http."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.when(F.rtrim(path, F.lit("/")).endswith("/sse"), "sse").otherwise("http")


def public(url: Column) -> Column:
    """url without user, query and fragment."""
    part = lambda name: F.coalesce(F.try_parse_url(url, F.lit(name)), F.lit(""))
    return F.concat(part("PROTOCOL"), F.lit("://"), F.regexp_replace(part("AUTHORITY"), "^.*@", ""), part("PATH"))
