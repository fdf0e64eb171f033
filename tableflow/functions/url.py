"""Object-URL split: ``scheme://bucket/key`` into bucket, decoded key and
base name, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# URL pieces (RFC 3986 scheme, then authority up to the first
# "/", "?" or "#", then the path up to "?" or "#").
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def percent_decode(c: Column) -> Column:
    """Decode %XX escapes as UTF-8; "+" stays "+" (Spark's decoder would
    turn it into a space, so it is escaped first).  A value with a bad
    escape is kept undecoded."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def object_url_parts(column: str | Column) -> dict[str, Column]:
    """Columns ``scheme`` (lower case), ``bucket``, ``key`` (decoded, no leading "/") and
    ``base_name`` (text after the key's last "/").  A value that is not an
    absolute URL gives nulls."""
    url = F.col(column) if isinstance(column, str) else column
    is_url = url.rlike(_URL)
    # Object-store schemes take no ";params": a ";" belongs to the key.
    path = F.regexp_extract(url, _URL, 3)
    decoded = percent_decode(path)
    key = F.substring(decoded, F.lit(2), F.greatest(F.char_length(decoded), F.lit(1)))
    return {
        "scheme": F.when(is_url, F.lower(F.regexp_extract(url, _URL, 1))),
        "bucket": F.when(is_url, F.regexp_extract(url, _URL, 2)),
        "key": F.when(is_url, key),
        "base_name": F.when(is_url, F.regexp_extract(key, r"([^/]*)$", 1)),
    }


def split_object_url(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Add the URL parts of ``column`` as columns (optionally prefixed)."""
    return df.withColumns({prefix + k: v for k, v in object_url_parts(column).items()})
