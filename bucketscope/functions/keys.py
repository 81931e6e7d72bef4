"""Column expressions over object keys. ``rel`` is the part of a key after the target prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def after_prefix(key: Column, prefix: str) -> Column:
    return F.substr(key, F.lit(len(prefix) + 1)) if prefix else key


def slashes(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "/", ""))


def key_depth(key: Column, prefix: str = "") -> Column:
    """Directory level of a key below ``prefix``; a trailing slash does not count as a level.

    NULL for the prefix itself and for keys outside it.
    """
    rel = after_prefix(key, prefix)
    inner = slashes(rel) - F.when(rel.endswith("/"), 1).otherwise(0)
    return F.when(key.startswith(prefix) & (rel != ""), inner + 1)


def prefix_at_depth(key: Column, prefix: str, depth: int) -> Column:
    """``prefix`` plus ``rel`` up to and with its ``depth``-th slash; NULL where there are fewer."""
    rel = after_prefix(key, prefix)
    boundary = F.concat(F.lit(prefix), F.substring_index(rel, "/", depth), F.lit("/"))
    return F.when(key.startswith(prefix) & (slashes(rel) >= depth), boundary)


def relative_key(key: Column, prefix: str | None) -> Column:
    """Key without the target prefix, as shown in relative listings.

    A prefix that does not end in a slash also takes one slash after it, and only one. A key of which nothing would
    be left, or which lies outside the prefix, stays whole.
    """
    if not prefix:
        return key
    rest = F.when(key.startswith(prefix), after_prefix(key, prefix)).otherwise(key)
    if not prefix.endswith("/"):
        rest = F.when(rest.startswith("/"), F.substr(rest, F.lit(2))).otherwise(rest)
    return F.coalesce(F.nullif(rest, F.lit("")), key)
