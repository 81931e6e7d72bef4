"""Small pieces of SQL text shared by the checks."""

from __future__ import annotations


def stamp(column: str, alias: str | None = None) -> str:
    text = f"strftime({column}, '%Y-%m-%dT%H:%M:%SZ')"
    return f"{text} as {alias}" if alias else text


def rel(prefix: str) -> str:
    return f"substr(key, {len(prefix) + 1})"


def slashes(text: str) -> str:
    return f"(length({text}) - length(replace({text}, '/', '')))"


def boundary(prefix: str, depth: int) -> str:
    return f"concat('{prefix}', regexp_extract({rel(prefix)}, '^(([^/]*/){{{depth}}})', 1))"


def depth(prefix: str) -> str:
    text = rel(prefix)
    return f"({slashes(text)} - case when {text} like '%/' then 1 else 0 end + 1)"


def escaped(column: str) -> str:
    text = column
    for code in (*range(1, 0x20), 0x7F):
        text = f"replace({text}, chr({code}), '\\x{code:02x}')"
    return text


def padded(text: str, width: int, side: str = "r") -> str:
    return f"case when length({text}) < {width} then {side}pad({text}, {width}, ' ') else {text} end"


def human(size: str, gap: str = "") -> str:
    units = [("EiB", 6), ("PiB", 5), ("TiB", 4), ("GiB", 3), ("MiB", 2), ("KiB", 1)]
    cases = " ".join(
        f"when {size} >= {1024**n} then printf('%.1f{gap}{unit}', cast({size} as double) / {1024**n}.0)" for unit, n in units
    )
    return f"case {cases} else cast({size} as varchar) end"


def level_rows(source: str, prefix: str, max_depth: int, marker: str = "rollup", where: str = "true") -> str:
    """A depth-limited listing of ``source``: its objects and markers, then PREFIX rows."""
    deep = f"{slashes(rel(prefix))} >= {max_depth}" if marker == "rollup" else f"{depth(prefix)} > {max_depth}"
    under = f"starts_with(key, '{prefix}') and {where}"
    return f"""
select bucket, entry_type, key, size, last_modified from {source} where {under} and not ({deep})
union all
select distinct bucket, 'PREFIX', {boundary(prefix, max_depth)}, cast(0 as bigint), cast(null as timestamp)
from {source} where {under} and {deep}"""
