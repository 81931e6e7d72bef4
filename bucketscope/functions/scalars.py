"""Value formatting: timestamps, sizes and control characters, alike in every session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Binary units and their exponents.
BINARY_UNITS = (("EiB", 6), ("PiB", 5), ("TiB", 4), ("GiB", 3), ("MiB", 2), ("KiB", 1))
# Size units accepted in text and their bytes.
SIZE_UNITS = {
    "": 1,
    **{letter: 1000**n for n, letter in enumerate("KMGTPE", start=1)},
    **{f"{letter}i": 1024**n for n, letter in enumerate("KMGTPE", start=1)},
}
SIZE_PATTERN = r"^ *([0-9]+)([.][0-9]+)? *((?:[KMGTPE]i?)?)B? *$"
MAX_SIZE = 2**64 - 1
CONTROL_CHARS = [chr(code) for code in (*range(0x20), 0x7F)]


def _utc_text(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` of an instant in UTC, whatever the session's zone is."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.unix_seconds(ts)
    day, second = F.floor(seconds / 86400).cast("int"), F.pmod(seconds, F.lit(86400))
    shown = epoch + F.make_dt_interval(day, F.lit(0), F.lit(0), second.cast("decimal(18,6)"))
    return F.translate(F.substring(shown.cast("string"), 1, 19), " ", "T")


def fmt_ts(ts: Column, tz: str | None = None) -> Column:
    """RFC 3339 with whole seconds: ``Z`` in UTC, a numeric offset (``+00:00`` too) in a named zone."""
    if tz is None:
        return F.concat(_utc_text(ts), F.lit("Z"))
    # moved by the zone's offset at the instant, which does not depend on the session's zone
    local = F.from_utc_timestamp(ts, tz)
    minutes = F.floor((F.unix_seconds(local) - F.unix_seconds(ts)) / 60)
    sign = F.when(minutes < 0, "-").otherwise("+")
    offset = F.format_string("%s%02d:%02d", sign, F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60)
    return F.concat(_utc_text(local), offset)


def _one_decimal(size: Column, unit: int) -> Column:
    """The exact quotient with one decimal, ties to even, in whole numbers."""
    tenfold = (size % unit).cast("decimal(20,0)") * 10
    below = F.floor(tenfold / F.lit(unit).cast("decimal(20,0)")).cast("bigint")
    left = (tenfold - below.cast("decimal(20,0)") * F.lit(unit).cast("decimal(20,0)")) * 2
    tie = left == F.lit(unit).cast("decimal(20,0)")
    up = (left > F.lit(unit).cast("decimal(20,0)")) | (tie & (below % 2 == 1))
    tenths = F.floor(size / F.lit(unit).cast("decimal(20,0)")).cast("bigint") * 10 + below + up.cast("bigint")
    return F.concat(F.floor(tenths / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"))


def fmt_size_split(size: Column) -> Column:
    """``struct(number, unit)`` with one decimal, ties to even; sizes below 1024 keep whole ``bytes``."""
    number = F.when(size < 1024, size.cast("string"))
    unit = F.when(size < 1024, F.lit("bytes"))
    for name, power in BINARY_UNITS:
        fits = size >= 1024**power
        number = number.when(fits, _one_decimal(size, 1024**power))
        unit = unit.when(fits, F.lit(name))
    return F.struct(number.alias("number"), unit.alias("unit"))


def fmt_size(size: Column, human: bool = False) -> Column:
    if not human:
        return size.cast("string")
    text = F.when(size < 1024, size.cast("string"))
    for name, power in BINARY_UNITS:
        text = text.when(size >= 1024**power, F.concat(_one_decimal(size, 1024**power), F.lit(name)))
    return text


def escape_ctl(text: Column, raw: bool = False) -> Column:
    """Control characters as ``\\xNN``. Text without any, nearly all of it, only pays for one test.

    The replacements are folded over an array rather than nested: as 33 nested calls they make the generated code too
    long for the JVM to compile.
    """
    if raw:
        return text
    codes = F.array(*[F.struct(F.lit(c).alias("char"), F.lit(f"\\x{ord(c):02x}").alias("code")) for c in CONTROL_CHARS])
    escaped = F.aggregate(codes, text, lambda done, each: F.replace(done, each["char"], each["code"]))
    return F.when(text.rlike(r"[\x00-\x1f\x7f]"), escaped).otherwise(text)


def parse_size(value: str | Column) -> int | Column:
    """Bytes of a size such as ``8MiB``; KB is 1000 bytes, KiB 1024, a bare number bytes.

    A string is parsed here and raises ``ValueError`` when it is not a size or exceeds 64 bits. A column gives
    ``decimal(20,0)``, NULL for such values.
    """
    if isinstance(value, str):
        import math
        import re
        from fractions import Fraction

        match = re.match(SIZE_PATTERN, value)
        if match is None:
            raise ValueError(f"invalid size: {value!r}")
        whole, fraction, unit = match.groups()
        size = math.ceil(Fraction(whole + (fraction or "")) * SIZE_UNITS[unit])
        if size > MAX_SIZE:
            raise ValueError(f"size does not fit 64 bits: {value!r}")
        return size
    part = lambda group: F.regexp_extract(value, SIZE_PATTERN, group)
    unit = part(3)
    factor = F.lit(1).cast("decimal(19,0)")
    for name, amount in SIZE_UNITS.items():
        if name:
            factor = F.when(unit == name, F.lit(amount).cast("decimal(19,0)")).otherwise(factor)
    # leading zeros do not count; what is left and has over 20 digits is beyond 64 bits, and gives NULL
    whole = F.try_multiply(F.regexp_replace(part(1), "^0+(?=.)", "").try_cast("decimal(20,0)"), factor)
    # decimals in two groups of 18 digits, each exact with any factor; what follows only rounds up
    decimals = F.rpad(F.substring(part(2), 2, 36), 36, "0")
    first, second = (F.substring(decimals, at, 18).cast("decimal(18,0)") for at in (1, 19))
    billionth2 = F.lit(10**18).cast("decimal(19,0)")
    high, low = first * factor, second * factor
    carry = F.floor(low / billionth2).cast("decimal(20,0)")
    bytes_of_first = F.floor(high / billionth2).cast("decimal(20,0)")
    rest = high - bytes_of_first * billionth2 + carry
    more = (rest > 0) | (low > carry * billionth2) | F.substring(part(2), 38, 1 << 20).rlike("[1-9]")
    tail = F.when(rest > billionth2, 2).when(more, 1).otherwise(0).cast("decimal(20,0)")
    size = F.try_add(whole, bytes_of_first + tail)
    return F.when(value.rlike(SIZE_PATTERN) & (size <= F.lit(str(MAX_SIZE)).cast("decimal(20,0)")),
                  size.cast("decimal(20,0)"))
