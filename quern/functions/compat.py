"""Scalar functions whose usual PostgreSQL-style form Spark spells differently or lacks; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two bigints, never negative; 0 for two zeros.  Euclid's steps are at most 92 for 64 bits."""
    start = F.struct(F.abs(a.cast("long")).alias("a"), F.abs(b.cast("long")).alias("b"))
    # once b is 0 the pair stays as it is
    step = lambda s, _: F.struct(
        F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"),
        F.when(s["b"] == 0, s["b"]).otherwise(s["a"] % F.when(s["b"] == 0, F.lit(1)).otherwise(s["b"])).alias("b"),
    )
    done = F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step)["a"]
    return F.when(a.isNotNull() & b.isNotNull(), done)


def lcm(a: Column, b: Column) -> Column:
    """Least common multiple, never negative; 0 if one is 0."""
    zero = (a == 0) | (b == 0)
    divisor = F.when(zero, F.lit(1)).otherwise(gcd(a, b))
    return F.when(zero, F.lit(0).cast("long")).otherwise(F.abs(F.call_function("div", a.cast("long"), divisor) * b.cast("long")))


def trunc(x: Column, digits: int = 0) -> Column:
    """Towards zero, at a number of digits."""
    scale = F.lit(float(10**digits))
    return F.when(x < 0, F.ceil(x * scale)).otherwise(F.floor(x * scale)) / scale


def concat_skip(*parts: Column) -> Column:
    """Concatenation that leaves nulls out, where Spark's concat gives null."""
    return F.concat_ws("", *parts)


def regexp_replace_first(text: Column, pattern: str, replacement: str) -> Column:
    """Replace the first match only, as without the flag g; both are free of groups."""
    return F.regexp_replace(text, f"(?s)^(.*?)(?:{pattern})", "$1" + replacement)


def date_bin(width: str, time: Column) -> Column:
    """Start of the bin of a width (such as ``15 minutes``) since 1970 that holds a timestamp."""
    micros = F.unix_micros(time.cast("timestamp"))
    size = F.lit(_seconds(width) * 1_000_000)
    return F.timestamp_micros(micros - F.pmod(micros, size))


def _seconds(width: str) -> int:
    number, unit = width.split()
    sizes = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
    return int(number) * sizes[unit.rstrip("s")]


def to_hex(x: Column) -> Column:
    return F.lower(F.hex(x))
