"""The eight column types, their Spark types, and strict literal checks.

A literal fits a column only if its kind is the column's own: integers for
INT4, INT8 and TIMESTAMPTZ (microseconds), decimals for FLOAT8, strings for TEXT,
BYTEA and UUID, bracketed lists for VECTOR.  Spark would cast; this layer refuses.
"""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import types as T

MAX_DIM = 2000


class SqlError(Exception):
    """A statement that is refused; nothing was written."""


@dataclass(frozen=True)
class ColumnType:
    name: str  # INT4 INT8 FLOAT8 TEXT BYTEA TIMESTAMPTZ UUID VECTOR
    dim: int = 0

    def __str__(self) -> str:
        return f"VECTOR({self.dim})" if self.name == "VECTOR" else self.name


SPELLINGS = {
    "int": "INT4", "int4": "INT4", "integer": "INT4", "bigint": "INT8", "int8": "INT8", "float8": "FLOAT8",
    "text": "TEXT", "varchar": "TEXT", "bytea": "BYTEA", "timestamptz": "TIMESTAMPTZ", "uuid": "UUID",
}

SPARK = {
    "INT4": T.IntegerType(), "INT8": T.LongType(), "FLOAT8": T.DoubleType(), "TEXT": T.StringType(),
    "BYTEA": T.BinaryType(), "TIMESTAMPTZ": T.TimestampType(), "UUID": T.StringType(),
    "VECTOR": T.ArrayType(T.FloatType()),
}


def struct(columns: list[tuple[str, ColumnType]]) -> T.StructType:
    return T.StructType([T.StructField(n, SPARK[t.name], True, {"sql_type": str(t)}) for n, t in columns])


def parse_type(text: str) -> ColumnType:
    if m := re.fullmatch(r"VECTOR\((\d+)\)", text):
        return ColumnType("VECTOR", int(m[1]))
    return ColumnType(text)


EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def micros(value: int) -> datetime:
    return EPOCH + timedelta(microseconds=value)


def vector(values, dim: int, what: str = "vector") -> list[float]:
    """``values`` as finite single-precision components of the right number."""
    if len(values) != dim:
        raise SqlError(f"{what} has {len(values)} components, VECTOR({dim}) needs {dim}")
    out = [float(x) for x in values]
    if not all(math.isfinite(x) and abs(x) <= 3.4028234663852886e38 for x in out):
        raise SqlError(f"{what} has a component that is not finite")
    return out


def stored(value, kind: ColumnType, column: str):
    """The Spark value of a literal to be stored in a column; value is None, int, float, str, bytes or list."""
    if value is None:
        return None
    name, bad = kind.name, SqlError(f"column {column} is {kind}: {value!r} is of another type")
    if isinstance(value, bool):
        raise bad
    if name in ("INT4", "INT8", "TIMESTAMPTZ"):
        if not isinstance(value, int):
            raise bad
        bits = 31 if name == "INT4" else 63
        if not -(1 << bits) <= value < 1 << bits:
            raise SqlError(f"column {column} is {kind}: {value} is out of range")
        return micros(value) if name == "TIMESTAMPTZ" else value
    if name == "FLOAT8" and isinstance(value, float):
        return value
    if name == "TEXT" and isinstance(value, str):
        return value
    if name == "BYTEA" and isinstance(value, str | bytes):
        return bytearray(value.encode() if isinstance(value, str) else value)
    if name == "UUID" and isinstance(value, uuid.UUID):
        return str(value)
    if name == "VECTOR" and isinstance(value, list | tuple):
        return vector(value, kind.dim, f"value of {column}")
    raise bad


def comparable(value, kind: ColumnType, column: str):
    """The Spark value of a literal that a column is compared with."""
    if value is None:
        raise SqlError(f"{column} can't be compared with NULL")
    if kind.name in ("BYTEA", "VECTOR", "UUID") and not isinstance(value, uuid.UUID):
        raise SqlError(f"column {column} of type {kind} can't be compared with a literal")
    return stored(value, kind, column)
