"""Distances of a vector column to a query vector, in double precision and input order."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.sqltypes import SqlError, vector

L2, COSINE, INNER = "<->", "<=>", "<#>"
#: Operator class of an index for each operator.
OPCLASS = {L2: "vector_l2_ops", COSINE: "vector_cosine_ops", INNER: "vector_ip_ops"}


def query_vector(value, dim: int, operator: str) -> list[float]:
    """A list, or text such as ``[1,2.5]``; finite, of the right length, and not zero for cosine."""
    if isinstance(value, str):
        if not re.fullmatch(r"\s*\[[^\[\]]*\]\s*", value):
            raise SqlError(f"{value!r} is no vector")
        inner = value.strip()[1:-1].strip()
        try:
            value = [float(x) for x in inner.split(",")] if inner else []
        except ValueError:
            raise SqlError(f"{value!r} is no vector") from None
    if not isinstance(value, list | tuple):
        raise SqlError("a distance needs a vector")
    out = vector(value, dim, "query vector")
    if operator == COSINE and not any(out):
        raise SqlError("cosine distance to a zero vector is undefined")
    return out


def _as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def distance(v: Column, query: list[float], operator: str) -> Column:
    """Null for a null vector; a stored zero vector raises for cosine.

    Components of the query are rounded to single precision, as stored ones are.
    """
    q = F.array(*[F.lit(float(x)).cast("float").cast("double") for x in query])
    w = _as_double(v)
    if operator == L2:
        d = F.sqrt(_sum(F.zip_with(w, q, lambda a, b: (a - b) * (a - b))))
    elif operator == INNER:
        d = -_sum(F.zip_with(w, q, lambda a, b: a * b))
    elif operator == COSINE:
        dot = _sum(F.zip_with(w, q, lambda a, b: a * b))
        own = _sum(F.transform(w, lambda a: a * a))
        norm = math.sqrt(sum(float(x) ** 2 for x in query))
        fail = F.raise_error(F.lit("cosine distance to a zero vector is undefined")).cast("double")
        d = F.when(own == 0, fail).otherwise(1 - dot / (F.sqrt(own) * F.lit(norm)))
    else:
        raise SqlError(f"no distance operator {operator}")
    return F.when(v.isNotNull(), d)


def l2(v: Column, query) -> Column:
    return distance(v, list(query), L2)


def cosine(v: Column, query) -> Column:
    return distance(v, list(query), COSINE)


def negative_inner(v: Column, query) -> Column:
    return distance(v, list(query), INNER)
