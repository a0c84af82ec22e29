"""Choice of the access path of a SELECT, with the reason for every plain scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from quern.functions.vector import OPCLASS
from quern.plans.dialect import Distance, Select

#: Index keys longer than this are compared in a scan.
MAX_KEY_BYTES = 2000
#: Spark's limits are 32-bit.
MAX_LIMIT = 2**31 - 1


@dataclass(frozen=True)
class Request:
    select: Select
    #: column -> method, for ordinary indexes
    btree: frozenset[str]
    #: (column, opclass) of the vector index, and whether it covers the snapshot
    hnsw: tuple[str, str] | None
    fresh: bool = True


@dataclass(frozen=True)
class Plan:
    path: str  # BTreeScan, HnswScan, SeqScan
    reason: str = ""
    detail: str = ""

    def text(self, rows: int | None = None, pages: int | None = None) -> str:
        known = [] if rows is None else [f"rows={rows}", f"pages={pages}"]
        return " ".join([self.path, *([f"reason={self.reason}"] if self.reason else []), *([self.detail] if self.detail else []), *known])


def _ordered_by_distance(r: Request) -> bool:
    return r.select.order is not None and isinstance(r.select.order.key, Distance)


def _vector_path(r: Request) -> Plan:
    order, key = r.select.order, r.select.order.key
    if r.select.where:
        return Plan("SeqScan", "ExtraWhere")
    if r.select.limit is None:
        return Plan("SeqScan", "MissingLimit")
    if order.desc:
        return Plan("SeqScan", "Desc")
    if not r.hnsw or r.hnsw[0] != key.column:
        return Plan("SeqScan", "NoIndex")
    if r.hnsw[1] != OPCLASS[key.op]:
        return Plan("SeqScan", "MetricMismatch")
    if not r.fresh:
        return Plan("SeqScan", "SnapshotFallback")
    return Plan("HnswScan", detail=f"column={key.column} opclass={r.hnsw[1]} k={min(r.select.limit, MAX_LIMIT)}")


def _key_path(r: Request) -> Plan:
    where = r.select.where
    if where.column not in r.btree:
        return Plan("SeqScan", "NoIndex")
    if isinstance(where.value, str | bytes) and len(where.value if isinstance(where.value, bytes) else where.value.encode()) > MAX_KEY_BYTES:
        return Plan("SeqScan", "KeyTooLarge")
    return Plan("BTreeScan", detail=f"column={where.column} op={where.op}")


#: Access paths in order: what they match, and the plan they make.  More can be put in.
REGISTRY: list[tuple[str, Callable[[Request], bool], Callable[[Request], Plan]]] = [
    ("hnsw", _ordered_by_distance, _vector_path),
    ("btree", lambda r: r.select.where is not None, _key_path),
    ("seq", lambda r: True, lambda r: Plan("SeqScan", "Plain")),
]


def choose(request: Request) -> Plan:
    return next(make(request) for _, matches, make in REGISTRY if matches(request))
