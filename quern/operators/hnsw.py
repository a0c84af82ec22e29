"""A navigable small-world graph in layers, in numpy."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Params:
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 64
    seed: int = 42
    heuristic: bool = True

    @property
    def m0(self) -> int:
        return 2 * self.m


#: Nodes whose distances to all others are computed at once when a graph is filled.
BLOCK = 256
METRICS = {"vector_l2_ops", "vector_cosine_ops", "vector_ip_ops"}


class Hnsw:
    """Nodes are numbered in order of insertion.  L2 distances are squared here; ties go to the smaller node."""

    def __init__(self, metric: str = "vector_l2_ops", params: Params = Params()):
        if metric not in METRICS:
            raise ValueError(f"no metric {metric}")
        self.metric, self.params = metric, params
        self.vectors = np.zeros((0, 0))
        self.norms = np.zeros(0)
        self.neighbours: list[list[list[int]]] = []  # node -> layer -> nodes
        self.dead: set[int] = set()
        self.entry = -1
        self._rng = np.random.default_rng(params.seed)
        self._n = 0

    def __len__(self) -> int:
        return self._n

    def check(self, v) -> np.ndarray:
        v = np.asarray(v, np.float32).astype(np.float64)
        if not np.isfinite(v).all():
            raise ValueError("a component is not finite")
        if self._n and len(v) != self.vectors.shape[1]:
            raise ValueError(f"dimension {len(v)} instead of {self.vectors.shape[1]}")
        if self.metric == "vector_cosine_ops" and not v.any():
            raise ValueError("cosine distance to a zero vector is undefined")
        return v

    def distances(self, q: np.ndarray, nodes) -> np.ndarray:
        return self._apart(q, self.vectors[nodes], self.norms[nodes])

    def _apart(self, q: np.ndarray, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
        if self.metric == "vector_l2_ops":
            d = x - q
            return np.einsum("ij,ij->i", d, d)
        dot = x @ q
        if self.metric == "vector_ip_ops":
            return -dot
        return 1 - dot / (norms * math.sqrt(float(q @ q)))

    def _layer(self, q: np.ndarray, entries: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ef nearest found from the entries, nearest first."""
        seen = {n for _, n in entries}
        open_, best = list(entries), [(-d, -n) for d, n in entries]
        heapq.heapify(open_)
        heapq.heapify(best)
        while open_:
            d, node = heapq.heappop(open_)
            if len(best) >= ef and (d, node) > (-best[0][0], -best[0][1]):
                break
            fresh = [n for n in self.neighbours[node][layer] if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for dn, n in zip(self.distances(q, fresh).tolist(), fresh):
                if len(best) < ef or (dn, n) < (-best[0][0], -best[0][1]):
                    heapq.heappush(open_, (dn, n))
                    heapq.heappush(best, (-dn, -n))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, -n) for d, n in best)

    def _select(self, near: list[tuple[float, int]], m: int) -> list[int]:
        """m of the candidates: nearest ones, or (heuristic) ones nearer to the node than to any chosen before, then the rest."""
        if not self.params.heuristic or len(near) <= m:
            return [n for _, n in near[:m]]
        gaps, nodes = np.array([d for d, _ in near]), np.array([n for _, n in near])
        free, chosen, x, norms = np.ones(len(near), bool), [], self.vectors[nodes], self.norms[nodes]
        for i in range(len(near)):
            if free[i]:
                chosen.append(i)
                if len(chosen) == m:
                    break
                free &= self._apart(x[i], x, norms) > gaps
        rest = sorted(set(range(len(near))) - set(chosen))
        return nodes[chosen + rest[: m - len(chosen)]].tolist()

    def _level(self) -> int:
        return int(-math.log(1.0 - self._rng.random()) / math.log(self.params.m))

    def _join(self, node: int, layer: int, near: list[tuple[float, int]]) -> None:
        """Link a new node with some of those near it, both ways."""
        most = self.params.m0 if layer == 0 else self.params.m
        self.neighbours[node][layer] = self._select(near, self.params.m)
        for n in self.neighbours[node][layer]:
            links = self.neighbours[n][layer]
            links.append(node)
            if len(links) > most:
                d = self.distances(self.vectors[n], links).tolist()
                self.neighbours[n][layer] = self._select(sorted(zip(d, links)), most)

    def insert(self, v) -> int:
        v = self.check(v)
        node = self._n
        if node >= len(self.vectors):
            grown = np.zeros((max(64, 2 * node), len(v)))
            if node:
                grown[:node] = self.vectors[:node]
            self.vectors = grown
            self.norms = np.concatenate((self.norms, np.zeros(len(grown) - len(self.norms))))
        self.vectors[node] = v
        self.norms[node] = math.sqrt(float(v @ v))
        self._n += 1
        level = self._level()
        self.neighbours.append([[] for _ in range(level + 1)])
        if self.entry < 0:
            self.entry = node
            return node
        top = len(self.neighbours[self.entry]) - 1
        at = [(float(self.distances(v, [self.entry])[0]), self.entry)]
        for layer in range(top, level, -1):
            at = self._layer(v, at, 1, layer)
        for layer in range(min(top, level), -1, -1):
            at = self._layer(v, at, self.params.ef_construction, layer)
            self._join(node, layer, at)
        if level > top:
            self.entry = node
        return node

    def fill(self, rows) -> None:
        """Insert many into an empty graph: the candidates of a node are the exact nearest of all before it.

        They come from blocks of matrix products, so time grows with the square of
        the rows; a shard's number of rows is bounded.
        """
        if self._n:
            raise ValueError("the graph has nodes")
        checked = [self.check(v) for v in rows]
        if not checked:
            return
        self.vectors, self._n = np.stack(checked), len(checked)
        self.norms = np.sqrt((self.vectors**2).sum(1))
        levels = [self._level() for _ in checked]
        self.neighbours = [[[] for _ in range(level + 1)] for level in levels]
        members: list[list[int]] = [[] for _ in range(max(levels) + 1)]
        ef = self.params.ef_construction
        for start in range(0, self._n, BLOCK):
            order = self._order(start, min(start + BLOCK, self._n))
            for node in range(start, min(start + BLOCK, self._n)):
                for layer in range(levels[node], -1, -1):
                    before = np.array(members[layer], np.int64)
                    members[layer].append(node)
                    if len(before) == 0:
                        continue
                    if len(before) > ef:
                        before = before[np.argpartition(order[node - start, before], ef - 1)[:ef]]
                    self._join(node, layer, sorted(zip(self.distances(self.vectors[node], before).tolist(), before.tolist())))
                if self.entry < 0 or levels[node] > levels[self.entry]:
                    self.entry = node
        self._connect()

    def _reach(self, node: int, seen: set[int]) -> None:
        """Add to ``seen`` what paths from a node lead to."""
        stack = [node]
        while stack:
            node = stack.pop()
            if node not in seen:
                seen.add(node)
                stack += [n for layer in self.neighbours[node] for n in layer if n not in seen]

    def _connect(self) -> None:
        """Nodes that no path leads to, as in large groups of copies, get a link from one they link to, beyond the bound on links."""
        seen: set[int] = set()
        self._reach(self.entry, seen)
        for node in range(self._n):
            if node not in seen:
                self.neighbours[next((n for n in self.neighbours[node][0] if n in seen), self.entry)][0].append(node)
                self._reach(node, seen)

    def _order(self, start: int, stop: int) -> np.ndarray:
        """For nodes from start to stop, numbers that order all nodes before stop by their distance."""
        dot = self.vectors[start:stop] @ self.vectors[:stop].T
        if self.metric == "vector_l2_ops":
            return self.norms[:stop] ** 2 - 2 * dot
        return -dot if self.metric == "vector_ip_ops" else -dot / self.norms[:stop]

    def search(self, q, k: int, ef: int | None = None) -> list[tuple[int, float]]:
        """The k nearest live nodes found, as (node, distance)."""
        ef = self.params.ef_search if ef is None else ef
        if ef < k:
            raise ValueError(f"ef {ef} is less than k {k}")
        if k == 0 or self.entry < 0:
            return []
        q = self.check(q)
        at = [(float(self.distances(q, [self.entry])[0]), self.entry)]
        for layer in range(len(self.neighbours[self.entry]) - 1, 0, -1):
            at = self._layer(q, at, 1, layer)
        found = self._layer(q, at, ef + min(len(self.dead), ef), 0)
        return [(n, d) for d, n in found if n not in self.dead][:k]

    def within(self, q, k: int, ties: float, ef: int | None = None) -> list[tuple[int, float]]:
        """Exactly the k nearest live nodes, nearest first, and all that are farther than the k-th by ``ties`` at most.

        What the graph finds bounds the distance of the k-th; all vectors are then
        checked against that bound.  L2 distances are not squared here.
        """
        if k == 0 or self.entry < 0:
            return []
        q = self.check(q)
        found = self.search(q, k, max(k, self.params.ef_search if ef is None else ef))
        d = self.distances(q, np.arange(self._n))
        if self.metric == "vector_l2_ops":
            d = np.sqrt(d)
        d[list(self.dead)] = np.inf
        if len(found) < k:  # few live nodes, or graphs that lead to fewer
            found = [(n, 0.0) for n in np.argsort(d, kind="stable")[:k].tolist()]
        near = np.flatnonzero(d <= max(d[n] for n, _ in found))
        kth = np.partition(d[near], min(k, len(near)) - 1)[min(k, len(near)) - 1]
        near = np.flatnonzero((d <= kth + ties) & (d < np.inf))
        order = near[np.lexsort((near, d[near]))]
        return list(zip(order.tolist(), d[order].tolist()))

    def delete(self, node: int) -> None:
        """Mark a node dead; it still leads to others.  Twice is once."""
        if not 0 <= node < self._n:
            raise ValueError(f"no node {node}")
        self.dead.add(node)

    def redirect(self) -> dict[str, int]:
        """Replace links to dead nodes by links to what these lead to."""
        changed = removed = 0
        for node in range(self._n):
            if node in self.dead:
                continue
            for layer, links in enumerate(self.neighbours[node]):
                gone = [n for n in links if n in self.dead]
                if gone:
                    pool = {x for n in gone if layer < len(self.neighbours[n]) for x in self.neighbours[n][layer]} | set(links)
                    pool -= self.dead | {node}
                    pool = {x for x in pool if layer < len(self.neighbours[x])}
                    order = sorted(pool)
                    near = sorted(zip(self.distances(self.vectors[node], order).tolist(), order)) if order else []
                    self.neighbours[node][layer] = self._select(near, self.params.m0 if layer == 0 else self.params.m)
                    changed, removed = changed + 1, removed + len(gone)
        return {"nodes_changed": changed, "links_removed": removed}

    def audit(self) -> dict[str, float]:
        """Counts, live nodes that no search can reach on layer 0, and the share of live links without their reverse."""
        seen: set[int] = set()
        if self.entry >= 0:
            self._reach(self.entry, seen)
        links = [(a, b) for a in range(self._n) if a not in self.dead for b in self.neighbours[a][0] if b not in self.dead]
        both = set(links)
        one_way = sum((b, a) not in both for a, b in links)
        return {
            "node_count": self._n,
            "live_count": self._n - len(self.dead),
            "tombstoned_count": len(self.dead),
            "unreachable_live_count": len(set(range(self._n)) - self.dead - seen),
            "asymmetry": one_way / len(links) if links else 0.0,
        }
