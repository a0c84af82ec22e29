"""Nearest neighbours: inverted file, product-quantised residuals, asymmetric distances, exact reranking.

Vectors belong to the nearest of a number of coarse centroids and keep a code of
their residual, a byte for each subspace, with the distance e between the
residual and what its code stands for.  A query first probes the cells nearest
to it; their best vectors give its k-th distance t.  It then probes every other
cell whose sphere (centroid and radius) comes within t, and in a cell reranks by
exact distance the vectors whose asymmetric distance, from a table for each
subspace, is at most t + e.  By the triangle inequality nothing nearer is missed;
how much is probed depends on how the vectors are clustered.

Large cells are cut into blocks by a hash, so that one cell never is one task.
Queries come in broadcast blocks of a fixed size; no vector is shuffled for a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut, table

#: Vectors (those of the smallest hashes) on which centroids and codebooks are fitted.
SAMPLE = 16_384
MAX_CELLS, SUBSPACES, CODEWORDS = 4096, 16, 256
#: A query's first cells hold at least so many times k vectors.
FIRST = 8
#: Vectors of a block of a cell, and numbers of a broadcast block of queries (32 MB).
BLOCK_ROWS, QUERY_NUMBERS = 20_000, 4_000_000
#: Distances that are held at a time.
PAIRS = 1_000_000
#: Components are clipped to this in the index (never in a score); it keeps squares finite, and clipping brings vectors only nearer.
CLIP = 1e150


def lloyd(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """k-means; an empty cluster takes a random point."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        at = nearest(x, c)[0]
        n = np.bincount(at, minlength=len(c))
        total = np.zeros(c.shape)
        np.add.at(total, at, x / 2)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None] * 2, x[rng.integers(0, len(x), len(c))])
    return c


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances (rows of x, rows of c)."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :], 0)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of c for each row of x, and the distance to it."""
    at, far = np.empty(len(x), np.int32), np.empty(len(x))
    for i in range(0, len(x), 4096):
        d = squares(x[i : i + 4096], c)
        at[i : i + 4096] = best = d.argmin(1)
        far[i : i + 4096] = np.sqrt(((x[i : i + 4096] - c[best]) ** 2).sum(1))
    return at, far


class Ivf:
    """Coarse centroids and a codebook for each subspace."""

    def __init__(self, sample: np.ndarray, n_cells: int):
        sample = np.unique(sample, axis=0)
        self.centroids = lloyd(sample, min(n_cells, len(sample)))
        residual = sample - self.centroids[nearest(sample, self.centroids)[0]]
        self.parts = [p for p in np.array_split(np.arange(sample.shape[1]), SUBSPACES) if len(p)]
        self.books = [lloyd(residual[:, p], CODEWORDS) for p in self.parts]

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, subspaces), and the distance of each residual to what its code stands for."""
        found = [nearest(residual[:, p], b) for p, b in zip(self.parts, self.books)]
        return np.stack([at for at, _ in found], axis=1).astype(np.uint8), np.sqrt(sum(far * far for _, far in found))

    def asymmetric(self, residual: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Distances (queries, vectors) of queries' residuals to what codes stand for, by a table for each subspace."""
        d = np.zeros((len(residual), len(code)))
        for j, (p, b) in enumerate(zip(self.parts, self.books)):
            d += squares(residual[:, p], b)[:, code[:, j]]
        return np.sqrt(d)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a and b in double precision, scaled where squares would leave its range."""
    with np.errstate(over="ignore"):
        diff = a - b
        total = (diff * diff).sum(1)
        out = np.sqrt(total)
        for i in np.flatnonzero(~((total > 1e-280) & (total < 1e300))):
            m = np.abs(diff[i]).max()
            out[i] = m if m == 0 or not np.isfinite(m) else m * np.sqrt(((diff[i] / m) ** 2).sum())
    return out


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part, each pair once; v has floats if the column has, else doubles.

    Null ids, null, empty and zero vectors, vectors with null or non-finite
    components, and those whose length is not the most frequent one (ties: the
    longest) are left out.
    """
    v = F.col("v")
    inf = F.lit(float("inf"))
    kind = "array<float>" if df.select(F.col(vector)).schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast(kind).alias("v"))
    rows = rows.where(
        F.col("vec_id").isNotNull()
        & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf))
    )
    sizes = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return rows.limit(0)
    return rows.where(F.size(v) == sizes[0]["d"]).dropDuplicates(["vec_id", "v"])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _clipped(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -CLIP, CLIP)


def _place(model):
    """Adds the cell of each vector, its distance to the centroid, the code of its residual there, and the code's error."""

    def run(batches):
        ivf = model.value
        for b in batches:
            if len(b):
                x = _clipped(_matrix(b.column(1)))
                at, far = nearest(x, ivf.centroids)
                code, error = ivf.encode(x - ivf.centroids[at])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(at), pa.array(far), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)],
                    names=["vec_id", "v", "cell", "far", "code", "error"],
                )

    return run


class Asked:
    """A block of queries: ids, vectors, the first cells of each (pairs sorted by cell), and the k-th distance found there."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, ivf: Ivf, sizes: np.ndarray):
        self.ids, self.x, self.k = ids, x, k
        self.limit = np.full(len(ids), np.inf)
        cells, rows = [], []
        for i in range(0, len(x), 1024):
            order = np.argsort(squares(_clipped(x[i : i + 1024]), ivf.centroids), axis=1, kind="stable").astype(np.int32)
            held = np.cumsum(sizes[order], axis=1)
            first = held - sizes[order] < FIRST * k + 1
            row, col = np.nonzero(first & (sizes[order] > 0))
            rows.append(row + i)
            cells.append(order[row, col])
        rows, cells = np.concatenate(rows), np.concatenate(cells)
        by = np.argsort(cells, kind="stable")
        self.rows, self.cells = rows[by].astype(np.int32), cells[by]

    def first_of(self, cell: int) -> np.ndarray:
        a, b = np.searchsorted(self.cells, [cell, cell + 1])
        return self.rows[a:b]


def search_block(ivf: Ivf, asked: Asked, who: np.ndarray, centroid: np.ndarray, ids: np.ndarray, x: np.ndarray, code: np.ndarray, error: np.ndarray):
    """(query ids, vec_ids, distances): the k nearest of a cell's vectors for each of the queries, within its limit."""
    out = [], [], []
    for i in range(0, len(who), step := max(1, PAIRS // len(ids))):
        some = who[i : i + step]
        near = ivf.asymmetric(_clipped(asked.x[some]) - centroid, code)
        limit = asked.limit[some]
        own = asked.ids[some][:, None] == ids[None, :]
        if not np.isfinite(limit).all():  # nothing known yet: the k-th of the upper bounds
            high = np.where(own, np.inf, near + error)
            kth = np.partition(high, asked.k - 1, axis=1)[:, asked.k - 1] if len(ids) > asked.k else np.full(len(some), np.inf)
            # clipped vectors are nearer than they are: no upper bound
            whole = bool((np.abs(x) <= CLIP).all()) and bool((np.abs(asked.x[some]) <= CLIP).all())
            limit = np.minimum(limit, kth) if whole else limit
        q, v = np.nonzero((near - error <= (limit * (1 + 1e-9) + 1e-300)[:, None]) & ~own)
        for j in range(0, len(q), 200_000):
            a, b = q[j : j + 200_000], v[j : j + 200_000]
            d = exact(asked.x[some[a]], x[b])
            keep = d <= asked.limit[some[a]]
            order = np.lexsort((ids[b][keep], d[keep], a[keep]))
            a, b, d = a[keep][order], b[keep][order], d[keep][order]
            starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
            rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
            top = rank < asked.k
            out[0].append(asked.ids[some[a[top]]])
            out[1].append(ids[b[top]])
            out[2].append(d[top])
    return tuple(np.concatenate(o) if o else np.zeros(0) for o in out)


def _search(model, shared, radius: np.ndarray, first: bool):
    """Over rows sorted by (cell, block): what the queries find there, in their first cells or in all others that come near enough."""

    def block(ivf: Ivf, asked: Asked, rows: pa.Table):
        cell = rows.column("cell")[0].as_py()
        centroid = ivf.centroids[cell]
        who = asked.first_of(cell)
        if not first:
            low = np.sqrt(squares(_clipped(asked.x), centroid[None, :])[:, 0]) - radius[cell]
            size = np.sqrt((_clipped(asked.x) ** 2).sum(1)) + np.sqrt((centroid**2).sum())
            near = low <= asked.limit + 1e-7 * size  # what rounding may take
            near[who] = False
            who = np.flatnonzero(near)
        if not len(who):
            return
        ids = rows.column("vec_id").to_numpy()
        code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        q, v, d = search_block(ivf, asked, who, centroid, ids, _matrix(rows.column("v")), code, rows.column("error").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "vec_id", "score"])

    def run(batches):
        ivf, asked, at, waiting = model.value, shared.value, None, []
        for b in batches:
            if not len(b):
                continue
            cell, part = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "block"))
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(b)]
            for start, end in zip(cuts, cuts[1:]):
                name = (cell[start], part[start])
                if at is not None and name != at:
                    yield from block(ivf, asked, pa.Table.from_batches(waiting))
                    waiting = []
                at = name
                waiting.append(b.slice(start, end - start))
        if waiting:
            yield from block(ivf, asked, pa.Table.from_batches(waiting))

    return run


def search(base: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by Euclidean distance, ties to the smaller vec_id.

    Every usable vector of ``base`` is indexed (see ``usable``), in the precision it
    has; a query never finds its own id.  Vectors and ids that repeat together count
    once; an id with several vectors asks with each of them.  Cells grow in number
    with the square root of the vectors, up to MAX_CELLS.  The driver collects the
    fitting sample, the cells' sizes and radii, a block of queries at a time and
    their k-th distances.  Without a usable vector or query there are no rows.
    """
    spark = base.sparkSession
    rows = usable(base, vec_id, vector)
    asked = cut(usable(queries, vec_id, vector))
    n, n_asked = rows.count(), asked.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n or not n_asked:
        return empty
    sample = _clipped(_matrix(rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(SAMPLE).select("v").toArrow().column("v")))
    dim = sample.shape[1]
    if asked.select(F.size("v")).first()[0] != dim:
        return empty
    model = spark.sparkContext.broadcast(Ivf(sample, max(1, min(MAX_CELLS, math.isqrt(n)))))
    kind = rows.schema["v"].dataType.simpleString()
    placed = cut(rows.mapInArrow(_place(model), f"vec_id long, v {kind}, cell int, far double, code binary, error double"))
    n_cells = len(model.value.centroids)
    sizes, radius = np.zeros(n_cells, np.int64), np.zeros(n_cells)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():
        sizes[r.cell], radius[r.cell] = r.n, r.far
    of_cell = F.element_at(F.array(*[F.lit(int(b)) for b in np.maximum(1, -(-sizes // BLOCK_ROWS))]), F.col("cell") + 1)
    held = placed.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), of_cell).cast("int"))
    held = cut(held.repartition("cell", "block").sortWithinPartitions("cell", "block").select("vec_id", "v", "cell", "block", "code", "error"))
    found, out = None, "query_id long, vec_id long, score double"
    n_blocks = math.ceil(n_asked * dim / QUERY_NUMBERS)
    for i in range(n_blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)) == i).toArrow()
        if not len(part):
            continue
        block = Asked(part.column("vec_id").to_numpy(), _matrix(part.column("v")), k, model.value, sizes)
        first = cut(held.mapInArrow(_search(model, spark.sparkContext.broadcast(block), radius, True), out))
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy("score"))
        last = first.withColumn("nth", nth).where(F.col("nth") == k).select("query_id", "score").toPandas()
        if len(set(block.ids.tolist())) == len(block.ids):  # an id with several vectors has no one limit
            place = {q: j for j, q in enumerate(block.ids.tolist())}
            block.limit[[place[q] for q in last.query_id]] = last.score
        rest = held.mapInArrow(_search(model, spark.sparkContext.broadcast(block), radius, False), out)
        found = first.unionAll(rest) if found is None else found.unionAll(first).unionAll(rest)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark, sf_dir: str) -> DataFrame:
    """The vectors of ``embeddings`` whose id is divisible by 100, against all others."""
    base = table(spark, sf_dir, "embeddings")
    return search(base, base.where(F.col("vec_id") % 100 == 0))
