"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64 bits over word shingles.  The bits are grouped into
partitions of correlated bits.  If the partitions' thresholds t_i (each at least
-1) sum to tau - m + 1, two fingerprints within tau bits differ in at most t_i
bits in some partition i.  The thresholds are allocated by dynamic programming
over estimated costs.  Fingerprints probe the buckets that their partition's
value and its variants of up to t_i flipped bits name; inside a bucket members
are verified against all probes, and only edges that join two classes are
emitted.  A bucket of many rows is split: its members are dealt into blocks, and
every block sees all rows.  Components of the edges are found by alternating star
contraction over nodes that are ordered by their smallest document, so that a
component's root says which document that is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import cut, small_batches, table, text_bytes, unused, written

BITS, TAU, SHINGLE, SEED = 64, 4, 4, 42
#: Distinct fingerprints (those of the smallest hashes) on which costs and bit correlations are estimated.
SAMPLE = 4096
#: What a probe row costs, in verified candidates.
PROBE_COST = 300.0
#: A bucket of more rows is split; so many split buckets are broadcast, more are joined.
BUCKET_ROWS, HOT_BUCKETS = 20_000, 100_000
#: Bitmaps of 4 KB that ``keep_one`` broadcasts (64 MB), for 32,768 rows each; more rows are joined.
BITMAPS = 16_384


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of all word shingles, repeats included; no words give zero."""
    words = text_bytes(text).lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), shingle
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist())), np.uint64, n
    )
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


@F.pandas_udf(T.LongType())
def _fingerprints(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in it:
        yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of equal width; each takes, one by one, the free bit most correlated with those it has."""
    x = bits.astype(np.float64) - bits.mean(0)
    norm = np.sqrt((x * x).sum(0))
    norm[norm == 0] = 1
    corr = np.abs((x / norm).T @ (x / norm))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for p in range(m):
        width = BITS // m + (p < BITS % m)
        first = max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))
        part = [first]
        free.discard(first)
        while len(part) < width:
            best = max(free, key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            free.discard(best)
        out.append(sorted(part))
    return out


def candidate_rates(bits: np.ndarray, part: list[int], tau: int) -> list[float]:
    """Estimated chance that two fingerprints differ in at most 0..tau bits of a partition.

    The larger of the rate among sampled pairs and of what the bits' shares give if they were independent.
    """
    share = bits[:, part].mean(0) if len(bits) else np.full(len(part), 0.5)
    differ = 2 * share * (1 - share)
    dist = np.zeros(tau + 1)
    dist[0] = 1
    for p in differ:
        dist[1:] = dist[1:] * (1 - p) + dist[:-1] * p
        dist[0] *= 1 - p
    free = np.cumsum(dist)
    sample = bits[:512, part].astype(np.int32)
    if len(sample) < 2:
        return free.tolist()
    d = (sample[:, None, :] != sample[None, :, :]).sum(2)
    seen = np.bincount(d.ravel(), minlength=tau + 1)[: tau + 1]
    seen[0] -= len(sample)
    return np.maximum(free, np.cumsum(seen) / (len(sample) * (len(sample) - 1))).tolist()


def allocate(rates: list[list[float]], widths: list[int], n: int, tau: int) -> tuple[float, list[int]]:
    """Thresholds of least cost with sum tau - m + 1, by dynamic programming over partitions and sums."""
    m = len(widths)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(m):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, ts) in best.items():
            for t in range(-1, tau + 1):
                probes = sum(comb(widths[i], k) for k in range(t + 1)) + (t > 0)
                c = cost + (n * probes * PROBE_COST + float(n) * n * rates[i][t] if t >= 0 else 0.0)
                if total + t not in nxt or c < nxt[total + t][0]:
                    nxt[total + t] = (c, [*ts, t])
        best = nxt
    return best[tau - m + 1]


def plan(sample: np.ndarray, n: int, tau: int = TAU) -> list[tuple[int, list[int]]]:
    """[(threshold, bits)] of the partitions used, for the number of partitions of least estimated cost."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    options = []
    for m in range(1, tau + 2):
        parts = group_bits(bits, m)
        cost, ts = allocate([candidate_rates(bits, p, tau) for p in parts], [len(p) for p in parts], n, tau)
        options.append((cost, m, [(t, p) for t, p in zip(ts, parts) if t >= 0]))
    return min(options)[2]


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _probe(parts: list[tuple[int, list[int]]]):
    """Rows (part, key, fp, member) of every fingerprint: its own bucket, and those of its variants."""
    flips = [
        np.array([_mask(c) for k in range(t + 1) for c in combinations(bits, k)], np.uint64) for t, bits in parts
    ]
    masks = [np.uint64(_mask(bits)) for _, bits in parts]

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, (mask, flip) in enumerate(zip(masks, flips)):
                for at in range(0, len(fp), max(1, 200_000 // len(flip))):
                    some = fp[at : at + max(1, 200_000 // len(flip))]
                    keys = ((some & mask)[:, None] ^ flip[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(keys), i, np.int32)),
                            pa.array(keys.view(np.int64)),
                            pa.array(np.repeat(some, len(flip)).view(np.int64)),
                            pa.array(np.tile(np.arange(len(flip)) == 0, len(some))),
                        ],
                        names=["part", "key", "fp", "member"],
                    )

    return run


def link_bucket(fp: np.ndarray, member: np.ndarray, tau: int = TAU) -> list[tuple[int, int]]:
    """Edges that span the classes of a bucket: a member and any probe within tau bits are linked.

    Every member is compared with all rows, 4M pairs at a time; of the links
    found only those that join two classes become edges, at most one less than rows.
    """
    root = np.arange(len(fp))
    edges: list[tuple[int, int]] = []
    who = np.flatnonzero(member)
    for m0 in range(0, len(who), max(1, 4_000_000 // len(fp))):
        rows = who[m0 : m0 + max(1, 4_000_000 // len(fp))]
        near = np.bitwise_count(fp[rows][:, None] ^ fp[None, :]) <= tau
        for a, hit in zip(rows, near):
            if hit.sum() > 1:
                for r in np.unique(root[hit]):
                    if r != root[a]:
                        b = np.flatnonzero(hit & (root == r))[0]
                        edges.append((int(fp[a]), int(fp[b])))
                        root[root == r] = root[a]
    return edges


def _verify(tau: int):
    """Over rows (part, key, block, fp, member) sorted by the first three: the edges of each bucket, which may go on over batches."""

    def edges_of(part):
        if len(part) == 0:
            return []
        key, fp, member = part[:, 0], part[:, 1], part[:, 2].astype(bool)  # of one part and block
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        out = []
        for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))):
            if b - a > 1 and member[a:b].any():
                # a bucket holds a fingerprint once: as a member, or as a probe
                out += link_bucket(fp[a:b], member[a:b], tau)
        return out

    def batch_of(edges):
        a = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

    def run(batches):
        waiting: list[np.ndarray] = []
        at = None
        for batch in batches:
            if not len(batch):
                continue
            part, key, block, fp, member = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            rows = np.stack([key.view(np.uint64), fp.view(np.uint64), member.astype(np.uint64)], axis=1)
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            # whole buckets of one part and block go together; the last bucket of a batch waits for the next batch
            bounds = np.concatenate(([0], cuts, [len(rows)]))
            name = (part[0], key[0], block[0])
            if at is not None and name != at:
                if edges := edges_of(np.concatenate(waiting)):
                    yield batch_of(edges)
                waiting = []
            if len(cuts):
                first = np.concatenate([*waiting, rows[: cuts[0]]])
                edges, waiting = edges_of(first), []
                for a, b in zip(bounds[1:-1], bounds[2:-1]):
                    if b - a > 1:
                        edges += edges_of(rows[a:b])
                if edges:
                    yield batch_of(edges)
            waiting.append(rows[bounds[-2] :])
            at = (part[-1], key[-1], block[-1])
        if waiting and (edges := edges_of(np.concatenate(waiting))):
            yield batch_of(edges)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the components of ``edges`` (a, b), by alternating large-star and small-star steps; a root is its smallest node.

    A step is one window over the directed edges of a node; the edges never grow,
    and each round is checkpointed.  Ends when a round changes nothing.
    """
    edges = cut(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = (
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(small.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        edges = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_links(fps: DataFrame, tau: int = TAU, fp: str = "fp") -> DataFrame:
    """Edges (a, b) among the distinct fingerprints whose components equal those of all links within tau bits."""
    spark = fps.sparkSession
    distinct = cut(fps.select(F.col(fp).alias("fp")).where("fp is not null").distinct())
    n = distinct.count()
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    rows = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    parts = plan(np.array([r.fp for r in rows], np.int64).view(np.uint64), n, tau)
    probes = distinct.mapInArrow(_probe(parts), "part int, key long, fp long, member boolean")
    hot = cut(probes.groupBy("part", "key").count().where(F.col("count") > BUCKET_ROWS))
    n_hot = hot.count()
    block = F.lit(0).alias("block")
    if n_hot:
        blocks = hot.select("part", "key", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("blocks"))
        probes = probes.join(F.broadcast(blocks) if n_hot <= HOT_BUCKETS else blocks, ["part", "key"], "left")
        probes = probes.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))) == F.col("block")
        probes, block = probes.withColumn("member", F.col("member") & own), F.col("block")
    return (
        probes.select("part", "key", block, "fp", "member")
        .repartition("part", "key", "block")
        .sortWithinPartitions("part", "key", "block")
        .mapInArrow(_verify(tau), "a long, b long")
    )


def _least(prints: DataFrame, tau: int, *more: str) -> DataFrame:
    """(fp, least, root) of every distinct fingerprint of ``prints`` (doc_id, fp, more).

    least is the struct (none, id, fp, more) of its smallest document, null ids last; root that of its component.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "fp", *more))
    least = cut(prints.groupBy("fp").agg(first.alias("least")))
    edges = near_links(least, tau)
    for end in "ab":
        edges = edges.join(least.select(F.col("fp").alias(end), F.col("least").alias(f"of_{end}")), end)
    roots = components(edges.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    roots = roots.select(F.col("node")["fp"].alias("fp"), "root")
    return least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "least").alias("root"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tau: int = TAU
) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``.

    component_id is the smallest doc_id that links of tau or fewer differing bits
    reach.  Null and empty texts have fingerprint zero, linked like any other; rows
    that repeat an id are kept; a null id never is a component's smallest unless
    all its ids are null; no rows give no rows.  Texts are read whole, however long;
    only fingerprints are shuffled, never texts.
    """
    small_batches(docs.sparkSession)
    prints = cut(docs.select(F.col(doc_id).alias("doc_id"), _fingerprints(F.col(text)).alias("fp")))
    of_fp = _least(prints, tau).select("fp", F.col("root")["id"].alias("component_id"))
    return prints.join(of_fp, "fp", "left").select("doc_id", "fp", "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole text of ``documents``; a row for each row."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group: that with the smallest id.  Columns stay as they are, whatever they are called.

    A group is a component of fingerprints, whatever its ids: groups that share an
    id, or have null ids only, keep a document each.  Of rows that repeat that id
    in the group, one of the smallest fingerprint stays.

    The rows are written once with their fingerprint and a row key.  What to keep is
    decided on narrow rows and comes back as bitmaps of row keys, which are broadcast
    while there are at most BITMAPS of them and joined by the row key beyond, so
    that no key is hot.
    """
    small_batches(docs.sparkSession)
    fp, key = unused(docs, "fp"), unused(docs, "row_key")
    held = written(docs.select("*", _fingerprints(F.col(text)).alias(fp), F.monotonically_increasing_id().alias(key)))
    named = _least(held.select(F.col(doc_id).alias("doc_id"), F.col(fp).alias("fp"), F.col(key).alias("key")), TAU, "key")
    kept = cut(named.where(F.col("root")["fp"] == F.col("fp")).select((F.col("least")["key"] + 1).alias("n")))
    bits = kept.groupBy(F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))
    bits = cut(bits)
    own = [F.col(f"`{c}`") for c in docs.columns]
    if bits.count() > BITMAPS:
        return held.join(kept, F.col(key) + 1 == F.col("n"), "left_semi").select(*own)
    bucket, word = unused(docs, "bucket"), unused(docs, "bits")
    bits = F.broadcast(bits.select(F.col("bucket").alias(bucket), F.col("bits").alias(word)))
    place = F.bitmap_bit_position(F.col(key) + 1)
    byte = F.conv(F.hex(F.substring(F.col(word), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1
    return held.join(bits, F.bitmap_bucket_number(F.col(key) + 1) == F.col(bucket)).where(bit).select(*own)
