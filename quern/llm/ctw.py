"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each with a tree of its own over the bytes
before it, nearest first, of depth DEPTH.  A node's two counts give its
Krichevsky-Trofimov probability; the weighted probability of a node is half of
that plus half of the product of its children's.  The same weights mix the
estimates of all depths on a context's path into the probability of a bit; a
node that training never met gives a half, as its two counts of zero say.

Where a partition of texts is read, its texts are cut into blocks of about
BLOCK_BYTES.  A block's texts and its distinct contexts with their next byte
(grams) and distinct words, with training counts, go into a table; texts are not
shuffled to be counted.  Grams and words are packed by the part of the key space
they are in.  The trees are weighted where the grams of a three-byte context
meet, and the code length of each gram goes back to the blocks that hold it.
Nothing that grows with the corpus is broadcast: only the trees' nodes of depth
two or less are, and there are 2**24 of those at most, of 12 bytes.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import id_hash, small_batches, table, text_bytes, written

#: Bytes of context; a gram of DEPTH + 1 bytes and a document's place in a chunk (PLACE bits) have to fit in a long.
DEPTH, PLACE = 5, 16
BLOCK_BYTES = 16 << 20
#: Bytes of text for each part of the key space.
PART_BYTES = 24 << 20
#: Grams whose trees are weighted at a time (more, if they share a three-byte context), and that wait to be merged.
SLICE, WAITING = 1 << 18, 1 << 22
#: The token that ends a text; no word has white space.
END = b"\n"
GRAMS, TOKENS, TEXTS = 0, 1, 2


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of gamma for x > 0: Stirling's series after a shift by 8."""
    x = np.asarray(x, np.float64)
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9) - shift


def log_kt_of(n0, n1):
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - math.log(math.pi)


_SMALL = 64
_TABLE = log_kt_of(*np.meshgrid(np.arange(_SMALL), np.arange(_SMALL), indexing="ij")).ravel()
_TABLE[0] = 0.0


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones (whole numbers)."""
    small = (n0 < _SMALL) & (n1 < _SMALL)
    out = _TABLE[np.where(small, n0 * _SMALL + n1, 0).astype(np.int64)]
    large = np.flatnonzero(~small)
    out[large] = log_kt_of(n0[large], n1[large])
    return out


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all texts in order, each text ended by byte 0, and the number of grams of each text.

    A gram holds, from the top, the DEPTH bytes before (nearest first) and the byte itself.
    """
    pad = bytes(DEPTH)
    x = np.frombuffer(b"".join(part for t in texts for part in (pad, t, b"\0")), np.uint8).astype(np.int64)
    n = np.array([len(t) + 1 for t in texts], np.int64)
    key = x.copy()
    for d in range(1, DEPTH + 1):
        key[d:] |= x[:-d] << (8 * (DEPTH + 1 - d))
    keep = np.ones(len(x), bool)
    ends = np.cumsum(n)
    for d in range(DEPTH):
        keep[ends - n + DEPTH * np.arange(len(texts)) + d] = False
    return key[keep], n


def starts_of(key: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys start."""
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)


def sum_by(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = starts_of(key)
    return key[first], *(np.add.reduceat(v[order], first) if len(key) else v for v in values)


class Trees:
    """The trees below depth 2 over sorted distinct grams and their training counts (0: not met there).

    The grams have to hold all of their three-byte contexts.  A level has its
    distinct grams (context of that depth, byte); the node of bit j of a byte is
    the run of grams that share context and the byte's first j bits, so no node is
    ever looked up.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.gram, count = gram, n.astype(np.float64)
        self.down: dict[int, np.ndarray] = {}  # gram of a level -> its gram one level up
        self.nodes: dict[tuple[int, int], tuple] = {}  # (depth, bit) -> node of each gram, first grams, zeros, ones
        self.own: dict[tuple[int, int], np.ndarray] = {}  # share of a node's own estimate in its weight
        inner: list = [None] * 8
        for depth in range(DEPTH, 1, -1):
            for j in range(8):
                key = gram >> (8 - j)
                first = starts_of(key)
                node = np.zeros(len(gram), np.int32)
                node[first[1:]] = 1
                node = np.cumsum(node, dtype=np.int32)
                ones = (gram >> (7 - j) & 1).astype(np.float64) * count
                o = np.add.reduceat(ones, first)
                z = np.add.reduceat(count, first) - o
                self.nodes[depth, j] = node, first, z, o
                if depth < DEPTH:
                    below = self.nodes[depth + 1, j][1]
                    inner[j] = np.bincount(node[self.down[depth + 1][below]], inner[j], len(first))
                if depth > 2:
                    kt = log_kt(z, o)
                    lw = kt if depth == DEPTH else np.logaddexp(kt, inner[j]) - math.log(2)
                    self.own[depth, j] = np.ones(len(kt)) if depth == DEPTH else np.exp(np.minimum(0, kt - math.log(2) - lw))
                    inner[j] = lw
            if depth > 2:
                key = (gram >> 16 << 8 | gram & 255) << 22 | np.arange(len(gram)) if len(gram) < 1 << 22 else None
                if key is None:
                    key = gram >> 16 << 8 | gram & 255
                    order = np.argsort(key, kind="stable")
                    key = key[order]
                else:
                    key.sort()
                    order, key = key & ((1 << 22) - 1), key >> 22
                first = starts_of(key)
                at = np.zeros(len(key), np.int32)
                at[first[1:]] = 1
                up = np.empty(len(key), np.int32)
                up[order] = np.cumsum(at, dtype=np.int32)
                self.down[depth] = up
                count = np.bincount(up, count, len(first))
                gram = key[first]
        self.gram2, self.inner2 = gram, inner

    def keys2(self, j: int) -> np.ndarray:
        """Keys of the depth-2 nodes of bit j: context, then place in the byte."""
        g = self.gram2[self.nodes[2, j][1]]
        return g >> 8 << 8 | (1 << j | (g & 255) >> (8 - j))

    def roots(self) -> tuple[np.ndarray, ...]:
        """(key, zeros, ones, sum of the children's log weights) of the depth-2 nodes, as far as they are met here."""
        parts = [(self.keys2(j), *self.nodes[2, j][2:], self.inner2[j]) for j in range(8)]
        k, z, o, lw = map(np.concatenate, zip(*parts))
        met = z + o > 0
        return k[met], z[met], o[met], lw[met]

    def log10(self, top: Top) -> np.ndarray:
        """log10 probability of each gram's byte in its context."""
        total = np.zeros(len(self.gram))
        for j in range(8):
            one, rest = top.at(self.keys2(j))  # probability of a one from the depths so far, and the weight of the others
            for depth in range(3, DEPTH + 1):
                _, first, z, o = self.nodes[depth, j]
                above = self.nodes[depth - 1, j][0][self.down[depth][first]]
                share = rest[above] * self.own[depth, j]
                one = one[above] + share * ((o + 0.5) / (z + o + 1))
                rest = rest[above] - share
            node = self.nodes[DEPTH, j][0]
            bit = self.gram >> (7 - j) & 1
            total += np.log10(np.where(bit == 1, one[node], 1 - one[node]))
        return total


def up(key: np.ndarray) -> np.ndarray:
    """The node for the same bit with one byte of context less."""
    return key >> 16 << 8 | key & 255


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(wanted.shape, np.int64), np.zeros(wanted.shape, bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Top:
    """Nodes of depth 2 to 0: for each the probability of a one from the depths down to it, and the weight left below.

    What is left after the last node that was met gives a half.
    """

    def __init__(self, k2, z2, o2, inner2):
        order = np.argsort(k2)
        k, z, o, inner = k2[order], z2[order], o2[order], inner2[order]
        levels = []
        for depth in (2, 1, 0):
            kt = log_kt(z, o)
            lw = np.logaddexp(kt, inner) - math.log(2)
            levels.append((k, np.exp(np.minimum(0, kt - math.log(2) - lw)), (o + 0.5) / (z + o + 1)))
            if depth:
                k, z, o, inner = sum_by(up(k), z, o, lw)
        self.levels = []
        one = rest = keys = None
        for key, share, kt in reversed(levels):
            if keys is None:
                a, w = np.zeros(len(key)), np.ones(len(key))
            else:
                at, _ = find(keys, up(key))
                a, w = one[at], rest[at]
            keys, one, rest = key, a + w * share * kt, w * (1 - share)
            self.levels.append((key.astype(np.int32), one.astype(np.float32), rest.astype(np.float32)))

    def at(self, key2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of a one so far, weight left) for nodes of depth 2."""
        one, rest = np.full(len(key2), 0.5), np.zeros(len(key2))
        for depth, (keys, a, w) in enumerate(self.levels):
            key = key2
            for _ in range(2 - depth):
                key = up(key)
            at, met = find(keys, key.astype(np.int32))
            if depth < 2:
                one[met] = a[at[met]] + 0.5 * w[at[met]]
            else:
                one[met], rest[met] = a[at[met]], w[at[met]]
        return one, rest


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, lowest bytes of all first."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=0))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(data, n, np.int64))


#: task and block: where the texts were read; part: of the key space; a: keys (sorted grams, words, texts); b: their values
_PACKED = "task int, block int, part int, kind int, n int, size long, a binary, b binary"
_NAMES = [c.split()[0] for c in _PACKED.split(", ")]
_KINDS = [pa.int32()] * 5 + [pa.int64()] + [pa.binary()] * 2


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=_NAMES)


def part_of(gram: np.ndarray, parts: int) -> np.ndarray:
    """The part in which the grams of a three-byte context meet."""
    x = (gram >> 8 * (DEPTH - 2)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)


def _unpack_tokens(r: dict) -> tuple[list[bytes], np.ndarray]:
    text = pa.decompress(r["a"], r["size"], codec="zstd", asbytes=True)
    return text.split(b" "), unpack(r["b"], r["n"], np.int64)


def _chunks(texts: list[bytes], most: int = 2 << 20):
    """Runs of texts of about ``most`` bytes and at most 2 ** PLACE texts, as index ranges."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i + 1 - start == 1 << PLACE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _merged(gram: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return sum_by(gram, count) if len(gram) else (gram, count)


def count_block(texts: list[bytes], train: np.ndarray, parts: int) -> list[tuple]:
    """(part, kind, n, size, a, b) of the distinct grams and distinct tokens of texts, with their training counts."""
    keys = []
    for a, b in _chunks(texts):
        g, n = grams_of(texts[a:b])
        g = g << 1 | np.repeat(train[a:b].astype(np.int64), n)
        g.sort()
        keys.append(g)
    key = np.concatenate(keys)
    keys.clear()
    key.sort()
    learnt = np.cumsum(key & 1)
    key >>= 1
    first = starts_of(key)
    ends = np.append(first[1:], len(key)) - 1
    count = np.diff(learnt[ends], prepend=0)
    gram = key[first]
    del key, learnt
    part = part_of(gram, parts)
    order = np.argsort(part, kind="stable")
    gram, count, part = gram[order], count[order], part[order].astype(np.int64)
    cuts = starts_of(part)
    rows = [
        (int(part[i]), GRAMS, int(j - i), 0, pack_sorted(gram[i:j]), pack(count[i:j])) for i, j in zip(cuts, [*cuts[1:], len(gram)])
    ]
    words: Counter = Counter({END: int(train.sum())})
    other: set[bytes] = set()
    for a, b in _chunks(texts):
        words.update(b" ".join([t for t, known in zip(texts[a:b], train[a:b]) if known]).lower().split())
        other.update(b" ".join([t for t, known in zip(texts[a:b], train[a:b]) if not known]).lower().split())
    of_part: dict[int, list[bytes]] = {}
    for w in words.keys() | other:
        of_part.setdefault(crc32(w) % parts, []).append(w)
    for p, ws in of_part.items():
        ws.sort()
        text = b" ".join(ws)
        c = np.array([words.get(w, 0) for w in ws], np.int64)
        rows.append((p, TOKENS, len(ws), len(text), pa.compress(text, codec="zstd", asbytes=True), pack(c)))
    return rows


def _blocks(parts: int, block_bytes: int):
    """Cut what a task reads (doc_id, text, train) into blocks, and count each."""

    def flush(task: int, block: int, ids: list[pa.Array], texts: list[bytes], train: np.ndarray):
        about = pa.table({"doc_id": pa.chunked_array(ids), "train": pa.array(train), "n": pa.array([len(t) for t in texts], pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, about.schema) as out:
            out.write_table(about)
        whole = b"".join(texts)
        packed = pa.compress(whole, codec="zstd", asbytes=True)
        yield _packed([(task, block, -1, TEXTS, len(texts), len(whole), packed, sink.getvalue().to_pybytes())])
        for row in count_block(texts, train, parts):
            yield _packed([(task, block, *row)])

    def run(batches):
        task, block, size = TaskContext.get().partitionId(), 0, 0
        ids, texts, train = [], [], []
        for batch in batches:
            start = 0
            for i, t in enumerate(batch.column(1).to_pylist()):
                raw = text_bytes(t)
                texts.append(raw)
                size += len(raw) + 100
                if size >= block_bytes:
                    ids.append(batch.column(0).slice(start, i + 1 - start))
                    train.append(batch.column(2).slice(start, i + 1 - start).to_numpy(zero_copy_only=False))
                    yield from flush(task, block, ids, texts, np.concatenate(train).astype(bool))
                    ids, texts, train = [], [], []
                    block, size, start = block + 1, 0, i + 1
            if start < len(batch):
                ids.append(batch.column(0).slice(start))
                train.append(batch.column(2).slice(start).to_numpy(zero_copy_only=False))
        if texts:
            yield from flush(task, block, ids, texts, np.concatenate(train).astype(bool))

    return run


def _meet(rows) -> tuple[np.ndarray, np.ndarray, Counter]:
    """Distinct grams with their training counts, and the tokens' training counts, of all packed rows of a part.

    Grams are merged whenever WAITING of them have gathered: only distinct ones are held.
    """
    none = np.zeros(0, np.int64)
    grams, counts, waiting, total = [none], [none], 0, Counter()
    for r in rows:
        if r["kind"] == TOKENS:
            tokens, c = _unpack_tokens(r)
            for w, x in zip(tokens, c.tolist()):
                total[w] += x
        else:
            grams.append(unpack_sorted(r["a"], r["n"]))
            counts.append(unpack(r["b"], r["n"], np.int64))
            waiting += r["n"]
            if waiting > WAITING:
                g, c = _merged(np.concatenate(grams), np.concatenate(counts))
                grams, counts, waiting = [g], [c], 0
    return *_merged(np.concatenate(grams), np.concatenate(counts)), total


def _slices(gram: np.ndarray):
    """Ranges of about SLICE grams that end where a three-byte context ends."""
    ends = np.append(starts_of(gram >> 8 * (DEPTH - 2))[1:], len(gram)) if len(gram) else []
    start = 0
    for end in ends:
        if end - start >= SLICE or end == len(gram):
            yield start, int(end)
            start = int(end)


def _roots(batches):
    """Nodes of depth 2 as far as they are known here; under the key -1 the training tokens and how many differ."""
    gram, n, total = _meet(r for b in batches for r in b.to_pylist())
    met = n > 0
    gram, n = gram[met], n[met]
    c = np.array([x for x in total.values() if x], np.float64)
    for a, b in _slices(gram):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in Trees(gram[a:b], n[a:b]).roots()], names=["k", "z", "o", "lw"])
    last = (np.array([-1]), np.array([c.sum()]), np.array([float(len(c))]), np.zeros(1))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], names=["k", "z", "o", "lw"])


def _answers(top):
    """For every packed row: the same keys with their log10 probabilities, or training counts."""

    def run(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        gram, n, total = _meet(rows)
        p = np.zeros(len(gram), np.float32)
        for a, b in _slices(gram):
            p[a:b] = Trees(gram[a:b], n[a:b]).log10(top.value)
        for r in rows:
            if r["kind"] == GRAMS:
                r["b"] = pack(p[np.searchsorted(gram, unpack_sorted(r["a"], r["n"]))])
            else:
                r["b"] = pack(np.array([total[w] for w in _unpack_tokens(r)[0]], np.int64))
            yield _packed([tuple(r[c] for c in _NAMES)])

    return run


def score_block(found: list[dict], texts: list[bytes], low: float) -> tuple[np.ndarray, ...]:
    """(score, tokens, known tokens, base score) of each text, by what came back for the grams and tokens of its block."""
    keys, values, place, seen = [], [], {}, [np.zeros(0, np.int64)]
    for r in found:
        if r["kind"] == GRAMS:
            keys.append(unpack_sorted(r["a"], r["n"]))
            values.append(unpack(r["b"], r["n"], np.float32))
        else:
            tokens, c = _unpack_tokens(r)
            place.update(zip(tokens, range(len(place), len(place) + len(tokens))))
            seen.append(c)
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key)
    key, value = key[order], value[order].astype(np.float64)
    seen = np.concatenate(seen)
    base = np.log10((seen + 0.1) / low)
    out = tuple(np.zeros(len(texts)) for _ in range(4))
    for a, b in _chunks(texts):
        g, n = grams_of(texts[a:b])
        g = g.astype(np.uint64) << np.uint64(PLACE) | np.repeat(np.arange(b - a, dtype=np.uint64), n)
        g.sort()
        doc = (g & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        g = (g >> np.uint64(PLACE)).astype(np.int64)
        first = starts_of(g)
        p = np.repeat(value[np.searchsorted(key, g[first])], np.diff(np.append(first, len(g))))
        out[0][a:b] = np.bincount(doc, p, b - a)
        words = [t.lower().split() for t in texts[a:b]]
        n = np.array([len(w) + 1 for w in words])
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(w + [END] for w in words)), np.int64, int(n.sum()))
        doc = np.repeat(np.arange(b - a), n)
        out[1][a:b] = n
        out[2][a:b] = np.bincount(doc, seen[at] > 0, b - a)
        out[3][a:b] = np.bincount(doc, base[at], b - a)
    return out


def _scores(total: int, distinct: int, kind: pa.DataType):
    """Score the documents of the blocks of a task: rows come sorted by block, a block's texts last."""
    low = total + 0.1 * (distinct + 1)

    def run(batches):
        found: list[dict] = []
        for r in (r for b in batches for r in b.to_pylist()):
            if r["kind"] != TEXTS:
                found.append(r)
                continue
            about = pa.ipc.open_stream(r["b"]).read_all()
            whole = pa.decompress(r["a"], r["size"], codec="zstd", asbytes=True)
            n = about.column("n").to_numpy()
            ends = np.cumsum(n).tolist()
            score, tokens, known, base = score_block(found, [whole[e - m : e] for e, m in zip(ends, n.tolist())], low)
            found = []
            yield pa.RecordBatch.from_arrays(
                [
                    about.column("doc_id").combine_chunks().cast(kind),
                    pa.array(~about.column("train").to_numpy()),
                    pa.array(tokens.astype(np.int64)),
                    pa.array(known.astype(np.int64)),
                    pa.array(np.full(len(n), total, np.int64)),
                    pa.array(base),
                    pa.array(score),
                    pa.array(-score / math.log10(2) / (n + 1)),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
            )

    return run


def score_texts(docs: DataFrame, train, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte).

    ``train`` is a boolean Column: rows to learn from (null: not).  ``score`` is
    the log10 probability of the text's bytes as they are and of its end; tokens
    and ``base_score`` are of the text lower-cased (A-Z).  Null texts count as
    empty ones; rows that repeat, and rows with null or equal ids, are scored each
    (and learnt from each); a text longer than a block is a block of its own;
    other columns are ignored; no rows give no rows.  Without any training row
    every bit has probability a half.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(math.ceil(size / PART_BYTES), spark.sparkContext.defaultParallelism)
    counted = written(rows.mapInArrow(_blocks(parts, BLOCK_BYTES), _PACKED), "kind").select(*_NAMES)
    tasks = (counted.agg(F.max("task")).first()[0] or 0) + 1
    met = counted.where(F.col("kind") != TEXTS).repartitionById(parts, F.col("part"))
    tops = met.mapInArrow(_roots, "k long, z double, o double, lw double")
    tops = tops.groupBy("k").agg(*(F.sum(c).alias(c) for c in ("z", "o", "lw"))).toPandas()
    seen, tops = tops[tops.k == -1], tops[tops.k >= 0]
    top = spark.sparkContext.broadcast(Top(tops.k.to_numpy(), tops.z.to_numpy(), tops.o.to_numpy(), tops.lw.to_numpy()))
    found = met.mapInArrow(_answers(top), _PACKED)
    kind = rows.schema["doc_id"].dataType
    back = found.unionByName(counted.where(F.col("kind") == TEXTS)).repartitionById(tasks, F.col("task"))
    from pyspark.sql.pandas.types import to_arrow_type

    return back.sortWithinPartitions("block", "kind").mapInArrow(
        _scores(int(seen.z.sum()), int(seen.o.sum()), to_arrow_type(kind)),
        f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double",
    )


def op2_ctw(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``, learning from those whose crc32(doc_id as text) mod 10 is not 0; see ``score_texts``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, id_hash("doc_id") % 10 != 0)
