"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token's bytes are a linked list.  Each pair of neighbours that has a merge
rank stands in that rank's bucket (its left positions, leftmost first).  Two
levels of bitmaps say which buckets hold anything; the lowest set bit of the
root and of one leaf give the next rank.  Entries whose pair has changed since
are skipped when they are met.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from heapq import heappop, heappush
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import small_batches, table

#: A leaf of the bitmap has 2 ** LEAF bits, the root as many as there are leaves.
LEAF = 9
LOW = (1 << LEAF) - 1
BITS = [1 << i for i in range(1 << LEAF)]
#: Pre-tokens of at most CACHED characters are kept with their ids in a Python worker: the last ones
#: met, in two generations of CACHE.
CACHE, CACHED = 400_000, 48


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_ids(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token; a pre-token that is a token itself is that token."""
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # where the next token starts, and the last one
    pair = [get(piece[i : i + 2]) for i in range(n - 1)]  # rank of a token with its next
    pair.append(None)
    buckets: dict[int, list[int]] = {}
    leaves: dict[int, int] = {}
    root = 0
    for i, r in enumerate(pair):
        if r is not None:
            if r in buckets:
                buckets[r].append(i)  # positions come in order: a heap already
            else:
                buckets[r] = [i]
                word = r >> LEAF
                if word in leaves:
                    leaves[word] |= BITS[r & LOW]
                else:
                    leaves[word] = BITS[r & LOW]
                    root |= 1 << word
    while root:
        word = (root & -root).bit_length() - 1
        leaf = leaves[word]
        rank = (word << LEAF) + (leaf & -leaf).bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket[0]
            del buckets[rank]
            leaf &= leaf - 1
            if leaf:
                leaves[word] = leaf
            else:
                del leaves[word]
                root &= root - 1
        if pair[i] != rank:
            continue  # stale
        gone = after[i]
        end = after[i] = after[gone]
        pair[gone] = None
        fresh = []
        if end < n:
            before[end] = i
            pair[i] = r = get(piece[i : after[end]])
            if r is not None:
                fresh.append((r, i))
        else:
            pair[i] = None
        at = before[i]
        if at >= 0:
            pair[at] = r = get(piece[at:end])
            if r is not None:
                fresh.append((r, at))
        for r, at in fresh:
            if r in buckets:
                heappush(buckets[r], at)
            else:
                buckets[r] = [at]
                word = r >> LEAF
                if word in leaves:
                    leaves[word] |= BITS[r & LOW]
                else:
                    leaves[word] = BITS[r & LOW]
                    root |= 1 << word
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Codec:
    """Encoder and decoder of one vocabulary; single bytes have to be tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        # \s of the pattern is Unicode's White_Space
        spaces = r"\t-\r \x85\xa0  -     　"
        own = pattern.replace(r"[^\s", f"[^{spaces}").replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]")
        self.find = regex.compile(own).findall
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, piece: str) -> bytes:
        """The ids of a pre-token that is not among the young ones, as int32."""
        ids = self.old.get(piece)
        if ids is None:
            ids = np.array(merge_ids(piece.encode("utf-8", "surrogatepass"), self.ranks), np.int32).tobytes()
        if len(piece) <= CACHED:
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        get, ids = self.young.get, self._ids
        return np.frombuffer(b"".join([get(p) or ids(p) for p in self.find(text)]), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


class Vocabulary(NamedTuple):
    """What ``encode`` and ``decode`` take: a name, and ranks (as large as their file) with the pattern, broadcast."""

    name: str
    shared: object


#: The codec that this Python worker made last, by the vocabulary's name: its cache outlives a task.
_LAST: dict[str, Codec] = {}


def codec(spark, path: str, pattern: str) -> Vocabulary:
    return Vocabulary(uuid.uuid4().hex, spark.sparkContext.broadcast((load_ranks(path), pattern)))


def worker_codec(vocabulary: Vocabulary) -> Codec:
    if vocabulary.name not in _LAST:
        _LAST.clear()
        _LAST[vocabulary.name] = Codec(*vocabulary.shared.value)
    return _LAST[vocabulary.name]


def encode(text: Column, vocabulary: Vocabulary) -> Column:
    """array<int> of token ids; null and empty texts give an empty array; special tokens are ordinary text."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = worker_codec(vocabulary)
        for texts in it:
            yield pd.Series([c.encode(t) for t in texts], dtype=object)

    return ids(text)


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The bytes that an array of ids stands for; null gives no bytes."""

    @F.pandas_udf(T.BinaryType())
    def texts(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = worker_codec(vocabulary)
        for batch in it:
            yield pd.Series([b"" if x is None else c.decode(x) for x in batch], dtype=object)

    return texts(ids)


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded), a row for each row of ``docs``."""
    small_batches(docs.sparkSession)
    encoded = docs.select(F.col(doc_id).alias("doc_id"), encode(F.col(text), vocabulary).alias("ids"))
    return encoded.select("doc_id", "ids", decode(F.col("ids"), vocabulary).alias("decoded"))


def _public(spark) -> Vocabulary:
    import public_tokenizers

    return codec(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def digests(docs: DataFrame) -> DataFrame:
    """n_tokens and SHA-256 of the ids and of the decoded bytes, per document."""
    return encode_documents(docs, _public(docs.sparkSession)).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded; a row for each row, no tokens for null and empty texts."""
    return digests(table(spark, sf_dir, "documents"))
