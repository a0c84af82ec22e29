"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` consecutive words (a
shorter item is one window).  A window is a set of word shingles that has to be
contained whole, so its necessary prefix is one shingle: the rarest, by counts
over all documents.  The index maps that shingle to the windows it stands for
and to its place in them.  A document's shingles probe the index; a candidate
must fit between the document's first and last word (length and positional
bounds) and is then compared word by word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, small_batches, table, text_bytes, unused

WINDOW = 13
#: A broadcast block of the benchmark has at most so many words (and so many windows); more items go to further blocks.
BLOCK_WORDS = 1_000_000

_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` as UTF-8."""
    return text_bytes(text).translate(_WORD_BYTES).split()


def windows_of(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def shingles(words) -> list[tuple[bytes, ...]]:
    """Pairs of neighbouring words; a single word is its own shingle."""
    return list(zip(words, words[1:])) if len(words) > 1 else [tuple(words)]


def build_index(items: list[tuple[str, str | None]], counts: dict, window: int = WINDOW) -> tuple[dict, dict, set]:
    """(first word -> second word -> [(place, window words, item ids)], the same for windows of one word, first words)."""
    owners: dict[tuple, set] = {}
    for item, text in items:
        for w in windows_of(words_of(text), window):
            owners.setdefault(w, set()).add(item)
    pairs: dict[bytes, dict[bytes, list]] = {}
    singles: dict[bytes, list] = {}
    for w, ids in owners.items():
        at = min(range(max(1, len(w) - 1)), key=lambda i: (counts.get(w[i : i + 2], 0), w[i : i + 2], i))
        entry = (at, list(w), sorted(ids))
        if len(w) == 1:
            singles.setdefault(w[0], []).append(entry)
        else:
            pairs.setdefault(w[at], {}).setdefault(w[at + 1], []).append(entry)
    return pairs, singles, set(pairs) | set(singles)


def find_hits(words: list[bytes], index: tuple[dict, dict, set]) -> tuple[list[list[int]], set[str]]:
    """Merged [start, end) spans of all window occurrences, and the ids of their items."""
    pairs, singles, heads = index
    if heads.isdisjoint(words):
        return [], set()
    n, spans, items = len(words), [], set()
    for i, word in enumerate(words):
        if word not in heads:
            continue
        found = list(singles.get(word, ()))
        if i + 1 < n and word in pairs:
            found += pairs[word].get(words[i + 1], ())
        for at, w, ids in found:
            start, end = i - at, i - at + len(w)
            if start >= 0 and end <= n and words[start:end] == w:
                spans.append([start, end])
                items.update(ids)
    return merge(spans), items


def merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of at most BLOCK_WORDS words, streamed to the driver (a longer item is a block of its own)."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_id).cast("string"), F.col(text)).where(f"`{item_id}` is not null")
    for row in rows.toLocalIterator():
        n = len(words_of(row[1]))
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield block


def shingle_counts(docs: DataFrame, wanted: set[tuple[bytes, ...]], text: str = "text") -> dict:
    """How often each wanted shingle stands in all documents; a row per wanted shingle at most comes back."""
    spark = docs.sparkSession
    order = sorted(wanted)
    shared = spark.sparkContext.broadcast({w: i for i, w in enumerate(order)})

    def count(batches):
        ids, total = shared.value, Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                words = words_of(t)
                total.update(filter(None.__ne__, map(ids.get, shingles(words))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total.keys()), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["k", "n"]
        )

    part = docs.select(F.col(text).alias("t")).mapInArrow(count, "k long, n long")
    return {order[r.k]: r.n for r in part.groupBy("k").agg(F.sum("n").alias("n")).collect()}


def mark_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    out: str = "contamination",
    window: int = WINDOW,
) -> DataFrame:
    """``docs`` with one more column ``out``: struct(n_words, n_hit, spans, item_ids).

    ``spans`` are the merged [start, end) word ranges inside occurrences of
    benchmark windows, flattened; ``item_ids`` the sorted ids whose windows occur.
    Rows and the other columns are kept as they are; a column named ``out`` is
    replaced.  Null and empty texts have no words and no hits; items that are
    null, empty or without id are ignored; an item id that repeats counts once
    per document.  With an empty benchmark nothing is hit.  No document is
    shuffled.  The benchmark comes in broadcast blocks of BLOCK_WORDS words; for
    each further block the column so far is checkpointed and extended.
    """
    small_batches(docs.sparkSession)
    kind = "struct<n_words:bigint,n_hit:bigint,spans:array<bigint>,item_ids:array<string>>"
    first = True
    for block in _blocks(benchmark, item_id, item_text):
        if not first:
            docs = cut(docs)
        wanted = {s for _, t in block for w in [words_of(t)] if w for s in shingles(w)}
        wanted |= {(w,) for _, t in block for w in words_of(t)[:1] if len(words_of(t)) == 1}
        index = build_index(block, shingle_counts(docs, wanted, text) if wanted else {}, window)
        docs = docs.withColumn(out, _marker(docs, index, kind)(F.col(text), F.lit(None).cast(kind) if first else F.col(out)))
        first = False
    if first:
        docs = docs.withColumn(out, _marker(docs, ({}, {}, set()), kind)(F.col(text), F.lit(None).cast(kind)))
    return docs


def _marker(docs: DataFrame, index, kind: str):
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf(kind)
    def mark(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts, before in it:
            rows = []
            was = before.to_dict("records") if isinstance(before, pd.DataFrame) else [None] * len(texts)
            for t, b in zip(texts, was):
                words = words_of(t)
                spans, items = find_hits(words, own)
                if b and b["spans"] is not None and len(b["spans"]):
                    flat = [int(x) for x in b["spans"]]
                    spans = merge(spans + [list(p) for p in zip(flat[::2], flat[1::2])])
                    items |= set(b["item_ids"])
                rows.append((len(words), sum(e - s for s, e in spans), [x for s in spans for x in s], sorted(items)))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "spans", "item_ids"])

    return mark


def is_contaminated(column: str = "contamination"):
    """At least one hit, and at least a twentieth of the words hit."""
    c = F.col(column)
    return (c["n_hit"] > 0) & (c["n_hit"] * 20 >= c["n_words"])


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents`` against the whole ``benchmark``; a row for each row, without words where the text is null."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_contamination(docs, table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return marked.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["item_ids"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["item_ids"], ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns, whatever those are called."""
    out = unused(docs, "contamination")
    return mark_contamination(docs, benchmark, out=out).where(~is_contaminated(out)).select(*(f"`{c}`" for c in docs.columns))
