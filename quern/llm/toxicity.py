"""Toxicity by a linear-chain conditional random field over tokens.

Documents have labels, tokens have not.  Of a bounded sample of labelled
documents, the token forms (whole words and word beginnings) that stand in many
toxic and hardly any other documents label the tokens.  A chain of the two
states clean and toxic, one for each whole text, is then trained on those tokens
by gradient ascent on its conditional likelihood; a token's features are its own
forms and the words beside it.  Scoring runs forward and backward over every
token of a text; the marginals give the document's score and the offending
offsets.

The odds of the toxic state pass from token to token by linear fractional maps.
Runs of RUN tokens are composed into one map each, all runs side by side; the
runs of a text are then chained, so that a chain is exact however long it is.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import id_hash, release, small_batches, table

#: The sample takes at most so many toxic and clean labels (of the smallest hashes), and so many characters of their documents.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1500, 3000, 12_000_000
#: Tokens of a run, whose maps are composed side by side with those of other runs; no bound of a chain.
RUN = 64
#: Hashed feature weights; documents of a training step.
WEIGHTS, STEP_DOCS, EPOCHS, RATE, DECAY = 1 << 18, 256, 10, 0.3, 1e-5
#: What labels a token: its form stands in so many toxic documents of the sample, in such a share of them,
#: and at least at so many times the clean rate (log).
SUPPORT, SHARE, LOG_ODDS = 3, 0.01, 3.0
#: Strength of the ridge in the document score.
RIDGE = 0.5
#: Documents are predicted toxic from this score on.
THRESHOLD = 0.3
#: Tokens whose weight a worker keeps.
CACHE = 100_000

_EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_~`/\\"


def word_of(token: str) -> str:
    return token.lower().strip(_EDGES)


def forms(word: str) -> list[str]:
    """The word itself, and its beginnings of 4 to 6 letters."""
    return ["=" + word, *(word[:n] for n in (4, 5, 6) if len(word) >= n)]


def hashed(named: list[str]) -> list[int]:
    return [crc32(x.encode("utf-8", "surrogatepass")) % WEIGHTS for x in named]


def features(token: str) -> tuple[list[int], int, int]:
    """Hashed features: the token's own (forms, ending, shape), and what it is to the token after it and the one before."""
    word = word_of(token)
    shape = ("d" if any(c.isdigit() for c in token) else "") + ("u" if token.isupper() else "") + ("p" if word != token.lower() else "")
    return hashed([*forms(word), "$" + word[-3:], "/" + shape, "bias"]), *hashed(["<" + word, ">" + word])


def runs_of(lens: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of so many tokens, laid end to end: for each run its first token, its tokens, and its place in its text."""
    n = -(-lens // run)
    doc = np.repeat(np.arange(len(lens)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    starts = np.cumsum(lens) - lens
    return starts[doc] + nth * run, np.minimum(run, lens[doc] - nth * run), nth


def chain_odds(e: np.ndarray, lens: np.ndarray, trans: np.ndarray, run: int = RUN) -> np.ndarray:
    """Odds of the toxic state at every token, from it and all tokens before it in its text.

    e are the emissions (log odds) of texts of ``lens`` tokens laid end to end;
    trans (2, 2) are transitions in logs.
    """
    w = np.exp(np.clip(e.astype(np.float64), -30, 30))
    (t00, t01), (t10, t11) = np.exp(trans)
    first, size, nth = runs_of(lens, run)
    out = np.empty(len(w))
    if not len(first):
        return out
    padded = np.concatenate((w, np.ones(run)))
    order = np.argsort(-size, kind="stable")
    first, size, nth = first[order], size[order], nth[order]
    alive = np.searchsorted(-size, -np.arange(run), side="left")  # runs of more than t tokens
    # each run as one map x -> (a x + b) / (c x + d) of the odds before it
    at_start = nth == 0
    a, b, c, d = np.ones(len(first)), np.zeros(len(first)), np.zeros(len(first)), np.ones(len(first))
    for t in range(run if nth.max() else 0):
        n = alive[t]
        if not n:
            break
        v = padded[first[:n] + t]
        a0, b0, c0, d0 = a[:n], b[:n], c[:n], d[:n]
        a1, b1 = v * (t11 * a0 + t01 * c0), v * (t11 * b0 + t01 * d0)
        c1, d1 = t10 * a0 + t00 * c0, t10 * b0 + t00 * d0
        if t == 0:  # the first token of a text: its emission, whatever was before
            a1, b1, c1, d1 = np.where(at_start, 0, a1), np.where(at_start, v, b1), np.where(at_start, 0, c1), np.where(at_start, 1, d1)
        scale = 1 / (a1 + b1 + c1 + d1)
        a[:n], b[:n], c[:n], d[:n] = a1 * scale, b1 * scale, c1 * scale, d1 * scale
    # the odds before each run
    before = np.empty(len(first))
    place = np.empty(len(first), np.int64)
    place[order] = np.arange(len(first))  # runs in the order of the texts -> their place here
    inside = np.flatnonzero(nth[place] == 0)  # the first run of each text, in the order of the texts
    odds = np.ones(len(inside))
    for _ in range(int(nth.max()) + 1):
        here = place[inside]
        before[here] = odds
        odds = (a[here] * odds + b[here]) / (c[here] * odds + d[here])
        more = inside + 1 < len(first)
        more[more] = nth[place[inside[more] + 1]] > 0
        inside, odds = inside[more] + 1, odds[more]
        if not len(inside):
            break
    x = before
    for t in range(run):
        n = alive[t]
        if not n:
            break
        v, y = padded[first[:n] + t], x[:n]
        y = v * (t01 + t11 * y) / (t00 + t10 * y)
        if t == 0:
            y = np.where(at_start, v, y)
        out[first[:n] + t] = x[:n] = y
    return out


def marginals(e: np.ndarray, lens: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward odds, backward odds, marginal log odds) of every token; the first two count the token's emission both."""
    ahead = chain_odds(e, lens, trans)
    back = chain_odds(e[::-1], lens[::-1], trans.T)[::-1]
    return ahead, back, np.log(ahead) + np.log(back) - np.clip(e, -30, 30)


class ToxicCrf:
    def __init__(self):
        self.w = np.zeros(WEIGHTS, np.float32)
        self.trans = np.zeros((2, 2))
        #: document score: logistic of these times ``summary``
        self.doc = np.array([-4.0, 0.0, 0.0, 0.0])

    def fit_tokens(self, index: dict[str, int], ids: list[np.ndarray], labels: list[np.ndarray], seed: int = 3) -> _Weights:
        """AdaGrad on the conditional log likelihood of whole texts (numbers of their tokens, and the label of each); the tokens' weights."""
        rng = np.random.default_rng(seed)
        seen, seen_t, w = np.full(WEIGHTS, 1e-2), np.full((2, 2), 1e-2), np.zeros(WEIGHTS)
        flat, sizes, left, right = (array("i") for _ in range(4))
        for t in index:
            own, a, b = features(t)
            flat.extend(own)
            sizes.append(len(own))
            left.append(a)
            right.append(b)
        flat, sizes, left, right = (np.array(x, np.int32) for x in (flat, sizes, left, right))
        at = np.cumsum(sizes) - sizes
        # a token that says nothing is as likely toxic as any
        y = np.concatenate(labels)
        w[hashed(["bias"])] = np.log((y.sum() + 0.5) / (len(y) + 1))
        for _ in range(EPOCHS):
            order = rng.permutation(len(ids))
            for i in range(0, len(order), STEP_DOCS):
                some = order[i : i + STEP_DOCS]
                x, y = np.concatenate([ids[j] for j in some]), np.concatenate([labels[j] for j in some])
                lens = np.array([len(ids[j]) for j in some])
                kinds, back = np.unique(x, return_inverse=True)
                ends = np.cumsum(sizes[kinds])
                mine = flat[np.repeat(at[kinds] - ends + sizes[kinds], sizes[kinds]) + np.arange(ends[-1])]
                weight = np.add.reduceat(w[mine], ends - sizes[kinds])
                inner = np.ones(len(x), bool)
                inner[np.cumsum(lens) - lens] = False  # tokens with one before them
                has = np.flatnonzero(inner)
                e = weight[back]
                e[has] += w[left[x[has - 1]]]
                e[has - 1] += w[right[x[has]]]
                ahead, behind, odds = marginals(e, lens, self.trans)
                miss = y - 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
                per_kind = np.bincount(back, miss, len(kinds))
                g = np.bincount(mine, np.repeat(per_kind, sizes[kinds]), WEIGHTS)
                g += np.bincount(left[x[has - 1]], miss[has], WEIGHTS) + np.bincount(right[x[has]], miss[has - 1], WEIGHTS)
                g = g / len(some) - DECAY * w
                seen += g * g
                w += RATE * g / np.sqrt(seen)
                # odds of the four transitions between a token and the next
                a, b = ahead[has - 1], behind[has]
                pair = np.exp(self.trans)[:, :, None] * np.stack([np.stack([np.ones(len(a)), b]), np.stack([a, a * b])])
                pair /= pair.sum((0, 1))
                y0, y1 = y[has - 1] > 0, y[has] > 0
                gt = np.array([[((y0 == i) & (y1 == j)).sum() - pair[i, j].sum() for j in (0, 1)] for i in (0, 1)]) / len(some) - 1e-3 * self.trans
                seen_t += gt * gt
                self.trans += RATE * gt / np.sqrt(seen_t)
        self.w = w.astype(np.float32)
        known = _Weights(self)
        known.update(index)
        known.rows = array("d", np.stack((np.add.reduceat(self.w[flat], at), self.w[left], self.w[right]), 1).ravel().astype(float).tolist())
        return known

    def weight(self, token: str) -> tuple[float, float, float]:
        """What a token adds to the log odds of itself, of the token after it and of the one before it."""
        own, left, right = features(token)
        return float(self.w[own].sum()), float(self.w[left]), float(self.w[right])

    def odds(self, texts: list[str], cache: _Weights) -> list[np.ndarray]:
        """Marginal log odds of every token of every text."""
        tokens = [t.split() for t in texts]
        lens = np.array([len(t) for t in tokens], np.int64)
        total = int(lens.sum())
        own, left, right = cache.table(np.fromiter(map(cache.__getitem__, (x for t in tokens for x in t)), np.int64, total))
        e = own
        inner = np.ones(total, bool)
        inner[(np.cumsum(lens) - lens)[lens > 0]] = False
        has = np.flatnonzero(inner)
        e[has] += left[has - 1]
        e[has - 1] += right[has]
        found = marginals(e, lens[lens > 0], self.trans)[2] if total else e
        return np.split(found, np.cumsum(lens)[:-1]) if len(texts) else []

    @staticmethod
    def summary(odds: np.ndarray) -> tuple[float, ...]:
        """Bias, largest log odds, log of 1 + expected toxic tokens, log of 1 + tokens."""
        if not len(odds):
            return 1.0, -12.0, 0.0, 0.0
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        return 1.0, float(np.clip(odds.max(), -12, 12)), float(np.log1p(p.sum())), float(np.log1p(len(odds)))

    def score(self, odds: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.doc, self.summary(odds)), -30, 30))))

    def fit_documents(self, odds: list[np.ndarray], y: np.ndarray) -> None:
        """Logistic regression by Newton's method (steps halved while they lose), held by a ridge to the largest odds and the count."""
        x = np.array([self.summary(o) for o in odds])
        prior = np.array([-1.0, 1.0, 1.0, 0.0])

        def loss(w):
            return (np.logaddexp(0, x @ w) - y * (x @ w)).sum() + RIDGE / 2 * ((w - prior) ** 2).sum()

        w = prior.copy()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
            step, size = np.linalg.solve(h, x.T @ (y - p) - RIDGE * (w - prior)), 1.0
            while size > 1e-6 and loss(w + size * step) > loss(w):
                size /= 2
            w = w + size * step
        self.doc = w


class _Weights(dict):
    """Token -> its row in a table of weights; made when asked for; once CACHE tokens are there, all go before the next texts."""

    def __init__(self, model: ToxicCrf):
        super().__init__()
        self.model = model
        self.rows = array("d")  # three for a token
        self.ready = np.zeros((0, 3))

    def __missing__(self, token: str) -> int:
        self[token] = row = len(self.rows) // 3
        self.rows.extend(self.model.weight(token))
        return row

    def table(self, rows: np.ndarray) -> np.ndarray:
        """(3, tokens) weights of tokens by their rows."""
        if 3 * len(self.ready) < len(self.rows):
            self.ready = np.concatenate((self.ready, np.array(self.rows[3 * len(self.ready) :]).reshape(-1, 3)))
        out = self.ready[rows].T.copy()
        if len(self.rows) >= 3 * CACHE:
            self.clear()
            self.rows, self.ready = array("d"), np.zeros((0, 3))
        return out


def marker_forms(texts: list[str], y: list[int]) -> set[str]:
    """Forms that label a token toxic."""
    count = (Counter(), Counter())
    n = [0, 0]
    for t, label in zip(texts, y):
        n[label] += 1
        count[label].update({f for w in {word_of(x) for x in set(t.split())} if w for f in forms(w)})
    out = set()
    for f, c in count[1].items():
        if c >= max(SUPPORT, SHARE * n[1]):
            odds = np.log((c + 0.5) / (n[1] + 1)) - np.log((count[0][f] + 0.5) / (n[0] + 1))
            if odds >= LOG_ODDS or (c >= n[1] and not count[0][f]):
                out.add(f)
    return out


def train(docs: DataFrame, labels: DataFrame) -> ToxicCrf | None:
    """Fit on the sample; None if it has no document of either kind.

    ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).  Null labels, ids and
    texts are left out; an id with several labels is toxic if one of them is;
    texts that repeat count once.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    known = known.where(id_hash("doc_id") % 4 != 2).select("doc_id", (F.col("y") > 0).cast("int").alias("y"), F.xxhash64("doc_id").alias("h"))
    ids = [
        (r.doc_id, r.y, r.h)
        for y, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))
        for r in known.where(F.col("y") == y).orderBy("h").limit(most).collect()
    ]
    if not ids:
        return None
    spark = docs.sparkSession
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, h long"
    wanted = F.broadcast(spark.createDataFrame(ids, kind))  # SAMPLE_TOXIC + SAMPLE_CLEAN rows at most
    mine = docs.select("doc_id", "text").where("text is not null").join(wanted, "doc_id")
    sizes = mine.groupBy("doc_id", "h").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("c")).collect()
    chosen, total = [], 0
    for r in sorted(sizes, key=lambda r: r.h):
        if total + r.n <= SAMPLE_CHARS:
            total += r.n
            chosen.append((r.doc_id,))
    if not chosen:
        return None
    small = F.broadcast(spark.createDataFrame(chosen, kind.split(",")[0]))
    rows = mine.join(small, "doc_id", "left_semi").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    rows = sorted({(r.text, r.y) for r in rows})
    return train_on([t for t, _ in rows], [y for _, y in rows])


def train_on(texts: list[str], y: list[int]) -> ToxicCrf | None:
    if not 0 < sum(y) < len(y):
        return None
    markers = marker_forms(texts, y)
    model = ToxicCrf()
    index: dict[str, int] = {}
    ids = [np.array([index.setdefault(x, len(index)) for x in t.split()], np.int32) for t in texts]
    marked = np.array([not markers.isdisjoint(forms(word_of(x))) for x in index] or [False])
    told = [(own, (marked[own] & bool(label)).astype(np.float32)) for own, label in zip(ids, y) if len(own)]
    known = model.fit_tokens(index, *map(list, zip(*told))) if told else _Weights(model)
    model.fit_documents(model.odds(texts, known), np.array(y, float))
    return model


def tag(text: Column, model: ToxicCrf | None, spark) -> Column:
    """struct(score, spans): spans are the character offsets [start, end) of runs of toxic tokens, flattened.

    Null and empty texts are scored like texts without tokens.  Without a model
    every score is 0.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<score:double,spans:array<int>>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        cache = _Weights(own)
        for texts in it:
            if own is None:
                yield pd.DataFrame({"score": 0.0, "spans": [[]] * len(texts)})
                continue
            texts = [t or "" for t in texts]
            odds = own.odds(texts, cache)
            yield pd.DataFrame(
                {"score": [own.score(o) for o in odds], "spans": [offsets(t, o) for t, o in zip(texts, odds)]}
            )
            del texts, odds
        del cache
        release()

    return run(text)


def offsets(text: str, odds: np.ndarray) -> list[int]:
    if not (odds > 0).any():
        return []
    out: list[int] = []
    last = -2
    for i, m in enumerate(re.finditer(r"\S+", text)):
        if odds[i] > 0:
            if last == i - 1 and out:
                out[-1] = m.end()
            else:
                out += [m.start(), m.end()]
            last = i
    return out


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, learning from labelled rows whose crc32(doc_id as text) mod 4 is not 2.

    A row for each row; null and empty texts are scored like texts without tokens.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    found = docs.select("doc_id", (id_hash("doc_id") % 4 == 2).alias("held_out"), tag(F.col("text"), model, spark).alias("t"))
    return found.select(
        "doc_id",
        "held_out",
        F.col("t")["score"].alias("score"),
        (F.col("t")["score"] >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents scored under the threshold, with their own columns, whatever those are called.

    Null and empty texts score low and stay; repeated rows are judged each; without
    a model (no labels of either kind) every document stays.
    """
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return docs.where(tag(F.col("text"), model, docs.sparkSession)["score"] < THRESHOLD)
