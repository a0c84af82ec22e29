"""Language identification by a bidirectional gated recurrent network over bytes.

Every position of a text gets a distribution over the languages from the states
of both directions there, and a document's distribution is the mean over its
positions.  Texts longer than SEGMENT bytes are read in windows that overlap: a
direction starts HALO bytes before the first position that counts, so that no
position lacks its neighbours.  Training is in numpy by backpropagation through
time with Adam, on pieces drawn over the whole texts of a bounded sample of rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import id_hash, small_batches, table, text_bytes

HIDDEN = 8
#: Positions of a window that count, and bytes that a direction reads before them.
SEGMENT, HALO = 256, 32
#: Training takes at most so many documents of each language (those of the smallest hashes; fewer, if there are more than
#: SAMPLE_ROWS / SAMPLE_DOCS languages, but one at least), with at most so many characters in all, shared evenly.
SAMPLE_DOCS, SAMPLE_ROWS, SAMPLE_CHARS = 400, 40_000, 8_000_000
#: Numbers of the largest array that scoring makes.
ROOM = 4_000_000
STEPS, BATCH, SPAN, RATE = 500, 128, 64, 0.02

_CASE = np.arange(256)
_CASE[65:91] += 32


def _tanh_sigmoid(x, out=None):
    """Logistic function of 2x, by tanh (which numpy vectorises)."""
    out = np.tanh(x, out=out)
    out *= 0.5
    out += 0.5
    return out


class BiGru:
    """Parameters per direction: W (3H x 256) for bytes, U (3H x H), b (3H); gates z, r, then the candidate."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        h, k = hidden, len(langs)
        self.langs, self.h = langs, h
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["W" + d] = rng.normal(0, 0.4, (3 * h, 256)).astype(np.float32)
            self.p["U" + d] = rng.normal(0, 0.5 / np.sqrt(h), (3 * h, h)).astype(np.float32)
            self.p["b" + d] = np.zeros((3 * h, 1), np.float32)
        self.p["V"] = rng.normal(0, 0.3, (k, 2 * h)).astype(np.float32)
        self.p["c"] = np.zeros((k, 1), np.float32)

    # -- training -----------------------------------------------------------------

    def _run(self, d: str, x: np.ndarray):
        """States after each step of bytes x (T, N) in reading order, and what backpropagation needs."""
        p, h = self.p, self.h
        s, keep = np.zeros((h, x.shape[1]), np.float32), []
        for t in range(len(x)):
            a = p["W" + d][:, x[t]] + p["b" + d]
            g = _tanh_sigmoid(0.5 * (a[: 2 * h] + p["U" + d][: 2 * h] @ s))
            z, r = g[:h], g[h:]
            rs = r * s
            c = np.tanh(a[2 * h :] + p["U" + d][2 * h :] @ rs)
            new = s + z * (c - s)
            keep.append((s, z, r, rs, c, new))
            s = new
        return keep

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray):
        """Mean cross-entropy over all positions of x (T, N) with one label y (N) a segment, and its gradient."""
        p, h = self.p, self.h
        steps, n = x.shape
        runs = {"f": self._run("f", x), "b": self._run("b", x[::-1])}
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        up = {"f": [None] * steps, "b": [None] * steps}
        loss = 0.0
        for t in range(steps):
            both = np.concatenate([runs["f"][t][5], runs["b"][steps - 1 - t][5]])
            o = p["V"] @ both + p["c"]
            o -= o.max(0)
            e = np.exp(o)
            e /= e.sum(0)
            loss -= np.log(e[y, np.arange(n)] + 1e-9).mean()
            e[y, np.arange(n)] -= 1
            e /= n * steps
            grads["V"] += e @ both.T
            grads["c"] += e.sum(1, keepdims=True)
            back = p["V"].T @ e
            up["f"][t], up["b"][steps - 1 - t] = back[:h], back[h:]
        for d, seq in (("f", x), ("b", x[::-1])):
            u = p["U" + d]
            ds = np.zeros((h, n), np.float32)
            for t in range(steps - 1, -1, -1):
                s, z, r, rs, c, _ = runs[d][t]
                ds = ds + up[d][t]
                dc = ds * z * (1 - c * c)
                dz = ds * (c - s) * z * (1 - z)
                drs = u[2 * h :].T @ dc
                dr = drs * s * r * (1 - r)
                da = np.concatenate([dz, dr, dc])
                grads["U" + d][: 2 * h] += da[: 2 * h] @ s.T
                grads["U" + d][2 * h :] += dc @ rs.T
                grads["b" + d] += da.sum(1, keepdims=True)
                np.add.at(grads["W" + d].T, seq[t], da.T)
                ds = ds * (1 - z) + drs * r + u[: 2 * h].T @ da[: 2 * h]
        return loss / steps, grads

    def fit(self, texts: list[np.ndarray], y: np.ndarray, steps: int = STEPS, seed: int = 11) -> BiGru:
        """Steps of Adam on pieces drawn from texts (each its pieces (n, SPAN)) with a label each; languages and texts are drawn alike."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        pieces, size = np.concatenate(texts), np.array([len(t) for t in texts])
        start = np.cumsum(size) - size
        of = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        for i in range(1, steps + 1):
            pick = np.concatenate([rng.choice(o, max(1, BATCH // len(of))) for o in of])
            own = start[pick] + rng.integers(0, size[pick])
            _, g = self.loss_and_gradient(_CASE[pieces[own]].T, y[pick])
            norm = np.sqrt(sum(float((w * w).sum()) for w in g.values()))
            rate = RATE * min(1.0, 2 * (1 - i / (steps + 1)))
            for k in self.p:
                w = g[k] / max(1.0, norm)
                m[k] += 0.1 * (w - m[k])
                v[k] += 0.01 * (w * w - v[k])
                self.p[k] -= (rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-7)).astype(np.float32)
        return self

    # -- inference ----------------------------------------------------------------

    def ready(self):
        """Parameters for ``sums``: byte tables with bias and case folding, and halves for the tanh form of the gates."""
        h, out = self.h, []
        for d in "fb":
            scale = np.concatenate([np.full(2 * h, 0.5), np.ones(h)]).astype(np.float32)[:, None]
            w = ((self.p["W" + d] + self.p["b" + d]) * scale)[:, _CASE]
            u = self.p["U" + d] * scale
            out.append((np.ascontiguousarray(w), np.ascontiguousarray(u[: 2 * h]), np.ascontiguousarray(u[2 * h :])))
        return out, self.p["V"], self.p["c"]

    def sums(self, x: np.ndarray, ready, mask: np.ndarray | None = None, lead: int = 0, tail: int = 0) -> np.ndarray:
        """Sum over the positions of each window of the position's distribution, (K, N), for x (T, N).

        mask (T, N) says which bytes are there; the others leave the states as they
        are.  The first ``lead`` and the last ``tail`` steps are read, but not counted.
        """
        h, (dirs, v, c) = self.h, ready
        steps, n = x.shape
        logits = np.empty((steps - lead - tail, len(v), n), np.float32)
        logits[:] = c
        for d, (w, ug, uc) in enumerate(dirs):
            vd = np.ascontiguousarray(v[:, d * h : (d + 1) * h])
            s = np.zeros((h, n), np.float32)
            a, g, k, rs = (np.empty((r, n), np.float32) for r in (3 * h, 2 * h, h, h))
            out = np.empty((len(v), n), np.float32)
            for t in range(steps - tail) if d == 0 else range(steps - 1, lead - 1, -1):
                np.take(w, x[t], axis=1, out=a, mode="clip")
                np.matmul(ug, s, out=g)
                g += a[: 2 * h]
                _tanh_sigmoid(g, g)
                np.multiply(g[h:], s, out=rs)
                np.matmul(uc, rs, out=k)
                k += a[2 * h :]
                np.tanh(k, out=k)
                k -= s
                k *= g[:h]
                if mask is not None:
                    k *= mask[t]
                s += k
                if lead <= t < steps - tail:
                    np.matmul(vd, s, out=out)
                    logits[t - lead] += out
        total = np.zeros((len(v), n), np.float32)
        for t in range(len(logits)):
            o = logits[t]
            o -= o.max(0)
            np.exp(o, out=o)
            o /= o.sum(0)
            if mask is not None:
                o *= mask[t + lead]
            total += o
        return total

    def documents(self, texts: list[bytes], ready) -> np.ndarray:
        """Pooled distributions (documents, K): mean over all positions; zero for an empty text."""
        data = np.frombuffer(bytes(HALO) + b"".join(texts) + bytes(SEGMENT + HALO), np.uint8)
        lens = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(lens) - lens + HALO
        out = np.zeros((len(texts), len(self.langs)))

        def add(doc: np.ndarray, at: np.ndarray, halo: int):
            """Windows of the documents from the given places, ``halo`` wider on both sides."""
            wide = max(1, min(2048, ROOM // (SEGMENT * len(self.langs))))
            for i in range(0, len(doc), wide):
                own, a = doc[i : i + wide], at[i : i + wide]
                core = min(SEGMENT, int((lens[own] - a).max()))
                place = a[None, :] + np.arange(-halo, core + halo)[:, None]
                there = (place >= 0) & (place < lens[own][None, :])
                x = data[np.minimum(starts[own] + place, len(data) - 1)]
                mask = None if there.all() else there.astype(np.float32)
                np.add.at(out, own, self.sums(x, ready, mask, halo, halo).T)

        n = np.where(lens > SEGMENT, -(-lens // SEGMENT), 0)
        doc = np.repeat(np.arange(len(texts)), n)
        at = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * SEGMENT
        for full in (True, False):  # windows inside a text, then those at its ends
            some = ((at >= HALO) & (at + SEGMENT + HALO <= lens[doc])) == full
            add(doc[some], at[some], HALO)
        order = np.argsort(lens, kind="stable")
        order = order[(lens[order] > 0) & (lens[order] <= SEGMENT)]
        for part in np.array_split(order, max(1, len(order) // 64)):
            if len(part):
                add(part, np.zeros(len(part), np.int64), 0)
        return out / np.maximum(lens, 1)[:, None]


def pieces_of(text: bytes) -> np.ndarray:
    """The whole text in pieces of SPAN bytes, (n, SPAN); the last one ends where the text does, a shorter text is repeated to fill one."""
    raw = np.frombuffer((text + b" ") * SPAN if len(text) < SPAN else text, np.uint8)
    if len(text) < SPAN:
        raw = raw[:SPAN]
    at = np.append(np.arange(0, len(raw) - SPAN, SPAN), len(raw) - SPAN)
    return raw[at[:, None] + np.arange(SPAN)]


def chosen(sizes: list[tuple], langs: list[str]) -> list[tuple]:
    """Of rows (lang, key, characters) the keys to learn from: by key while they fit the language's share; the shortest, if none does."""
    room = SAMPLE_CHARS // len(langs)
    out = []
    for y in langs:
        own, used, got = sorted(r[1:] for r in sizes if r[0] == y), 0, []
        for k, n in own:
            if used + n <= room:
                used += n
                got.append(k)
        if own and not got:
            got = [min(own, key=lambda r: (r[1], r[0]))[0]]
        out += [(y, k) for k in got]
    return out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> BiGru | None:
    """Fit on a bounded sample: of each language SAMPLE_DOCS documents, by hash of ``key`` and text, within SAMPLE_CHARS.

    Every language that has a usable row is learnt.  Rows without language or
    without a letter are left out, rows that repeat count once; with none left
    there is no model.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("y"), F.xxhash64(key, text).alias("k"))
    rows = rows.where("y is not null and t is not null").where(F.rlike("t", F.lit("\\p{L}")))
    counts = rows.groupBy("y").count().collect()  # a row for each language
    if not counts:
        return None
    langs = sorted(r["y"] for r in counts)
    each = max(1, min(SAMPLE_DOCS, SAMPLE_ROWS // len(langs)))
    sizes: list[tuple] = []
    # first only rows under a bound of the hash, which leaves about twice as many as are kept; where repeated rows make
    # that too few, all rows of the language
    for bounded in (True, False):
        short = [(r["y"], min(1.0, 2.5 * each / r["count"]) if bounded else 1.0) for r in counts]
        if not bounded:
            have = Counter(y for y, _, _ in sizes)
            short = [(r["y"], 1.0) for r in counts if have[r["y"]] < min(each, r["count"]) and 2.5 * each < r["count"]]
            sizes = [r for r in sizes if r[0] not in {y for y, _ in short}]
        if short:
            share = F.broadcast(spark.createDataFrame(short, "y string, share double"))  # a row for each language
            drawn = rows.join(share, "y").where(F.pmod(F.col("k"), F.lit(1_000_003)) < F.col("share") * 1_000_003)
            drawn = drawn.groupBy("y", "k").agg(F.max(F.length("t")).alias("n"))
            nth = F.row_number().over(Window.partitionBy("y").orderBy("k"))
            sizes += [(r.y, r.k, r.n) for r in drawn.withColumn("nth", nth).where(F.col("nth") <= each).collect()]
    wanted = F.broadcast(spark.createDataFrame(chosen(sizes, langs), "y string, k long"))  # SAMPLE_ROWS at most
    texts = rows.join(wanted, ["y", "k"], "left_semi").groupBy("y", "k").agg(F.min("t").alias("t")).collect()
    found = sorted((r.y, r.k, r.t) for r in texts)
    langs = sorted({y for y, _, _ in found})
    return BiGru(langs).fit([pieces_of(text_bytes(t)) for _, _, t in found], np.array([langs.index(y) for y, _, _ in found]))


def predict(text: Column, model: BiGru | None, spark) -> Column:
    """struct(lang, score): ``und`` with score 0 for null, empty and letterless texts, or without a model."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang:string,score:double>")
    def label(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = shared.value
        ready = own and own.ready()
        for texts, letters in it:
            if own is None:
                yield pd.DataFrame({"lang": ["und"] * len(texts), "score": 0.0})
                continue
            raw = [text_bytes(t) if ok else b"" for t, ok in zip(texts, letters)]
            p = own.documents(raw, ready)
            best = p.argmax(1)
            yield pd.DataFrame(
                {
                    "lang": [own.langs[b] if r else "und" for b, r in zip(best, raw)],
                    "score": np.clip(np.where([bool(r) for r in raw], p.max(1), 0.0), 0, 1),
                }
            )

    return label(text, F.coalesce(F.rlike(text, F.lit("\\p{L}")), F.lit(False)))


def trained_on(docs: DataFrame) -> BiGru | None:
    """A model of the documents whose crc32(doc_id as text) mod 5 is not 0."""
    return train(docs.where(id_hash("doc_id") % 5 != 0).select("doc_id", "text", "lang"))


def op7_language(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, learning from labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    A row for each row; null, empty and letterless texts are ``und`` with score 0.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    guess = predict(F.col("text"), trained_on(docs), spark)
    found = docs.select("doc_id", (id_hash("doc_id") % 5 == 0).alias("held_out"), guess.alias("p"))
    return found.select("doc_id", "held_out", F.col("p")["lang"].alias("lang_pred"), F.col("p")["score"].alias("score"))


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents that get a language (those without text or letters go), with their own columns, whatever those are called.

    The score rejects none.  Without a model every text with a letter stays.
    """
    model = trained_on(docs)
    if model is None:
        return docs.where(F.rlike("text", F.lit("\\p{L}")))
    return docs.where(predict(F.col("text"), model, docs.sparkSession)["lang"] != "und")
