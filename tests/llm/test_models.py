import functools
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import ctw, langid, toxicity


# -- context-tree weighting ---------------------------------------------------------


def brute_ctw(train, text, depth):
    """The root's weighted probability with the next bit over that without it, by the definition of the weights."""
    counts = {}
    for t in train:
        seq = bytes(depth) + t + b"\0"
        for i in range(depth, len(seq)):
            for j in range(8):
                node, bit = 1 << j | seq[i] >> (8 - j), seq[i] >> (7 - j) & 1
                for d in range(depth + 1):
                    counts.setdefault((node, seq[i - d : i]), [0, 0])[bit] += 1
    children = {}
    for node, c in counts:
        if c:
            children.setdefault((node, c[1:]), set()).add((node, c))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @functools.cache
    def weight(node, context):
        if len(context) == depth:
            return kt(*counts[node, context])
        return np.logaddexp(kt(*counts[node, context]), sum(weight(*c) for c in children.get((node, context), ()))) - math.log(2)

    def with_bit(node, context, d, bit):
        """The weight after one more bit in the context of full depth; a node that was never met has no counts and weight one."""
        own = context[depth - d :]
        n = list(counts.get((node, own), (0, 0)))
        n[bit] += 1
        if d == depth:
            return kt(*n)
        path = (node, context[depth - d - 1 :])
        rest = sum(weight(*c) for c in children.get((node, own), ()) if c != path)
        return np.logaddexp(kt(*n), rest + with_bit(node, context, d + 1, bit)) - math.log(2)

    total, seq = 0.0, bytes(depth) + text + b"\0"
    for i in range(depth, len(seq)):
        for j in range(8):
            node, bit = 1 << j | seq[i] >> (8 - j), seq[i] >> (7 - j) & 1
            before = weight(node, b"") if (node, b"") in counts else 0.0
            total += (with_bit(node, seq[i - depth : i], 0, bit) - before) / math.log(10)
    return total


def test_ctw_against_brute_force(spark):
    train = ["abracadabra", "banana band", "the cat", ""]
    rows = [(i, t, True) for i, t in enumerate(train)] + [(10, "a new band", False), (11, None, False), (12, "zzz", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    got = {r.doc_id: r for r in ctw.score_texts(df, F.col("learn")).collect()}
    raw = [t.encode() for t in train]
    for i, t, _ in rows:
        assert got[i].score == pytest.approx(brute_ctw(raw, (t or "").encode(), ctw.DEPTH), rel=1e-6)
    r = got[10]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (4, 2, 9, True)
    v, n = 6, 9
    counts = {"a": 0, "new": 0, "band": 1, "END": 4}
    assert r.base_score == pytest.approx(sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in counts.values()))


def test_ctw_blocks_parts_and_repeats(spark, monkeypatch):
    """Many blocks, parts, slices and merges score as one does, and all of them as the definition says."""
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abc de\u00e9"), rng.integers(0, 60))) for _ in range(120)] + ["ab c"] * 40
    rows = [(7 if i >= 120 else i, t, i % 5 != 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(3)

    def scores():
        found = ctw.score_texts(df, F.col("learn")).collect()
        return sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 4)) for r in found)

    once = scores()
    raw = [t.encode() for _, t, learn in rows if learn]
    for i in (0, 5, 10, 121):
        want = round(brute_ctw(raw, texts[i].encode(), ctw.DEPTH), 4)
        assert any(r[0] == rows[i][0] and r[6] == pytest.approx(want, abs=2e-4) for r in once)
    for name, value in (("BLOCK_BYTES", 700), ("PART_BYTES", 100)):
        monkeypatch.setattr(ctw, name, value)
    many = scores()
    assert [r[:6] for r in many] == [r[:6] for r in once] and np.allclose([r[6] for r in many], [r[6] for r in once], atol=2e-4)


def test_ctw_slices_and_merges(monkeypatch):
    rng = np.random.default_rng(9)
    texts, train = [bytes(rng.choice(list(b"abcd "), 300).tolist()) for _ in range(30)], np.arange(30) % 4 > 0

    def both():
        blocks = [dict(zip(("part", "kind", "n", "size", "a", "b"), r)) for i in (0, 15) for r in ctw.count_block(texts[i : i + 15], train[i : i + 15], 1)]
        gram, n, total = ctw._meet(blocks)
        top = ctw.Top(*ctw.sum_by(*map(np.concatenate, zip(*(ctw.Trees(gram[a:b], n[a:b]).roots() for a, b in ctw._slices(gram))))))
        return gram, n, total, np.concatenate([ctw.Trees(gram[a:b], n[a:b]).log10(top) for a, b in ctw._slices(gram)])

    once = both()
    for name, value in (("SLICE", 20), ("WAITING", 50), ("PLACE", 3)):
        monkeypatch.setattr(ctw, name, value)
    many = both()
    assert (once[0] == many[0]).all() and (once[1] == many[1]).all() and once[2] == many[2] and np.allclose(once[3], many[3])


def test_ctw_odd_rows(spark, odd):
    got = ctw.score_texts(odd, F.col("doc_id") < 6)
    assert got.count() == odd.count() and got.where("score is null or score > 0 or isnan(score)").count() == 0
    assert ctw.score_texts(odd, F.lit(False)).where("n_known > 0").count() == 0
    assert ctw.score_texts(odd.limit(0), F.lit(True)).count() == 0


def test_packing():
    x = np.sort(np.random.default_rng(0).integers(0, 1 << 48, 1000))
    assert (ctw.unpack_sorted(ctw.pack_sorted(x), 1000) == x).all()
    assert np.allclose(ctw.lgamma(np.array([0.5, 1, 2.5, 1e6])), [math.lgamma(v) for v in (0.5, 1, 2.5, 1e6)], rtol=1e-12, atol=1e-12)


# -- conditional random field -------------------------------------------------------


def test_chain_against_enumeration():
    rng = np.random.default_rng(1)
    lens = np.array([6, 1, 5])
    e, trans = rng.normal(size=12), rng.normal(size=(2, 2))
    got = toxicity.marginals(e, lens, trans)[2]
    for start, n in zip(np.cumsum(lens) - lens, lens):
        weight = np.zeros((n, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(e[start + t] * y[t] for t in range(n)) + sum(trans[y[t], y[t + 1]] for t in range(n - 1)))
            for t in range(n):
                weight[t, y[t]] += w
        assert np.allclose(got[start : start + n], np.log(weight[:, 1] / weight[:, 0]))


def test_chain_is_whole_whatever_its_runs():
    rng = np.random.default_rng(2)
    lens = np.array([1000, 64, 65, 1, 3, 128, 700])
    e, trans = rng.normal(size=lens.sum()) * 3, np.array([[1.0, -2], [-3, 2.5]])
    whole = toxicity.chain_odds(e, lens, trans, 1000)
    assert np.allclose(whole, toxicity.chain_odds(e, lens, trans, 64)) and np.allclose(whole, toxicity.chain_odds(e, lens, trans, 7))
    x = None
    for t in range(1000):  # the first text, step by step
        w = math.exp(e[t])
        x = w if x is None else w * (math.exp(trans[0, 1]) + math.exp(trans[1, 1]) * x) / (math.exp(trans[0, 0]) + math.exp(trans[1, 0]) * x)
        assert whole[t] == pytest.approx(x)


def test_chain_gradient():
    """The step of the weights is up the likelihood: training on one text makes its labels likelier than chance."""
    model = toxicity.ToxicCrf()
    index = {"a": 0, "bad": 1, "word": 2, "here": 3}
    model.fit_tokens(index, [np.arange(4), np.array([0, 2])], [np.array([0.0, 1, 1, 0]), np.array([0.0, 0])])
    odds = model.odds(["a bad word here", "a word", "", "word"], toxicity._Weights(model))
    assert (odds[0] > 0).tolist() == [False, True, True, False] and (odds[1] < 0).all() and len(odds[2]) == 0


def toxic_table(spark, n=240):
    rng = np.random.default_rng(2)
    words = ["wor" + chr(97 + i) + chr(97 + j) for i in range(10) for j in range(10)]
    rows, labels = [], []
    for i in range(n):
        text = list(rng.choice(words, 30))
        if i % 4 == 0:
            text[7:9] = ["nasty" + chr(97 + i % 5), "Vile!"]
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out_and_spans(spark):
    docs, labels = toxic_table(spark)
    model = toxicity.train(docs, labels)
    got = docs.join(labels, "doc_id").select("*", toxicity.tag(F.col("text"), model, spark).alias("r")).collect()
    for r in got:
        assert (r.r.score >= toxicity.THRESHOLD) == bool(r.toxic)
        if r.toxic:
            assert "Vile!" in r.text[r.r.spans[0] : r.r.spans[1]]
    assert toxicity.keep_clean(docs, labels).count() == 180


def test_toxicity_odd_rows(spark, odd):
    docs, labels = toxic_table(spark, 80)
    model = toxicity.train(docs, labels)
    scores = odd.select(toxicity.tag(F.col("text"), model, spark).alias("r")).select("r.*").collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    strange = labels.unionAll(spark.createDataFrame([(None, 1), (5, None), (5, 1), (5, 1), (9999, 1)], "doc_id long, toxic int"))
    assert toxicity.train(docs, strange) is not None
    assert toxicity.train(docs, labels.limit(0)) is None and toxicity.train(docs.limit(0), labels) is None
    assert toxicity.keep_clean(odd, labels.limit(0)).count() == odd.count()
    kept = toxicity.keep_clean(odd, labels.unionAll(spark.createDataFrame([(6, 1), (1, 0)], "doc_id long, toxic int")))
    assert kept.schema == odd.schema and kept.where("`dotted.name` <> 'kept' or `__toxic` <> 'kept'").count() == 0


# -- recurrent network --------------------------------------------------------------


def test_gradient():
    rng = np.random.default_rng(0)
    m = langid.BiGru(["a", "b"], hidden=3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, y = rng.integers(97, 102, (5, 4)), np.array([0, 1, 1, 0])
    _, g = m.loss_and_gradient(x, y)
    for k, v in m.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        old, eps = v[at], 1e-5
        v[at] = old + eps
        up, _ = m.loss_and_gradient(x, y)
        v[at] = old - eps
        down, _ = m.loss_and_gradient(x, y)
        v[at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * eps), rel=1e-3)


def plain_sum(m, t):
    """The sum of the distributions at all positions of a text, read whole by the form that training uses."""
    total = np.zeros(len(m.langs))
    x = np.frombuffer(t, np.uint8).astype(int)[:, None]
    f, b = m._run("f", x), m._run("b", x[::-1])
    for s in range(len(x)):
        o = m.p["V"] @ np.concatenate([f[s][5], b[len(x) - 1 - s][5]]) + m.p["c"]
        e = np.exp(o - o.max())
        total += (e / e.sum())[:, 0]
    return total


def test_batched_inference_equals_training_form():
    m = langid.BiGru(["a", "b", "c"], hidden=4)
    texts = [bytes(range(97, 123)) * 20, b"", b"xyz", b"ab" * 128, bytes(range(97, 123)) * 10, b"q" * 257, bytes(range(97, 123)) * 40]
    got = m.documents(texts, m.ready())
    assert got[1].tolist() == [0, 0, 0]
    for row, t in enumerate(texts):
        if t:
            assert np.allclose(got[row], plain_sum(m, t) / len(t), atol=1e-4 if len(t) <= langid.SEGMENT else 5e-3)


def test_pieces_cover_whole_texts():
    for n in (1, 5, 63, 64, 65, 128, 1000):
        pieces = langid.pieces_of(bytes(i % 251 for i in range(n)))
        assert pieces.shape[1] == langid.SPAN and len(pieces) == max(1, -(-n // langid.SPAN))
        assert set(range(min(n, 251))) <= set(pieces.ravel().tolist())


def test_chosen_rows_share_the_room(monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 100)
    rows = [("a", 3, 30), ("a", 1, 30), ("a", 2, 10), ("b", 9, 500), ("b", 8, 400)]
    assert langid.chosen(rows, ["a", "b"]) == [("a", 1), ("a", 2), ("b", 8)]


def test_one_id_for_many_rows_and_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 3)
    for same in (1, 2, 6):  # rows of one id, alike and not; every language is learnt
        rows = [(same, "the same old text", "en")] * 5000 + [(same, f"ein anderer text {i}", "de") for i in range(1500)] + [(None, "le texte", "fr")] * 2000
        model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        assert model.langs == ["de", "en", "fr"]
    rows = [(i, f"text of {i}", f"l{i:03}") for i in range(300)]
    assert len(langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs) == 300


def test_language_held_out_and_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 150)
    rng = np.random.default_rng(4)
    parts = {"en": ["the", "ing", "and", "wh"], "de": ["sch", "ung", "ein", "ß"], "fr": ["eau", "ère", "que", "ou"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k], 2)) for _ in range(20)), k) for i in range(150) for k in [list(parts)[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.trained_on(df)
    got = df.select("lang", langid.predict(F.col("text"), model, spark).alias("p")).collect()
    assert np.mean([r.lang == r.p.lang for r in got]) >= 0.95
    strange = odd.select("doc_id", langid.predict(F.col("text"), model, spark).alias("p")).collect()
    assert len(strange) == odd.count() and {r.doc_id for r in strange if r.p.lang == "und"} == {2, 3, 4, 7}
    assert langid.train(df.limit(0)) is None
    assert odd.select(langid.predict(F.col("text"), None, spark).alias("p")).where("p.lang <> 'und'").count() == 0
    kept = langid.keep_known(df.unionByName(odd.select("doc_id", "text", "lang")))
    assert kept.where("doc_id is null or text = 'a'").count() >= 1 and kept.columns == df.columns


def test_keep_known_without_a_model(spark, odd):
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = langid.keep_known(unlabelled)
    assert kept.columns == unlabelled.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [*((False, i) for i in (1, 5, 6, 8, 9)), (True, None)]


def test_toxicity_workers_keep_little():
    """What a worker's full cache of token weights takes, by the bytes of a token; emptying it changes no odds."""
    import tracemalloc

    model = toxicity.ToxicCrf()
    model.w = np.random.default_rng(0).normal(size=toxicity.WEIGHTS).astype(np.float32)
    words = [f"word{i}" for i in range(5000)]
    cache = toxicity._Weights(model)
    tracemalloc.start()
    model.odds([" ".join(words)], cache)
    a_token = tracemalloc.get_traced_memory()[0] / len(words)
    tracemalloc.stop()
    assert a_token * toxicity.CACHE < 40e6
    kept = np.concatenate(model.odds([" ".join(words)], cache))
    cache.clear()
    cache.rows, cache.ready = cache.rows[:0], cache.ready[:0]
    assert np.array_equal(kept, np.concatenate(model.odds([" ".join(words)], cache)))
