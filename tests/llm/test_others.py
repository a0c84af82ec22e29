import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import bpe, chatformat, ivfpq, licenses, urlrules
from quern.llm.common import id_hash


def frame_rows(df, *columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))


# -- URL rules ------------------------------------------------------------------------

URLS = [
    None, "", "no scheme/org/", "http://org/", "http://example.org/es/x", "http://EXAMPLE.org/en/12?q#f", "https://a.b.example.com/fr/", "http://com/de/x",
    "http://x.com/de", "http://notexample.org/es/", "http://casino-win.net/", "http://Casino.net", "http://casinos.net/", "http://h?casino", "://", "a://b://c/d",
    "http://free.bets.net/x#free-bets", "http://x.example.com/de/1", "http://x.example.com/de/1",
]


def test_urls_against_plain_matching(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("token", F.lit("x"))
    got = {r.u: r for r in urlrules.judge_urls(df, urlrules.SITES + urlrules.WORDS).collect()}
    import re

    for u in {u or "" for u in URLS}:
        rest = u.partition("://")[2] if "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        low = host.lower()
        fits = []
        for r in urlrules.SITES:
            h, _, p = r.name.partition("/")
            if (low == h or low.endswith("." + h)) and path.startswith("/" + p):
                fits.append((-len(r.name), r.name, r.verdict))
        r = got[u]
        assert (r.host, r.path) == (low, path)
        assert (r.rule, r.site_verdict) == (min(fits)[1:] if fits else (None, None))
        assert r.matched == sorted(w.name for w in urlrules.WORDS if re.search(w.regex, u.lower()))
    assert urlrules.judge_urls(df.limit(0), urlrules.SITES).count() == 0


def test_rules_without_literals_and_rarest(spark):
    rules = [urlrules.Rule("any", "block", "url", "^ftp"), urlrules.word_rule("block", "a", "b")]
    df = spark.createDataFrame([("ftp://x",), ("http://a.b",), ("http://a",)], "url string")
    assert {r.u: r.matched for r in urlrules.judge_urls(df, rules).collect()} == {"ftp://x": ["any"], "http://a.b": ["a-b"], "http://a": []}


def test_literals_are_tokens_of_every_match():
    low, both = urlrules.LOWER + urlrules.DIGITS, urlrules.UPPER + urlrules.LOWER + urlrules.DIGITS
    for regex, inside, want in [
        (urlrules.site_rule("x", "example.org/es/").regex, both, ["example", "org", "es"]),
        (urlrules.site_rule("x", "example.org/en/1").regex, both, ["example", "org", "en"]),
        (urlrules.word_rule("x", "casino", "win").regex, low, ["casino", "win"]),
        ("^ftp", low, []), ("/ads?/", low, []), ("/ads/(?:big|small)/x1/", low, ["ads", "x1"]), ("[^a-z0-9]cat[^a-z]", low, []),
        ("/a+b/cd/", low, ["cd"]), ("/(ef)/gh$", low, ["ef", "gh"]), ("x(?:y-)?z/", low, []), ("/(?:y-)?z/", low, ["z"]), ("a|/b/", low, []),
    ]:
        assert urlrules.literals_of(regex, inside) == want, regex
    import re

    rng = np.random.default_rng(12)
    rules = [r.regex for r in urlrules.WORDS] + ["/ads/(?:big|small)/x1/", "/(?:y-)?z/", "[^a-z0-9]free[^a-z0-9]+bets$"]
    pieces = ["casino", "win", "free", "bets", "/", "-", ".", "ads", "big", "x1", "y", "z", "porn", "s"]
    for _ in range(2000):
        text = "".join(rng.choice(pieces, rng.integers(1, 9)))
        held = set(re.split("[^a-z0-9]+", text))
        for regex in rules:
            if re.search(regex, text):
                assert held.issuperset(urlrules.literals_of(regex, low))


# -- vectors --------------------------------------------------------------------------


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[100:350] = x[100]  # a hot vector
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [math.nan] * 8, 1), (1003, [1.0] * 3, 1), (1004, [math.inf] + [1.0] * 7, 1), (None, [1.0] * 8, 1)]
    rows += [rows[3], (1005, [None] + [1.0] * 7, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int")
    got = ivfpq.search(df, df.where("vec_id % 100 = 0")).collect()
    hits = []
    for q in range(0, 700, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        order = [int(i) for i in np.lexsort((np.arange(700), d)) if i != q][:10]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(s == pytest.approx(d[v], abs=1e-12) for _, v, s in mine)
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        hits.append(len(set(order) & {m[1] for m in mine}) / 10)
    assert {r.query_id for r in got} == set(range(0, 700, 100)) and np.mean(hits) >= 0.9


def test_search_keeps_doubles(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.000000001, 2.0]), (2, [1e300, 1.0]), (3, [-1e300, 1.0]), (4, [1.0, 2.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in ivfpq.search(df, df).collect()}
    assert len(got) == 20
    assert got[0, 1] == abs(1.0 - 1.000000001) and got[2, 3] == 2e300 and got[0, 4] == 0.5
    assert got[0, 2] == pytest.approx(1e300)


def test_search_in_blocks_of_queries_and_on_clusters(spark, monkeypatch):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(20, 6)) * 100
    x = (centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 6))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = {}
    for q in range(0, 2000, 50):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want[q] = [int(i) for i in np.lexsort((np.arange(2000), d)) if i != q][:10]
    monkeypatch.setattr(ivfpq, "QUERY_NUMBERS", 60)
    got = {}
    for r in sorted(ivfpq.search(df, df.where("vec_id % 50 = 0")).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want
    # cells that come near enough are few where vectors are clustered
    ivf = ivfpq.Ivf(x.astype(float), 44)
    at, far = ivfpq.nearest(x.astype(float), ivf.centroids)
    sizes, radius = np.bincount(at, minlength=44), np.array([far[at == c].max(initial=0) for c in range(44)])
    q = x[::50].astype(float)
    limit = np.array([np.sort(np.sqrt(((x - x[i]) ** 2).sum(1)))[10] for i in range(0, 2000, 50)])
    probed = (np.sqrt(ivfpq.squares(q, ivf.centroids)) - radius <= limit[:, None]) @ sizes
    assert probed.mean() < 0.25 * 2000


def test_search_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (100, [1.0, 2.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert frame_rows(ivfpq.search(df, df.where("vec_id = 0")), "rank", "vec_id") == ["(1, 100)", "(2, 3)"]
    assert ivfpq.search(df.limit(0), df).count() == 0 and ivfpq.search(df, df.limit(0)).count() == 0
    assert ivfpq.search(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


def test_blocks_of_a_cell(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    once = frame_rows(ivfpq.search(df, df.where("vec_id % 100 = 0")), "query_id", "rank", "vec_id")
    monkeypatch.setattr(ivfpq, "BLOCK_ROWS", 7)
    assert frame_rows(ivfpq.search(df, df.where("vec_id % 100 = 0")), "query_id", "rank", "vec_id") == once


def test_search_for_more_than_are_reranked_by_default(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([np.ones((300, 4)), rng.normal(size=(100, 4)) + 9]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted(ivfpq.search(df, df.where("vec_id = 0"), k=250).collect(), key=lambda r: r["rank"])
    assert len(got) == 250 and all(0 < r.vec_id < 300 and r.score == 0.0 for r in got)


# -- chat -----------------------------------------------------------------------------


def test_chat_against_sql_and_odd_rows(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"w{t if c % 3 else t + c}") for c in range(12) for t in range(c % 5 + 1)]
    rows += [(1, 0, "user", "w0"), (20, 0, None, None), (21, 0, None, None), (21, None, "assistant", ""), (20, 1, "assistant", "a" * 9000), (30, 0, "user", "alone"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("x"))
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = chatformat.op9_chat_format(spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    theirs = c.sql(chatformat.ORACLE_SQL)
    assert frame_rows(got, *theirs.columns) == sorted(map(repr, theirs.fetchall()))
    pair = got.where("pair_id = 10").first()
    assert pair.prompt == "<|unknown|>\n<|end|>\n" and pair.prompt_turns == 1
    for side, mask in ((pair.chosen, pair.chosen_mask), (pair.rejected, pair.rejected_mask)):
        a, b = map(int, mask.split("-"))
        assert side[:a].endswith("<|assistant|>\n") and side[b - 8 : b] == "<|end|>\n"


def test_chat_ids_beyond_doubles(spark, tmp_path):
    ids = [2**54 + i for i in range(6)] + [-2, -1, -3]
    spark.createDataFrame([(i, 0, "user", str(i)) for i in ids], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.pair_id: (r.chosen, r.rejected) for r in chatformat.op9_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == {2**53, 2**53 + 1, 2**53 + 2, -1, -2} and all(str(2 * k) in got[k][0] and str(2 * k + 1) in got[k][1] for k in got if k != -2)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert {r[0] for r in c.sql(f"SELECT pair_id FROM ({chatformat.ORACLE_SQL})").fetchall()} == set(got)


def test_chat_empty(spark):
    df = spark.createDataFrame([], "pair_id long, side string, turn long, role string, text string")
    assert chatformat.preference_pairs(df).count() == 0


# -- licences -------------------------------------------------------------------------


def brute_licence(texts):
    import re

    vocab = {t for _, b in licenses.TEMPLATES for t in licenses.words(b)}
    lines = [w for t in texts for line in (t or "").split("\n") if (w := [x for x in licenses.words(line)])]
    df = Counter(t for w in lines for t in set(w) if t in vocab)
    idf = lambda t: math.log((1 + len(lines)) / (1 + df.get(t, 0))) + 1
    out = []
    for text in texts:
        best = None
        for unit in [*(text or "").split("\n"), *re.split(licenses.BLANK, text or ""), text or ""]:
            w = Counter(licenses.words(unit))
            if not w:
                continue
            norm = math.sqrt(sum((n * idf(t)) ** 2 for t, n in w.items()))
            for name, body in licenses.TEMPLATES:
                v = {t: n * idf(t) for t, n in Counter(licenses.words(body)).items()}
                dot = sum(w[t] * idf(t) * x for t, x in v.items()) / (norm * math.sqrt(sum(x * x for x in v.values())))
                if round(dot, 9) >= licenses.THRESHOLD and (best is None or (round(dot, 9), name) > best):
                    best = (round(dot, 9), name)
        out.append(best)
    return out


MIT = next(b for n, b in licenses.TEMPLATES if n == "MIT" and "hereby" in b)


def wrapped(text, width=70):
    import textwrap

    return "\n".join(textwrap.wrap(text, width))


def test_licences_against_brute_force_and_inheritance(spark):
    files = [
        ("LICENSE", "Released under the MIT License."), ("a/x.py", "code here\nand there"), ("a/LICENSE", "Licensed under the Apache License, Version 2.0.\n"),
        ("a/b/c/y.py", "text of a program\n# licensed under the gnu general public license version 3\nmore\nlines\nof it"), ("a/b/c/z.py", "no word of it"),
        ("d/e.py", None), ("d/f.py", ""), (None, "the public domain"), ("a/b/c/z.py", "no word of it"), ("a/big.txt", "word " * 50_000), ("g/a", "the license of the work"),
        ("h/LICENSE.md", "MIT License\n\nCopyright (c) 2021 Some Body\n\n" + wrapped(MIT[12:])), ("h/i/j.c", "int main"),
        ("k/COPYING", "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\nPreamble and so on\nwith\nmany\nmore\nlines"), ("k/l.c", "int l"),
        ("m/n.c", "/* " + wrapped(licenses._gnu("GNU Lesser General Public License", "2.1")).replace("\n", "\n * ") + " */\n\nint n;\n" + "int o;\n" * 300),
    ]
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "i int, path string, text string").withColumns({c: F.lit(0) for c in ("dir", "own", "m", "lines")})
    got = sorted(licenses.scan_licenses(df, keep=("i",)).collect(), key=lambda r: r.i)
    for r, best in zip(got, brute_licence([t for _, t in files]), strict=True):
        assert (r.own_score, r.own_license) == (best or (None, None))
    at = {r.i: (r.license, r.origin, r.from_dir) for r in got}
    assert at[1] == ("Apache-2.0", "inherited", "a") and at[4] == at[8] == ("Apache-2.0", "inherited", "a")
    assert at[3] == ("GPL", "own", None) and at[5] == at[6] == at[7] == ("MIT", "inherited", "")
    assert at[11] == ("MIT", "own", None) and at[12] == ("MIT", "inherited", "h")
    assert at[13] == ("GPL", "own", None) and at[14] == ("GPL", "inherited", "k") and at[15] == ("LGPL", "own", None)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_long_lines_cost_in_proportion(spark):
    line = "licensed mit license " + " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([("a", line), ("b", MIT + " " + line)], "path string, text string")
    assert [r.own_license for r in licenses.scan_licenses(df).collect()] == [None, None]


# -- tokens ---------------------------------------------------------------------------


def test_encoding_odd_rows(spark, odd):
    got = bpe.digests(odd)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == odd.count() and rows[2].n_tokens == rows[3].n_tokens == 0 and rows[6].n_tokens > 30_000
    long = odd.where("doc_id = 6").select(F.sha2("text", 256).alias("h")).first().h
    assert rows[6].decoded_sha256 == long
    assert bpe.digests(odd.limit(0)).count() == 0


def test_id_hash(spark):
    from zlib import crc32

    got = spark.createDataFrame([(5,), (None,)], "doc_id long").select(id_hash("doc_id").alias("h")).collect()
    assert [r.h for r in got] == [crc32(b"5"), 0]
