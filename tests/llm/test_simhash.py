import random

import numpy as np
import xxhash

from quern.llm import simhash
from quern.llm.simhash import allocate, components, fingerprint, group_bits, keep_one, link_bucket, near_duplicates, near_links, plan


def brute_components(fps, tau=4):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= tau:
                root[find(a)] = find(b)
    return {f: frozenset(g for g in fps if find(g) == find(f)) for f in fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint():
    words = "A b C d E f".split()
    hs = [xxhash.xxh64_intdigest(" ".join(w.lower() for w in words[i : i + 4]), 42) for i in range(3)]
    assert fingerprint("A b\tC  d E\nf") == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > 3)
    assert fingerprint("X y") == xxhash.xxh64_intdigest("x y", 42)
    assert fingerprint(None) == fingerprint("") == fingerprint(" \n") == 0


def test_pigeonhole_thresholds():
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for n in (10, 10_000, 10_000_000, 10**10):
        parts = plan(sample, n)
        bits = [b for _, p in parts for b in p]
        assert len(bits) == len(set(bits))
    cost, ts = allocate([[0.1, 0.2, 0.3, 0.4, 0.5]] * 3, [22, 21, 21], 1000, 4)
    assert sum(ts) == 4 - 3 + 1 and min(ts) >= -1
    groups = group_bits(np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), 5)
    assert sorted(b for g in groups for b in g) == list(range(64))


def test_links_against_brute_force(spark):
    rnd = random.Random(3)
    fps = [rnd.getrandbits(64) for _ in range(300)]
    for f in list(fps[:60]):  # chains of near ones, and a dense group
        for _ in range(4):
            f ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 5)))
            fps.append(f)
    fps += [fps[0] ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(200)] + [0, 0, 1, (1 << 64) - 1]
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    expected = brute_components(fps)
    roots = {r.node: r.root for r in components(near_links(df)).collect()}
    for f, group in expected.items():
        assert {roots.get(signed(g), signed(g)) for g in group} == {min(map(signed, group))}
    edges = link_bucket(np.array(sorted(set(fps)), np.uint64), np.ones(len(set(fps)), bool))
    assert len(edges) == len(expected) - len(set(expected.values()))


def test_split_buckets_and_joined_keys(spark, monkeypatch):
    rnd = random.Random(4)
    base = rnd.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rnd.sample(range(64), 2)) for _ in range(150)} | {rnd.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(signed(f),) for f in sorted(fps)], "fp long")
    want = sorted((r.node, r.root) for r in components(near_links(df)).collect())
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 7)
    assert sorted((r.node, r.root) for r in components(near_links(df)).collect()) == want
    monkeypatch.setattr(simhash, "HOT_BUCKETS", 0)
    assert sorted((r.node, r.root) for r in components(near_links(df)).collect()) == want
    docs = spark.createDataFrame([(i, f"w{i % 40} x{i % 40} y z v u") for i in range(300)], "doc_id long, text string")
    once = sorted(r.doc_id for r in keep_one(docs).collect())
    monkeypatch.setattr(simhash, "BITMAPS", 0)
    assert once == sorted(r.doc_id for r in keep_one(docs).collect()) and once == sorted({r.component_id for r in near_duplicates(docs).collect()})


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(1000, 1100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path + star + [(5, 5)], "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(101, 141)) and all(got[i] == 7 for i in range(1000, 1100)) and 5 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark, odd):
    got = near_duplicates(odd).collect()
    assert len(got) == odd.count()
    of = {}
    for r in got:
        of.setdefault(r.doc_id, set()).add(r.component_id)
    assert of[1] == of[5] == {1} and of[2] == of[3] == of[4] == {2} and of[7] == {7} and of[None] == {None}
    kept = keep_one(odd)
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.collect())
    assert [i for _, i in ids] == [1, 2, 6, 7, 8, 9, None] and kept.columns == odd.columns
    assert near_duplicates(odd.limit(0)).count() == 0 and keep_one(odd.limit(0)).count() == 0


def test_keep_one_keeps_a_document_of_each_group(spark):
    fruit, tools = "apple pear plum cherry grape melon fig", "hammer saw drill wrench pliers chisel rasp"
    birds, fish = "robin wren finch crow heron swift owl", "trout pike carp perch eel cod sole"
    rows = [(1, fruit), (1, tools), (2, fruit), (None, birds), (None, birds), (None, fish), (None, tools), (3, fish + " ray"), (1, fruit)]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, kept)) == sorted(
        f"Row(doc_id={i}, text={t!r})" for i, t in [(1, fruit), (1, tools), (None, birds), (None, fish), (3, fish + " ray")]
    )
