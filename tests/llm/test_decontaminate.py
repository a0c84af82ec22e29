import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quern.llm.decontaminate import build_index, drop_contaminated, find_hits, mark_contamination, words_of

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text, items, window):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, hit, ids = WORD.findall(lower), set(), set()
    for i, t in items:
        own = WORD.findall(t or "")
        for a in range(max(1, len(own) - window + 1)) if own else ():
            w = own[a : a + window]
            for b in range(len(words) - len(w) + 1):
                if words[b : b + len(w)] == w:
                    hit.update(range(b, b + len(w)))
                    ids.add(i)
    return len(words), hit, ids


few = st.lists(st.sampled_from("a b c d".split()), max_size=14).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(few, st.lists(few, max_size=4), st.integers(1, 4), st.dictionaries(st.tuples(st.sampled_from([b"a", b"b"]), st.sampled_from([b"a", b"c"])), st.integers(0, 9)))
def test_against_brute_force(text, items, window, counts):
    items = [(str(i), t) for i, t in enumerate(items)]
    spans, ids = find_hits(words_of(text), build_index(items, counts, window))
    n, hit, expected = brute(text, items, window)
    assert {x for a, b in spans for x in range(a, b)} == hit and ids == expected


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(max_size=40))
def test_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    assert [w.decode() for w in words_of(text)] == WORD.findall(lower)


def test_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "Sat on the MAT"), (1, "a"), (None, "cat"), (2, None), (3, ""), (4, "x y")], "item_id long, text string")
    got = mark_contamination(odd, bench).select("doc_id", "contamination.*", "score")
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == odd.count() and rows[1].item_ids == ["1"] and rows[1].n_hit == 5 and rows[2].n_words == 0
    assert rows[9].item_ids == [] or rows[9].item_ids == ["4"]
    assert rows[6].n_words == 30_000 and rows[6].n_hit == 0 and rows[6].score == "kept"
    empty = mark_contamination(odd, bench.limit(0))
    assert empty.where("contamination.n_hit > 0").count() == 0
    assert mark_contamination(odd.limit(0), bench).count() == 0
    left = drop_contaminated(odd, bench)
    assert left.columns == odd.columns and left.where("doc_id in (1, 5, 8)").count() == 0


def test_blocks(spark, odd, monkeypatch):
    from quern.llm import decontaminate

    bench = spark.createDataFrame([(1, "sat on"), (2, "on the mat"), (3, "very long")], "item_id long, text string").coalesce(1)
    once = mark_contamination(odd, bench).select("doc_id", "contamination").collect()
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 2)
    assert sorted(map(repr, mark_contamination(odd, bench).select("doc_id", "contamination").collect())) == sorted(map(repr, once))
