import numpy as np
import tiktoken
import public_tokenizers

import corpus_pipeline
from quern.llm import langid
from quern.llm.bpe import load_ranks


def test_pipeline_against_what_was_planted(spark, tmp_path, monkeypatch):
    """Each kind of document that a stage should take out is planted among clean ones of three languages."""
    monkeypatch.setattr(langid, "STEPS", 150)
    rng = np.random.default_rng(8)
    parts = {"en": ["the", "ing", "and", "wh", "st", "on"], "de": ["sch", "ung", "ein", "ß", "ver"], "fr": ["eau", "ère", "que", "ou", "ment"]}
    prose = lambda k, n: " ".join("".join(rng.choice(parts[k], rng.integers(1, 5))) for _ in range(n))
    docs, toxic = [], []
    for i in range(200):
        k = list(parts)[i % 3]
        text = prose(k, 60)
        if i % 8 == 0:
            text = text.replace(" ", " vileword scumbag ", 2)
            toxic.append(i)
        docs.append((i, text, k, "s", len(text)))
    passage = prose("en", 40)
    planted = {
        300: docs[1][1], 301: docs[1][1], 302: None, 303: "12 34 !!", 304: f"{prose('en', 20)} {passage} {prose('en', 10)}", 305: prose("fr", 50),
        306: prose("de", 700) + " " + " ".join(passage.split()[:13]),
    }
    docs += [(i, t, "en", "s", len(t or "")) for i, t in planted.items()]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, kind).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    expected = {i for i in range(200) if i not in toxic} | {305, 306}
    assert set(got) == expected
    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {d[0]: d[1] for d in docs}
    assert all(got[i].n_tokens == len(theirs.encode_ordinary(texts[i])) for i in expected)


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "decontamination", "encoding"]
