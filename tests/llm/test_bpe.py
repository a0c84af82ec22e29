import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.bpe import Codec, load_ranks, merge_ids

RANKS = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
OURS = Codec(RANKS, public_tokenizers.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert OURS.encode(text).tolist() == THEIRS.encode_ordinary(text)
    assert OURS.decode(OURS.encode(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab cth'e\n\t\x1c\x85\xa0 éñ12!|", max_size=120))
def test_dense_text(text):
    assert OURS.encode(text).tolist() == THEIRS.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 5_000, " " * 9_999, "then" * 3_000 + "x", "<|endoftext|>", "", "é" * 7_777])
def test_long_pre_tokens(text):
    assert OURS.encode(text).tolist() == THEIRS.encode_ordinary(text)


def test_null_and_single_token():
    assert OURS.encode(None).tolist() == []
    assert merge_ids(b"the", RANKS) == [RANKS[b"the"]]
