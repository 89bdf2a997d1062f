import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings, strategies as st

from quern.llm import bpe


@pytest.fixture(scope="module")
def library():
    codec = bpe.codec(None)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in codec.bytes_of.items()}, special_tokens={})


def ids(text):
    return np.frombuffer(bpe.codec(None).encode([text])[0], dtype="<u4").tolist()


CASES = ["", " ", "\n\n a  b\t\tc \n", "it's we'll I'M don't x's", "日本語 テスト１２ Ⅷ½²", "a" * 5000, "éè 😀 🤷🏽‍♀️", "\x1c\x1d a\x85b　c  ", "<|endoftext|> x", "1234567 12,000.50", "क्षत्रिय नमस्ते", "____ -- == ??!!"]


@pytest.mark.parametrize("text", CASES)
def test_matches_library(library, text):
    assert ids(text) == library.encode_ordinary(text)
    assert bpe.codec(None).decode(bpe.codec(None).encode([text])[0]) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sdabcé1.")), max_size=60))
def test_random_texts(text):
    codec = bpe.codec(None)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in codec.bytes_of.items()}, special_tokens={})
    got = codec.encode([text])[0]
    assert codec.decode(got) == text.encode()
    # Characters newer than this Python's tables may be classed differently; all others must agree.
    if regex.findall(public_tokenizers.PATTERN, text) == [w for u in bpe.patterns()[0].findall(text) for w in bpe.patterns()[1].findall(u)]:
        assert np.frombuffer(got, dtype="<u4").tolist() == own.encode_ordinary(text)


def test_words_where_a_lower_rank_comes_up_late():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 290, b"abcabc": 280, b"ab": 310}
    own = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks | {bytes([200, b]): 320 + b for b in range(1)}, special_tokens={})
    codec = bpe.Codec(ranks)
    for word in ("abcabcabc", "aabcbcabc", "abcab", "bcabcbc"):
        assert np.frombuffer(codec.replay([word.encode()])[0], dtype="<u4").tolist() == own.encode_ordinary(word)


@pytest.mark.parametrize("many", [1, 2, 10**9])
def test_steps_over_many_positions(library, monkeypatch, many):
    monkeypatch.setattr(bpe, "MANY", many)
    codec = bpe.codec(None)
    words = ["banana", "aaaaaaa", "ababababab", "internationalisation", "mississippi", "x", "", "éééé", "ththththe", "  "] * 5
    for word, ids in zip(words, codec.replay([w.encode() for w in words])):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library._encode_single_piece(word) if word else ids == b""


def test_long_text_in_pieces(library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_WORDS", 7)
    text = "the quick  brown\n\nfox jumps " * 40
    assert ids(text) == library.encode_ordinary(text)


def test_query_on_odd_rows(spark, library):
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z"), (None, "ab ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    got = sorted(bpe.digests(docs).collect(), key=str)
    assert len(got) == 5
    for r in got:
        text = next(t or "" for d, t, _ in rows if d == r.doc_id)
        want = np.array(library.encode_ordinary(text), dtype="<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want) // 4, hashlib.sha256(want).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.digests(docs.where("false")).collect() == []
    plan = bpe.digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("run(") <= 2  # one Python pass
    both = bpe.decode(bpe.encode(docs)).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in both)
