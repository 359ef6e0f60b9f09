"""Operator 1 against the tokenizers library and on edge cases."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linkloom.llm.bpe import ByteBPE
from linkloom.llm.token_counts import count_tokens

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return ByteBPE(PATH)


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_random_texts(library, own, text):
    assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", " " * 3000, "ab" * 20000, "it's 'LL don't", "\r\n\r\n x"])
def test_edges(library, own, text):
    assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_query_on_awkward_rows(spark, library):
    rows = [(1, "Hello wörld", "x"), (1, "Hello wörld", "x"), (2, None, "y"), (3, "", None), (None, "word " * 600, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = count_tokens(docs, PATH, 512).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert count_tokens(docs.limit(0), PATH, 512).count() == 0
