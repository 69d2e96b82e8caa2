import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from latticevec.llm import bpe
from latticevec.llm.queries import QUERIES, VOCABULARY


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def codec():
    with open(VOCABULARY, encoding="utf-8") as f:
        return bpe.Codec(f.read(), leaf=16)  # so that short texts already take the tree


CASES = ["", " ", "a", "hello world", "a" * 5000, "ab" * 3000, "é" * 2000, "x1" * 900, "aaab" * 700 + "<|endoftext|>" + "z" * 99, " \n\n" + "q" * 300, "!" * 700, "12345678901234567890" * 40, "漢字" * 300, "I'm " + "don't" * 80, "\x00\x01" * 200, "the" * 400 + "\n\n" + "ing" * 400]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_cases(codec, library, k):
    ids = codec.encode(CASES[k])
    assert ids == library.encode(CASES[k], add_special_tokens=False).ids
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False) == CASES[k]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcthein 's\n\u00e9\u6f22 0!<|endoftx>", max_size=200), st.integers(1, 30))
def test_tree_equals_the_library(codec, library, text, repeat):
    whole = text * repeat
    assert codec.encode(whole) == library.encode(whole, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=120), st.binary(max_size=120))
def test_join(codec, left, right):
    token = codec.base.decode_single_token_bytes
    assert bpe.join(codec.piece(left) if left else [], codec.piece(right) if right else [], codec.piece, token) == (codec.piece(left + right) if left + right else [])


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" + "\n" * 1_100_000 + "b", "a b " + " \n\t" * 400_000 + "c d"])
def test_long_runs_of_white_space(codec, library, text):
    assert not codec.short_runs(text)
    assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_special_tokens_as_ordinary_text_in_long_texts(codec, library):
    text = " " * 5000 + "<|endoftext|>" + "z" * 5000
    library.encode_special_tokens = True
    try:
        assert codec.encode(text, special=False) == library.encode(text, add_special_tokens=False).ids
    finally:
        library.encode_special_tokens = False


def test_decode_of_broken_bytes(codec, library):
    for ids in ([255], [227, 130], [50256, 13], list(range(200, 260))):
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    got = QUERIES["op5_bpe"](spark, sf_dir).toPandas().set_index("doc_id")
    for doc_id, text in zip(docs.doc_id, docs.text, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        row = got.loc[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows_and_round_trip(odd_docs, no_docs):
    out = bpe.round_trip(odd_docs, VOCABULARY)
    assert out.count() == odd_docs.count() and out.where("doc_id = 1").first()["n_tokens"] == 0
    texts = {(r["doc_id"], r["text"] or "") for r in odd_docs.collect()}
    back = bpe.decode_documents(bpe.encode_documents(odd_docs, VOCABULARY), VOCABULARY)
    assert {(r["doc_id"], r["text"]) for r in back.collect()} == texts
    assert bpe.round_trip(no_docs, VOCABULARY).count() == 0
