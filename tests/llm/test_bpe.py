"""Encoding and decoding against the tokenizers library."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe

SPECIAL = ["", " ", "a", "aaaaaaaaa", "<|endoftext|>x <|endoftext|>", "à 日本語 😀😀  \n\n x\t\ty  ", "'s'tISN'T don't we'll", "0123456 ÀÉ", "\x00\x01 \xa0  a", "ab" * 5000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("text", SPECIAL)
def test_special_texts(library, text):
    ids = bpe.automaton().encode(text).tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert bpe.automaton().decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_random_texts(text):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")) if not hasattr(test_random_texts, "t") else test_random_texts.t
    test_random_texts.t = library
    ids = bpe.automaton().encode(text).tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert bpe.automaton().decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_prefixes_are_paths():
    """Each prefix of a word's path is the path of that prefix: the automaton is deterministic."""
    machine = bpe.automaton()
    ids = machine.path(" internationalization".encode())
    for k in range(1, len(ids)):
        assert machine.path(b"".join(machine.label[i] for i in ids[:k])) == ids[:k]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 10)
    machine = bpe.automaton()
    machine.rest()
    words = [f" word{k}" for k in range(100)]
    first = [machine.encode(w).tolist() for w in words]
    assert [machine.encode(w).tolist() for w in words] == first
    assert len(machine.words) <= 10
    machine.rest()


def test_frames(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "same text", "x"), (3, "same text", "x"), (None, "no id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    out = bpe.decode(bpe.encode(df), ids="token_ids_").collect()
    assert [(r["doc_id"], r["decoded"]) for r in out] == [(1, ""), (2, ""), (3, "same text"), (3, "same text"), (None, "no id")]
    assert out[2]["token_ids_"] == library.encode("same text").ids
    assert bpe.encode(df.limit(0)).count() == 0


def test_query(spark, tmp_path, library):
    spark.createDataFrame([(k, t) for k, t in enumerate([*SPECIAL, None])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in bpe.op3_bpe(spark, str(tmp_path)).collect():
        text = [*SPECIAL, None][r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
