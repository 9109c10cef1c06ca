"""Token attribution against the tokenizers library's offsets."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, tokencount

TEXTS = ["One line.\nTwo lines\n\nfour  ", "no break", "", None, "\n\n\n", "é😀日本語\nüñ x\n", " a\n b\n c", "x\n" * 500]


def brute(text, rule):
    """Spans from cumulative decoding lengths, attributed one by one."""
    machine = bpe.automaton()
    lines = tokencount._lines(text or "")
    edges = np.cumsum([0, *map(len, lines)])
    out = np.zeros(len(lines))
    raw, at = (text or "").encode(), 0
    owner = [k for k, c in enumerate(text or "") for _ in c.encode()]
    for i in machine.encode(text).tolist():
        n = len(machine.label[i])
        chars = sorted(set(owner[at:at + n]))
        at += n
        places = [int(np.searchsorted(edges, c, side="right") - 1) for c in chars]
        if rule == "start":
            out[places[0]] += 1
        elif rule == "split":
            for p in places:
                out[p] += 1 / len(places)
        else:
            out[max(set(places), key=lambda p: (places.count(p), -p))] += 1
    assert at == len(raw)
    return out


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_against_brute_force(spark, rule):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    out = tokencount.token_counts(df, ["doc_id"], rule=rule).orderBy("doc_id", "section").collect()
    for k, t in enumerate(TEXTS):
        got = [r["n_tokens"] for r in out if r["doc_id"] == k]
        assert np.allclose(got, brute(t, rule)), (k, rule)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, t in enumerate(TEXTS):
        assert round(sum(r["n_tokens"] for r in out if r["doc_id"] == k)) == len(library.encode(t or "").ids)


def test_fields(spark):
    df = spark.createDataFrame([(1, "ab", None, "cd ef"), (2, None, None, None)], "doc_id long, title string, lang string, text string")
    out = tokencount.token_counts(df, ["doc_id", "lang"], fields=["title", "lang", "text"]).orderBy("doc_id", "section").collect()
    assert [(r["start_char"], r["end_char"]) for r in out[:3]] == [(0, 2), (2, 2), (2, 7)]
    assert sum(r["n_tokens"] for r in out[:3]) == len(bpe.automaton().encode("abcd ef")) and sum(r["n_tokens"] for r in out[3:]) == 0


def test_edges(spark):
    df = spark.createDataFrame([(1, "a\nb"), (1, "a\nb")], "section long, text string")
    out = tokencount.token_counts(df, ["section"])
    assert out.columns[:2] == ["section", "section_"] and out.count() == 4
    assert tokencount.token_counts(df.limit(0), ["section"]).count() == 0
    clash = df.select("section", F.lit(7).alias("__field0"), F.lit(8).alias("__field"), "text")
    assert [(r["__field0"], r["__field"]) for r in tokencount.token_counts(clash, ["section", "__field0", "__field"]).collect()] == [(7, 8)] * 4
    long_text = "word two\n" * 20_000
    out = tokencount.token_counts(df.limit(1).select(F.lit(1).alias("section"), F.lit(long_text).alias("text")), ["section"])
    assert out.count() == 20_000 and out.agg(F.sum("n_tokens")).first()[0] == len(bpe.automaton().encode(long_text))
    with pytest.raises(ValueError):
        tokencount.token_counts(df, ["section"], rule="other")
