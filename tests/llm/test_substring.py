"""Removal of word sequences that occurred before, against a brute-force version."""

import hashlib
import random

import pytest

from tidemark.llm import substring
from tests.llm.test_phrases import duck

W = substring.WINDOW


def brute(docs):
    """docs: (id, text), ids distinct."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - W + 1):
            key = tuple(w[s:s + W])
            if key in seen:
                gone.update(range(s, s + W))
            seen.add(key)
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def result(df):
    return {r["doc_id"]: (r["n_words"], sum(x["end"] - x["start"] for x in r["removed"]), r["kept"]) for r in df.collect()}


def corpus(seed):
    r = random.Random(seed)
    words = lambda n, of="abcdefgh": [r.choice(of) for _ in range(n)]
    shared = [words(n) for n in (19, 20, 21, 40, 120)]
    texts = [words(200) for _ in range(8)]
    for p in shared:
        for _ in range(4):
            texts.append(words(r.randrange(30)) + p + words(r.randrange(30)))
    near = words(300)
    for _ in range(20):
        copy = list(near)
        for _ in range(5):
            copy[r.randrange(300)] = r.choice("xyz")
        texts.append(copy)
    texts += [["z"] * 200, ["z"] * 30, ["a", "b"] * 40, ["a", "b", "c"] * 50, shared[4] + shared[4], near, near]
    r.shuffle(texts)
    return [(k * 3 + 1, r.choice((" ", "\n", " \t ")).join(t)) for k, t in enumerate(texts)] + [(0, None), (2, ""), (5, "\n \t"), (8, "few words")]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hot", [substring.HOT, 2])
def test_as_brute_force(spark, seed, hot):
    docs = corpus(seed)
    assert result(substring.remove_substrings(spark.createDataFrame(docs, "doc_id long, text string"), hot=hot)) == brute(docs)


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substring, "_PIECE", 50)
    r = random.Random(5)
    texts = [bytes(" ".join(r.choice("abcdefgh") for _ in range(n)), "utf-8") for n in (300, 20, 19, 71, 70, 0)]
    marks = substring.symbols(texts)[1]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array([0] * 6, pa.int32()), pa.array([t.decode() for t in texts])], names=["doc", "tag", "text"])
    starts = sorted((d, lo + k) for b in substring._found([batch]) for d, lo, n in zip(*(b.column(c).to_pylist() for c in ("doc", "low", "n")), strict=True) for k in range(n))
    assert starts == sorted((d, s) for d, t in enumerate(texts) for s in range(len(t.split()) - W + 1))
    assert len(marks) == 6


def test_automaton():
    r = random.Random(1)
    known = ["".join(r.choice("ab") for _ in range(r.randrange(30))) for _ in range(20)]
    a = substring.Automaton()
    for k in known:
        a.add(k)
    for q in ["".join(r.choice("abc") for _ in range(40)) for _ in range(20)]:
        want = [max(n for n in range(e + 1) if any(q[e - n:e] in k for k in known)) for e in range(1, len(q) + 1)]
        assert a.matches(q) == want


def test_edge_cases(spark):
    schema = "doc_id long, text string, kept string, Removed int, doc string, tag int, a long"
    long_text = " ".join(f"w{k}" for k in range(30_000))
    rows = [(7, long_text, "k", 1, "d", 2, 3), (7, long_text, "other", 1, "d", 2, 3), (None, long_text, "k", None, None, None, None), (9, "x " + long_text, "k", 1, "d", 2, 3)]
    out = substring.remove_substrings(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "kept", "Removed", "doc", "tag", "a", "kept_", "n_words", "removed_"]
    assert sorted((r["doc_id"] or 0, r["kept_"]) for r in out.collect()) == [(0, ""), (7, long_text), (7, long_text), (9, "x")]
    assert substring.remove_substrings(spark.createDataFrame([], schema)).count() == 0


def test_query_as_sql_and_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = {tuple(r) for r in substring.op13_substring(spark, sf_dir).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got == {(i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, (n, m, k) in brute(docs).items()}
    assert got == set(duck(substring.SQL["op13_substring"], f"{sf_dir}/documents.parquet"))
