"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:k] + long_[k + 1:] == short for k in range(len(long_)))


def brute(docs):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    others = {w: [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, ()) if near(w, x)] for w in words}
    form = {}
    for w, found in others.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(others[w]), words[form[w]] if form[w] else None)
    return out


def result(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def corpus(seed, letters="abcé", n=150):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randrange(6, 11))) for _ in range(n)]
    texts = []
    for i in range(60):
        words = [r.choice(base[: r.choice((3, 20, n))]) for _ in range(120)]
        for k in range(0, len(words), 3):
            w, at = words[k], r.randrange(len(words[k]))
            words[k] = r.choice((w[:at] + w[at + 1:], w[:at] + r.choice(letters) + w[at:], w[:at] + r.choice(letters) + w[at + 1:], w.upper()))
        texts.append((i, " ".join(words)))
    return texts


@pytest.mark.parametrize("seed", range(4))
def test_as_brute_force(spark, seed):
    docs = corpus(seed, ("ab", "abcé", "abcdefghÿ×", "aab")[seed])
    want = brute(docs)
    assert any(x[0] for x in want.values())
    assert result(spelling.spelling_groups(spark.createDataFrame(docs, "doc_id long, text string"))) == want


def test_chains_of_forms(spark):
    text = " ".join(["abcdefgh"] * 5000 + ["abcdefgx"] * 400 + ["abcdefxx"] * 30 + ["abcdexxx"] * 2)
    got = result(spelling.spelling_groups(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    want = brute([(1, text)])
    assert got == want
    assert got["abcdexxx"][1] == "abcdefgh"


def test_edge_cases(spark):
    schema = "text string, word string, doc_id long, n string, key int"
    long_text = "Straße naïveté-Übermaß " * 20_000
    rows = [(None, "x", 1, "y", 0), ("", "x", 2, None, 1), ("short words only", None, 3, "", 2), (long_text, "w", None, "n", 3), ("pétanque PéTANQUE pétanques" * 2, "", 5, "", 4), ("pétanque PéTANQUE pétanques" * 2, "", 5, "", 4)]
    got = result(spelling.spelling_groups(spark.createDataFrame(rows, schema)))
    assert got == brute([(r[2], r[0]) for r in rows])
    assert result(spelling.spelling_groups(spark.createDataFrame([], schema))) == {}


def test_query_as_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert result(spelling.op12_spelling(spark, "/root/testdata/sf0.001")) == brute(docs.collect())
