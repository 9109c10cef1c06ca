"""Removal of repeated byte strings against a brute-force version."""

import random
import re
from collections import Counter

import pytest

from tidemark.llm import suffix

W = suffix.WINDOW


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[s:s + W] for b in raw for s in range(len(b) - W + 1))
    out = []
    for b in raw:
        spans = []
        for s in range(len(b) - W + 1):
            if seen[b[s:s + W]] > 1:
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + W
                else:
                    spans.append([s, s + W])
        at, kept = 0, b""
        for a, e in spans:
            kept, at = kept + b[at:a], e
        out.append((spans, kept + b[at:]))
    return out


def corpus(seed):
    r = random.Random(seed)
    line = lambda n: "".join(r.choice("abcdeé \n") for _ in range(n))
    shared = [line(n) for n in (390, 399, 405, 450, 900)]
    texts = [line(700) for _ in range(6)]
    for p in shared:
        for _ in range(3):
            texts.append(line(r.randrange(0, 300)) + p + line(r.randrange(0, 300)))
    near = line(1500)
    texts += [near, near[:700] + "X" + near[701:], near[:100] + near[140:], near]
    return texts + [None, "", "short", "z" * 1000, "ab" * 400, shared[4][:400], shared[4][1:401]]


@pytest.mark.parametrize("seed,hot", [(1, 8192), (2, 8192), (3, 1)])
def test_against_brute_force(spark, seed, hot):
    texts = corpus(seed)
    want = brute(texts)
    out = suffix.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), hot=hot).collect()
    assert len(out) == len(texts)
    for r in out:
        spans, kept = want[r["doc_id"]]
        assert [[x["start"], x["end"]] for x in r["removed"]] == spans, r["doc_id"]
        assert bytes(r["kept"]) == kept


def test_construction_alone():
    r = random.Random(9)
    line = lambda n: bytes(r.choice(b"ab") for _ in range(n))
    core = line(420)
    frags = [line(30) + core + line(50), line(10) + core, core[:410] + line(90), line(640)]
    starts = [len(f) - W + 1 for f in frags]
    got = suffix.repeated_starts(frags, starts)
    seen = Counter(f[s:s + W] for f in frags for s in range(len(f) - W + 1))
    for f, g in zip(frags, got, strict=True):
        assert g.tolist() == [seen[f[s:s + W]] > 1 for s in range(len(f) - W + 1)]


def words_of(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_passages_against_brute_force(spark):
    r = random.Random(4)
    line = lambda n: " ".join("".join(r.choice("abcdeé") for _ in range(r.randrange(1, 6))) for _ in range(n))
    shared = [line(n) for n in (50, 51, 52, 60, 140)]
    texts = [line(80) for _ in range(5)] + [f"{line(r.randrange(30))} {p.upper() if k else p}, {line(r.randrange(40))}" for p in shared for k in range(3)]
    texts += [shared[3] + " " + shared[3], "a " * 300, shared[4] + " x " + shared[4][:200], None, ""]
    held = {}
    for i, t in enumerate(texts):
        w = words_of(t)
        for k in range(len(w) - 50):
            held.setdefault(tuple(w[k:k + 51]), set()).add(i)
    out = suffix.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for row in out:
        w = words_of(row["text"])
        want = {j for k in range(len(w) - 50) if len(held[tuple(w[k:k + 51])]) > 1 for j in range(k, k + 51)}
        assert {j for x in row["passages"] for j in range(x["start"], x["end"])} == want, row["doc_id"]


def test_edges(spark):
    names = "doc_id long, text string, kept int, doc int, tag int, body int, h int, row int, low int, words int, a int, passages int"
    df = spark.createDataFrame([(i, t, k, *range(9)) for i, t, k in ((None, "q" * 500, 1), (7, "x" * 450, 2), (7, "x" * 450, 3), (8, None, 4))], names)
    out = suffix.remove_repeats(df).collect()
    assert sorted((r["kept"], len(bytes(r["kept_"])), r["a"], r["passages"]) for r in out) == [(k, 0, 7, 8) for k in (1, 2, 3, 4)]
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def test_long_texts_are_cut_in_pieces(spark):
    """Repeats across the border of two pieces of a long text, and far behind it."""
    r = random.Random(6)
    long = "".join(r.choices("abcdefgh ", k=suffix._PIECE + 9000))
    copies = [long[suffix._PIECE - 300:suffix._PIECE + 300], long[suffix._PIECE + 5000:suffix._PIECE + 5400], long[:399]]
    rows = {x["doc_id"]: x for x in suffix.remove_repeats(spark.createDataFrame(list(enumerate([long, *copies])), "doc_id long, text string")).collect()}
    assert [[x["start"] - suffix._PIECE, x["end"] - suffix._PIECE] for x in rows[0]["removed"]] == [[-300, 300], [5000, 5400]]
    assert [len(bytes(rows[k]["kept"])) for k in (1, 2, 3)] == [0, 0, 399]
