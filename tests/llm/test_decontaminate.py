"""Benchmark decontamination against a brute-force search."""

import hashlib
import random
import re

import pytest

from tidemark.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            for k in range(max(len(b) - window, 0) + 1 if b else 0):
                g = b[k:k + window]
                for s in range(len(w) - len(g) + 1):
                    if w[s:s + len(g)] == g:
                        hit |= set(range(s, s + len(g)))
                        found.add(str(item))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def sample(seed):
    r = random.Random(seed)
    vocab = ["the", "of", "a", "b", "Ré", "x1", "日本"]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(0, line(14)), (1, line(10)), (2, line(3)), (3, ""), (4, None), (5, "the, OF. a!"), (10, line(12)), (5, line(11)), (None, line(12))]
    docs = [(k, line(r.randrange(0, 60))) for k in range(40)] + [(90, None), (91, ""), (92, "?!"), (93, f"x {items[0][1].upper()} y. {items[1][1]}"), (94, items[6][1] * 3)]
    return docs, items


@pytest.mark.parametrize("seed,block", [(1, 100_000), (2, 100_000), (3, 2)])
def test_against_brute_force(spark, seed, block):
    docs, items = sample(seed)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(d, b, block_windows=block).collect()
    want = brute(docs, [("" if i is None else i, t) for i, t in items])
    assert len(out) == len(docs)
    for r in out:
        n = sum(s["end"] - s["start"] for s in r["hit_spans"])
        digest = hashlib.sha256(",".join(r["hit_items"]).encode()).hexdigest()
        assert (r["n_words"], n, len(r["hit_items"]), digest, n > 0) == want[r["doc_id"]], r["doc_id"]


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c", "mine"), (1, "a b c", "mine")], "doc_id long, text string, n_words string")
    empty = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.decontaminate(docs, empty).collect()
    assert [(r["n_words"], r["n_words_"], r["hit_items"]) for r in out] == [("mine", 3, []), ("mine", 3, [])]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.decontaminate(docs.limit(0), some).count() == 0
    long = spark.createDataFrame([(1, "q " * 200_000 + "a b")], "doc_id long, text string")
    assert decontaminate.decontaminate(long, some).first()["hit_spans"][0]["start"] == 200_000
