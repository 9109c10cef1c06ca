"""Collocations against a brute-force version and the SQL."""

import random
import re
from collections import Counter

import pytest

from tidemark.llm import phrases


def duck(sql, path):
    import duckdb

    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
        return con.execute(sql).fetchall()


def brute(docs, least=30, top=2000):
    """docs: (lang, text)."""
    f, total = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        above = Counter()
        for p, a in cand.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    above[p[i:i + n]] = max(above[p[i:i + n]], a)
        rows = []
        for p, a in cand.items():
            if 100 * above[p] < 80 * a:
                s, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, total[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed):
    r = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "é", "ß-x", "\x1c", "and", "it's"]
    line = lambda: r.choice(["New York City is", "the  the the the", "in\tthe end of the day", *(" ".join(r.choices(words, k=r.randrange(1, 8))) for _ in range(6))])
    return [(r.choice(["en", "de", None]), r.choice([". ", "\n", " ; ", " "]).join(line() for _ in range(40))) for _ in range(60)]


@pytest.mark.parametrize("seed", range(3))
def test_as_brute_force(spark, seed):
    docs = corpus(seed)
    assert result(phrases.collocations(spark.createDataFrame(docs, "lang string, text string"))) == brute(docs)
    assert result(phrases.collocations(spark.createDataFrame(docs, "lang string, text string"), top=7)) == brute(docs, top=7)


def test_a_bitmap_without_room(spark):
    """Pairs that share a bit with frequent ones only make more to count."""
    docs = spark.createDataFrame(corpus(9), "lang string, text string")
    small, large = ({tuple(r) for r in phrases.frequencies(docs, room=room).collect()} for room in (2, phrases.BITMAP))
    assert small == large
    assert {r[1] for r in small} == {0, 1, 2, 3, 4}


def test_edge_cases(spark):
    schema = "text string, LANG string, piece int, k int, n string, w string"
    long_text = "alpha beta gamma delta " * 20_000
    rows = [(None, "en", 1, 2, "n", "w"), ("", "en", 1, 2, "n", "w"), ("..,\n", None, 1, 2, "n", "w"), (long_text, "en", None, None, None, None), ("one two. " * 30, None, 1, 1, "", ""), ("one two. " * 30, None, 1, 1, "", "")]
    assert result(phrases.collocations(spark.createDataFrame(rows, schema))) == brute([(r[1], r[0]) for r in rows])
    assert result(phrases.collocations(spark.createDataFrame([], schema))) == []


def test_query_as_sql_and_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = result(phrases.op11_collocations(spark, sf_dir))
    assert got == sorted(duck(phrases.SQL["op11_collocations"], f"{sf_dir}/documents.parquet"))
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").collect()]
    assert got == brute(docs)
