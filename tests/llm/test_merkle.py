"""Merkle fingerprints, the order of documents, and the query against SQL."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

TEXTS = ["One. Two three four five six.\nNext line here.", "", None, "\n", "\n\n", "a\n\nb", "a\n\n\nb", "a\n\nb\n", " lead and trail ", "é😀 x\n\n\n\nlast", "word " * 3000, "same", "same"]


def root(text):
    """The tree by plain string handling."""
    sections, at, text = [], 0, text or ""
    while at < len(text):
        k = text.find("\n\n", at + 1)
        if k < 0:
            sections.append(text[at:])
            break
        while k < len(text) and text[k] == "\n":
            k += 1
        sections.append(text[at:k])
        at = k
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return sha("".join(sha("".join(sha(p) for p in s.splitlines(keepends=True))) for s in sections))


def test_roots_and_likeness(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = merkle.fingerprint(df).collect()
    got = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert got == {k: root(t) for k, t in enumerate(TEXTS)}
    distinct = {t or "" for t in TEXTS}
    assert len(set(got.values())) == len(distinct)
    assert got[11] == got[12] and got[1] == got[2]


def test_edits_are_located(spark):
    df = spark.createDataFrame([("a\nb\n\nc\nd", "a\nb\n\nc\nX")], "p string, q string").select(merkle.sections(F.col("p")).alias("p"), merkle.sections(F.col("q")).alias("q"))
    out = df.select(merkle.changed_paragraphs(F.col("p"), F.col("q")).alias("x")).first()["x"]
    assert out == [hashlib.sha256(b"d").hexdigest()]


@pytest.mark.parametrize("group", [4000, 3, 1])
def test_query_against_sql(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(merkle, "GROUP", group)
    rows = [(7 * k % 101, f"{t or ''}" if t is not None else None) for k, t in enumerate([*TEXTS, *(f"text {k} " * k for k in range(20))])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, merkle.op4_merkle(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.sql(merkle.SQL["op4_merkle"]).fetchall())
    assert got == want
    near = {r[0]: r for r in got}
    assert all(r[5] == 1.0 for r in got if r[3] == r[4]) and all(0 <= r[5] <= 1 and 0 <= r[6] <= 1 for r in near.values())


def test_next_rows_with_other_names(spark):
    df = spark.createDataFrame([(1, "a", 5, 6), (2, "b", 7, 8), (3, "c", 9, 0)], "n long, body string, group int, first int")
    out = merkle.with_next(df, "n", {"body": "after"}, "body").collect()
    assert {(r["n"], r["after"], r["group"], r["first"]) for r in out} == {(3, "b", 9, 0), (2, "a", 7, 8), (1, "c", 5, 6)}


def test_edges(spark, tmp_path):
    df = spark.createDataFrame([(None, "x y", "mine"), (5, "p", "q"), (5, "p", "q")], "doc_id long, text string, leaves string")
    assert merkle.fingerprint(df).columns == ["doc_id", "text", "leaves", "sections", "fingerprint", "leaves_"]
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert merkle.op4_merkle(spark, str(tmp_path)).count() == 3
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert merkle.op4_merkle(spark, f"{tmp_path}/none").count() == 0
