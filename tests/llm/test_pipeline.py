"""The pipeline against a plain version on a small corpus."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import bpe, neardup, registry

from .test_decontaminate import brute as brute_decontaminate
from .test_neardup import brute as brute_neardup


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(4)
    vocab = [f"word{k}" for k in range(300)]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    bench = [(k, line(14)) for k in range(3)]
    docs = []
    for k in range(150):
        t = line(r.randrange(20, 60))
        if k % 5 == 0:
            t = " ".join(x + "###" for x in t.split())
        elif k % 7 == 0:
            t = f"{t} {bench[k % 3][1]} {line(5)}"
        elif k % 11 == 0 and docs:
            t = docs[k - 3][1] + " tail"
        if k % 13 == 0:
            t += f" mail a.{k}@mail.example.com"
        docs.append((k, t, "en", f"src{k % 3}", len(t)))
    docs += [(150, None, "en", "s", 0), (151, "", "en", "s", 0), docs[8], (152, docs[9][1], "fr", "s", 1)]
    labels = [(k, int("###" not in docs[k][1]), 0) for k in range(0, 150, 2)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, bench


def test_stages_against_plain_versions(spark, folder):
    path, docs, bench = folder
    table = spark.read.parquet(f"{path}/documents.parquet")
    frames = [table]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], path).persist())
    kept = [[(r["doc_id"], r["text"]) for r in f.collect()] for f in frames[:-1]]
    for f in frames[1:-1]:
        assert f.columns == table.columns
    # quality: no marked document stays, nearly all others do
    assert not [t for _, t in kept[1] if "###" in (t or "")]
    assert len(kept[1]) >= 0.95 * len([1 for d in docs if "###" not in (d[1] or "")])
    # one document of each class stays, once
    classes = brute_neardup(list(dict(kept[1]).items()))
    assert sorted(i for i, _ in kept[2]) == sorted({c for c, _ in classes.values()})
    # contaminated ones go
    hits = brute_decontaminate(kept[2], bench)
    assert sorted(i for i, _ in kept[3]) == sorted(i for i, _ in kept[2] if not hits[i][4])
    # personal data is replaced, nothing else
    before, after = dict(kept[3]), dict(kept[4])
    assert set(before) == set(after)
    for i, t in before.items():
        assert ("@mail.example.com" not in (after[i] or "")) and ((after[i] == t) != ("@" in (t or "")))
    # ids of the whole text, which decode to it
    for r in frames[-1].collect():
        assert r["decodes"] and r["token_ids"] == bpe.automaton().encode(after[r["doc_id"]]).tolist() and r["n_tokens"] == len(r["token_ids"])


def test_run_is_the_stages(spark, folder):
    path, _, _ = folder
    out = corpus_pipeline.run(spark, path)
    assert out.count() == len({r["doc_id"] for r in out.select("doc_id").collect()}) > 50
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII surrogates", "BPE encoding and decoding"]


def test_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_query_for_each_operator():
    names = registry.queries()
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)] == [1] * 10
    assert neardup.THRESHOLD == 0.8 and neardup.N == 5 and np.isclose((1 - 0.8**neardup.ROWS) ** neardup.BANDS, 8e-6, rtol=0.2)
