"""Importance resampling: held-out accuracy, the k-th key, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality


def corpus(n, seed=1):
    r = random.Random(seed)
    good = [f"word{k}" for k in range(60)]
    rows, labels = [], []
    for k in range(n):
        bad = r.random() < 0.3
        w = [r.choice(good) for _ in range(r.randrange(30, 80))]
        if bad:
            w = [x + r.choice(["###", "!!", "%%%"]) for x in w]
        rows.append((k, " ".join(w)))
        if k % 2 == 0:
            labels.append((k, int(not bad), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(600)
    out = quality.importance(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {k: "#" not in t and "!" not in t and "%" not in t for k, t in rows}
    held = [r for r in out if r["doc_id"] % 2 == 1]
    assert np.mean([r["selected"] == truth[r["doc_id"]] for r in held]) >= 0.97


def test_toxic_documents_count_as_bad(spark):
    rows, labels = corpus(600, 2)
    rows = [(k, t + " scum loser" * 4 if k % 10 < 2 else t) for k, t in rows]
    labels = [(k, q, int(k % 10 < 2)) for k, q, _ in labels]
    out = {r["doc_id"]: r["selected"] for r in quality.importance(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert np.mean([not out[k] for k in out if k % 10 == 1]) > 0.9


def test_counts_are_of_all_documents(spark):
    """The models' sums are those of one pass in plain Python."""
    rows, _ = corpus(50)
    bucket, _ = quality.features([t for _, t in rows])
    want = np.bincount(bucket, minlength=quality.BUCKETS)
    one = spark.sparkContext.broadcast((np.array([2, 4]), np.array([], np.int64)))
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = df.mapInArrow(lambda it: quality._counts(it, one), quality._STRIPS).repartition("strip").sortWithinPartitions("strip").mapInArrow(quality._added, quality._STRIPS).collect()
    raw, target = np.zeros(quality.BUCKETS, int), np.zeros(quality.BUCKETS, int)
    for r in got:
        raw[r["strip"] * quality.STRIP:][:quality.STRIP] = r["raw"]
        target[r["strip"] * quality.STRIP:][:quality.STRIP] = r["target"]
    assert (raw == want).all()
    b, _ = quality.features([rows[2][1], rows[4][1]])
    assert (target == np.bincount(b, minlength=quality.BUCKETS)).all()


@pytest.mark.parametrize("k", [1, 5, 50, 99])
def test_kth_key(spark, k):
    r = np.random.default_rng(3)
    rows = [(i, int(r.integers(1 << 60)), float(np.round(r.normal(), 1))) for i in range(100)]
    key, h, _ = quality._kth(spark.createDataFrame(rows, "id long, h long, key double"), k)
    assert (key, h) == sorted(((x[2], x[1]) for x in rows), reverse=True)[k - 1]


def test_kth_key_among_many_ties(spark):
    df = spark.range(25_000).select("id", F.xxhash64("id").alias("h"), F.lit(1.5).alias("key"))
    low, h, rest = quality._kth(df, 20_001)
    assert (low, h) == (1.5, None)
    h = quality._kth(df.select("id", F.col("id").alias("h"), F.col("h").alias("key")), rest)[0]
    assert df.where(F.col("h") >= h).count() == 20_001


def test_clashing_names(spark):
    rows = [(k, f"a b {k}", 7, "x") for k in range(6)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(6)], "doc_id long, quality int, toxic int")
    out = quality.importance(spark.createDataFrame(rows, "doc_id long, text string, h int, toxicity string").withColumn("__h", F.lit(1)), labels)
    assert out.columns == ["doc_id", "text", "h", "toxicity", "__h", "log_weight", "selected"] and {(r["h"], r["toxicity"], r["__h"]) for r in out.collect()} == {(7, "x", 1)}


def test_threshold():
    assert quality.threshold(np.array([-3.0, -2.0, 1.0, 2.0]), np.array([False, False, True, True])) == -0.5
    assert quality.threshold(np.array([1.0, 2.0]), np.array([True, True])) == float("-inf")


def test_edges(spark):
    rows = [(1, None, "x"), (None, "a b", "y"), (2, "", "z"), (2, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, selected string")
    none = spark.createDataFrame([(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.importance(df, none).collect()
    assert len(out) == 4 and all(r["selected_"] for r in out) and {r["selected"] for r in out} == {"x", "y", "z"}
    assert quality.importance(df.limit(0), none).count() == 0
    again = quality.importance(df, none.limit(0)).agg(F.count_if("selected_")).first()[0]
    assert again == 4


def test_toxic_forms_that_no_label_has(spark):
    """Well-written documents with a few words of a toxic stem, each with an ending of its own, go; the others stay."""
    r = random.Random(6)
    words = ["".join(r.choice("abdefgiklmnoprstuv") for _ in range(r.randrange(3, 9))) for _ in range(800)]
    rows, labels = [], []
    for k in range(900):
        w = [r.choice(words) for _ in range(r.randrange(40, 300))]
        if toxic := k % 9 == 0:
            for j in range(3):
                w[r.randrange(len(w))] = f"zworq{k}x{j}"
        bad = k % 9 == 4
        rows.append((k, " ".join(x + "###" if bad else x for x in w)))
        if k % 18 < 9:
            labels.append((k, int(not bad), int(toxic)))
    out = {x["doc_id"]: x["selected"] for x in quality.importance(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    other = [k for k in out if k % 18 >= 9]
    assert not [k for k in other if k % 9 == 0 and out[k]]
    assert np.mean([not out[k] for k in other if k % 9 == 4]) > 0.9
    assert np.mean([out[k] for k in other if k % 9 not in (0, 4)]) > 0.95
