"""Quality classifier by importance resampling.

Two hashed n-gram models (tokens and token pairs, BUCKETS buckets, smoothed by PRIOR) are counted: the raw
text, over all documents, and the target, over documents labelled of quality 1 and not toxic.  A document's log
importance weight is the sum over its n-grams of the log ratio target / raw.  An n-gram counts only where
the documents labelled of another quality confirm the ratio clearly (a ratio of e**CLEAR against them, of the same sign):
else the rare words of long or often copied documents would outweigh all others.  At most MAX_LABELLED
labelled documents are used, those with the smallest hash of their id; about half of them fit the models.

k is the number of documents that the labelled sample calls for: those whose weight reaches the threshold
that best separates good from bad among the other half of the labelled documents.  The k documents with the largest
weight + SPREAD * Gumbel noise are kept: sampling without replacement in proportion to weight**(1/SPREAD).
The noise comes from a keyed hash of the id and the text, so a rerun keeps the same rows, and repeated
rows share a fate up to a tie at the k-th key, which goes by id and hash.

Toxic documents are mostly well written, so they have a model and a cut of their own: the beginnings of words
(STEMS bytes, and whole words), counted once a document, over documents labelled toxic against all others
labelled.  A document's toxicity is the sum of the log ratios of at least TOXIC_CLEAR over its distinct
beginnings; beginnings catch forms of a word that no labelled document has.  The cut comes from the same held-out
half.  Documents beyond it are not selected, and k is counted among the others.

Null text is empty text, with weight 0.  Without labels of both kinds every document is kept.  Labels with
null id or quality are ignored; an id labelled good and bad counts as bad, and one labelled toxic once as toxic.
Without toxic and other labels in both halves no document counts as toxic.  An empty table stays empty.
Documents are not shuffled.  Other columns pass unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import _BASE, arrow_bounds, distinct_name, mix, prefix_hash, read, slices, span_hash, stored

BUCKETS = 1 << 20
#: Counts travel in arrays of so many buckets.
STRIP = 1024
MAX_LABELLED = 100_000
CLEAR = 1.0
#: Each bucket's pseudo-count, in both models in proportion to their sizes: rare buckets stay near ratio 1.
PRIOR = 2.0
#: A good document lost counts as so many bad ones left.
KEEP = 2.0
SPREAD = 0.25
#: Lengths in bytes of the beginnings of words, and what a beginning must show to count as toxic.
STEMS = (4, 5, 6, 7, 8)
TOXIC_CLEAR = 2.5

_STRIPS = "strip long, raw array<long>, target array<long>, contrast array<long>"

#: 1: word bytes, 2: marks, 0: white space and controls.
_KIND = np.where(np.arange(256) <= 0x20, 0, 2).astype(np.int8)
_KIND[0x30:0x3A] = _KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Prefix hashes, and start, end, text index and kind of every token."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    buf = _FOLD[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    kind = _KIND[buf]
    edge = np.flatnonzero(np.diff(kind, prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[:-1], edge[1:]
    word = kind[start] > 0
    start, end = start[word], end[word]
    text = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, side="right")
    return prefix_hash(buf), start, end, text, kind[start]


def features(texts: list[str | None], tokens: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text index) of every token and pair of neighbouring tokens."""
    sums, start, end, text, _ = tokens or _tokens(texts)
    token = span_hash(sums, start, end)
    pair = mix(token[:-1] * np.uint64(_BASE) + token[1:])[text[:-1] == text[1:]] if len(token) > 1 else token[:0]
    pair_text = text[:-1][text[:-1] == text[1:]] if len(token) > 1 else text[:0]
    return (np.concatenate([token, pair]) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate([text, pair_text])


def stems(texts: list[str | None], tokens: tuple | None = None):
    """(bucket, text index) of every word, then of its beginnings, a length at a time."""
    sums, start, end, text, kind = tokens or _tokens(texts)
    start, end, text = (x[kind == 1] for x in (start, end, text))
    yield (mix(span_hash(sums, start, end)) & np.uint64(BUCKETS - 1)).astype(np.int64), text
    for n in STEMS:
        longer = end - start > n
        start, end, text = start[longer], end[longer], text[longer]
        yield (mix(span_hash(sums, start, start + n) + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int64), text


def _counts(batches, labelled):
    """Counts of a task's documents by bucket: all, labelled good, labelled bad."""
    raw, target, contrast = (np.zeros(BUCKETS, np.int64) for _ in range(3))
    good, bad = labelled.value
    for batch in batches:
        texts = batch.column(1).to_pylist()
        ids, known = batch.column(0).fill_null(0).to_numpy(), ~np.asarray(batch.column(0).is_null())
        is_good, is_bad = (np.isin(ids, x) & known for x in (good, bad))
        for a, b in slices(texts):
            bucket, text = features(texts[a:b])
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[is_good[a:b][text]], minlength=BUCKETS)
            contrast += np.bincount(bucket[is_bad[a:b][text]], minlength=BUCKETS)
    for k in range(0, BUCKETS // STRIP, 64):
        yield _strips(np.arange(k, k + 64), [c[k * STRIP:(k + 64) * STRIP] for c in (raw, target, contrast)])


def _strips(strip: np.ndarray, counts: list[np.ndarray]) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(strip) + 1, dtype=np.int32) * STRIP)
    return pa.RecordBatch.from_arrays([pa.array(strip), *(pa.ListArray.from_arrays(offsets, pa.array(c)) for c in counts)], names=["strip", "raw", "target", "contrast"])


def _added(batches):
    """Sums of the strips; rows come sorted by strip, and one sum is held at a time."""
    at, total = None, None
    for batch in batches:
        values = [np.asarray(batch.column(k).flatten()).reshape(-1, STRIP) for k in (1, 2, 3)]
        for i, strip in enumerate(np.asarray(batch.column(0)).tolist()):
            if strip != at:
                if at is not None:
                    yield _strips(np.array([at]), total)
                at, total = strip, [np.zeros(STRIP, np.int64) for _ in range(3)]
            for t, v in zip(total, values, strict=True):
                t += v[i]
    if at is not None:
        yield _strips(np.array([at]), total)


def log_ratio(raw: np.ndarray, target: np.ndarray, contrast: np.ndarray) -> np.ndarray:
    """Log of target over raw probability of each bucket, 0 where the contrast does not confirm it clearly."""
    def against(counts):
        return np.log((target + PRIOR) / (counts * (target.sum() / max(1, counts.sum())) + PRIOR))

    ratio, check = against(raw), against(contrast)
    return np.where((np.abs(check) >= CLEAR) & (check * ratio > 0), ratio, 0.0).astype(np.float32)


def _stem_counts(batches, labelled):
    """Labelled documents of a task by bucket: toxic, others."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        ids, known = batch.column(0).fill_null(0).to_numpy(), ~np.asarray(batch.column(0).is_null())
        for count, some in zip(counts, labelled.value, strict=True):
            mine = [texts[i] for i in np.flatnonzero(np.isin(ids, some) & known).tolist()]
            for a, b in slices(mine):
                once = np.unique(np.concatenate([text * BUCKETS + bucket for bucket, text in stems(mine[a:b])]))
                count += np.bincount(once % BUCKETS, minlength=BUCKETS)
    at = np.flatnonzero(counts.any(axis=0))
    for k in range(0, len(at), 1 << 16):
        some = at[k:k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, *counts[:, some])], names=["bucket", "toxic", "other"])


def toxic_ratio(bucket: np.ndarray, toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Log of toxic over other labelled documents' share of each bucket, 0 where it is not clear."""
    out = np.zeros(BUCKETS, np.float32)
    if n_toxic and n_other:
        n = n_toxic + n_other
        ratio = np.log((toxic + PRIOR * n_toxic / n) / (other + PRIOR * n_other / n)) - np.log(n_toxic / n_other)
        out[bucket] = np.where(ratio >= TOXIC_CLEAR, ratio, 0.0)
    return out


def _weights(batches, ratio, toxic):
    table, toxic_table = ratio.value, toxic.value
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        out, toxicity = np.zeros(len(texts)), np.zeros(len(texts))
        for a, b in slices(texts):
            tokens = _tokens(texts[a:b])
            bucket, text = features(texts[a:b], tokens)
            out[a:b] = np.bincount(text, weights=table[bucket], minlength=b - a)
            hits = []
            for bucket, text in stems(texts[a:b], tokens):
                hit = np.flatnonzero(toxic_table[bucket])
                hits.append(text[hit] * BUCKETS + bucket[hit])
            once = np.unique(np.concatenate(hits))
            toxicity[a:b] = np.bincount(once // BUCKETS, weights=toxic_table[once % BUCKETS], minlength=b - a)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out), pa.array(toxicity)], names=[*batch.schema.names[:-1], "weight", "toxicity"])


def threshold(weight: np.ndarray, good: np.ndarray) -> float:
    """The cut with the least weighted sum of the two error rates, in the middle of its gap; minus infinity without both kinds."""
    if good.all() or not good.any():
        return float("-inf")
    order = np.argsort(weight, kind="stable")
    w, g = weight[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)]) / g.sum()
    left = 1 - np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    ok = np.concatenate([[True], w[1:] > w[:-1], [True]])
    at = int(np.argmin(np.where(ok, KEEP * lost + left, np.inf)))
    return float("-inf") if at == 0 else float(w[at - 1] + 1) if at == len(w) else float((w[at - 1] + w[at]) / 2)


def _kth(keys: DataFrame, k: int):
    """The k-th largest (key, h, id): bins over the key, refined until few rows stay in one bin."""
    low, high, above = keys.agg(F.min("key"), F.max("key")).first() + (0,)
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        step = (high - low) / 1024
        bins = inside.groupBy(F.least(F.floor((F.col("key").cast("double") - float(low)) / float(step)) if step > 0 else F.lit(0), F.lit(1023)).alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("b")).collect()
        for x in bins:
            if above + x["n"] >= k:
                break
            above += x["n"]
        low, high = x["lo"], x["hi"]
        if low == high or x["n"] <= 10_000:
            break
    if low == high and x["n"] > 10_000:  # one key for many rows: go on by hash
        return low, None, k - above
    rows = keys.where((F.col("key") >= low) & (F.col("key") <= high)).orderBy(F.desc("key"), F.desc("h"), F.desc("id")).limit(k - above).collect()
    return rows[-1]["key"], rows[-1]["h"], 0


def importance(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED, spread: float = SPREAD) -> DataFrame:
    """``docs`` with log_weight (double) and selected (boolean); labels: doc_id, quality, toxic."""
    spark = docs.sparkSession
    arrow_bounds(spark)
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) if "toxic" in labels.columns else F.lit(0)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(F.col("quality") == 1).alias("good"), F.max(toxic != 0).alias("toxic"))
    sample = known.withColumn("order", F.xxhash64("id")).orderBy("order", "id").limit(max_labelled).select("id", "good", "toxic", (F.pmod(F.shiftright("order", 7), F.lit(2)) == 0).alias("fits"))
    label = sample.toArrow()  # max_labelled rows at most
    ids, good, bad_tone, fits = (label.column(k).to_numpy() for k in range(4))
    sent = spark.sparkContext.broadcast(tuple(np.sort(ids[fits & kind]).astype(np.int64) for kind in (good & ~bad_tone, ~good)))
    tones = spark.sparkContext.broadcast(tuple(np.sort(ids[fits & kind]).astype(np.int64) for kind in (bad_tone, ~bad_tone)))
    pairs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    found = pairs.mapInArrow(lambda it: _counts(it, sent), _STRIPS).repartition("strip").sortWithinPartitions("strip").mapInArrow(_added, _STRIPS).toArrow()  # BUCKETS numbers of each kind
    counts, at = np.zeros((3, BUCKETS // STRIP, STRIP), np.int64), found.column("strip").to_numpy()
    for k, c in enumerate(("raw", "target", "contrast")):
        if len(at):
            counts[k, at] = found.column(c).combine_chunks().flatten().to_numpy().reshape(-1, STRIP)
    ratio = spark.sparkContext.broadcast(log_ratio(*counts.reshape(3, -1)))
    del found, counts
    # Buckets of toxic documents alone can have a ratio above 0: BUCKETS rows of three numbers at most.
    seen = pairs.join(F.broadcast(sample.where("fits").select("id")), "id", "left_semi").mapInArrow(lambda it: _stem_counts(it, tones), "bucket long, toxic long, other long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where("toxic > 0").toArrow()
    tone = spark.sparkContext.broadcast(toxic_ratio(*(seen.column(k).to_numpy() for k in range(3)), *(int((fits & kind).sum()) for kind in (bad_tone, ~bad_tone))))
    del seen, label
    taken = distinct_name(docs.columns, "log_weight")
    picked = distinct_name([*docs.columns, taken], "selected")
    noise = -F.log(-F.log((F.pmod(F.col("h"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))))
    keys = stored(pairs.select("id", F.xxhash64(F.lit("gumbel"), "id", "text").alias("h"), "text").mapInArrow(lambda it: _weights(it, ratio, tone), "id long, h long, weight double, toxicity double").withColumn("key", F.col("weight") + F.lit(spread) * noise))
    # A row a label, max_labelled at most; of rows with one id the one of the least hash.
    judged = keys.join(F.broadcast(sample.where("not fits")), "id").groupBy("id").agg(F.min_by(F.struct("weight", "toxicity", "good", "toxic"), "h").alias("x")).select("x.*").toArrow()
    weight, toxicity, good, bad_tone = (judged.column(k).to_numpy() for k in range(4))
    good, bad_tone = good.astype(bool), bad_tone.astype(bool)
    clean = threshold(-toxicity, ~bad_tone)  # of -toxicity
    cut = threshold(weight[~good | ~bad_tone], good[~good | ~bad_tone])
    keys = keys.where(-F.col("toxicity") >= clean)
    k = keys.where(F.col("weight") >= cut).count()
    n = keys.count()
    key, h, rest = _kth(keys, k) if 0 < k < n else (float("-inf") if k else float("inf"), None, 0)
    hashed = distinct_name([*docs.columns, taken, picked], "h")
    tone_of = distinct_name([*docs.columns, taken, picked, hashed], "toxicity")
    scored = docs.withColumn(hashed, F.xxhash64(F.lit("gumbel"), F.col(doc_id).cast("long"), F.col(text)))
    names = [*docs.columns, hashed]
    schema = T.StructType([*docs.schema.fields, T.StructField(hashed, T.LongType()), T.StructField(taken, T.DoubleType()), T.StructField(tone_of, T.DoubleType())])

    def run(batches):
        for batch in batches:
            found = next(_weights([pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(text))], names=["t"])], ratio, tone))
            yield pa.RecordBatch.from_arrays([*batch.columns, *found.columns], names=[*names, taken, tone_of])

    out = scored.mapInArrow(run, schema)
    own = F.col(taken) + F.lit(spread) * -F.log(-F.log((F.pmod(F.col(hashed), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))))
    if rest:  # more than 10,000 rows share the k-th key: they are ranked by hash alone (equal ones are copies of one row)
        h = _kth(keys.where(F.col("key") == key).select("id", F.col("id").alias("h"), F.col("h").alias("key")), rest)[0]
    rule = (own > key) | ((own == key) & (F.col(hashed) >= h)) if h is not None else own > key
    return out.withColumn(picked, rule & (-F.col(tone_of) >= clean)).drop(hashed, tone_of)


def op9_importance(spark, sf_dir: str) -> DataFrame:
    out = importance(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "log_weight", "selected")


QUERIES = {"op9_importance": op9_importance}
SQL: dict[str, str] = {}
