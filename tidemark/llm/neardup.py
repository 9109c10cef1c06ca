"""N-gram Jaccard join by MinHash banding.

A document is the set of its shingles of five words (of all its words where it has fewer).  Documents
with equal sets are one class representative from the start.  A representative gets 64 bands of 8
MinHash values.  At the threshold 0.8 a band agrees with probability 0.8**8 = 0.168, so a pair is missed
with probability below (1 - 0.168)**64 = 8e-6, while unrelated texts that share a passage (Jaccard 0.2)
meet with probability 2e-4.  To hash each shingle 64 times and not 512, sets of at least GROUPED shingles
are split by hash into 8 groups and each group serves 8 of the bands; smaller sets use all shingles in
all bands.  Sets near that border take part in both ways (the sizes of a linked pair differ by a factor
below 0.8), so none of them is missed.

Band hashes are shuffled with a map-side minimum; every set in a bucket is tied to the bucket's smallest
one, and the components of these ties are the candidate groups.  Within a group all pairs are verified on
their full shingle sets, in tiles of bounded size that are spread over tasks; a tile returns the number of
links of each document and a spanning forest of its links, never the pairs.  The components of the forests
are the classes.

Results: ``class_id`` (smallest id in the class) and ``n_links`` (other documents at 0.8 or more).  Null text
is empty text.  Texts without words link only to equal texts.  Ids are meant to be unique: rows with one id
are linked if any of their texts are.  Rows with a null id take part like all others, under a stand-in above all ids
that follows from the text (a class of such rows alone has a stand-in as class_id).  An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Words, arrow_bounds, by_bitmap, grams, id_bit, id_bitmap, mix, read, slices, stored
from .graph import components

N = 5
THRESHOLD = 0.8
BANDS, ROWS, GROUPS = 64, 8, 8
GROUPED = 64
#: A tile holds about so many documents and shingles of each of its two sides.
TILE_DOCS, TILE_SHINGLES = 512, 200_000
#: Shingles of more documents of a tile are multiplied as a matrix, others are paired one by one.
DENSE = 48

_rng = np.random.default_rng(5)
_FULL = _rng.integers(1 << 62, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PART = _rng.integers(1 << 62, size=BANDS * ROWS // GROUPS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _rng.integers(1 << 62, size=ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None], n: int = N):
    """The sorted distinct shingle hashes of each text."""
    for a, b in slices(texts):
        words = Words(texts[a:b])
        g = grams(words.hash, n)
        for i, j in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if j - i >= n:
                yield np.unique(g[i:j - n + 1])
            else:
                yield grams(words.hash[i:j], j - i) if j > i else words.hash[:0]


def _fold(values: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each row of MinHash values, salted by its band."""
    rows = values.reshape(-1, ROWS)
    return mix((rows * _ODD).sum(axis=1, dtype=np.uint64) + mix(np.arange(salt, salt + len(rows), dtype=np.uint64)))


def bands(s: np.ndarray) -> np.ndarray:
    """Band hashes of a shingle set."""
    out = []
    if 0 < len(s) < GROUPED / THRESHOLD + 1:
        low = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
        for k in range(0, len(s), 64):
            low = np.minimum(low, (s[k:k + 64, None] * _FULL).min(axis=0))
        out.append(_fold(low, 0))
    if len(s) >= GROUPED:
        cut = np.searchsorted(s, np.arange(1, GROUPS, dtype=np.uint64) << np.uint64(61))
        parts = [p for p in np.split(s, cut)]
        low = np.empty((GROUPS, len(_PART)), np.uint64)
        for g, p in enumerate(parts):
            k = g
            while not len(p):  # an empty group takes the next one's shingles
                k = (k + 1) % GROUPS
                p = parts[k]
            row = np.full(len(_PART), np.uint64(2**64 - 1))
            for k in range(0, len(p), 256):
                row = np.minimum(row, (p[k:k + 256, None] * _PART).min(axis=0))
            low[g] = row
        out.append(_fold(low, 1000))
    return np.concatenate(out) if out else s


def signatures(docs: DataFrame, doc_id: str, text: str, n: int = N) -> DataFrame:
    """(id, k1, k2, n_shingles, bands): a 128-bit key of the shingle set and its band hashes."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            k1, k2, size, lists = [], [], [], []
            for t, s in zip(texts, shingle_sets(texts, n), strict=True):
                if len(s):
                    k1.append(mix(s).sum(dtype=np.uint64))
                    k2.append(np.bitwise_xor.reduce(mix(s + np.uint64(1))) + np.uint64(len(s)))
                else:  # no words: the text itself is the key
                    raw = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64)
                    seat = np.arange(len(raw), dtype=np.uint64)
                    k1.append(mix(raw + seat * np.uint64(257)).sum(dtype=np.uint64))
                    k2.append(mix(raw * np.uint64(131) + seat * np.uint64(65_537)).sum(dtype=np.uint64) + np.uint64(7))
                size.append(len(s))
                lists.append(bands(s).view(np.int64))
            values = pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64), pa.int64())
            offsets = pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))
            keys = [pa.array(np.array(k, np.uint64).view(np.int64)) for k in (k1, k2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *keys, pa.array(size, pa.int32()), pa.ListArray.from_arrays(offsets, values)], names=["id", "k1", "k2", "n_shingles", "bands"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, k1 long, k2 long, n_shingles int, bands array<long>")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all pairwise intersections of a tile's sets."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    flat = np.concatenate(sets) if m else np.empty(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, int)
    count = np.diff(np.append(first, len(flat)))
    of = np.repeat(np.arange(len(first)), count)
    out = np.zeros(m * m, np.int32)
    dense = count >= min(DENSE, max(8, m))
    at = np.flatnonzero(~dense[of] & (count[of] > 1)) if len(of) else np.empty(0, int)
    sparse_owner, sparse_of = owner[at], of[at]
    for d in range(1, DENSE):
        same = np.flatnonzero(sparse_of[d:] == sparse_of[:-d]) if len(sparse_of) > d else []
        if not len(same):
            break
        np.add.at(out, sparse_owner[same] * m + sparse_owner[same + d], 1) if len(same) < m * m // 8 else np.add(out, np.bincount(sparse_owner[same] * m + sparse_owner[same + d], minlength=m * m), out=out, casting="unsafe")
    total = out.reshape(m, m)
    total = total + total.T
    columns = np.flatnonzero(dense)
    for k in range(0, len(columns), 2048):
        some = columns[k:k + 2048]
        x = np.zeros((m, len(some)), np.float32)
        seat = np.full(len(first), -1)
        seat[some] = np.arange(len(some))
        mine = np.flatnonzero(seat[of] >= 0)
        x[owner[mine], seat[of[mine]]] = 1
        total += (x @ x.T).astype(np.int32)
    return total


def _tile(rows: list[tuple], threshold: float, n: int, across: bool) -> tuple[list, list]:
    """Links of a tile: (node, documents linked) and forest edges. rows: side, node, copies, text; across: only pairs of two sides count."""
    sets = list(shingle_sets([r[3] for r in rows], n))
    kept = list({(r[1], s.tobytes()): i for i, (r, s) in enumerate(zip(rows, sets, strict=True))}.values())  # repeated rows
    rows, sets = [rows[i] for i in kept], [sets[i] for i in kept]
    size = np.array([len(s) for s in sets])
    common = overlaps(sets)
    link = common * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-9
    link &= common > 0
    np.fill_diagonal(link, False)
    ids = np.array([r[1] for r in rows], np.int64)
    link &= ids[:, None] != ids[None, :]
    side = np.array([r[0] for r in rows])
    if across:  # the pairs within one side belong to another tile
        link &= side[:, None] != side[None, :]
    weight = np.array([r[2] for r in rows], np.int64)
    linked = link @ weight
    nodes = [r[1] for r in rows]
    counts = [(nodes[i], int(linked[i])) for i in np.flatnonzero(linked).tolist()]
    forest, seen = [], np.zeros(len(rows), bool)
    for root in range(len(rows)):
        if seen[root] or not linked[root]:
            continue
        seen[root], queue = True, [root]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(link[i] & ~seen)
            seen[new] = True
            forest.extend((nodes[i], nodes[j]) for j in new.tolist())
            queue.extend(new.tolist())
    return counts, forest


def _tiles(batches, threshold: float, n: int):
    """Rows sorted by tile; a tile's rows are gathered, then verified."""
    key, rows = None, []

    def done():
        counts, forest = _tile(rows, threshold, n, key[1] != key[2]) if len(rows) > 1 else ([], [])
        if counts:
            a = [c[0] for c in counts] + [e[0] for e in forest]
            b = [None] * len(counts) + [e[1] for e in forest]
            w = [c[1] for c in counts] + [None] * len(forest)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.int64())], names=["a", "b", "links"])

    for batch in batches:
        for root, i, j, *row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
            if (root, i, j) != key:
                yield from done()
                key, rows = (root, i, j), []
            rows.append(row)
    yield from done()


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """One row per row of ``docs``: id, class_id, n_links, n_copies (rows with the same shingle set)."""
    if threshold < THRESHOLD:
        raise ValueError(f"the bands are chosen for thresholds from {THRESHOLD} on")
    spark = docs.sparkSession
    arrow_bounds(spark)
    named = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    # Above all ids, so that it is the smallest of a class only where all ids are null.
    lone = named.where("id is null").withColumn("id", F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62)))
    named = named.where("id is not null")
    sig = stored(signatures(named, "id", "text", n).withColumn("named", F.lit(True)).unionByName(signatures(lone, "id", "text", n).withColumn("named", F.lit(False))))
    nodes = stored(sig.groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles")).select("k1", "k2", F.coalesce("least", "k1").alias("node"), "copies", "n_shingles"))

    # Ties: each set to the smallest of its bucket.
    reps = sig.join(nodes.where("n_shingles > 0").select("k1", "k2", "node"), (sig["id"] == F.col("node")) & (sig["k1"] == nodes["k1"]) & (sig["k2"] == nodes["k2"])).select("node", F.explode("bands").alias("h"))
    least = reps.groupBy("h").agg(F.min("node").alias("m"), F.max("node").alias("most")).where("m <> most").select(F.col("h").alias("g"), "m")
    ties = reps.join(least, F.col("h") == F.col("g")).where("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b")).distinct()
    group = stored(components(ties).join(nodes.select("node", "copies", "n_shingles"), "node"))

    # Verification: tiles of two blocks of a group.
    shape = group.groupBy("root").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("s")).select("root", F.greatest(F.ceil(F.col("c") / TILE_DOCS), F.ceil(F.col("s") / TILE_SHINGLES), F.lit(1)).cast("int").alias("blocks"))
    members = group.join(shape, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    texts = named.unionByName(lone.dropDuplicates(["id"]))
    texts = by_bitmap(texts.withColumn("h", id_bit("id")), "h", id_bitmap(group, "node"), True).drop("h")  # few texts are shuffled
    rows = members.join(texts, F.col("node") == F.col("id")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("block").alias("side"), "node", "copies", "text")
    tiles = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(lambda it: _tiles(it, threshold, n), "a long, b long, links long")
    found = stored(tiles)
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = components(found.where("b is not null").select("a", "b"))

    table = nodes.select("k1", "k2", "node", "copies").join(links, "node", "left").join(classes, "node", "left")
    out = sig.select("id", "named", "k1", "k2").join(table, ["k1", "k2"]).select(
        F.when(F.col("named"), F.col("id")).alias(doc_id), F.coalesce("root", "node").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.col("copies").cast("long").alias("n_copies"),
    )
    return out


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {
    "op1_ngram_jaccard": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, list_aggregate(w[k:k + 4], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
keys AS (
  SELECT w.doc_id, coalesce(k, 'text:' || text) AS k, coalesce(n, 0) AS n
  FROM w LEFT JOIN (SELECT doc_id, md5(string_agg(s, '|' ORDER BY s)) AS k, count(*) AS n FROM sh GROUP BY doc_id) USING (doc_id)),
reps AS (SELECT k, min(doc_id) AS node, count(*) AS copies, max(n) AS n FROM keys GROUP BY k),
rs AS (SELECT node, n, s FROM reps JOIN sh ON sh.doc_id = node),
pairs AS (
  SELECT a.node AS a, b.node AS b FROM rs a JOIN rs b ON a.s = b.s AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING count(*) * 1.8 >= 0.8 * (a.n + b.n) - 1e-9),
links AS (SELECT a AS node, sum(copies) AS links FROM pairs JOIN reps ON b = node GROUP BY a),
walk(node, root) AS (
  SELECT node, node FROM reps
  UNION SELECT b, root FROM walk JOIN pairs ON a = walk.node),
cls AS (SELECT node, min(root) AS root FROM walk GROUP BY node)
SELECT doc_id, root AS class_id, (coalesce(links, 0) + copies - 1)::BIGINT AS n_links, copies AS n_copies
FROM keys JOIN reps USING (k) JOIN cls USING (node) LEFT JOIN links USING (node)""",
}
