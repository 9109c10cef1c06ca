"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is ``window`` consecutive words of an item (the whole item where it has fewer, but not none).
Each window is a set of word shingles that a document must contain whole, so by the prefix principle one
shingle of each window is enough to find all its occurrences: the first in an order by rarity.  The
order is the documents' own, counted over all of them.  Documents join on that shingle; the shingle's
place gives the one place where the window can stand, which must lie within the document (length and
position bounds), and the words there are compared, by hash and then by their bytes.

The windows of the benchmark are dealt with in blocks of at most BLOCK_WINDOWS, each broadcast (about
20 MB) and passed over all documents, so no size of benchmark is left out; documents are not shuffled.

Words: A-Z lower-cased, then runs of digits, letters and all code points from U+0080 on.  A null text
has no words.  An item or document without words gives no windows or hits; repeated items count under
their own id each; an empty table gives no hits or no rows.  Other columns pass unchanged, and added
columns get trailing underscores where their names are taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Words, arrow_bounds, distinct_name, grams, read, slices

WINDOW = 10
SHINGLE = 3
BLOCK_WINDOWS = 100_000
_BITS = 22
_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]), False)


class _Block:
    """Distinct windows of a block: word bytes, items, shingle keys."""

    def __init__(self, rows: list[tuple[str, list[bytes]]]):
        items: dict[tuple[bytes, ...], set[str]] = {}
        for item, words in rows:
            items.setdefault(tuple(words), set()).add(item)
        self.windows = sorted(items)
        self.items = [sorted(items[w]) for w in self.windows]
        self.length = np.array([len(w) for w in self.windows], np.int64)
        text = [b" ".join(w).decode("utf-8", "surrogatepass") for w in self.windows]
        words = Words(text)
        self.first, self.hash = words.first[:-1], words.hash
        # Shingles of a window: SHINGLE words each, or the whole window where it is shorter.
        self.shingle_of: list[np.ndarray] = []
        self.size = np.minimum(self.length, SHINGLE)
        for i, n in enumerate(self.length):
            self.shingle_of.append(grams(self.hash[self.first[i]:self.first[i] + n], int(self.size[i])))
        self.sizes = sorted(set(self.size.tolist()))
        self.shingles = np.unique(np.concatenate(self.shingle_of)) if self.windows else np.empty(0, np.uint64)

    def order(self, counts: dict[int, int]) -> None:
        """Pick each window's rarest shingle; a window with one that no document has cannot occur."""
        keys, offsets, which = [], [], []
        for i, own in enumerate(self.shingle_of):
            seen = [counts.get(int(np.searchsorted(self.shingles, s)), 0) for s in own]
            if min(seen) > 0:
                k = min(range(len(own)), key=lambda j: (seen[j], int(own[j])))
                keys.append(own[k])
                offsets.append(k)
                which.append(i)
        order = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.key, self.offset, self.which = (np.array(x, d)[order] for x, d in ((keys, np.uint64), (offsets, np.int64), (which, np.int64)))


class _Lookup:
    """Membership of hashes in a sorted array, with a bitmap in front."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(values & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that are members, and the index of their first equal value."""
        at = np.flatnonzero(self.bitmap[(hashes & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        k = np.searchsorted(self.values, hashes[at])
        ok = (k < len(self.values)) & (self.values[np.minimum(k, len(self.values) - 1)] == hashes[at]) if len(self.values) else np.zeros(len(at), bool)
        return at[ok], k[ok]


def _shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the shingle at each word and the document there, without those that leave the document."""
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    g = grams(words.hash, size)
    same = doc[: len(g)] == doc[size - 1:] if len(g) else np.zeros(0, bool)
    return np.where(same, g, np.uint64(0)), doc


def _counted(batches, block: _Block, text: str):
    """Documents per shingle of the block, summed over each batch."""
    look = _Lookup(block.shingles)
    for batch in batches:
        texts = batch.column(text).to_pylist()
        total = np.zeros(len(block.shingles), np.int64)
        for a, b in slices(texts):
            words = Words(texts[a:b])
            found = []
            for size in block.sizes:
                g, doc = _shingles(words, size)
                at, k = look.find(g)
                found.append(doc[at] * np.int64(len(block.shingles)) + k)
            total += np.bincount(np.unique(np.concatenate(found)) % len(block.shingles), minlength=len(block.shingles))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["shingle", "n"])


def _occurrences(words: Words, block: _Block, look: _Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and window of every occurrence."""
    docs, starts, wins = [], [], []
    count = np.diff(np.append(np.flatnonzero(np.r_[True, block.key[1:] != block.key[:-1]]), len(block.key))) if len(block.key) else np.zeros(0, int)
    run = np.zeros(len(block.key), np.int64)
    if len(block.key):
        run[np.r_[True, block.key[1:] != block.key[:-1]]] = count
    for size in block.sizes:
        g, doc = _shingles(words, size)
        at, k = look.find(g)
        n = run[k]
        at = np.repeat(at, n)
        entry = np.repeat(k, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        w = block.which[entry]
        start = at - block.offset[entry]
        ok = (block.size[w] == size) & (start >= 0)
        d, w, start = doc[at[ok]], w[ok], start[ok]
        ok = (start >= words.first[d]) & (start + block.length[w] <= words.first[d + 1])
        d, w, start = d[ok], w[ok], start[ok]
        for j in range(int(block.length[w].max()) if len(w) else 0):
            inside = j < block.length[w]
            ok = ~inside
            ok[inside] = words.hash[start[inside] + j] == block.hash[block.first[w[inside]] + j]
            d, w, start = d[ok], w[ok], start[ok]
        ok = np.array([all(words.word(s + j) == x for j, x in enumerate(block.windows[i])) for s, i in zip(start.tolist(), w.tolist(), strict=True)], bool)
        docs.append(d[ok])
        starts.append(start[ok])
        wins.append(w[ok])
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (docs, starts, wins))


def _runs(covered: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _matched(batches, block: _Block, text: str, names: list[str], first: bool):
    look = _Lookup(block.key)
    for batch in batches:
        texts = batch.column(text).to_pylist()
        n_words, spans, items = np.zeros(len(texts), np.int64), [[] for _ in texts], [[] for _ in texts]
        if not first:
            spans, items = (batch.column(batch.schema.names.index(n)).to_pylist() for n in names[1:])
        for a, b in slices(texts):
            words = Words(texts[a:b])
            n_words[a:b] = np.diff(words.first)
            docs, starts, wins = _occurrences(words, block, look)
            for d in np.unique(docs).tolist():
                mine = docs == d
                edge = np.zeros(int(n_words[a + d]) + 1, np.int64)
                at, w = starts[mine] - words.first[d], wins[mine]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + block.length[w], -1)
                covered = np.cumsum(edge)[:-1] > 0
                for s in spans[a + d]:
                    covered[s["start"]:s["end"]] = True
                spans[a + d] = _runs(covered)
                items[a + d] = sorted({i for k in set(w.tolist()) for i in block.items[k]} | set(items[a + d]))
        keep = [c for c in batch.schema.names if c not in names]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.names.index(c)) for c in keep), pa.array(n_words), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
            names=[*keep, *names],
        )


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, block key, words) of every window; items without words have none."""
    schema = "item string, words array<binary>"

    def run(batches):
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            words = Words(texts)
            out_i, out_w = [], []
            for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                own = [words.word(k) for k in range(a, b)]
                for k in range(max(len(own) - window, 0) + 1 if own else 0):
                    out_i.append(names[i])
                    out_w.append(own[k:k + window])
            yield pa.RecordBatch.from_arrays([pa.array(out_i, pa.string()), pa.array(out_w, pa.list_(pa.binary()))], names=["item", "words"])

    return benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")).mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with n_words, hit_spans (runs of hit words) and hit_items (ids as strings, sorted)."""
    spark = docs.sparkSession
    arrow_bounds(spark)
    names = []
    for wish in ("n_words", "hit_spans", "hit_items"):
        names.append(distinct_name([*docs.columns, *names], wish))
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], _SPAN), T.StructField(names[2], T.ArrayType(T.StringType(), False))])
    table = windows(benchmark, item_id, item_text, window)
    n_blocks = max(1, -(-table.count() // block_windows))
    out = docs
    for b in range(n_blocks):
        mine = table if n_blocks == 1 else table.where(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == b)
        block = _Block([(r["item"], [bytes(w) for w in r["words"]]) for r in mine.collect()])  # about block_windows at most
        counts = {}
        if len(block.shingles):
            sent = spark.sparkContext.broadcast(block)
            found = docs.select(F.col(text).alias("text")).mapInArrow(lambda it, sent=sent: _counted(it, sent.value, "text"), "shingle long, n long")
            counts = {r[0]: r[1] for r in found.groupBy("shingle").agg(F.sum("n").alias("n")).collect()}  # one row a shingle of the block
        block.order(counts)
        ready = spark.sparkContext.broadcast(block)
        out = out.mapInArrow(lambda it, ready=ready, b=b: _matched(it, ready.value, text, names, b == 0), schema)
    return out


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("n_words"), n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


QUERIES = {"op10_decontaminate": op10_decontaminate}
SQL = {
    "op10_decontaminate": r"""
WITH bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 10) AS m, list_aggregate(w[k:k + 9], 'string_agg', ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM bw WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
occ AS (
  SELECT DISTINCT d.doc_id, d.k, d.m, win.item_id
  FROM (SELECT doc_id, k, m, list_aggregate(w[k:k + m - 1], 'string_agg', ' ') AS g
        FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM dw, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)) d
  JOIN win ON win.g = d.g AND win.m = d.m),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
