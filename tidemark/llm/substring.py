"""Removal of word sequences that occurred before, by suffix automata of reference shards.

A word is removed if a window of WINDOW consecutive words of one document covers it whose sequence also starts
earlier: in a document of a smaller id, or in the same one before.

A broadcast of every shard's automaton past all documents would cost shards x documents, so each piece of a
document goes to the one shard that can hold its match:

1. A window's anchor is its smallest-hashed K-gram of words (the leftmost on a tie), so equal windows have equal
   anchors.  Successive windows with one anchor form a fragment.  Anchors that occur once hold no repeated
   window.  Of equal fragments the first stays and all windows of the others are repeats.

2. The different fragments of an anchor go, by the anchor's hash, to a shard of about SHARD words.  A task streams a
   shard's fragments in the order of the documents past the shard's automaton, for matching statistics: the
   longest suffix read so far that is a substring of an earlier fragment.  Where it has WINDOW words or more a
   repeated window ends.  Then the automaton takes the fragment in.  Its symbols are the words themselves.
   Anchors with more than HOT different fragments would fill a task: their windows are counted instead, by
   anchor and hash of the window, with a map-side minimum.

3. Spans are joined to their documents and the words cut out.  Documents without spans are not shuffled: a bitmap of
   hashed ids tells most of them apart.

Words are runs of all but space and the control characters U+0009 to U+000D, case kept.  Null and empty texts have
no words; texts of fewer than WINDOW words keep all.  Rows with a null id come after all others, in the order of a
hash of their text; rows of one id are ordered by a hash of their text, and rows that are the same in id and text
count as one document and have the same result.  An empty table gives an empty one.  Columns of any name pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Words, arrow_bounds, by_bitmap, distinct_name, id_bit, id_bitmap, join_counted, mix, prefix_sums, read, slices, span_hash, stored
from .suffix import fragments

WINDOW, K = 20, 8
#: Words of a shard: its automaton has up to twice as many states, of some 300 bytes each.
SHARD = 60_000
HOT = 2048
_PIECE = 1 << 22
_SEPARATE = np.uint64(0x5851F42D4C957F2D)
_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, *range(0x09, 0x0E)]] = False
_SAME = np.arange(256, dtype=np.uint8)


def symbols(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each word of several texts, each text followed by a mark; places of the marks)."""
    words = Words(texts, _INSIDE, _SAME)
    return np.insert(mix(words.hash), words.first[1:], _SEPARATE), words.first[1:] + np.arange(len(texts))


def _found(batches):
    """Fragments of each document. Columns: doc, tag, text."""
    for batch in batches:
        docs, tags = (np.asarray(batch.column(c)) for c in (0, 1))
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        for begin, end in slices(texts):
            all_symbols, marks = symbols(texts[begin:end])
            for a in range(0, len(all_symbols), _PIECE):  # a window lies in one piece, whatever the text's length
                part = all_symbols[a:a + _PIECE + WINDOW - 1]
                ends = np.append(marks[(marks >= a) & (marks < a + len(part))] - a, len(part))
                anchor, own, low, n = fragments(part, ends, WINDOW, K)
                which = np.searchsorted(marks, low + a)
                low = low + a - np.concatenate([[0], marks[:-1] + 1])[which]
                row = begin + which
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(own.view(np.int64)), pa.array(docs[row]), pa.array(tags[row]), pa.array(low), pa.array(n.astype(np.int32))], names=["a", "f", "doc", "tag", "low", "n"])


class Automaton:
    """Suffix automaton of several sequences of hashable symbols; states are lists side by side."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, at: int, symbol, below: int) -> int:
        """The state reached from ``at``, cut down to what ``at`` can spell."""
        moves, link, length = self.next, self.link, self.length
        if length[below] == length[at] + 1:
            return below
        copy = self._state(length[at] + 1, link[below], dict(moves[below]))
        link[below] = copy
        while at >= 0 and moves[at].get(symbol) == below:
            moves[at][symbol] = copy
            at = link[at]
        return copy

    def add(self, sequence) -> None:
        moves, link, length = self.next, self.link, self.length
        last = 0
        for symbol in sequence:
            below = moves[last].get(symbol)
            if below is not None:  # another sequence has this already
                last = self._split(last, symbol, below)
                continue
            new, at = self._state(length[last] + 1, 0, {}), last
            while at >= 0 and symbol not in moves[at]:
                moves[at][symbol] = new
                at = link[at]
            if at >= 0:
                link[new] = self._split(at, symbol, moves[at][symbol])
            last = new

    def matches(self, sequence) -> list[int]:
        """Matching statistics: the length of the longest suffix of each prefix that the automaton holds."""
        moves, link, length = self.next, self.link, self.length
        at = have = 0
        out = []
        for symbol in sequence:
            while at and symbol not in moves[at]:
                at = link[at]
                have = length[at]
            below = moves[at].get(symbol)
            if below is not None:
                at, have = below, have + 1
            out.append(have)
        return out


def _cut_out(batches):
    """The words of the wanted fragments. Columns: text, doc, tag, wanted (low, n, a, bucket)."""
    for batch in batches:
        out, size = [], 0
        for text, doc, tag, wanted in zip(batch.column(0).cast(pa.binary()).to_pylist(), *(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
            words = text.split()  # of bytes: at the same six characters
            for x in wanted:
                part = b" ".join(words[x["low"]:x["low"] + x["n"] + WINDOW - 1])
                out.append((x["bucket"], x["a"], doc, tag, x["low"], x["n"], part))
                size += len(part)
                if size > 1 << 21:
                    yield _fragments(out)
                    out, size = [], 0
        yield _fragments(out)


_FRAGMENT = [("bucket", pa.int64()), ("a", pa.int64()), ("doc", pa.int64()), ("tag", pa.int32()), ("low", pa.int64()), ("n", pa.int32()), ("words", pa.binary())]
_SPANS = "doc long, tag int, low long, n int"


def _fragments(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_FRAGMENT)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FRAGMENT, strict=True)], names=[n for n, _ in _FRAGMENT])


def _streamed(batches):
    """Shards, sorted by bucket and document, to the spans of window starts that occur in an earlier fragment."""
    key, automaton = None, Automaton()
    for batch in batches:
        out = []
        for bucket, _, doc, tag, low, _, words in zip(*(batch.column(c).to_pylist() for c in range(len(_FRAGMENT))), strict=True):
            if bucket != key:
                key, automaton = bucket, Automaton()
            sequence = words.split(b" ")
            start = None
            for k, have in enumerate([*automaton.matches(sequence)[WINDOW - 1:], 0]):
                if have >= WINDOW:
                    start = k if start is None else start
                elif start is not None:
                    out.append((doc, tag, low + start, k - start))
                    start = None
            automaton.add(sequence)
        columns = zip(*out, strict=True) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], names=["doc", "tag", "low", "n"])


def _windows(batches):
    """Hash of every window of the fragments of hot anchors."""
    for batch in batches:
        words = batch.column(6).to_pylist()
        a, doc, tag, low, n = (np.asarray(batch.column(k)) for k in range(1, 6))
        hashes = []
        for part, size in zip(words, n.tolist(), strict=True):
            sums, start = prefix_sums(symbols([part])[0][:-1]), np.arange(size)
            hashes.append(span_hash(sums, start, start + WINDOW))
        w = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        at = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
        columns = [np.repeat(a, n), w.view(np.int64), np.repeat(doc, n), np.repeat(tag, n), np.repeat(low, n) + at]
        for k in range(0, max(len(w), 1), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[k:k + (1 << 16)]) for x in columns], names=["a", "w", "doc", "tag", "low"])


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(spans, keyed documents): windows [low, low + n) that occur earlier; and doc, tag, h and the row.

    A document is (doc, tag): its id and a hash of its text, both in an order in which null ids come last.
    """
    spark = docs.sparkSession
    arrow_bounds(spark)
    none = F.col(doc_id).isNull()
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.when(none, F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF))).otherwise(F.hash(text)).cast("int").alias("tag"))
    keyed = keyed.withColumn("h", id_bit("doc"))
    body = F.col("row")[text]
    here = F.struct("doc", "tag", "low")
    rows = stored(keyed.select("doc", "tag", body.alias("body")).where(F.octet_length("body") >= 2 * WINDOW - 1).mapInArrow(_found, "a long, f long, doc long, tag int, low long, n int"))
    anchors = stored(rows.groupBy("a").agg(F.count("*").alias("c")).where("c > 1"))
    several = stored(join_counted(rows, anchors, ["a"], "c").drop("c"))
    kinds = stored(several.groupBy("a", "f").agg(F.count("*").alias("c"), F.min(F.struct("doc", "tag", "low", "n")).alias("first")))
    copied = join_counted(several, kinds.where("c > 1").select("a", "f", "c", F.struct("first.doc", "first.tag", "first.low").alias("first")), ["a", "f"], "c")
    span = ["doc", "tag", "low", "n"]
    parts = [copied.where(here != F.col("first")).select(span)]

    mixed = stored(kinds.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    several_kinds = stored(join_counted(kinds, mixed, ["a"], "kinds").select("a", "kinds", "first.*"))
    total = several_kinds.agg(F.sum(F.col("n") + (WINDOW - 1)).alias("s")).first()["s"] or 0
    shards = max(1, -(-total // SHARD))
    wanted = several_kinds.select("doc", "tag", "low", "n", "a", F.when(F.col("kinds") > hot, -1).otherwise(F.pmod(F.xxhash64("a"), F.lit(shards))).cast("long").alias("bucket"))
    per_doc = stored(wanted.groupBy("doc", "tag").agg(F.collect_list(F.struct("low", "n", "a", "bucket")).alias("wanted")))
    texts = by_bitmap(keyed.select("doc", "tag", body.alias("body"), "h"), "h", id_bitmap(per_doc, "doc"), True).dropDuplicates(["doc", "tag"])
    frags = stored(texts.join(per_doc, ["doc", "tag"]).select("body", "doc", "tag", "wanted").mapInArrow(_cut_out, "bucket long, a long, doc long, tag int, low long, n int, words binary"))
    parts.append(frags.where("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket", "doc", "tag", "low").mapInArrow(_streamed, _SPANS))
    counted = frags.where("bucket < 0").mapInArrow(_windows, "a long, w long, doc long, tag int, low long")
    earliest = stored(counted.groupBy("a", "w").agg(F.count("*").alias("c"), F.min(here).alias("first")).where("c > 1"))
    parts.append(join_counted(counted, earliest, ["a", "w"], "c").where(here != F.col("first")).select("doc", "tag", "low", F.lit(1).alias("n")))
    out = stored(parts[0])
    for part in parts[1:]:
        out = out.unionByName(stored(part))
    return out, keyed


def remove_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """``docs`` with ``kept`` (the remaining words joined by a space), ``n_words`` and ``removed`` (maximal runs of words, start and end)."""
    names = []
    for wish in ("kept", "n_words", "removed"):
        names.append(distinct_name([*docs.columns, *names], wish))
    spans, keyed = repeats(docs, doc_id, text, hot)
    columns = docs.columns
    cuts = stored(spans.groupBy("doc", "tag").agg(F.collect_set(F.struct("low", "n")).alias("cuts")))
    near = id_bitmap(cuts, "doc")
    runs = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]), False)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], runs)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            row = batch.column(0)
            kept, sizes, gone = [], [], []
            for t, found in zip(row.field(text).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (t or b"").split()
                merged = []
                for low, high in sorted((c["low"], c["low"] + c["n"] + WINDOW - 1) for c in found or ()):
                    if merged and low <= merged[-1]["end"]:
                        merged[-1]["end"] = max(high, merged[-1]["end"])
                    else:
                        merged.append({"start": low, "end": high})
                sizes.append(len(words))
                for m in reversed(merged):
                    del words[m["start"]:m["end"]]
                kept.append(b" ".join(words))
                gone.append(merged)
            yield pa.RecordBatch.from_arrays([*(row.field(c) for c in columns), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, kind)], names=[*columns, *names])

    hit = by_bitmap(keyed, "h", near, True).join(cuts, ["doc", "tag"], "left").select("row", "cuts")
    clean = by_bitmap(keyed, "h", near, False).select("row", F.lit(None).cast(hit.schema["cuts"].dataType).alias("cuts"))
    return hit.mapInArrow(run, schema).unionByName(clean.mapInArrow(run, schema))


def op13_substring(spark, sf_dir: str) -> DataFrame:
    out = remove_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op13_substring": op13_substring}
SQL = {"op13_substring": f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM again)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
"""}
