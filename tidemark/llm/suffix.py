"""Removal of repeated byte strings with a column-wise suffix-array construction.

A byte is removed if it lies in a string of WINDOW bytes that also starts anywhere else, in the same
document or another.  Three steps:

1. Candidates.  A window's anchor is its smallest-hashed K-gram (the leftmost on a tie), which depends on
   the window's content only, so equal windows have equal anchors.  Successive windows with one anchor
   form a fragment, every window lies in exactly one, and (anchor, hash of the fragment) is counted over
   all documents.  Anchors that occur once hold no repeated window.  A fragment that occurs twice is
   repeated whole.

2. Construction.  The distinct fragments of anchors with several of them are collections for the
   column-wise construction.  A symbol is a block of BLOCK bytes and a fragment enters as its BLOCK
   shifted symbol sequences, so each byte offset starts one suffix and a window is WINDOW/BLOCK symbols.
   Each round inserts one symbol of each sequence, from the right: the rank of the new suffix follows
   from the rank of the suffix it extends and its first symbol (LF mapping), and the common prefixes next
   to the insertions are taken from those of the suffixes extended.  The Burrows-Wheeler transform is kept
   sorted, as pairs (symbol, place of the suffix that it precedes): the number of pairs below a new one is
   the new suffix's rank, which is what the mapping asks of the transform.  Bytes as symbols would need as
   many rounds as the longest text has bytes, each with a pass over all that came before; blocks and
   fragments need about 16.  Runs of common prefixes of a window or more are the repeats.  Collections hold
   about COLLECTION bytes; they are built in a task from the shuffle's sorted files, and a whole collection
   is passed over in each round.

3. Cut.  Spans are joined to their documents and cut out.  Documents without spans are not shuffled: a
   bitmap of hashed ids (8 MB at any size of input) tells most of them apart.

An anchor with more than HOT distinct fragments is no collection: its windows are counted one by one, with
a map-side sum.

Besides, passages of more than 50 words that another document has too are reported (and not removed: many have
fewer bytes than a window).  The first step does the same with words, as common.Words gives them, for windows of
PASSAGE words; the windows of fragments that are not repeated whole are counted.

Texts are UTF-8 bytes, null is empty; shorter texts than WINDOW keep all.  Repeated rows are repeats of
each other, but for passages rows with one id (or with none and one text) are one document.  Null ids are kept.
An empty table gives an empty table.  Rows are told apart by id and a hash of the text.  Columns of any name pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import _BYTE, _INVERSE, Words, _power, arrow_bounds, by_bitmap, distinct_name, id_bit, id_bitmap, mix, prefix_hash, prefix_sums, read, slices, span_hash, stored

WINDOW, K, BLOCK = 400, 160, 40
#: The same in words, for passages.
PASSAGE, PASSAGE_K = 51, 20
COLLECTION = 2_000_000
HOT = 8192
#: Buckets of fragments whose windows are counted: of bytes, of words.
_HOT_BYTES, _WORDS = -1, -2
_PIECE = 4 << 20
_SHIFT = np.uint64(24)
#: Anchors of words are other numbers than those of bytes.
_WORD_SALT = np.uint64(0x5851F42D4C957F2D)


def fragments(symbols: np.ndarray, ends: np.ndarray, window: int = WINDOW, k: int = K):
    """(anchor, fragment hash, first start, starts) of all fragments; texts end before the symbols at ``ends``."""
    w = window - k + 1
    n_grams = len(symbols) - k + 1
    m = n_grams - w + 1
    if m <= 0:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    sums = prefix_sums(symbols)
    gram = mix((sums[k:] - sums[:-k]) * _power(_INVERSE, len(sums))[:n_grams])
    value = gram >> _SHIFT << _SHIFT | np.arange(n_grams, dtype=np.uint64)
    rows = np.concatenate([value, np.full(-n_grams % w, np.uint64(2**64 - 1))]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(rows, axis=1).ravel()
    least = np.minimum(ahead[:m], behind[w - 1:w - 1 + m])
    start = np.flatnonzero(np.arange(m) + window <= ends[np.searchsorted(ends, np.arange(m))])
    at = (least[start] & np.uint64((1 << 24) - 1)).astype(np.int64)
    if not len(start):
        return gram[:0], gram[:0], start, start
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    low, high = start[first], start[np.append(first[1:], len(start)) - 1]
    return gram[at[first]], span_hash(sums, low, high + window), low, high - low + 1


def _packed(rows: list[tuple[int, bytes]], limit: int = 1 << 20):
    """(row of each text, joined bytes, text ends, offset in its text): several texts at once, long ones in pieces."""
    group, size = [], 0
    for i, b in rows:
        for a in range(0, max(len(b) - WINDOW + 1, 0), _PIECE):
            piece = b[a:a + _PIECE + WINDOW - 1]
            if group and size + len(piece) > limit:
                yield group
                group, size = [], 0
            group.append((i, a, piece))
            size += len(piece)
    if group:
        yield group


def _word_symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, text ends): the words of several texts, each text followed by a mark."""
    words = Words(texts)
    return np.insert(mix(words.hash), words.first[1:], _WORD_SALT), words.first[1:] + np.arange(len(texts))


def _found(batches):
    """Fragments of each document, of bytes and of words. Columns: doc, tag, text."""
    for batch in batches:
        docs, tags = (np.asarray(batch.column(c)) for c in (0, 1))
        texts = [(i, t) for i, t in enumerate(batch.column(2).to_pylist()) if t]

        def table(found, ends, row, offset, words, docs=docs, tags=tags):
            anchor, own, low, n = found
            which = np.searchsorted(ends, low)
            low = low - np.concatenate([[0], ends[:-1] + 1])[which] + offset[which]
            row = row[which]
            return pa.RecordBatch.from_arrays([pa.array((anchor ^ _WORD_SALT if words else anchor).view(np.int64)), pa.array(own.view(np.int64)), pa.array(docs[row]), pa.array(tags[row]), pa.array(low), pa.array(n.astype(np.int32)), pa.array(np.full(len(low), words))], names=["a", "f", "doc", "tag", "low", "n", "words"])

        for group in _packed([(i, t.encode("utf-8", "surrogatepass")) for i, t in texts if len(t) * 4 >= WINDOW]):
            buf = np.frombuffer(b"\n".join(p for _, _, p in group) + b"\n", np.uint8)
            ends = np.cumsum([len(p) + 1 for _, _, p in group]) - 1
            yield table(fragments(_BYTE[buf], ends), ends, *(np.array([g[k] for g in group]) for k in (0, 1)), False)
        for a, b in slices([t for _, t in texts]):
            symbols, ends = _word_symbols([t for _, t in texts[a:b]])
            yield table(fragments(symbols, ends, PASSAGE, PASSAGE_K), ends, np.array([i for i, _ in texts[a:b]]), np.zeros(b - a, np.int64), True)


def repeated_starts(frags: list[bytes], n_starts: list[int], window: int = WINDOW, block: int = BLOCK) -> list[np.ndarray]:
    """Which of each fragment's windows also start elsewhere in the collection (column-wise construction)."""
    deep = window // block
    buf = np.frombuffer(b"".join(frags), np.uint8)
    base = np.cumsum([0, *map(len, frags)])
    sums = prefix_hash(buf)
    # Symbol sequences: fragment, residue; symbol i stands at byte begin + i * block.
    begin, length = [], []
    for b, n in zip(base[:-1].tolist(), n_starts, strict=True):
        r = np.arange(min(block, n))
        begin.append(b + r)
        length.append((n - 1 - r) // block + deep)
    begin, length = np.concatenate(begin), np.concatenate(length)
    order = np.argsort(-length, kind="stable")  # so that the active sequences are a prefix
    begin, length = begin[order], length[order]
    n_seq = len(begin)
    offsets = np.repeat(begin, length) + block * (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))
    symbol = np.unique(span_hash(sums, offsets, offsets + block), return_inverse=True)[1].astype(np.int64)
    seat = np.cumsum(length) - length

    # The transform, sorted: each suffix after the n_seq empty ones has its first symbol and the place of the
    # suffix that this symbol precedes.
    lead, tail = np.empty(0, np.int32), np.empty(0, np.int64)
    lcp = np.zeros(n_seq, np.int16)  # common prefix with the suffix before, up to ``deep``
    own = np.empty(0, np.int64)  # byte offset of each suffix
    place = np.arange(n_seq)
    for round_ in range(1, int(length.max()) + 1):
        active = int(np.searchsorted(-length, -round_, side="right"))
        source = place[:active]
        at = seat[:active] + length[:active] - round_
        new = symbol[at]
        key = new << 32 | source
        rank = np.argsort(key)
        key, source, at = key[rank], source[rank], at[rank]
        slot = np.searchsorted(lead.astype(np.int64) << 32 | tail, key) + np.arange(active)
        size = len(lead) + active
        fresh = np.zeros(size, bool)
        fresh[slot] = True
        kept = np.flatnonzero(~fresh)

        def merged(old, inserted):
            out = np.empty(size, old.dtype)
            out[kept], out[slot] = old, inserted
            return out

        lead, tail, own = merged(lead, new[rank]), merged(tail, source), merged(own, offsets[at])
        # Common prefixes of the pairs that an insertion touches: 1 + the least one between the tails.
        pair = np.flatnonzero(fresh | np.r_[False, fresh[:-1]])
        pair = pair[pair > 0]
        pair_same = pair[lead[pair] == lead[pair - 1]]
        low, high = tail[pair_same - 1], tail[pair_same]
        depth = np.ones(len(pair_same), np.int16)
        for t in range(1, deep):
            short = np.cumsum(lcp < t, dtype=np.int32)
            depth += short[low] == short[high]
        fresh_lcp = merged(lcp[n_seq:], 0)
        fresh_lcp[pair] = 0
        fresh_lcp[pair_same] = depth
        lcp = np.concatenate([np.zeros(n_seq, np.int16), fresh_lcp])
        moved = np.concatenate([np.arange(n_seq), n_seq + kept])
        tail = moved[tail]
        place[:active][rank] = n_seq + slot
    full = lcp[n_seq:] >= deep
    hit = full | np.r_[full[1:], False]
    out = [np.zeros(n, bool) for n in n_starts]
    found = own[hit]
    which = np.searchsorted(base, found, side="right") - 1
    for i in np.unique(which).tolist():
        out[i][found[which == i] - base[i]] = True
    return out


def _ranges(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _cut_out(batches):
    """The wanted fragments' bytes, or the hashes of their windows of words. Columns: text, doc, tag, wanted (a, n, low, alone, bucket)."""
    for batch in batches:
        out = []
        for text, doc, tag, wanted in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            passages = None
            if any(x["bucket"] == _WORDS for x in wanted):
                sums = prefix_sums(_word_symbols([text])[0])
                start = np.arange(max(len(sums) - 1 - PASSAGE, 0))
                passages = span_hash(sums, start, start + PASSAGE)
            for x in wanted:
                low, n = x["low"], x["n"]
                part = passages[low:low + n].tobytes() if x["bucket"] == _WORDS else raw[low:low + n + WINDOW - 1]
                out.append((x["bucket"], x["a"], doc, tag, low, n, x["alone"], part))
                if len(out) >= 5000:
                    yield _batch(out)
                    out = []
        yield _batch(out)


_FRAGMENT = [("bucket", pa.int64()), ("a", pa.int64()), ("doc", pa.int64()), ("tag", pa.int32()), ("low", pa.int64()), ("n", pa.int32()), ("alone", pa.bool_()), ("frag", pa.binary())]
_FRAGMENTS = "bucket long, a long, doc long, tag int, low long, n int, alone boolean, frag binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_FRAGMENT)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FRAGMENT, strict=True)], names=[n for n, _ in _FRAGMENT])


def _built(batches):
    """Collections, sorted by bucket, to the spans of window starts that are repeated."""
    key, rows = None, []

    def done():
        if not rows:
            return
        hits = repeated_starts([r[7] for r in rows], [r[5] for r in rows])
        out = [(doc, tag, low + a, b - a) for (_, _, doc, tag, low, _, alone, _), hit in zip(rows, hits, strict=True) if alone for a, b in _ranges(hit)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], names=["doc", "tag", "low", "n"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(len(_FRAGMENT))), strict=True):
            if row[0] != key:
                yield from done()
                key, rows = row[0], []
            rows.append(row)
    yield from done()


def _windows(batches):
    """Hash of every window of the fragments of hot anchors and of words, a record batch at a time."""
    for batch in batches:
        bucket, a, doc, tag, low, n = (np.asarray(batch.column(k)) for k in range(6))
        words = bucket == _WORDS
        hashes = []
        for frag, size, hashed in zip(batch.column(7).to_pylist(), n.tolist(), words.tolist(), strict=True):
            if hashed:
                hashes.append(np.frombuffer(frag, np.uint64))
            else:
                s = np.arange(size)
                hashes.append(span_hash(prefix_hash(np.frombuffer(frag, np.uint8)), s, s + WINDOW))
        w = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        at = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
        columns = [np.repeat(a, n), w.view(np.int64), *(np.repeat(x, n) for x in (doc, tag)), np.repeat(low, n) + at, np.repeat(words, n)]
        for k in range(0, len(w), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[k:k + (1 << 16)]) for x in columns], names=["a", "w", "doc", "tag", "low", "words"])


def _again(rows: DataFrame, *by: str, **more) -> DataFrame:
    """Groups of bytes that occur twice, of words those in two documents."""
    found = rows.groupBy(*by).agg(F.count("*").alias("c"), F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.max("words").alias("words"), *(x.alias(k) for k, x in more.items()))
    return found.where(F.when(F.col("words"), F.col("d0") != F.col("d1")).otherwise(F.col("c") > 1))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(spans, keyed documents): the repeated windows' starts [low, low + n), of bytes or of words; and doc, tag, h and the row.

    Tables that are joined are stored before: two plain tables can be dealt anew where a key has many rows.
    """
    spark = docs.sparkSession
    arrow_bounds(spark)
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text)).alias("doc"), F.hash(text).alias("tag"))
    keyed = keyed.withColumn("h", id_bit("doc"))
    body = F.col("row")[text]
    rows = stored(keyed.select("doc", "tag", body.alias("body")).where(F.octet_length("body") >= min(WINDOW, 2 * PASSAGE - 1)).mapInArrow(_found, "a long, f long, doc long, tag int, low long, n int, words boolean"))
    anchors = stored(_again(rows, "a", f0=F.min("f"), f1=F.max("f")).select(F.col("a").alias("b"), (F.col("f0") != F.col("f1")).alias("mixed")))
    several = stored(rows.join(anchors, F.col("a") == F.col("b")).drop("b"))
    span = ["doc", "tag", "low", "n", "words"]
    whole = several.where("not mixed").select(span)

    mixed = several.where("mixed and not words")
    kinds = stored(mixed.groupBy("a", "f").agg(F.count("*").alias("c"), F.min(F.struct("doc", "tag", "low", "n")).alias("at")))
    twice = mixed.join(kinds.where("c > 1").select("a", "f"), ["a", "f"]).select(span)
    per = stored(kinds.groupBy("a").agg(F.count("*").alias("kinds")))
    total = kinds.agg(F.sum(F.col("at.n") + (WINDOW - 1)).alias("s")).first()["s"] or 0
    buckets = max(1, -(-total // COLLECTION))
    wanted = kinds.join(per, "a").select(
        "at.doc", "at.tag", "at.low", "at.n", (F.col("c") == 1).alias("alone"), "a",
        F.when(F.col("kinds") > hot, _HOT_BYTES).otherwise(F.when(F.col("kinds") > hot // 4, F.xxhash64("a").bitwiseOR(F.lit(1 << 62)).bitwiseAND(F.lit((1 << 63) - 1))).otherwise(F.pmod(F.xxhash64("a"), F.lit(buckets)))).cast("long").alias("bucket"))
    wanted = wanted.unionByName(several.where("mixed and words").select("doc", "tag", "low", "n", F.lit(True).alias("alone"), "a", F.lit(_WORDS).cast("long").alias("bucket")))
    per_doc = stored(wanted.groupBy("doc", "tag").agg(F.collect_set(F.struct("low", "n", "alone", "bucket", "a")).alias("wanted")))
    near = id_bitmap(per_doc, "doc")
    texts = by_bitmap(keyed.select("doc", "tag", body.alias("body"), "h"), "h", near, True).dropDuplicates(["doc", "tag"])
    frags = stored(texts.join(per_doc, ["doc", "tag"]).select("body", "doc", "tag", "wanted").mapInArrow(_cut_out, _FRAGMENTS))
    built = frags.where("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_built, "doc long, tag int, low long, n int")
    counted = frags.where("bucket < 0").mapInArrow(_windows, "a long, w long, doc long, tag int, low long, words boolean")
    single = counted.join(stored(_again(counted, "a", "w").select("a", "w")), ["a", "w"]).select("doc", "tag", "low", F.lit(1).alias("n"), "words")
    out = whole
    for part in (twice, built.withColumn("words", F.lit(False)), single):  # each its own job: a hot key of one is seen and split
        out = out.unionByName(stored(part))
    return out, keyed


def _runs(low: np.ndarray, n: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal runs (start, end) covered by windows that start in the spans [low, low + n)."""
    if not len(low):
        return []
    order = np.argsort(low)
    low, end = low[order], np.maximum.accumulate((low + n)[order] + window - 1)
    first = np.flatnonzero(np.r_[True, low[1:] > end[:-1]])
    return list(zip(low[first].tolist(), end[np.append(first[1:], len(low)) - 1].tolist(), strict=True))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """``docs`` with ``kept`` (the remaining bytes), ``removed`` (maximal removed runs, start and end in bytes) and ``passages`` (runs of words that other documents have too)."""
    names = []
    for wish in ("kept", "removed", "passages"):
        names.append(distinct_name([*docs.columns, *names], wish))
    spans, keyed = repeats(docs, doc_id, text, hot)
    columns = docs.columns
    per_doc = stored(spans.groupBy("doc", "tag").agg(F.collect_set(F.struct("low", "n", "words")).alias("cuts")))
    near = id_bitmap(per_doc, "doc")
    runs = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]), False)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.BinaryType()), T.StructField(names[1], runs), T.StructField(names[2], runs)])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            row, cuts = batch.column(0), batch.column(1)
            flat = cuts.flatten()
            low, n, words = (np.asarray(flat.field(k)) for k in range(3))
            ends = np.cumsum(cuts.value_lengths().fill_null(0).to_numpy())
            outs, gone, said = [], [], []
            for t, a, b in zip(row.field(text).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                mine, hits = slice(a, b), words[a:b]
                found = _runs(low[mine][~hits], n[mine][~hits], WINDOW)
                at, parts = 0, []
                for start, end in found:
                    parts.append(raw[at:start])
                    at = end
                outs.append(b"".join([*parts, raw[at:]]))
                gone.append([{"start": x, "end": y} for x, y in found])
                said.append([{"start": x, "end": y} for x, y in _runs(low[mine][hits], n[mine][hits], PASSAGE)])
            yield pa.RecordBatch.from_arrays([*(row.field(c) for c in columns), pa.array(outs, pa.binary()), pa.array(gone, kind), pa.array(said, kind)], names=[*columns, *names])

    hit = by_bitmap(keyed, "h", near, True).join(per_doc, ["doc", "tag"], "left").select("row", "cuts").mapInArrow(run, schema)
    clean = by_bitmap(keyed, "h", near, False).select("row.*", F.coalesce(F.col("row")[text], F.lit("")).cast("binary").alias(names[0]), *(F.array().cast(runs).alias(n) for n in names[1:]))
    return hit.unionByName(clean)


def op7_suffix(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
        F.aggregate("passages", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"]).alias("n_repeated_words"),
    )


QUERIES = {"op7_suffix": op7_suffix}
SQL: dict[str, str] = {}
