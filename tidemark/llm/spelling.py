"""Spelling variants of words, found by a rare-first q-gram prefix filter.

Words are counted over whole texts.  Two words are near if one code point inserted, deleted or replaced makes one
of the other.  Such an edit touches at most two bigrams of a word, so of the three rarest bigrams of either word,
in an order that is the same for all words, one is untouched in both and stands among the three of the other.

1. Bigrams are ordered by the number of words they occur in (ties by the bigram).  The alphabet has 90 letters,
   so there are 8,100 bigrams at most and the order is broadcast.

2. Each word is listed under its three rarest bigrams, with limits on their place: an untouched bigram leaves the
   whole edit after it or before it, so what stands on the other side is the same and lengths differ by one at
   most.  Where REST or more code points are left for the edit it is in one half of them, and the other half
   is the same too.  Length, case, bigram and what is the same make the key of the join, so that a common
   bigram at the start of words is no large group, and no pairs are made but of words that agree so far.

3. Pairs are verified by their edit distance, and each is kept once.

A word's form is the near word that is ``FACTOR`` times as frequent at least, the most frequent of those (ties: the
smallest in code-point order).  Roots follow forms by pointer doubling; counts grow by FACTOR with each step, so
there is no circle and the number of rounds is small.

Texts that are null or empty have no words; long texts are read whole.  A null id counts as an empty one in the
draw of deleted letters; repeated rows count as often as they occur.  An empty table gives no words.  Other
columns are not read, so their names don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .common import arrow_bounds, prefix_hash, read, span_hash, stored

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One of so many (document, word) pairs loses a letter.
DRAW = 31
FACTOR = 10
PREFIX = 3
REST = 4
#: Distinct words that a task gathers before it hands on their counts.
GATHERED = 300_000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def runs_counted(doc_id: int | None, text: bytes, least: int = LEAST_LENGTH, draw: int = DRAW) -> Counter:
    """Words of at least ``least`` letters of one text with their counts, after the deletion of drawn letters."""
    found = Counter(re.findall(f"[a-zÀ-ÿ]{{{least},}}", text.translate(_FOLD).decode("utf-8", "replace")))
    head = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    drawn = {word: h for word in found if (h := zlib.crc32(word.encode(), head)) % draw == 0}
    taken = [(word, h, found.pop(word)) for word, h in drawn.items()]
    for word, h, n in taken:
        at = h % len(word)
        if len(word) > least:
            found[word[:at] + word[at + 1:]] += n
    return found


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, draw: int = DRAW) -> DataFrame:
    """(word, n) of all words of ``least`` letters and ``least_count`` occurrences."""
    arrow_bounds(docs.sparkSession)

    def table(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        total = Counter()
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if t:
                    total.update(runs_counted(i, t, least, draw))
                if len(total) > GATHERED:
                    yield table(total)
                    total = Counter()
        yield table(total)

    rows = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- prefix filter ------------------------------------------------------------------------------

def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, joined; where each word begins and the last ends). All are below U+0100."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def bigram_counts(words: DataFrame) -> DataFrame:
    """(bigram, n): in how many words' places it occurs; a bigram is two code points as one number."""
    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            text, at = _letters(batch.column(0))
            pairs = text[:-1].astype(np.int64) << 8 | text[1:]
            inside = np.ones(len(pairs), bool)
            inside[at[1:-1] - 1] = False
            total += np.bincount(pairs[inside], minlength=1 << 16)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bigram", "n"])

    return words.select("word").mapInArrow(run, "bigram long, n long").groupBy("bigram").agg(F.sum("n").alias("n"))


def rarest(text: np.ndarray, at: np.ndarray, rank: np.ndarray, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray]:
    """(word, place) of the ``prefix`` bigrams of lowest rank of each word."""
    length = np.diff(at)
    n = np.maximum(length - 1, 0)
    word = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    start = at[word] + place
    order = np.lexsort((place, rank[text[start].astype(np.int64) << 8 | text[start + 1]], word))
    nth = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
    kept = order[nth < prefix]
    return word[kept], place[kept]


def keys(text: np.ndarray, at: np.ndarray, word: np.ndarray, place: np.ndarray, longer: bool) -> tuple[np.ndarray, np.ndarray]:
    """(word, key) under which words meet; ``longer``: as the word that has one letter more than the other.

    What is the same: the bigram with all before it (edit after it) or behind it (edit before it), and one half
    of the rest if that has REST letters or more in the shorter word.
    """
    sums = prefix_hash(text)
    low, high = at[word], at[word + 1]
    length = (high - low - longer).astype(np.uint64)
    out = []
    for side in (0, 1):
        fixed = (low, low + place + 2) if side == 0 else (low + place, high)
        begin, end = (fixed[1], high) if side == 0 else (low, fixed[0])
        m = end - begin - longer
        base = span_hash(sums, *fixed) + length * np.uint64(2) + np.uint64(side)
        half = m // 2
        for part in (0, 1):  # the same half: the first, the second, or none of a short rest
            a, b = (begin, begin + half) if part == 0 else (begin + half + longer, end)
            whole = m < REST
            chosen = (m >= (0 if part == 0 else REST))
            same = np.where(whole, np.uint64(0), span_hash(sums, np.where(chosen, a, low), np.where(chosen, b, low)) + np.uint64(part + 1))
            out.append((word[chosen], (base * np.uint64(0x9E3779B97F4A7C15) ^ same)[chosen]))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _listed(words: DataFrame, held: Broadcast, longer: bool) -> DataFrame:
    """(key, word, n) of all words under their keys; ``held``: the rank of each bigram."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            text, at = _letters(batch.column(0))
            which, key = keys(text, at, *rarest(text, at, held.value), longer)
            which = pa.array(which)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(which), batch.column(1).take(which)], names=["key", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each two near words once; ``words``: distinct words of 4 letters or more below U+0100, n."""
    order = bigram_counts(words).orderBy("n", "bigram").collect()  # 8,100 at most
    rank = np.zeros(1 << 16, np.int32)
    rank[[r["bigram"] for r in order]] = np.arange(len(order))
    held = words.sparkSession.sparkContext.broadcast(rank)
    even = _listed(words, held, False)
    right = even.unionByName(_listed(words, held, True)).select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    first = F.struct(F.char_length("word"), "word") < F.struct(F.char_length("other"), "other")
    met = even.join(right, "key").where(first).where(F.levenshtein("word", "other", 1) == 1)
    return met.select("word", "n", "other", "other_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) without circles: forms are followed to the last, by doubling."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def spelling_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of ``docs``."""
    words = stored(count_words(docs, doc_id, text))
    pairs = near_pairs(words)
    both = F.explode(F.array(F.struct("word", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))).alias("p")
    best = pairs.select(both).select("p.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    top = -F.col("best.minus")
    joined = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(top >= factor * F.col("n"), F.struct(F.col("best.other").alias("form"), top.alias("form_n"))).alias("f"))
    out = stored(joined.select("word", "n", "n_near", "f.form", "f.form_n"))
    last = roots(out.where("form is not null").select("word", "form"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op12_spelling": op12_spelling}
SQL: dict[str, str] = {}
