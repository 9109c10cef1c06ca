"""Shared plumbing of the llm operators: inputs, lineage cuts, vectorised word hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.store import forget, shared_dir, stored  # noqa: F401  (for the other modules)

#: UTF-8 bytes are hashed in slices of about this size, which bounds the memory of a Python worker.
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_bounds(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts may hold 100 kB each and workers have a few hundred MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], count: str, share: int = 1000) -> DataFrame:
    """``rows`` joined to ``table`` (one row a key), whose column ``count`` tells how many rows each key has.

    Keys with more than one in ``share`` of the counted rows are fewer than ``share``: those are broadcast, and what
    is shuffled has no larger group.  Both tables are read twice, so they should be stored.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    large = F.col(count) * share > total
    heavy = F.broadcast(table.where(large))
    hot = rows.join(heavy, on)
    cold = rows.join(heavy.select(*on), on, "left_anti").join(table.where(~large), on)
    return hot.unionByName(cold)


def distinct_name(columns: list[str], wish: str) -> str:
    """A column name that clashes with none of the given ones (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


# --- a bitmap of hashed ids: which rows can be left out of a shuffle ---------------------------

#: 8 MB of bits, whatever the number of ids.  It fills up as ids grow in number; then fewer rows are left out.
BITMAP = 1 << 26


def id_bit(column: str) -> Column:
    """The id's bit."""
    return F.pmod(F.xxhash64(column), F.lit(BITMAP))


def id_bitmap(ids: DataFrame, column: str) -> Broadcast:
    """The bits of all ids, broadcast."""
    return bitmap(ids.select(id_bit(column).alias("h")))


def bitmap(bits: DataFrame) -> Broadcast:
    """The bits (column h, 0 to BITMAP - 1), broadcast; built by partial bitmaps, of which the driver gets 2048 at most."""
    parts = bits.groupBy(F.expr("bitmap_bucket_number(h)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("bits")).collect()
    out = np.zeros(BITMAP // 8 + 4096, np.uint8)
    for k, found in parts:  # bucket 1 holds the bits 1 to 32768, bucket 0 bit 0
        out[max(k - 1, 0) * 4096:max(k, 1) * 4096] |= np.frombuffer(found, np.uint8)
    return bits.sparkSession.sparkContext.broadcast(out)


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which bits are set."""
    h = np.maximum(h - 1, 0)
    return (bits[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)


def by_bitmap(df: DataFrame, bit: str, bitmap: Broadcast, inside: bool) -> DataFrame:
    """Rows of ``df`` whose id_bit (in column ``bit``) is set, or the others."""

    def run(batches):
        for batch in batches:
            hit = in_bitmap(bitmap.value, np.asarray(batch.column(batch.schema.names.index(bit))))
            yield batch.filter(pa.array(hit == inside))

    return df.mapInArrow(run, df.schema)


# --- words -----------------------------------------------------------------------------------

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        row = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        row[0] = 1
        have = _powers[base] = np.multiply.accumulate(row)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of uint64 (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of bytes; span_hash() turns two of them into the hash of a span."""
    return prefix_sums(_BYTE[buf])


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """The same of any symbols, given as scattered 64-bit numbers."""
    sums = np.empty(len(symbols) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(symbols * _power(_BASE, len(symbols)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes in [start, end), the same wherever they stand."""
    rolled = (sums[ends] - sums[starts]) * _power(_INVERSE, len(sums))[starts]
    return mix(rolled + (ends - starts).astype(np.uint64) * np.uint64(_INVERSE))


class Words:
    """The words of several texts, lower-cased in A-Z: digits, letters and all of U+0080 on, or the bytes told.

    ``buf`` holds the lower-cased bytes, ``start``/``end`` the byte span of each word, ``hash`` its
    64-bit hash, ``first`` the index of each text's first word (one more entry than texts).
    """

    def __init__(self, texts: list[str | bytes | None], word: np.ndarray = _WORD, fold: np.ndarray = _LOWER):
        raw = [b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
        self.buf = fold[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
        inside = np.zeros(len(self.buf) + 1, np.int8)
        inside[1:] = word[self.buf]
        edge = np.diff(inside)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.hash = span_hash(prefix_hash(self.buf), self.start, self.end)
        at = np.cumsum([0, *(len(r) + 1 for r in raw)])
        self.first = np.searchsorted(self.start, at)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i]:self.end[i]].tobytes()


def slices(texts: list[str | None], limit: int = SLICE_BYTES):
    """Index ranges of consecutive texts of about ``limit`` characters; a longer text stands alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hash of each run of n hashes; empty where there are fewer."""
    m = len(hashes) - n + 1
    if m <= 0:
        return hashes[:0]
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total = (total + hashes[k:k + m]) * np.uint64(_BASE)
    return mix(total)
