"""Phrase collocations: n-grams that occur together more often than their parts would.

1. Texts are split into pieces, and identical pieces of a language become one row with a multiplicity.  Pieces are
   deduplicated in each task before the shuffle.

2. N-grams are counted with those weights.  A task counts the n-grams of a few MB of pieces on exact word numbers;
   the partial counts go to hash buckets by language and phrase, and each bucket is counted out-of-core by duckdb,
   which spills beyond MEMORY to the folder that Spark gives a task for spills.  Single words and pairs come first.
   A phrase is not more frequent than its pairs, so triples and quadruples are counted only where all their
   pairs are frequent.  Which pairs are is told by a bitmap of their hashes (8 MB at any size of input); a pair that
   shares a bit with a frequent one only makes more to count.

3. Each candidate sends lookup requests for the parts of all its cuts; requests and counts meet by a shuffle on
   (language, part).  Parts asked for by a large share of all requests are broadcast, of which there can be few.

4. Each candidate tells the phrases inside it its frequency; those that are not frequent enough beside it go.  The
   first TOP of a language are found in two rounds, the first within hash groups, so that no task sorts a language.

Counts and scores are exact: sums in 64 bits, products and quotients as decimals of up to 38 digits.

Null and empty texts have no words, a null language is ``und``; long texts are read whole.  Repeated rows count as
often as they occur.  Ties in rank are broken by frequency and phrase, so there are none.  An empty table gives an
empty table.  Other columns are not read, so their names don't matter.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import BITMAP, arrow_bounds, bitmap, in_bitmap, join_counted, mix, prefix_hash, read, span_hash, stored

LEAST, LONGEST, TOP = 30, 4, 2000
SCALE, WITHIN = 2_000_000, 80
#: Bytes of pieces that a task counts at once; of a bucket's counts that duckdb holds in memory.
GATHER, MEMORY = 4 << 20, "200MB"
#: Hash groups of a language in the first round of ranking.
GROUPS = 128
_SPLIT = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])
_ROWS = "lang string, k int, phrase string, n long"


def split(text: bytes) -> list[bytes]:
    """The pieces of a text that have words, their words joined by one space."""
    return [p for raw in text.translate(_SPLIT).split(b"\n") if (p := b" ".join(raw.split()))]


def pieces(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, piece, m): identical pieces and their number."""
    def run(batches):
        for batch in batches:
            seen = defaultdict(Counter)
            for of, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                seen[of].update(split(t or b""))
            for of, found in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([of] * len(found), pa.string()), pa.array(found.keys(), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], names=["lang", "piece", "m"])

    rows = docs.select(F.coalesce(lang, F.lit("und")), F.col(text)).mapInArrow(run, "lang string, piece string, m long")
    return rows.groupBy("lang", "piece").agg(F.sum("m").alias("m"))


# --- counting -----------------------------------------------------------------------------------

def _gathered(batches):
    """Record batches joined to tables of about GATHER bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > GATHER:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _whole(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class Pieces:
    """The words of a table (lang, piece, m) as numbers: ``word``, ``lang``, ``m`` and ``row`` of each place."""

    def __init__(self, table: pa.Table):
        lists = _whole(pc.split_pattern(_whole(table.column(1)), " "))
        coded = _whole(lists.flatten()).dictionary_encode()
        langs = _whole(table.column(0)).dictionary_encode()
        self.words, self.langs = coded.dictionary, langs.dictionary
        self.row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
        self.word = np.asarray(coded.indices).astype(np.int64)
        self.lang = np.asarray(langs.indices).astype(np.int64)[self.row]
        self.m = np.asarray(_whole(table.column(2)))[self.row]
        self.pair = np.append(self.row[1:] == self.row[:-1], False) if len(self.row) else np.zeros(0, bool)

    def counted(self, at: np.ndarray, k: int, key: np.ndarray) -> pa.RecordBatch:
        """The ``k`` words from the places ``at`` on, equal where ``key`` is, with their weighted numbers."""
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(order) else order
        n = np.add.reduceat(self.m[at[order]], first) if len(order) else np.zeros(0, np.int64)
        places = at[order[first]]
        words = [self.words.take(pa.array(self.word[places + i])) for i in range(k)]
        phrase = pc.binary_join_element_wise(*words, " ") if k > 1 else words[0]
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(self.lang[places])), pa.array(np.full(len(n), k, np.int32)), phrase, pa.array(n)], schema=_COUNTS)

    def pair_keys(self, at: np.ndarray) -> np.ndarray:
        return (self.lang[at] * len(self.words) + self.word[at]) * len(self.words) + self.word[at + 1]


def hashes(texts: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)
    sums = prefix_hash(np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8))
    return span_hash(sums, np.r_[0, ends[:-1]].astype(np.int64), ends) if len(texts) else np.empty(0, np.uint64)


def pair_bits(lang: np.ndarray, first: np.ndarray, second: np.ndarray, room: int) -> np.ndarray:
    """The bit of a pair of words, from their hashes and that of their language."""
    return (mix(mix(lang * np.uint64(3) + first) + second) % np.uint64(room)).astype(np.int64)


def _short(batches):
    """Counts of single words (k 1), pairs (k 2) and of all words (k 0)."""
    for table in _gathered(batches):
        p = Pieces(table)
        total = np.zeros(len(p.langs), np.int64)
        np.add.at(total, p.lang, p.m)
        yield pa.RecordBatch.from_arrays([p.langs, pa.array(np.zeros(len(total), np.int32)), pa.array([""] * len(total)), pa.array(total)], schema=_COUNTS)
        every, pairs = np.arange(len(p.word)), np.flatnonzero(p.pair)
        yield p.counted(every, 1, p.lang * len(p.words) + p.word)
        yield p.counted(pairs, 2, p.pair_keys(pairs))


def _bucket(batches, least: int):
    """One hash bucket of partial counts, added up by duckdb; batches are handed on as they come."""
    import duckdb

    local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
    spill = tempfile.mkdtemp(prefix="counts-", dir=local)
    try:
        with duckdb.connect(":memory:", config={"memory_limit": MEMORY, "threads": 1, "temp_directory": spill, "preserve_insertion_order": False}) as con:
            incoming = pa.RecordBatchReader.from_batches(_COUNTS, (b.cast(_COUNTS) for b in batches))
            con.register("incoming", incoming)
            yield from con.execute(f"SELECT lang, k, phrase, sum(n)::BIGINT AS n FROM incoming GROUP BY ALL HAVING k = 0 OR sum(n) >= {int(least)}").to_arrow_reader(20_000)
    finally:
        shutil.rmtree(spill, ignore_errors=True)


def _added(parts: DataFrame, least: int) -> DataFrame:
    return parts.repartition("lang", "phrase").mapInArrow(lambda batches: _bucket(batches, least), _ROWS)


def frequencies(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, room: int = BITMAP) -> DataFrame:
    """(lang, k, phrase, n): n-grams of 1 to LONGEST words that occur ``least`` times or more; k 0: number of all words.

    ``room`` (at most BITMAP): bits for frequent pairs; fewer only make more to count.
    """
    arrow_bounds(docs.sparkSession)

    def _pair_bits(batches):
        for batch in batches:
            words = hashes(pc.split_pattern(batch.column(1), " ").flatten())
            yield pa.RecordBatch.from_arrays([pa.array(pair_bits(hashes(batch.column(0)), words[::2], words[1::2], room))], names=["h"])

    rows = stored(pieces(docs, lang, text))
    short = stored(_added(rows.mapInArrow(_short, _ROWS), least))
    frequent = bitmap(short.where("k = 2").select("lang", "phrase").mapInArrow(_pair_bits, "h long"))

    def _long(batches):
        for table in _gathered(batches):
            p = Pieces(table)
            words, langs = hashes(p.words), hashes(p.langs)
            at = np.flatnonzero(p.pair)
            at = at[in_bitmap(frequent.value, pair_bits(langs[p.lang[at]], words[p.word[at]], words[p.word[at + 1]], room))]
            good = np.zeros(len(p.word) + 1, bool)
            good[at] = True
            key = np.zeros(len(p.word) + 1, np.int64)  # of the n-gram that begins at each place
            key[at] = np.unique(p.pair_keys(at), return_inverse=True)[1]
            for k in range(3, LONGEST + 1):
                at = at[good[at + k - 2]]
                key[at] = np.unique(key[at] * len(p.words) + p.word[at + k - 1], return_inverse=True)[1]
                yield p.counted(at, k, key[at])

    return short.unionByName(stored(_added(rows.mapInArrow(_long, _ROWS), least)))


# --- scores -------------------------------------------------------------------------------------

def _words(begin: int, n) -> F.Column:
    return F.array_join(F.slice("w", begin, n), " ")


def _big(name: str):
    return F.col(name).cast("decimal(20,0)")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, within: int = WITHIN) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    freq = frequencies(docs, lang, text, least)
    known = stored(freq.where("k > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")))
    cand = stored(freq.where("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w")))

    cuts = F.array(*(F.struct(F.lit(c).alias("cut"), F.lit(side).alias("side"), part.alias("part")) for c in range(1, LONGEST) for side, part in ((0, _words(1, c)), (1, _words(c + 1, LONGEST)))))
    asked = stored(cand.select("lang", "phrase", "k", "a", F.explode(cuts).alias("q")).where("q.cut < k").select("lang", "phrase", "a", "q.*"))
    table = stored(asked.groupBy("lang", "part").agg(F.count("*").alias("c")).join(known, ["lang", "part"]))
    told = join_counted(asked, table, ["lang", "part"], "c")
    f = lambda c, side: F.max(F.when((F.col("cut") == c) & (F.col("side") == side), F.col("f")))
    parts = told.groupBy("lang", "phrase", "a").agg(*(f(c, side).alias(f"f{c}{side}") for c in range(1, LONGEST) for side in (0, 1)))
    score = lambda c: F.expr(f"(cast({SCALE} as decimal(18,0)) * cast(a as decimal(20,0))) div (cast(f{c}0 as decimal(20,0)) + cast(f{c}1 as decimal(20,0)))")
    best = F.array_min(F.array_compact(F.array(*(F.when(F.col(f"f{c}1").isNotNull(), F.struct(score(c).alias("score"), F.lit(c).alias("cut"), F.col(f"f{c}0").alias("l"), F.col(f"f{c}1").alias("r"))) for c in range(1, LONGEST)))))
    scored = parts.select("lang", "phrase", "a", best.alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")

    inside = F.array(*(F.struct(F.lit(n).alias("size"), F.lit(b + n).alias("end"), _words(b + 1, n).alias("phrase")) for n in range(2, LONGEST) for b in range(LONGEST - n + 1)))
    inner = cand.where("k > 2").select("lang", "k", "a", F.explode(inside).alias("s")).where("s.end <= k AND s.size < k").select("lang", "a", "s.phrase")
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("above"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(_big("above") * 100 < _big("a") * within, F.lit(True)))

    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(GROUPS)).alias("g")
    some = kept.select("lang", "phrase", "a", "l", "r", "score", group).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "g").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(freq.where("k = 0").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {"op11_collocations": op11_collocations}
SQL = {"op11_collocations": f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
s AS (SELECT lang, w, count(*) AS m FROM (SELECT lang, list_filter(regexp_split_to_array(p, '[ \\x09]+'), lambda x: x <> '') AS w FROM p) GROUP BY lang, w HAVING len(w) > 0),
g AS (SELECT lang, k, m, w, unnest(range(1, len(w) - k + 2)) AS i FROM s CROSS JOIN (SELECT unnest(range(1, {LONGEST + 1})) AS k)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, sum(m)::BIGINT AS n FROM g GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= {LEAST}),
cuts AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS p1, array_to_string(w[j + 1:], ' ') AS p2 FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
scored AS (SELECT cuts.lang, cuts.phrase, a, j, f1.n AS l, f2.n AS r, (({SCALE}::HUGEINT * a) // (f1.n::HUGEINT + f2.n))::BIGINT AS score
  FROM cuts JOIN f f1 ON f1.lang = cuts.lang AND f1.phrase = p1 JOIN f f2 ON f2.lang = cuts.lang AND f2.phrase = p2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS k FROM scored) WHERE k = 1),
inner_ AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS above FROM (SELECT *, unnest(range(1, k - n + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS n FROM c)) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ x USING (lang, phrase) WHERE x.above IS NULL OR 100 * x.above::HUGEINT < {WITHIN} * b.a::HUGEINT)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= {TOP}
"""}
