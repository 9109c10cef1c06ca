"""Ordered operators over one long recording: range partitions, dense positions, prefix scans, halo rows, ranks.

A window without keys puts all rows in one task.  Here the rows are range-partitioned by their order (and keys), so
that a block of neighbouring rows is one group; what passes from block to block is one row a block: a count, a
sum, a boundary row.  Only those summaries are ordered in one task.  Rows of one order value may lie in two
blocks, so that a value that many rows have is no hot group.

Null values of the order column come first, as in a Spark sort.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.store import forget, stored

BLOCK, POSITION, PART, HOME = "__block", "__pos", "__part", "__home"
#: Rows of a part of the ordered rows; also the least number of rows that a halo must not exceed.
PART_ROWS = 65_536
#: Rows of a range, about; there are as many ranges as shuffle partitions at least.
BLOCK_ROWS = 250_000


def in_blocks(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """``df`` with ``__block``, the number of its range of (keys, order), and ``__tie``; stored, so that blocks stay what they are.

    Ranges become more with the rows, not larger: the rows are stored once as they are, and counted.
    """
    tied = df.withColumn("__tie", F.xxhash64(*(c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind)))
    if not blocks:
        tied = stored(tied)
        blocks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tied.count() // BLOCK_ROWS))
    out = stored(tied.repartitionByRange(blocks, *keys, *order, "__tie").withColumn(BLOCK, F.spark_partition_id()))
    forget(tied)
    out._blocks = blocks
    return out


def spread(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows`` with a task a block, where ``blocks`` is what in_blocks() gave: blocks that share a task would need its memory at once."""
    return rows.repartitionById(blocks._blocks, BLOCK)


def _before(value: str, keys: Sequence[str], by: str) -> Column:
    """Sum of a summary's ``value`` over all groups before, within the keys."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def join_same(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join by columns of the same names in which null equals null; the columns of ``rows`` stay."""
    renamed = table.select(*(F.col(c).alias(f"__same{on.index(c)}") if c in on else F.col(c) for c in table.columns))
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"__same{i}"))
    return rows.join(renamed, same, how).drop(*(f"__same{i}" for i in range(len(on))))


def join_counted(rows: DataFrame, table: DataFrame, on: Sequence[str], count: str) -> DataFrame:
    """``rows`` joined to a stored ``table`` (one row a key), whose column ``count`` tells how many rows each key has.

    Keys with more than a thousandth of the counted rows are fewer than a thousand: those are broadcast, and what is
    shuffled has no larger group.
    """
    large = F.col(count) * 1000 > (table.agg(F.sum(count)).first()[0] or 0)
    heavy = table.where(large)
    hot = join_same(rows, F.broadcast(heavy), on)
    cold = join_same(join_same(rows, F.broadcast(heavy.select(*on)), on, "left_anti"), table.where(~large), on)
    return hot.unionByName(cold)


def with_offsets(rows: DataFrame, value: Column, keys: Sequence[str], by: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over all rows of the groups (``by``) before theirs."""
    sums = rows.groupBy(*keys, by).agg(F.sum(value).alias("__sum"))
    return join_same(rows, sums.select(*keys, by, _before("__sum", keys, by).alias(out)), [*keys, by])


def positions(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), out: str = POSITION, blocks: int | None = None) -> DataFrame:
    """``df`` with the place (from 0) of each row in the order, within its keys; ties in a fixed, arbitrary order."""
    keys, order = list(keys), list(order)
    cut = in_blocks(df, order, keys, blocks)
    rows = spread(with_offsets(cut, F.lit(1), keys, BLOCK, "__before"), cut)
    own = F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy(*order, "__tie"))
    return rows.withColumn(out, (own - 1 + F.col("__before")).cast("long")).drop(BLOCK, "__before", "__tie")


def with_halo(placed: DataFrame, radius: int, rows: int = PART_ROWS, at: str = POSITION) -> DataFrame:
    """Rows with ``__part``, a stretch of positions, and ``__home``; rows within ``radius`` of a part are also listed in it as guests."""
    size = max(rows, radius, 1)
    home = F.floor(F.col(at) / size).cast("long")
    inner = F.col(at) - home * size
    listed = F.array_compact(F.array(home, F.when((inner < radius) & (home > 0), home - 1), F.when(inner >= size - radius, home + 1)))
    return placed.withColumn(HOME, home).withColumn(PART, F.explode(listed)).withColumn(HOME, F.col(HOME) == F.col(PART))


def windowed(df: DataFrame, step: Callable[[DataFrame, list[str]], DataFrame], radius: int, order: Sequence[str], keys: Sequence[str] = (), rows: int = PART_ROWS) -> DataFrame:
    """``step(rows, keys)`` of an operator that looks ``radius`` rows ahead and behind, in parts with halo rows.

    ``step`` gets further keys and must order by ``__pos`` (or the order itself, where it has no ties).
    """
    return step(with_halo(positions(df, order, keys), radius, rows), [*keys, PART]).where(HOME).drop(HOME, PART, POSITION)


def scan(df: DataFrame, value: Column | str, out: str, order: Sequence[str], keys: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """``df`` with the running sum of ``value`` (nulls count 0) up to and with each row."""
    keys, order = list(keys), list(order)
    value = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0))
    cut = in_blocks(df.withColumn("__value", value), order, keys, blocks)
    rows = spread(with_offsets(cut, F.col("__value"), keys, BLOCK, "__before"), cut)
    own = F.sum("__value").over(Window.partitionBy(*keys, BLOCK).orderBy(*order, "__tie").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(out, own + F.col("__before")).drop(BLOCK, "__before", "__value", "__tie")


def near_rows(rows: DataFrame, wanted: Column, order: Sequence[str], row: Column, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, __block, order, __tie, row): of what in_blocks() gave, the last two rows before each block and the first two behind it that are wanted.

    A block's rows of other keys are no neighbours.  The rows pass from block to block as one summary a block and key.
    """
    keys, order = list(keys), [*order, "__tie"]
    upto, row = (Window.unboundedPreceding, -1), row.alias("row")
    own = Window.partitionBy(*keys, BLOCK, "__wanted").orderBy(*order)
    rows = spread(rows.select(*keys, BLOCK, wanted.alias("__wanted"), *order, F.when(wanted, F.struct(*order, row)).alias("__item")), rows)
    rows = rows.withColumn("__a", F.lag("__item").over(own)).withColumn("__z", F.lead("__item").over(own))
    pair = lambda other: F.when(F.col("__wanted"), F.struct(F.col("__item").alias("one"), F.col(other).alias("two")))
    ends = rows.groupBy(*keys, BLOCK).agg(F.max(pair("__a")).alias("__last"), F.min(pair("__z")).alias("__first"))
    for end, by in (("__last", F.col(BLOCK)), ("__first", F.col(BLOCK).desc())):
        others = Window.partitionBy(*keys).orderBy(by).rowsBetween(*upto)
        ends = ends.withColumn("__far", F.last(f"{end}.one", ignorenulls=True).over(others))  # where the block has one wanted row only
        ends = ends.withColumn(end, F.when(F.col(end).isNotNull(), F.struct(F.col(f"{end}.one"), F.coalesce(f"{end}.two", "__far").alias("two"))))
        ends = ends.withColumn(end, F.last(end, ignorenulls=True).over(others))
    near = F.array_compact(F.array("__last.one", "__last.two", "__first.one", "__first.two"))
    return ends.select(*keys, BLOCK, F.explode(near).alias("__near")).select(*keys, BLOCK, "__near.*")


def cume_dist(df: DataFrame, column: str, out: str, keys: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """``df`` with the share of rows (within the keys) whose value is at most the row's.

    Counted by distinct value, with a prefix scan of those counts; rows are then joined to their value.  Values
    that many rows have are few, and broadcast.  Nulls count as the smallest value.
    """
    keys = list(keys)
    counts = stored(df.groupBy(*keys, F.col(column).alias("__v")).agg(F.count("*").alias("__n")))
    below = scan(counts, "__n", "__upto", ["__v"], keys, blocks)
    total = counts.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    share = stored(join_same(below, total, keys).select(*keys, "__v", "__n", (F.col("__upto") / F.col("__all")).alias(out)))
    return join_counted(df.withColumn("__v", F.col(column)), share, [*keys, "__v"], "__n").drop("__v", "__n")
