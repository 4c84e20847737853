"""Ordered running totals without pulling a whole key group into one task.

A plain ``Window.partitionBy(site).orderBy(k)`` sorts every row of a site in
one task; one hot site holding a third of the data would then be a single
multi-terabyte task. ``running_totals`` does the classic two-level scan:

1. cut the order key into fixed-width blocks and aggregate per
   ``(partition, block)`` (map-side partial aggregation, tiny output);
2. prefix-sum the block totals per partition (rows = number of blocks);
3. join the block offsets back on ``(partition, block)`` and finish with a
   window inside each block, which holds at most ``block_size`` keys.

Steps 3's join and window share the ``(partition, block)`` hash
partitioning, so Spark plans a single exchange for them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apptflow.session import cut_lineage

DEFAULT_BLOCK = 1 << 16


def running_totals(df: DataFrame, partition_cols: list[str], order_col: str | None,
                   values: dict[str, Column], block_size: int = DEFAULT_BLOCK,
                   inclusive: bool = True, block: Column | None = None,
                   order: list[Column] | None = None, totals: dict[str, str] | None = None) -> DataFrame:
    """Add ``name = Σ value`` over rows ordered by ``order_col`` within
    ``partition_cols``. ``order_col`` must be an integer key, unique within
    its partition (ties would make the order ambiguous).

    For other orders pass ``block`` (a non-decreasing integer function of
    the order) and ``order`` (the full ordering, unique within partition);
    the block then only needs to be monotone in that order. ``totals`` names
    further columns for the whole partition's sums of some values: they come
    from the block sums, without another pass or join.

    Each block sum is a row of its partition's window, so the keys must be
    dense enough for blocks to hold many of them; ``range_running_totals`` takes
    any keys.
    """
    blk = "_blk"
    tmp = {f"_v_{n}": v for n, v in values.items()}
    if block is None:
        block = F.floor(F.col(order_col) / F.lit(block_size))
    d = df.withColumn(blk, block.cast("long")).withColumns(tmp)
    block_sums = d.groupBy(*partition_cols, blk).agg(*[F.sum(t).alias(t) for t in tmp])
    w_blocks = Window.partitionBy(*partition_cols).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = block_sums.select(*partition_cols, blk, *[
        F.coalesce(F.sum(t).over(w_blocks), F.lit(0)).alias(f"_off{t}") for t in tmp],
        *[F.sum(f"_v_{n}").over(Window.partitionBy(*partition_cols)).alias(name) for n, name in (totals or {}).items()])
    joined = d.join(offsets, on=[*partition_cols, blk], how="inner")
    upper = Window.currentRow if inclusive else -1
    inner_order = order if order is not None else [F.col(order_col)]
    w_in = Window.partitionBy(*partition_cols, blk).orderBy(*inner_order).rowsBetween(Window.unboundedPreceding, upper)
    out = joined.withColumns({
        n: F.col(f"_off_v_{n}") + F.coalesce(F.sum(f"_v_{n}").over(w_in), F.lit(0))
        for n in values})
    return out.drop(blk, *tmp, *[f"_off{t}" for t in tmp])


def range_running_totals(df: DataFrame, partition_cols: list[str], order_cols: list[str], values: dict[str, Column],
                         inclusive: bool = True) -> DataFrame:
    """``running_totals`` for keys of any type and spread, in three levels.

    1. Sampled splitters range-partition the rows by (partition, order) and each
       range is sorted on its own, so a hot partition lies in many ranges; the
       sorted rows are checkpointed, which fixes the ranges.
    2. Every (partition, range) has one sum, of which there are fewer than
       partitions + ranges; the sums before each are prefix sums over ranges,
       a window of a partition's ranges.
    3. A window inside (range, partition) finishes.

    Rows equal in all of ``partition_cols`` and ``order_cols`` come in no defined order.
    """
    keys = [*partition_cols, *order_cols]
    tmp = {f"_v_{n}": v for n, v in values.items()}
    d = df.withColumns(tmp).repartitionByRange(*keys).sortWithinPartitions(*keys)
    d = cut_lineage(d.withColumn("_at", F.monotonically_increasing_id()))
    d = d.withColumn("_range", F.shiftright("_at", 33))
    before = Window.partitionBy(*partition_cols).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*partition_cols, "_range").agg(*[F.sum(t).alias(t) for t in tmp])
    offsets = sums.select(*[F.col(c).alias(f"_p_{c}") for c in partition_cols], F.col("_range").alias("_p_range"), *[
        F.coalesce(F.sum(t).over(before), F.lit(0)).alias(f"_off{t}") for t in tmp])
    same = [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in partition_cols]
    inside = Window.partitionBy(*partition_cols, "_range").orderBy("_at").rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    d = d.join(offsets, [F.col("_range") == F.col("_p_range"), *same])
    return d.select(*df.columns, *[(F.col(f"_off_v_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0))).alias(n)
                                   for n in values])
