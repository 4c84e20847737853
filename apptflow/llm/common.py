"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apptflow.session import cut_lineage, scratch_path, stored  # noqa: F401  (the operators' names for them)

#: the white space of the text contracts: blank, tab, line feed, vertical tab, form feed, carriage return
SPACES = r"[\x20\x09-\x0D]+"
#: rows of an Arrow batch that are Python objects at a time: a worker keeps the memory that it once took
ROWS = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_parts(batch: pa.RecordBatch | pa.Array) -> Iterator[pa.RecordBatch | pa.Array]:
    """``batch`` in runs of ``ROWS`` rows that share its buffers; an empty one as it is."""
    for at in range(0, max(1, len(batch)), ROWS):
        yield batch.slice(at, ROWS)


def let(expr: str, name: str, body: str) -> str:
    """SQL text that evaluates ``expr`` once and uses it as ``name`` in ``body``."""
    return f"element_at(transform(array({expr}), {name} -> {body}), 1)"


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, ignoring case."""
    have = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in have:
        name += "_"
    return name


def prefix_sums(df: DataFrame, keys: list[str], sums: dict[str, Column | None]) -> DataFrame:
    """Add to every row, for each name, the sum of the column (None: the count of rows) over the rows before it in
    the order of ``keys``.

    Sampled splitters range-partition the rows and each partition is sorted
    on its own; the totals of the partitions, one row each, give every
    partition its start. Hot keys are split as long as ``keys`` as a whole are
    not; rows equal in all of ``keys`` are interchangeable. The sorted rows are
    checkpointed, so the splitters of the two passes are the same.
    """
    cols = df.columns
    d = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    d = cut_lineage(d.withColumn("_at", F.monotonically_increasing_id()))
    d = d.withColumn("_part", F.shiftright("_at", 33))
    amounts = {n: F.lit(1).cast("long") if c is None else c for n, c in sums.items()}
    ends = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = (d.groupBy("_part").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in amounts.items()])
              .select("_part", *[F.coalesce(F.sum(f"_sum_{n}").over(ends), F.lit(0)).alias(f"_start_{n}") for n in sums]))
    before = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({f"_local_{n}": F.col("_at") - F.shiftleft("_part", 33) if sums[n] is None
                       else F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in amounts.items()})
    # as many rows as partitions: the planner's own broadcast limit decides
    return d.join(starts, "_part").select(*cols, *[(F.col(f"_start_{n}") + F.col(f"_local_{n}")).alias(n) for n in sums])


def ordered(df: DataFrame, keys: list[str], weight: str | None = None, position: str = "position") -> DataFrame:
    """Add ``position``: rows (or sum of ``weight``) before each row in the order of ``keys``, see ``prefix_sums``."""
    return prefix_sums(df, keys, {position: F.col(weight) if weight else None})


def crc32_text(c: Column) -> Column:
    """crc32 of a value's text."""
    return F.crc32(c.cast("string").cast("binary"))
