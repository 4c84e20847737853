"""Exact duplicates by a content sort.

Texts are equal when identical after each run of blanks, tabs and line ends
became one space. Sampled splitters range-partition the rows by (first
characters, digest) of the normalised text, every partition is sorted
externally by the whole text, which places equal texts next to each other, and
neighbours are compared in full: a run of equal texts keeps its smallest
identifier. The digest in the range key keeps the sampled splitters small and
spreads texts that share a long beginning; equal texts share both, so no run
is torn apart.

A text that makes up more than half a partition's share of all rows would still
be one run in one task. Such texts (at most two for each shuffle partition) are
found by a pre-aggregated count by SHA-256; their rows get a third range key,
a slice by identifier, so that their runs are cut in many pieces, and take
keeper and size from the count.

Defined results: null text counts as empty, and empty texts equal each other.
A null identifier is larger than any other. Of rows that repeat identifier and
text one is kept. An empty table gives no rows. Other columns are ignored by
``exact_duplicates`` and passed through by ``drop_exact_duplicates``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apptflow.llm.common import SPACES, partitions

PREFIX_CHARS = 64
SLICES = 64


def _runs(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    cols = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    d = docs.select(F.col(id_col).alias("id"), norm.alias("norm"), *cols)
    d = d.withColumn("sha", F.sha2("norm", 256))
    n, parts = docs.count(), partitions(docs.sparkSession)
    hot = (d.groupBy(F.col("sha").alias("hot_sha")).agg(F.count("*").alias("hot_size"), F.min("id").alias("hot_keep"))
           .filter(F.col("hot_size") * 2 * parts > max(n, 2 * parts)))
    # fewer than 2 * parts rows by the filter above
    d = d.join(F.broadcast(hot), d["sha"] == hot["hot_sha"], "left")
    d = (d.withColumn("slice", F.when(F.col("hot_sha").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(SLICES)))
                      .otherwise(F.lit(0)).cast("int"))
         .withColumn("prefix", F.substring("norm", 1, PREFIX_CHARS)))
    run = Window.partitionBy("prefix", "sha", "slice", "norm").orderBy(F.col("id").asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = (d.repartitionByRange("prefix", "sha", "slice")
         .withColumns({"run_keep": F.first("id").over(whole), "run_size": F.count("*").over(whole),
                       "nth": F.row_number().over(run)}))
    is_hot = F.col("hot_sha").isNotNull()
    keep = F.when(is_hot, F.col("hot_keep")).otherwise(F.col("run_keep"))
    return d.select("id", keep.alias("keep_id"),
                    F.when(is_hot, F.col("hot_size")).otherwise(F.col("run_size")).alias("group_size"),
                    (F.col("id").eqNullSafe(keep) & (F.col("nth") == 1)).alias("kept"),
                    "sha", *(["row"] if carry else []))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    return _runs(docs, id_col, text_col, False).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of ``docs`` with all their columns, moved once."""
    return _runs(docs, id_col, text_col, True).filter("kept").select(
        *[F.col("row")[c].alias(c) for c in docs.columns])
