"""Flag-level summary reports."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apptflow.functions import flags as fx
from apptflow.sources import dims


def _flag_entries(mapping: list[tuple[int, str, str]], truthy: list[str], control=None):
    """Array of nullable (order_no, label) structs: one slot per report flag,
    plus the control slot set only when no flag is. Explode it and drop the
    nulls (a Generate over a plain array stays fast; one over a lambda
    ``filter`` does not)."""
    hits = [fx.is_yes(col, truthy) for _, col, _ in mapping]
    slots = [F.when(h, F.struct(F.lit(o).alias("order_no"), F.lit(lbl).alias("label")))
             for h, (o, _, lbl) in zip(hits, mapping)]
    if control is not None:
        none = ~reduce(lambda a, b: a | b, hits)
        slots.append(F.when(none, F.struct(F.lit(control[0]).alias("order_no"), F.lit(control[1]).alias("label"))))
    return F.array_compact(F.array(*slots))


def flag_summary(df: DataFrame, mapping: list[tuple[int, str, str]] | None = None,
                 truthy: list[str] | None = None, class_col: str = "class") -> DataFrame:
    """Flag x class summary with a control row, in one pass (F1).

    Each row is expanded to the report rows it belongs to (its set flags, or
    the control row when none is set), then one grouped count. The partial
    aggregate runs map-side, so the shuffle carries at most
    (#partitions x #report rows) tiny records regardless of input size.
    Rows for flags with no patients are kept (right join on the label dim).
    """
    mapping = dims.DISPLAY_NAME if mapping is None else mapping
    truthy = dims.TRUTHY if truthy is None else truthy
    entries = _flag_entries(mapping, truthy, control=(0, dims.CONTROL_LABEL))
    exploded = df.select(F.col(class_col).alias("cls"), F.lit(1).alias("w"), F.explode(entries).alias("e"))
    exploded = exploded.filter(F.col("e").isNotNull()).select("cls", "w", F.col("e.order_no").alias("order_no"), F.col("e.label").alias("delay_reason"))
    # zero-weight seed rows keep report rows that have no patients, without a join
    seeds = dims.literal(df.sparkSession, [(0, dims.CONTROL_LABEL)] + [(o, lbl) for o, _, lbl in mapping],
                         "order_no int, delay_reason string").select(
        F.lit(None).cast("string").alias("cls"), F.lit(0).alias("w"), "order_no", "delay_reason")
    out = exploded.unionByName(seeds).groupBy("order_no", "delay_reason").agg(
        F.sum("w").cast("long").alias("total_cases"),
        F.sum(F.when(F.col("cls") == "Class 3", F.col("w")).otherwise(0)).cast("long").alias("major_delay"),
        F.sum(F.when(F.col("cls") == "Class 2", F.col("w")).otherwise(0)).cast("long").alias("minor_delay"))
    return out.select(
        "order_no", "delay_reason", "total_cases", "major_delay",
        fx.pct_text(F.col("major_delay"), F.col("total_cases")).alias("pct_major"),
        fx.pct_text(F.col("minor_delay"), F.col("total_cases")).alias("pct_minor"))


def control_mask(cols: list[str], truthy: list[str] | None = None):
    """True where none of ``cols`` is set."""
    return ~reduce(lambda a, b: a | b, [fx.is_yes(c, truthy) for c in cols])


def flag_long(df: DataFrame, flag_cols: list[str], keep: list[str], truthy: list[str] | None = None) -> DataFrame:
    """One row per (row, set flag): the unpivot behind per-flag reports."""
    arr = F.array_compact(F.array(*[F.when(fx.is_yes(c, truthy), F.lit(dims.FLAG_DISPLAY.get(c, c)))
                                    for c in flag_cols]))
    return df.select(*keep, F.explode(arr).alias("flag")).filter(F.col("flag").isNotNull())


def flag_error_outcomes(df: DataFrame, actual: str, predicted: str,
                        flag_cols: list[str] | None = None) -> DataFrame:
    """Per-flag outcome counts and under-estimate rate."""
    flag_cols = dims.FLAG_COLUMNS if flag_cols is None else flag_cols
    long = flag_long(df.withColumn("outcome", fx.outcome_group(actual, predicted)),
                     flag_cols, ["outcome"], truthy=["yes", "1", "true", "y"])
    agg = long.groupBy("flag").agg(
        F.count(F.lit(1)).alias("total_patients"),
        F.count_if(F.col("outcome") == "Correct Class 2").alias("correct_class_2"),
        F.count_if(F.col("outcome") == "Correct Class 3").alias("correct_class_3"),
        F.count_if(F.col("outcome") == "ERROR: Actual 3 -> Pred 2").alias("under_3_to_2"),
        F.count_if(F.col("outcome") == "ERROR: Actual 2 -> Pred 3").alias("over_2_to_3"))
    return agg.withColumn("safety_risk_rate", F.col("under_3_to_2") / F.col("total_patients"))
