"""Duration and class policies (D1, D2, K1-K5) as row-local expressions.

All policies are projections: no shuffle, they run on batch and streaming
DataFrames alike.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptflow.functions import flags as fx
from apptflow.sources import dims

AVERAGE_RULES = dims.AVERAGE_RULES


def baseline_minutes(scan: str = "scan_type") -> Column:
    """K1: the rule book's standard minutes (default 30)."""
    return fx.rule_minutes_expr(scan).cast("int")


def _avg_value(key: str, averages: dict[str, float]) -> float:
    return float(averages.get(key, dims.FLAG_AVERAGE_FALLBACK[key]))


def averages_extra(reason: Column, scan: Column, averages: list[tuple] | None = None) -> Column:
    """K2 extra minutes before rounding: max over matched keywords, plus contrast.

    The averages table is a bounded parameter (tens of rows), inlined as
    literals so the policy stays a codegen'd projection.
    """
    table = dict((k.lower(), v) for k, v in (dims.FLAG_AVERAGE if averages is None else averages))
    low = F.lower(reason.cast("string"))
    terms = []
    for words, key in AVERAGE_RULES:
        hit = None
        for w in words:
            c = low.contains(w)
            hit = c if hit is None else (hit | c)
        terms.append(F.when(hit, F.lit(_avg_value(key, table))).otherwise(F.lit(0.0)))
    extra = F.greatest(F.lit(0.0), *terms)
    contrast = F.when(F.lower(scan).contains("contrast"), F.lit(_avg_value("contrast", table))).otherwise(F.lit(0.0))
    return extra + contrast


def averages_extra_joined(df: DataFrame, averages: DataFrame, reason: str = "reason_text",
                          scan: str = "scan_type", out: str = "extra") -> DataFrame:
    """K2 with the averages table (flag, minutes) as an input.

    The table is folded into one row, a map of at most one entry a flag, and
    joined on a constant; a key that it lacks takes its own fallback.
    """
    known = averages.select(F.lower("flag").alias("flag"), F.col("minutes").cast("double").alias("minutes"))
    wanted = [key for _, key in AVERAGE_RULES] + ["contrast"]
    one = known.filter(F.col("flag").isin(wanted)).groupBy("flag").agg(F.max("minutes").alias("minutes")).agg(
        F.map_from_entries(F.collect_list(F.struct("flag", "minutes"))).alias("_minutes"), F.lit(1).alias("_one"))
    d = df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one")

    def minutes(key: str) -> Column:
        return F.coalesce(F.element_at("_minutes", F.lit(key)), F.lit(float(dims.FLAG_AVERAGE_FALLBACK[key])))

    low = F.lower(F.col(reason).cast("string"))
    terms = [F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), minutes(key)).otherwise(F.lit(0.0))
             for words, key in AVERAGE_RULES]
    contrast = F.when(F.lower(F.col(scan)).contains("contrast"), minutes("contrast")).otherwise(F.lit(0.0))
    return d.withColumn(out, F.greatest(F.lit(0.0), *terms) + contrast).drop("_minutes", "_one")


def class_from_extra(extra: Column) -> Column:
    """K3: 0 -> Class 1, <=20 -> Class 2, else Class 3 (on rounded minutes)."""
    return F.when(extra == 0, "Class 1").when(extra <= 20, "Class 2").otherwise("Class 3")


def with_averages_policy(df: DataFrame, reason: str = "reason_text", scan: str = "scan_type",
                         averages: list[tuple] | None = None) -> DataFrame:
    extra = F.bround(averages_extra(F.col(reason), F.col(scan), averages), 0).cast("int")
    return (df.withColumn("heuristic_extra", extra)
            .withColumn("heuristic_minutes", baseline_minutes(scan) + F.col("heuristic_extra"))
            .withColumn("heuristic_class", class_from_extra(F.col("heuristic_extra"))))


def model_minutes(scan: Column | str, predicted_overrun: Column | str) -> Column:
    """K4: rule minutes + max(0, round-half-even(prediction))."""
    p = F.col(predicted_overrun) if isinstance(predicted_overrun, str) else predicted_overrun
    return (fx.rule_minutes_expr(scan) + F.greatest(F.lit(0), F.bround(p, 0).cast("int"))).cast("int")


def group_mean_model(history: DataFrame, keys: list[str], target: str = "overrun_minutes") -> DataFrame:
    """A deterministic overrun predictor: the historical mean per key group.

    Returns (keys..., predicted_overrun, n_train). Its size is bounded by the
    number of distinct key combinations (of flag texts and contrast: at most
    2^10 x 2), not by the data.
    """
    agg = history.groupBy(*keys).agg(F.sum(target).alias("_s"), F.count(F.lit(1)).alias("n_train"))
    return agg.select(*keys, fx.ratio_round(F.col("_s"), F.col("n_train"), 2).alias("predicted_overrun"),
                      "n_train")
