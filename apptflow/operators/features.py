"""Feature preparation (J1-J7) as fit/transform over DataFrames.

Statistics are fitted by one Spark aggregate each and applied as literals,
the same pattern as ``pyspark.ml`` estimators; only scalars (or a
category list bounded by the column's cardinality) reach the driver.
Exactness traps handled here: exact median (T9), population std (T8),
mode ties by smallest value (T10).
"""
from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apptflow.sources import dims

CLASSIFICATION_CATEGORICAL = ["gender", "scan_type", *dims.FLAG_COLUMNS[:9], "contrast", *dims.FLAG_COLUMNS[9:]]
REGRESSION_CATEGORICAL = ["scan_type", "wheelchair_user", "hoist_required", "poor_mobility", "learning_difficulty",
                          "cognitive_impairment", "interpreter_required", "sedation_needed", "difficult_iv_access",
                          "hospital_transport_required", "contrast"]


BINS = 512


def kth_value(df: DataFrame, col: str, k: int) -> float | None:
    """The value of rank ``k`` (from 0) among the numbers in ``col``, by histogram refinement.

    A round counts the values of the current interval in ``BINS`` equal bins, with the least and the largest of
    each; the bin that holds the rank is the next interval, until it holds one value. Only the counts leave the tasks.
    """
    x = F.col(col).cast("double")
    d = df.select(x.alias("x")).filter("x IS NOT NULL AND NOT isnan(x)")
    r = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n")).first()
    lo, hi = r["lo"], r["hi"]
    if not 0 <= k < r["n"]:
        return None
    while lo < hi:
        if math.isinf(lo) or math.isinf(hi):  # infinities are bins of their own
            bin_ = F.when(F.col("x") == float("-inf"), 0).when(F.col("x") == float("inf"), 2).otherwise(1)
        else:
            share = (F.col("x") / 2 - lo / 2) / (hi / 2 - lo / 2) if hi - lo == math.inf else (F.col("x") - lo) / (hi - lo)
            bin_ = F.floor(share * BINS)
        hist = (d.filter(F.col("x").between(lo, hi)).groupBy(bin_.alias("bin"))
                .agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("bin").collect())
        for b in hist:  # at most BINS + 1 rows
            if k < b["n"]:
                lo, hi = b["lo"], b["hi"]
                break
            k -= b["n"]
    return lo


def fit_median(df: DataFrame, col: str) -> float | None:
    """Exact median, the mean of the two middle values of an even number (T9); NaN and null do not count."""
    x = F.col(col).cast("double")
    d = df.select(x.alias(col)).filter(x.isNotNull() & ~F.isnan(x))
    n = d.count()
    low = kth_value(d, col, (n - 1) // 2)
    if n == 0 or n % 2:
        return low
    above = d.agg(F.count(F.when(F.col(col) <= low, 1)).alias("upto"), F.min(F.when(F.col(col) > low, F.col(col))).alias("next"))
    r = above.first()
    high = low if r["upto"] > n // 2 else r["next"]
    return (low + high) / 2


def fit_mean(df: DataFrame, col: str) -> float | None:
    return df.agg(F.avg(col)).first()[0]


def fit_mode(df: DataFrame, col: str) -> str | None:
    """Most frequent non-null value, ties to the smallest value."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.min_by(col, F.struct(-F.col("n"), F.col(col))).alias("m")).first()
    return None if row is None else row[0]


def fit_modes(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """Modes of several string columns in one pass: unpivot (column, value),
    count, then the smallest value among the most frequent per column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols]))
    counts = (df.select(pairs.alias("p")).select("p.c", "p.v").filter(F.col("v").isNotNull())
              .groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")))
    rows = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("m")).collect()
    return {r["c"]: r["m"] for r in rows}  # one row per column: bounded by len(cols)


def impute(df: DataFrame, col: str, value, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, F.coalesce(F.col(col), F.lit(value)))


def fit_standardise(df: DataFrame, col: str) -> tuple[float, float]:
    """Mean and population std from exact sums (T8); integral inputs stay exact."""
    r = df.agg(F.count(col).alias("n"), F.sum(col).alias("s"), F.sum(F.col(col).cast("long") * F.col(col)).alias("ss")).first()
    n, s, ss = r["n"], r["s"], r["ss"]
    mean = s / n
    var = (n * ss - s * s) / (n * n)
    return mean, math.sqrt(var)


def standardise(col: Column, mean: float, std: float) -> Column:
    return F.when(F.lit(std) == 0, F.lit(0.0)).otherwise((col - F.lit(mean)) / F.lit(std))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k · n_c) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = counts.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k")).withColumn("_k", F.lit(1))
    return counts.withColumn("_k", F.lit(1)).join(F.broadcast(tot), "_k").select(
        label, "n_c", (F.col("n").cast("double") / (F.col("k") * F.col("n_c")).cast("double")).alias("weight"))


def encoder_stages(categorical: list[str], numeric: list[str], out: str = "features") -> list:
    """StringIndexer(alphabetAsc, keep) + OneHotEncoder(dropLast) + assembler.

    Unknown categories land in the kept 'invalid' slot, which dropLast
    removes: an all-zero block, like handle_unknown='ignore'.
    """
    idx = [StringIndexer(inputCols=categorical, outputCols=[f"{c}__idx" for c in categorical],
                         handleInvalid="keep", stringOrderType="alphabetAsc")]
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in categorical], outputCols=[f"cat__{c}" for c in categorical],
                        dropLast=True)
    asm = VectorAssembler(inputCols=numeric + [f"cat__{c}" for c in categorical], outputCol=out)
    return [*idx, ohe, asm]


def prepare_classification(df: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """Median-impute and population-standardise age; mode-impute categoricals."""
    fit_on = df if fit_on is None else fit_on
    med = fit_median(fit_on, "age")
    d = impute(df, "age", med, "age_f")
    mean, std = fit_standardise(impute(fit_on, "age", med, "age_f"), "age_f")
    d = d.withColumn("age_z", standardise(F.col("age_f"), mean, std))
    modes = fit_modes(fit_on, CLASSIFICATION_CATEGORICAL)
    return d.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in modes.items()})


def prepare_regression(df: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    fit_on = df if fit_on is None else fit_on
    d = impute(df, "age", fit_mean(fit_on, "age"), "age_f")
    modes = fit_modes(fit_on, REGRESSION_CATEGORICAL)
    return d.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in modes.items()})


def feature_pipeline(categorical: list[str], numeric: list[str]) -> Pipeline:
    return Pipeline(stages=encoder_stages(categorical, numeric))


def categories(df: DataFrame, categorical: list[str], first_index: int) -> DataFrame:
    """column (its place), value, feature_index of every known value: dense ranks within a column after the columns
    before it, as the encoder numbers them. As many rows as there are distinct values."""
    cells = F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).cast("string").alias("value"))
                      for i, c in enumerate(categorical)])
    known = df.select(F.explode(cells).alias("x")).select("x.*").filter("value IS NOT NULL").distinct()
    counts = known.groupBy("column").agg(F.count("*").alias("n"))
    before = Window.orderBy("column").rowsBetween(Window.unboundedPreceding, -1)  # a row for each column
    offsets = counts.select("column", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value")) - 1
    return known.withColumn("rank", rank).join(offsets, "column").select(
        "column", "value", (F.lit(first_index) + F.col("offset") + F.col("rank")).cast("int").alias("feature_index"))


def sparse_features(df: DataFrame, key: str, categorical: list[str], numeric: list[str], known: DataFrame) -> DataFrame:
    """key, feature_index, value: the non-zero entries of the assembled vector as rows.

    Numbers come first, then a 1 for the slot of each known category; a value that is not in ``known`` has no entry.
    ``known`` has a row per category, so it goes to the cells; dealing the cells out by category would skew.
    """
    numbers = [F.struct(F.lit(i).alias("feature_index"), F.col(c).cast("double").alias("value")) for i, c in enumerate(numeric)]
    cells = [F.struct(F.lit(i).alias("column"), F.col(c).cast("string").alias("value")) for i, c in enumerate(categorical)]
    left = df.select(key, F.explode(F.array(*numbers)).alias("x")).select(key, "x.*").filter("value <> 0")
    right = (df.select(key, F.explode(F.array(*cells)).alias("x")).select(key, "x.*")
             .join(F.broadcast(known), ["column", "value"]).select(key, "feature_index", F.lit(1.0).alias("value")))
    return left.unionByName(right)
