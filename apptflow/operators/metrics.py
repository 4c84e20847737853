"""Evaluation metrics as aggregates.

Every metric is computed from exact integer sums/counts gathered in ONE
pass with conditional aggregates; the final arithmetic runs on a single
tiny row. Nothing is collected to the driver and there is no per-row
Python.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apptflow.sources import dims


def _div0(num: Column, den: Column) -> Column:
    """num/den with 0 for an empty denominator (zero_division=0)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: list[str] | None = None,
                     group: list[str] | None = None) -> DataFrame:
    """Dense confusion matrix in long form (F6): every (actual, predicted) pair."""
    labels = dims.CLASS_LABELS if labels is None else labels
    group = group or []
    spark: SparkSession = df.sparkSession
    counts = df.groupBy(*group, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    pairs = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted")) for a in labels for p in labels])
    if group:
        grid = counts.select(*group).distinct().select(*group, F.explode(pairs).alias("g")).select(*group, "g.*")
    else:
        grid = dims.literal(spark, [(a, p) for a in labels for p in labels], "actual string, predicted string")
    return grid.join(counts, [*group, "actual", "predicted"], "left").select(
        *group, "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def classification_report(df: DataFrame, actual: str, predicted: str, model: str,
                          labels: list[str] | None = None) -> DataFrame:
    """Precision / recall / F1 / support per class, macro, weighted, accuracy."""
    labels = dims.CLASS_LABELS if labels is None else labels
    a, p = F.col(actual), F.col(predicted)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(a == p).alias("hits")]
    for i, c in enumerate(labels):
        aggs += [F.count_if((a == c) & (p == c)).alias(f"tp{i}"),
                 F.count_if(p == c).alias(f"pp{i}"),
                 F.count_if(a == c).alias(f"sp{i}")]
    row = df.agg(*aggs)
    per = []
    for i, c in enumerate(labels):
        tp, pp, sp = F.col(f"tp{i}"), F.col(f"pp{i}"), F.col(f"sp{i}")
        per.append((c, _div0(tp, pp), _div0(tp, sp), _div0(tp * 2, pp + sp), sp))
    k = len(labels)

    def mean(idx):
        total = per[0][idx]
        for x in per[1:]:
            total = total + x[idx]
        return total / F.lit(float(k))

    sup_total = per[0][4]
    for x in per[1:]:
        sup_total = sup_total + x[4]

    def weighted(idx):
        total = per[0][idx] * per[0][4]
        for x in per[1:]:
            total = total + x[idx] * x[4]
        return _div0(total, sup_total)

    rows = [F.struct(F.lit(c).alias("class_or_avg"), pr.alias("precision"), rc.alias("recall"),
                     f1.alias("f1_score"), sp.cast("double").alias("support"))
            for c, pr, rc, f1, sp in per]
    rows.append(F.struct(F.lit("macro avg").alias("class_or_avg"), mean(1).alias("precision"),
                         mean(2).alias("recall"), mean(3).alias("f1_score"),
                         sup_total.cast("double").alias("support")))
    rows.append(F.struct(F.lit("weighted avg").alias("class_or_avg"), weighted(1).alias("precision"),
                         weighted(2).alias("recall"), weighted(3).alias("f1_score"),
                         sup_total.cast("double").alias("support")))
    rows.append(F.struct(F.lit("accuracy").alias("class_or_avg"), F.lit(None).cast("double").alias("precision"),
                         F.lit(None).cast("double").alias("recall"), _div0(F.col("hits"), F.col("n")).alias("f1_score"),
                         F.col("n").cast("double").alias("support")))
    return row.select(F.lit(model).alias("model"), F.explode(F.array(*rows)).alias("r")).select("model", "r.*")


def regression_metrics(long: DataFrame, group: str, actual: str, predicted: str) -> DataFrame:
    """MAE, MSE, RMSE, R² per group from exact integer sums.

    Inputs must be integral minutes so the sums are exact and the result is
    bit-identical across engines and partitionings.
    """
    e = (F.col(predicted) - F.col(actual)).cast("long")
    y = F.col(actual).cast("long")
    agg = long.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(e)).alias("sae"), F.sum(e * e).alias("sse"),
        F.sum(y).alias("sy"), F.sum(y * y).alias("syy"))
    return regression_from_sums(agg, group)


def regression_from_sums(agg: DataFrame, group: str) -> DataFrame:
    """The metrics from n, sae, sse, sy, syy (longs); products of two sums are decimals, which do not overflow."""
    n = F.col("n")

    def product(a, b):
        return F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")

    sst_n = product("n", "syy") - product("sy", "sy")
    return agg.select(
        group, "n",
        (F.col("sae") / n).alias("mae"),
        (F.col("sse") / n).alias("mse"),
        F.sqrt(F.col("sse") / n).alias("rmse"),
        F.when(sst_n == 0, F.lit(None).cast("double"))
        .otherwise(F.lit(1.0) - product("n", "sse").cast("double") / sst_n.cast("double")).alias("r2"))


def regression_errors(long: DataFrame, group: str, actual: str, predicted: str) -> DataFrame:
    """mae, rmse, r2 per group of predictions that are not whole minutes (F9); r2 is null where the actual values are equal."""
    e = F.col(predicted) - F.col(actual)
    agg = long.groupBy(group).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("sse"),
                                  (F.var_pop(actual) * F.count(F.lit(1))).alias("sst"))
    return agg.select(group, "mae", "rmse", F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).alias("r2"))


def overtime_idle(long: DataFrame, group: str, actual: str, planned: str) -> DataFrame:
    """Overtime = Σ|planned-actual| where negative, idle = Σ where positive."""
    d = (F.col(planned) - F.col(actual)).cast("long")
    agg = long.groupBy(group).agg(
        F.coalesce(F.sum(F.when(d < 0, -d)), F.lit(0)).alias("overtime"),
        F.coalesce(F.sum(F.when(d > 0, d)), F.lit(0)).alias("idle"))
    return agg.withColumn("total_inefficiency", F.col("overtime") + F.col("idle"))


def best_of(scores: DataFrame, name: str, error: str, priority: dict[str, int]) -> DataFrame:
    """The row of the least error (F16); equal errors go to the lower priority number."""
    pr = F.element_at(F.create_map(*[x for k, v in priority.items() for x in (F.lit(k), F.lit(v))]), F.col(name))
    best = F.min_by(F.struct(name, error), F.struct(F.col(error), pr)).alias("best")
    return scores.agg(best).select(F.col("best")[name].alias(f"best_{name}"), F.col("best")[error].alias(f"best_{error}"))


def density(values: DataFrame, group: str, value: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """Kernel density of an integer column per group on ``points`` equidistant places (F15): group, point, x, density.

    The bandwidth is n^(-1/5) sample deviations (Scott's rule); the places reach ``cut`` bandwidths beyond the values.
    Values are counted, each count is dealt out linearly to its two neighbouring places, and a Gaussian kernel is
    convolved over the places: after one grouped count the work does not depend on the rows. A group whose values are all
    equal, or that has one, has no bandwidth and no rows.
    """
    v = F.col(value).cast("long")
    counts = values.filter(v.isNotNull()).groupBy(group, v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    n, s = F.col("n_all"), F.col("s").cast("double")
    stats = counts.groupBy(group).agg(
        F.sum("n").alias("n_all"), F.sum(F.col("v") * F.col("n")).alias("s"),
        F.sum(F.col("v") * F.col("v") * F.col("n")).cast("double").alias("ss"), F.min("v").alias("least"), F.max("v").alias("most"))
    width = F.sqrt((F.col("ss") - s * s / n) / (n - 1)) * F.pow(n.cast("double"), F.lit(-0.2))
    stats = stats.filter("n_all > 1 AND least < most").withColumn("h", width)
    stats = stats.withColumns({"first": F.col("least") - cut * F.col("h"),
                               "step": (F.col("most") - F.col("least") + 2 * cut * F.col("h")) / (points - 1)})
    d = counts.join(stats, group)
    at = (F.col("v") - F.col("first")) / F.col("step")
    d = d.withColumns({"place": F.floor(at).cast("int"), "over": at - F.floor(at)})
    ends = F.array(F.struct(F.col("place").alias("j"), (F.col("n") * (1 - F.col("over"))).alias("w")),
                   F.struct((F.col("place") + 1).alias("j"), (F.col("n") * F.col("over")).alias("w")))
    dealt = d.select(group, F.explode(ends).alias("e")).groupBy(group, "e.j").agg(F.sum("e.w").alias("w"))
    bins = dealt.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("j", "w"))).alias("bins"))  # at most ``points``
    rows = stats.join(bins, group).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    kernel = F.aggregate("bins", F.lit(0.0), lambda a, b: a + b["w"] * F.exp(
        -0.5 * F.pow((F.col("point") - b["j"]) * F.col("step") / F.col("h"), F.lit(2.0))))
    scale = F.col("n_all") * F.col("h") * math.sqrt(2 * math.pi)
    return rows.select(group, "point", (F.col("first") + F.col("point") * F.col("step")).alias("x"),
                       (kernel / scale).alias("density"))
