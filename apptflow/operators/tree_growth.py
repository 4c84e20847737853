"""A classification tree grown level by level from grouped histograms (J8, J9 split audit).

Per level one aggregate counts the rows of every (node, column, value) and
class; numeric columns become prefix sums over their values. A candidate split
is "column = value" for texts and "column <= value" for numbers; the best of a
node is that with the largest decrease of class-weighted gini impurity (in whole
billionths; ties: the earlier column, then the smaller value). Rows take their
child's number from the level's splits, at most 2^level of them.

Nodes are numbered 1, then 2 i (left: the split holds) and 2 i + 1. A node whose best
decrease is under a billionth stays a leaf. Counts are integers and weights enter after
the sums, so results do not depend on partitioning.

``split_audit`` applies the same histograms to the nodes of any tree that rows have
been led through, to see whether each saved split is the best one.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apptflow.session import cut_lineage

NANO = 1_000_000_000


def gini(counts: list[Column], size: Column) -> Column:
    return reduce(lambda a, c: a - (c / size) * (c / size), counts, F.lit(1.0))


def _added(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def histogram(rows: DataFrame, label: str, labels: list[str], texts: list[str], numbers: list[str]) -> DataFrame:
    """node, column (its place in ``texts + numbers``), value, number and the rows of each class, n0, n1, ..."""
    cells = [F.struct(F.lit(i).alias("column"), F.col(c).cast("string").alias("value"), F.lit(None).cast("double").alias("number"))
             for i, c in enumerate(texts)]
    cells += [F.struct(F.lit(len(texts) + i).alias("column"), F.lit(None).cast("string").alias("value"),
                       F.col(c).cast("double").alias("number")) for i, c in enumerate(numbers)]
    d = rows.select("node", F.col(label).alias("_label"), F.explode(F.array(*cells)).alias("x")).select("node", "_label", "x.*")
    return d.groupBy("node", "column", "value", "number").agg(
        *[F.count(F.when(F.col("_label") == name, 1)).alias(f"n{k}") for k, name in enumerate(labels)])


def candidates(hist: DataFrame, weights: list[float], n_texts: int) -> DataFrame:
    """node, column, value, number, gain_nano, the node's rows of each class and the left ones', for every candidate split.

    Windows are over the values of one column in one node.
    """
    ks = range(len(weights))
    column = Window.partitionBy("node", "column")
    upto = column.orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = hist.withColumns({f"all{k}": F.sum(f"n{k}").over(column) for k in ks})
    d = d.withColumns({f"left{k}": F.when(F.col("column") < n_texts, F.col(f"n{k}")).otherwise(F.sum(f"n{k}").over(upto))
                       for k in ks})
    whole = [F.col(f"all{k}") * F.lit(w) for k, w in enumerate(weights)]
    left = [F.col(f"left{k}") * F.lit(w) for k, w in enumerate(weights)]
    right = [(F.col(f"all{k}") - F.col(f"left{k}")) * F.lit(w) for k, w in enumerate(weights)]
    d = d.withColumns({**{f"w{k}": c for k, c in enumerate(whole)}, **{f"l{k}": c for k, c in enumerate(left)},
                       **{f"r{k}": c for k, c in enumerate(right)}})
    sums = {s: _added([F.col(f"{s}{k}") for k in ks]) for s in "wlr"}
    d = d.withColumns({f"{s}_size": c for s, c in sums.items()}).filter("l_size > 0 AND r_size > 0")
    part = {s: gini([F.col(f"{s}{k}") for k in ks], F.col(f"{s}_size")) for s in "wlr"}
    gain = part["w"] - F.col("l_size") / F.col("w_size") * part["l"] - F.col("r_size") / F.col("w_size") * part["r"]
    return d.select("node", "column", "value", "number", F.floor(gain * NANO).alias("gain_nano"),
                    *[f"all{k}" for k in ks], *[f"left{k}" for k in ks])


def best_splits(found: DataFrame) -> DataFrame:
    """The best candidate of every node."""
    order = F.struct((-F.col("gain_nano")).alias("g"), "column", "value", "number")
    rest = F.struct(*[c for c in found.columns if c != "node"])
    return found.groupBy("node").agg(F.min_by(rest, order).alias("s")).select("node", "s.*").filter("gain_nano > 0")


def _holds(texts: list[str], numbers: list[str]) -> Column:
    """Whether the split (column, value, number) holds for a row."""
    values = F.array(*[F.col(c).cast("string") for c in texts])
    figures = F.array(*[F.col(c).cast("double") for c in numbers])
    return F.when(F.col("column") < len(texts), F.get(values, F.col("column")).eqNullSafe(F.col("value"))).otherwise(
        F.coalesce(F.get(figures, F.col("column") - len(texts)) <= F.col("number"), F.lit(False)))


def descend(rows: DataFrame, splits: DataFrame, texts: list[str], numbers: list[str]) -> DataFrame:
    """``rows`` with ``node`` one level further down where their node has a split; ``splits`` is a table of nodes."""
    cols = rows.columns
    d = rows.join(F.broadcast(splits.select("node", "column", "value", "number")), "node", "left")
    child = F.when(F.col("column").isNull(), F.col("node")).otherwise(
        2 * F.col("node") + F.when(_holds(texts, numbers), 0).otherwise(1))
    return d.withColumn("node", child).select(*cols)


def grow(train: DataFrame, label: str, labels: list[str], weights: list[float], texts: list[str], numbers: list[str],
         depth: int) -> DataFrame:
    """node, depth, column, value, number, gain_nano, all0, ..., left0, ... of every split of a tree of ``depth`` levels."""
    rows = cut_lineage(train.select(label, *texts, *numbers, F.lit(1).cast("long").alias("node")))
    found = None
    for level in range(depth):
        here = rows.filter(F.col("node") >= 1 << level)  # rows of leaves above stay behind
        best = best_splits(candidates(histogram(here, label, labels, texts, numbers), weights, len(texts)))
        best = cut_lineage(best.withColumn("depth", F.lit(level)))  # at most 2^level rows
        found = best if found is None else found.unionByName(best)
        if level + 1 < depth:
            rows = descend(rows, best, texts, numbers)
    return found


def classify(rows: DataFrame, splits: DataFrame, depth: int, labels: list[str], weights: list[float], texts: list[str],
             numbers: list[str], out: str = "predicted_class") -> DataFrame:
    """``rows`` with their leaf's node and class: the largest weighted count, ties to the first label."""
    d = rows.withColumn("node", F.lit(1).cast("long"))
    for level in range(depth):
        d = descend(d, splits.filter(F.col("depth") == level), texts, numbers)
    return d.join(F.broadcast(leaf_classes(splits, labels, weights, out)), "node", "left")


def leaf_classes(splits: DataFrame, labels: list[str], weights: list[float], out: str) -> DataFrame:
    """node and class of both children of every split; at most 2^(depth + 1) rows."""
    ks = range(len(labels))
    left = F.struct((2 * F.col("node")).alias("node"), F.array(*[F.col(f"left{k}") * F.lit(weights[k]) for k in ks]).alias("w"))
    right = F.struct((2 * F.col("node") + 1).alias("node"), F.array(
        *[(F.col(f"all{k}") - F.col(f"left{k}")) * F.lit(weights[k]) for k in ks]).alias("w"))
    kids = splits.select(F.explode(F.array(left, right)).alias("x")).select("x.*")
    names = F.array(*[F.lit(x) for x in labels])
    return kids.select("node", F.element_at(names, F.array_position("w", F.array_max("w")).cast("int")).alias(out))


def split_importances(splits: DataFrame, weights: list[float], names: list[str]) -> DataFrame:
    """feature, importance: weighted decrease of each column's splits over that of all."""
    size = _added([F.col(f"all{k}") * F.lit(w) for k, w in enumerate(weights)])
    whole = Window.partitionBy()  # a row for each column of the table
    feature = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("column") + 1)
    d = splits.groupBy(feature.alias("feature")).agg(F.sum(F.col("gain_nano") * size).alias("s"))
    return d.select("feature", (F.col("s") / F.sum("s").over(whole)).alias("importance"))


def split_audit(led: DataFrame, label: str, labels: list[str], weights: list[float], texts: list[str],
                numbers: list[str]) -> DataFrame:
    """node, best_gain (nano) over all candidate splits of the rows led to each ``node``."""
    found = candidates(histogram(led, label, labels, texts, numbers), weights, len(texts))
    return found.groupBy("node").agg(F.max("gain_nano").alias("best_gain"))
