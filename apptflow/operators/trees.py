"""Fitted trees as tables: decoded splits, paths, scoring and importances by relational means.

A saved tree is a table of at most 2^(depth + 1) nodes a tree, numbered from 0
in pre-order. Everything here reads that table alone:

* ``tree_nodes``: depth, split text and the root-to-node path of every node, by
  a recursive query over parent pointers;
* ``score``: rows walk the trees: a tree is an array of nodes by number, folded
  over its levels with ``aggregate``, so a row is scored where it lies;
* ``importances``: the impurity decrease of every split, weighted by its node's
  rows, summed by feature and normalised per tree.
"""
from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apptflow.functions import flags as fx
from apptflow.sources import dims


def feature_table(spark: SparkSession, names: list[str]) -> DataFrame:
    """feature_index, feature: the assembled vector's slots with cleaned names."""
    t = dims.literal(spark, list(enumerate(names)), "feature_index int, feature string")
    return t.withColumn("feature", fx.clean_feature_name("feature"))


def saved_nodes(spark: SparkSession, model: PipelineModel, model_path: str) -> DataFrame:
    """Nodes of the last stage's trees, read from the data saved at ``model_path``: tree_id, id, prediction, impurity,
    stats, n_rows, gain, left_child, right_child and the split: feature_index and threshold or left_values (the values
    of a categorical feature that go left)."""
    # a stage's folder is named by its number, in as many digits as the last one has, and its uid
    n = len(model.stages)
    folder = f"{n - 1:0{len(str(n))}d}_{model.stages[-1].uid}"
    nodes = spark.read.parquet(f"{model_path}/stages/{folder}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select("treeID", "nodeData.*")
    else:
        nodes = nodes.withColumn("treeID", F.lit(0))
    inner = F.col("leftChild") >= 0
    is_value_set = F.col("split.numCategories") >= 0
    return nodes.select(
        F.col("treeID").alias("tree_id"), "id", "prediction", "impurity", F.col("impurityStats").alias("stats"),
        F.col("rawCount").alias("n_rows"), "gain", F.col("leftChild").alias("left_child"),
        F.col("rightChild").alias("right_child"), F.when(inner, F.col("split.featureIndex")).alias("feature_index"),
        F.when(inner & ~is_value_set, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.when(inner & is_value_set, F.col("split.leftCategoriesOrThreshold")).alias("left_values"))


def split_text(left: bool) -> Column:
    """The predicate of a node's rows that go left or right."""
    by_threshold = F.concat("feature", F.lit(" <= " if left else " > "), F.col("threshold").cast("string"))
    by_values = F.concat("feature", F.lit(" in (" if left else " not in ("), F.array_join(
        F.transform("left_values", lambda x: x.cast("string")), ", "), F.lit(")"))
    return F.when(F.col("threshold").isNotNull(), by_threshold).otherwise(by_values)


def tree_nodes(nodes: DataFrame, features: DataFrame) -> DataFrame:
    """``nodes`` with feature, split, parent, depth and path (the predicates from the root to the node)."""
    named = nodes.join(features, "feature_index", "left")
    named = named.withColumns({"left_text": split_text(True), "right_text": split_text(False)})
    walked = nodes.sparkSession.sql("""
        WITH RECURSIVE walk(tree_id, id, parent, depth, path) AS (
          SELECT tree_id, id, CAST(NULL AS INT), 0, CAST(array() AS array<string>) FROM {named} WHERE id = 0
          UNION ALL
          SELECT w.tree_id, IF(side = 0, n.left_child, n.right_child), n.id, w.depth + 1,
            concat(w.path, array(IF(side = 0, n.left_text, n.right_text)))
          FROM walk w JOIN {named} n ON n.tree_id = w.tree_id AND n.id = w.id
          LATERAL VIEW explode(array(0, 1)) s AS side
          WHERE n.left_child >= 0)
        SELECT * FROM walk""", named=named)
    return named.withColumn("split", F.when(F.col("left_child") >= 0, F.col("left_text"))).drop(
        "left_text", "right_text").join(walked, ["tree_id", "id"])


def forest_row(nodes: DataFrame) -> DataFrame:
    """One row: ``trees``, an array of arrays of nodes by number. At most trees x 2^(depth + 1) nodes."""
    node = F.struct("id", "left_child", "right_child", "feature_index", "threshold", "left_values", "prediction", "stats")
    trees = nodes.groupBy("tree_id").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    return trees.agg(F.transform(F.sort_array(F.collect_list(F.struct("tree_id", "nodes"))), lambda t: t["nodes"]).alias("trees"))


def leaf_of(tree: Column, x: Column, depth: int) -> Column:
    """The leaf that the array ``x`` reaches: one step a level."""
    def step(node: Column, _: Column) -> Column:
        value = F.get(x, node["feature_index"])
        left = F.when(node["threshold"].isNotNull(), value <= node["threshold"]).otherwise(
            F.array_contains(node["left_values"], value))
        return F.when(node["left_child"] < 0, node).otherwise(
            F.get(tree, F.when(left, node["left_child"]).otherwise(node["right_child"])))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, depth))), F.get(tree, F.lit(0)), step)


def score(rows: DataFrame, nodes: DataFrame, depth: int, kind: str, weights: list[float] | None = None,
          features: str = "features", out: str = "tree_prediction") -> DataFrame:
    """Add the prediction of the trees in ``nodes`` for the vector column ``features``.

    ``kind``: ``tree`` (its leaf's prediction), ``votes`` (the class with the largest sum of leaves' shares),
    ``mean`` or ``sum`` (of the leaves' predictions, by ``weights``). The trees are one row, joined on a constant.
    """
    one = forest_row(nodes).withColumn("_one", F.lit(1))
    d = rows.withColumns({"_one": F.lit(1), "_x": vector_to_array(features)}).join(F.broadcast(one), "_one")
    leaves = F.transform("trees", lambda t: leaf_of(t, F.col("_x"), depth))
    d = d.withColumn("_leaves", leaves)
    if kind == "tree":
        value = F.col("_leaves")[0]["prediction"]
    elif kind == "votes":
        shares = F.transform("_leaves", lambda leaf: F.transform(leaf["stats"], lambda s: s / F.aggregate(
            leaf["stats"], F.lit(0.0), lambda a, y: a + y)))
        first = F.transform(F.get(shares, F.lit(0)), lambda _: F.lit(0.0))
        votes = F.aggregate(shares, first, lambda a, s: F.zip_with(a, s, lambda p, q: p + q))
        value = (F.array_position(votes, F.array_max(votes)) - 1).cast("double")
    else:
        factors = F.array(*[F.lit(float(w)) for w in weights]) if weights else F.transform("trees", lambda _: F.lit(1.0))
        total = F.aggregate(F.zip_with("_leaves", factors, lambda leaf, w: leaf["prediction"] * w), F.lit(0.0),
                            lambda a, y: a + y)
        value = total / F.size("trees") if kind == "mean" else total
    return d.withColumn(out, value).drop("_one", "_x", "trees", "_leaves")


def importances(nodes: DataFrame, features: DataFrame, weighted_count: Column, per_tree: bool = True) -> DataFrame:
    """feature, importance of every feature (J13, J14): sums of gain x ``weighted_count`` of the splits on it, normalised
    per tree, then over all. ``per_tree=False`` leaves the trees' sums as they are."""
    gains = (nodes.filter(F.col("left_child") >= 0).groupBy("tree_id", "feature_index")
             .agg(F.sum(F.col("gain") * weighted_count).alias("decrease")))
    whole = gains.groupBy("tree_id").agg(F.sum("decrease").alias("whole"))
    share = F.col("decrease") / F.col("whole") if per_tree else F.col("decrease")
    sums = gains.join(whole, "tree_id").filter("whole > 0").groupBy("feature_index").agg(F.sum(share).alias("s"))
    every = features.join(sums, "feature_index", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    total = every.agg(F.sum("s").alias("total"), F.lit(1).alias("_one"))  # one row
    d = every.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    return d.select("feature_index", "feature", F.when(F.col("total") > 0, F.col("s") / F.col("total"))
                    .otherwise(F.lit(0.0)).alias("importance"))
