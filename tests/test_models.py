"""Model training: better than the majority, importances, tree shape, save and load."""
import statistics
from contextvars import Context

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import functions as F

from apptflow.operators import features as fe
from apptflow.operators import models as ml
from apptflow.operators import tree_growth as growth
from apptflow.operators import trees
from apptflow.plans import q_features as qf
from apptflow.plans.registry import queries
from apptflow.session import stored
from apptflow.sources import dims
from apptflow.sources.adapters import shared_plans


@pytest.fixture(scope="module")
def q():
    return queries()


def test_classifier_beats_majority_and_survives_saving(spark, sf_small, q):
    scores = q["dt_scores"](spark, sf_small).cache()
    test = scores.filter("split = 'test'")
    n = test.count()
    majority = test.groupBy("class").count().agg(F.max("count")).first()[0]
    assert test.filter("class = predicted_class").count() > majority
    again = {r["patient_id"]: r["predicted_class"] for r in q["model_roundtrip"](spark, sf_small).collect()}
    first = {r["patient_id"]: r["predicted_class"] for r in scores.collect()}
    assert n and again == first
    assert first == {r["patient_id"]: r["predicted_class"] for r in q["tree_walk_scores"](spark, sf_small).collect()}


def test_importances_sum_to_one(spark, sf_small, q):
    sums = q["feature_importance"](spark, sf_small).groupBy("model").agg(F.sum("importance").alias("s")).collect()
    assert len(sums) == 2 and all(r["s"] == pytest.approx(1) for r in sums)


def test_children_hold_their_parents_rows(spark, sf_small, q):
    nodes = {r["id"]: r for r in q["tree_nodes"](spark, sf_small).collect()}
    inner = [r for r in nodes.values() if r["left_child"] >= 0]
    assert inner and all(nodes[r["left_child"]]["n_rows"] + nodes[r["right_child"]]["n_rows"] == r["n_rows"]
                         and nodes[r["left_child"]]["depth"] == r["depth"] + 1
                         and nodes[r["right_child"]]["parent"] == r["id"] for r in inner)


@pytest.fixture(scope="module")
def fitted(spark, sf_small):
    """Kind -> model, scored rows, nodes and features, fitted once."""
    out = {}
    with shared_plans():
        for kind in ("dt", "rf_cls", "rf_reg", "gbt_reg"):
            model, scored = qf._scores(spark, sf_small, kind)
            nodes = trees.saved_nodes(spark, model, ml.save_model(spark, model, kind)).cache()
            out[kind] = model, scored.cache(), nodes, trees.feature_table(spark, ml.feature_names(scored))
        yield out


@pytest.mark.parametrize("kind, how", [("dt", "tree"), ("rf_cls", "votes"), ("rf_reg", "mean"), ("gbt_reg", "sum")])
def test_walked_trees_predict_like_the_model(fitted, kind, how):
    model, scored, nodes, _ = fitted[kind]
    last = model.stages[-1]
    weights = list(last.treeWeights) if kind == "gbt_reg" else None
    walked = trees.score(scored, nodes, 10, how, weights)
    assert walked.filter(F.abs(F.col("prediction") - F.col("tree_prediction")) > 1e-9).isEmpty()


@pytest.mark.parametrize("kind", ["dt", "rf_cls", "rf_reg", "gbt_reg"])
def test_importances_from_nodes(fitted, kind):
    model, _, nodes, features = fitted[kind]
    rows = F.col("stats")[0] if kind.endswith("reg") else F.aggregate("stats", F.lit(0.0), lambda a, x: a + x)
    got = {r["feature_index"]: r["importance"]
           for r in trees.importances(nodes, features, rows, per_tree=kind != "gbt_reg").collect()}
    want = model.stages[-1].featureImportances.toArray()
    assert [got[i] for i in range(len(want))] == pytest.approx(list(want), abs=1e-9)


def test_paths_partition_the_rows(spark, fitted):
    """Every training row satisfies the path of one leaf, and each leaf's count is its number of rows."""
    model, scored, nodes, features = fitted["dt"]
    leaves = trees.tree_nodes(nodes, features).filter("left_child < 0").collect()
    names = [r["feature"] for r in features.orderBy("feature_index").collect()]
    x = scored.filter("split = 'train'").select("patient_id", vector_to_array("features").alias("x")).select(
        "patient_id", *[F.col("x")[i].alias(n) for i, n in enumerate(names)]).cache()

    def holds(step):
        for sign in (" not in ", " in ", " <= ", " > "):
            if sign in step:
                name, value = step.split(sign)
                return f"`{name}`{sign}{value}"

    counts = x.agg(*[F.count_if(F.expr(" AND ".join(map(holds, r["path"])))).alias(f"n{r['id']}") for r in leaves]).first()
    assert all(counts[f"n{r['id']}"] == r["n_rows"] for r in leaves)
    assert sum(counts) == x.count()


def test_grown_tree_begins_like_the_fitted_one(spark, sf_small, fitted):
    """The best splits of the histograms have the gains of the saved tree's first levels."""
    _, _, nodes, features = fitted["dt"]
    saved = {r["id"]: r for r in trees.tree_nodes(nodes, features).collect()}
    with shared_plans():
        grown = sorted((r["depth"], r["gain_nano"]) for r in qf._grown(spark, sf_small).collect())
    want = sorted((r["depth"], int(r["gain"] * growth.NANO)) for r in saved.values() if r["depth"] < 3 and r["left_child"] >= 0)
    assert len(grown) == len(want)
    assert all(a[0] == b[0] and abs(a[1] - b[1]) <= 2 for a, b in zip(grown, want))


def test_every_saved_split_is_the_best(spark, sf_small, fitted):
    """Rows led down the saved tree: no candidate of a node beats its split."""
    model, scored, nodes, features = fitted["dt"]
    with shared_plans():
        weights = qf._class_weight_list(spark, sf_small)
    saved = trees.tree_nodes(nodes, features).collect()
    inner = {r["id"]: r for r in saved if r["left_child"] >= 0 and r["depth"] < 4}
    rows = scored.filter("split = 'train'").withColumn("_x", vector_to_array("features"))
    one = trees.forest_row(nodes)
    names = [*qf.GROWN_TEXTS]
    for depth in range(4):
        led = rows.crossJoin(F.broadcast(one)).withColumn("node", trees.leaf_of(F.col("trees")[0], F.col("_x"), depth)["id"]
                                                          if depth else F.lit(0)).select("node", "class", *names, "age_z")
        best = {r["node"]: r["best_gain"] for r in growth.split_audit(
            led, "class", dims.CLASS_LABELS, weights, names, ["age_z"]).collect()}
        for i, r in inner.items():
            if r["depth"] == depth:
                assert abs(best[i] - int(r["gain"] * growth.NANO)) <= 2


def test_sparse_features_are_the_assembled_vector(spark, sf_small):
    with shared_plans():
        d = qf.prepared(spark, sf_small, "cls")
        known = fe.categories(d, fe.CLASSIFICATION_CATEGORICAL, 1)
        rows = fe.sparse_features(d, "patient_id", fe.CLASSIFICATION_CATEGORICAL, ["age_z"], known)
        got = {(r["patient_id"], r["feature_index"]): r["value"] for r in rows.collect()}
        v = fe.feature_pipeline(fe.CLASSIFICATION_CATEGORICAL, ["age_z"]).fit(d).transform(d)
        want = {(r["patient_id"], int(i)): x for r in v.select("patient_id", "features").collect()
                for i, x in enumerate(r["features"].toArray()) if x}
    assert got == want


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [5.0] * 7 + [1e300, -1e300], [float("inf"), 1.0, float("-inf"), 2.0],
                                    [float("nan"), 4.0, None, 6.0, 5.0], [2.0 ** k for k in range(-60, 60)]])
def test_median_by_selection(spark, values):
    d = spark.createDataFrame([(x,) for x in values], "x double")
    known = [x for x in values if x is not None and x == x]
    assert fe.fit_median(d, "x") == (statistics.median(known) if known else None)


def test_median_of_many_distinct_values(spark):
    d = spark.range(1_000_000).select((F.xxhash64("id") / 3.0).alias("x"))
    assert fe.fit_median(d, "x") == d.agg(F.median("x")).first()[0]


def test_assembled_width(spark, sf_small, q):
    got = q["assembled_features"](spark, sf_small).select("n_features").distinct().collect()
    assert len(got) == 1 and got[0][0] > 10


def test_statistics_and_training_read_a_written_history(spark, sf_small):
    with shared_plans():
        for task in ("cls", "reg"):
            plan = qf.prepared(spark, sf_small, task)._jdf.queryExecution().optimizedPlan().toString()
            assert "Window" not in plan and "Join" not in plan and "md5" not in plan


def test_fit_on_encoded_rows_is_the_whole_pipeline(spark, sf_small):
    with shared_plans():
        d = qf.prepared(spark, sf_small, "reg")
        t = d.filter("split = 'train'").withColumn("overrun", F.col("overrun_minutes").cast("double"))
        tree = DecisionTreeRegressor(featuresCol="features", labelCol="overrun", maxDepth=4, maxBins=128, seed=1)
        stages = fe.encoder_stages(fe.REGRESSION_CATEGORICAL, ["age_f"])
        whole = Pipeline(stages=[*stages, tree]).fit(t)
        ours = ml._fit(t, stages, tree, ["features", "overrun"])
        assert len(ours.stages) == len(whole.stages)
        assert ours.stages[-1].toDebugString.split("\n")[1:] == whole.stages[-1].toDebugString.split("\n")[1:]
        assert ml.feature_names(ours.transform(d)) == ml.feature_names(whole.transform(d))


def test_categories_are_broadcast_to_the_cells(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (2, "b", 0.0), (3, None, 1.0)], "k long, c string, x double")
    known = fe.categories(rows, ["c"], 1)
    out = fe.sparse_features(rows, "k", ["c"], ["x"], known)
    assert sorted(map(tuple, out.collect())) == [(1, 0, 2.0), (1, 1, 1.0), (2, 2, 1.0), (3, 0, 1.0)]
    assert "strategy=broadcast" in out._jdf.queryExecution().analyzed().toString()


@pytest.fixture(scope="module")
def alike(spark):
    """2,000 rows, about 50 distinct, with a null and numbers of rows that differ."""
    d = spark.range(2000).select((F.floor(F.sqrt("id")) % 5).alias("k"), (F.col("id") % 7 % 3).alias("v"))
    return d.select(F.nullif(F.concat(F.lit("c"), F.col("k").cast("string")), F.lit("c4")).alias("c"),
                    (F.col("v") * 10.0).alias("x"), (F.col("k") * 3.0 + F.col("v") * F.col("v") + F.col("k") % 2).alias("overrun"),
                    F.when(F.col("k") + F.col("v") > 3, "b").otherwise("a").alias("class"))


def _counted(monkeypatch, rows, cols):
    monkeypatch.setattr(ml, "MANY_ROWS", 1000)
    return ml.units(rows, cols)


def _trees(model):
    return [t.toDebugString.split("\n")[1:] for t in model.trees]


def test_units_are_the_distinct_rows_of_many_alike(monkeypatch, alike):
    assert ml.units(alike, ["c", "x", "overrun"]) is None  # few rows
    found = _counted(monkeypatch, alike, ["c", "x", "overrun"])
    got = {tuple(r)[:-1]: r["n_rows"] for r in found.collect()}
    want = {tuple(r)[:-1]: r["count"] for r in alike.groupBy("c", "x", "overrun").count().collect()}
    assert got == want and sum(got.values()) == 2000 and any(k[0] is None for k in got)
    assert ml.units(alike.withColumn("id", F.monotonically_increasing_id()), ["id"]) is None  # none alike


def test_boosting_on_units_is_boosting_on_rows(monkeypatch, alike):
    found = _counted(monkeypatch, alike, ["c", "x", "overrun"])
    gbt = GBTRegressor(featuresCol="features", labelCol="overrun", maxIter=4, maxDepth=3, stepSize=0.3, seed=1)
    stages = fe.encoder_stages(["c"], ["x"])
    whole, ours = ml._fit(alike, stages, gbt, ["features", "overrun"]), ml._fit_units(found, stages, gbt, "overrun")
    got = ours.transform(found).withColumnRenamed("prediction", "p").select(*found.columns, "p")
    both = whole.transform(found).join(got, [F.col("p") >= -1e9, *[found[c].eqNullSafe(got[c]) for c in ("c", "x", "overrun")]])
    assert both.count() == found.count() and both.filter(F.abs(F.col("prediction") - F.col("p")) > 1e-9).isEmpty()


def test_draws_of_a_unit_are_the_sum_of_its_rows_draws(spark):
    rows = [("a", None, 1), (None, "a", 1), ("b", "b", 30), ("c", "c", 4000)]
    found = spark.createDataFrame(rows, "c string, d string, n_rows long")
    draws = {r["c"] or r["d"] + "?": r["draws"] for r in ml.with_draws(found, 4000).collect()}
    for (c, d, n), got in zip(rows, (draws["a"], draws["a?"], draws["b"], draws["c"])):
        assert statistics.fmean(got) == pytest.approx(n, abs=5 * (n / 4000) ** 0.5)
        assert statistics.variance(got) == pytest.approx(n, rel=0.15)
    assert draws["a"] != draws["a?"]
    again = {r["c"] or r["d"] + "?": r["draws"] for r in ml.with_draws(found.repartition(3, "c"), 4000).collect()}
    assert again == draws


@pytest.mark.parametrize("kind", ["class", "reg"])
def test_forest_of_draws_is_grown_from_the_drawn_rows(spark, monkeypatch, tmp_path, alike, kind):
    """Each tree is the one that the learner grows from every row as often as it was drawn."""
    weighed = alike.withColumn("weight", F.when(F.col("class") == "b", 2.5).otherwise(0.5))
    same = {"featuresCol": "features", "featureSubsetStrategy": "all", "maxDepth": 4, "maxBins": 16, "seed": 3}
    if kind == "class":
        label, weight, stages, is_a = "label", "weight", [ml.label_indexer()], RandomForestClassificationModel
        forest = RandomForestClassifier(labelCol=label, weightCol=weight, numTrees=3, **same)
    else:
        label, weight, stages, is_a = "overrun", None, [], RandomForestRegressionModel
        forest = RandomForestRegressor(labelCol=label, numTrees=3, **same)
    found = _counted(monkeypatch, weighed, ["c", "x", "overrun", "class", "weight"])
    stages = [*stages, *fe.encoder_stages(["c"], ["x"])]
    ours = ml._fit_units(found, stages, forest, label, weight)
    last = ours.stages[-1]
    assert isinstance(last, is_a) and last.getNumTrees == 3 and last.getMaxDepth() == 4
    drawn = ml.with_draws(found, 3)
    for t in range(3):
        rows = drawn.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("draws")[t].cast("int"))))
        rows = PipelineModel(stages=ours.stages[:-1]).transform(rows)
        assert _trees(forest.copy({forest.numTrees: 1, forest.bootstrap: False}).fit(rows))[0] == _trees(last)[t]
    ours.write().save(f"{tmp_path}/model")
    assert _trees(PipelineModel.load(f"{tmp_path}/model").stages[-1]) == _trees(last)


def test_forest_and_boosting_are_trained_on_units(spark, sf_small, monkeypatch):
    """The learners' input has a row for every unit, not for every training row."""
    monkeypatch.setattr(ml, "MANY_ROWS", 1000)
    monkeypatch.setattr(ml, "ALIKE", 1)
    monkeypatch.setattr(ml, "regressor", lambda kind: RandomForestRegressor(labelCol="overrun", numTrees=2, maxDepth=2)
                        if kind == "rf" else GBTRegressor(labelCol="overrun", maxIter=2, maxDepth=2))
    written = {}

    def spy(df, what):
        out = stored(df, what)
        written.setdefault(what, []).append(out.count())
        return out

    monkeypatch.setattr(ml, "stored", spy)
    top = Context().run(queries()["feature_importance"], spark, sf_small)  # without the plans that a fixture shares
    assert top.filter("importance > 0").count() > 2
    assert len(written["units"]) == 1 and written["encoded"] == written["units"] * 2
    with shared_plans():
        assert written["units"][0] < qf.prepared(spark, sf_small, "reg").filter("split = 'train'").count()
