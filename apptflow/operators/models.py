"""Model training, scoring, importance and tree tables (J8-J15, A6) on pyspark.ml.

Training is Spark's distributed tree learning (per-partition histogram
aggregation); scoring is ``transform``. Hyper-parameters follow the
reference's models (T12): every one is set explicitly.

Trees see a row only through the columns they read, so forests and boosting
train on the distinct rows of those columns and the number of rows of each
("units"), where there are far fewer of them than rows: boosting by that number
as weight, a tree of a forest by the sum of its rows' bootstrap draws. Where
rows are few or seldom alike, they are trained on as they are.
"""
from __future__ import annotations

import random
import uuid
from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from apptflow.sources import dims

from apptflow.functions import flags as fx
from apptflow.operators import features as fe
from apptflow.session import ensure_checkpoint_dir, stored

SEED = 42

#: fewer training rows are trained on as they are
MANY_ROWS = 100_000
#: rows alike, on the average, from which on their units are trained on
ALIKE = 4
#: trees of a forest that are grown at the same time
TREES_AT_ONCE = 8


def label_indexer() -> StringIndexer:
    return StringIndexer(inputCol="class", outputCol="label", stringOrderType="alphabetAsc")


def classifier(kind: str):
    if kind == "dt":
        return DecisionTreeClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxDepth=10,
                                      impurity="gini", maxBins=128, seed=SEED)
    return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=100,
                                  maxDepth=10, featureSubsetStrategy="sqrt", impurity="gini", maxBins=128,
                                  bootstrap=True, seed=SEED)


def regressor(kind: str):
    if kind == "rf":  # the same trees with or without cached nodes, but a row need not walk each again for every level
        return RandomForestRegressor(featuresCol="features", labelCol="overrun", numTrees=100, maxDepth=10,
                                     featureSubsetStrategy="all", maxBins=128, cacheNodeIds=True, seed=SEED)
    return GBTRegressor(featuresCol="features", labelCol="overrun", maxIter=100, maxDepth=5, stepSize=0.1,
                        maxBins=128, seed=SEED)


def _fit(train: DataFrame, stages: list, estimator, cols: list[str]) -> PipelineModel:
    """``Pipeline(stages + estimator)``; the estimator reads the encoded rows several times, so they are written once."""
    encoder = Pipeline(stages=stages).fit(train)
    model = estimator.fit(stored(encoder.transform(train).select(*cols), "encoded"))
    return PipelineModel(stages=[*encoder.stages, model])


def units(train: DataFrame, cols: list[str]) -> DataFrame | None:
    """The distinct rows of ``cols`` with their ``n_rows``, written once; None if ``train`` has fewer than ``MANY_ROWS``
    rows or fewer than ``ALIKE`` times as many rows as units."""
    n = train.count()
    if n < MANY_ROWS:
        return None
    found = stored(train.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_rows")), "units")
    return found if found.count() * ALIKE <= n else None


def with_draws(found: DataFrame, trees: int, seed: int = SEED) -> DataFrame:
    """Add ``draws``: for every tree the sum of the bootstrap draws of a unit's rows.

    A row is drawn Poisson(1) times for a tree, so n rows Poisson(n) times. The generator is keyed by the unit's values:
    a retried task draws the same.
    """
    values = [c for c in found.columns if c != "n_rows"]
    keyed = found.withColumn("_key", F.xxhash64(*values, *[F.isnull(c) for c in values]))  # the hash passes over nulls

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = (batch.column(c).to_numpy() for c in ("_key", "n_rows"))
            out = np.empty((len(n), trees), dtype=np.int64)
            for i, (key, size) in enumerate(zip(keys.view(np.uint64).tolist(), n.tolist())):
                out[i] = np.random.Generator(np.random.Philox(key=[key, seed])).poisson(size, trees)
            offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * trees)
            drawn = pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))
            kept = [c for c in batch.schema.names if c != "_key"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), drawn], [*kept, "draws"])

    schema = StructType([*found.schema.fields, StructField("draws", ArrayType(LongType()))])
    return keyed.mapInArrow(draw, schema)


def fit_forest(rows: DataFrame, forest, weight: str | None = None):
    """The model of ``forest`` (a random forest estimator) from ``rows``, whose columns ``draw_<t>`` say how often tree t
    drew each; ``weight`` names a column of weights. Every tree is grown by the same learner as a forest of one."""
    trees = forest.getNumTrees()
    seeds = random.Random(forest.getSeed())
    jobs = [(t, seeds.getrandbits(62)) for t in range(trees)]

    def grow(job: tuple[int, int]):
        t, seed = job
        drawn = F.col(f"draw_{t}").cast("double")
        mine = rows.filter(F.col(f"draw_{t}") > 0).select(
            "features", forest.getLabelCol(), (drawn if weight is None else drawn * F.col(weight)).alias("_weight"))
        one = forest.copy({forest.numTrees: 1, forest.bootstrap: False, forest.seed: seed, forest.cacheNodeIds: False,
                           forest.weightCol: "_weight"})
        return one.fit(mine)

    with ThreadPool(TREES_AT_ONCE) as pool:
        grown = pool.map(inheritable_thread_target(rows.sparkSession)(grow), jobs, chunksize=1)
    return _forest_of(forest, grown)


def _forest_of(forest, grown: list):
    """The model that the estimator ``forest`` would have made of the first trees of the models ``grown``."""
    sc = SparkContext.getOrCreate()
    ml = sc._jvm.org.apache.spark.ml
    is_class = isinstance(forest, RandomForestClassifier)
    kind = ml.classification.DecisionTreeClassificationModel if is_class else ml.regression.DecisionTreeRegressionModel
    trees = sc._gateway.new_array(kind, len(grown))
    for t, m in enumerate(grown):
        trees[t] = m._java_obj.trees()[0]
    if is_class:
        made = ml.classification.RandomForestClassificationModel(
            forest.uid, trees, grown[0].numFeatures, max(m.numClasses for m in grown))
    else:
        made = ml.regression.RandomForestRegressionModel(forest.uid, trees, grown[0].numFeatures)
    forest._transfer_params_to_java()
    forest._java_obj.copyValues(made, ml.param.ParamMap())
    return forest._copyValues(forest._create_model(made))


def _fit_units(found: DataFrame, stages: list, estimator, label: str, weight: str | None = None) -> PipelineModel:
    """As ``_fit``, from the units of the training rows: a forest's trees by draws, else by numbers of rows."""
    encoder = Pipeline(stages=stages).fit(found)
    cols = ["features", label, *([weight] if weight else [])]
    if isinstance(estimator, GBTRegressor):
        rows = encoder.transform(found).select(*cols, F.col("n_rows").cast("double").alias("n_rows"))
        model = estimator.copy({estimator.weightCol: "n_rows"}).fit(stored(rows, "encoded"))
    else:
        trees = estimator.getNumTrees()
        rows = encoder.transform(with_draws(found, trees)).select(
            *cols, *[F.col("draws")[t].alias(f"draw_{t}") for t in range(trees)])
        model = fit_forest(stored(rows, "encoded"), estimator, weight)
    return PipelineModel(stages=[*encoder.stages, model])


def classification_rows(train: DataFrame) -> DataFrame:
    w = fe.class_weights(train, "class").select("class", "weight")
    return train.join(F.broadcast(w), "class")  # <= number of classes rows


def regression_rows(train: DataFrame) -> DataFrame:
    return train.withColumn("overrun", F.col("overrun_minutes").cast("double"))


def classification_units(train: DataFrame) -> DataFrame | None:
    return units(classification_rows(train), [*fe.CLASSIFICATION_CATEGORICAL, "age_z", "class", "weight"])


def regression_units(train: DataFrame) -> DataFrame | None:
    return units(regression_rows(train), [*fe.REGRESSION_CATEGORICAL, "age_f", "overrun"])


def fit_classifier(train: DataFrame, kind: str, found: DataFrame | None = None) -> PipelineModel:
    """From the units ``found`` of the rows, if given."""
    stages = [label_indexer(), *fe.encoder_stages(fe.CLASSIFICATION_CATEGORICAL, ["age_z"])]
    if found is not None:
        return _fit_units(found, stages, classifier(kind), "label", "weight")
    return _fit(classification_rows(train), stages, classifier(kind), ["features", "label", "weight"])


def fit_regressor(train: DataFrame, kind: str, found: DataFrame | None = None) -> PipelineModel:
    """From the units ``found`` of the rows, if given."""
    stages = fe.encoder_stages(fe.REGRESSION_CATEGORICAL, ["age_f"])
    if found is not None:
        return _fit_units(found, stages, regressor(kind), "overrun")
    return _fit(regression_rows(train), stages, regressor(kind), ["features", "overrun"])


def class_labels(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labelsArray[0])


def predicted_class(model: PipelineModel, scored: DataFrame) -> DataFrame:
    """Map the numeric prediction back to the class label."""
    labels = F.array(*[F.lit(x) for x in class_labels(model)])
    return scored.withColumn("predicted_class", F.element_at(labels, F.col("prediction").cast("int") + 1))


def feature_names(scored: DataFrame, col: str = "features") -> list[str]:
    """Expanded feature names from the assembler's ML attribute metadata."""
    meta = scored.schema[col].metadata.get("ml_attr", {})
    attrs = []
    for group in meta.get("attrs", {}).values():
        attrs.extend(group)
    return [a["name"] for a in sorted(attrs, key=lambda a: a["idx"])]


def feature_importance(spark: SparkSession, model: PipelineModel, scored: DataFrame, name: str) -> DataFrame:
    """(model, feature, importance) for every expanded feature."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    names = feature_names(scored)
    rows = [(name, n, float(v)) for n, v in zip(names, imp)]
    t = dims.literal(spark, rows, "model string, feature string, importance double")
    return t.withColumn("feature", fx.clean_feature_name("feature"))


def top_k(df: DataFrame, group: str, order: str, k: int = 10) -> DataFrame:
    """Top k rows per group by a descending score."""
    w = Window.partitionBy(group).orderBy(F.desc(order), F.asc("feature"))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def save_model(spark: SparkSession, model: PipelineModel, name: str) -> str:
    """Persist under the shared checkpoint directory."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{name}-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    return path
