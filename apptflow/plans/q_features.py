"""Feature preparation (oracle-checked) and model queries (rows-only)."""
from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from apptflow.functions.draws import u, u_sql
from apptflow.operators import features as fe
from apptflow.operators import metrics as mx
from apptflow.operators import models as ml
from apptflow.operators import tree_growth as tg
from apptflow.operators import trees as tr
from apptflow.operators.sampling import exact_split
from apptflow.plans import sqlviews as sv
from apptflow.plans.registry import query
from apptflow.plans.sqlfmt import with_
from apptflow.session import stored
from apptflow.sources import adapters, dims
from apptflow.sources.adapters import memo_plan

MISSING_RATE = 0.05  # share of ages / genders blanked to exercise imputation


@memo_plan
def with_missing(spark, sf_dir):
    a = adapters.appointment(spark, sf_dir)
    return a.withColumns({
        "age": F.when(u("patient_id", "age_missing") < MISSING_RATE, F.lit(None).cast("int")).otherwise(F.col("age")),
        "gender": F.when(u("patient_id", "gender_missing") < MISSING_RATE, F.lit(None).cast("string"))
        .otherwise(F.col("gender")),
    })


def _missing_sql() -> str:
    return sv.appointment_cte() + f""",
am AS (SELECT patient_id, CASE WHEN {u_sql('patient_id', 'age_missing')} < {MISSING_RATE} THEN NULL ELSE age END AS age,
              CASE WHEN {u_sql('patient_id', 'gender_missing')} < {MISSING_RATE} THEN NULL ELSE gender END AS gender
       FROM appointment)"""


@query("impute_median", lambda: with_(_missing_sql()) +
       " SELECT patient_id, coalesce(CAST(age AS DOUBLE), (SELECT median(age) FROM am)) AS age_filled FROM am")
def impute_median(spark, sf_dir):
    d = with_missing(spark, sf_dir)
    d = d.withColumn("age", F.col("age").cast("double"))
    return fe.impute(d, "age", fe.fit_median(d, "age"), "age_filled").select("patient_id", "age_filled")


@query("impute_mean", lambda: with_(_missing_sql()) +
       " SELECT patient_id, coalesce(CAST(age AS DOUBLE), (SELECT avg(age) FROM am)) AS age_filled FROM am")
def impute_mean(spark, sf_dir):
    d = with_missing(spark, sf_dir)
    d = d.withColumn("age", F.col("age").cast("double"))
    return fe.impute(d, "age", fe.fit_mean(d, "age"), "age_filled").select("patient_id", "age_filled")


@query("impute_mode", lambda: with_(_missing_sql()) + """
SELECT patient_id, coalesce(gender, (SELECT gender FROM am WHERE gender IS NOT NULL GROUP BY gender
                                     ORDER BY count(*) DESC, gender LIMIT 1)) AS gender_filled FROM am""")
def impute_mode(spark, sf_dir):
    d = with_missing(spark, sf_dir)
    return fe.impute(d, "gender", fe.fit_mode(d, "gender"), "gender_filled").select("patient_id", "gender_filled")


@query("standardise", lambda: with_(sv.appointment_cte()) + """,
st AS (SELECT count(age) AS n, sum(age) AS s, sum(CAST(age AS BIGINT) * age) AS ss FROM appointment)
SELECT patient_id, CASE WHEN (n * ss - s * s) = 0 THEN 0.0 ELSE
       (age - CAST(s AS DOUBLE) / n) / sqrt(CAST(n * ss - s * s AS DOUBLE) / CAST(n * n AS DOUBLE)) END AS age_z
FROM appointment, st""")
def standardise(spark, sf_dir):
    """(x - mean) / population std with exact-sum statistics."""
    a = adapters.appointment(spark, sf_dir)
    return a.select("patient_id", fe.standardise(F.col("age"), *fe.fit_standardise(a, "age")).alias("age_z"))


@query("one_hot", lambda: with_(sv.appointment_cte()) + """,
cats AS (SELECT scan_type, CAST(row_number() OVER (ORDER BY scan_type) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT scan_type FROM appointment) d)
SELECT a.patient_id, a.scan_type, c.idx AS hot_index, CAST((SELECT count(*) FROM cats) AS INTEGER) AS vec_size
FROM appointment a JOIN cats c ON a.scan_type = c.scan_type""")
def one_hot(spark, sf_dir):
    """StringIndexer(alphabetAsc, keep) + OneHotEncoder(dropLast) as exploded columns."""
    a = adapters.appointment(spark, sf_dir).select("patient_id", "scan_type")
    model = fe.feature_pipeline(["scan_type"], []).fit(a)
    enc = model.transform(a).withColumn("arr", vector_to_array("features"))
    hot = F.array_position("arr", F.lit(1.0)) - 1
    return enc.select("patient_id", "scan_type", F.when(hot >= 0, hot).cast("int").alias("hot_index"),
                      F.size("arr").alias("vec_size"))


@query("class_weights", lambda: with_(sv.appointment_cte()) + """
SELECT class, n_c, CAST(n AS DOUBLE) / CAST(k * n_c AS DOUBLE) AS weight FROM
 (SELECT class, count(*) AS n_c FROM appointment GROUP BY class) c,
 (SELECT count(*) AS n, count(DISTINCT class) AS k FROM appointment) t""")
def class_weights(spark, sf_dir):
    return fe.class_weights(adapters.appointment(spark, sf_dir), "class")


# --- models (rows-only checks) -------------------------------------------------------

@memo_plan
def split_history(spark, sf_dir):
    """The appointments with their split, written once: every statistic and every pass of a training reads them again."""
    a = adapters.appointment(spark, sf_dir)
    return stored(exact_split(a, ["site"]), "history")


@memo_plan
def prepared(spark, sf_dir, task: str):
    d = split_history(spark, sf_dir)
    train = d.filter(F.col("split") == "train")
    if task == "cls":
        return fe.prepare_classification(d, fit_on=train)
    return fe.prepare_regression(d, fit_on=train)


@memo_plan
def training_units(spark, sf_dir, task: str):
    """The distinct training rows with their numbers, or None (see ``ml.units``)."""
    train = prepared(spark, sf_dir, task).filter(F.col("split") == "train")
    return ml.classification_units(train) if task == "cls" else ml.regression_units(train)


@memo_plan
def fitted(spark, sf_dir, kind: str) -> PipelineModel:
    task = "cls" if kind in ("dt", "rf_cls") else "reg"
    d = prepared(spark, sf_dir, task)
    train = d.filter(F.col("split") == "train")
    if kind == "dt":  # its nodes' numbers are numbers of rows
        return ml.fit_classifier(train, "dt")
    found = training_units(spark, sf_dir, task)
    if task == "cls":
        return ml.fit_classifier(train, "rf", found)
    return ml.fit_regressor(train, "rf" if kind == "rf_reg" else "gbt", found)


def _scores(spark, sf_dir, kind):
    task = "cls" if kind in ("dt", "rf_cls") else "reg"
    d = prepared(spark, sf_dir, task)
    m = fitted(spark, sf_dir, kind)
    return m, m.transform(d)


def _encoder_sql() -> str:
    """Known categories with the encoder's slots, and the age statistics of the training rows."""
    cells = " UNION ALL ".join(f"SELECT {i} AS col, {c} AS v, patient_id FROM halves" for i, c in enumerate(fe.CLASSIFICATION_CATEGORICAL))
    return with_(sv.appointment_cte(), f"""
halves AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY site ORDER BY {u_sql('patient_id', 'split')}, patient_id)
   <= (count(*) OVER (PARTITION BY site) * 20 + 99) // 100 THEN 'test' ELSE 'train' END AS split FROM appointment),
cells AS ({cells}),
known AS (SELECT col, v, CAST(row_number() OVER (ORDER BY col, v) AS INT) AS feature_index FROM (SELECT DISTINCT col, v FROM cells) t),
ages AS (SELECT count(age) AS n, sum(age) AS s, sum(CAST(age AS BIGINT) * age) AS ss FROM halves WHERE split = 'train'),
numbers AS (SELECT patient_id, CASE WHEN n * ss - s * s = 0 THEN 0.0 ELSE
  (age - CAST(s AS DOUBLE) / n) / sqrt(CAST(n * ss - s * s AS DOUBLE) / CAST(n * n AS DOUBLE)) END AS z FROM halves, ages),
entries AS (SELECT patient_id, 0 AS feature_index, z AS value FROM numbers WHERE z <> 0
  UNION ALL SELECT patient_id, feature_index, 1.0 FROM cells JOIN known USING (col, v))""")


@query("sparse_features", lambda: _encoder_sql() +
       " SELECT patient_id, feature_index, round(value, 9) AS value FROM entries")
def sparse_features(spark, sf_dir):
    """The assembled vectors as a table of entries."""
    d = prepared(spark, sf_dir, "cls")
    known = fe.categories(d, fe.CLASSIFICATION_CATEGORICAL, 1)
    rows = fe.sparse_features(d, "patient_id", fe.CLASSIFICATION_CATEGORICAL, ["age_z"], known)
    return rows.withColumn("value", F.round("value", 9))


@query("assembled_features", lambda: _encoder_sql() + """
SELECT patient_id, (SELECT 1 + count(*) FROM known)::INT AS n_features, count(*)::INT AS nnz FROM entries GROUP BY patient_id""")
def assembled_features(spark, sf_dir):
    """Routed and assembled feature vectors."""
    # Drop the non-feature columns that are present; absent names are ignored
    d = prepared(spark, sf_dir, "cls").drop("scheduled_at", "actual_end", "actual_minutes", "overrun_minutes",
                                            "scheduled_minutes", "arrival_offset", "not_a_column")
    model = fe.feature_pipeline(fe.CLASSIFICATION_CATEGORICAL, ["age_z"]).fit(d)
    v = model.transform(d).withColumn("arr", vector_to_array("features"))
    return v.select("patient_id", F.size("arr").alias("n_features"),
                    F.size(F.filter("arr", lambda x: x != 0)).alias("nnz"))


@query("dt_scores")
def dt_scores(spark, sf_dir):
    """Decision tree, depth 10, balanced weights."""
    m, s = _scores(spark, sf_dir, "dt")
    return ml.predicted_class(m, s).select("patient_id", "split", "class", "predicted_class")


@query("rf_class_scores")
def rf_class_scores(spark, sf_dir):
    """Random forest classifier, 100 trees x depth 10."""
    m, s = _scores(spark, sf_dir, "rf_cls")
    return ml.predicted_class(m, s).select("patient_id", "split", "class", "predicted_class")


@query("rf_reg_scores")
def rf_reg_scores(spark, sf_dir):
    """Random forest regressor, 100 trees x depth 10, all features per split."""
    _, s = _scores(spark, sf_dir, "rf_reg")
    return s.select("patient_id", "split", "overrun_minutes", F.col("prediction").alias("predicted_overrun"))


@query("gbt_reg_scores")
def gbt_reg_scores(spark, sf_dir):
    """Gradient-boosted regressor, 100 x depth 5, step 0.1."""
    _, s = _scores(spark, sf_dir, "gbt_reg")
    return s.select("patient_id", "split", "overrun_minutes", F.col("prediction").alias("predicted_overrun"))


@query("model_class_report")
def model_class_report(spark, sf_dir):
    """Classification reports of both classifiers over all rows."""
    out = None
    for kind, name in (("dt", "Decision Tree"), ("rf_cls", "Random Forest")):
        m, s = _scores(spark, sf_dir, kind)
        rep = mx.classification_report(ml.predicted_class(m, s), "class", "predicted_class", name)
        out = rep if out is None else out.unionByName(rep)
    return out


@query("model_regression_report")
def model_regression_report(spark, sf_dir):
    """MAE / RMSE / R² of both regressors on the test split (F9 on J10, J11)."""
    out = None
    for kind, name in (("rf_reg", "Random Forest"), ("gbt_reg", "Gradient Boosting")):
        _, s = _scores(spark, sf_dir, kind)
        t = s.filter(F.col("split") == "test").select(
            F.lit(name).alias("model"), F.col("overrun_minutes").cast("double").alias("y"), "prediction")
        out = t if out is None else out.unionByName(t)
    return mx.regression_errors(out, "model", "y", "prediction")


@query("feature_importance")
def feature_importance(spark, sf_dir):
    """Importances of every expanded feature, both regressors."""
    out = None
    for kind, name in (("rf_reg", "Random Forest"), ("gbt_reg", "Gradient Boosting")):
        m, s = _scores(spark, sf_dir, kind)
        t = ml.feature_importance(spark, m, s, name)
        out = t if out is None else out.unionByName(t)
    return out


@query("topk_importance")
def topk_importance(spark, sf_dir):
    """Top 10 features per model."""
    return ml.top_k(feature_importance(spark, sf_dir), "model", "importance", 10)


@query("tree_nodes")
def tree_nodes(spark, sf_dir):
    """Nodes of the decision tree with depth, gini, counts, split text and path."""
    m, scored = _scores(spark, sf_dir, "dt")
    nodes = tr.saved_nodes(spark, m, ml.save_model(spark, m, "dt"))
    return tr.tree_nodes(nodes, tr.feature_table(spark, ml.feature_names(scored)))


@query("tree_walk_scores")
def tree_walk_scores(spark, sf_dir):
    """The decision tree's classes by walking its table of nodes (J12); equals ``dt_scores``."""
    m, _ = _scores(spark, sf_dir, "dt")
    nodes = tr.saved_nodes(spark, m, ml.save_model(spark, m, "dt"))
    d = m.stages[-2].transform(prepared_vectors(spark, sf_dir, m))
    d = tr.score(d, nodes, m.stages[-1].getMaxDepth(), "tree", out="prediction")
    return ml.predicted_class(m, d).select("patient_id", "split", "class", "predicted_class")


def prepared_vectors(spark, sf_dir, model: PipelineModel):
    """Rows after the stages before the assembler."""
    d = prepared(spark, sf_dir, "cls")
    for stage in model.stages[:-2]:
        d = stage.transform(d)
    return d


# --- a tree grown by grouped histograms (J7, J8, J12, J13, G3) -------------------

GROWN_DEPTH = 3
GROWN_TEXTS = fe.CLASSIFICATION_CATEGORICAL
GROWN_NUMBERS = ["age"]


@memo_plan
def _class_weight_list(spark, sf_dir) -> list[float]:
    """Balanced weights of the training rows' classes, in the order of their labels; 0 for one that is absent."""
    train = split_history(spark, sf_dir).filter(F.col("split") == "train")
    known = {r["class"]: r["weight"] for r in fe.class_weights(train, "class").collect()}  # a row for each class
    return [float(known.get(c, 0.0)) for c in dims.CLASS_LABELS]


@memo_plan
def _grown(spark, sf_dir):
    train = split_history(spark, sf_dir).filter(F.col("split") == "train")
    return tg.grow(train, "class", dims.CLASS_LABELS, _class_weight_list(spark, sf_dir), GROWN_TEXTS, GROWN_NUMBERS, GROWN_DEPTH)


def _grown_sql() -> str:
    """Twin of ``tree_growth``: the histograms, candidates and best splits of each level, and the rows led down."""
    ks = range(len(dims.CLASS_LABELS))
    names = [*GROWN_TEXTS, *GROWN_NUMBERS]
    n_texts = len(GROWN_TEXTS)
    texts, numbers = ", ".join(GROWN_TEXTS), ", ".join(f"CAST({c} AS DOUBLE)" for c in GROWN_NUMBERS)
    ctes = [sv.appointment_cte(), f"""
halves AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY site ORDER BY {u_sql('patient_id', 'split')}, patient_id)
   <= (count(*) OVER (PARTITION BY site) * 20 + 99) // 100 THEN 'test' ELSE 'train' END AS split FROM appointment),
sized AS (SELECT class, count(*) AS n_c FROM halves WHERE split = 'train' GROUP BY class),
weighed AS (SELECT {', '.join(f"coalesce((SELECT (SELECT sum(n_c) FROM sized)::DOUBLE / ((SELECT count(*) FROM sized) * n_c)::DOUBLE FROM sized WHERE class = '{c}'), 0.0) AS c{k}" for k, c in enumerate(dims.CLASS_LABELS))}),
rows0 AS (SELECT patient_id, class, split, 1 AS node, [{texts}] AS ts, [{numbers}] AS ns FROM halves)"""]

    def sums(s: str) -> str:
        return " + ".join(f"{s}{k}" for k in ks)

    def part(s: str) -> str:
        return "(1.0::DOUBLE" + "".join(f" - ({s}{k} / {s}_size) * ({s}{k} / {s}_size)" for k in ks) + ")"

    for level in range(GROWN_DEPTH):
        counts = ", ".join(f"count(*) FILTER (class = '{c}') AS n{k}" for k, c in enumerate(dims.CLASS_LABELS))
        ctes.append(f"""hist{level} AS (
  SELECT node, col, v, x, {counts} FROM (
    SELECT node, class, unnest(range({n_texts})) AS col, unnest(ts) AS v, NULL::DOUBLE AS x FROM rows{level} WHERE split = 'train' AND node >= {1 << level}
    UNION ALL SELECT node, class, {n_texts} + unnest(range({len(GROWN_NUMBERS)})), NULL, unnest(ns) FROM rows{level} WHERE split = 'train' AND node >= {1 << level}) t
  GROUP BY node, col, v, x),
cand{level} AS (SELECT *, {', '.join(f"sum(n{k}) OVER (PARTITION BY node, col) AS all{k}" for k in ks)},
  {', '.join(f"CASE WHEN col < {n_texts} THEN n{k} ELSE sum(n{k}) OVER (PARTITION BY node, col ORDER BY x ROWS UNBOUNDED PRECEDING) END AS left{k}" for k in ks)}
  FROM hist{level}),
mass{level} AS (SELECT *, {', '.join(f"all{k} * c{k} AS w{k}, left{k} * c{k} AS l{k}, (all{k} - left{k}) * c{k} AS r{k}" for k in ks)} FROM cand{level}, weighed),
total{level} AS (SELECT *, {sums('w')} AS w_size, {sums('l')} AS l_size, {sums('r')} AS r_size FROM mass{level}),
gain{level} AS (SELECT *, floor(({part('w')} - l_size / w_size * {part('l')} - r_size / w_size * {part('r')}) * {tg.NANO})::BIGINT AS gain_nano
  FROM total{level} WHERE l_size > 0 AND r_size > 0),
best{level} AS (SELECT * FROM gain{level} QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain_nano DESC, col, v, x) = 1 AND gain_nano > 0),
rows{level + 1} AS (SELECT r.patient_id, r.class, r.split, r.ts, r.ns,
  CASE WHEN b.node IS NULL THEN r.node WHEN b.col < {n_texts} THEN 2 * r.node + CASE WHEN r.ts[b.col + 1] IS NOT DISTINCT FROM b.v THEN 0 ELSE 1 END
       ELSE 2 * r.node + CASE WHEN coalesce(r.ns[b.col - {n_texts} + 1] <= b.x, false) THEN 0 ELSE 1 END END AS node
  FROM rows{level} r LEFT JOIN best{level} b ON b.node = r.node)""")
    every = " UNION ALL ".join(f"SELECT *, {level} AS depth FROM best{level}" for level in range(GROWN_DEPTH))
    named = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    ctes.append(f"splits AS (SELECT *, {named}[col + 1] AS feature FROM ({every}) t)")
    return with_(*ctes)


_SPLIT_COLS = ["node", "depth", "feature", "value", "number", "gain_nano", *[f"all{k}" for k in range(3)],
               *[f"left{k}" for k in range(3)]]


@query("grown_tree", lambda: _grown_sql() + " SELECT node, depth, feature, v AS value, x AS number, gain_nano, "
       + ", ".join(f"all{k}::BIGINT AS all{k}, left{k}::BIGINT AS left{k}" for k in range(3)) + " FROM splits")
def grown_tree(spark, sf_dir):
    """Splits of the first levels of the weighted classification tree, each the best of its node (J8 split audit)."""
    names = F.array(*[F.lit(n) for n in [*GROWN_TEXTS, *GROWN_NUMBERS]])
    return _grown(spark, sf_dir).withColumn("feature", F.element_at(names, F.col("column") + 1)).select(*_SPLIT_COLS)


def _grown_scores_sql() -> str:
    ks = range(len(dims.CLASS_LABELS))
    pick = {s: "CASE " + " ".join(
        f"WHEN {s}{k} = greatest({', '.join(f'{s}{j}' for j in ks)}) THEN '{dims.CLASS_LABELS[k]}'" for k in ks) + " END"
        for s in "lr"}
    return _grown_sql() + f""",
leaves AS (SELECT 2 * node AS node, {pick['l']} AS predicted_class FROM splits
           UNION ALL SELECT 2 * node + 1, {pick['r']} FROM splits)
SELECT patient_id, split, class, r.node::BIGINT AS node, predicted_class FROM rows{GROWN_DEPTH} r LEFT JOIN leaves USING (node)"""


@query("grown_tree_scores", _grown_scores_sql)
def grown_tree_scores(spark, sf_dir):
    """Every appointment's leaf and class in the grown tree."""
    d = split_history(spark, sf_dir).select("patient_id", "split", "class", *GROWN_TEXTS, *GROWN_NUMBERS)
    d = tg.classify(d, _grown(spark, sf_dir), GROWN_DEPTH, dims.CLASS_LABELS, _class_weight_list(spark, sf_dir),
                    GROWN_TEXTS, GROWN_NUMBERS)
    return d.select("patient_id", "split", "class", "node", "predicted_class")


@query("grown_importance_top", lambda: _grown_sql() + """,
sums AS (SELECT feature, sum(gain_nano * w_size) AS s FROM splits GROUP BY feature),
shares AS (SELECT feature, s / (SELECT sum(s) FROM sums) AS importance FROM sums)
SELECT 'Grown Tree' AS model, feature, round(importance, 9) AS importance,
  row_number() OVER (ORDER BY importance DESC, feature)::INT AS rank FROM shares QUALIFY rank <= 3""")
def grown_importance_top(spark, sf_dir):
    """The top features by weighted impurity decrease."""
    d = tg.split_importances(_grown(spark, sf_dir), _class_weight_list(spark, sf_dir), [*GROWN_TEXTS, *GROWN_NUMBERS])
    d = ml.top_k(d.withColumn("model", F.lit("Grown Tree")), "model", "importance", 3)
    return d.select("model", "feature", F.round("importance", 9).alias("importance"), "rank")


@query("model_roundtrip")
def model_roundtrip(spark, sf_dir):
    """Save, reload and re-score the decision tree."""
    m = fitted(spark, sf_dir, "dt")
    path = ml.save_model(spark, m, "dt_roundtrip")
    loaded = PipelineModel.load(path)
    d = prepared(spark, sf_dir, "cls")
    return ml.predicted_class(loaded, loaded.transform(d)).select("patient_id", "class", "predicted_class")
