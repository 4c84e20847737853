"""Policies, the three-way comparison and its metrics."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apptflow.functions import flags as fx
from apptflow.functions.draws import _sql_lit
from apptflow.operators import metrics as mx
from apptflow.operators import policies as pol
from apptflow.operators import reports
from apptflow.plans import sqlviews as sv
from apptflow.plans.q_core import _reason_text_sql
from apptflow.plans.registry import query
from apptflow.plans.sqlfmt import ratio_round_sql, values_sql, with_
from apptflow.session import ensure_checkpoint_dir
from apptflow.sources import adapters, dims
from apptflow.sources.adapters import memo_plan
from apptflow.sources.io import read_csv, write_csv

POLICIES = ["baseline", "heuristic", "ml"]
MODEL_KEYS = ["reason_text", "contrast"]


# --- Spark side --------------------------------------------------------------

@memo_plan
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    appt = adapters.appointment(spark, sf_dir)
    return appt.select(
        "patient_id", F.col("actual_minutes").alias("duration_actual"),
        pol.baseline_minutes("scan_type").alias("duration_baseline"), F.col("class").alias("class_actual"),
        fx.reason_text().alias("reason_text"), "contrast", "overrun_minutes", *dims.FLAG_COLUMNS)


@memo_plan
def overrun_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group-mean overrun model fitted on the whole history. Its row count is
    bounded by the distinct (flag text, contrast) patterns (<= 2^10 x 2)."""
    return pol.group_mean_model(history(spark, sf_dir), MODEL_KEYS)


def with_model_policy(spark: SparkSession, sf_dir: str, req: DataFrame) -> DataFrame:
    """``req`` with predicted_overrun, duration_ml and class_ml."""
    model = overrun_model(spark, sf_dir).select(*MODEL_KEYS, "predicted_overrun")
    s = req.join(F.broadcast(model), MODEL_KEYS, "left").withColumn(  # at most 2^10 x 2 rows
        "predicted_overrun", F.coalesce("predicted_overrun", F.lit(0.0)))
    rounded = F.greatest(F.lit(0), F.bround("predicted_overrun", 0).cast("int"))
    return s.withColumns({"duration_ml": pol.model_minutes("scan_type", "predicted_overrun"),
                          "class_ml": pol.class_from_extra(rounded)})


def with_heuristic_policy(req: DataFrame) -> DataFrame:
    """``req`` with duration_heuristic and class_heuristic."""
    return pol.with_averages_policy(req).withColumnsRenamed(
        {"heuristic_minutes": "duration_heuristic", "heuristic_class": "class_heuristic"}).drop("heuristic_extra")


@memo_plan
def policy_requests(spark, sf_dir) -> DataFrame:
    """Requests with what the policies read."""
    return adapters.request_base(spark, sf_dir).select(
        "site", "patient_id", "scan_type", fx.reason_text().alias("reason_text"), "contrast", *dims.FLAG_COLUMNS)


@memo_plan
def heuristic_policy(spark, sf_dir) -> DataFrame:
    return with_heuristic_policy(policy_requests(spark, sf_dir)).select(
        "patient_id", "duration_heuristic", "class_heuristic")


@memo_plan
def ml_policy(spark, sf_dir) -> DataFrame:
    return with_model_policy(spark, sf_dir, policy_requests(spark, sf_dir)).select("patient_id", "duration_ml", "class_ml")


@memo_plan
def comparison(spark, sf_dir) -> DataFrame:
    """Both policies against history for every request, in one pass.

    Request, history and both policies derive row-wise from the same source
    row, so instead of two shuffle joins on patient id this is one scan plus
    a broadcast of the bounded group-mean model.
    """
    r = adapters.request_base(spark, sf_dir, ("actual_minutes", "scan_type", "class")).select(
        "patient_id", "scan_type", "contrast", fx.reason_text().alias("reason_text"),
        F.col("hist_actual_minutes").alias("duration_actual"),
        pol.baseline_minutes("hist_scan_type").alias("duration_baseline"),
        F.col("hist_class").alias("class_actual"))
    model = overrun_model(spark, sf_dir).select(*MODEL_KEYS, "predicted_overrun")
    s = r.join(F.broadcast(model), MODEL_KEYS, "left").withColumn(  # at most 2^10 x 2 rows
        "predicted_overrun", F.coalesce("predicted_overrun", F.lit(0.0)))
    s = pol.with_averages_policy(s)
    rounded = F.greatest(F.lit(0), F.bround("predicted_overrun", 0).cast("int"))
    def label(c):  # class labels compared as trimmed strings (C13)
        return F.trim(c.cast("string"))
    return s.select("patient_id", pol.model_minutes("scan_type", "predicted_overrun").alias("duration_ml"),
                    label(pol.class_from_extra(rounded)).alias("class_ml"), "duration_actual", "duration_baseline",
                    label(F.col("class_actual")).alias("class_actual"),
                    F.col("heuristic_minutes").alias("duration_heuristic"),
                    label(F.col("heuristic_class")).alias("class_heuristic"))


@memo_plan
def policy_long(spark, sf_dir) -> DataFrame:
    """One row per (patient, policy): planned vs actual minutes, via one explode."""
    m = comparison(spark, sf_dir)
    arr = F.array(*[F.struct(F.lit(p).alias("policy"), F.col(f"duration_{p}").alias("planned")) for p in POLICIES])
    return m.select("patient_id", "duration_actual", F.explode(arr).alias("x")).select(
        "patient_id", "duration_actual", "x.policy", "x.planned")


# --- SQL side ----------------------------------------------------------------

def _extra_sql(reason: str, scan: str) -> str:
    table = dict(dims.FLAG_AVERAGE)
    terms = []
    for words, key in pol.AVERAGE_RULES:
        cond = " OR ".join(f"lower({reason}) LIKE '%{w}%'" for w in words)
        v = float(table.get(key, dims.FLAG_AVERAGE_FALLBACK[key]))
        terms.append(f"CASE WHEN {cond} THEN {v!r} ELSE 0.0 END")
    c = float(table.get("contrast", dims.FLAG_AVERAGE_FALLBACK["contrast"]))
    return f"(greatest(0.0, {', '.join(terms)}) + CASE WHEN lower({scan}) LIKE '%contrast%' THEN {c!r} ELSE 0.0 END)"


def _class_sql(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 'Class 1' WHEN {x} <= 20 THEN 'Class 2' ELSE 'Class 3' END"


def comparison_ctes() -> str:
    flags = ", ".join(dims.FLAG_COLUMNS)
    return sv.request_base_cte() + f""",
hist AS (SELECT patient_id, actual_minutes AS duration_actual, CAST({sv.rule_minutes_sql('scan_type')} AS INTEGER) AS duration_baseline,
                class AS class_actual, {_reason_text_sql()} AS reason_text, contrast, overrun_minutes, {flags}
         FROM appointment),
model AS (SELECT reason_text, contrast, {ratio_round_sql('sum(overrun_minutes)', 'count(*)', 2)} AS predicted_overrun,
                 count(*) AS n_train FROM hist GROUP BY reason_text, contrast),
req AS (SELECT patient_id, scan_type, {_reason_text_sql()} AS reason_text, contrast FROM request_base),
heur AS (SELECT patient_id, CAST({sv.rule_minutes_sql('scan_type')} + he AS INTEGER) AS duration_heuristic,
                {_class_sql('he')} AS class_heuristic
         FROM (SELECT *, CAST(round_even({_extra_sql('reason_text', 'scan_type')}, 0) AS INTEGER) AS he FROM req) t),
scored AS (SELECT r.patient_id, r.scan_type, coalesce(m.predicted_overrun, 0.0) AS predicted_overrun
           FROM req r LEFT JOIN model m ON r.reason_text = m.reason_text AND r.contrast = m.contrast),
ml AS (SELECT patient_id, CAST({sv.rule_minutes_sql('scan_type')} + mo AS INTEGER) AS duration_ml, {_class_sql('mo')} AS class_ml
       FROM (SELECT *, greatest(0, CAST(round_even(predicted_overrun, 0) AS INTEGER)) AS mo FROM scored) t),
merged AS (SELECT ml.patient_id, duration_ml, trim(CAST(class_ml AS VARCHAR)) AS class_ml, duration_actual,
                  duration_baseline, trim(CAST(class_actual AS VARCHAR)) AS class_actual,
                  duration_heuristic, trim(CAST(class_heuristic AS VARCHAR)) AS class_heuristic
           FROM ml JOIN hist ON ml.patient_id = hist.patient_id JOIN heur ON heur.patient_id = ml.patient_id),
plong AS (SELECT patient_id, duration_actual, 'baseline' AS policy, duration_baseline AS planned FROM merged
          UNION ALL SELECT patient_id, duration_actual, 'heuristic', duration_heuristic FROM merged
          UNION ALL SELECT patient_id, duration_actual, 'ml', duration_ml FROM merged)"""


def _report_sql(model: str, actual: str, predicted: str, src: str) -> str:
    labels = dims.CLASS_LABELS
    aggs = ["count(*) AS n", f"count(*) FILTER (WHERE {actual} = {predicted}) AS hits"]
    for i, c in enumerate(labels):
        aggs += [f"count(*) FILTER (WHERE {actual} = '{c}' AND {predicted} = '{c}') AS tp{i}",
                 f"count(*) FILTER (WHERE {predicted} = '{c}') AS pp{i}",
                 f"count(*) FILTER (WHERE {actual} = '{c}') AS sp{i}"]

    def d0(n, d):
        return f"CASE WHEN ({d}) = 0 THEN 0.0 ELSE CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) END"

    per = [(c, d0(f"tp{i}", f"pp{i}"), d0(f"tp{i}", f"sp{i}"), d0(f"tp{i} * 2", f"pp{i} + sp{i}"), f"sp{i}")
           for i, c in enumerate(labels)]
    k = float(len(labels))
    sup = " + ".join(x[4] for x in per)
    arms = [f"SELECT '{model}' AS model, '{c}' AS class_or_avg, {p} AS precision, {r} AS recall, {f} AS f1_score, "
            f"CAST({s} AS DOUBLE) AS support FROM agg" for c, p, r, f, s in per]
    for name, fn in (("macro avg", lambda i: "(" + " + ".join(f"({x[i]})" for x in per) + f") / {k!r}"),
                     ("weighted avg", lambda i: d0("(" + " + ".join(f"({x[i]}) * {x[4]}" for x in per) + ")", sup))):
        arms.append(f"SELECT '{model}', '{name}', {fn(1)}, {fn(2)}, {fn(3)}, CAST({sup} AS DOUBLE) FROM agg")
    arms.append(f"SELECT '{model}', 'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), {d0('hits', 'n')}, "
                f"CAST(n AS DOUBLE) FROM agg")
    return f"(WITH agg AS (SELECT {', '.join(aggs)} FROM {src}) " + " UNION ALL ".join(arms) + ")"


# --- registered queries ---------------------------------------------------------

@query("policy_baseline", lambda: with_(sv.request_base_cte()) +
       f" SELECT patient_id, CAST({sv.rule_minutes_sql('scan_type')} AS INTEGER) AS baseline_minutes FROM request_base")
def policy_baseline(spark, sf_dir):
    r = adapters.request_base(spark, sf_dir)
    return r.select("patient_id", pol.baseline_minutes("scan_type").alias("baseline_minutes"))


@query("policy_averages", lambda: with_(comparison_ctes()) + " SELECT * FROM heur")
def policy_averages(spark, sf_dir):
    return heuristic_policy(spark, sf_dir)


@query("policy_averages_table", lambda: with_(comparison_ctes()) + " SELECT * FROM heur")
def policy_averages_table(spark, sf_dir):
    """The averages policy with its table written, read back and joined."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/averages/{uuid.uuid4().hex}"
    write_csv(dims.flag_average(spark), path)
    averages = read_csv(spark, path, "flag STRING, minutes DOUBLE")
    req = adapters.request_base(spark, sf_dir).select("patient_id", "scan_type", fx.reason_text().alias("reason_text"))
    extra = F.bround("extra", 0).cast("int")
    return pol.averages_extra_joined(req, averages).select(
        "patient_id", (pol.baseline_minutes("scan_type") + extra).cast("int").alias("duration_heuristic"),
        pol.class_from_extra(extra).alias("class_heuristic"))


@query("policy_model", lambda: with_(comparison_ctes()) + " SELECT * FROM ml")
def policy_model(spark, sf_dir):
    return ml_policy(spark, sf_dir)


@query("overrun_model", lambda: with_(comparison_ctes()) + " SELECT * FROM model")
def overrun_model_q(spark, sf_dir):
    return overrun_model(spark, sf_dir)


@query("regression_metrics", lambda: with_(comparison_ctes()) + """
SELECT policy, count(*) AS n, CAST(sum(abs(planned - duration_actual)) AS DOUBLE) / count(*) AS mae,
       CAST(sum((planned - duration_actual) * (planned - duration_actual)) AS DOUBLE) / count(*) AS mse,
       sqrt(CAST(sum((planned - duration_actual) * (planned - duration_actual)) AS DOUBLE) / count(*)) AS rmse,
       CASE WHEN count(*) * sum(duration_actual * duration_actual) - sum(duration_actual) * sum(duration_actual) = 0 THEN NULL
            ELSE 1.0 - CAST(count(*) * sum((planned - duration_actual) * (planned - duration_actual)) AS DOUBLE)
                 / CAST(count(*) * sum(CAST(duration_actual AS BIGINT) * duration_actual) - sum(duration_actual) * sum(duration_actual) AS DOUBLE) END AS r2
FROM plong GROUP BY policy""")
def regression_metrics(spark, sf_dir):
    return mx.regression_metrics(policy_long(spark, sf_dir), "policy", "duration_actual", "planned")


@query("overtime_idle", lambda: with_(comparison_ctes()) + """
SELECT policy, coalesce(sum(CASE WHEN planned - duration_actual < 0 THEN duration_actual - planned END), 0) AS overtime,
       coalesce(sum(CASE WHEN planned - duration_actual > 0 THEN planned - duration_actual END), 0) AS idle,
       coalesce(sum(abs(planned - duration_actual)), 0) AS total_inefficiency
FROM plong GROUP BY policy""")
def overtime_idle(spark, sf_dir):
    return mx.overtime_idle(policy_long(spark, sf_dir), "policy", "duration_actual", "planned")


@query("classification_report", lambda: with_(comparison_ctes()) +
       " SELECT * FROM " + _report_sql("ml", "class_actual", "class_ml", "merged") + " r")
def classification_report(spark, sf_dir):
    return mx.classification_report(comparison(spark, sf_dir), "class_actual", "class_ml", "ml")


@query("union_reports", lambda: with_(comparison_ctes()) + " SELECT * FROM " +
       _report_sql("heuristic", "class_actual", "class_heuristic", "merged") + " a UNION ALL SELECT * FROM " +
       _report_sql("ml", "class_actual", "class_ml", "merged") + " b")
def union_reports(spark, sf_dir):
    m = comparison(spark, sf_dir)
    return (mx.classification_report(m, "class_actual", "class_heuristic", "heuristic")
            .unionByName(mx.classification_report(m, "class_actual", "class_ml", "ml")))


@query("confusion_matrix", lambda: with_(comparison_ctes()) + f""",
lab AS {values_sql([(c,) for c in dims.CLASS_LABELS], ['c'])},
cl AS (SELECT 'heuristic' AS model, class_actual AS actual, class_heuristic AS predicted FROM merged
       UNION ALL SELECT 'ml', class_actual, class_ml FROM merged),
cnt AS (SELECT model, actual, predicted, count(*) AS n FROM cl GROUP BY 1, 2, 3),
grid AS (SELECT m.model, a.c AS actual, p.c AS predicted FROM (SELECT DISTINCT model FROM cnt) m, lab a, lab p)
SELECT g.model, g.actual, g.predicted, coalesce(cnt.n, 0) AS n FROM grid g
LEFT JOIN cnt ON cnt.model = g.model AND cnt.actual = g.actual AND cnt.predicted = g.predicted""")
def confusion_matrix(spark, sf_dir):
    m = comparison(spark, sf_dir)
    arr = F.array(F.struct(F.lit("heuristic").alias("model"), F.col("class_heuristic").alias("predicted")),
                  F.struct(F.lit("ml").alias("model"), F.col("class_ml").alias("predicted")))
    long = m.select("class_actual", F.explode(arr).alias("x")).select("class_actual", "x.model", "x.predicted")
    return mx.confusion_matrix(long, "class_actual", "predicted", group=["model"])


METRIC_PICKS = [("Accuracy", "accuracy", "f1_score"), ("Weighted F1", "weighted avg", "f1_score"),
                ("Class 3 Recall (Safety)", "Class 3", "recall")]


@query("metrics_long", lambda: with_(comparison_ctes()) + ", rep AS (SELECT * FROM " +
       _report_sql("heuristic", "class_actual", "class_heuristic", "merged") + " a UNION ALL SELECT * FROM " +
       _report_sql("ml", "class_actual", "class_ml", "merged") + " b) " + " UNION ALL ".join(
           f"SELECT model, '{lbl}' AS metric, coalesce({col}, 0.0) AS score FROM rep WHERE class_or_avg = '{row}'"
           for lbl, row, col in METRIC_PICKS))
def metrics_long(spark, sf_dir):
    """Wide report -> (model, metric, score) for accuracy, weighted F1, Class 3 recall."""
    rep = union_reports(spark, sf_dir)
    picks = F.array(*[F.struct(F.lit(lbl).alias("metric"), F.lit(row).alias("row"), F.lit(col).alias("col"))
                      for lbl, row, col in METRIC_PICKS])
    x = rep.select("*", F.explode(picks).alias("p")).filter(F.col("class_or_avg") == F.col("p.row"))
    score = F.when(F.col("p.col") == "recall", F.col("recall")).otherwise(F.col("f1_score"))
    return x.select("model", F.col("p.metric").alias("metric"), F.coalesce(score, F.lit(0.0)).alias("score"))


@query("residuals", lambda: with_(comparison_ctes()) +
       " SELECT policy, CAST(sum(duration_actual - planned) AS DOUBLE) / count(*) AS mean_residual, count(*) AS n"
       " FROM plong GROUP BY policy")
def residuals(spark, sf_dir):
    """Residual = actual - planned; its mean per policy."""
    long = policy_long(spark, sf_dir).withColumn("residual", F.col("duration_actual") - F.col("planned"))
    return long.groupBy("policy").agg((F.sum("residual") / F.count(F.lit(1))).alias("mean_residual"),
                                      F.count(F.lit(1)).alias("n"))


HIST_LO, HIST_HI, HIST_BINS = -60, 60, 24


@query("residual_histogram", lambda: with_(comparison_ctes()) + f"""
SELECT policy, CAST(CASE WHEN r < {HIST_LO} THEN 0 WHEN r >= {HIST_HI} THEN {HIST_BINS + 1}
                    ELSE floor((r - ({HIST_LO})) * {HIST_BINS} / {HIST_HI - HIST_LO}) + 1 END AS BIGINT) AS bin, count(*) AS n
FROM (SELECT policy, duration_actual - planned AS r FROM plong) t GROUP BY 1, 2""")
def residual_histogram(spark, sf_dir):
    """Fixed-bin residual density, the data behind a KDE plot."""
    long = policy_long(spark, sf_dir).withColumn("r", F.col("duration_actual") - F.col("planned"))
    b = F.width_bucket(F.col("r").cast("double"), F.lit(float(HIST_LO)), F.lit(float(HIST_HI)), F.lit(HIST_BINS))
    return long.groupBy("policy", b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


DENSITY_POINTS = 200


@query("residual_density", lambda: with_(comparison_ctes()) + f""",
cnt AS (SELECT policy, CAST(duration_actual - planned AS BIGINT) AS v, count(*) AS n FROM plong GROUP BY ALL),
st0 AS (SELECT policy, sum(n)::BIGINT AS n_all, sum(v * n)::DOUBLE AS s, sum(v * v * n)::DOUBLE AS ss, min(v) AS least, max(v) AS most
        FROM cnt GROUP BY policy),
st1 AS (SELECT *, sqrt((ss - s * s / n_all) / (n_all - 1)) * pow(n_all::DOUBLE, -0.2::DOUBLE) AS h FROM st0 WHERE n_all > 1 AND least < most),
st AS (SELECT *, least - 3.0::DOUBLE * h AS first, (most - least + 2 * 3.0::DOUBLE * h) / {DENSITY_POINTS - 1} AS step FROM st1),
placed AS (SELECT policy, n, (v - first) / step AS pos FROM cnt JOIN st USING (policy)),
dealt AS (SELECT policy, j, sum(w) AS w FROM (
  SELECT policy, floor(pos) AS j, n * (1 - (pos - floor(pos))) AS w FROM placed
  UNION ALL SELECT policy, floor(pos) + 1, n * (pos - floor(pos)) FROM placed) t GROUP BY policy, j)
SELECT st.policy, p.point::INT AS point, round(first + p.point * step, 6) AS x,
  round(sum(w * exp(-0.5::DOUBLE * pow((p.point - j) * step / h, 2))) / (n_all * h * sqrt(2 * pi())), 9) AS density
FROM st JOIN dealt USING (policy), range({DENSITY_POINTS}) p(point) GROUP BY st.policy, p.point, first, step, n_all, h""")
def residual_density(spark, sf_dir):
    """Kernel density of the residuals of each policy."""
    long = policy_long(spark, sf_dir).withColumn("r", F.col("duration_actual") - F.col("planned"))
    d = mx.density(long, "policy", "r", DENSITY_POINTS)
    return d.select("policy", "point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


def _pct_diff_sql(base: str, x: str) -> str:
    # hundredths B (baseline) and M; tenths of a percent of (B-M)/B, half-even, signed
    num = f"(({base}) - ({x})) * 1000"
    return (f"CASE WHEN ({base}) = 0 THEN '0.0%' ELSE (CASE WHEN {num} < 0 THEN '-' ELSE '' END) || "
            f"CAST(t // 10 AS VARCHAR) || '.' || CAST(t % 10 AS VARCHAR) || '%' END")


@query("model_comparison", lambda: with_(comparison_ctes()) + f""",
m AS (SELECT policy, CAST({ratio_round_sql('sum(abs(planned - duration_actual))', 'count(*)', 2)} AS DOUBLE) AS mae,
             CAST(round_even(sum(abs(planned - duration_actual)) * 100.0 / count(*), 0) AS BIGINT) AS mae_c
      FROM plong GROUP BY policy),
b AS (SELECT mae_c AS base_c FROM m WHERE policy = 'baseline'),
d AS (SELECT m.*, b.base_c, abs(b.base_c - m.mae_c) * 1000 AS an FROM m, b),
e AS (SELECT *, an // base_c AS q, an - (an // base_c) * base_c AS r FROM d),
f AS (SELECT *, q + CASE WHEN 2 * r > base_c OR (2 * r = base_c AND q % 2 = 1) THEN 1 ELSE 0 END AS t FROM e)
SELECT policy, mae, CASE WHEN policy = 'baseline' THEN '-' ELSE {_pct_diff_sql('base_c', 'mae_c')} END AS pct_diff_vs_baseline
FROM f""")
def model_comparison(spark, sf_dir):
    """MAE table with the % difference against the first (baseline) policy."""
    long = policy_long(spark, sf_dir)
    agg = long.groupBy("policy").agg(F.sum(F.abs(F.col("planned") - F.col("duration_actual"))).alias("sae"),
                                     F.count(F.lit(1)).alias("n"))
    hundredths = (fx.ratio_round(F.col("sae"), F.col("n"), 2) * 100).cast("long")
    m = agg.select("policy", fx.ratio_round(F.col("sae"), F.col("n"), 2).alias("mae"), hundredths.alias("mae_c"))
    base = m.filter(F.col("policy") == "baseline").select(F.lit(1).alias("_k"), F.col("mae_c").alias("base_c"))
    d = m.withColumn("_k", F.lit(1)).join(F.broadcast(base), "_k").drop("_k")  # one baseline row
    an = F.abs(F.col("base_c") - F.col("mae_c")) * 1000
    text = fx.pct_text(an / 1000, F.col("base_c"))
    signed = F.concat(F.when(F.col("base_c") < F.col("mae_c"), F.lit("-")).otherwise(F.lit("")), text)
    return d.select("policy", "mae", F.when(F.col("policy") == "baseline", F.lit("-"))
                    .otherwise(F.when(F.col("base_c") == 0, F.lit("0.0%")).otherwise(signed))
                    .alias("pct_diff_vs_baseline"))


PRIORITY = {"baseline": 2, "heuristic": 1, "ml": 0}


@query("best_model", lambda: with_(comparison_ctes()) + f"""
SELECT policy AS best_policy, mae AS best_mae FROM (
  SELECT policy, CAST(sum(abs(planned - duration_actual)) AS DOUBLE) / count(*) AS mae,
         CASE policy {' '.join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items())} END AS pr
  FROM plong GROUP BY policy) t ORDER BY mae, pr LIMIT 1""")
def best_model(spark, sf_dir):
    """Lowest MAE wins; ties go to the model policy, then heuristic (F16)."""
    agg = policy_long(spark, sf_dir).groupBy("policy").agg(
        (F.sum(F.abs(F.col("planned") - F.col("duration_actual"))) / F.count(F.lit(1))).alias("mae"))
    return mx.best_of(agg, "policy", "mae", PRIORITY)


@query("value_range", lambda: with_(comparison_ctes()) +
       " SELECT min(least(duration_actual, planned)) AS lo, max(greatest(duration_actual, planned)) AS hi FROM plong")
def value_range(spark, sf_dir):
    long = policy_long(spark, sf_dir)
    return long.agg(F.min(F.least("duration_actual", "planned")).alias("lo"),
                    F.max(F.greatest("duration_actual", "planned")).alias("hi"))


@memo_plan
def _hist_scored(spark, sf_dir) -> DataFrame:
    """History rows scored by the overrun model, prediction in hundredths."""
    h = history(spark, sf_dir)
    model = overrun_model(spark, sf_dir).select(*MODEL_KEYS, "predicted_overrun")
    s = h.join(F.broadcast(model), MODEL_KEYS, "left")  # at most 2^10 x 2 rows
    centi = F.bround(fx.clip_zero("predicted_overrun") * 100, 0).cast("long")
    rounded = F.greatest(F.lit(0), F.bround("predicted_overrun", 0).cast("int"))
    return s.withColumns({"pred_centi": centi, "class_pred": pol.class_from_extra(rounded)})


F2_FLAGS = [c for c in dims.FLAG_COLUMNS if c not in ("mobility_needs", "cognitive_conditions")] + ["contrast"]


def _hist_scored_sql() -> str:
    return """, hs AS (SELECT h.*, CAST(round_even(greatest(0.0, m.predicted_overrun) * 100, 0) AS BIGINT) AS pred_centi,
       """ + _class_sql("greatest(0, CAST(round_even(m.predicted_overrun, 0) AS INTEGER))") + """ AS class_pred
       FROM hist h LEFT JOIN model m ON h.reason_text = m.reason_text AND h.contrast = m.contrast)"""


@query("flag_avg_prediction", lambda: with_(comparison_ctes()) + _hist_scored_sql() + ", fl AS (" + " UNION ALL ".join(
    f"SELECT {_sql_lit(dims.FLAG_DISPLAY[c])} AS flag, pred_centi FROM hs WHERE lower({c}) = 'yes'" for c in F2_FLAGS)
    + f") SELECT flag, {ratio_round_sql('sum(pred_centi)', 'count(*) * 100', 2)} AS avg_predicted_overrun,"
      " count(*) AS n_patients FROM fl GROUP BY flag")
def flag_avg_prediction(spark, sf_dir):
    """Per-flag mean predicted overrun and patient count (F2)."""
    s = _hist_scored(spark, sf_dir)
    long = reports.flag_long(s, F2_FLAGS, ["pred_centi"], truthy=["yes"])
    agg = long.groupBy("flag").agg(F.sum("pred_centi").alias("s"), F.count(F.lit(1)).alias("n_patients"))
    return agg.select("flag", fx.ratio_round(F.col("s"), F.col("n_patients") * 100, 2).alias("avg_predicted_overrun"),
                      "n_patients")


@query("class_avg_prediction", lambda: with_(comparison_ctes()) + _hist_scored_sql() +
       f" SELECT class_actual AS class, {ratio_round_sql('sum(pred_centi)', 'count(*) * 100', 2)} AS avg_predicted_overrun,"
       " count(*) AS n_patients FROM hs GROUP BY class_actual")
def class_avg_prediction(spark, sf_dir):
    """Per-class mean predicted overrun and patient count."""
    s = _hist_scored(spark, sf_dir)
    agg = s.groupBy(F.col("class_actual").alias("class")).agg(
        F.sum("pred_centi").alias("s"), F.count(F.lit(1)).alias("n_patients"))
    return agg.select("class", fx.ratio_round(F.col("s"), F.col("n_patients") * 100, 2).alias("avg_predicted_overrun"),
                      "n_patients")


def _outcome_sql(a: str, p: str) -> str:
    return (f"CASE WHEN {a} = 'Class 2' AND {p} = 'Class 2' THEN 'Correct Class 2' "
            f"WHEN {a} = 'Class 3' AND {p} = 'Class 3' THEN 'Correct Class 3' "
            f"WHEN {a} = 'Class 3' AND {p} = 'Class 2' THEN 'ERROR: Actual 3 -> Pred 2' "
            f"WHEN {a} = 'Class 2' AND {p} = 'Class 3' THEN 'ERROR: Actual 2 -> Pred 3' ELSE 'Other' END")


@query("outcome_group", lambda: with_(comparison_ctes()) + _hist_scored_sql() +
       f" SELECT {_outcome_sql('class_actual', 'class_pred')} AS outcome, count(*) AS n FROM hs GROUP BY 1")
def outcome_group(spark, sf_dir):
    s = _hist_scored(spark, sf_dir)
    return s.groupBy(fx.outcome_group("class_actual", "class_pred").alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"))


@query("flag_error_outcomes", lambda: with_(comparison_ctes()) + _hist_scored_sql() + ", fo AS (" + " UNION ALL ".join(
    f"SELECT {_sql_lit(dims.FLAG_DISPLAY[c])} AS flag, {_outcome_sql('class_actual', 'class_pred')} AS outcome FROM hs "
    f"WHERE lower({c}) IN ('yes', '1', 'true', 'y')" for c in dims.FLAG_COLUMNS) + """)
SELECT flag, count(*) AS total_patients, count(*) FILTER (WHERE outcome = 'Correct Class 2') AS correct_class_2,
       count(*) FILTER (WHERE outcome = 'Correct Class 3') AS correct_class_3,
       count(*) FILTER (WHERE outcome = 'ERROR: Actual 3 -> Pred 2') AS under_3_to_2,
       count(*) FILTER (WHERE outcome = 'ERROR: Actual 2 -> Pred 3') AS over_2_to_3,
       CAST(count(*) FILTER (WHERE outcome = 'ERROR: Actual 3 -> Pred 2') AS DOUBLE) / count(*) AS safety_risk_rate
FROM fo GROUP BY flag""")
def flag_error_outcomes(spark, sf_dir):
    """Per-flag outcome counts and under-estimate rate."""
    return reports.flag_error_outcomes(_hist_scored(spark, sf_dir), "class_actual", "class_pred")


@query("value_counts", lambda: with_(sv.request_base_cte()) +
       " SELECT flag_present, count(*) AS n FROM request_base GROUP BY flag_present")
def value_counts(spark, sf_dir):
    return adapters.request_base(spark, sf_dir).groupBy("flag_present").agg(F.count(F.lit(1)).alias("n"))
