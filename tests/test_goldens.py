"""Goldens rebuilt by arithmetic from the published result files."""
import math

import numpy as np

import pytest
from pyspark.sql import functions as F

from apptflow.operators import metrics as mx
from apptflow.operators import policies as pol
from apptflow.functions import flags as fx


def _pairs(spark, cells):
    rows = [(f"Class {a}", f"Class {p}") for a, p, n in cells for _ in range(n)]
    return spark.createDataFrame(rows, "actual string, predicted string")


def _report(spark, cells):
    df = _pairs(spark, cells)
    rep = mx.classification_report(df, "actual", "predicted", "m").collect()
    return {r["class_or_avg"]: r for r in rep}


def test_g1_decision_tree_report(spark):
    rep = _report(spark, [(1, 1, 3385), (2, 2, 808), (2, 3, 92), (3, 3, 512), (3, 2, 203)])
    assert rep["accuracy"]["f1_score"] == pytest.approx(0.941)
    assert rep["Class 2"]["precision"] == pytest.approx(0.7992087042532147, abs=1e-15)
    assert rep["Class 2"]["recall"] == pytest.approx(0.8977777777777778)
    assert rep["Class 3"]["f1_score"] == pytest.approx(0.7763457164518575)
    assert rep["macro avg"]["precision"] == pytest.approx(0.8822969411528375)
    assert rep["weighted avg"]["f1_score"] == pytest.approx(0.940230938237545)
    assert rep["weighted avg"]["support"] == 5000


def test_g2_random_forest_report(spark):
    rep = _report(spark, [(1, 1, 3385), (2, 2, 836), (2, 3, 64), (3, 3, 503), (3, 2, 212)])
    assert rep["accuracy"]["f1_score"] == pytest.approx(0.9448)
    assert rep["Class 3"]["precision"] == pytest.approx(0.8871252204585538)
    assert rep["macro avg"]["f1_score"] == pytest.approx(0.8810092034071507)
    assert rep["weighted avg"]["recall"] == pytest.approx(0.9448)


def test_confusion_is_dense_and_sums_to_n(spark):
    df = _pairs(spark, [(1, 1, 5), (3, 2, 2)])
    cm = mx.confusion_matrix(df, "actual", "predicted").collect()
    assert len(cm) == 9 and sum(r["n"] for r in cm) == 7


def test_g3_flag_percentages(spark):
    df = spark.createDataFrame([(50, 44, 6), (43, 8, 35), (3728, 99, 242), (0, 0, 0)], "t long, c3 long, c2 long")
    out = df.select(fx.pct_text(F.col("c3"), F.col("t")).alias("major"),
                    fx.pct_text(F.col("c2"), F.col("t")).alias("minor")).collect()
    assert [r["major"] for r in out] == ["88.0%", "18.6%", "2.7%", "0.0%"]
    assert [r["minor"] for r in out] == ["12.0%", "81.4%", "6.5%", "0.0%"]


def test_pct_half_even_ties(spark):
    # 49/400 = 12.25% exactly -> '12.2%' (half-even), 51/400 = 12.75% -> '12.8%'
    df = spark.createDataFrame([(400, 49), (400, 51)], "t long, c long")
    assert [r[0] for r in df.select(fx.pct_text(F.col("c"), F.col("t"))).collect()] == ["12.2%", "12.8%"]


def test_slot_grid_with_the_late_weekday_opening(spark):
    """Two years of weekdays from 09:00 and weekends, without holidays."""
    from apptflow.operators import generation as gen
    days = spark.sql("SELECT explode(sequence(DATE'2023-01-01', DATE'2024-12-31')) AS day")
    cal = days.withColumn("kind", F.when(F.weekday("day") >= 5, "weekend").otherwise("weekday"))
    assert gen.slot_grid(cal, gen.HOURS_COMPAT).count() == 29656
    assert gen.slot_grid(cal).count() == 31744
    with pytest.raises(ValueError):
        gen.sample_slots(gen.slot_grid(cal.limit(1)), 1000)


def test_g7_averages_policy(spark):
    df = spark.createDataFrame([
        ("Hoist Required, Wheelchair User", "Brain with Contrast"),
        ("None", "Brain with Contrast"),
        ("None", "Brain"),
        ("Cognitive Conditions, Learning Difficulty", "Brain"),
        ("None", "Unknown Scan"),
    ], "reason_text string, scan_type string")
    out = pol.with_averages_policy(df).collect()
    assert (out[0]["heuristic_extra"], out[0]["heuristic_class"], out[0]["heuristic_minutes"]) == (46, "Class 3", 91)
    assert (out[1]["heuristic_extra"], out[1]["heuristic_class"]) == (8, "Class 2")
    assert (out[2]["heuristic_extra"], out[2]["heuristic_class"], out[2]["heuristic_minutes"]) == (0, "Class 1", 30)
    # 'cognitive' also matches learning patients via Cognitive Conditions; max(18.32, 19.35) -> 19
    assert out[3]["heuristic_extra"] == 19
    assert out[4]["heuristic_minutes"] == 30  # unknown scan type -> default 30


def test_g4_percent_difference(spark):
    # base 3.90, model 4.01 -> (390 - 401) / 390 = -2.82% -> '-2.8%'
    df = spark.createDataFrame([(390, 401)], "b long, m long")
    an = F.abs(F.col("b") - F.col("m")) * 1000
    txt = df.select(F.concat(F.when(F.col("b") < F.col("m"), "-").otherwise(""), fx.pct_text(an / 1000, F.col("b"))))
    assert txt.first()[0] == "-2.8%"


def test_model_minutes_half_even(spark):
    df = spark.createDataFrame([("Brain", 2.5), ("Brain", 3.5), ("Brain", -4.0)], "scan_type string, p double")
    got = [r[0] for r in df.select(pol.model_minutes("scan_type", "p")).collect()]
    assert got == [32, 34, 30]


def test_regression_metrics_exact(spark):
    df = spark.createDataFrame([("a", 10, 12), ("a", 20, 18), ("a", 30, 30)], "g string, y int, p int")
    r = mx.regression_metrics(df, "g", "y", "p").first()
    assert r["mae"] == pytest.approx(4 / 3)
    assert r["rmse"] == pytest.approx(math.sqrt(8 / 3))
    assert r["r2"] == pytest.approx(1 - 8 / 200)


def test_best_model_is_the_least_error(spark):
    rows = [("baseline", 3.9), ("heuristic", 5.0), ("ml", 4.0)]
    best = mx.best_of(spark.createDataFrame(rows, "policy string, mae double"), "policy", "mae",
                      {"baseline": 2, "heuristic": 1, "ml": 0}).first()
    assert tuple(best) == ("baseline", 3.9)
    rows = [("baseline", 4.0), ("ml", 4.0)]
    assert mx.best_of(spark.createDataFrame(rows, "policy string, mae double"), "policy", "mae",
                      {"baseline": 2, "ml": 0}).first()["best_policy"] == "ml"


def test_regression_of_very_many_rows(spark):
    """The sums of 10**11 rows: 40 minutes on average, off by 5."""
    n = 10 ** 11
    sums = [("p", n, 5 * n, 25 * n, 40 * n, 2000 * n)]
    r = mx.regression_from_sums(spark.createDataFrame(
        sums, "policy string, n long, sae long, sse long, sy long, syy long"), "policy").first()
    assert (r["mae"], r["mse"], r["rmse"]) == (5.0, 25.0, 5.0)
    assert r["r2"] == pytest.approx(1 - 25 / 400)


def test_density_of_residuals(spark):
    """The density is that of a direct kernel sum, and its integral is 1; equal or single values have none."""
    rows = [("a", v) for v in [-3, -1, 0, 0, 0, 2, 5, 5, 9, 40]] + [("one", 3), ("same", 4), ("same", 4)]
    got = mx.density(spark.createDataFrame(rows, "g string, r int"), "g", "r", 2000).toPandas()
    values = np.array([v for g, v in rows if g == "a"])
    h = values.std(ddof=1) * len(values) ** -0.2
    direct = np.exp(-0.5 * ((got.x.values[:, None] - values) / h) ** 2).sum(1) / (len(values) * h * math.sqrt(2 * math.pi))
    assert set(got.g) == {"a"} and np.abs(got.density.values - direct).max() < 1e-6
    assert np.trapezoid(got.sort_values("x").density, got.sort_values("x").x) == pytest.approx(1, abs=3e-3)
