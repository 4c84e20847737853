"""Eligible starts per request against an enumeration of every date, scanner and start; ordered totals of sparse keys."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from apptflow.operators import eligibility as el
from apptflow.operators.generation import FIXED_HOLIDAYS
from apptflow.operators.scan import range_running_totals, running_totals
from apptflow.plans.q_booking import ELIGIBLE_FIRST, ELIGIBLE_LAST, _averages_rules_sql, _eligibility_sql
from apptflow.plans.registry import queries
from apptflow.sources import dims
from tools_path import canon, duck

FIRST, LAST = "2025-12-20", "2026-01-08"


def rule(weekday, scanner, start):
    """Odd kinds only on scanner 2, even ones not on Mondays, all must end by 20:00."""
    odd = F.col("kind") % 2 == 1
    return (start + F.col("minutes") <= 720) & (~odd | (scanner == 2)) & (odd | (weekday != 0))


def test_against_enumeration(spark):
    rows = [(i, k, m, d) for i, (k, m, d) in enumerate(
        [(1, 30, "2025-12-01"), (2, 45, "2025-12-20"), (1, 720, "2025-12-25"), (2, 721, "2025-12-21"), (4, 15, "2026-01-08"),
         (3, 15, "2026-01-09"), (2, 60, None), (None, 30, "2025-12-31"), (2, 45, "2025-12-20")])]
    req = spark.createDataFrame(rows, "id int, kind int, minutes int, day string").withColumn(
        "request_date", F.col("day").cast("date"))
    got = {r["id"]: (r["n_starts"], r["n_days"], r["first_day"]) for r in el.eligible_starts(
        req, {"p": (["kind", "minutes"], rule)}, FIRST, LAST, ["id"]).collect()}
    days = [dt.date.fromisoformat(FIRST) + dt.timedelta(n) for n in range(20)]
    days = [d for d in days if (d.month, d.day) not in FIXED_HOLIDAYS]
    for i, kind, minutes, day in rows:
        odd, even = kind is None or kind % 2 == 1, kind is None or kind % 2 == 0  # of an unknown kind both rules must hold
        hits = [] if day is None else [
            d for d in days for s, *_ in dims.SCANNERS for t in range(0, 720, 15)
            if d >= dt.date.fromisoformat(day) and t + minutes <= 720 and (not odd or s == 2)
            and (not even or d.weekday() != 0)]
        assert got[i] == (len(hits), len(set(hits)), min(hits) if hits else None)


def test_query_against_every_slot(spark, sf_small):
    """Each request meets every date, scanner and quarter-hour of the horizon in DuckDB."""
    closed = " OR ".join(f"(month(d) = {m} AND day(d) = {x})" for m, x in FIXED_HOLIDAYS)
    ok = _averages_rules_sql("a.reason_text", "c.scanner", "c.weekday", "c.start", "c.start + a.duration_heuristic")
    head = _eligibility_sql().split("p1 AS (")[0].rstrip().rstrip(",")
    want = duck(sf_small).execute(head + f"""
SELECT a.patient_id, count(*) AS n_starts, count(DISTINCT o.date) AS n_days, min(o.date) AS first_day
FROM asked a JOIN opened o ON o.date >= a.request_date JOIN cells c ON c.weekday = o.weekday WHERE {ok} GROUP BY a.patient_id""").df()
    got = queries()["request_eligibility"](spark, sf_small).filter("policy = 'averages' AND n_starts > 0").select(
        "patient_id", "n_starts", "n_days", "first_day")
    assert closed and ELIGIBLE_FIRST < ELIGIBLE_LAST
    assert canon(got.toPandas()) == canon(want)


@pytest.mark.parametrize("inclusive", [True, False])
def test_totals_of_sparse_keys(spark, inclusive):
    """Keys 2**40 apart, one site with most rows, a null site, negative values."""
    d = spark.range(3000).select(F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 == 0, "rare").alias("site"),
                                 ((F.col("id") - 1500) * (1 << 40)).alias("key"), (F.col("id") % 7 - 3).alias("v"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = range_running_totals(d.repartition(5), ["site"], ["key"], {"upto": F.col("v")}, inclusive).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    sums = {}
    for r in got.sort_values("key").itertuples():
        before = sums.get(r.site, 0)
        sums[r.site] = before + r.v
        assert r.upto == (sums[r.site] if inclusive else before)
    assert len(got) == 3000


def test_totals_of_partitions(spark):
    d = spark.range(500).select((F.col("id") % 3).alias("site"), F.col("id").alias("key"))
    got = running_totals(d, ["site"], "key", {"nth": F.lit(1).cast("long")}, block_size=16, totals={"nth": "n"})
    assert got.groupBy("site").agg(F.max("nth").alias("a"), F.min("n").alias("b"), F.max("n").alias("c")).filter(
        "a <> b OR b <> c").isEmpty()
