"""Generation queries (B1-B10, D8): grids, draws, the request clock."""
from __future__ import annotations

from pyspark.sql import functions as F

from apptflow.sources import dims

from apptflow.functions.draws import u, u_sql
from apptflow.operators import generation as gen
from apptflow.plans import sqlviews as sv
from apptflow.plans.registry import query
from apptflow.plans.sqlfmt import values_sql, with_
from apptflow.sources import adapters, dims
from apptflow.sources.io import table

SLOT_SAMPLE_N = 5000  # the reference's number of historical records


def _calendar(spark, sf_dir):
    o = table(spark, sf_dir, "orders", ["o_orderdate"])
    bounds = o.agg(F.min("o_orderdate").cast("date").alias("d0"), F.max("o_orderdate").cast("date").alias("d1"))
    days = bounds.select(gen.day_range(F.col("d0"), F.col("d1")).alias("day"))
    return gen.calendar(days)


def _calendar_sql() -> str:
    hol = " OR ".join(f"(month(day) = {m} AND day(day) = {d})" for m, d in gen.FIXED_HOLIDAYS)
    return f"""days AS (SELECT CAST(d AS DATE) AS day FROM (SELECT min(o_orderdate) AS d0, max(o_orderdate) AS d1 FROM orders) b,
                  generate_series(CAST(b.d0 AS DATE), CAST(b.d1 AS DATE), INTERVAL 1 DAY) g(d)),
cal AS (SELECT day, CASE WHEN {hol} THEN 'holiday' WHEN isodow(day) >= 6 THEN 'weekend' ELSE 'weekday' END AS kind,
               ({hol}) AS is_holiday FROM days)"""


@query("holiday_flag", lambda: with_(_calendar_sql()) + " SELECT day, kind, is_holiday FROM cal")
def holiday_flag(spark, sf_dir):
    return _calendar(spark, sf_dir)


def _grid_sql() -> str:
    hours = values_sql(gen.HOURS, ["kind", "first_hour", "end_hour"])
    return _calendar_sql() + f""",
hours AS {hours},
grid AS (SELECT c.day, c.kind, CAST(s AS TIMESTAMP) AS slot FROM cal c JOIN hours h ON c.kind = h.kind,
         generate_series(CAST(c.day AS TIMESTAMP) + to_hours(h.first_hour),
                         CAST(c.day AS TIMESTAMP) + to_minutes(h.end_hour * 60 - 15), INTERVAL 15 MINUTE) g(s))"""


@query("slot_grid", lambda: with_(_grid_sql()) + " SELECT kind, count(*) AS n_slots, min(slot) AS first_slot,"
       " max(slot) AS last_slot FROM grid GROUP BY kind")
def slot_grid(spark, sf_dir):
    """Opening-hours slot grid over the order date range (B1), summarised per day kind."""
    g = gen.slot_grid(_calendar(spark, sf_dir))
    return g.groupBy("kind").agg(F.count(F.lit(1)).alias("n_slots"), F.min("slot").alias("first_slot"),
                                 F.max("slot").alias("last_slot"))


@query("slot_sample", lambda: with_(_grid_sql()) + f""",
top AS (SELECT slot FROM grid ORDER BY {u_sql("strftime(slot, '%Y-%m-%d %H:%M')", 'slot_pick')}, slot LIMIT {SLOT_SAMPLE_N})
SELECT slot, row_number() OVER (ORDER BY slot) AS slot_no FROM top""")
def slot_sample(spark, sf_dir):
    """5,000 distinct slots drawn without replacement, in time order (B2)."""
    return gen.sample_slots(gen.slot_grid(_calendar(spark, sf_dir)), SLOT_SAMPLE_N)


@query("uniform_draw", lambda: with_(sv.appointment_raw_cte()) +
       " SELECT patient_id, age, gender, scan_type, arrival_offset FROM appointment_raw")
def uniform_draw(spark, sf_dir):
    return adapters.appointment_raw(spark, sf_dir).select("patient_id", "age", "gender", "scan_type", "arrival_offset")


def _cum_sql(name: str, items_sql: str, keys: str = "") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""{name}_w AS (SELECT *, CASE WHEN row_number() OVER ({part} ORDER BY ord DESC) = 1 THEN 1.0000001
                  ELSE sum(weight) OVER ({part} ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                       / sum(weight) OVER ({part or ''}) END AS hi FROM {items_sql} t),
{name} AS (SELECT *, coalesce(lag(hi) OVER ({part} ORDER BY ord), 0.0) AS lo FROM {name}_w)"""


REASON_ROWS = [(i, r, w) for i, (r, w) in enumerate(dims.REASON_MIX)]


@query("weighted_draw", lambda: with_(sv.appointment_raw_cte(), _cum_sql(
    "mix", values_sql(REASON_ROWS, ["ord", "reason", "weight"]))) + f"""
SELECT a.patient_id, m.reason FROM appointment_raw a JOIN mix m
  ON {u_sql('a.patient_id', 'reason_range')} >= m.lo AND {u_sql('a.patient_id', 'reason_range')} < m.hi""")
def weighted_draw(spark, sf_dir):
    """Weighted draw as a keyed range join against the cumulative dimension."""
    spark_dim = dims.literal(spark, REASON_ROWS, "ord int, reason string, weight double")
    mix = gen.cumulative(spark_dim, "weight", "ord").select("reason", "lo", "hi")
    facts = adapters.appointment_raw(spark, sf_dir).select("patient_id").withColumn(
        "d", u("patient_id", "reason_range"))
    return gen.range_bucket_join(facts, "d", mix, "lo", "hi").select("patient_id", "reason")


@query("overrun_draw", lambda: with_(sv.appointment_raw_cte()) +
       " SELECT patient_id, delay_reason, CASE WHEN overrun_minutes = 0 THEN 'none' WHEN overrun_minutes <= 20"
       " THEN 'minor' ELSE 'major' END AS severity, overrun_minutes FROM appointment_raw")
def overrun_draw(spark, sf_dir):
    """Two-stage conditional draw: severity given reason, then minutes."""
    r = adapters.appointment_raw(spark, sf_dir)
    sev = F.when(F.col("overrun_minutes") == 0, "none").when(F.col("overrun_minutes") <= 20, "minor").otherwise("major")
    return r.select("patient_id", "delay_reason", sev.alias("severity"), "overrun_minutes")


@query("actual_times", lambda: with_(sv.appointment_raw_cte()) +
       " SELECT patient_id, scheduled_at, actual_minutes, actual_end FROM appointment_raw")
def actual_times(spark, sf_dir):
    return adapters.appointment_raw(spark, sf_dir).select("patient_id", "scheduled_at", "actual_minutes", "actual_end")


IND_ROWS = [(i, ind, s, w) for i, (ind, s, w) in enumerate(dims.INDICATION_MIX)]


@query("indication_scan_draw", lambda: with_(sv.request_base_cte(), _cum_sql(
    "imix", values_sql(IND_ROWS, ["ord", "indication", "scan_type", "weight"]), "indication")) + f"""
SELECT r.patient_id, r.indication, m.scan_type,
       CASE WHEN m.scan_type LIKE '%Contrast%' THEN 'Yes' ELSE 'No' END AS contrast
FROM request_base r JOIN imix m ON r.indication = m.indication
  AND {u_sql('r.patient_id', 'scan_range')} >= m.lo AND {u_sql('r.patient_id', 'scan_range')} < m.hi""")
def indication_scan_draw(spark, sf_dir):
    """Scan type given indication: normalised weights, keyed range join."""
    dim = dims.literal(spark, IND_ROWS, "ord int, indication string, scan_type string, weight double")
    mix = gen.cumulative(dim, "weight", "ord", ["indication"]).select("indication", "scan_type", "lo", "hi")
    facts = adapters.request_base(spark, sf_dir).select("patient_id", "indication").withColumn(
        "d", u("patient_id", "scan_range"))
    j = gen.range_bucket_join(facts, "d", mix, "lo", "hi", keys=["indication"])
    return j.select("patient_id", "indication", "scan_type",
                    F.when(F.col("scan_type").contains("Contrast"), "Yes").otherwise("No").alias("contrast"))


@query("request_clock", lambda: with_(sv.request_cte()) + " SELECT patient_id, site, row_index, request_ts FROM request")
def request_clock(spark, sf_dir):
    """Per-site running request clock via the two-level scan."""
    return adapters.request(spark, sf_dir).select("patient_id", "site", "row_index", "request_ts")
