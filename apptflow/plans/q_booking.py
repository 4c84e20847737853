"""Booking queries: shift grid, FCFS schedule and its consumers."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apptflow.sources import dims

from apptflow.functions import flags as fx
from apptflow.functions.draws import _sql_lit
from apptflow.operators import audit as au
from apptflow.operators import booking as bk
from apptflow.operators import eligibility as el
from apptflow.operators import policies as pol
from apptflow.operators.generation import FIXED_HOLIDAYS
from apptflow.operators.scan import running_totals
from apptflow.plans import sqlviews as sv
from apptflow.plans.q_core import _reason_text_sql
from apptflow.plans.q_metrics import (comparison_ctes, history, policy_requests, with_heuristic_policy,
                                      with_model_policy)
from apptflow.plans.registry import query
from apptflow.sources import adapters, dims
from apptflow.sources.adapters import memo_plan

SCANNER_NAME = {sc: name for sc, name, _, _, _ in dims.SCANNERS}


# --- Spark side --------------------------------------------------------------

@memo_plan
def fcfs_queue(spark, sf_dir) -> DataFrame:
    """Requests with baseline minutes in queue order (request time, then index).

    The request clock is monotone in ``row_index``, so queue order is
    ``row_index`` order; one two-level scan yields both the queue position
    and the packed end offsets ``e_end`` the packer needs.
    """
    r = adapters.request_base(spark, sf_dir).select(
        "site", "patient_id", "age", "indication", "scan_type", fx.reason_text().alias("reason_text"),
        pol.baseline_minutes("scan_type").alias("duration"))
    r = running_totals(r, ["site"], "patient_id", {
        "row_index": F.lit(1).cast("long"),
        "e_end": (F.col("duration") + dims.CHANGEOVER_MINUTES).cast("long")})
    return r.withColumn("row_index", F.col("row_index") - 1)


@memo_plan
def fcfs(spark, sf_dir) -> DataFrame:
    return bk.fcfs_schedule(spark, fcfs_queue(spark, sf_dir), e_col="e_end")


# --- SQL side ----------------------------------------------------------------

def _shifts_sql() -> str:
    sc = ", ".join(f"({s})" for s, _, _, _, _ in dims.SCANNERS)
    return f"""bdays AS (SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '{dims.BOOKING_START}', DATE '{dims.BOOKING_END}', INTERVAL 1 DAY) g(d)),
sc AS (SELECT * FROM (VALUES {sc}) t(scanner)),
seg AS (SELECT date, scanner, 0 AS open_min, CASE WHEN scanner = 4 AND isodow(date) = 3 THEN 300 ELSE 720 END AS close_min, 0 AS part
        FROM bdays, sc
        UNION ALL SELECT date, 4, 540, 720, 1 FROM bdays WHERE isodow(date) = 3),
shifts AS (SELECT CAST(row_number() OVER (ORDER BY date, scanner, part) - 1 AS BIGINT) AS shift_no, date, scanner, open_min, close_min FROM seg)"""


def _walk_sql(name: str, items: str) -> str:
    """The head-of-line loop over ``items`` (site, row_index, duration), one step per row."""
    return f"""{name}(site, j, s, cur, pj, ps, pstart) AS (
  SELECT site, CAST(0 AS BIGINT), CAST(0 AS BIGINT), (SELECT open_min FROM shifts WHERE shift_no = 0),
         CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS INTEGER)
  FROM (SELECT DISTINCT site FROM {items}) s0
  UNION ALL
  SELECT w.site,
         CASE WHEN w.cur + i.duration <= sh.close_min THEN w.j + 1 ELSE w.j END,
         CASE WHEN w.cur + i.duration <= sh.close_min THEN w.s ELSE w.s + 1 END,
         CASE WHEN w.cur + i.duration <= sh.close_min THEN w.cur + i.duration + {dims.CHANGEOVER_MINUTES} ELSE nsh.open_min END,
         CASE WHEN w.cur + i.duration <= sh.close_min THEN w.j END,
         CASE WHEN w.cur + i.duration <= sh.close_min THEN w.s END,
         CASE WHEN w.cur + i.duration <= sh.close_min THEN w.cur END
  FROM {name} w JOIN {items} i ON i.site = w.site AND i.row_index = w.j
  JOIN shifts sh ON sh.shift_no = w.s
  LEFT JOIN shifts nsh ON nsh.shift_no = w.s + 1
  WHERE w.cur + i.duration <= sh.close_min OR nsh.shift_no IS NOT NULL)"""


def _fcfs_sql() -> str:
    """Test-only oracle: the head-of-line loop as a recursive CTE, one step per row."""
    req = sv.request_cte()
    return "WITH RECURSIVE " + req + ",\n" + _shifts_sql() + f""",
items AS (SELECT site, row_index, patient_id, age, indication, scan_type, {_reason_text_sql()} AS reason_text,
                 CAST({sv.rule_minutes_sql('scan_type')} AS INTEGER) AS duration FROM request),
""" + _walk_sql("walk", "items") + """,
fcfs AS (SELECT i.site, i.row_index, i.patient_id, i.age, i.indication, i.scan_type, i.reason_text, i.duration,
                CAST(w.ps AS INTEGER) AS shift_no, sh.date, CAST(sh.scanner AS INTEGER) AS scanner,
                CAST(w.pstart AS INTEGER) AS start_min, CAST(w.pstart + i.duration AS INTEGER) AS end_min
         FROM walk w JOIN items i ON i.site = w.site AND i.row_index = w.pj JOIN shifts sh ON sh.shift_no = w.ps
         WHERE w.pj IS NOT NULL)"""


FCFS_COLS = ["site", "row_index", "patient_id", "age", "indication", "scan_type", "reason_text", "duration",
             "shift_no", "date", "scanner", "start_min", "end_min"]


@query("shift_grid", lambda: "WITH " + sv.request_base_cte() + ",\n" + _shifts_sql() +
       " SELECT s.site, count(*) AS n_segments, CAST(sum(close_min - open_min) AS BIGINT) AS open_minutes"
       " FROM (SELECT DISTINCT site FROM request_base) s, shifts GROUP BY s.site")
def shift_grid(spark, sf_dir):
    """Site x date x scanner segments of the booking horizon (L1), summarised per site."""
    sites = adapters.request_base(spark, sf_dir).select("site").distinct()
    g = bk.shift_grid(spark, sites)
    return g.groupBy("site").agg(F.count(F.lit(1)).alias("n_segments"),
                                 F.sum(F.col("close_min") - F.col("open_min")).cast("long").alias("open_minutes"))


@query("fcfs_schedule", lambda: _fcfs_sql() + f"""
SELECT {', '.join(f'i.{c}' for c in FCFS_COLS[:8])}, {', '.join(f'f.{c}' for c in FCFS_COLS[8:])},
       CASE WHEN f.shift_no IS NULL THEN 'unplaced' ELSE 'placed' END AS status,
       CASE WHEN f.shift_no IS NOT NULL THEN NULL
            WHEN i.duration > (SELECT max(close_min - open_min) FROM shifts) THEN {_sql_lit(bk.TOO_LONG)}
            ELSE {_sql_lit(bk.NO_ROOM)} END AS reason
FROM items i LEFT JOIN fcfs f ON i.site = f.site AND i.row_index = f.row_index""")
def fcfs_schedule(spark, sf_dir):
    """Exact first-come-first-served packing per site (L2): every request, with status and reason."""
    queue = fcfs_queue(spark, sf_dir).drop("e_end")
    return bk.with_status(queue, fcfs(spark, sf_dir)).select(*FCFS_COLS, "status", "reason")


# --- two policies' schedules against history (D3) ------------------------------

def _policy_schedule(spark, queue: DataFrame, duration: str) -> DataFrame:
    """Booked requests of the packer fed with a policy's durations."""
    queue = running_totals(queue, ["site"], "patient_id", {
        "row_index": F.lit(1).cast("long"), "e_end": (F.col(duration) + dims.CHANGEOVER_MINUTES).cast("long")})
    queue = queue.withColumns({"row_index": F.col("row_index") - 1, "duration": F.col(duration)})
    return bk.fcfs_schedule(spark, queue, e_col="e_end")


def three_way(model_schedule: DataFrame, averages_schedule: DataFrame, hist: DataFrame) -> DataFrame:
    """Two booked schedules and history, on patient: only patients booked in both remain (D3)."""
    m = model_schedule.select("patient_id", F.col("duration").alias("duration_ml"), "class_ml")
    a = averages_schedule.select("patient_id", F.col("duration").alias("duration_heuristic"), "class_heuristic")
    h = hist.select("patient_id", "duration_actual", "duration_baseline", "class_actual")
    return m.join(h, "patient_id").join(a, "patient_id")


def _three_way_sql() -> str:
    items = [f"""{p}_items AS (SELECT b.site, row_number() OVER (PARTITION BY b.site ORDER BY b.patient_id) - 1 AS row_index,
  b.patient_id, p.{d} AS duration FROM request_base b JOIN {p} p ON p.patient_id = b.patient_id)"""
             for p, d in (("ml", "duration_ml"), ("heur", "duration_heuristic"))]
    return ("WITH RECURSIVE " + comparison_ctes() + ",\n" + _shifts_sql() + ",\n" + ",\n".join(items) + ",\n"
            + _walk_sql("ml_walk", "ml_items") + ",\n" + _walk_sql("heur_walk", "heur_items") + """,
booked AS (SELECT i.patient_id FROM ml_walk w JOIN ml_items i ON i.site = w.site AND i.row_index = w.pj
           INTERSECT SELECT i.patient_id FROM heur_walk w JOIN heur_items i ON i.site = w.site AND i.row_index = w.pj)
SELECT merged.* FROM merged JOIN booked USING (patient_id)""")


@query("three_way_join", _three_way_sql)
def three_way_join(spark, sf_dir):
    """The model's and the averages' schedules against history (D3)."""
    req = policy_requests(spark, sf_dir).drop(*dims.FLAG_COLUMNS)
    by_model = with_model_policy(spark, sf_dir, req).select("site", "patient_id", "duration_ml", "class_ml")
    by_averages = with_heuristic_policy(req).select("site", "patient_id", "duration_heuristic", "class_heuristic")
    return three_way(_policy_schedule(spark, by_model, "duration_ml"),
                     _policy_schedule(spark, by_averages, "duration_heuristic"), history(spark, sf_dir))


def _scanner_name_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {k} THEN {_sql_lit(v)}" for k, v in SCANNER_NAME.items()) + " END"


def _clock_sql(col: str) -> str:
    return f"strftime(CAST(date AS TIMESTAMP) + to_minutes(CAST({col} + 480 AS BIGINT)), '%H:%M')"


@query("schedule_text", lambda: _fcfs_sql() + f"""
SELECT site, {_scanner_name_sql('scanner')} AS scanner_name, strftime(date, '%Y-%m-%d') AS date_text,
       dayname(date) AS day_name, {_clock_sql('start_min')} AS start_time, {_clock_sql('end_min')} AS end_time,
       patient_id, age, indication AS clinical_indication, reason_text AS delay_reason, scan_type, duration
FROM fcfs""")
def schedule_text(spark, sf_dir):
    """The schedule's display columns."""
    s = fcfs(spark, sf_dir)
    name = F.element_at(F.create_map(*[x for k, v in SCANNER_NAME.items() for x in (F.lit(k), F.lit(v))]), F.col("scanner"))
    return s.select("site", name.alias("scanner_name"), F.date_format("date", "yyyy-MM-dd").alias("date_text"),
                    F.date_format("date", "EEEE").alias("day_name"),
                    bk.clock_text(F.col("date"), F.col("start_min"), "HH:mm").alias("start_time"),
                    bk.clock_text(F.col("date"), F.col("end_min"), "HH:mm").alias("end_time"),
                    "patient_id", "age", F.col("indication").alias("clinical_indication"),
                    F.col("reason_text").alias("delay_reason"), "scan_type", "duration")


@query("fill_rate", lambda: _fcfs_sql() + """
SELECT r.site, r.requested, coalesce(b.booked, 0) AS booked FROM
 (SELECT site, count(*) AS requested FROM items GROUP BY site) r
 LEFT JOIN (SELECT site, count(*) AS booked FROM fcfs GROUP BY site) b ON r.site = b.site""")
def fill_rate(spark, sf_dir):
    """Booked vs requested per site."""
    req = fcfs_queue(spark, sf_dir).groupBy("site").agg(F.count(F.lit(1)).alias("requested"))
    booked = fcfs(spark, sf_dir).groupBy("site").agg(F.count(F.lit(1)).alias("booked"))
    return req.join(booked, "site", "left").select("site", "requested", F.coalesce("booked", F.lit(0)).alias("booked"))


@query("scanner_occupancy", lambda: _fcfs_sql() + """
SELECT f.site, f.date, f.scanner, count(*) AS n_scans, CAST(sum(f.duration) AS BIGINT) AS busy_minutes,
       CAST(sum(f.duration) AS DOUBLE) / o.open_minutes AS occupancy
FROM fcfs f JOIN (SELECT date, scanner, sum(close_min - open_min) AS open_minutes FROM shifts GROUP BY 1, 2) o
  ON o.date = f.date AND o.scanner = f.scanner
GROUP BY f.site, f.date, f.scanner, o.open_minutes""")
def scanner_occupancy(spark, sf_dir):
    """Minutes used per scanner-day over its open minutes."""
    s = fcfs(spark, sf_dir)
    t = dims.literal(spark, bk.shift_template(), "shift_no int, date date, scanner int, open_min int, close_min int")
    open_m = t.groupBy("date", "scanner").agg(F.sum(F.col("close_min") - F.col("open_min")).alias("open_minutes"))
    agg = s.groupBy("site", "date", "scanner").agg(F.count(F.lit(1)).alias("n_scans"),
                                                   F.sum("duration").cast("long").alias("busy_minutes"))
    return agg.join(F.broadcast(open_m), ["date", "scanner"]).select(
        "site", "date", "scanner", "n_scans", "busy_minutes",
        (F.col("busy_minutes") / F.col("open_minutes")).alias("occupancy"))


@query("distinct_dates", lambda: _fcfs_sql() + " SELECT DISTINCT site, date FROM fcfs")
def distinct_dates(spark, sf_dir):
    return fcfs(spark, sf_dir).select("site", "date").distinct()


@query("first_week", lambda: _fcfs_sql() + """,
d AS (SELECT site, date, dense_rank() OVER (PARTITION BY site ORDER BY date) AS dr FROM (SELECT DISTINCT site, date FROM fcfs) x)
SELECT f.site, f.date, f.scanner, f.patient_id, f.start_min FROM fcfs f JOIN d ON d.site = f.site AND d.date = f.date WHERE d.dr <= 7""")
def first_week(spark, sf_dir):
    """Rows of each site's first 7 distinct schedule dates."""
    return _week(fcfs(spark, sf_dir)).select("site", "date", "scanner", "patient_id", "start_min")


def _week(s: DataFrame) -> DataFrame:
    days = s.select("site", "date").distinct()  # <= sites x horizon days
    ranked = days.withColumn("dr", F.dense_rank().over(Window.partitionBy("site").orderBy("date")))
    return s.join(ranked.filter(F.col("dr") <= 7).select("site", "date"), ["site", "date"], "left_semi")


def _colour_sql(col: str) -> str:
    whens = " ".join(f"WHEN position({_sql_lit(k)} IN {col}) > 0 THEN {_sql_lit(c)}" for _, k, c in dims.COLOURS)
    return f"CASE {whens} ELSE {_sql_lit(dims.OTHER_COLOUR)} END"


@query("timeline", lambda: _fcfs_sql() + f""",
d AS (SELECT site, date, dense_rank() OVER (PARTITION BY site ORDER BY date) AS dr FROM (SELECT DISTINCT site, date FROM fcfs) x)
SELECT f.site, f.date, f.scanner, f.patient_id, f.start_min * 1.5 AS left_px, f.duration * 1.5 AS width_px,
       {_colour_sql('f.reason_text')} AS colour,
       CASE WHEN f.reason_text = 'None' THEN 'Std' ELSE split_part(f.reason_text, ',', 1) || ' (' || CAST(f.duration AS VARCHAR) || 'm)' END AS label,
       'Patient: ' || CAST(f.patient_id AS VARCHAR) || ' | Scan: ' || f.scan_type || ' | Flag: ' || f.reason_text
         || ' | Booked: ' || {_clock_sql('f.start_min').replace('date', 'f.date')} || '-' || {_clock_sql('f.end_min').replace('date', 'f.date')} AS tooltip
FROM fcfs f JOIN d ON d.site = f.site AND d.date = f.date WHERE d.dr <= 7""")
def timeline(spark, sf_dir):
    """Timeline blocks of the first week (L12): position, width, colour, label, tooltip."""
    s = _week(fcfs(spark, sf_dir))
    colour = bk.timeline_colour(F.col("reason_text"))
    label = F.when(F.col("reason_text") == "None", "Std").otherwise(
        F.concat(F.split_part(F.col("reason_text"), F.lit(","), F.lit(1)), F.lit(" ("),
                 F.col("duration").cast("string"), F.lit("m)")))
    tip = F.concat(F.lit("Patient: "), F.col("patient_id").cast("string"), F.lit(" | Scan: "), F.col("scan_type"),
                   F.lit(" | Flag: "), F.col("reason_text"), F.lit(" | Booked: "),
                   bk.clock_text(F.col("date"), F.col("start_min"), "HH:mm"), F.lit("-"),
                   bk.clock_text(F.col("date"), F.col("end_min"), "HH:mm"))
    start_text = bk.clock_text(F.col("date"), F.col("start_min"), "HH:mm")
    return s.select("site", "date", "scanner", "patient_id", (fx.hhmm_to_minutes(start_text) * 1.5).alias("left_px"),
                    (F.col("duration") * 1.5).alias("width_px"), colour.alias("colour"), label.alias("label"),
                    tip.alias("tooltip"))


def _exact_colour_sql(col: str) -> str:
    whens = " ".join(f"WHEN {_sql_lit(k)} THEN {_sql_lit(c)}" for k, c in dims.EXACT_COLOURS)
    return f"CASE split_part({col}, ',', 1) {whens} ELSE {_sql_lit(dims.OTHER_COLOUR)} END"


_WEEK_SQL = """,
d AS (SELECT site, date, dense_rank() OVER (PARTITION BY site ORDER BY date) AS dr FROM (SELECT DISTINCT site, date FROM fcfs) x),
week AS (SELECT f.* FROM fcfs f JOIN d ON d.site = f.site AND d.date = f.date WHERE d.dr <= 7)"""


@query("timeline_exact", lambda: _fcfs_sql() + _WEEK_SQL + f"""
SELECT site, date, scanner, patient_id, start_min * 1.5 AS left_px, duration * 1.5 AS width_px,
       {_exact_colour_sql('reason_text')} AS colour,
       CASE WHEN reason_text = 'None' THEN 'Std' ELSE split_part(reason_text, ',', 1) END AS label FROM week""")
def timeline_exact(spark, sf_dir):
    """Timeline blocks of the first week, coloured by the first flag's exact match."""
    reason = F.col("reason_text")
    return _week(fcfs(spark, sf_dir)).select(
        "site", "date", "scanner", "patient_id", (F.col("start_min") * 1.5).alias("left_px"),
        (F.col("duration") * 1.5).alias("width_px"), bk.timeline_colour(reason, "exact").alias("colour"),
        F.when(reason == "None", "Std").otherwise(bk.first_flag(reason)).alias("label"))


def _legend_sql() -> str:
    keys = ", ".join(f"({o}, {_sql_lit(k)}, {_sql_lit(c)})" for o, k, c in dims.COLOURS)
    return _fcfs_sql() + _WEEK_SQL + f""",
keys AS (SELECT * FROM (VALUES {keys}, (99, {_sql_lit(dims.OTHER_LABEL)}, {_sql_lit(dims.OTHER_COLOUR)})) v(o, k, c)),
legend AS (SELECT c, row_number() OVER (ORDER BY min(o)) AS position,
                  replace(arg_min(k, o), 'Sedation', 'Sedation / Claustrophobia') AS label FROM keys GROUP BY c),
blocks AS (SELECT site, {_colour_sql('reason_text')} AS c FROM week),
counted AS (SELECT site, c, count(*) AS n FROM blocks GROUP BY 1, 2)
SELECT s.site, l.position, l.label, l.c AS colour, coalesce(n.n, 0) AS n_blocks
FROM (SELECT DISTINCT site FROM blocks) s, legend l LEFT JOIN counted n ON n.site = s.site AND n.c = l.c"""


@query("timeline_legend", _legend_sql)
def timeline_legend(spark, sf_dir):
    """Legend of each site's first week: colours in first-seen order with their blocks."""
    blocks = _week(fcfs(spark, sf_dir)).select("site", bk.timeline_colour(F.col("reason_text")).alias("colour"))
    return bk.legend_counts(blocks)


# --- rules, caps, streaks, audit ------------------------------------------------

def _has(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {_sql_lit(w)})" for w in words) + ")"


def _rules_sql() -> str:
    """Window columns of the audit over the FCFS schedule (twin of operators.audit)."""
    sd = "PARTITION BY site, date, scanner"
    run = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f""",
a0 AS (SELECT *, isodow(date) - 1 AS wd,
              CASE WHEN {_has('reason_text', ['Sedation', 'Claustro'])} THEN 1 ELSE 0 END AS sedf,
              CASE WHEN reason_text <> 'None' THEN 1 ELSE 0 END AS flagf FROM fcfs),
a1 AS (SELECT *,
  sum(CASE WHEN contains(reason_text, 'Hoist') THEN 1 ELSE 0 END) OVER ({sd} ORDER BY start_min, patient_id {run}) AS hoists,
  sum(CASE WHEN contains(reason_text, 'Hospital') THEN 1 ELSE 0 END) OVER (PARTITION BY site, date ORDER BY start_min, patient_id {run}) AS transports,
  lead(start_min) OVER ({sd} ORDER BY start_min, patient_id) AS next_start,
  count(*) OVER (PARTITION BY patient_id) AS n_patient,
  sum(1 - sedf) OVER ({sd} ORDER BY start_min {run}) AS sed_island,
  sum(1 - flagf) OVER ({sd} ORDER BY start_min {run}) AS flag_island FROM a0),
a2 AS (SELECT *,
  CASE WHEN sedf = 1 THEN sum(sedf) OVER (PARTITION BY site, date, scanner, sed_island ORDER BY start_min {run}) ELSE 0 END AS sed_streak,
  CASE WHEN flagf = 1 THEN sum(flagf) OVER (PARTITION BY site, date, scanner, flag_island ORDER BY start_min {run}) ELSE 0 END AS flag_streak
  FROM a1)"""


def _audit_checks_sql() -> dict[str, str]:
    r = "reason_text"
    return {
        "opening_hours": "start_min < 0 OR end_min > 720",
        "closure": "scanner = 4 AND wd = 2 AND start_min < 540 AND end_min > 300",
        "overlap": f"next_start < end_min + {dims.CHANGEOVER_MINUTES}",
        "duplicate_patient": "n_patient > 1",
        "weekend_barred": f"wd >= 5 AND {_has(r, au.WEEKEND_BARRED_WORDS)}",
        "late_complex_start": f"{_has(r, au.COMPLEX_WORDS)} AND start_min > {au.LAST_COMPLEX_START}",
        "hoist_lunch": "contains(reason_text, 'Hoist') AND start_min >= 240 AND start_min < 360",
        "sedation_scanner_3": f"{_has(r, ['Sedation', 'Claustro'])} AND scanner = 3",
        "mobility_scanner_2": f"scanner = 2 AND {_has(r, au.SCANNER2_BARRED_WORDS)}",
        "transport_scanner_4": "scanner = 4 AND contains(reason_text, 'Hospital')",
        "hoist_cap": f"contains(reason_text, 'Hoist') AND hoists > {au.MAX_HOISTS}",
        "transport_cap": f"contains(reason_text, 'Hospital') AND transports > {au.MAX_TRANSPORTS_PER_DAY}",
        "sedation_streak": f"sed_streak > {au.MAX_SEDATION_STREAK}",
        "flag_streak": f"flag_streak > {au.MAX_FLAG_STREAK}",
    }


def _audit_sql() -> str:
    checks = _audit_checks_sql()
    aggs = ", ".join(f"count(*) FILTER (WHERE coalesce({c}, false)) AS {k}" for k, c in checks.items())
    arms = " UNION ALL ".join(f"SELECT '{k}' AS rule, {k} AS violations FROM cnt" for k in checks)
    return _fcfs_sql() + _rules_sql() + f", cnt AS (SELECT {aggs} FROM a2) {arms}"


@query("schedule_audit", _audit_sql)
def schedule_audit(spark, sf_dir):
    """Booking rules as checks over the FCFS schedule."""
    return au.schedule_audit(fcfs(spark, sf_dir))


@query("running_caps", lambda: _fcfs_sql() + _rules_sql() + """
SELECT 'hoist' AS cap, site, date, scanner, patient_id, hoists AS so_far FROM a2
  WHERE contains(reason_text, 'Hoist') AND hoists > 2
UNION ALL SELECT 'transport', site, date, scanner, patient_id, transports FROM a2
  WHERE contains(reason_text, 'Hospital') AND transports > 3""")
def running_caps(spark, sf_dir):
    """Rows past a running cap: >2 hoists per scanner-day, >3 transports per site-day."""
    s = fcfs(spark, sf_dir)
    s = au.running_count(s, F.col("reason_text").contains("Hoist"), ["site", "date", "scanner"], "start_min", "hoists")
    s = au.running_count(s, F.col("reason_text").contains("Hospital"), ["site", "date"], "start_min", "transports")
    h = s.filter(F.col("reason_text").contains("Hoist") & (F.col("hoists") > au.MAX_HOISTS)).select(
        F.lit("hoist").alias("cap"), "site", "date", "scanner", "patient_id", F.col("hoists").cast("long").alias("so_far"))
    t = s.filter(F.col("reason_text").contains("Hospital") & (F.col("transports") > au.MAX_TRANSPORTS_PER_DAY)).select(
        F.lit("transport").alias("cap"), "site", "date", "scanner", "patient_id",
        F.col("transports").cast("long").alias("so_far"))
    return h.unionByName(t)


@query("streaks", lambda: _fcfs_sql() + _rules_sql() + """
SELECT site, date, scanner, max(sed_streak) AS max_sedation_streak, max(flag_streak) AS max_flag_streak
FROM a2 GROUP BY site, date, scanner""")
def streaks(spark, sf_dir):
    """Longest sedation and flagged runs per scanner-day (L7, gaps-and-islands)."""
    s = fcfs(spark, sf_dir)
    sd = ["site", "date", "scanner"]
    s = au.streaks(s, au.any_word(F.col("reason_text"), ["Sedation", "Claustro"]), sd, name="sed_streak")
    s = au.streaks(s, F.col("reason_text") != "None", sd, name="flag_streak")
    return s.groupBy(*sd).agg(F.max("sed_streak").cast("long").alias("max_sedation_streak"),
                              F.max("flag_streak").cast("long").alias("max_flag_streak"))


@query("soft_rule_flags", lambda: _fcfs_sql() + _rules_sql() + """
SELECT site, patient_id, flagf = 1 AND start_min <= 10 AS flag_at_open, flagf = 1 AND end_min >= 720 AS flag_at_close,
       flag_streak > 2 AS flag_run_over_2 FROM a2""")
def soft_rule_flags(spark, sf_dir):
    """Model-policy soft rules evaluated on each booked row."""
    s = fcfs(spark, sf_dir)
    flagged = F.col("reason_text") != "None"
    s = au.streaks(s, flagged, ["site", "date", "scanner"], name="flag_streak")
    soft = au.soft_rule_breaks(flagged, F.col("start_min"), F.col("end_min"))
    return s.select("site", "patient_id", soft["flag_at_open"].alias("flag_at_open"),
                    soft["flag_at_close"].alias("flag_at_close"), (F.col("flag_streak") > 2).alias("flag_run_over_2"))


# --- queue order and eligibility ------------------------------------------------------

@query("queue_order", lambda: "WITH " + sv.request_cte() + f"""
SELECT site, patient_id, prio AS is_priority,
       row_number() OVER (PARTITION BY site ORDER BY prio DESC, request_ts, row_index) - 1 AS queue_pos
FROM (SELECT *, coalesce(regexp_matches({_reason_text_sql()}, '(?i)Hospital|Hoist|Claustrophobic|Sedation'), false) AS prio
      FROM request) t""")
def queue_order(spark, sf_dir):
    """Averages-policy queue: priority first, then request time.

    Positions come from the two-level scan; the block key puts priority
    rows first and keeps blocks monotone in the queue order.
    """
    r = adapters.request(spark, sf_dir).withColumn("is_priority", fx.is_priority(fx.reason_text()))
    block = (1 - F.col("is_priority").cast("long")) * F.lit(1 << 40) + F.floor(F.col("row_index") / F.lit(1 << 16))
    ranked = running_totals(r, ["site"], None, {"queue_pos": F.lit(1).cast("long")}, inclusive=False, block=block,
                            order=[F.col("is_priority").desc(), F.col("request_ts"), F.col("row_index")])
    return ranked.select("site", "patient_id", "is_priority", "queue_pos")


def _cells_sql() -> str:
    sc = ", ".join(str(s) for s, _, _, _, _ in dims.SCANNERS)
    return (f"cells AS (SELECT w AS weekday, s AS scanner, q * 15 AS start FROM range(7) a(w), "
            f"(SELECT unnest([{sc}]) AS s) b, range(48) c(q))")


@query("eligible_slots", lambda: "WITH " + comparison_ctes() + ",\n"
       + _cells_sql() + f""",
prof AS (SELECT r.reason_text, h.duration_heuristic AS duration, count(*) AS n_requests
         FROM req r JOIN heur h ON r.patient_id = h.patient_id GROUP BY 1, 2)
SELECT p.reason_text, p.duration, p.n_requests, count(*) FILTER (WHERE {{ok}}) AS eligible_cells
FROM prof p, cells c GROUP BY 1, 2, 3""".replace("{ok}", _averages_rules_sql("p.reason_text", "c.scanner", "c.weekday",
                                                                               "c.start", "c.start + p.duration")))
def eligible_slots(spark, sf_dir):
    """Averages-policy eligibility (L3, D7): per request profile, the number of
    (weekday, scanner, quarter-hour) start cells that pass the rules.

    Profiles (flag text x duration) are bounded by the flag patterns; each is
    tested against a fixed literal cell array, so there is no join at all.
    """
    prof = (with_heuristic_policy(policy_requests(spark, sf_dir))
            .groupBy("reason_text", F.col("duration_heuristic").alias("duration"))
            .agg(F.count(F.lit(1)).alias("n_requests")))
    return prof.withColumn("eligible_cells", F.size(el.passing_cells(averages_rule("duration"))).cast("long"))


def averages_rule(duration: str):
    """The averages policy's rules on a request's reason_text and duration."""
    return lambda weekday, scanner, start: au.averages_rules(
        F.col("reason_text"), scanner, weekday, start, start + F.col(duration))


def model_rule(duration: str):
    """The model policy's hard rules on a request's needs, class and duration."""
    return lambda weekday, scanner, start: au.model_hard_rules(
        F.col("hoist"), F.col("sedation"), F.col("transport"), F.col("class_ml"), scanner, weekday, start,
        start + F.col(duration))


def _averages_rules_sql(reason, scanner, weekday, start, end) -> str:
    hour = f"floor(({start} + 480) / 60)"
    end_hour = f"floor(({end} + 480) / 60)"
    end_min = f"(({end} + 480) % 60)"
    return " AND ".join([
        f"{end} <= 720",
        f"NOT ({_has(reason, au.COMPLEX_WORDS)} AND {start} > {au.LAST_COMPLEX_START})",
        f"NOT ({weekday} >= 5 AND {_has(reason, au.WEEKEND_BARRED_WORDS)})",
        f"NOT (contains({reason}, 'Hoist') AND {hour} >= 12 AND {hour} < 14)",
        f"NOT (contains({reason}, 'Hospital') AND ({hour} < 9 OR ({end_hour} >= 17 AND {end_min} > 0)))",
        f"NOT ({_has(reason, ['Sedation', 'Claustro'])} AND {scanner} = 3)",
        f"NOT ({scanner} = 2 AND {_has(reason, au.SCANNER2_BARRED_WORDS)})",
        f"NOT ({scanner} = 4 AND (contains({reason}, 'Hospital') OR ({weekday} = 2 AND {hour} >= 13)))",
    ])


def _model_rules_sql(h, s, t, c, scanner, weekday, start, end) -> str:
    hour = f"floor(({start} + 480) / 60)"
    c3 = f"{c} = 'Class 3'"
    return " AND ".join([
        f"{end} <= 720",
        f"NOT ({weekday} >= 5 AND ({c3} OR {h} OR {s} OR {t}))",
        f"NOT ({s} AND {scanner} = 3)",
        f"NOT ({scanner} = 2 AND {h})",
        f"NOT (({h} OR {t} OR {s} OR {c3}) AND {hour} >= 17)",
        f"NOT ({scanner} = 4 AND {weekday} = 2 AND {hour} >= 13)",
    ])


@query("eligible_slots_model", lambda: "WITH " + comparison_ctes()
       + ",\n" + _cells_sql() + """,
rb AS (SELECT patient_id, hoist_required = 'Yes' AS hoist, sedation_needed = 'Yes' AS sedation,
              hospital_transport_required = 'Yes' AS transport FROM request_base),
prof AS (SELECT rb.hoist, rb.sedation, rb.transport, ml.class_ml, ml.duration_ml, count(*) AS n_requests
         FROM rb JOIN ml ON rb.patient_id = ml.patient_id GROUP BY 1, 2, 3, 4, 5)
SELECT p.*, count(*) FILTER (WHERE {ok}) AS eligible_cells FROM prof p, cells c GROUP BY 1, 2, 3, 4, 5, 6""".replace(
    "{ok}", _model_rules_sql("p.hoist", "p.sedation", "p.transport", "p.class_ml", "c.scanner", "c.weekday", "c.start",
                             "c.start + p.duration_ml")))
def eligible_slots_model(spark, sf_dir):
    """Model-policy hard-rule eligibility per request profile (L4)."""
    prof = (with_needs(with_model_policy(spark, sf_dir, policy_requests(spark, sf_dir)))
            .groupBy("hoist", "sedation", "transport", "class_ml", "duration_ml")
            .agg(F.count(F.lit(1)).alias("n_requests")))
    return prof.withColumn("eligible_cells", F.size(el.passing_cells(model_rule("duration_ml"))).cast("long"))


def with_needs(req: DataFrame) -> DataFrame:
    return req.withColumns({"hoist": F.col("hoist_required") == "Yes", "sedation": F.col("sedation_needed") == "Yes",
                            "transport": F.col("hospital_transport_required") == "Yes"})


# --- eligible starts of every request -------------------------------------------

#: horizon of the request tables: 89 days from the day that the request clock starts on
ELIGIBLE_FIRST, ELIGIBLE_LAST = "2025-10-01", "2025-12-28"


def _eligibility_sql() -> str:
    """Every request meets every open date and scanner of the horizon; starts are counted per profile and weekday."""
    averages = _averages_rules_sql("p.reason_text", "c.scanner", "c.weekday", "c.start", "c.start + p.duration")
    model = _model_rules_sql("p.hoist", "p.sedation", "p.transport", "p.class_ml", "c.scanner", "c.weekday", "c.start",
                             "c.start + p.duration")
    closed = " OR ".join(f"(month(d) = {m} AND day(d) = {x})" for m, x in FIXED_HOLIDAYS)
    return "WITH " + sv.request_cte() + ",\n" + comparison_ctes().split(sv.request_base_cte() + ",")[1] + ",\n" + _cells_sql() + f""",
opened AS (SELECT CAST(d AS DATE) AS date, isodow(d) - 1 AS weekday
  FROM generate_series(DATE '{ELIGIBLE_FIRST}', DATE '{ELIGIBLE_LAST}', INTERVAL 1 DAY) g(d) WHERE NOT ({closed})),
asked AS (SELECT r.site, r.patient_id, CAST(r.request_ts AS DATE) AS request_date, q.reason_text,
    h.duration_heuristic, m.duration_ml, m.class_ml, hoist_required = 'Yes' AS hoist, sedation_needed = 'Yes' AS sedation,
    hospital_transport_required = 'Yes' AS transport
  FROM request r JOIN req q USING (patient_id) JOIN heur h USING (patient_id) JOIN ml m USING (patient_id)),
p1 AS (SELECT DISTINCT reason_text, duration_heuristic AS duration FROM asked),
p2 AS (SELECT DISTINCT hoist, sedation, transport, class_ml, duration_ml AS duration FROM asked),
s1 AS (SELECT p.*, c.weekday, c.scanner, count(*) AS n FROM p1 p, cells c WHERE {averages} GROUP BY ALL),
s2 AS (SELECT p.*, c.weekday, c.scanner, count(*) AS n FROM p2 p, cells c WHERE {model} GROUP BY ALL),
met AS (
  SELECT 'averages' AS policy, a.patient_id, o.date, s.n FROM asked a JOIN opened o ON o.date >= a.request_date
  JOIN s1 s ON s.reason_text = a.reason_text AND s.duration = a.duration_heuristic AND s.weekday = o.weekday
  UNION ALL
  SELECT 'model', a.patient_id, o.date, s.n FROM asked a JOIN opened o ON o.date >= a.request_date
  JOIN s2 s ON s.hoist = a.hoist AND s.sedation = a.sedation AND s.transport = a.transport AND s.class_ml = a.class_ml
    AND s.duration = a.duration_ml AND s.weekday = o.weekday),
sums AS (SELECT policy, patient_id, sum(n) AS n, count(DISTINCT date) AS days, min(date) AS first_day FROM met GROUP BY ALL)
SELECT k.policy, a.site, a.patient_id, a.request_date, coalesce(s.n, 0)::BIGINT AS n_starts,
  coalesce(s.days, 0)::BIGINT AS n_days, s.first_day
FROM asked a CROSS JOIN (VALUES ('averages'), ('model')) k(policy)
LEFT JOIN sums s ON s.policy = k.policy AND s.patient_id = a.patient_id"""


@query("request_eligibility", _eligibility_sql)
def request_eligibility(spark, sf_dir):
    """Eligible starts of every request from its date on, under both policies."""
    req = adapters.request(spark, sf_dir).select(
        "site", "patient_id", F.col("request_ts").cast("date").alias("request_date"), "scan_type",
        fx.reason_text().alias("reason_text"), "contrast", *dims.FLAG_COLUMNS)

    def with_policies(d: DataFrame) -> DataFrame:
        return with_needs(with_model_policy(spark, sf_dir, with_heuristic_policy(d)))

    policies = {"averages": (["reason_text", "duration_heuristic"], averages_rule("duration_heuristic")),
                "model": (["hoist", "sedation", "transport", "class_ml", "duration_ml"], model_rule("duration_ml"))}
    return el.eligible_starts(with_policies(req), policies, ELIGIBLE_FIRST, ELIGIBLE_LAST,
                              ["site", "patient_id", "request_date"], with_policies(policy_requests(spark, sf_dir)))
