"""Core projections, predicates, lookups and the flag summary (A, C, D, E, F1)."""
from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from apptflow.functions import flags as fx
from apptflow.functions.draws import _sql_lit, pick, u, pick_sql, u_sql
from apptflow.operators import reports
from apptflow.plans import sqlviews as sv
from apptflow.plans.registry import query
from apptflow.plans.sqlfmt import pct_sql, values_sql, with_
from apptflow.session import ensure_checkpoint_dir
from apptflow.sources import adapters, dims
from apptflow.sources.io import read_csv, read_csv_checked, table, write_csv

APPT = sv.appointment_cte
REQ = sv.request_cte


def _yes(col: str, truthy=("yes", "true", "1")) -> str:
    return f"coalesce(lower(trim(CAST({col} AS VARCHAR))) IN ({', '.join(_sql_lit(t) for t in truthy)}), false)"


# --- F1 flag summary (flagship) ---------------------------------------------

def _flag_summary_sql() -> str:
    arms = [f"SELECT {o} AS order_no, class FROM appointment WHERE {_yes(c)}" for o, c, _ in dims.DISPLAY_NAME]
    none = " AND ".join(f"NOT {_yes(c)}" for _, c, _ in dims.DISPLAY_NAME)
    arms.append(f"SELECT 0 AS order_no, class FROM appointment WHERE {none}")
    labels = values_sql([(0, dims.CONTROL_LABEL)] + [(o, lbl) for o, _, lbl in dims.DISPLAY_NAME],
                        ["order_no", "delay_reason"])
    return with_(APPT(), f"""long_f AS ({' UNION ALL '.join(arms)}),
agg AS (SELECT order_no, count(*) AS total_cases, count(*) FILTER (WHERE class = 'Class 3') AS major_delay,
               count(*) FILTER (WHERE class = 'Class 2') AS minor_delay FROM long_f GROUP BY order_no),
j AS (SELECT CAST(l.order_no AS INTEGER) AS order_no, l.delay_reason, coalesce(a.total_cases, 0) AS total_cases,
             coalesce(a.major_delay, 0) AS major_delay, coalesce(a.minor_delay, 0) AS minor_delay
      FROM {labels} l LEFT JOIN agg a ON a.order_no = l.order_no)""") + f"""
SELECT order_no, delay_reason, total_cases, major_delay,
       {pct_sql('major_delay', 'total_cases')} AS pct_major, {pct_sql('minor_delay', 'total_cases')} AS pct_minor
FROM j"""


@query("flag_summary", _flag_summary_sql)
def flag_summary(spark: SparkSession, sf_dir: str):
    return reports.flag_summary(adapters.appointment(spark, sf_dir))


# --- C4 / C5 / C6 / C7 -------------------------------------------------------

@query("overrun_minutes", lambda: with_(sv.appointment_raw_cte()) +
       " SELECT patient_id, actual_minutes - scheduled_minutes AS overrun_minutes FROM appointment_raw")
def overrun_minutes(spark, sf_dir):
    raw = adapters.appointment_raw(spark, sf_dir)
    return raw.select("patient_id", (F.col("actual_minutes") - F.col("scheduled_minutes")).alias("overrun_minutes"))


@query("reason_flags", lambda: with_(APPT()) +
       f" SELECT patient_id, delay_reason, {', '.join(dims.FLAG_COLUMNS)}, contrast FROM appointment")
def reason_flags(spark, sf_dir):
    return adapters.appointment(spark, sf_dir).select("patient_id", "delay_reason", *dims.FLAG_COLUMNS, "contrast")


def _delay_band_sql() -> str:
    o = "CAST(l_quantity AS INTEGER) - 25"
    form2 = f"CASE WHEN {o} > 20 THEN 'Class 3' WHEN {o} > 0 THEN 'Class 2' ELSE 'Class 1' END"
    return (f"SELECT {sv.delay_band_sql(o)} AS band, {form2} AS band_report, count(*) AS n "
            f"FROM lineitem GROUP BY 1, 2")


@query("delay_band", _delay_band_sql)
def delay_band(spark, sf_dir):
    """Both banding forms over lineitem quantities shifted to include negatives."""
    li = table(spark, sf_dir, "lineitem", ["l_quantity"])
    o = F.col("l_quantity").cast("int") - 25
    return (li.select(fx.delay_band(o).alias("band"), fx.delay_band_report(o).alias("band_report"))
            .groupBy("band", "band_report").agg(F.count(F.lit(1)).alias("n")))


@query("flag_present", lambda: with_(REQ()) + " SELECT patient_id, flag_present FROM request")
def flag_present(spark, sf_dir):
    return adapters.request(spark, sf_dir).select("patient_id", "flag_present")


def _reason_text_sql(cols=None, names=None) -> str:
    cols = dims.REASON_TEXT_FLAGS if cols is None else cols
    names = dims.FLAG_DISPLAY if names is None else names
    parts = ", ".join(f"CASE WHEN {c} = 'Yes' THEN {_sql_lit(names[c])} END" for c in cols)
    return f"coalesce(nullif(concat_ws(', ', {parts}), ''), 'None')"


def _short_names() -> dict:
    out = {}
    for c in dims.REASON_TEXT_FLAGS:
        n = dims.FLAG_DISPLAY[c]
        for suffix in (" Required", " needed", " User"):
            n = n.replace(suffix, "")
        out[c] = n
    return out


@query("delay_reason_text", lambda: with_(REQ()) +
       f" SELECT patient_id, {_reason_text_sql()} AS reason_text, "
       f"{_reason_text_sql(names=_short_names())} AS short_flags FROM request")
def delay_reason_text(spark, sf_dir):
    return adapters.request(spark, sf_dir).select(
        "patient_id", fx.reason_text().alias("reason_text"), fx.short_flag_text().alias("short_flags"))


# Spellings vary by a hash draw so every accepted and rejected form occurs.
SPELL_YES = ["Yes", "yes", "TRUE", "1", "y"]
SPELL_NO = ["No", "no", "false", "0", None]


def _spelled_sql() -> str:
    return (f"CASE WHEN hoist_required = 'Yes' OR wheelchair_user = 'Yes' "
            f"THEN {pick_sql(u_sql('patient_id', 'spelling'), SPELL_YES)} "
            f"ELSE {pick_sql(u_sql('patient_id', 'spelling'), SPELL_NO)} END")


@query("normalise_flags", lambda: with_(APPT()) +
       f" SELECT patient_id, raw_flag, CASE WHEN {_yes('raw_flag')} THEN 'Yes' ELSE 'No' END AS flag "
       f"FROM (SELECT patient_id, {_spelled_sql()} AS raw_flag FROM appointment) t")
def normalise_flags(spark, sf_dir):
    appt = adapters.appointment(spark, sf_dir)
    draw = u("patient_id", "spelling")
    spelled = F.when((F.col("hoist_required") == "Yes") | (F.col("wheelchair_user") == "Yes"),
                     pick(draw, SPELL_YES)).otherwise(pick(draw, SPELL_NO))
    return appt.select("patient_id", spelled.alias("raw_flag")).select(
        "patient_id", "raw_flag", fx.normalise_flag("raw_flag").alias("flag"))


def _complexity_sql() -> str:
    return " + ".join(f"CAST({c} = 'Yes' AS INTEGER)" for c in dims.REASON_TEXT_FLAGS)


@query("complexity_score", lambda: with_(REQ()) +
       f" SELECT patient_id, {_complexity_sql()} AS complexity FROM request")
def complexity_score(spark, sf_dir):
    return adapters.request(spark, sf_dir).select("patient_id", fx.complexity().alias("complexity"))


@query("complexity_pool", lambda: with_(REQ()) +
       f" SELECT pool, count(*) AS n FROM (SELECT CASE WHEN c >= 3 THEN 'high' WHEN c >= 1 THEN 'medium' "
       f"ELSE 'low' END AS pool FROM (SELECT {_complexity_sql()} AS c FROM request) a) b GROUP BY pool")
def complexity_pool(spark, sf_dir):
    c = fx.complexity()
    pool = F.when(c >= 3, "high").when(c >= 1, "medium").otherwise("low")
    return (adapters.request(spark, sf_dir).select(pool.alias("pool"))
            .groupBy("pool").agg(F.count(F.lit(1)).alias("n")))


@query("date_round_robin", lambda: with_(REQ()) +
       f" SELECT patient_id, site, row_index, CAST(DATE '{dims.BOOKING_START}' + CAST(row_index % 5 AS INTEGER) AS DATE)"
       f" AS request_date FROM request")
def date_round_robin(spark, sf_dir):
    r = adapters.request(spark, sf_dir)
    return r.select("patient_id", "site", "row_index",
                    F.date_add(F.lit(dims.BOOKING_START).cast("date"), (F.col("row_index") % 5).cast("int"))
                    .alias("request_date"))


@query("rounding", """SELECT l_quantity / 2 AS half_qty, CAST(round_even(l_quantity / 2, 0) AS DOUBLE) AS even,
       CAST(round(l_quantity / 2, 0) AS DOUBLE) AS half_up, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def rounding(spark, sf_dir):
    """Half-to-even (bround) vs half-up rounding on exact .5 ties."""
    li = table(spark, sf_dir, "lineitem", ["l_quantity"])
    h = F.col("l_quantity") / 2
    return (li.select(h.alias("half_qty"), F.bround(h, 0).alias("even"), F.round(h, 0).alias("half_up"))
            .groupBy("half_qty", "even", "half_up").agg(F.count(F.lit(1)).alias("n")))


@query("clip_zero", lambda: with_(APPT()) +
       " SELECT patient_id, greatest(0.0, CAST(overrun_minutes - 10 AS DOUBLE)) AS clipped FROM appointment")
def clip_zero(spark, sf_dir):
    appt = adapters.appointment(spark, sf_dir)
    return appt.select("patient_id", fx.clip_zero(F.col("overrun_minutes") - 10).alias("clipped"))


@query("ensure_columns", lambda: with_(REQ()) +
       " SELECT patient_id, mobility_needs, 'Unknown' AS clinical_indication, 'No' AS hoist_flag_extra FROM request")
def ensure_columns(spark, sf_dir):
    r = adapters.request(spark, sf_dir).select("patient_id", "mobility_needs")
    return fx.ensure_columns(r, {"mobility_needs": "No", "clinical_indication": "Unknown",
                                 "hoist_flag_extra": "No"})


@query("filter_flag", lambda: with_(APPT()) +
       " SELECT patient_id, site, class FROM appointment WHERE hoist_required = 'Yes'")
def filter_flag(spark, sf_dir):
    return adapters.appointment(spark, sf_dir).filter(F.col("hoist_required") == "Yes").select(
        "patient_id", "site", "class")


@query("control_group", lambda: with_(APPT()) +
       " SELECT class, count(*) AS n FROM appointment WHERE " +
       " AND ".join(f"NOT {_yes(c)}" for _, c, _ in dims.DISPLAY_NAME) + " GROUP BY class")
def control_group(spark, sf_dir):
    appt = adapters.appointment(spark, sf_dir)
    mask = reports.control_mask([c for _, c, _ in dims.DISPLAY_NAME])
    return appt.filter(mask).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("available_requests", lambda: with_(REQ()) + f""",
days AS (SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '{dims.BOOKING_START}', DATE '{dims.BOOKING_END}', INTERVAL 1 DAY) g(d)),
rd AS (SELECT site, CAST(DATE '{dims.BOOKING_START}' + CAST(row_index % 5 AS INTEGER) AS DATE) AS request_date FROM request),
sites AS (SELECT DISTINCT site FROM request)
SELECT s.site, d.day, (SELECT count(*) FROM rd WHERE rd.site = s.site AND rd.request_date <= d.day) AS n_available
FROM sites s, days d""")
def available_requests(spark, sf_dir):
    """Requests available by each booking day (E5): per-day counts + running sum.

    The set-based form of ``request_date <= day``: count per (site, date),
    then a cumulative sum over the (tiny) per-site date axis. No theta join.
    """
    r = date_round_robin(spark, sf_dir)
    start = F.lit(dims.BOOKING_START).cast("date")
    per_day = r.groupBy("site", F.col("request_date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    # every (site, day) cell, generated per site rather than joined
    grid = r.select("site").distinct().select(
        "site", F.explode(F.sequence(start, F.lit(dims.BOOKING_END).cast("date"))).alias("day"))
    w = Window.partitionBy("site").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return (grid.join(per_day, ["site", "day"], "left")
            .select("site", "day", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("n_available")))


@query("priority_flag", lambda: with_(REQ()) +
       f" SELECT patient_id, reason_text, coalesce(regexp_matches(reason_text, '(?i)Hospital|Hoist|Claustrophobic|Sedation'), false) AS is_priority"
       f" FROM (SELECT patient_id, {_reason_text_sql()} AS reason_text FROM request) t")
def priority_flag(spark, sf_dir):
    r = adapters.request(spark, sf_dir).select("patient_id", fx.reason_text().alias("reason_text"))
    return r.withColumn("is_priority", fx.is_priority("reason_text"))


@query("rule_minutes", lambda: with_(REQ()) + f""",
rule AS {values_sql([(s, m) for s, m, _ in dims.SCAN_RULES], ['scan_type', 'minutes'])}
SELECT r.patient_id, r.scan_type, CAST(coalesce(rule.minutes, {dims.DEFAULT_SCAN_MINUTES}) AS INTEGER) AS minutes
FROM request r LEFT JOIN rule ON r.scan_type = rule.scan_type""")
def rule_minutes(spark, sf_dir):
    """Scan type -> standard minutes via a broadcast left join, default 30."""
    r = adapters.request(spark, sf_dir).select("patient_id", "scan_type")
    rule = F.broadcast(dims.scan_rule(spark).select("scan_type", "minutes"))
    return r.join(rule, "scan_type", "left").select(
        "patient_id", "scan_type",
        F.coalesce("minutes", F.lit(dims.DEFAULT_SCAN_MINUTES)).cast("int").alias("minutes"))


@query("padded_id", lambda: with_(APPT()) +
       " SELECT patient_id, lpad(CAST(patient_id AS VARCHAR), CAST(greatest(4, length(CAST(patient_id AS VARCHAR))) AS INTEGER), '0')"
       " AS patient_number FROM appointment")
def padded_id(spark, sf_dir):
    return adapters.appointment(spark, sf_dir).select("patient_id", fx.pad_id("patient_id").alias("patient_number"))


@query("rename_std", lambda: with_(REQ()) + " SELECT patient_id AS patient_number, scan_type AS scan, age FROM request")
def rename_std(spark, sf_dir):
    r = adapters.request(spark, sf_dir).select("patient_id", "scan_type", "age")
    return r.withColumnsRenamed({"patient_id": "patient_number", "scan_type": "scan"})


FINAL_COLS = ["patient_id", "age", "gender", "scan_type", "scheduled_minutes", "arrival_offset",
              "actual_minutes", "scheduled_at", "actual_end", "overrun_minutes", *dims.FLAG_COLUMNS[:9],
              "contrast", *dims.FLAG_COLUMNS[9:], "class"]


@query("final_projection", lambda: with_(APPT()) + f" SELECT {', '.join(FINAL_COLS)} FROM appointment")
def final_projection(spark, sf_dir):
    return adapters.appointment(spark, sf_dir).select(*FINAL_COLS)


@query("dim_scan_rules", lambda: with_(APPT()) + f""",
rule AS {values_sql(dims.SCAN_RULES, ['scan_type', 'minutes', 'contrast'])}
SELECT rule.scan_type, CAST(rule.minutes AS INTEGER) AS minutes, rule.contrast, count(a.patient_id) AS n
FROM rule LEFT JOIN appointment a ON a.scan_type = rule.scan_type GROUP BY 1, 2, 3""")
def dim_scan_rules(spark, sf_dir):
    """The scan-rule dimension with its usage counts (A4)."""
    appt = adapters.appointment(spark, sf_dir)
    counts = appt.groupBy("scan_type").agg(F.count(F.lit(1)).alias("n"))
    return (F.broadcast(dims.scan_rule(spark)).join(counts, "scan_type", "left")
            .select("scan_type", "minutes", "contrast", F.coalesce("n", F.lit(0)).alias("n")))


CSV_SCHEMA = ("patient_id BIGINT, age INT, gender STRING, scan_type STRING, scheduled_minutes INT, "
              "actual_minutes INT, scheduled_at TIMESTAMP_NTZ, delay_reason STRING, class STRING")


@query("csv_roundtrip", lambda: with_(APPT()) +
       " SELECT patient_id, age, gender, scan_type, scheduled_minutes, actual_minutes, scheduled_at, delay_reason, class"
       " FROM appointment")
def csv_roundtrip(spark, sf_dir):
    """Header CSV sink then typed CSV scan (A1, A3) through shared storage."""
    import uuid
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/csv_roundtrip/{uuid.uuid4().hex}"
    cols = [c.split()[0] for c in CSV_SCHEMA.split(", ")]
    write_csv(adapters.appointment(spark, sf_dir).select(*cols), path)
    return read_csv(spark, path, CSV_SCHEMA)


CHECKED_SCHEMA = "patient_id BIGINT, age INT, scan_type STRING, delay_reason STRING"
BAD_AGE, SHORT_LINE = 0.03, 0.02


def _lines_sql() -> str:
    short, bad = u_sql("patient_id", "short_line"), u_sql("patient_id", "bad_age")
    return with_(APPT()) + f""",
lines AS (SELECT patient_id, age, scan_type, delay_reason, {short} < {SHORT_LINE} AS short, {bad} < {BAD_AGE} AS bad,
  lpad(patient_id::VARCHAR, 12, '0') || ',' || CASE WHEN {bad} < {BAD_AGE} THEN 'n/a' ELSE ' ' || age::VARCHAR END AS start,
  ',"' || scan_type || '",' || coalesce('"' || delay_reason || '"', 'None') AS rest FROM appointment)"""


@query("csv_rejects", lambda: _lines_sql() + """
SELECT 'good' AS status, patient_id, age, scan_type, delay_reason, NULL AS line FROM lines WHERE NOT short AND NOT bad
UNION ALL SELECT 'rejected', NULL, NULL, NULL, NULL, start || CASE WHEN short THEN '' ELSE rest END FROM lines WHERE short OR bad""")
def csv_rejects(spark, sf_dir):
    """A file with short lines, bad numbers, padded identifiers and 'None': good rows and rejected lines (A1, A2)."""
    import uuid
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv_rejects/{uuid.uuid4().hex}"
    a = adapters.appointment(spark, sf_dir)
    start = F.concat(F.lpad(F.col("patient_id").cast("string"), 12, "0"), F.lit(","), F.when(
        u("patient_id", "bad_age") < BAD_AGE, F.lit("n/a")).otherwise(F.concat(F.lit(" "), F.col("age").cast("string"))))
    rest = F.concat(F.lit(',"'), "scan_type", F.lit('",'), F.coalesce(
        F.concat(F.lit('"'), "delay_reason", F.lit('"')), F.lit("None")))
    a.select(F.when(u("patient_id", "short_line") < SHORT_LINE, start).otherwise(F.concat(start, rest)).alias("value")).write.text(path)
    good, rejected = read_csv_checked(spark, path, CHECKED_SCHEMA, header=False)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in CHECKED_SCHEMA.split(", "))]
    return good.select(F.lit("good").alias("status"), "*", F.lit(None).cast("string").alias("line")).unionByName(
        rejected.select(F.lit("rejected").alias("status"), *nothing, "line"))
