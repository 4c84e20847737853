"""The test-data adapter written as DuckDB SQL common table expressions.

These are the oracle's own definitions of ``appointment`` and ``request``
(plain window functions, no two-level scans), generated from the same fixed
dimension values as the Spark plans.
"""
from __future__ import annotations

from apptflow.functions.draws import pick_sql, u_sql, weighted_pick_sql, _sql_lit
from apptflow.sources import dims


def _in(values) -> str:
    return ", ".join(_sql_lit(v) for v in values)


def rule_minutes_sql(col: str) -> str:
    whens = " ".join(f"WHEN {_sql_lit(s)} THEN {m}" for s, m, _ in dims.SCAN_RULES)
    return f"COALESCE(CASE {col} {whens} END, {dims.DEFAULT_SCAN_MINUTES})"


def yes_no_sql(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 'Yes' ELSE 'No' END"


def reason_flags_sql(col: str) -> list[str]:
    by_flag: dict[str, list[str]] = {}
    for flag, r in dims.REASON_FLAG:
        by_flag.setdefault(flag, []).append(r)
    return [f"{yes_no_sql(f'{col} IN ({_in(by_flag[f])})')} AS {f}" for f in dims.FLAG_COLUMNS]


def delay_band_sql(col: str) -> str:
    return (f"CASE WHEN {col} = 0 THEN 'Class 1' WHEN {col} > 0 AND {col} <= 20 THEN 'Class 2' "
            f"WHEN {col} > 20 THEN 'Class 3' ELSE 'Unknown' END")


def appointment_raw_cte() -> str:
    scan_names = [s for s, _, _ in dims.SCAN_RULES]
    p = "patient_id"
    return f"""appointment_raw AS (
  SELECT patient_id, site, age, gender, scan_type, scheduled_minutes, arrival_offset,
         scheduled_minutes + overrun_minutes AS actual_minutes, overrun_minutes, scheduled_at,
         delay_reason, scheduled_at + to_minutes(CAST(scheduled_minutes + overrun_minutes AS BIGINT)) AS actual_end
  FROM (
    SELECT *, CAST(CASE WHEN delay_reason IS NULL THEN 0
                        WHEN {u_sql(p, 'severity')} < (CASE WHEN delay_reason IN ({_in(dims.MAJOR_PRONE_REASONS)}) THEN 0.1 ELSE 0.7 END)
                        THEN 5 + floor({u_sql(p, 'minutes')} * 16)
                        ELSE 21 + floor({u_sql(p, 'minutes')} * 40) END AS INTEGER) AS overrun_minutes,
           CAST({rule_minutes_sql('scan_type')} AS INTEGER) AS scheduled_minutes
    FROM (
      SELECT o.o_orderkey AS patient_id, c.c_nationkey AS site,
             CAST(18 + floor({u_sql('o.o_orderkey', 'age')} * 72) AS INTEGER) AS age,
             {pick_sql(u_sql('o.o_orderkey', 'gender'), dims.GENDERS)} AS gender,
             {pick_sql(u_sql('o.o_orderkey', 'scan'), scan_names)} AS scan_type,
             CAST({pick_sql(u_sql('o.o_orderkey', 'arrival'), dims.ARRIVAL_OFFSETS)} AS INTEGER) AS arrival_offset,
             NULLIF({weighted_pick_sql(u_sql('o.o_orderkey', 'reason'), dims.REASON_MIX)}, 'None') AS delay_reason,
             o.o_orderdate + to_minutes(CAST(480 + 15 * floor({u_sql('o.o_orderkey', 'slot')} * 48) AS BIGINT)) AS scheduled_at
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey) b) b2)"""


def appointment_cte() -> str:
    flags = ",\n         ".join(reason_flags_sql("delay_reason"))
    cols9 = ", ".join(dims.FLAG_COLUMNS[:9])
    cols2 = ", ".join(dims.FLAG_COLUMNS[9:])
    return appointment_raw_cte() + f""",
appointment_f AS (
  SELECT *, actual_minutes - scheduled_minutes AS overrun2,
         {flags},
         {yes_no_sql("lower(scan_type) LIKE '%contrast%'")} AS contrast
  FROM appointment_raw),
appointment AS (
  SELECT patient_id, site, age, gender, scan_type, scheduled_minutes, arrival_offset, actual_minutes,
         scheduled_at, actual_end, overrun2 AS overrun_minutes, delay_reason, {cols9}, contrast, {cols2},
         {delay_band_sql('overrun2')} AS class
  FROM appointment_f)"""


def indication_scan_sql(draw: str) -> str:
    parts = []
    for ind in dims.INDICATIONS:
        items = [(s, w) for i, s, w in dims.INDICATION_MIX if i == ind]
        parts.append(f"WHEN indication = {_sql_lit(ind)} THEN {weighted_pick_sql(draw, items)}")
    return "CASE " + " ".join(parts) + " END"


def request_base_cte() -> str:
    flags = ", ".join(dims.FLAG_COLUMNS)
    any_yes = " OR ".join(f"coalesce(lower({c}) = 'yes', false)" for c in dims.FLAG_COLUMNS)
    return appointment_cte() + f""",
request_a AS (
  SELECT patient_id, site, age, gender, {flags},
         {yes_no_sql(any_yes)} AS flag_present,
         {pick_sql(u_sql('patient_id', 'indication'), dims.INDICATIONS)} AS indication
  FROM appointment),
request_s AS (
  SELECT *, {indication_scan_sql(u_sql('patient_id', 'indication_scan'))} AS scan_type FROM request_a),
request_base AS (
  SELECT *, {yes_no_sql("scan_type LIKE '%Contrast%'")} AS contrast FROM request_s)"""


def request_cte() -> str:
    flags = ", ".join(dims.FLAG_COLUMNS)
    return request_base_cte() + f""",
request_b AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY patient_id) - 1 AS row_index,
         CAST(sum(CAST(2 + floor({u_sql('patient_id', 'gap')} * 13) AS BIGINT)) OVER (PARTITION BY site ORDER BY patient_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS clock
  FROM request_base),
request AS (
  SELECT patient_id, site, row_index, age, gender, {flags}, flag_present, indication, scan_type, contrast,
         TIMESTAMP '2025-10-01 00:00:00' + to_minutes(CAST(floor(clock / 600) * 1440 + 480 + clock % 600 AS BIGINT)) AS request_ts
  FROM request_b)"""
