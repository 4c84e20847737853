"""Sampling queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from apptflow.functions.draws import u_sql
from apptflow.operators import sampling as smp
from apptflow.plans import sqlviews as sv
from apptflow.plans.registry import query
from apptflow.plans.sqlfmt import with_
from apptflow.sources import adapters, dims
from apptflow.sources.adapters import memo_plan


def _quota_sql() -> str:
    ctes = [f"pool AS (SELECT *, {u_sql('patient_id', 'quota')} AS u FROM request_base)"]
    prev = None
    steps = [(o, f"{flag} = 'Yes'", n, flag) for o, flag, n in dims.QUOTAS]
    steps.append((len(dims.QUOTAS) + 1, "flag_present = 'No'", dims.TARGET_NO_FLAG, "no_flag"))
    for step, cond, n, label in steps:
        excl = f" AND patient_id NOT IN (SELECT patient_id FROM t{prev})" if prev else ""
        ctes.append(f"s{step} AS (SELECT patient_id, u, {step} AS step, '{label}' AS label FROM pool "
                    f"WHERE {cond}{excl} ORDER BY u, patient_id LIMIT {n})")
        ctes.append(f"t{step} AS (SELECT * FROM s{step}" + (f" UNION ALL SELECT * FROM t{prev})" if prev else ")"))
        prev = step
    fill = len(steps) + 1
    ctes.append(f"""f AS (SELECT patient_id, u, {fill} AS step, 'fill' AS label FROM (
        SELECT *, row_number() OVER (ORDER BY u, patient_id) AS rn FROM pool
        WHERE patient_id NOT IN (SELECT patient_id FROM t{prev})) x
      WHERE rn <= {dims.SAMPLE_SIZE} - (SELECT count(*) FROM t{prev}))""")
    ctes.append(f"allp AS (SELECT * FROM t{prev} UNION ALL SELECT * FROM f)")
    ctes.append("quota_sample AS (SELECT patient_id, step, label, row_number() OVER (PARTITION BY step ORDER BY u, patient_id)"
                " AS pick_no FROM allp)")
    return sv.request_base_cte() + ",\n" + ",\n".join(ctes)


@memo_plan
def _quota(spark, sf_dir):
    return smp.quota_sample(adapters.request_base(spark, sf_dir))


@query("quota_sample", lambda: with_(_quota_sql()) + " SELECT * FROM quota_sample")
def quota_sample(spark, sf_dir):
    return _quota(spark, sf_dir)


@query("pool_remaining", lambda: with_(_quota_sql()) +
       " SELECT patient_id, site FROM request_base WHERE patient_id NOT IN (SELECT patient_id FROM quota_sample)")
def pool_remaining(spark, sf_dir):
    pool = adapters.request_base(spark, sf_dir).select("patient_id", "site")
    return smp.remaining(pool, _quota(spark, sf_dir))


@query("sampled_rows", lambda: with_(_quota_sql()) +
       " SELECT q.step, q.pick_no, r.patient_id, r.age, r.gender, r.flag_present, r.indication, r.scan_type, r.contrast"
       " FROM quota_sample q JOIN request_base r ON q.patient_id = r.patient_id")
def sampled_rows(spark, sf_dir):
    """Fetch sampled requests with their sampled order."""
    rows = adapters.request_base(spark, sf_dir).select(
        "patient_id", "age", "gender", "flag_present", "indication", "scan_type", "contrast")
    s = _quota(spark, sf_dir).select("patient_id", "step", "pick_no")
    return smp.fetch_in_order(s, rows)


@query("random_sample", lambda: with_(sv.request_base_cte()) +
       f" SELECT patient_id, site FROM request_base ORDER BY {u_sql('patient_id', 'sample')}, patient_id"
       f" LIMIT {dims.SAMPLE_SIZE}")
def random_sample(spark, sf_dir):
    return smp.random_sample(adapters.request_base(spark, sf_dir), dims.SAMPLE_SIZE).select("patient_id", "site")


@query("train_test_split", lambda: with_(sv.appointment_cte()) + f"""
SELECT patient_id, site, CASE WHEN row_number() OVER (PARTITION BY site ORDER BY {u_sql('patient_id', 'split')}, patient_id)
   <= (count(*) OVER (PARTITION BY site) * 20 + 99) // 100 THEN 'test' ELSE 'train' END AS split
FROM appointment""")
def train_test_split(spark, sf_dir):
    a = adapters.appointment(spark, sf_dir).select("patient_id", "site")
    return smp.exact_split(a, ["site"]).select("patient_id", "site", "split")
