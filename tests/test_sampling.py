"""Sampling properties: quota sizes, exclusivity, exact split sizes."""
from pyspark.sql import functions as F

from apptflow.operators import sampling as smp
from apptflow.sources import adapters, dims


def test_quota_sample_sizes_and_exclusive(spark, sf_small):
    pool = adapters.request_base(spark, sf_small)
    s = smp.quota_sample(pool)
    rows = s.collect()
    ids = [r["patient_id"] for r in rows]
    assert len(ids) == len(set(ids)) == min(dims.SAMPLE_SIZE, pool.count())
    by_step = {}
    for r in rows:
        by_step[r["step"]] = by_step.get(r["step"], 0) + 1
    avail = {o: pool.filter(F.col(f) == "Yes").count() for o, f, _ in dims.QUOTAS}
    for o, f, n in dims.QUOTAS:
        assert by_step.get(o, 0) <= min(n, avail[o])


def test_exact_split_per_site(spark, sf_small):
    a = adapters.appointment(spark, sf_small).select("patient_id", "site")
    s = smp.exact_split(a, ["site"])
    got = {(r["site"]): (r["n"], r["t"]) for r in s.groupBy("site").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect()}
    for site, (n, t) in got.items():
        assert t == (n * 20 + 99) // 100


def test_quota_shortfall_is_reported(spark, sf_small):
    from apptflow.operators import sampling
    from apptflow.sources import adapters
    pool = adapters.request_base(spark, sf_small)
    quotas = [(1, "hoist_required", 10 ** 6)]
    got = sampling.quota_sample(pool, quotas, target_no_flag=5, size=10 ** 7)
    lack = sampling.quota_shortfall(got, quotas, 5, 10 ** 7)
    n, hoists = pool.count(), pool.filter("hoist_required = 'Yes'").count()
    assert got.count() == n and lack == {"hoist_required": 10 ** 6 - hoists, "total": 10 ** 7 - n}
