"""Sampling operators.

Every sample is a deterministic hash order, so re-running a lost task
reproduces the same rows. Top-n picks use ``orderBy(...).limit(n)``, which
Spark plans as a distributed top-k (TakeOrderedAndProject): each partition
keeps n rows, so no unbounded group reaches one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptflow.functions.draws import u
from apptflow.operators.scan import running_totals
from apptflow.sources import dims


def random_sample(df: DataFrame, n: int, key: str = "patient_id", salt: str = "sample") -> DataFrame:
    """n rows by hash order."""
    return df.withColumn("u", u(key, salt)).orderBy("u", key).limit(n)


def quota_sample(pool: DataFrame, quotas: list[tuple] | None = None, target_no_flag: int = dims.TARGET_NO_FLAG,
                 size: int = dims.SAMPLE_SIZE, key: str = "patient_id", salt: str = "quota") -> DataFrame:
    """Ordered exclusive quota sample.

    For each quota in order take min(quota, available) rows with that flag
    that were not taken before (lowest hash draw first); then unflagged
    rows; then fill to ``size`` from the rest. A pool that is too small gives
    fewer rows: ``quota_shortfall`` reports how many each step lacks.

    Step k can only pick among the ``M_k = Σ_{j<=k} n_j`` lowest draws of its
    eligible rows (earlier steps remove at most ``M_k - n_k`` of them), and the
    fill among the ``size`` lowest draws overall. One aggregate counts the
    eligible rows of each step; as draws are uniform, a draw threshold a little
    over M_k / count keeps a bounded number of candidates, which are read once
    more with a higher threshold where a step has fewer than it can use. The
    ordered picks are made on these candidates, a few times ``size`` rows.
    Returns (key, step, label, pick_no) in sampled order.
    """
    steps, wanted = _quota_steps(quotas, target_no_flag, size)
    p = pool.select(key, *{c for c, _, _, _ in steps if c}).withColumn("u", u(key, salt))
    eligible = [F.col(c) == v if c else F.lit(True) for c, v, _, _ in steps]
    # the steps a row is eligible for, as bits of one number
    p = p.select(key, "u", sum(F.when(e, F.lit(1 << i)).otherwise(F.lit(0)) for i, e in enumerate(eligible)).alias("may"))
    # rows of each pattern of bits: at most 2**steps of them
    patterns = {r["may"]: r["n"] for r in p.groupBy("may").agg(F.count(F.lit(1)).alias("n")).collect()}
    count = [sum(n for m, n in patterns.items() if m >> i & 1) for i in range(len(steps))]
    use = [min(w, count[i]) for i, w in enumerate(wanted)]  # candidates that a step can use
    share = [min(1.0, (w + 6 * w ** 0.5 + 10) / max(1, count[i])) for i, w in enumerate(use)]
    while True:
        limits = dims.literal(pool.sparkSession, [
            (m, float(max(share[i] for i in range(len(steps)) if m >> i & 1))) for m in patterns], "may int, most double")
        near = p.join(F.broadcast(limits), "may").filter(F.col("u") <= F.col("most"))
        rows = sorted((r["u"], r[key], r["may"]) for r in near.select("u", key, "may").collect())
        short = [i for i, w in enumerate(use) if sum(1 for x, _, may in rows if may >> i & 1 and x <= share[i]) < w]
        if not short:
            break
        share = [min(1.0, s * 2) if i in short else s for i, s in enumerate(share)]
    taken: set = set()
    picked = []
    for i, (_, _, n, label) in enumerate(steps):
        room = n if i < len(steps) - 1 else size - len(taken)
        chosen = [k for _, k, may in rows if may >> i & 1 and k not in taken][:max(0, room)]
        taken.update(chosen)
        picked += [(k, i + 1, label, j + 1) for j, k in enumerate(chosen)]
    kind = pool.schema[key].dataType.simpleString()
    return pool.sparkSession.createDataFrame(picked, f"{key} {kind}, step int, label string, pick_no int")


def _quota_steps(quotas: list[tuple] | None, target_no_flag: int, size: int) -> tuple[list[tuple], list[int]]:
    """(column, value, rows, label) of each step, the fill last, and how many candidates each may need."""
    quotas = dims.QUOTAS if quotas is None else quotas
    steps = [(flag, "Yes", n, flag) for _, flag, n in quotas]
    steps += [("flag_present", "No", target_no_flag, "no_flag"), (None, None, size, "fill")]
    wanted = [sum(n for _, _, n, _ in steps[:i + 1]) for i in range(len(steps) - 1)] + [size]
    return steps, wanted


def quota_shortfall(sample: DataFrame, quotas: list[tuple] | None = None,
                    target_no_flag: int = dims.TARGET_NO_FLAG, size: int = dims.SAMPLE_SIZE) -> dict[str, int]:
    """Rows that each step of a quota sample lacks, and under ``total`` those the whole sample lacks."""
    steps, _ = _quota_steps(quotas, target_no_flag, size)
    got = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = {label: n - got.get(label, 0) for _, _, n, label in steps[:-1] if n > got.get(label, 0)}
    return out | ({"total": size - sum(got.values())} if size > sum(got.values()) else {})


def exact_split(df: DataFrame, by: list[str], test_pct: int = 20, key: str = "patient_id",
                salt: str = "split") -> DataFrame:
    """Exact per-group train/test split (I2): the ceil(test_pct% · n) rows
    with the smallest hash draw in each group are 'test'.

    Ranks come from the two-level scan over hash blocks, so a group holding
    a third of the data is still spread over many tasks.
    """
    d = df.withColumn("u", u(key, salt))
    ranked = running_totals(d, by, None, {"_rank": F.lit(1).cast("long")}, block=F.floor(F.col("u") * 65536),
                            order=[F.col("u"), F.col(key)], totals={"_rank": "_n"})
    test_n = F.floor((F.col("_n") * test_pct + 99) / 100)
    return ranked.withColumn("split", F.when(F.col("_rank") <= test_n, "test").otherwise("train")).drop("_rank", "_n")


def fetch_in_order(sample: DataFrame, rows: DataFrame, key: str = "patient_id") -> DataFrame:
    """Rows of the sampled keys with the sample's order columns."""
    return rows.join(sample, key, "inner")


def remaining(pool: DataFrame, sample: DataFrame, key: str = "patient_id") -> DataFrame:
    """Pool minus the sampled keys (D4/H2); the sample side is size-bounded."""
    return pool.join(F.broadcast(sample.select(key)), key, "left_anti")
