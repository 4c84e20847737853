"""FCFS packing against a brute-force head-of-line loop, and audit properties."""
import random

import pytest
from pyspark.sql import functions as F

from apptflow.operators import audit as au
from apptflow.operators import booking as bk
from apptflow.sources import dims


def loop_reference(queue, template, gap=5):
    """Plain sequential FCFS: head item must fit, else move to the next segment."""
    out, j = [], 0
    for shift_no, date, scanner, open_m, close_m in template:
        cur = open_m
        while j < len(queue) and cur + queue[j] <= close_m:
            out.append((j, shift_no, cur))
            cur += queue[j] + gap
            j += 1
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fcfs_matches_loop(spark, seed):
    rnd = random.Random(seed)
    template = bk.shift_template("2025-01-06", "2025-01-10")  # includes a Wednesday closure
    rows = []
    for site in range(3):
        n = rnd.randint(20, 260)
        durs = [rnd.choice([30, 45, 60, 5, 299]) for _ in range(n)]
        ref = loop_reference(durs, template)
        rows.append((site, durs, ref))
    data = [(s, i, s * 1000 + i, d) for s, durs, _ in rows for i, d in enumerate(durs)]
    q = spark.createDataFrame(data, "site int, row_index long, patient_id long, duration int")
    got = bk.fcfs_schedule(spark, q, template).select("site", "row_index", "shift_no", "start_min").collect()
    got = sorted((r["site"], r["row_index"], r["shift_no"], r["start_min"]) for r in got)
    want = sorted((s, j, sh, st) for s, _, ref in rows for j, sh, st in ref)
    assert got == want


def test_shift_template_closure():
    t = bk.shift_template("2025-01-08", "2025-01-08")  # a Wednesday
    s4 = [(o, c) for _, _, sc, o, c in t if sc == 4]
    assert s4 == [(0, 300), (540, 720)]
    assert len(t) == 5


def test_audit_on_fcfs_has_no_structural_violations(spark, sf_small):
    from apptflow.plans.q_booking import fcfs
    audit = {r["rule"]: r["violations"] for r in au.schedule_audit(fcfs(spark, sf_small)).collect()}
    for rule in ("opening_hours", "closure", "overlap", "duplicate_patient"):
        assert audit[rule] == 0, rule


def test_streaks_gaps_and_islands(spark):
    rows = [(1, t * 60, f) for t, f in enumerate([1, 1, 0, 1, 1, 1, 0])]
    df = spark.createDataFrame(rows, "k int, start_min int, f int")
    got = [r["streak"] for r in au.streaks(df, F.col("f") == 1, ["k"]).orderBy("start_min").collect()]
    assert got == [1, 2, 0, 1, 2, 3, 0]


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_every_request_has_a_status(spark, sf):
    from apptflow.plans.registry import queries
    from apptflow.sources import adapters
    d = f"/root/testdata/sf{sf}"
    got = queries()["fcfs_schedule"](spark, d).groupBy("status").count().collect()
    counts = {r["status"]: r["count"] for r in got}
    assert sum(counts.values()) == adapters.orders_with_site(spark, d).count()
    assert counts["placed"] > 0 and (sf == "0.01" or counts["unplaced"] > 0)


def test_too_long_request_blocks_its_queue(spark):
    template = bk.shift_template("2025-01-06", "2025-01-06")
    q = spark.createDataFrame([(1, 0, 10, 30), (1, 1, 11, 900), (1, 2, 12, 30)],
                              "site int, row_index long, patient_id long, duration int")
    out = bk.with_status(q, bk.fcfs_schedule(spark, q, template), template).orderBy("row_index").collect()
    assert [(r["status"], r["reason"]) for r in out] == [
        ("placed", None), ("unplaced", bk.TOO_LONG), ("unplaced", bk.NO_ROOM)]


def test_timeline_colours(spark):
    """Substring and exact match differ where a keyword is only part of the first flag; null is the other colour."""
    d = spark.createDataFrame([(1, "Hospital Transport"), (2, "Transport,Hoist"), (3, "None"), (4, None), (5, "")], "id int, r string")
    got = {r["id"]: (r["a"], r["b"]) for r in d.select(
        "id", bk.timeline_colour(F.col("r")).alias("a"), bk.timeline_colour(F.col("r"), "exact").alias("b")).collect()}
    other = dims.OTHER_COLOUR
    assert got == {1: ("#ff9933", other), 2: ("#ff4d4d", "#ff9933"), 3: ("#99ff99", "#99ff99"), 4: (other, other), 5: (other, other)}
    with pytest.raises(ValueError):
        bk.timeline_colour(F.col("r"), "prefix")


def test_legend_in_first_seen_order(spark):
    assert [label for _, label, _ in bk.legend()] == [
        "Hoist", "Transport", "Wheelchair", "Sedation / Claustrophobia", "Interpreter", "None", "Other"]
    blocks = spark.createDataFrame([(1, "#cc99ff"), (1, "#cc99ff"), (1, dims.OTHER_COLOUR), (2, None)], "site int, colour string")
    got = {(r["site"], r["position"]): r["n_blocks"] for r in bk.legend_counts(blocks).collect()}
    assert len(got) == 14 and {k: n for k, n in got.items() if n} == {(1, 4): 2, (1, 7): 1}
    assert bk.legend_counts(blocks.limit(0)).count() == 0


def test_shift_rows_do_not_carry_the_candidates(spark):
    queue = spark.createDataFrame([(1, i, i, 30 + i % 7) for i in range(60)], "site int, row_index long, patient_id long, duration int")
    placed = bk.fcfs_schedule(spark, queue, bk.shift_template("2025-01-06", "2025-01-07"))
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" not in plan  # a window over the exploded shifts held each site's candidates once per shift
    exploded = [line for line in plan.splitlines() if "Generate posexplode" in line]
    assert exploded and placed.count() > 0
    assert all("pt" not in [c.split("#")[0] for c in line.replace("[", " ").replace("]", " ").replace(",", " ").split()] for line in exploded)
