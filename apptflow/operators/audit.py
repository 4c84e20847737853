"""Booking rules as table checks.

Every window here is partitioned by a scanner-day or a site-day, whose row
count is bounded by the opening hours (at most ~25 scans), never by the
data size.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apptflow.sources import dims
from apptflow.sources.dims import (COMPLEX_WORDS, LAST_COMPLEX_START, MAX_FLAG_STREAK, MAX_HOISTS, MAX_SEDATION_STREAK,
                                   MAX_TRANSPORTS_PER_DAY, SCANNER2_BARRED_WORDS, WEEKEND_BARRED_WORDS)


def any_word(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def averages_rules(reason: Column, scanner: Column, weekday: Column, start: Column, end: Column,
                   transport_end: str = "compat") -> Column:
    """True when a (request, slot) pair passes the averages-policy rules (L3).

    ``start``/``end`` are minutes after 08:00. ``transport_end='compat'``
    keeps the rule as written (an end at 18:00 passes); 'strict' means
    end <= 17:00.
    """
    hour = F.floor((start + 480) / 60)
    end_hour = F.floor((end + 480) / 60)
    end_minute = (end + 480) % 60
    weekend = weekday >= 5
    ok = end <= 720
    ok = ok & ~(any_word(reason, COMPLEX_WORDS) & (start > LAST_COMPLEX_START))
    ok = ok & ~(weekend & any_word(reason, WEEKEND_BARRED_WORDS))
    ok = ok & ~(reason.contains("Hoist") & (hour >= 12) & (hour < 14))
    if transport_end == "compat":
        late = (end_hour >= 17) & (end_minute > 0)
    else:
        late = end > 17 * 60 - 480
    ok = ok & ~(reason.contains("Hospital") & ((hour < 9) | late))
    ok = ok & ~(any_word(reason, ["Sedation", "Claustro"]) & (scanner == 3))
    ok = ok & ~((scanner == 2) & any_word(reason, SCANNER2_BARRED_WORDS))
    ok = ok & ~((scanner == 4) & (reason.contains("Hospital") | ((weekday == 2) & (hour >= 13))))
    return ok


def model_hard_rules(hoist: Column, sedation: Column, transport: Column, cls: Column, scanner: Column,
                     weekday: Column, start: Column, end: Column) -> Column:
    """True when a (request, slot) pair passes the model policy's hard rules (L4)."""
    hour = F.floor((start + 480) / 60)
    weekend = weekday >= 5
    class3 = cls == "Class 3"
    ok = end <= 720
    ok = ok & ~(weekend & (class3 | hoist | sedation | transport))
    ok = ok & ~(sedation & (scanner == 3))
    ok = ok & ~((scanner == 2) & hoist)
    ok = ok & ~((hoist | transport | sedation | class3) & (hour >= 17))
    ok = ok & ~((scanner == 4) & (weekday == 2) & (hour >= 13))
    return ok


def soft_rule_breaks(flagged: Column, start: Column, end: Column) -> dict[str, Column]:
    """Model-policy soft rules (L5), per booked row."""
    return {"flag_at_open": flagged & (start <= 10), "flag_at_close": flagged & (end >= 720)}


def streaks(sched: DataFrame, flag: Column, part: list[str], order: str = "start_min", name: str = "streak") -> DataFrame:
    """Length of the run of consecutive flagged rows ending at each row.

    Gaps-and-islands in one ordering: the run length is the row's position
    minus the position of the last unflagged row before it. Both windows
    share the partitioning and sort, so there is no second exchange.
    """
    w = Window.partitionBy(*part).orderBy(order)
    d = sched.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_n", F.row_number().over(w))
    last_break = F.max(F.when(~F.col("_f"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    run = F.col("_n") - F.coalesce(last_break, F.lit(0))
    return d.withColumn(name, F.when(F.col("_f"), run).otherwise(F.lit(0)).cast("long")).drop("_f", "_n")


def running_count(sched: DataFrame, flag: Column, part: list[str], order: str, name: str) -> DataFrame:
    """Running number of flagged rows so far in the partition (L6 caps)."""
    w = Window.partitionBy(*part).orderBy(order, "patient_id").rowsBetween(Window.unboundedPreceding, 0)
    return sched.withColumn(name, F.sum(flag.cast("int")).over(w))


def schedule_audit(sched: DataFrame, gap: int = dims.CHANGEOVER_MINUTES) -> DataFrame:
    """One row per booking rule with its number of violating rows.

    ``sched`` has site, date, scanner, patient_id, reason_text, start_min,
    end_min. Policy rules the schedule was not built with simply report
    their violations.
    """
    sd = ["site", "date", "scanner"]
    r = F.col("reason_text")
    wd = F.weekday("date")
    # site-day window first: its hash partitioning also satisfies every
    # scanner-day window after it, so they share one exchange
    s = running_count(sched, r.contains("Hospital"), ["site", "date"], "start_min", "transports")
    s = running_count(s, r.contains("Hoist"), sd, "start_min", "hoists")
    s = streaks(s, any_word(r, ["Sedation", "Claustro"]), sd, name="sed_streak")
    s = streaks(s, r != "None", sd, name="flag_streak")
    nxt = F.lead("start_min").over(Window.partitionBy(*sd).orderBy("start_min", "patient_id"))
    s = s.withColumn("next_start", nxt)
    dup = Window.partitionBy("patient_id")
    s = s.withColumn("n_patient", F.count(F.lit(1)).over(dup))
    checks = {
        "opening_hours": (F.col("start_min") < 0) | (F.col("end_min") > 720),
        "closure": (F.col("scanner") == 4) & (wd == 2) & (F.col("start_min") < 540) & (F.col("end_min") > 300),
        "overlap": F.col("next_start") < F.col("end_min") + gap,
        "duplicate_patient": F.col("n_patient") > 1,
        "weekend_barred": (wd >= 5) & any_word(r, WEEKEND_BARRED_WORDS),
        "late_complex_start": any_word(r, COMPLEX_WORDS) & (F.col("start_min") > LAST_COMPLEX_START),
        "hoist_lunch": r.contains("Hoist") & (F.col("start_min") >= 240) & (F.col("start_min") < 360),
        "sedation_scanner_3": any_word(r, ["Sedation", "Claustro"]) & (F.col("scanner") == 3),
        "mobility_scanner_2": (F.col("scanner") == 2) & any_word(r, SCANNER2_BARRED_WORDS),
        "transport_scanner_4": (F.col("scanner") == 4) & r.contains("Hospital"),
        "hoist_cap": r.contains("Hoist") & (F.col("hoists") > MAX_HOISTS),
        "transport_cap": r.contains("Hospital") & (F.col("transports") > MAX_TRANSPORTS_PER_DAY),
        "sedation_streak": F.col("sed_streak") > MAX_SEDATION_STREAK,
        "flag_streak": F.col("flag_streak") > MAX_FLAG_STREAK,
    }
    counts = s.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()])
    arr = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in checks])
    return counts.select(F.explode(arr).alias("x")).select("x.rule", "x.violations")
