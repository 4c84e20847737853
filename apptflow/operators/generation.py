"""Set-based table generation (B1, B2, B5, B8, D8) [re-aimed from loops]."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apptflow.sources import dims

from apptflow.functions.draws import u

# Opening hours by day kind: (kind, first hour, end hour). Fixed values; the
# compat variant reproduces the reference's weekday typo (opens at 09:00).
HOURS = [("weekday", 8, 20), ("weekend", 9, 17), ("holiday", 9, 17)]
HOURS_COMPAT = [("weekday", 9, 20), ("weekend", 9, 17), ("holiday", 9, 17)]
# Fixed-date holidays (month, day) applied to every year of the range.
FIXED_HOLIDAYS = [(1, 1), (12, 25), (12, 26)]
SLOT_MINUTES = 15


def day_range(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(first, last, F.expr("INTERVAL 1 DAY")))


def calendar(dates: DataFrame, date_col: str = "day") -> DataFrame:
    """Tag each day weekday/weekend/holiday.

    Holidays come from a rule (fixed month/day pairs), giving a holiday
    dimension of at most 3 rows per year; membership is a broadcast
    left join on the date.
    """
    days = dates.select(F.col(date_col).alias("day"))
    rule = None
    for m, d in FIXED_HOLIDAYS:
        c = (F.month("day") == m) & (F.dayofmonth("day") == d)
        rule = c if rule is None else (rule | c)
    holidays = days.filter(rule).select(F.col("day").alias("holiday_date"))
    j = days.join(F.broadcast(holidays), days.day == holidays.holiday_date, "left")
    kind = (F.when(F.col("holiday_date").isNotNull(), "holiday")
            .when(F.weekday("day") >= 5, "weekend").otherwise("weekday"))
    return j.select("day", kind.alias("kind"), F.col("holiday_date").isNotNull().alias("is_holiday"))


def slot_grid(cal: DataFrame, hours: list[tuple] | None = None) -> DataFrame:
    """Every 15-minute slot of every open hour of every day (B1)."""
    hours = HOURS if hours is None else hours
    spark: SparkSession = cal.sparkSession
    h = dims.literal(spark, hours, "kind string, first_hour int, end_hour int")
    j = cal.join(F.broadcast(h), "kind")
    start = F.timestamp_add("HOUR", F.col("first_hour"), F.col("day").cast("timestamp_ntz"))
    last = F.timestamp_add("MINUTE", F.col("end_hour") * 60 - SLOT_MINUTES, F.col("day").cast("timestamp_ntz"))
    return j.select("day", "kind", F.explode(F.sequence(start, last, F.expr(f"INTERVAL {SLOT_MINUTES} MINUTES")))
                    .alias("slot"))


def sample_slots(grid: DataFrame, n: int, salt: str = "slot_pick") -> DataFrame:
    """n slots without replacement, then in time order (B2).

    ``orderBy(...).limit(n)`` plans as a distributed top-k (each partition
    keeps n rows). Raises if the grid has fewer than n slots, like the
    reference's capacity check.
    """
    key = F.date_format("slot", "yyyy-MM-dd HH:mm")
    top = grid.withColumn("u", u(key, salt)).orderBy("u", "slot").limit(n)
    have = top.count()
    if have < n:
        raise ValueError(f"{n} slots asked for, the grid has {have}")
    w = Window.orderBy("slot")  # n rows only: bounded by the sample size
    return top.select("slot", F.row_number().over(w).alias("slot_no"))


def range_bucket_join(facts: DataFrame, draw: str, dim: DataFrame, lo: str, hi: str,
                      keys: list[str] | None = None, buckets: int = 100) -> DataFrame:
    """Join each fact to the dim row with ``lo <= draw < hi``.

    The dim's intervals are exploded over the fixed buckets they cover so
    the join has an equi key (keys + bucket) and plans as a broadcast hash
    join, never an unkeyed nested loop. The dim is a bounded dimension.
    """
    keys = keys or []
    b = "_bucket"
    d = dim.withColumn(b, F.explode(F.sequence(F.floor(F.col(lo) * buckets).cast("int"),
                                               F.least(F.ceil(F.col(hi) * buckets).cast("int"), F.lit(buckets - 1)))))
    f = facts.withColumn(b, F.floor(F.col(draw) * buckets).cast("int"))
    cond = [f[k] == d[k] for k in keys] + [f[b] == d[b], f[draw] >= d[lo], f[draw] < d[hi]]
    return f.join(F.broadcast(d), cond, "inner").drop(d[b]).drop(f[b]).drop(*[d[k] for k in keys])


def cumulative(dim: DataFrame, weight: str, order: str, keys: list[str] | None = None) -> DataFrame:
    """Normalised cumulative bounds (lo, hi) of a weight column, per key."""
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy(order)  # dimension-sized partitions
    tot = Window.partitionBy(*keys)
    run = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(weight).over(tot)
    last = F.row_number().over(w.orderBy(F.desc(order))) == 1
    with_hi = dim.select("*", F.when(last, F.lit(1.0000001)).otherwise(run / total).alias("hi"))
    # lo = the previous row's hi, so the intervals tile [0, 1) without gaps or overlaps
    return with_hi.withColumn("lo", F.coalesce(F.lag("hi").over(w), F.lit(0.0)))
