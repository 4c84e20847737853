"""Eligible starts of every request under a policy's rules (D7, L3, L4), without a row for each request and slot.

A request may start at any quarter-hour of any scanner on any open day of the
horizon from its request date on. The rules look at weekday, scanner and time of
day only, so a request's count is a product:

1. per profile (what the rules read of a request, and its duration), the
   starts that pass on each weekday, tested on the cells of one week;
2. per day of the horizon, how many open days of each weekday lie from that day
   to the end, and which comes first: suffix sums over the calendar, holidays
   left out;
3. requests are joined as-of to the calendar (their date, or the first day of the
   horizon if that is later) and to their profile, and sum up over weekdays.

The calendar has as many rows as the horizon has days. Profiles are grouped before
the cells are tested; their table is joined back by the planner's choice.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apptflow.operators.generation import SLOT_MINUTES, calendar, day_range
from apptflow.sources import dims

#: starts of a scanner-day, 08:00 to 20:00
STARTS = 12 * 60 // SLOT_MINUTES

Rule = Callable[[Column, Column, Column], Column]


def week_cells() -> Column:
    """All (weekday, scanner, start) cells as one compact expression
    (a literal array this size would exceed the JVM method limit in codegen)."""
    ids = F.array(*[F.lit(sc) for sc, _, _, _, _ in dims.SCANNERS])
    n_sc = len(dims.SCANNERS)
    return F.transform(F.sequence(F.lit(0), F.lit(7 * n_sc * STARTS - 1)), lambda i: F.struct(
        F.floor(i / (n_sc * STARTS)).cast("int").alias("weekday"),
        F.element_at(ids, (F.floor(i / STARTS) % n_sc + 1).cast("int")).alias("scanner"),
        ((i % STARTS) * SLOT_MINUTES).cast("int").alias("start")))


def passing_cells(rule: Rule) -> Column:
    """The cells that ``rule(weekday, scanner, start)`` lets pass."""
    return F.filter(week_cells(), lambda c: rule(c["weekday"], c["scanner"], c["start"]))


def weekday_starts(profiles: DataFrame, rule: Rule) -> DataFrame:
    """Add ``starts``: how many cells of each weekday (0: Monday) pass."""
    d = profiles.withColumn("_cells", passing_cells(rule))
    starts = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda w: F.size(
        F.filter("_cells", lambda c: c["weekday"] == w)).cast("long"))
    return d.withColumn("starts", starts).drop("_cells")


def open_days_from(spark: SparkSession, first: str, last: str) -> DataFrame:
    """day, days, next_days: for every day of the horizon, the open days of each weekday from it to ``last`` and the
    first of them. The window is over the horizon's days."""
    days = spark.range(1).select(day_range(F.lit(first).cast("date"), F.lit(last).cast("date")).alias("day"))
    d = calendar(days).select("day", F.weekday("day").alias("weekday"), (~F.col("is_holiday")).alias("is_open"))
    onwards = Window.orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = [F.col("is_open") & (F.col("weekday") == w) for w in range(7)]
    return d.select("day", F.array(*[F.count(F.when(c, 1)).over(onwards) for c in here]).alias("days"),
                    F.array(*[F.min(F.when(c, F.col("day"))).over(onwards) for c in here]).alias("next_days"))


def eligible_starts(requests: DataFrame, policies: dict[str, tuple[list[str], Rule]], first: str, last: str,
                    keep: list[str], profiles_of: DataFrame | None = None, date_col: str = "request_date") -> DataFrame:
    """policy, ``keep``, n_starts, n_days, first_day for every request and policy: eligible (date, scanner,
    quarter-hour) starts from the request's date on, the days that have one, and the first such day (null: none).

    ``policies``: for each name what its rule reads of a request, and the rule. ``profiles_of``: a cheaper table with the
    same profiles. A null date, or one after ``last``, has none.
    """
    d = requests
    for name, (cols, rule) in policies.items():
        profiles = weekday_starts((requests if profiles_of is None else profiles_of).select(*cols).distinct(), rule)
        profiles = profiles.select(*[F.col(c).alias(f"_{name}_{c}") for c in cols], F.col("starts").alias(f"_{name}"))
        same = [d[c].eqNullSafe(profiles[f"_{name}_{c}"]) for c in cols]
        d = d.join(profiles, same, "left").drop(*[f"_{name}_{c}" for c in cols])
    as_of = F.when(F.col(date_col).isNotNull(), F.greatest(F.col(date_col), F.lit(first).cast("date")))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), F.col(f"_{n}").alias("starts")) for n in policies]))
    d = d.select(*keep, as_of.alias("_day"), each.alias("_p")).select(*keep, "_day", "_p.*")
    calendar_ = open_days_from(requests.sparkSession, first, last)
    d = d.join(F.broadcast(calendar_), F.col("_day") == F.col("day"), "left")  # a row for each day of the horizon

    def total(weight: Callable[[Column], Column]) -> Column:
        products = [weight(F.col("starts")[w]) * F.col("days")[w] for w in range(7)]
        return F.coalesce(sum(products[1:], products[0]), F.lit(0).cast("long"))

    days = [F.when(F.col("starts")[w] > 0, F.col("next_days")[w]) for w in range(7)]
    return d.select("policy", *keep, total(lambda s: s).alias("n_starts"),
                    total(lambda s: F.when(s > 0, 1).otherwise(0).cast("long")).alias("n_days"),
                    F.least(*days).alias("first_day"))
