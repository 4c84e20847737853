"""Shift grids and first-come-first-served packing (L1, L2, L10) [re-aimed].

The reference books one queue with a clock loop. FCFS packing has an exact
set-based form. Per site, in queue order, let

    e_j = Σ_{k<=j} (d_k + gap) - gap

be the end of item j if every item were packed back to back. A shift of
capacity c that starts right after item i takes exactly the items with
e_i < e_j <= e_i + c + gap (the head must fit; strict order). So the whole
schedule is determined by the shift boundaries E_s in e-space:

    E_0 = -gap,  E_s = max{e_j : e_j <= E_{s-1} + c_s + gap}  (or E_{s-1})

1. ``e_j``: ordered running sum via the two-level scan (no whole-site task).
2. Only items with e_j <= H, H = Σ_s (c_s + gap) - gap, can ever be placed,
   so each site's candidate list is bounded by the booking horizon, not by
   the data. A RANGE-frame count gives, per candidate, how many items a
   shift of each capacity would take after it; the fold over the shifts is
   then one array lookup per shift.
3. Each shift's item positions are exploded and equi-joined back on
   (site, row_index); start = open_s + e_j - d_j - (E_{s-1} + gap).
Items beyond the horizon are unplaced, exactly as the reference stops at
its end date; ``with_status`` returns them too, with the reason.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apptflow.operators.scan import running_totals
from apptflow.session import cut_lineage
from apptflow.sources import dims

DAY_OPEN = 8 * 60   # minutes of day when scanners open (08:00)


def shift_template(start: str = dims.BOOKING_START, end: str = dims.BOOKING_END,
                   scanners: list[tuple] | None = None, closures: list[tuple] | None = None) -> list[tuple]:
    """Ordered shift segments of the horizon (L1), from fixed parameters.

    Returns (shift_no, date, scanner, open_min, close_min) with minutes
    counted from 08:00, in booking order: date, scanner, segment. A closure
    splits a scanner-day into the parts before and after it.
    """
    scanners = dims.SCANNERS if scanners is None else scanners
    closures = dims.CLOSURES if closures is None else closures
    d0, d1 = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    out, n, d = [], 0, d0
    while d <= d1:
        for sc, _, _, oh, ch in scanners:
            segs = [((oh * 60) - DAY_OPEN, (ch * 60) - DAY_OPEN)]
            for csc, wd, fh, th in closures:
                if csc == sc and d.weekday() == wd:
                    cut_a, cut_b = fh * 60 - DAY_OPEN, th * 60 - DAY_OPEN
                    segs = [s for seg in segs for s in ((seg[0], min(seg[1], cut_a)), (max(seg[0], cut_b), seg[1]))
                            if s[1] > s[0]]
            for o, c in segs:
                out.append((n, d, sc, o, c))
                n += 1
        d += dt.timedelta(days=1)
    return out


def shift_grid(spark: SparkSession, sites: DataFrame, start: str = dims.BOOKING_START,
               end: str = dims.BOOKING_END) -> DataFrame:
    """site x date x scanner x segment (L1), generated per site (no join).

    Scanner hours come from the scanner dimension; a closure splits its
    scanner-day into the segments before and after it.
    """
    days = sites.select("site", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    sc = F.array(*[F.struct(F.lit(s).alias("scanner"), F.lit(oh * 60 - DAY_OPEN).alias("o"),
                            F.lit(ch * 60 - DAY_OPEN).alias("c")) for s, _, _, oh, ch in dims.SCANNERS])
    g = days.select("site", "date", F.explode(sc).alias("s")).select("site", "date", "s.*")
    closed = None
    for csc, wd, fh, th in dims.CLOSURES:
        cond = (F.col("scanner") == csc) & (F.weekday("date") == wd)
        cut = F.array(F.struct(F.col("o").alias("open_min"), F.least(F.col("c"), F.lit(fh * 60 - DAY_OPEN)).alias("close_min")),
                      F.struct(F.greatest(F.col("o"), F.lit(th * 60 - DAY_OPEN)).alias("open_min"), F.col("c").alias("close_min")))
        closed = F.when(cond, cut) if closed is None else closed.when(cond, cut)
    whole = F.array(F.struct(F.col("o").alias("open_min"), F.col("c").alias("close_min")))
    segs = whole if closed is None else closed.otherwise(whole)
    out = g.select("site", "date", "scanner", F.explode(segs).alias("seg")).select("site", "date", "scanner", "seg.*")
    return out.filter(F.col("close_min") > F.col("open_min"))


def fcfs_schedule(spark: SparkSession, queue: DataFrame, template: list[tuple] | None = None,
                  gap: int = dims.CHANGEOVER_MINUTES, block_size: int = 1 << 16,
                  e_col: str | None = None) -> DataFrame:
    """Exact FCFS packing of ``queue`` (site, row_index, patient_id, duration, ...).

    ``row_index`` is the 0-based queue position within the site. Returns the
    queue rows that were placed, with shift_no, date, scanner, start_min and
    end_min (minutes after 08:00). ``e_col`` names a precomputed inclusive
    running sum of ``duration + gap`` in queue order (saves a scan when the
    caller already ran one for ``row_index``).
    """
    template = shift_template() if template is None else template
    caps = [c - o for _, _, _, o, c in template]
    distinct_caps = sorted(set(caps))
    horizon = sum(c + gap for c in caps) - gap
    if e_col is None:
        q = running_totals(queue, ["site"], "row_index", {"e": (F.col("duration") + gap).cast("long")},
                           block_size=block_size).withColumn("e", F.col("e") - gap)
    else:
        q = queue.withColumn("e", F.col(e_col) - gap).drop(e_col)
    # Candidates are bounded by the horizon, not the data: materialise them
    # once (reliable checkpoint in the shared directory) because the fold,
    # the pointer windows and the final join all read them.
    cand = cut_lineage(q.filter(F.col("e") <= horizon))
    # Per candidate position p (0 = the start sentinel at e = -gap): how many
    # items a shift of capacity c takes when it starts right after p, i.e.
    # the items with e in (e_p, e_p + c + gap]. RANGE frames over the
    # site's candidates, whose number is bounded by the horizon.
    pts = cand.select("site", (F.col("row_index") + 1).alias("pos"), "e")
    sentinel = cand.select("site").distinct().select("site", F.lit(0).cast("long").alias("pos"),
                                                     F.lit(-gap).cast("long").alias("e"))
    pts = pts.unionByName(sentinel)
    w = Window.partitionBy("site").orderBy("e")
    takes = {f"t{c}": F.count(F.lit(1)).over(w.rangeBetween(1, c + gap)) for c in distinct_caps}
    pts = pts.withColumns(takes)
    per_site = pts.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("pos", "e", *takes))).alias("pt"))
    # fold the shifts: p_s = p_{s-1} + take_{c_s}(p_{s-1}); one O(1) lookup per shift
    cap_arr = F.array(*[F.lit(distinct_caps.index(c)) for c in caps])
    bound = "array<struct<p_lo:bigint,p_hi:bigint,e_lo:bigint>>"
    init = F.struct(F.lit(0).cast("long").alias("p"), F.array().cast(bound).alias("b"))

    def step(acc, ci):
        row = F.element_at(F.col("pt"), (acc["p"] + 1).cast("int"))
        take = F.element_at(F.array(*[row[f"t{c}"] for c in distinct_caps]), ci + 1)
        p_new = acc["p"] + take
        shift = F.struct(acc["p"].alias("p_lo"), p_new.alias("p_hi"), row["e"].alias("e_lo"))
        return F.struct(p_new.alias("p"), F.concat(acc["b"], F.array(shift)).alias("b"))

    # a row per shift has its bounds only, never the site's candidates
    bounds = per_site.select("site", F.aggregate(cap_arr, init, step)["b"].alias("b"))
    shifts = bounds.select("site", F.posexplode("b").alias("shift_no", "bound")).select("site", "shift_no", "bound.*")
    shifts = shifts.filter(F.col("p_hi") > F.col("p_lo")).select(
        "site", "shift_no", "p_lo", "e_lo", F.explode(F.sequence(F.col("p_lo"), F.col("p_hi") - 1)).alias("row_index"))
    t = dims.literal(spark, template, "shift_no int, date date, scanner int, open_min int, close_min int")
    placed = shifts.join(F.broadcast(t), "shift_no").join(cand, ["site", "row_index"])
    start = F.col("open_min") + F.col("e") - F.col("duration") - (F.col("e_lo") + gap)
    return (placed.withColumn("start_min", start.cast("int"))
            .withColumn("end_min", (F.col("start_min") + F.col("duration")).cast("int"))
            .drop("e_lo", "e", "open_min", "close_min"))


#: why a request has no slot
TOO_LONG, NO_ROOM = "longer than any shift", "no room before the end date"


def with_status(queue: DataFrame, placed: DataFrame, template: list[tuple] | None = None) -> DataFrame:
    """Every request of ``queue`` with its slot or, if it got none, the reason (L2).

    ``placed`` is what ``fcfs_schedule`` returned for the queue. One request
    longer than any shift blocks its queue, as the head must fit.
    """
    longest = max(c - o for _, _, _, o, c in (shift_template() if template is None else template))
    slot = placed.select("site", "row_index", "shift_no", "date", "scanner", "start_min", "end_min")
    d = queue.join(slot, ["site", "row_index"], "left")
    is_placed = F.col("shift_no").isNotNull()
    return d.withColumns({
        "status": F.when(is_placed, "placed").otherwise("unplaced"),
        "reason": F.when(is_placed, F.lit(None).cast("string")).when(F.col("duration") > longest, TOO_LONG).otherwise(NO_ROOM)})


def clock_text(date: Column, minutes: Column, fmt: str) -> Column:
    """Format date + 08:00 + minutes (C14)."""
    ts = F.timestamp_add("MINUTE", minutes + DAY_OPEN, date.cast("timestamp_ntz"))
    return F.date_format(ts, fmt)


def first_flag(reason: Column) -> Column:
    return F.split_part(reason, F.lit(","), F.lit(1))


def timeline_colour(reason: Column, match: str = "contains") -> Column:
    """Colour of a booked row (L12): of the first keyword that the reasons contain, or with ``match='exact'`` of the
    keyword that the first flag is (T27). Null reasons and those without a keyword get the other colour."""
    if match == "contains":
        tests = [(reason.contains(k), c) for _, k, c in dims.COLOURS]
    elif match == "exact":
        tests = [(first_flag(reason) == k, c) for k, c in dims.EXACT_COLOURS]
    else:
        raise ValueError(f"match must be 'contains' or 'exact', not {match!r}")
    colour = F.lit(dims.OTHER_COLOUR)
    for test, c in reversed(tests):
        colour = F.when(test, c).otherwise(colour)
    return colour


def legend() -> list[tuple[int, str, str]]:
    """(position, label, colour) of the timeline's legend: each colour once, in first-seen order, the other one last."""
    labels: dict[str, str] = {}
    for _, k, c in sorted(dims.COLOURS):
        labels.setdefault(c, dims.LEGEND_LABELS.get(k, k))
    labels[dims.OTHER_COLOUR] = dims.OTHER_LABEL
    return [(i + 1, label, c) for i, (c, label) in enumerate(labels.items())]


def legend_counts(blocks: DataFrame, by: str = "site") -> DataFrame:
    """Blocks of every legend entry per ``by``, entries without blocks too: one aggregate, no join.

    ``blocks`` has ``by`` and ``colour``; an empty table gives no rows.
    """
    entries = legend()
    counts = blocks.groupBy(by).agg(*[F.count_if(F.col("colour") == c).alias(f"n{i}") for i, _, c in entries])
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("position"), F.lit(label).alias("label"),
                              F.lit(c).alias("colour"), F.col(f"n{i}").alias("n_blocks")) for i, label, c in entries])
    return counts.select(by, F.explode(rows).alias("x")).select(by, "x.*")
