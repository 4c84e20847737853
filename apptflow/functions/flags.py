"""Flag, band and text expressions (C4-C21, E6, K-policy helpers).

Each builder returns a ``Column``; nothing here leaves the JVM.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptflow.sources import dims

__all__ = [
    "yes_no", "is_yes", "normalise_flag", "reason_flags", "contrast_from_scan",
    "delay_band", "delay_band_report", "flag_present", "reason_text",
    "short_flag_text", "complexity", "pct_text", "outcome_group", "clip_zero",
    "hhmm_to_minutes", "clean_feature_name", "is_priority", "ensure_columns",
    "pad_id", "rule_minutes_expr", "ratio_round",
]


def yes_no(cond: Column) -> Column:
    """Boolean -> 'Yes'/'No'; null counts as No (null-safe, trap T5)."""
    return F.when(F.coalesce(cond, F.lit(False)), F.lit("Yes")).otherwise(F.lit("No"))


def is_yes(col: Column | str, truthy: list[str] | None = None) -> Column:
    """Truthiness test over a configurable spelling set (C10, trap T29)."""
    col = F.col(col) if isinstance(col, str) else col
    truthy = dims.TRUTHY if truthy is None else truthy
    return F.coalesce(F.lower(F.trim(col.cast("string"))).isin(*truthy), F.lit(False))


def normalise_flag(col: Column | str, truthy: list[str] | None = None) -> Column:
    """Any spelling -> 'Yes'/'No', null -> 'No' (C10)."""
    return yes_no(is_yes(col, truthy))


def reason_flags(reason: Column | str) -> dict[str, Column]:
    """Eleven hierarchical Yes/No flags from one delay reason."""
    reason = F.col(reason) if isinstance(reason, str) else reason
    by_flag: dict[str, list[str]] = {}
    for flag, r in dims.REASON_FLAG:
        by_flag.setdefault(flag, []).append(r)
    return {flag: yes_no(reason.isin(*by_flag[flag])) for flag in dims.FLAG_COLUMNS}


def contrast_from_scan(scan: Column | str, case_sensitive: bool = False) -> Column:
    """'Yes' when the scan type mentions contrast (C6 case-insensitive, B9 exact)."""
    scan = F.col(scan) if isinstance(scan, str) else scan
    hit = scan.contains("Contrast") if case_sensitive else F.lower(scan).contains("contrast")
    return yes_no(hit)


def delay_band(overrun: Column | str) -> Column:
    """0 -> Class 1, (0,20] -> Class 2, >20 -> Class 3, else Unknown (C7 form 1)."""
    o = F.col(overrun) if isinstance(overrun, str) else overrun
    return (F.when(o == 0, "Class 1").when((o > 0) & (o <= 20), "Class 2")
            .when(o > 20, "Class 3").otherwise("Unknown"))


def delay_band_report(overrun: Column | str) -> Column:
    """>20 -> Class 3, >0 -> Class 2, default Class 1 (C7 form 2)."""
    o = F.col(overrun) if isinstance(overrun, str) else overrun
    return F.when(o > 20, "Class 3").when(o > 0, "Class 2").otherwise("Class 1")


def flag_present(cols: list[str]) -> Column:
    """'Yes' if any listed flag is 'yes' (case-insensitive), else 'No' (C8)."""
    hits = [F.coalesce(F.lower(F.col(c).cast("string")) == "yes", F.lit(False)) for c in cols]
    return yes_no(reduce(lambda a, b: a | b, hits))


def reason_text(cols: list[str] | None = None, names: dict[str, str] | None = None) -> Column:
    """Set flags joined by ', ' in list order, else 'None' (C9)."""
    cols = dims.REASON_TEXT_FLAGS if cols is None else cols
    names = dims.FLAG_DISPLAY if names is None else names
    parts = [F.when(F.col(c) == "Yes", F.lit(names[c])) for c in cols]
    return F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit("None"))


def short_flag_text(cols: list[str] | None = None) -> Column:
    """Model-policy flag text: names without ' Required', ' needed', ' User' (C9)."""
    cols = dims.REASON_TEXT_FLAGS if cols is None else cols
    short = {}
    for c in cols:
        n = dims.FLAG_DISPLAY[c]
        for suffix in (" Required", " needed", " User"):
            n = n.replace(suffix, "")
        short[c] = n
    return reason_text(cols, short)


def complexity(cols: list[str] | None = None) -> Column:
    """Number of set flags (C11)."""
    cols = dims.REASON_TEXT_FLAGS if cols is None else cols
    return reduce(lambda a, b: a + b, [(F.col(c) == "Yes").cast("int") for c in cols])


def pct_text(num: Column, den: Column) -> Column:
    """Percentage with one decimal, e.g. '88.0%'; 0 on an empty denominator.

    Rounded half-to-even in exact integer arithmetic so every engine prints
    the same digits.
    """
    scaled = num.cast("long") * 1000
    q = F.floor(scaled / den).cast("long")
    r = scaled - q * den
    up = (r * 2 > den) | ((r * 2 == den) & (q % 2 == 1))
    tenths = q + F.when(up, 1).otherwise(0)
    text = F.concat(F.floor(tenths / 10).cast("long").cast("string"), F.lit("."),
                    (tenths % 10).cast("string"), F.lit("%"))
    return F.when(F.coalesce(den, F.lit(0)) == 0, F.lit("0.0%")).otherwise(text)


def outcome_group(actual: Column | str, predicted: Column | str) -> Column:
    """Outcome of a (actual, predicted) class pair (C17)."""
    a = F.col(actual) if isinstance(actual, str) else actual
    p = F.col(predicted) if isinstance(predicted, str) else predicted
    return (F.when((a == "Class 2") & (p == "Class 2"), "Correct Class 2")
            .when((a == "Class 3") & (p == "Class 3"), "Correct Class 3")
            .when((a == "Class 3") & (p == "Class 2"), "ERROR: Actual 3 -> Pred 2")
            .when((a == "Class 2") & (p == "Class 3"), "ERROR: Actual 2 -> Pred 3")
            .otherwise("Other"))


def clip_zero(x: Column | str) -> Column:
    """Negative predictions -> 0."""
    x = F.col(x) if isinstance(x, str) else x
    return F.greatest(F.lit(0.0), x.cast("double"))


def hhmm_to_minutes(text: Column | str, origin_hour: int = 8) -> Column:
    """'HH:MM' -> minutes since origin_hour (C20)."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(text, ":")
    return (parts.getItem(0).cast("int") - origin_hour) * 60 + parts.getItem(1).cast("int")


def clean_feature_name(name: Column | str) -> Column:
    """Strip transformer prefixes 'cat__' / 'num__' (C21)."""
    name = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(name, "^(cat__|num__)", "")


PRIORITY_PATTERN = "(?i)Hospital|Hoist|Claustrophobic|Sedation"


def is_priority(reason: Column | str) -> Column:
    """Case-insensitive keyword regex on the reason text."""
    reason = F.col(reason) if isinstance(reason, str) else reason
    return F.coalesce(reason.rlike(PRIORITY_PATTERN), F.lit(False))


def ensure_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add absent columns with a literal default; present ones are kept."""
    missing = {k: F.lit(v) for k, v in defaults.items() if k not in df.columns}
    return df.withColumns(missing) if missing else df


def pad_id(id_col: Column | str, width: int = 4) -> Column:
    """Zero-padded id text, never truncating longer ids."""
    c = (F.col(id_col) if isinstance(id_col, str) else id_col).cast("string")
    return F.lpad(c, F.greatest(F.lit(width), F.length(c)), F.lit("0"))


def rule_minutes_expr(scan: Column | str) -> Column:
    """Scan type -> standard minutes, default 30, as an inline map lookup."""
    scan = F.col(scan) if isinstance(scan, str) else scan
    m = F.create_map(*[x for s, mins, _ in dims.SCAN_RULES for x in (F.lit(s), F.lit(mins))])
    return F.coalesce(F.element_at(m, scan), F.lit(dims.DEFAULT_SCAN_MINUTES))


def ratio_round(num: Column, den: Column, decimals: int) -> Column:
    """``num/den`` rounded half-to-even to ``decimals`` places, exactly.

    ``num`` and ``den`` must be integral (exact sums/counts). Integer
    arithmetic makes the result identical in every engine, unlike rounding
    a binary double.
    """
    scale = 10 ** decimals
    scaled = num.cast("long") * scale
    q = F.floor(scaled / den).cast("long")
    r = scaled - q * den
    up = (r * 2 > den) | ((r * 2 == den) & (q % 2 == 1))
    return F.when(den == 0, F.lit(None).cast("double")).otherwise(
        (q + F.when(up, 1).otherwise(0)).cast("double") / F.lit(float(scale)))
