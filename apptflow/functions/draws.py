"""Deterministic hash draws (B4-B6 building blocks).

``u(id, salt)`` is a uniform number in [0, 1) computed from the first 32 bits
of ``md5(id || ':' || salt)``. It is a pure function of the row, so draws are
reproducible, independent of partitioning, and survive task retries: a lost
executor recomputes exactly the same values.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def u(key: Column | str, salt: str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    hexed = F.md5(F.concat(key.cast("string"), F.lit(":" + salt)))
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("bigint") / F.lit(TWO_32)


def u_sql(key: str, salt: str) -> str:
    """The same draw as DuckDB SQL (used by the oracle)."""
    return f"(('0x'||substr(md5(cast({key} as varchar)||':{salt}'),1,8))::BIGINT/4294967296.0)"


def pick(draw: Column, values: list) -> Column:
    """Uniform choice from a fixed list: element ``floor(u*k)``."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.floor(draw * len(values)) + 1).cast("int"))


def pick_sql(draw: str, values: list) -> str:
    lits = ", ".join(_sql_lit(v) for v in values)
    return f"([{lits}])[cast(floor({draw}*{len(values)}) as bigint)+1]"


def cumulative_bounds(items: list[tuple]) -> list[tuple]:
    """(value, weight) -> (value, lo, hi) with weights normalised to 1.

    Bounds are rounded to 12 decimals so both engines compare against the
    same literals.
    """
    total = sum(w for _, w in items)
    out, acc = [], 0.0
    for value, w in items:
        lo = round(acc / total, 12)
        acc += w
        hi = round(acc / total, 12)
        out.append((value, lo, hi))
    # the last bucket is closed at 1.0 so every draw lands somewhere
    out[-1] = (out[-1][0], out[-1][1], 1.0)
    return out


def weighted_pick(draw: Column, items: list[tuple]) -> Column:
    """Weighted choice from a small fixed list as a CASE chain."""
    bounds = cumulative_bounds(items)
    expr = None
    for value, _, hi in bounds[:-1]:
        cond = draw < F.lit(hi)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    last = F.lit(bounds[-1][0])
    return last if expr is None else expr.otherwise(last)


def weighted_pick_sql(draw: str, items: list[tuple]) -> str:
    bounds = cumulative_bounds(items)
    if len(bounds) == 1:
        return _sql_lit(bounds[0][0])
    whens = " ".join(f"WHEN {draw} < {hi!r} THEN {_sql_lit(v)}" for v, _, hi in bounds[:-1])
    return f"CASE {whens} ELSE {_sql_lit(bounds[-1][0])} END"


def _sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return repr(v)
