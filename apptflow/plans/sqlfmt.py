"""Small SQL text helpers shared by the oracle strings."""
from __future__ import annotations

from apptflow.functions.draws import _sql_lit


def pct_sql(num: str, den: str) -> str:
    """Twin of ``flags.pct_text``: half-even tenths in integer arithmetic."""
    q = f"(CAST({num} AS BIGINT) * 1000 // ({den}))"
    r = f"(CAST({num} AS BIGINT) * 1000 - {q} * ({den}))"
    t = f"({q} + CASE WHEN 2 * {r} > ({den}) OR (2 * {r} = ({den}) AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
    return (f"CASE WHEN coalesce({den}, 0) = 0 THEN '0.0%' ELSE "
            f"CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR) || '%' END")


def values_sql(rows: list[tuple], cols: list[str]) -> str:
    body = ", ".join("(" + ", ".join(_sql_lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(cols)}))"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c for c in ctes if c)


def ratio_round_sql(num: str, den: str, decimals: int) -> str:
    scale = 10 ** decimals
    q = f"(CAST({num} AS BIGINT) * {scale} // ({den}))"
    r = f"(CAST({num} AS BIGINT) * {scale} - {q} * ({den}))"
    t = f"({q} + CASE WHEN 2 * {r} > ({den}) OR (2 * {r} = ({den}) AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
    return f"CASE WHEN ({den}) = 0 THEN NULL ELSE CAST({t} AS DOUBLE) / {float(scale)!r} END"
