"""Shards along a Hilbert curve.

Several metadata columns are quantised into 2**bits cells each, by equal
depth and in the order of their values: a cell's number is the share of rows
with smaller values. The cell's index on the Hilbert curve (Skilling's
transform, 2004) orders the rows, ties by identifier; the order is cut into
runs, shard by shard. Rows close on the curve are close in every column, so a
file's min/max statistics prune on any of them.

Law ``rows``: the counts of two shards differ by at most one.

Defined results: null metadata counts as the empty text and null text as
empty; a null identifier sorts first; repeated rows take neighbouring slots;
an empty table gives no rows. Other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptflow.llm.common import let, ordered
from apptflow.session import cut_lineage

BITS = 5
ROW_OVERHEAD = 16


def hilbert_index(cell: str, n: int, bits: int = BITS) -> Column:
    """Index on the Hilbert curve of the cell in array column ``cell``: ``n`` dimensions of ``bits`` bits."""
    q = f"shiftleft(1L, {bits - 1} - k div {n})"
    turn = (f"aggregate(sequence(0, {(bits - 1) * n - 1}), x, (x, k) -> transform(x, (v, j) -> "
            f"CASE WHEN x[k % {n}] & {q} <> 0 THEN CASE WHEN j = 0 THEN v ^ ({q} - 1) ELSE v END "
            f"WHEN j = 0 OR j = k % {n} THEN v ^ ((x[0] ^ x[k % {n}]) & ({q} - 1)) ELSE v END))")
    gray = "transform(x, (v, j) -> aggregate(slice(x, 1, j + 1), 0L, (a, y) -> a ^ y))"
    flip = (f"aggregate(sequence(0, {bits - 2}), 0L, (t, k) -> CASE WHEN x[{n - 1}] & shiftleft(1L, {bits - 1} - k) <> 0 "
            f"THEN t ^ (shiftleft(1L, {bits - 1} - k) - 1) ELSE t END)")
    weave = (f"aggregate(sequence(0, {bits * n - 1}), 0L, (a, k) -> "
             f"a * 2 + (shiftright(x[k % {n}], {bits - 1} - k div {n}) & 1L))")
    body = let(turn, "x", let(gray, "x", let(f"transform(x, v -> v ^ {flip})", "x", weave)))
    return F.expr(let(cell, "x", body))


def depth_cuts(df: DataFrame, column: str, cells: int, n_rows: int) -> list:
    """The smallest value of each cell but the first: at most ``cells - 1`` values."""
    hist = df.groupBy(column).agg(F.count("*").alias("n"))
    hist = ordered(hist, [column], weight="n", position="before")
    cell = F.expr(f"before * {cells} DIV {max(n_rows, 1)}")
    firsts = hist.groupBy(cell.alias("cell")).agg(F.min(column).alias("v")).filter("cell > 0")  # <= cells rows
    return [(r["cell"], r["v"]) for r in firsts.orderBy("cell").collect()]


def _cell(column: str, cuts: list) -> Column:
    """Number of the last cell whose smallest value is not above the column's."""
    out = F.lit(0)
    for cell, v in cuts:
        out = F.when(F.col(column) >= F.lit(v), F.lit(int(cell))).otherwise(out)
    return out


def hilbert_shards(docs: DataFrame, dims: list[str], n_shards: int, id_col: str = "doc_id",
                   text_col: str = "text", bits: int = BITS) -> DataFrame:
    """id, size, text_crc32, curve_index, position, shard, slot for every row.

    ``dims`` are string columns; the size of the text is always a dimension.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).alias("id"), (F.octet_length(raw) + ROW_OVERHEAD).cast("long").alias("size"),
                       F.crc32(raw).alias("text_crc32"),
                       *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"d{i}") for i, c in enumerate(dims)])
    base = cut_lineage(base)
    n = base.count()
    names = [f"d{i}" for i in range(len(dims))] + ["size"]
    cells = [_cell(c, depth_cuts(base, c, 1 << bits, n)) for c in names]
    # the cells become columns first, so that the curve's lambdas read values
    placed = base.select("id", "size", "text_crc32", F.array(*cells).cast("array<bigint>").alias("cell"))
    placed = placed.withColumn("curve_index", hilbert_index("cell", len(names), bits))
    rows = ordered(placed.drop("cell"), ["curve_index", "id", "text_crc32", "size"])
    rows = rows.withColumn("shard", F.expr(f"CAST(position * {n_shards} DIV {max(n, 1)} AS INT)"))
    first = F.expr(f"(CAST(shard AS BIGINT) * {n} + {n_shards - 1}) DIV {n_shards}")
    return rows.select(F.col("id").alias(id_col), "size", "text_crc32", "curve_index", "position", "shard",
                       (F.col("position") - first).alias("slot"))
