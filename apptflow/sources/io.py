"""Table I/O (A1-A3, A6 helpers)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException


class MissingInput(FileNotFoundError):
    """Raised when a required input table is absent (A2)."""


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read one driver table; selecting columns early lets the scan prune."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    try:
        df = spark.read.parquet(path)
    except AnalysisException as exc:  # PATH_NOT_FOUND and friends
        raise MissingInput(f"input table '{name}' not found at {path}") from exc
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV sink, no index column (A3). Directory of part files."""
    df.write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Header CSV scan with a declared schema (A1); no inference pass."""
    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException as exc:  # Spark looks the path up, whatever its scheme
        raise MissingInput(f"input '{path}' not found") from exc


def read_csv_checked(spark: SparkSession, path: str, schema: str, none_tokens: tuple[str, ...] = ("None", ""),
                     header: bool = True) -> tuple[DataFrame, DataFrame]:
    """The good rows of a CSV, and a table of its rejected lines (A1, A2).

    A line is rejected when a value does not fit its column's type or the number of values is wrong; it comes back whole in
    ``line``. Texts are trimmed, so padded identifiers keep their digits (T6), and the tokens in ``none_tokens`` are null
    (T5). Good and rejected rows together are the file's lines, but for headers and empty ones; a value holds no line end.
    """
    fields = StructType.fromDDL(schema).fields
    try:
        lines = spark.read.text(path).filter("value <> ''")
    except AnalysisException as exc:
        raise MissingInput(f"input '{path}' not found") from exc
    if header:
        lines = lines.filter(F.regexp_replace("value", '["\\s]', "") != ",".join(f.name for f in fields))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line", "ignoreLeadingWhiteSpace": "true",
               "ignoreTrailingWhiteSpace": "true"}
    d = lines.select(F.from_csv("value", f"{schema}, _line STRING", options).alias("row")).select("row.*")

    def cleaned(f: StructField) -> Column:
        if not isinstance(f.dataType, StringType):
            return F.col(f.name)
        text = F.trim(F.col(f.name))
        return F.when(~text.isin(*none_tokens), text).alias(f.name)

    good = d.filter("_line IS NULL").select(*[cleaned(f) for f in fields])
    return good, d.filter("_line IS NOT NULL").select(F.col("_line").alias("line"))
