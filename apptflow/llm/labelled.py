"""Bounded samples of labelled rows for fitting classifiers."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptflow.llm.common import crc32_text

#: most rows of either label that a classifier is fitted on
SAMPLE = 3000


@dataclass
class Sample:
    """(id, label) rows, at most ``2 * SAMPLE``, and how many labelled rows of a label one stands for."""
    rows: DataFrame
    weight: dict[int, float]

    @property
    def prior(self) -> float:
        """Share of label 1 among all rows that may be learned from."""
        return self.weight.get(-1, 0.5)


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    return F.pmod(crc32_text(id_col), F.lit(modulus)) == remainder


def draw(labels: DataFrame, label_col: str, modulus: int, remainder: int, id_col: str = "doc_id",
         sample: int = SAMPLE) -> Sample:
    """The rows of either label with the smallest hashes, among those not held out.

    Null labels and identifiers are skipped; of rows that repeat an identifier the larger label holds.
    """
    known = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .filter(~held_out(F.col(id_col), modulus, remainder))
             .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("label")))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = [known.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    weight = {y: counts.get(y, 0) / max(1, min(sample, counts.get(y, 0))) for y in (0, 1)}
    total = counts.get(0, 0) + counts.get(1, 0)
    weight[-1] = counts.get(1, 0) / total if total else 0.5
    return Sample(parts[0].unionByName(parts[1]), weight)


def with_labels(docs: DataFrame, sample: Sample, id_col: str, text_col: str) -> DataFrame:
    """id, text, label of the sampled rows; the texts are read where they lie."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return d.join(F.broadcast(sample.rows), "id")  # at most 2 * SAMPLE rows
