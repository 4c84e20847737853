"""Target-distribution importance resampling (DSIR) with segment deduplication.

After Xie et al., "Data selection for language models via importance
resampling" (2023): texts are bags of hashed word n-grams (runs of one and two
words), a bucket's gain is the log ratio of its smoothed shares in the target
and in the raw corpus, a document's weight is the mean gain of its features, and
a Gumbel draw from a hash of the identifier makes the largest scores a sample
without replacement.

The corpus counts come from segments. A newline separates words, so it cuts a
text into lines whose features do not depend on their neighbours, but for the
pairs of words that reach over line ends. Equal lines are one row after a
map-side count; the features of a distinct line are hashed once, multiplied by
its occurrences, and added up in a vector of ``buckets`` numbers a task. Pairs
across lines are counted apart, where the documents lie.

Hashing is numpy over a batch's bytes: a CRC-32 goes over all words of a batch
at once, character by character, and that of a pair follows from those of its
words, since the CRC register is linear in its state. Words of more than
``LONG`` bytes, few in any text, go through zlib.

Only the bucket counts (at most ``buckets`` rows) and the number of eligible
documents reach the driver; the gains are as many numbers. Ranks are prefix
counts over range partitions.

Defined results: null and empty texts have no features, weight 0. A null
identifier hashes as the empty text and is larger than any other. Repeated rows
are rows of their own; rows equal in identifier, features and weight take
neighbouring ranks. Whole texts count; a batch holds at least one text, so a
task needs memory of about thirty times its longest. An empty table gives no
rows, an empty target gains from smoothing alone. Other columns are ignored.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apptflow.llm.common import prefix_sums, stored

BUCKETS = 10_000
#: bytes of a word that the vectorised hash takes; bytes of text handled at once
LONG = 48
CHUNK = 1 << 20
FULL = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


STEP = _byte_table()


def _zero_bytes() -> np.ndarray:
    """[n, k, v]: the register v << 8 k after n zero bytes."""
    now = (np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [now]
    for _ in range(LONG):
        now = STEP[now & 255] ^ (now >> 8)
        out.append(now)
    return np.stack(out)


ZEROS = _zero_bytes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


class Words:
    """The words of texts that lie one after the other in ``data``; text i ends before ``ends[i]``."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.data = LOWER[data]
        inside = IN_WORD[self.data]
        starts = np.concatenate([[0], ends[:-1]])
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        before[:1] = False
        before[starts[starts < len(data)]] = False  # a word ends with its text
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        after[-1:] = False
        after[starts[(starts > 0) & (starts <= len(data))] - 1] = False
        self.first = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.text = np.searchsorted(ends, self.first, "right")
        self.paired = self.text[1:] == self.text[:-1]

    def lines(self) -> np.ndarray:
        """Number of newlines before each word."""
        return np.searchsorted(np.flatnonzero(self.data == 10), self.first)

    def registers(self, which: np.ndarray) -> np.ndarray:
        """CRC register after each of the words ``which``, before its last inversion."""
        first, size = self.first[which], self.end[which] - self.first[which]
        out = np.full(len(which), FULL, np.uint32)
        order = np.argsort(-size, kind="stable")
        size, first = size[order], first[order]
        n_long = int(np.searchsorted(-size, -LONG, "left"))  # words over LONG
        reg = np.full(len(which), FULL, np.uint32)
        lengths = -size
        for k in range(int(size[n_long]) if n_long < len(size) else 0):
            n = int(np.searchsorted(lengths, -k, "left"))  # words of more than k bytes
            r = reg[n_long:n]
            reg[n_long:n] = STEP[(r ^ self.data[first[n_long:n] + k]) & 255] ^ (r >> 8)
        for i in range(n_long):
            reg[i] = zlib.crc32(self.data[first[i]:first[i] + size[i]].tobytes()) ^ 0xFFFFFFFF
        out[order] = reg
        return out

    def pair_registers(self, left: np.ndarray, right: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Register after a word, a blank and the word ``which``, from those of both words."""
        state = STEP[(left ^ np.uint32(32)) & 255] ^ (left >> 8) ^ FULL
        size = self.end[which] - self.first[which]
        n = np.minimum(size, LONG)
        out = right.copy()
        for k in range(4):
            out ^= ZEROS[n, k, (state >> np.uint32(8 * k)) & 255]
        for i in np.flatnonzero(size > LONG):
            word = self.data[self.first[which[i]]:self.end[which[i]]].tobytes()
            out[i] = zlib.crc32(word, int(state[i])) ^ 0xFFFFFFFF
        return out


def chunks(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """The words of a column's texts, about ``CHUNK`` bytes at a time, with the number of the first text."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, Words(raw[offsets[at]:offsets[to]], offsets[at + 1:to + 1] - offsets[at])
        at = to


def features(w: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every run of one or two words."""
    every = np.arange(len(w.first))
    reg = w.registers(every)
    left = np.flatnonzero(w.paired)
    pairs = w.pair_registers(reg[left], reg[left + 1], left + 1)
    hashed = np.concatenate([reg, pairs]) ^ FULL
    return np.concatenate([w.text, w.text[left]]), (hashed % np.uint32(buckets)).astype(np.int64)


def _summed(counts: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket."""

    def of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            times = batch.column(1).to_numpy()
            for first, w in chunks(batch.column(0)):
                line, bucket = features(w, buckets)
                counts += np.bincount(bucket, times[first + line], buckets).astype(np.int64)  # below 2**53 a batch
        yield _summed(counts)

    def over_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, w in chunks(batch.column(0)):
                line = w.lines()
                left = np.flatnonzero(w.paired & (line[1:] != line[:-1]))
                hashed = w.pair_registers(w.registers(left), w.registers(left + 1), left + 1) ^ FULL
                counts += np.bincount(hashed % np.uint32(buckets), minlength=buckets)
        yield _summed(counts)

    texts = df.select(F.col(text_col).alias("text")).filter("text <> ''")
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    lines = lines.groupBy("line").agg(F.count("*").alias("n"))
    parts = lines.mapInArrow(of_lines, "bucket long, n long").unionByName(
        texts.mapInArrow(over_lines, "bucket long, n long"))
    counts = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        counts[r["bucket"]] = r["n"]
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths, rounded down."""
    k, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k))))
                     for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features, weight of every row: the mean gain of its features, rounded down."""
    id_type = docs.schema[id_col].dataType.simpleString()
    buckets, table = len(gain), gain.astype(np.float64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, found, total = (np.zeros(n, np.int64) for _ in range(3))
            for first, w in chunks(batch.column(1)):
                text, bucket = features(w, buckets)
                m = int(text.max()) + 1 if len(text) else 0
                words[first:first + m] += np.bincount(w.text, minlength=m)
                found[first:first + m] += np.bincount(text, minlength=m)
                total[first:first + m] += np.bincount(text, table[bucket], m).astype(np.int64)
            cols = [pa.array(x) for x in (words, found, np.floor_divide(total, np.maximum(found, 1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", "n_words", "n_features", "weight"])

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return d.mapInArrow(score, f"id {id_type}, n_words long, n_features long, weight long")


def gumbel(id_col: Column, seed: int) -> Column:
    """A standard Gumbel number in thousandths, rounded down, from the hash of an identifier."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int, least_words: int, seed: int = 7,
             id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             buckets: int = BUCKETS) -> DataFrame:
    """id, n_words, n_features, weight, score, rank of every row.

    ``rank`` (1, 2, ...) orders the rows drawn: ``percent`` of those with ``least_words`` words, highest scores
    first, ties to the smaller identifier; null where not drawn.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    d = weigh(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    d = stored(d, "weights")
    eligible = d.filter(F.col("n_words") >= least_words).withColumns(
        {"lowness": -F.col("score"), "no_id": F.col("id").isNull()})
    drawn = eligible.count() * percent // 100
    ranked = prefix_sums(eligible, ["lowness", "no_id", "id", "n_features", "weight"], {"place": None})
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    cols = [F.col("id").alias(id_col), "n_words", "n_features", "weight", "score"]
    rest = d.filter(F.col("n_words") < least_words).select(*cols, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*cols, rank.alias("rank")).unionByName(rest)
