"""Quality classifier on supervised subword embeddings.

A text's words and character 3- and 4-grams (over its UTF-8 bytes, case and
marks kept), and for each word whether it repeats the word one, two or three
places before, are hashed into ``BUCKETS`` learned vectors; the vectors of all
occurrences are averaged and a softmax layer gives the label's probability, as
in "Bag of tricks for efficient text classification" (Joulin et al., 2016).
Training is minibatch stochastic gradient descent in numpy on a bounded sample
of labelled rows (``labelled.SAMPLE`` of each label, weighted back to their
shares); what reaches the driver are the sample's hashed counts. With two
labels the average of the vectors times the layer is an average of one number a
bucket, so scoring a text, whole and where it lies, is a table lookup.

Defined results: null text counts as empty; an empty text has the average of
no vectors, 0, and so the layer's bias. Null identifiers are scored, never
learned from. Without labelled rows of both labels every score is the share of
label 1 (0.5 without any). An empty table gives no rows. Other columns are
ignored by ``score`` and passed through by ``keep_good``.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apptflow.llm import labelled
from apptflow.llm.common import free_name, in_parts

BUCKETS = 1 << 16
DIM = 10
EPOCHS, LEAST_STEPS, BATCH, RATE = 6, 600, 25, 0.5
THRESHOLD = 0.3
#: hashing constants: odd multipliers of the positions and of the final mix
MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263)
MIX = 2654435769
#: distances at which a word may repeat, and the first of the buckets that say so
REPEATS, REPEAT_SLOT = (1, 2, 3), np.uint32(11)
#: characters hashed at a time, so that a very long text needs no more memory
SLICE = 1 << 20


def _slot(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(MIX)
    return h >> np.uint32(16)


def hashed(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all occurrences of words and character n-grams of a text."""
    data = text.encode("utf-8", "replace")
    if not data.strip():
        return
    padded = b" " + data + b" "
    for at in range(0, len(padded) - 2, SLICE):
        a = np.frombuffer(padded[at:at + SLICE + 3], np.uint8).astype(np.uint32)
        for n in (3, 4):
            m = min(len(a) - n + 1, SLICE)
            if m > 0:
                yield _slot(sum(a[i:i + m] * np.uint32(MULTIPLIERS[i]) for i in range(n)) + np.uint32(n))
    words = data.split()
    joined = np.frombuffer(b"".join(words), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    place = (np.arange(len(joined)) - np.repeat(starts, sizes)).astype(np.uint32)
    hashes = (np.add.reduceat((joined + np.uint32(1)) * (place * np.uint32(MULTIPLIERS[0]) + np.uint32(1)), starts, dtype=np.uint32))
    yield _slot(hashes)
    for k in REPEATS:
        yield REPEAT_SLOT + 2 * k + (hashes[k:] == hashes[:-k]).astype(np.uint32)


class Model:
    """One number a bucket, and the bias: log-odds of label 1."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table.astype(np.float32), bias

    def __call__(self, text: str | None) -> float:
        total, n = 0.0, 0
        for slots in hashed(text or ""):
            total += float(self.table[slots].sum(dtype=np.float64))
            n += len(slots)
        return float(1 / (1 + np.exp(-(self.bias + (total / n if n else 0.0)))))


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, seed: int = 7) -> Model:
    """Vectors and softmax layer from (buckets, shares) of each text."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer, bias = rng.normal(0, 1, (DIM, 2)), np.zeros(2)
    weight = weight / weight.mean()
    each = -(-len(y) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // each))
    steps, done = epochs * each, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at:at + BATCH]
            slots = np.concatenate([bags[r][0] for r in rows])
            share = np.concatenate([bags[r][1] for r in rows])
            sizes = np.array([len(bags[r][0]) for r in rows])
            of = np.repeat(np.arange(len(rows)), sizes)
            values = vectors[slots] * share[:, None]
            hidden = np.stack([np.bincount(of, values[:, d], len(rows)) for d in range(DIM)], 1)
            z = hidden @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            g = p * weight[rows, None] / len(rows)
            rate = RATE * (1 - done / steps)
            back = g @ layer.T
            layer -= rate * (hidden.T @ g)
            bias -= rate * g.sum(0)
            # a text's vectors share its gradient; the rate is per text, not per batch
            for d in range(DIM):
                vectors[:, d] -= rate * len(rows) * np.bincount(slots, share * back[of, d], BUCKETS)
            done += 1
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", modulus: int = 5, remainder: int = 0,
        id_col: str = "doc_id", text_col: str = "text") -> Model:
    sample = labelled.draw(labels, label_col, modulus, remainder, id_col)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in (t for part in in_parts(batch.column("text")) for t in part.to_pylist()):
                n = np.zeros(BUCKETS, np.int64)
                for slots in hashed(text or ""):
                    n += np.bincount(slots, minlength=BUCKETS)
                at = np.flatnonzero(n)
                out.append(at.astype(np.uint16).tobytes() + (n[at] / max(1, n.sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.binary())],
                                             names=["label", "bag"])

    got = labelled.with_labels(docs, sample, id_col, text_col).mapInArrow(features, "label int, bag binary").toArrow()
    y = got.column("label").to_numpy()
    if len(set(y.tolist())) < 2:
        prior = min(max(sample.prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), float(np.log(prior / (1 - prior))))
    raw = got.column("bag").to_pylist()
    # two bytes of bucket and four of share for each entry
    bags = [(np.frombuffer(x, np.uint16, len(x) // 6), np.frombuffer(x[len(x) // 6 * 2:], np.float32)) for x in raw]
    order = np.lexsort(([zlib.crc32(x) for x in raw], y))  # the same order whatever the tasks' order was
    weight = np.where(y == 1, sample.weight[1], sample.weight[0])
    return train([bags[i] for i in order], y[order].astype(np.int64), weight[order])


def _score_udf(model: Model):
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([model(t) for part in in_parts(batch) for t in part.to_pylist()], pa.float64())
    return F.arrow_udf(score, "double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted of every row."""
    d = docs.select(F.col(id_col).alias(id_col), _score_udf(model)(F.col(text_col)).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns."""
    name = free_name(docs, "quality_score")
    return docs.withColumn(name, _score_udf(model)(F.col(text_col))).filter(F.col(name) >= THRESHOLD).drop(name)
