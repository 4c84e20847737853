"""Toxicity of a text after noisy-channel deobfuscation.

A character language model (interpolated 4-grams over a to z, accents taken
off, and word boundaries) is counted over all documents. Words with digits or
symbols among or next to their letters, letters set apart by blanks or marks, and letters
repeated three times or more become lattices of what each character may stand
for; Viterbi decoding picks the path that is likeliest under the channel's
costs and the language model. All other words have one path, themselves.

The restored words and their beginnings, whether they occur once, twice or as
more than ``RATE`` of all words, are the features of a logistic model: from a
bounded sample of labelled rows (``SAMPLE`` of each label) the ``FEATURES``
features that tell most about the label are kept and weighted.
Texts are scored where they lie, row by row; only the counts of the language
model, at most 27**4 of them, and the sample's features reach the driver.

Defined results: null text counts as empty; a text without any known feature
gets the model's intercept. Null identifiers are scored, never learned from.
Without labelled rows of both labels every score is the share of label 1 (0.5
without any). An empty table gives no rows. Other columns are ignored by
``score`` and passed through by ``drop_toxic``.
"""
from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apptflow.llm import labelled
from apptflow.llm.common import free_name, in_parts

LETTERS = 27  # 0 is the boundary
ORDER = 4
BUCKETS = 1 << 20
FEATURES = 4096
PREFIXES = (3, 4, 5, 6, 7)
SAMPLE = 2000
#: least log-likelihood ratio of a kept feature: rarer ones only tell single documents apart
LEAST_INFORMATION = 4.5
RATE = 0.005
KINDS = 3  # of a name: once, twice, often
THRESHOLD = 0.3
CACHE_WORDS = 300_000

#: fixed values: letters that a digit or symbol may stand for
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: log-probabilities of the channel
LEET_COST, MARK_COST, BREAK_COST, HIDDEN_COST, REPEAT_COST = -1.0, -0.5, -2.0, -4.0, -0.5

REPEATED = re.compile(r"(.)\1\1")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
SYMBOLS = "".join(re.escape(c) for c in LEET if not c.isalnum())
# edges but for symbols that may be letters
MARKS = re.compile(rf"^(?:[^\w{SYMBOLS}]|_)+|(?:[^\w{SYMBOLS}]|_)+$")
SYMBOL = re.compile(f"[{SYMBOLS}]")
# three or more single letters or symbols, each set apart from the next by blanks or marks, however many
GAP = re.compile(rf"(?:[^\w{SYMBOLS}]|_)+")
SPACED = re.compile(rf"(?<![^\W_])(?:[^\W_]|[{SYMBOLS}])(?:{GAP.pattern}(?:[^\W_]|[{SYMBOLS}])){{2,}}(?![^\W_])")
PIECES = re.compile(r"[^\W\d_]+")


def _letter_table() -> bytes:
    """Letter of each Latin-1 byte: accents taken off, anything else a boundary."""
    out = bytearray(256)
    for b in range(256):
        c = unicodedata.normalize("NFD", bytes([b]).decode("latin-1").lower())[:1]
        out[b] = ord(c) - 96 if "a" <= c <= "z" else 0
    return bytes(out)


LETTER = _letter_table()


def letters(text: str) -> bytes:
    return text.encode("latin-1", "replace").translate(LETTER)


def count_grams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all character 4-grams of all documents, as a dense table."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS ** ORDER, np.int64)
        for batch in batches:
            for text in (t for part in in_parts(batch.column(0)) for t in part.to_pylist()):
                a = np.frombuffer(bytes(ORDER - 1) + letters(text or "") + b"\0", np.uint8).astype(np.int32)
                code = ((a[:-3] * LETTERS + a[1:-2]) * LETTERS + a[2:-1]) * LETTERS + a[3:]
                seen, n = np.unique(code, return_counts=True) if len(code) < 20_000 else (None, np.bincount(
                    code, minlength=len(total)))
                if seen is None:
                    total += n
                else:
                    total[seen] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    sums = docs.select(text_col).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(LETTERS ** ORDER)
    out[sums.column("at").to_numpy()] = sums.column("n").to_numpy()
    return out.reshape((LETTERS,) * ORDER)


def log_model(grams: np.ndarray) -> np.ndarray:
    """log P(letter | three before), each order interpolated with the next lower one."""
    p = np.full(LETTERS, 1 / LETTERS)
    for order in range(1, ORDER + 1):
        n = grams.sum(axis=tuple(range(ORDER - order)))
        p = (n + 5 * p) / (n.sum(-1, keepdims=True) + 5)
    return np.log(p).astype(np.float32)


class Restorer:
    """Viterbi decoding of the words of a text."""

    def __init__(self, model: np.ndarray):
        self.model = model.reshape(-1)

    def lattice(self, span: str) -> list[list[tuple[str, float]]]:
        """What each run of equal characters of ``span`` may stand for: (text, log-probability)."""
        out = []
        for run in re.finditer(r"(.)\1*", span, re.DOTALL):
            c, n = run[1], len(run[0])
            if c.isalpha():
                if n < 3:
                    out.append([(run[0], 0.0)])
                else:
                    out.append([(c, REPEAT_COST), (c * 2, REPEAT_COST)])
                continue
            paths = [("", MARK_COST if c not in LEET else HIDDEN_COST), (" ", BREAK_COST)]
            for letter in LEET.get(c, ""):
                paths.append((letter, LEET_COST))
                if n > 1:
                    paths.append((letter * 2, LEET_COST))
            out.append(paths)
        return out

    def decode(self, span: str) -> str:
        # state: the last three letters; the best path into each
        best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for paths in [*self.lattice(span), [(" ", 0.0)]]:
            found: dict[int, tuple[float, tuple]] = {}
            for state, (score, before) in best.items():
                for more, cost in paths:
                    s, at = score + cost, state
                    for x in letters(more):
                        at = at * LETTERS + x
                        s += self.model[at]
                        at %= LETTERS ** (ORDER - 1)
                    if at not in found or s > found[at][0]:
                        found[at] = (s, (before, more))
            best = found
        path, out = max(best.values(), key=lambda x: x[0])[1], []
        while path:
            path, more = path
            out.append(more)
        return "".join(reversed(out))

    def word(self, word: str) -> list[str]:
        """Restored words of a lower-case word between blanks."""
        if not word.isalpha():
            whole, word = MARKS.sub("", word), EDGES.sub("", word)
            # a symbol at an edge is a letter or a mark: both readings
            found = PIECES.findall(self.decode(whole)) if whole != word and SYMBOL.search(whole) else []
            if not word.isalpha():
                if not PIECES.search(word):
                    return found
                return [*found, *PIECES.findall(self.decode(word)), *PIECES.findall(word)]
            return [*found, *self.word(word)]
        if REPEATED.search(word):
            return PIECES.findall(self.decode(word))
        return [word]

    def spaced(self, text: str) -> list[str]:
        """Restored words of letters set apart."""
        return [w for m in SPACED.finditer(text)
                for w in PIECES.findall(self.decode(GAP.sub(".", m[0])))]


class Reader:
    """Features of the restored words of a text, by number; words are remembered.

    ``wanted``: the names' buckets to look at, all if None.
    """

    def __init__(self, model: np.ndarray, wanted: set[int] | None = None):
        self.restorer, self.wanted = Restorer(model), wanted
        self.cache: dict[str, tuple[int, ...]] = {}

    def _buckets(self, words: list[str]) -> tuple[int, ...]:
        found = {bucket(n) for w in words for n in (w, *("^" + w[:k] for k in PREFIXES if len(w) >= k))}
        return tuple(found if self.wanted is None else found & self.wanted)

    def __call__(self, text: str) -> set[int]:
        text = text.lower()
        words = text.split()
        times: dict[int, int] = {}
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w, n in Counter(words).items():
            found = cache.get(w)
            if found is None:
                found = cache[w] = self._buckets(self.restorer.word(w))
            for b in found:
                times[b] = times.get(b, 0) + n
        for w in self.restorer.spaced(text):
            for b in self._buckets([w]):
                times[b] = times.get(b, 0) + 1
        often = RATE * len(words)
        return {b * KINDS + kind for b, n in times.items() for kind in range(KINDS)
                if kind == 0 or kind == 1 and n >= 2 or kind == 2 and n > often}


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % BUCKETS


class Model:
    """What scoring needs: the language model, and the weights of the kept features."""

    def __init__(self, grams: np.ndarray, weights: dict[int, float], intercept: float):
        self.grams, self.weights, self.intercept = grams, weights, intercept

    def scorer(self) -> Callable[[str | None], float]:
        weights = self.weights
        read = Reader(self.grams, {f // KINDS for f in weights})

        def score(text: str | None) -> float:
            z = self.intercept + sum(sorted(weights.get(f, 0.0) for f in read(text or "")))
            return float(1 / (1 + np.exp(-z)))

        return score


def _information(n1: np.ndarray, n: np.ndarray, all1: float, every: float) -> np.ndarray:
    """Log-likelihood ratio of feature and label, for features that speak for label 1."""
    p, share = n1 / n, all1 / every

    def part(k: np.ndarray, p: np.ndarray | float, q: float) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(p, 1e-300) / q), 0)

    return np.where(p > share, part(n1, p, share) + part(n - n1, 1 - p, 1 - share), 0)


def _logistic(of: np.ndarray, feature: np.ndarray, y: np.ndarray, weight: np.ndarray, k: int,
              steps: int = 400, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Ridge logistic regression of presence features by adaptive gradient descent."""
    w, b = np.zeros(k), 0.0
    sw, sb = np.full(k, 1e-8), 1e-8
    weight = weight / weight.sum()
    for _ in range(steps):
        z = b + np.bincount(of, w[feature], len(y))
        g = weight * (1 / (1 + np.exp(-z)) - y)
        gw = np.bincount(feature, g[of], k) + ridge * w / len(y)
        sw += gw ** 2
        sb += g.sum() ** 2
        w = np.maximum(w - 0.3 * gw / np.sqrt(sw), 0)  # kept features speak for label 1
        b -= 0.3 * g.sum() / np.sqrt(sb)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = 4, remainder: int = 2,
        id_col: str = "doc_id", text_col: str = "text") -> Model:
    grams = log_model(count_grams(docs, text_col))
    sample = labelled.draw(labels, label_col, modulus, remainder, id_col, SAMPLE)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(grams)
        for batch in batches:
            found = [np.fromiter(read(t or ""), np.int32).tobytes()
                     for part in in_parts(batch.column("text")) for t in part.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.binary())],
                                             names=["label", "found"])

    got = labelled.with_labels(docs, sample, id_col, text_col).mapInArrow(features, "label int, found binary").toArrow()
    y = got.column("label").to_numpy()
    if len(set(y.tolist())) < 2:
        prior = min(max(sample.prior, 1e-6), 1 - 1e-6)
        return Model(grams, {}, float(np.log(prior / (1 - prior))))
    sets = [np.frombuffer(x, np.int32) for x in got.column("found").to_pylist()]
    of, feature = np.repeat(np.arange(len(y), dtype=np.int32), [len(s) for s in sets]), np.concatenate(sets)
    del sets, got
    weight = np.where(y == 1, sample.weight[1], sample.weight[0])
    n = np.bincount(feature, minlength=BUCKETS * KINDS)
    n1 = np.bincount(feature[y[of] == 1], minlength=BUCKETS * KINDS)
    use = np.flatnonzero(n1 >= 2)
    tells = _information(n1[use], n[use], y.sum(), len(y))
    use, tells = use[tells >= LEAST_INFORMATION], tells[tells >= LEAST_INFORMATION]
    use = use[np.lexsort((use, -tells))][:FEATURES]
    number = np.full(BUCKETS * KINDS, -1)
    number[use] = np.arange(len(use))
    kept = number[feature] >= 0
    w, b = _logistic(of[kept], number[feature[kept]], y, weight, len(use))
    return Model(grams, {int(f): float(x) for f, x in zip(use, w) if x > 0}, float(b))


def _scores(model: Model) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = model.scorer()
        for batch in batches:
            yield pa.array([of(t) for part in in_parts(batch) for t in part.to_pylist()], pa.float64())
    return score


def _score_udf(model: Model):
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _scores(model)(batches)
    return F.arrow_udf(score, "double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted of every row."""
    d = docs.select(F.col(id_col).alias(id_col), _score_udf(model)(F.col(text_col)).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    name = free_name(docs, "toxic_score")
    return docs.withColumn(name, _score_udf(model)(F.col(text_col))).filter(F.col(name) < THRESHOLD).drop(name)
