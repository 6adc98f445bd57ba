"""Toxicity by a factorization machine over hashed terms.

Terms are words and their beginnings (letters, digits and non-ASCII characters, lower-cased), hashed
into `BUCKETS`. From a bounded sample of labelled documents a factorization machine learns a weight for
every bucket seen in it and a vector for each, whose products weigh pairs of terms: an insult next to a
group mention can count for more than both alone, also if neither tells anything by itself. Terms that tell
much by themselves are learnt faster than the many that do not, which would be learnt by heart otherwise.
The model is a few arrays of fixed size; every document is then scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.words import NOT_WORD, U64, groups, utf8, word_parts
from spanwright.session import durable

BUCKETS = 1 << 18
RANK = 4
SAMPLE = 10_000
"""At most so many labelled documents are learnt from, chosen by a hash of their id."""
PREFIXES = (4, 5, 6, 7)
"""Bytes of the word beginnings that count as terms beside the whole word."""
FULL = 30
"""Chi-square of presence against the label from which a term is learnt at full rate."""
FLOOR = 0.05
"""Share of the full rate at which every other term is learnt at least."""


@dataclass
class Machine:
    """score = sigmoid(bias + w.x + sum over pairs of <v_i, v_j> x_i x_j), x = log(1 + count) of the buckets."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def scores(self, n: int, rows: np.ndarray, buckets: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Scores of n rows, given the row, bucket and x of each term; the same for equal rows in any company."""
        vectors = self.vectors[buckets]
        total = self.bias + np.bincount(rows, self.weights[buckets] * x, n) - np.bincount(rows, (vectors ** 2).sum(axis=1) * x ** 2, n) / 2
        for k in range(RANK):
            total += np.bincount(rows, vectors[:, k] * x, n) ** 2 / 2
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _counted(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, row of each term, its bucket, log(1 + count)) by groups of rows, each bucket once a row."""
    at, n, keys, counts = None, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def counted() -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        return n, keys // BUCKETS, keys % BUCKETS, np.log1p(counts)

    data, bounds = utf8(column)
    for low, high in groups(bounds):
        if at is not None:
            yield counted()
        at, n, keys, counts = low, high - low, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for rows, hashes in word_parts(data[bounds[low]:bounds[high]], bounds[low:high + 1] - bounds[low], NOT_WORD, PREFIXES):
            found, number = np.unique(rows * BUCKETS + (hashes & U64(BUCKETS - 1)).astype(np.int64), return_counts=True)
            if len(keys):
                found, inverse = np.unique(np.concatenate((keys, found)), return_inverse=True)
                number = np.bincount(inverse, np.concatenate((counts, number))).astype(np.int64)
            keys, counts = found, number
    if at is not None:
        yield counted()


def _rates(buckets: np.ndarray, cuts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of the full rate of each bucket, by the chi-square of its presence; 0 if it was not seen."""
    held = np.zeros((2, BUCKETS))
    for low in range(0, len(y), 256):
        label = np.repeat(y[low:low + 256], np.diff(cuts[low:low + 257]))
        part = buckets[cuts[low]:cuts[min(low + 256, len(y))]]
        for k in (0, 1):
            held[k] += np.bincount(part[label == k], minlength=BUCKETS)
    b, a = held
    toxic, n = float(y.sum()), a + b
    clean = len(y) - toxic
    chi = len(y) * (a * (clean - b) - b * (toxic - a)) ** 2 / (n * (len(y) - n) * toxic * clean + 1e-9)
    return np.where(n > 0, np.clip(chi / FULL, FLOOR, 1), 0)


def _fit(buckets: np.ndarray, x: np.ndarray, cuts: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.05,
         decay: float = 1e-4) -> Machine:
    """Sparse AdaGrad on the log loss, a batch of documents at a time; deterministic for equal samples."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    bias, n = np.log(share / (1 - share)), len(y)
    if not 0 < y.sum() < n:
        return Machine(float(bias), np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, RANK), np.float32))
    draw = np.random.default_rng(7)
    rates = _rates(buckets, cuts, y).astype(np.float32)
    flat = np.concatenate((np.zeros((BUCKETS, 1)), draw.normal(0, 0.01, (BUCKETS, RANK))), axis=1).astype(np.float32)
    squares, bias_squares = np.full(flat.shape, 1e-8, np.float32), 1e-8
    for _ in range(epochs):
        order = draw.permutation(n)
        for low in range(0, n, batch):
            docs = order[low:low + batch]
            sizes = cuts[docs + 1] - cuts[docs]
            ends = np.cumsum(sizes)
            rows = np.repeat(np.arange(len(docs)), sizes)
            at = np.repeat(cuts[docs] - ends + sizes, sizes) + np.arange(len(rows))
            known, inverse = np.unique(buckets[at], return_inverse=True)
            part = flat[known]
            scaled = (x[at] * rates[buckets[at]])[:, None]
            terms = part[inverse] * scaled
            sums = np.stack([np.bincount(rows, terms[:, k], len(docs)) for k in range(1 + RANK)], axis=1)
            own = np.bincount(rows, (terms[:, 1:] ** 2).sum(axis=1), len(docs))
            total = bias + sums[:, 0] + ((sums[:, 1:] ** 2).sum(axis=1) - own) / 2
            miss = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - y[docs]) / len(docs)
            by_weight = miss[rows][:, None] * scaled
            slopes = np.concatenate((by_weight, by_weight * (sums[rows, 1:] - terms[:, 1:])), axis=1)
            grad = np.stack([np.bincount(inverse, slopes[:, k], len(known)) for k in range(1 + RANK)], axis=1) + decay * part
            squares[known] += grad ** 2
            flat[known] = part - rate * grad / np.sqrt(squares[known])
            bias_squares += miss.sum() ** 2
            bias -= rate * miss.sum() / np.sqrt(bias_squares)
    flat *= rates[:, None]
    return Machine(float(bias), flat[:, 0].copy(), flat[:, 1:].copy())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample: int = SAMPLE) -> Machine:
    """A machine learnt from at most `sample` rows of `labels` (id_col, label_col in 0/1) and their texts.

    An id with several labels has the largest. Null labels and ids teach nothing. Without labels of both kinds the machine
    scores every document alike, with the share of ones (0.5 if there are no labels).
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = durable(texts.join(F.broadcast(picked), "id"))  # at most `sample` pairs of numbers

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            for n, at, buckets, x in _counted(batch.column(2)):
                cuts = np.searchsorted(at, np.arange(n + 1))
                found += [(buckets[a:b].astype(np.int32).tobytes(), x[a:b].astype(np.float32).tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[k] for f in found], pa.binary()) for k in (0, 1))],
                                             ["id", "label", "buckets", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = rows.select("id", "label", "text").mapInArrow(each, f"id {kind}, label int, buckets binary, x binary").orderBy("id", "buckets", "x").limit(sample)
    with tempfile.TemporaryFile() as places, tempfile.TemporaryFile() as values:  # the driver's own, read a batch at a time
        y, sizes = [], [0]
        for r in got.select("label", "buckets", "x").toLocalIterator():
            y.append(r.label)
            sizes.append(len(r.x) // 4)
            places.write(r.buckets)
            values.write(r.x)
        places.flush()
        values.flush()
        cuts = np.cumsum(sizes)
        arrays = [np.memmap(f, t, "r") if cuts[-1] else np.zeros(0, t) for f, t in ((places, np.int32), (values, np.float32))]
        return _fit(*arrays, cuts, np.array(y, np.float32))


def score(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """`docs` without the text, with a double column `score` between 0 and 1. Null and empty texts have no terms."""
    kept = [c for c in docs.columns if c not in (text_col, "score")]
    schema = docs.select(*kept).withColumn("score", F.lit(0.0)).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [machine.scores(*group) for group in _counted(batch.column(len(kept)))]
            values = np.concatenate(found).astype(np.float64) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values)], [*kept, "score"])

    return docs.select(*kept, text_col).mapInArrow(each, schema)
