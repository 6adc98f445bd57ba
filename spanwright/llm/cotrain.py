"""Quality of documents by co-training of two views.

One classifier sees only the content of a text, the other only the page's metadata. Both start from
labelled documents. In every round each view names the unlabelled documents it is sure of, and the other
view learns from these as well. At the end both are calibrated on labelled documents that neither learnt from, and
the calibrated log-odds add up (less the prior, which both hold).

All documents take part. Texts are read once into a small vector per document; each Newton step of a logistic
regression is one pass over these vectors that returns sums, so only numbers of fixed count reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.words import WHITE, groups, row_slices, shingles, utf8, word_hashes
from spanwright.session import durable

ROUNDS = 3
STEPS = 4
SURE = 0.95
RIDGE = 0.1
CONTENT = 17
LANGS, SOURCES, SIZES = 16, 64, 24
META = LANGS + SOURCES + SIZES + 1

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 white, 2 upper, 3 digit, 4 symbol, 5 mark, 6 other punctuation, 7 lower or not ASCII
_CLASS[WHITE] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 4
_CLASS[[ord(c) for c in "!?"]] = 5
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 6
_CLASS[97:123] = 7
_CLASS[128:] = 7


def content_vector(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """CONTENT numbers about one text (its bytes and its word hashes): shares of sorts of characters, repetition, lengths."""
    if not len(words):
        return np.concatenate(([1.0, 1.0], np.zeros(CONTENT - 2)))
    n, kinds = len(words), np.bincount(_CLASS[data], minlength=8)
    black = max(1, len(data) - kinds[1])
    lines = data == 10
    distinct, counts = np.unique(words, return_counts=True)
    grams = shingles(words, 3)
    windows = shingles(words, 8)
    return np.array([
        1.0, 0.0, min(1.0, 3 * kinds[2] / black), min(1.0, 3 * kinds[3] / black), min(1.0, 20 * kinds[4] / black), min(1.0, 3 * kinds[5] / n),
        min(1.0, 3 * kinds[6] / black), kinds[7] / black, np.log1p(n) / 5, float(n < 20), min(3.0, black / n / 5), len(distinct) / n,
        min(1.0, 5 * counts.max() / n), 1 - len(np.unique(grams)) / len(grams), 1 - len(np.unique(windows)) / len(windows),
        min(1.0, 5 * float((words[1:] == words[:-1]).mean())) if n > 1 else 0.0, min(1.0, 5 * lines.sum() / n)])


def _bucket(value: str | None, size: int) -> int:
    return 0 if value is None else 1 + xxhash.xxh32_intdigest(value) % (size - 1)


def meta_places(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """Places of the ones in the metadata vector: bias, language, source, size class; nulls have places of their own."""
    size = 0 if n_chars is None else 1 + min(SIZES - 2, max(0, int(n_chars)).bit_length())
    return [0, 1 + _bucket(lang, LANGS), 1 + LANGS + _bucket(source, SOURCES), 1 + LANGS + SOURCES + size]


def vectors(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, size_col: str) -> DataFrame:
    """(id, content binary, meta array<int>) per row of `docs`."""
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"),
                         F.col(source_col).cast("string").alias("source"), F.col(size_col).cast("long").alias("size"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column(1))
            content = []
            for low, high in groups(bounds):
                own = bounds[low:high + 1] - bounds[low]
                part = data[bounds[low]:bounds[high]]
                rows, words = word_hashes(part, own)
                cuts = row_slices(rows, high - low)
                content += [content_vector(part[own[k]:own[k + 1]], words[cuts[k]:cuts[k + 1]]).astype("<f4").tobytes() for k in range(high - low)]
            meta = [meta_places(*v) for v in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary()), pa.array(meta, pa.list_(pa.int32()))], ["id", "content", "meta"])

    return chosen.mapInArrow(each, f"id {kind}, content binary, meta array<int>")


def _views(batch: pa.RecordBatch) -> list[np.ndarray]:
    content = np.frombuffer(b"".join(batch.column("content").to_pylist()), "<f4").reshape(-1, CONTENT).astype(np.float64)
    places = batch.column("meta").flatten().to_numpy().reshape(-1, 4)
    meta = np.zeros((len(places), META))
    np.put_along_axis(meta, places, 1.0, axis=1)
    return [content, meta]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(table: DataFrame, terms) -> np.ndarray:
    """The sum over all rows of the vectors that `terms` makes of each batch; added up by Spark, place by place."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = terms(batch.slice(low, 2048))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"])

    rows = table.mapInArrow(each, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(max((r.place for r in rows), default=-1) + 1)
    for r in rows:
        out[r.place] = r.value
    return out


def _newton_terms(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    p = _sigmoid(x @ w)
    hessian = (x * (weight * p * (1 - p))[:, None]).T @ x
    return np.concatenate((x.T @ (weight * (y - p)), hessian.reshape(-1)))


def _newton(w: np.ndarray, sums: np.ndarray, ridge: float) -> np.ndarray:
    n = len(w)
    return w + np.linalg.solve(sums[n:].reshape(n, n) + ridge * np.eye(n), sums[:n] - ridge * w)


def _rounds(table: DataFrame, rounds: int) -> list[np.ndarray]:
    """Weights of both views after the rounds of exchange."""
    weights, teachers = [np.zeros(CONTENT), np.zeros(META)], None
    for _ in range(rounds):
        for _ in range(STEPS):
            def terms(batch: pa.RecordBatch, weights=weights, teachers=teachers) -> np.ndarray:
                views, label = _views(batch), batch.column("label").to_numpy(zero_copy_only=False)
                fold = batch.column("fold").to_numpy()
                out = []
                for k in (0, 1):
                    y, use = label.astype(np.float64), (label >= 0) & (fold != 0)
                    if teachers is not None:
                        told = _sigmoid(views[1 - k] @ teachers[1 - k])
                        sure = (label < 0) & ((told >= SURE) | (told <= 1 - SURE))
                        y, use = np.where(sure, told >= 0.5, y), use | sure
                    out.append(_newton_terms(views[k], y, use.astype(np.float64), weights[k]))
                return np.concatenate(out)

            sums = _sums(table, terms)
            if not len(sums):
                return weights
            split = CONTENT + CONTENT ** 2
            weights = [_newton(weights[0], sums[:split], RIDGE), _newton(weights[1], sums[split:], RIDGE)]
        teachers = weights
    return weights


def _calibration(table: DataFrame, weights: list[np.ndarray]) -> tuple[list[np.ndarray], float]:
    """(scale and shift of each view's log-odds, prior log-odds) from the labelled documents of fold 0."""
    scales, prior = [np.array([1.0, 0.0]), np.array([1.0, 0.0])], 0.0
    for _ in range(STEPS):
        def terms(batch: pa.RecordBatch, scales=scales) -> np.ndarray:
            views, label = _views(batch), batch.column("label").to_numpy(zero_copy_only=False)
            use = ((label >= 0) & (batch.column("fold").to_numpy() == 0)).astype(np.float64)
            y = label.astype(np.float64)
            parts = [_newton_terms(np.column_stack((v @ w, np.ones(len(v)))), y, use, s) for v, w, s in zip(views, weights, scales, strict=True)]
            return np.concatenate([*parts, [use.sum(), (use * y).sum()]])

        sums = _sums(table, terms)
        if not len(sums):
            break
        scales = [_toward_one(s, sums[k:k + 6]) for s, k in zip(scales, (0, 6), strict=True)]
        prior = float(np.log((sums[13] + 1) / (sums[12] - sums[13] + 1)))
    return scales, prior


def _toward_one(s: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """A Newton step with a weak pull to scale 1 and shift 0, so that few labels leave the view as it is."""
    rest = np.array([1.0, 0.0])
    return s + np.linalg.solve(sums[2:].reshape(2, 2) + np.eye(2), sums[:2] - (s - rest))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            source_col: str = "source", size_col: str = "n_chars", label_col: str = "quality", rounds: int = ROUNDS) -> DataFrame:
    """(id_col, held_out, content_score, meta_score, score, kept) for every row of `docs`.

    `labels` has id_col and label_col (0 or 1; an id with several labels has the largest). Documents whose
    crc32(id) mod 5 is 0 are held out of learning and calibrate the views. score is the probability of label 1; kept is
    score >= 0.5. Null or empty texts have a content vector of their own; null metadata has places of its own; a row with a
    null id is scored and teaches only as unlabelled. Repeated rows count each. Without labels all scores are 0.5.
    """
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
             .agg(F.max(label_col).cast("int").alias("label")))
    fold = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5, F.lit(1)).cast("int")
    table = durable(vectors(docs, id_col, text_col, lang_col, source_col, size_col).join(known, "id", "left")
                    .select("id", "content", "meta", F.coalesce("label", F.lit(-1)).alias("label"), fold.alias("fold")))
    weights = _rounds(table, rounds)
    scales, prior = _calibration(table, weights)
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = [(v @ w) * s[0] + s[1] for v, w, s in zip(_views(batch), weights, scales, strict=True)]
            scores = [_sigmoid(odds[0]), _sigmoid(odds[1]), _sigmoid(odds[0] + odds[1] - prior)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(batch.column("fold").to_numpy() == 0), *[pa.array(s) for s in scores], pa.array(scores[2] >= 0.5)],
                ["id", "held_out", "content_score", "meta_score", "score", "kept"])

    return table.mapInArrow(each, f"id {kind}, held_out boolean, content_score double, meta_score double, score double, kept boolean").withColumnRenamed("id", id_col)
