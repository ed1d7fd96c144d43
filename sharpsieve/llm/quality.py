"""Quality classifier: Naive Bayes support vectors (Wang and Manning, ACL 2012).

Features are indicators of hashed n-grams: of bytes (1 to 4), of words (1 and 2), and
of repeats (1 to 6: whether each word equals the one before). Each is scaled by its class log-count ratio; a linear hinge-loss model is
fitted by dual coordinate descent (Hsieh et al., ICML 2008) on rows of unit length.
Margins become probabilities by a logistic fit on margins of rows that the model of
their fold hasn't seen.

The model is fitted on at most `most` labelled documents, the first by md5 of the
id (8 kB each on the driver, as bit sets). Every text is scored whole.

Defined results: null and empty texts have no features and get the score of the
intercept; null labels aren't learned; of several labels of a document the larger
counts; without any row of one class every score is the share of class 1 (0.5
without labels); rows that repeat an id are scored each; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharpsieve.llm.common import encoded
from sharpsieve.llm.ngrams import byte_grams, pieces, word_grams

DIM_BITS, MOST, ALPHA, PENALTY, EPOCHS, FOLDS, THRESHOLD = 16, 4000, 1.0, 1.0, 12, 4, 0.3
_SHIFT = np.uint64(64 - DIM_BITS)


def indicators(text: bytes) -> np.ndarray:
    """The features that a text has, in order."""
    flags = np.zeros(1 << DIM_BITS, bool)
    for part in pieces(text, 512):
        for n in (1, 2, 3, 4):
            flags[byte_grams(part, n) >> _SHIFT] = True
        words, pairs = word_grams(part.lower())
        same = words[1:] == words[:-1]
        for grams in (words, pairs, *(byte_grams(same.tobytes(), n) for n in range(1, 7))):
            flags[grams >> _SHIFT] = True
    return np.flatnonzero(flags)


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, ids: np.ndarray) -> float:
        r = self.ratio[ids]
        norm = np.sqrt(np.dot(r, r))
        return float(np.dot(r, self.weight[ids]) / norm + self.bias) if norm > 0 else self.bias

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(indicators(text)) + self.offset, -35, 35))))


def ratios(rows: list[np.ndarray], labels: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """Class log-count ratios of the indicators; 2 * alpha is dealt to the classes by their sizes, so what no row has gets 0."""
    counts = [np.zeros(1 << DIM_BITS) for _ in range(2)]
    for ids, y in zip(rows, labels, strict=True):
        counts[int(y)][ids] += 1
    sums = [max(c.sum(), 1e-9) for c in counts]
    logs = [np.log((c + 2 * alpha * n / sum(sums)) / n) for c, n in zip(counts, sums, strict=True)]
    return logs[1] - logs[0]


def descend(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, penalty: float = PENALTY, epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss with squared norm; the intercept is a feature of value 1. Both classes weigh alike."""
    sign = np.where(labels > 0, 1.0, -1.0)
    upper = np.where(labels > 0, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9)) * penalty
    diagonal = np.array([float(np.dot(v, v)) + 1 for v in values])
    weight, bias, alpha, rng = np.zeros(1 << DIM_BITS), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            slope = sign[i] * (np.dot(weight[rows[i]], values[i]) + bias) - 1
            new = min(max(alpha[i] - slope / diagonal[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weight[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return weight, bias


def _parts(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    """Views of one array, as long as the arrays of `like`: one allocation, given back to the system as a whole."""
    ends = np.cumsum([len(x) for x in like])
    return [flat[end - len(x) : end] for end, x in zip(ends, like, strict=True)]


def _fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    ratio = ratios(rows, labels).astype(np.float32)
    values = _parts(np.empty(sum(map(len, rows)), np.float32), rows)
    for x, v in zip(rows, values, strict=True):
        np.take(ratio, x, out=v)
        n = np.sqrt(np.dot(v, v))
        if n > 0:
            v /= n
    ratio = ratio.astype(np.float64)
    return Model(ratio, *descend(rows, values, labels), 1.0, 0.0)


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit with smoothed targets (Platt), by Newton's method."""
    goal = np.where(labels > 0, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    x, theta = np.column_stack((margins, np.ones(len(margins)))), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - goal))
        theta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS) -> Model:
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(np.zeros(1 << DIM_BITS), np.zeros(1 << DIM_BITS), 0.0, 0.0, float(np.log(share / (1 - share))))
    model, margins = _fit(rows, labels), np.full(len(labels), np.nan)
    for k in range(folds):
        test = np.arange(len(labels)) % folds == k
        if labels[~test].size and labels[~test].min() != labels[~test].max():
            part = _fit([rows[i] for i in np.flatnonzero(~test)], labels[~test])
            margins[test] = [part.margin(rows[i]) for i in np.flatnonzero(test)]
    seen = ~np.isnan(margins)
    if seen.any() and labels[seen].min() != labels[seen].max():
        model.slope, model.offset = _logistic(margins[seen], labels[seen])
    return model


def train(docs: DataFrame, labels: DataFrame, *, learn: Column | None = None, label_col: str = "quality", most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """learn: which ids of labels may be learned (default: all)."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = chosen if learn is None else chosen.where(learn)
    chosen = chosen.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    chosen = chosen.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in encoded(batches):
            sets = []
            for x in found:
                flags = np.zeros(1 << DIM_BITS, bool)
                flags[indicators(x)] = True
                sets.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), batch.column("label"), batch.column("h")], names=["bits", "label", "h"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    rows = texts.join(F.broadcast(chosen), "id").select("_text", "label", F.xxhash64("id", "_text").alias("h"))
    got = rows.mapInArrow(run, "bits binary, label int, h long").orderBy("h", "bits").limit(2 * most).collect()  # more than `most` only where ids repeat
    sets, truth = [np.frombuffer(r.bits, np.uint8) for r in got], np.array([r.label for r in got], float)
    del got
    sizes = [int(np.bitwise_count(x).sum()) for x in sets]
    found = _parts(np.empty(sum(sizes), np.uint16), [range(n) for n in sizes])
    for x, own in zip(sets, found, strict=True):
        own[:] = np.flatnonzero(np.unpackbits(x))
    del sets
    return fit(found, truth)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score: a row for each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in encoded(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sent.value.score(x) for x in found], pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).mapInArrow(run, f"id {kind}, score double")


def keep_good(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of threshold or more, unchanged."""
    sent, spot = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(spot).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([sent.value.score(x or b"") >= threshold for x in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
