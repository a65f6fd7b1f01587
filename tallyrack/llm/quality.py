"""Quality by Bradley-Terry pairwise ranking (operator 10).

A document's score is a sum of weights over its binned features.  The weights are learned from preference pairs, a
document that labels mark good against one that they don't, by logistic loss on the difference of their features.
The score's threshold is the quantile of training scores that cuts off the share of bad labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, checkpoint, documents, held_out, slices, table, texts

#: At most so many labelled documents, least by hash, and preference pairs of them.
SAMPLE_DOCS, SAMPLE_PAIRS, BINS = 8000, 60_000, 12

_PUNCTUATION = np.array([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
#: Features of a text: eleven general ones, then each punctuation mark's share.
FEATURES = 11 + len(_PUNCTUATION)


def features(text: bytes) -> np.ndarray:
    """Of the whole text; all zero for an empty one."""
    out = np.zeros(FEATURES, np.float32)
    if not text:
        return out
    of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n, size = max(1, len(words)), len(text)
    lines = text.split(b"\n")
    upper, lower = of[65:91].sum(), of[97:123].sum()
    out[:11] = (
        np.log1p(size), np.log1p(len(words)), len(set(words)) / n, sum(map(eq, words, words[1:])) / n, size / n,
        len(lines) / n, len(set(lines)) / len(lines), upper / max(1, upper + lower), of[48:58].sum() / size, of[128:].sum() / size, of[:32].sum() / size,
    )
    out[11:] = of[_PUNCTUATION] / n
    return out


def feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features as little-endian floats, in the order of FEATURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [features(x).astype("<f4").tobytes() for x in texts(part.column("text"))]
            yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "x": pa.array(found, pa.binary())})

    return documents(docs, "doc_id", "text").mapInArrow(run, "doc_id long, x binary")


class Ranker:
    """Feature bins' weights, the threshold and the scale of the scores."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, threshold: float, scale: float) -> None:
        self.edges, self.weights, self.threshold, self.scale = edges, weights, threshold, scale

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        return self.weights[np.arange(bins.shape[1]), bins].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) * self.scale, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, steps: int = 150, penalty: float = 1e-4, seed: int = 4) -> Ranker:
    """Without both labels every score is one half."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(FEATURES)]
    # a feature that is rarely there has no quantiles: any more than the least value is a bin of its own
    edges = [np.unique(np.append(e, np.nextafter(x[:, k].min(), np.float32(np.inf), dtype=np.float32))) if len(x) else e for k, e in enumerate(edges)]
    ranker = Ranker(edges, np.zeros((FEATURES, BINS + 2)), 0.0, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return ranker
    r, bins = np.random.default_rng(seed), ranker.bins(x)
    wide = np.zeros((len(x), FEATURES * (BINS + 2)), np.float32)
    wide[np.arange(len(x))[:, None], np.arange(FEATURES) * (BINS + 2) + bins] = 1
    pairs = np.stack([r.choice(good, SAMPLE_PAIRS), r.choice(bad, SAMPLE_PAIRS)])
    w = np.zeros(wide.shape[1], np.float32)
    speed = np.zeros_like(w)
    for step in range(steps):
        s = wide @ w
        lost = 1 / (1 + np.exp(np.clip(s[pairs[0]] - s[pairs[1]], -30, 30)))
        pull = (np.bincount(pairs[0], lost, len(x)) - np.bincount(pairs[1], lost, len(x))) / SAMPLE_PAIRS
        speed = 0.9 * speed + pull.astype(np.float32) @ wide - penalty * w
        w += np.float32(3.0 * (1 - step / steps)) * speed
    ranker.weights = w.reshape(FEATURES, -1)
    s = np.sort(ranker.raw(x))
    cut = len(bad)
    ranker.threshold = float((s[cut - 1] + s[cut]) / 2)
    z, t = ranker.raw(x) - ranker.threshold, 2.0 * y - 1
    scales = np.geomspace(0.05, 20, 60)
    ranker.scale = float(scales[np.argmin([np.logaddexp(0, -np.clip(k * z * t, -50, 50)).mean() + 1e-4 * k for k in scales])])
    return ranker


def train(rows: DataFrame, labels: DataFrame) -> Ranker:
    """rows: feature_rows; labels: (doc_id, quality).  Labels of held-out documents are not read; a document with
    several labels has their largest."""
    known = documents(labels, "doc_id", "quality").filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    least = bounded_sample(rows.join(known, "doc_id").select("x", "quality", "doc_id"), known.count(), SAMPLE_DOCS, "doc_id")
    x = np.array([np.frombuffer(r.x, "<f4") for r in least], np.float32).reshape(-1, FEATURES)
    return fit(x, np.array([int(r.quality > 0) for r in least]))


def rank(rows: DataFrame, ranker: Ranker) -> DataFrame:
    """feature_rows -> (doc_id, score, predicted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(v.as_py() for v in batch.column("x")), "<f4").reshape(-1, FEATURES)
            score = ranker.score(x) if len(x) else np.zeros(0)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(score, pa.float64()), "predicted": pa.array((score >= 0.5).astype(np.int32))})

    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents, labels -> (doc_id, score, predicted).  Null and empty texts have a score too; repeated rows stay."""
    rows = checkpoint(feature_rows(docs))
    return rank(rows, train(rows, labels))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")
