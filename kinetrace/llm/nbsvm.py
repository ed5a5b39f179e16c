"""Quality classifier: naive Bayes support vectors.

A text's n-grams are indicators, hashed: runs of three bytes (lower-cased), words and pairs of words. Four indicators that are no n-grams stand beside them: how large a share of its lines, words and five-word windows occurred before in it (in steps of a factor of two), and how many words it has, up to 40 (in fours). Each is scaled by the log-count ratio of the two classes, then a linear hinge-loss model is fitted by dual coordinate descent. A logistic curve through margins of documents left out of the fit turns margins into scores.

Empty and null texts have the indicators of an empty text. Without labelled documents of both classes every score is the share of good ones (1 without any). Repeated doc_ids get a row each; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, fold_of, gram_hashes, map_arrow, spread, text_bytes, word_hashes
from .learn import SCORES, labelled_sample, labels_of, scored

BITS, FOLDS, KEEP_AT = 18, 5, 0.3
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32


def _share(part: int, whole: int) -> int:
    """0 for none, else one more than the number of halvings from all down to the share, 9 at most counted from the top."""
    return 0 if not part else 10 - min(9, int(np.log2(whole / part)))


def indicators(text: bytes) -> np.ndarray:
    """Sorted distinct feature numbers of a text."""
    size = 1 << BITS
    words, start, _ = word_hashes(text, lower=True)
    byte = _LOWER[np.frombuffer(text, np.uint8)]
    tri = ((byte[:-2] << 16 | byte[1:-1] << 8 | byte[2:]) * 0x9E3779B1 >> 7) % size if len(byte) > 2 else byte[:0]
    fives = gram_hashes(words, 5)
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = (
        _share(len(lines) - len(set(lines)), len(lines)),
        _share(int((words[1:] == words[:-1]).sum()), len(words)),
        _share(len(fives) - len(np.unique(fives)), len(fives)),
        min(len(words), 40) // 4,
    )
    special = np.array([(0x51ED270B * (16 * k + r + 1) >> 3) % size for k, r in enumerate(repeats)], np.int64)
    pairs = gram_hashes(words, 2)
    return np.unique(np.concatenate([tri, (words % np.uint64(size)).astype(np.int64), (pairs % np.uint64(size)).astype(np.int64), special]))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    size = 1 << BITS
    p, q = np.ones(size), np.ones(size)
    for x, y in zip(rows, good, strict=True):
        (p if y else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], good: np.ndarray, scale: np.ndarray, cost: float = 0.1, sweeps: int = 6, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights (of unscaled indicators) and bias of the hinge-loss model, by coordinate descent on its dual; 0 <= alpha <= cost times the class's weight."""
    y = np.where(good, 1.0, -1.0)
    top = cost * np.where(good, len(good) / (2 * max(1, good.sum())), len(good) / (2 * max(1, (~good).sum())))
    norm = np.array([float(scale[x] @ scale[x]) + 1.0 for x in rows])
    alpha, w, bias = np.zeros(len(rows)), np.zeros(len(scale)), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(sweeps):
        for i in rng.permutation(len(rows)):
            x = rows[i]
            s = scale[x]
            slope = y[i] * (float(w[x] @ s) + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), top[i])
            if new != alpha[i]:
                d = (new - alpha[i]) * y[i]
                w[x] += d * s
                bias += d
                alpha[i] = new
    return w * scale, bias


def logistic(margin: np.ndarray, good: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset of P(good), by Newton's method with smoothed targets."""
    t = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        h = p * (1 - p)
        hess = np.array([[(h * margin**2).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(a), float(b)


class Quality:
    def __init__(self, weight: np.ndarray, bias: float, slope: float, offset: float) -> None:
        self.weight, self.bias, self.slope, self.offset = weight, bias, slope, offset

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([float(self.weight[x].sum()) + self.bias for x in rows])

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins([indicators(t) for t in texts]) + self.offset, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray) -> Quality:
    good = labels == 1
    if good.all() or not good.any():
        share = float(good.mean()) if len(good) else 1.0
        return Quality(np.zeros(1 << BITS), 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    rows = [indicators(t) for t in texts]
    margin = np.zeros(len(rows))
    for k in range(3):  # margins of documents that the fit didn't see
        out = np.arange(len(rows)) % 3 == k
        part = [r for r, o in zip(rows, out, strict=True) if not o]
        weight, bias = dual_descent(part, good[~out], log_count_ratios(part, good[~out]))
        margin[out] = [float(weight[r].sum()) + bias for r, o in zip(rows, out, strict=True) if o]
    slope, offset = logistic(margin, good)
    weight, bias = dual_descent(rows, good, log_count_ratios(rows, good))
    return Quality(weight, bias, slope, offset)


def quality_scores(docs: DataFrame, model: Quality) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, from the whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.slope, model.offset))  # of fixed size

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        score = Quality(*shared.value).score(text_bytes(batch.column("text")))
        yield scored(batch, score, fold_of(batch.column("doc_id"), FOLDS) == 0, KEEP_AT)

    return map_arrow(docs.select("doc_id", "text"), one, SCORES)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    sample = labelled_sample(docs, labels_of(spark, sf_dir), "quality", FOLDS, 0)
    return quality_scores(spread(docs), fit(text_bytes(pa.array(sample["text"])), sample["label"].to_numpy(np.int64)))
