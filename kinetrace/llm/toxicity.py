"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a run of letters and digits, lower-cased; its vector is the mean of the vectors of its character n-grams (3 to 5, with marks for its ends), so a misspelling that was never seen shares most of them. A passage of 32 words is the mean of its words' vectors (a shorter one counts as filled up with zero vectors); a linear softmax gives its classes; a document is as toxic as its most toxic passage, wherever that starts, so a long clean document isn't mistaken for the insults' dilution and no cut parts two insults that stand close together. Embeddings and softmax are fitted together by Adam on the passages that decide. n-grams keep a zero vector unless three training documents hold them, toxic ones twice as often and three standard deviations more often than others: with far more n-grams than documents, a free fit would learn the documents instead.

Empty and null texts have the score of an empty passage. Without labelled documents of both classes every score is the share of toxic ones (0 without any). Repeated doc_ids get a row each; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, fold_of, free_shuffles, map_arrow, mix64, spread
from .learn import SCORES, labelled_sample, labels_of, scored

BUCKETS, DIM, SEGMENT, SIZES = 1 << 17, 8, 32, (3, 4, 5)
FOLDS = 5
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of each word, and the word's index: n-grams never cross words."""
    marked = "".join(f"<{w}>" for w in words)
    code = np.frombuffer(marked.encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    buckets, owners = [], []
    for n in SIZES:
        if len(code) < n:
            continue
        inside = owner[: len(code) - n + 1] == owner[n - 1 :]
        h = np.zeros(len(inside), np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + code[k : k + len(h)]
        buckets.append((mix64(h[inside] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[: len(inside)][inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def segments(lengths: np.ndarray, stride: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Where each passage starts among all words, and its document; every document has one at least. A stride of 1 gives every run of 32 words."""
    per = np.maximum(-(-(lengths - SEGMENT) // stride), 0) + 1
    doc = np.repeat(np.arange(len(lengths)), per)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    return np.repeat(np.cumsum(lengths) - lengths, per) + within * stride, doc


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the values from each start to its end."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[ends] - total[starts]


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start up to its end, one after the other, and how many each has."""
    n = ends - starts
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum()), n


def changing(hot: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all runs of 32 words, those that open a document or hold other hot words than the run a word before, as segments() gives them. hot: sorted places among all words."""
    end = np.cumsum(lengths)
    begin = end - lengths
    of = np.searchsorted(end, hot, side="right")
    places = np.stack([np.concatenate([begin, hot - SEGMENT + 1, hot + 1]), np.concatenate([np.arange(len(lengths)), of, of])])
    places[0] = np.clip(places[0], begin[places[1]], np.maximum(end - SEGMENT, begin)[places[1]])
    doc, start = np.unique(places[::-1], axis=1)
    return start, doc


class Toxicity:
    """word score: the difference of the two logits that a word's mean vector gives."""

    def __init__(self, bucket_score: np.ndarray, bias: float) -> None:
        self.bucket_score, self.bias = bucket_score, bias
        self.cache: dict[str, float] = {}

    def word_scores(self, words: list[str]) -> np.ndarray:
        buckets, owner = subwords(words)
        n = np.bincount(owner, minlength=len(words))
        return np.bincount(owner, self.bucket_score[buckets], len(words)) / np.maximum(n, 1)

    def score(self, texts: list[str]) -> np.ndarray:
        docs = [words_of(t) for t in texts]
        if len(self.cache) > 200_000:
            self.cache = {}
        cache = self.cache
        new = [w for w in set().union(*docs) if w not in cache]
        cache.update(zip(new, self.word_scores(new).tolist(), strict=True))
        values = np.array([cache[w] for d in docs for w in d])
        lengths = np.array([len(d) for d in docs], np.int64)
        starts, doc = segments(lengths, 1)
        logit = self.bias + sums(values, starts, np.minimum(starts + SEGMENT, np.cumsum(lengths)[doc])) / SEGMENT
        best = np.maximum.reduceat(logit, np.searchsorted(doc, np.arange(len(docs)))) if docs else logit
        return 1 / (1 + np.exp(-np.clip(best, -30, 30)))


def gradients(params: tuple[np.ndarray, ...], gram: np.ndarray, part: np.ndarray, passage: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted cross-entropy of the deciding passages, and its gradients by embeddings, softmax and bias. gram, part, passage: each n-gram of a passage and its share of the passage's mean."""
    e, w, b = params
    n = len(labels)
    bag = np.stack([np.bincount(passage, part * e[gram, k], n) for k in range(e.shape[1])], 1)
    z = bag @ w + b
    z -= z.max(1, keepdims=True)
    prob = np.exp(z)
    prob /= prob.sum(1, keepdims=True)
    loss = -float((weight * np.log(prob[np.arange(n), labels] + 1e-300)).sum())
    prob[np.arange(n), labels] -= 1
    g = prob * weight[:, None]
    back = g @ w.T
    ge = np.stack([np.bincount(gram, part * back[passage, k], len(e)) for k in range(e.shape[1])], 1)
    return loss, ge, bag.T @ g, g.sum(0)


def fit(texts: list[str], labels: np.ndarray, epochs: int = 400, rate: float = 0.05, positive: float = 6.0, decay: float = 2e-6, min_docs: int = 3, ratio: float = 2.0, surprise: float = 3.0, seed: int = 7) -> Toxicity:
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Toxicity(np.zeros(BUCKETS), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    vocabulary: dict[str, int] = {}
    each = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int32) for t in texts]
    lengths, ids = np.array([len(x) for x in each], np.int64), np.concatenate(each)
    names, parts, counts = list(vocabulary), [], []
    for k in range(0, len(names), 20_000):
        part, of = subwords(names[k : k + 20_000])
        parts.append(part[np.argsort(of, kind="stable")].astype(np.int32))
        counts.append(np.bincount(of, minlength=len(names[k : k + 20_000])))
    buckets, grams = np.concatenate(parts or [np.zeros(0, np.int32)]), np.concatenate(counts or [np.zeros(0, np.int64)])
    first = np.append(0, np.cumsum(grams))
    owner = np.repeat(np.arange(len(names), dtype=np.int32), grams)
    grams = np.maximum(grams, 1)

    seen = np.zeros((2, BUCKETS), np.int64)
    at = 0
    for n, y in zip(lengths, labels, strict=True):
        mine = np.unique(ids[at : at + n])
        seen[y, np.unique(np.concatenate([buckets[first[w] : first[w + 1]] for w in mine] or [np.zeros(0, np.int64)]))] += 1
        at += n
    bad, good = seen[1] / (labels == 1).sum(), seen[0] / (labels == 0).sum()
    both = (seen[0] + seen[1]) / len(labels)
    spread = np.sqrt(both * (1 - both) * (1 / (labels == 1).sum() + 1 / (labels == 0).sum())) + 1e-12
    known = (seen.sum(0) >= min_docs) & (bad >= ratio * good) & ((bad - good) / spread >= surprise)
    used = np.flatnonzero(known)
    keep = known[buckets]  # the rest would add zeros
    buckets, owner = np.searchsorted(used, buckets[keep]), owner[keep]
    first = np.searchsorted(owner, np.arange(len(vocabulary) + 1))

    # words with such n-grams, and the passages that differ in them
    hot = np.flatnonzero(np.diff(first)[ids] > 0)
    word_at = ids[hot]
    starts, doc = changing(hot, lengths)
    lo, hi = np.searchsorted(hot, starts), np.searchsorted(hot, np.minimum(starts + SEGMENT, np.cumsum(lengths)[doc]))
    part = 1 / (grams * SEGMENT)
    opens = np.searchsorted(doc, np.arange(len(lengths)))

    rng = np.random.default_rng(seed)
    e, w, b = rng.normal(0, 0.1, (len(used), DIM)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    m, v = [np.zeros_like(p) for p in (e, w, b)], [np.zeros_like(p) for p in (e, w, b)]
    weight = np.where(labels == 1, positive, 1.0)
    weight /= weight.sum()
    for step in range(1, epochs + 1):
        logit = sums((np.bincount(owner, (e @ (w[:, 1] - w[:, 0]))[buckets], len(part)) * part)[word_at], lo, hi)
        lead = np.flatnonzero(logit == np.maximum.reduceat(logit, opens)[doc])
        lead = lead[np.append(True, np.diff(doc[lead]) > 0)]  # the deciding passage of each document, the first of equals
        at, n = runs(lo[lead], hi[lead])
        words = word_at[at]
        pick, m_ = runs(first[words], first[words + 1])
        g_, p_, r_ = buckets[pick], np.repeat(part[words], m_), np.repeat(np.repeat(np.arange(len(lead)), n), m_)
        _, ge, gw, gb = gradients((e, w, b), g_, p_, r_, labels, weight)
        for k, (value, grad) in enumerate(((e, ge), (w, gw + 1e-4 * w), (b, gb))):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad**2
            value -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7) + decay * value
    score = np.zeros(BUCKETS)
    score[used] = e @ (w[:, 1] - w[:, 0])
    return Toxicity(score, float(b[1] - b[0]))


def trained(docs: DataFrame, labels: DataFrame) -> Toxicity:
    sample = labelled_sample(docs, labels, "toxic", FOLDS, 0)
    model = fit(sample["text"].tolist(), sample["label"].to_numpy(np.int64))
    del sample
    free_shuffles(docs.sparkSession)
    return model


def toxicity_scores(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, from the whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bucket_score, model.bias))  # a table of fixed size
    local: list[Toxicity] = []

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not local:
            local.append(Toxicity(*shared.value))
        score = local[0].score([x or "" for x in batch.column("text").to_pylist()])
        yield scored(batch, score, fold_of(batch.column("doc_id"), FOLDS) == 0, 0.5)

    return map_arrow(docs.select("doc_id", "text"), one, SCORES)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return toxicity_scores(spread(docs), trained(docs, labels_of(spark, sf_dir)))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents (all their columns) that the model doesn't call toxic. A row is kept or dropped by its own text."""
    model = trained(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model.bucket_score, model.bias))
    local: list[Toxicity] = []

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not local:
            local.append(Toxicity(*shared.value))
        yield batch.filter(pa.array(local[0].score([x or "" for x in batch.column("text").to_pylist()]) < 0.5))

    return map_arrow(docs, one, docs.schema)
