"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A text's UTF-8 bytes are cut into windows of 48 (the last filled with zeros, which don't count). In each window a gated recurrent unit runs forward and another backward; a softmax over both states labels every byte; a document's probabilities are the mean over its bytes. A text that is null or has no letter (Unicode category L) is `und` with score 0. Without a labelled document every text is `und`. Repeated doc_ids get a row each; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, documents, fold_of, map_arrow, spread, text_bytes
from .learn import bounded

WIDTH, HIDDEN, FOLDS, HELD_OUT, SAMPLE = 48, 8, 4, 2, 2000
_WORD_SIGN = re.compile(r"[^\W\d_]")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"

Params = dict[str, np.ndarray]


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode's category L; numbers such as ² or ½ are signs of words, but no letters."""
    return any(m[0].isalpha() for m in _WORD_SIGN.finditer(text))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(WIDTH, n) bytes, how many of each window count, and its text."""
    per = np.array([-(-len(t) // WIDTH) for t in texts], np.int64)
    data = np.frombuffer(b"".join(t + bytes(-len(t) % WIDTH) for t in texts), np.uint8).reshape(-1, WIDTH)
    owner = np.repeat(np.arange(len(texts)), per)
    size = np.full(len(owner), WIDTH)
    last = np.cumsum(per)[per > 0] - 1
    size[last] = [(len(t) - 1) % WIDTH + 1 for t in texts if t]
    return np.ascontiguousarray(data.T), size, owner


def start(languages: int, seed: int = 5) -> Params:
    rng = np.random.default_rng(seed)
    p = {"v": rng.normal(0, 0.3, (languages, 2 * HIDDEN)), "c": np.zeros((languages, 1))}
    for d in "fb":
        p |= {f"x{d}": rng.normal(0, 0.4, (3 * HIDDEN, 256)), f"u{d}": rng.normal(0, 0.4, (3 * HIDDEN, HIDDEN)), f"n{d}": np.zeros((HIDDEN, 1))}
    return {k: a.astype(np.float32) for k, a in p.items()}


def run(p: Params, d: str, x: np.ndarray, trace: bool = False):
    """States (WIDTH, HIDDEN, n) of one direction; trace: also what the backward pass needs.

    Gates: r, z = sigmoid(x + u h); candidate m = tanh(x + r (u h + n)); h = m + z (h - m). A sigmoid is taken from tanh.
    """
    n, k = x.shape[1], HIDDEN
    h, out, kept = np.zeros((k, n), np.float32), np.empty((WIDTH, k, n), np.float32), []
    xs, u, bias = p[f"x{d}"], p[f"u{d}"], p[f"n{d}"]
    for t in range(WIDTH) if d == "f" else range(WIDTH - 1, -1, -1):
        a = xs.take(x[t], axis=1)
        q = u @ h
        rz = a[: 2 * k]
        rz += q[: 2 * k]
        rz *= np.float32(0.5)
        np.tanh(rz, out=rz)
        rz *= np.float32(0.5)
        rz += np.float32(0.5)
        q = q[2 * k :]
        q += bias
        m = np.multiply(rz[:k], q, out=None if trace else q)
        m += a[2 * k :]
        np.tanh(m, out=m)
        if trace:
            kept.append((t, h, rz, q, m))
        new = h - m
        new *= rz[k:]
        new += m
        h = new
        out[t] = h
    return (out, kept) if trace else out


def position_probabilities(p: Params, x: np.ndarray) -> np.ndarray:
    """(WIDTH, languages, n)"""
    k = HIDDEN
    z = np.matmul(p["v"][:, :k], run(p, "f", x)) + np.matmul(p["v"][:, k:], run(p, "b", x)) + p["c"]
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def gradients(p: Params, x: np.ndarray, size: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, Params]:
    """Mean cross-entropy over the bytes that count, and its gradients by backpropagation through time."""
    k, n = HIDDEN, x.shape[1]
    hf, kf = run(p, "f", x, True)
    hb, kb = run(p, "b", x, True)
    both = np.concatenate([hf, hb], 1)
    z = np.matmul(p["v"], both) + p["c"]
    z -= z.max(1, keepdims=True)
    prob = np.exp(z)
    prob /= prob.sum(1, keepdims=True)
    counts = (np.arange(WIDTH)[:, None] < size) * weight
    counts = (counts / counts.sum()).astype(np.float32)
    cols = np.arange(n)
    loss = float(-(np.log(prob[:, label, cols] + 1e-9) * counts).sum())
    prob[:, label, cols] -= 1
    dz = prob * counts[:, None, :]
    g = {"v": np.einsum("tln,tkn->lk", dz, both), "c": dz.sum((0, 2))[:, None]}
    dh_all = np.matmul(p["v"].T, dz)
    for d, kept, part in (("f", kf, slice(0, k)), ("b", kb, slice(k, 2 * k))):
        gx, gu, gn = np.zeros_like(p[f"x{d}"]), np.zeros_like(p[f"u{d}"]), np.zeros_like(p[f"n{d}"])
        u, dh = p[f"u{d}"], np.zeros((k, n), np.float32)
        for t, h, rz, q, m in reversed(kept):
            dh = dh + dh_all[t, part]
            r, zt = rz[:k], rz[k:]
            dm = dh * (1 - zt) * (1 - m * m)
            dzt = dh * (h - m) * zt * (1 - zt)
            dq = dm * r
            dr = dm * q * r * (1 - r)
            da = np.concatenate([dr, dzt, dm])
            back = np.concatenate([dr, dzt, dq])
            gu += back @ h.T
            gn += dq.sum(1, keepdims=True)
            for row in range(3 * k):
                gx[row] += np.bincount(x[t], da[row], 256).astype(np.float32)
            dh = dh * zt + u.T @ back
        g |= {f"x{d}": gx, f"u{d}": gu, f"n{d}": gn}
    return loss, g


def fit(texts: list[bytes], langs: list[str], steps: int = 260, batch: int = 384, rate: float = 0.02, seed: int = 5) -> tuple[list[str], Params]:
    names = sorted(set(langs))
    texts_langs = [(t, names.index(y)) for t, y in zip(texts, langs, strict=True) if t]
    if not texts_langs:
        return [], {}
    p = start(len(names), seed)
    x, size, owner = windows([t for t, _ in texts_langs])
    label = np.array([y for _, y in texts_langs])[owner]
    share = np.bincount(label, minlength=len(names)) / len(label)
    rng = np.random.default_rng(seed)
    odds = 1 / np.sqrt(share[label])
    odds /= odds.sum()
    order = rng.choice(len(label), steps * batch, p=odds)  # rarer languages more often
    weight = (1 / np.sqrt(np.maximum(share, 1e-9)))[label]
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    for step in range(1, steps + 1):
        rows = order[(step - 1) * batch : step * batch]
        _, g = gradients(p, x[:, rows], size[rows], label[rows], weight[rows])
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        now = rate * (1 - step / (steps + 1))
        for k, a in g.items():
            a = a * np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            p[k] = (p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return names, p


def predict(names: list[str], p: Params, texts: list[bytes], block: int = 4096) -> np.ndarray:
    """(texts, languages) mean probabilities; zeros for an empty text."""
    x, size, owner = windows(texts)
    out = np.zeros((len(texts), len(names)))
    for k in range(0, x.shape[1], block):
        part = slice(k, k + block)
        prob = position_probabilities(p, x[:, part])
        if (size[part] < WIDTH).any():
            prob *= (np.arange(WIDTH)[:, None] < size[part])[:, None, :]
        total = prob.sum(0)
        for j in range(len(names)):
            out[:, j] += np.bincount(owner[part], total[j], len(texts))
    return out / np.maximum(np.bincount(owner, size, len(texts)), 1)[:, None]


def trained(docs: DataFrame, bound: int = SAMPLE) -> tuple[list[str], Params]:
    """Fitted on at most `bound` documents (and learn.SAMPLE_BYTES) outside the held-out fold whose language is known, in the order of a hash of their id."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(crc_of_id(F.col("doc_id")), F.lit(FOLDS)) != HELD_OUT))
    chosen = known.select("doc_id", "lang").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(bound)
    sample = bounded(known.where("text is not null"), chosen, "lang")
    return fit([t.encode() for t in sample["text"]], sample["lang"].tolist())


def language_scores(docs: DataFrame, names: list[str], p: Params) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((names, p))  # of fixed size

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, p = shared.value
        texts = text_bytes(batch.column("text"))
        found: dict[bytes, tuple[str, float]] = {t: ("und", 0.0) for t in texts}
        lettered = [t for t in found if has_letter(t.decode())]
        if names and lettered:
            prob = predict(names, p, lettered)
            for t, row in zip(lettered, prob, strict=True):
                j = int(row.argmax())
                found[t] = (names[j], min(1.0, float(row[j])))
        out = [found[t] for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fold_of(batch.column("doc_id"), FOLDS) == HELD_OUT), pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(docs.select("doc_id", "text"), one, SCHEMA)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    return language_scores(spread(docs.drop("lang")), *trained(docs))
