"""Onion clustering: states are peeled off a series' distribution, one Gaussian at a time.

Data not yet assigned give a histogram; its tallest peak is fitted by a Gaussian; windows (or, in the smooth variant, runs of at least delta_t frames) that stay within `sigmas` standard deviations of its mean all the time are assigned and removed; this goes on until nothing is assigned. States that overlap are then merged, and bounds of neighbours meet where their densities cross. What is left is -1. Histograms and assignments are Spark aggregates; the driver sees histograms and states.

Details of binning, fitting and merging are this library's own.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, written


@dataclass
class State:
    """One dimension: numbers; more: lists (sigma is the covariance; th_inf and th_sup hold how far the ellipsoid reaches along each component)."""

    mean: float | list[float]
    sigma: float | list[list[float]]
    area: float
    r_2: float
    perc: float = 0.0
    peak: float = 0.0
    th_inf: list[float] = field(default_factory=list)
    th_sup: list[float] = field(default_factory=list)

    def as_dict(self) -> dict:
        return asdict(self)


def windows(series: DataFrame, delta_t: int) -> DataFrame:
    """Adds window, the number of each run of delta_t frames; a run that lacks a frame (as at the end) is dropped."""
    rows = series.withColumn("window", F.floor(F.col("frame") / delta_t).cast("int"))
    size = F.count(F.lit(1)).over(Window.partitionBy("particle_id", "window"))
    return rows.withColumn("size", size).where(F.col("size") == delta_t).drop("size")


def assign_windows(rows: DataFrame, inside, group: str = "window") -> DataFrame:
    """(particle_id, window) of the windows that lie inside throughout."""
    return rows.groupBy("particle_id", group).agg(F.bool_and(inside).alias("all")).where("all").drop("all")


def assign_runs(series: DataFrame, inside, delta_t: int) -> DataFrame:
    """(particle_id, frame) of the frames in runs of at least delta_t consecutive frames that lie inside: gaps and islands."""
    w = Window.partitionBy("particle_id").orderBy("frame")
    rows = series.select("particle_id", "frame", inside.alias("i")).where("i").withColumn("island", F.col("frame") - F.row_number().over(w))
    size = F.count(F.lit(1)).over(Window.partitionBy("particle_id", "island"))
    return rows.withColumn("size", size).where(F.col("size") >= delta_t).select("particle_id", "frame")


def histogram(rows: DataFrame, column: str, bins: int | str) -> tuple[np.ndarray, np.ndarray, int]:
    """(edges, counts, n), counts exact; 'auto' takes the wider of the Sturges and Freedman-Diaconis bins (512 at most), the quartiles from a fine histogram."""
    n, lo, hi = rows.agg(F.count(column), F.min(column), F.max(column)).first()
    if not n or lo == hi:
        return np.array([lo or 0.0, (hi or 0.0) + 1e-12]), np.array([n or 0]), n or 0

    def counts(k: int) -> np.ndarray:
        at = F.least(F.floor((F.col(column) - lo) / ((hi - lo) / k)), F.lit(k - 1)).cast("int")
        out = np.zeros(k, np.int64)
        for b, c in rows.groupBy(at.alias("b")).count().collect():  # a row per bin
            out[b] = c
        return out

    if bins == "auto":
        cum = np.cumsum(counts(4096)) / n
        iqr = (np.searchsorted(cum, 0.75) - np.searchsorted(cum, 0.25)) * (hi - lo) / 4096
        width = max(2 * iqr / n ** (1 / 3), (hi - lo) / 512)
        bins = int(max(math.ceil(math.log2(n) + 1), min(512, math.ceil((hi - lo) / width))))
    return np.linspace(lo, hi, bins + 1), counts(bins), n


def smoothed(counts: np.ndarray, least_bins: int = 21) -> np.ndarray:
    """Means over three bins, of histograms with least_bins or more: fewer would lose their peaks."""
    c = np.pad(counts.astype(float), 1, mode="edge")
    return (c[:-2] + c[1:-1] + c[2:]) / 3 if len(counts) >= least_bins else counts.astype(float)


def fit_peak(x: np.ndarray, y: np.ndarray) -> State | None:
    """Gaussian through the tallest peak of a density y at x, by Gauss and Newton's method over the bins down to half of it on either side (three at least)."""
    if len(x) < 3 or y.max() <= 0:
        return None
    top = int(y.argmax())
    lo = hi = top
    while lo > 0 and y[lo - 1] >= y[top] / 2 and y[lo - 1] <= y[lo] * 1.25:
        lo -= 1
    while hi < len(y) - 1 and y[hi + 1] >= y[top] / 2 and y[hi + 1] <= y[hi] * 1.25:
        hi += 1
    lo, hi = max(0, min(lo, top - 1)), min(len(y) - 1, max(hi, top + 1))
    px, py = x[lo : hi + 1], y[lo : hi + 1]
    step = x[1] - x[0]
    p = np.array([x[top], max((px[-1] - px[0]) / 2.355, step), y[top]])
    for _ in range(60):
        z = (px - p[0]) / p[1]
        g = np.exp(-z * z / 2)
        jac = np.column_stack([p[2] * g * z / p[1], p[2] * g * z * z / p[1], g])
        move = np.linalg.lstsq(jac.T @ jac + 1e-9 * np.diag((jac**2).sum(0) + 1e-12), jac.T @ (py - p[2] * g), rcond=None)[0]
        p = p + np.clip(move, -0.5 * np.abs(p) - step, 0.5 * np.abs(p) + step)
        p[1] = max(abs(p[1]), step / 4)
        if np.abs(move).max() < 1e-10 * (np.abs(p).max() + 1):
            break
    fitted = p[2] * np.exp(-(((px - p[0]) / p[1]) ** 2) / 2)
    spread = ((py - py.mean()) ** 2).sum()
    r2 = 1 - ((py - fitted) ** 2).sum() / spread if spread > 0 else 1.0
    if not np.isfinite(p).all() or p[0] < x[0] - step or p[0] > x[-1] + step:
        return None
    return State(float(p[0]), float(p[1]), float(p[2] * p[1] * math.sqrt(2 * math.pi)), float(r2), peak=float(p[2]))


def shared_area(a: State, b: State) -> float:
    """Area under both of two Gaussians of unit area."""
    lo, hi = min(a.mean - 5 * a.sigma, b.mean - 5 * b.sigma), max(a.mean + 5 * a.sigma, b.mean + 5 * b.sigma)
    x = np.linspace(lo, hi, 2001)
    g = [np.exp(-(((x - s.mean) / s.sigma) ** 2) / 2) / (s.sigma * math.sqrt(2 * math.pi)) for s in (a, b)]
    return float(np.minimum(*g).sum() * (x[1] - x[0]))


def crossing(a: State, b: State) -> float:
    """Where the densities of two states cross between their means; else the mean of these weighted by the sigmas."""
    x = np.linspace(a.mean, b.mean, 2001)
    d = [s.area / s.sigma * np.exp(-(((x - s.mean) / s.sigma) ** 2) / 2) for s in (a, b)]
    at = np.flatnonzero(np.diff(np.sign(d[0] - d[1])))
    return float(x[at[0]]) if len(at) else (a.mean * b.sigma + b.mean * a.sigma) / (a.sigma + b.sigma)


def settle(states: list[State], lo: float, hi: float, max_area_overlap: float = 0.8) -> list[State]:
    """Ordered by mean; of two that share more than the given part of their area the smaller is dropped; bounds meet at crossings."""
    kept: list[State] = []
    for s in sorted(states, key=lambda s: -s.area):
        if all(shared_area(s, k) <= max_area_overlap for k in kept):
            kept.append(s)
    kept.sort(key=lambda s: s.mean)
    cuts = [lo, *[crossing(a, b) for a, b in zip(kept, kept[1:], strict=False)], hi]
    for s, a, b in zip(kept, cuts, cuts[1:], strict=False):
        s.th_inf, s.th_sup = [a, 0.0 if a == lo else 1.0], [b, 2.0 if b == hi else 1.0]
    return kept


def onion(series: DataFrame, delta_t: int, bins: int | str = "auto", sigmas: float = 2.0, smooth: bool = False, max_area_overlap: float = 0.8, max_states: int | None = None, least_bins: int = 21) -> tuple[list[State], DataFrame]:
    """(states, labels). series(particle_id, frame, value) or, with several components, (.., vec). Labels are (particle_id, window, label) of windows of delta_t frames, or with smooth (particle_id, frame, label). max_states: peaks to fit at most; by default the search goes on until a peak assigns nothing. least_bins: bins from which histograms are smoothed."""
    if "vec" in series.columns:
        return _onion_vectors(series, delta_t, bins, sigmas, smooth, max_states, max_area_overlap)
    rows = written(series if smooth else windows(series, delta_t))
    key = "frame" if smooth else "window"
    total = rows.count()
    if not total:
        raise ValueError("the series is shorter than delta_t")
    lo, hi = rows.agg(F.min("value"), F.max("value")).first()
    states: list[State] = []
    left = rows

    def inside(a: float, b: float):
        return (F.col("value") >= a) & (F.col("value") <= b)

    def assigned(df: DataFrame, a: float, b: float) -> DataFrame:
        return assign_runs(df, inside(a, b), delta_t) if smooth else assign_windows(df, inside(a, b))

    while max_states is None or len(states) < max_states:
        edges, counts, n = histogram(left, "value", bins)
        if n < 2 or len(counts) < 3:
            break
        density = smoothed(counts, least_bins) / (n * (edges[1] - edges[0]))
        state = fit_peak((edges[:-1] + edges[1:]) / 2, density)
        if state is None:
            break
        found = assigned(left, state.mean - sigmas * state.sigma, state.mean + sigmas * state.sigma)
        rest = written(left.join(found, ["particle_id", key], "left_anti"))
        if left is not rows:
            discard(left)
        left = rest
        if rest.count() == n:
            break
        state.area *= n / total
        states.append(state)
    if left is not rows:
        discard(left)
    states = settle(states, lo, hi, max_area_overlap)
    parts = None
    for k, s in enumerate(states):
        a, b = max(s.mean - sigmas * s.sigma, s.th_inf[0]), min(s.mean + sigmas * s.sigma, s.th_sup[0])
        part = assigned(rows, a, b).withColumn("label", F.lit(k))
        parts = part if parts is None else parts.unionByName(part)
    every = rows.select("particle_id", key).distinct()
    if parts is None:
        return [], every.withColumn("label", F.lit(-1))
    best = parts.groupBy("particle_id", key).agg(F.min("label").alias("label"))
    labels = every.join(best, ["particle_id", key], "left").withColumn("label", F.coalesce("label", F.lit(-1)))
    shares = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    size = sum(shares.values())
    for k, s in enumerate(states):
        s.perc = shares.get(k, 0) / size
    return states, labels


def ellipsoid_overlap(a: State, b: State) -> float:
    """Share of two Gaussians' mass in common, from the distance of their means and their covariances (Bhattacharyya's coefficient)."""
    p, q = np.array(a.sigma), np.array(b.sigma)
    both = (p + q) / 2
    gap = np.array(a.mean) - np.array(b.mean)
    d = gap @ np.linalg.solve(both, gap) / 8 + 0.5 * math.log(np.linalg.det(both) / math.sqrt(np.linalg.det(p) * np.linalg.det(q)))
    return math.exp(-d)


def _onion_vectors(series: DataFrame, delta_t: int, bins: int | str, sigmas: float, smooth: bool, max_states: int | None, max_overlap: float) -> tuple[list[State], DataFrame]:
    """Several components: the peak is the fullest cell of a grid, the Gaussian has the mean and covariance of the points around it (made wider, as a cut-out understates them), and inside is the ellipsoid within `sigmas` Mahalanobis distances. A state that shares more than max_overlap with an earlier one is part of it. State.sigma holds the covariance."""
    dims = series.select(F.size("vec")).first()[0]
    split = series.select("particle_id", "frame", *[F.col("vec")[k].alias(f"v{k}") for k in range(dims)])
    rows = written(split if smooth else windows(split, delta_t))
    key = "frame" if smooth else "window"
    names = [f"v{k}" for k in range(dims)]
    span = rows.agg(*[f(c) for c in names for f in (F.min, F.max)]).first()
    total = rows.count()
    if not total:
        raise ValueError("the series is shorter than delta_t")
    side = 20 if bins == "auto" else int(bins)
    width = [max(b - a, 1e-12) / side for a, b in zip(span[::2], span[1::2], strict=True)]

    def moments(df: DataFrame, where) -> tuple[float, np.ndarray, np.ndarray]:
        m = df.where(where).agg(F.count(F.lit(1)), *[F.avg(c) for c in names], *[F.covar_pop(a, b) for a in names for b in names]).first()
        return m[0], np.array(m[1 : dims + 1], float), np.array(m[dims + 1 :], float).reshape(dims, dims)

    def within(mean: np.ndarray, cov: np.ndarray, reach: float):
        inverse = np.linalg.inv(cov)
        gaps = [F.col(c) - float(a) for c, a in zip(names, mean, strict=True)]
        return sum((gaps[i] * gaps[j] * float(inverse[i, j]) for i in range(dims) for j in range(dims)), F.lit(0.0)) <= reach * reach

    floor = np.diag([(w / 4) ** 2 for w in width])
    states, left, parts = [], rows, None
    while True:
        cell = [F.least(F.floor((F.col(c) - a) / w), F.lit(side - 1)).cast("int").alias(f"g{k}") for k, (c, a, w) in enumerate(zip(names, span[::2], width, strict=True))]
        top = left.groupBy(*cell).count().orderBy(F.desc("count"), *[f"g{k}" for k in range(dims)]).first()
        if top is None:
            break
        near = F.lit(True)
        for k, (c, a, w) in enumerate(zip(names, span[::2], width, strict=True)):
            near = near & (F.abs((F.col(c) - a) / w - (top[k] + 0.5)) <= 2.5)
        _, mean, cov = moments(left, near)
        cov = cov + floor
        for _ in range(3):  # from the box to the ellipsoid that the points themselves make
            n, m, c = moments(left, within(mean, cov, 2.0))
            if n < 2 * dims:
                break
            mean, cov = m, c * 1.3 + floor
        inside = within(mean, cov, sigmas)
        found = written(assign_runs(left, inside, delta_t) if smooth else assign_windows(left, inside))
        taken = left.join(found, ["particle_id", key], "left_semi").count()
        if not taken:
            break
        axes = [sigmas * math.sqrt(x) for x in np.diag(cov)]
        state = State(mean.tolist(), cov.tolist(), taken / total, 1.0, taken / total, float(top["count"]), axes, axes)
        same = [k for k, s in enumerate(states) if ellipsoid_overlap(s, state) > max_overlap]
        if not same:
            if max_states is not None and len(states) >= max_states:
                break
            states.append(state)
        part = found.withColumn("label", F.lit(same[0] if same else len(states) - 1))
        parts = part if parts is None else parts.unionByName(part)
        rest = written(left.join(found, ["particle_id", key], "left_anti"))
        if left is not rows:
            discard(left)
        left = rest
    every = rows.select("particle_id", key).distinct()
    if parts is None:
        return [], every.withColumn("label", F.lit(-1))
    best = parts.groupBy("particle_id", key).agg(F.min("label").alias("label"))
    labels = every.join(best, ["particle_id", key], "left").withColumn("label", F.coalesce("label", F.lit(-1)))
    shares = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    for k, s in enumerate(states):
        s.perc = shares.get(k, 0) / sum(shares.values())
    return states, labels


def delays(n_frames: int, least: int = 1, most: int | None = None, num: int = 20) -> list[int]:
    """Distinct whole numbers of a geometric series."""
    return sorted({int(x) for x in np.geomspace(least, most or n_frames, num)})


def onion_scan(series: DataFrame, least: int = 1, most: int | None = None, num: int = 20, bins: int | str = "auto", sigmas: float = 3.0, max_area_overlap: float = 0.8) -> tuple[dict[int, list[State]], DataFrame]:
    """Smooth clustering at each delta_t: (states by delta_t, labels (particle_id, frame, delta_t, label))."""
    n = series.select("frame").distinct().count()
    states, out = {}, None
    for dt in delays(n, least, most, num):
        states[dt], labels = onion(series, dt, bins, sigmas, True, max_area_overlap)
        labels = labels.withColumn("delta_t", F.lit(dt)).select("particle_id", "frame", "delta_t", "label")
        out = labels if out is None else out.unionByName(labels)
    return states, out
