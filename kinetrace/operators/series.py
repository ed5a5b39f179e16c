"""Time-series aggregations: correlations, slow linear modes, radial distribution, intrinsic dimension, extrema."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.select import selection as selected
from ..session import ship
from .neighbors import neighbor_edges
from .ranks import numbered


def centred(series: DataFrame) -> DataFrame:
    """(particle_id, f, d): the frames of each particle and its values there, less their mean. A particle's series is one row, so lags need no join; lengths may differ and frames may be missing."""
    rows = series.groupBy("particle_id").agg(F.array_sort(F.collect_list(F.struct("frame", F.col("value").cast("double").alias("value")))).alias("s"), F.avg("value").alias("m"))
    return rows.select("particle_id", F.transform("s", lambda x: x["frame"].cast("long")).alias("f"), F.transform(F.array("m"), lambda m: F.transform("s", lambda x: x["value"] - m))[0].alias("d"))


def autocorrelation(d: np.ndarray) -> np.ndarray:
    """Sum of d(t) d(t + lag) by lag, by a Fourier transform."""
    n = 1 << (2 * len(d) - 1).bit_length()
    return np.fft.irfft(np.abs(np.fft.rfft(d, n)) ** 2, n)[: len(d)]


def self_time_correlation(series: DataFrame, max_delay: int | None = None) -> DataFrame:
    """(lag, value, error) for lags 0 to max_delay - 1 (by default, all): mean over particles of their mean product of values `lag` frames apart, and its standard error; both over the value at lag 0. A particle counts at the lags that two of its frames have."""
    ship(series.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for frames, values in zip(b.column("f"), b.column("d"), strict=True):
                at = frames.values.to_numpy() - frames.values[0].as_py()
                d, there = np.zeros(int(at[-1]) + 1), np.zeros(int(at[-1]) + 1)
                d[at], there[at] = values.values.to_numpy(), 1.0
                pairs = np.rint(autocorrelation(there))[:max_delay]
                lag = np.flatnonzero(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(lag.astype(np.int32)), pa.array(autocorrelation(d)[lag] / pairs[lag])], ["lag", "s"])

    means = centred(series).select("f", "d").mapInArrow(run, "lag int, s double")
    by = means.groupBy("lag").agg(F.avg("s").alias("c"), (F.stddev_pop("s") / F.sqrt(F.count("s"))).alias("e"))
    zero = by.where("lag = 0").select(F.col("c").alias("zero"))
    return by.crossJoin(F.broadcast(zero)).select("lag", (F.col("c") / F.col("zero")).alias("value"), (F.col("e") / F.col("zero")).alias("error"))


def _summed(df: DataFrame, columns: list[str], partial, size: int, width: int) -> np.ndarray:
    """Sum over all tasks of what `partial` makes of a batch: a (size, width) array. Rows of it are added up by tasks before the driver gets the one array."""
    step = max(1, (1 << 17) // width)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, width))
        for b in batches:
            if b.num_rows:
                total += partial(b)
        for k in range(0, size, step):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k : k + step].tobytes()])], ["k", "part"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column("k").to_pylist(), b.column("part").to_pylist(), strict=True):
                x = np.frombuffer(part)
                total[k] = total[k] + x if k in total else x
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()])], ["k", "part"])

    ship(df.sparkSession)
    out = np.zeros((size, width))
    for k, part in df.select(*columns).mapInArrow(first, "k int, part binary").repartition("k").mapInArrow(second, "k int, part binary").collect():
        out[k : k + step] = np.frombuffer(part).reshape(-1, width)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def cross_time_correlation(series: DataFrame, max_delay: int | None = None, errors: bool = True) -> DataFrame:
    """(lag, value[, error]) over ordered pairs of different particles, not scaled by lag 0: the sum of all products of one's value and the other's `lag` frames later, over the number of such products; and the standard error of this ratio over pairs (of a mean, where all particles have the same frames).

    No pair of particles is formed. The sum follows from that of all particles by frame; the sums of squares from three frames-by-frames matrices (of values d and marks m of frames that are there: d d, d m, m m, each summed over particles) times themselves shifted along their diagonals; the particles' own terms are taken off. So the work is particles times frames squared, and with errors=False particles times frames.
    """
    rows = centred(series)
    n, first, last = rows.agg(F.count(F.lit(1)), F.min(F.element_at("f", 1)), F.max(F.element_at("f", -1))).first()
    schema = "lag int, value double" + ", error double" * errors
    if not n:
        return series.sparkSession.createDataFrame([], schema)
    frames = last - first + 1
    top = min(frames, max_delay or frames)
    square = 3 * frames if errors else 0

    def partial(b: pa.RecordBatch) -> np.ndarray:
        f, of = b.column("f"), np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("f")).to_numpy())
        d, m = np.zeros((2, b.num_rows, frames))
        at = f.flatten().to_numpy() - first
        d[of, at], m[of, at] = b.column("d").flatten().to_numpy(), 1.0
        own = np.zeros((7, frames))
        own[0], own[1] = d.sum(0), m.sum(0)
        for x, y in zip(d, m, strict=True):
            s, k = autocorrelation(x), np.rint(autocorrelation(y))
            own[2:] += [s, k, s * s, s * k, k * k]
        return np.concatenate([d.T @ d, d.T @ m, m.T @ m, own]) if errors else own

    found = _summed(rows, ["f", "d"], partial, square + 7, frames)
    s, k, *own = found[square:]
    out = []
    for lag in range(top):
        rest = slice(0, frames - lag), slice(lag, frames)
        total, count = (float((x[rest[0]] * x[rest[1]]).sum()) - o[lag] for x, o in ((s, own[0]), (k, own[1])))
        value = total / count if count > 0.5 else math.nan
        row = [lag, value]
        if errors:
            a, b, c = (float((g[rest[0], rest[0]] * g[rest[1], rest[1]]).sum()) - o[lag] for g, o in zip(found[:square].reshape(3, frames, frames), own[2:], strict=True))
            row.append(math.sqrt(max(0.0, a - 2 * value * b + value * value * c)) / count if count > 0.5 else math.nan)
        out.append([lag, *map(float, row[1:])])
    return series.sparkSession.createDataFrame(out, schema)


def later(rows: DataFrame, column: str, lag: int) -> DataFrame:
    """Adds `later`, the column of the same particle `lag` frames on, and keeps the rows that have it: by the frame's number, so a missing frame pairs no others."""
    w = Window.partitionBy("particle_id").orderBy("frame").rangeBetween(lag, lag)
    return rows.withColumn("later", F.first(column).over(w)).where("later is not null")


def lagged_covariances(vectors: DataFrame, lag: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Symmetrised covariances at lag 0 and `lag`, and the number of pairs of frames; lags stay inside a particle. Tasks add up outer products of what a batch holds."""
    first = vectors.select(F.size("vec")).first()
    if first is None or first[0] < 1:
        raise ValueError("vectors are needed")
    d = first[0]

    def partial(b: pa.RecordBatch) -> np.ndarray:
        a, c = _matrix(b.column("vec")), _matrix(b.column("later"))
        out = np.zeros((2 * d + 2, d))
        out[:d], out[d : 2 * d], out[2 * d] = a.T @ a + c.T @ c, a.T @ c + c.T @ a, a.sum(0) + c.sum(0)
        out[2 * d + 1, 0] = len(a)
        return out

    found = _summed(later(vectors, "vec", lag), ["vec", "later"], partial, 2 * d + 2, d)
    n = int(found[2 * d + 1, 0])
    if not n:
        raise ValueError("the series is no longer than the lag")
    mean = found[2 * d] / (2 * n)
    return found[:d] / (2 * n) - np.outer(mean, mean), found[d : 2 * d] / (2 * n) - np.outer(mean, mean), n


def tica(vectors: DataFrame, lag: int, dims: int, cutoff: float = 1e-6) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Time-lagged independent components of all particles: (timescales, coefficients (dims, components), projection (particle_id, frame, vec)).

    The generalised eigenproblem of the symmetrised covariances is solved on the driver, without directions whose variance is under the cut-off; coordinates are scaled by their eigenvalue (kinetic map). A mode's sign makes its largest coefficient positive.
    """
    c0, ct, _ = lagged_covariances(vectors, lag)
    s, u = np.linalg.eigh(c0)
    keep = s > cutoff
    white = u[:, keep] / np.sqrt(s[keep])
    value, mode = np.linalg.eigh(white.T @ ct @ white)
    order = np.argsort(-np.abs(value))[:dims]
    value = value[order]
    modes = white @ mode[:, order]
    modes = modes * np.sign(modes[np.abs(modes).argmax(0), np.arange(modes.shape[1])]) * value
    with np.errstate(divide="ignore"):
        times = -lag / np.log(np.minimum(np.abs(value), 1.0))
    mean = np.array(vectors.select(*[F.avg(F.col("vec")[k]).alias(f"m{k}") for k in range(len(c0))]).first(), float)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = (_matrix(b.column("vec")) - mean) @ modes
                yield pa.RecordBatch.from_arrays([b.column("particle_id"), b.column("frame"), pa.array(list(y), pa.list_(pa.float64()))], ["particle_id", "frame", "vec"])

    kind = vectors.schema
    schema = f"particle_id {kind['particle_id'].dataType.simpleString()}, frame {kind['frame'].dataType.simpleString()}, vec array<double>"
    return times, modes.T, vectors.select("particle_id", "frame", "vec").mapInArrow(project, schema)


def rdf(positions: DataFrame, r_range: tuple[float, float], box, s1=None, s2=None, exclusion_block: tuple[int, int] | None = None, nbins: int = 200, norm: str = "rdf") -> DataFrame:
    """(bin, r, value): histogram of minimum-image distances of pairs from two selections, the last bin closed. norm: rdf (over shell volume, frames and pair density), density (over shell volume and frames) or none (counts).

    exclusion_block (a, b) leaves out pairs with rank // a of the first equal to rank // b of the second; (1, 1) by default where both selections are the same.
    """
    if norm not in ("rdf", "density", "none"):
        raise ValueError("norm must be rdf, density or none")
    lo, hi = r_range
    width = (hi - lo) / nbins
    block = exclusion_block or ((1, 1) if s1 is s2 or s1 == s2 else None)
    either = selected(s1) | selected(s2)
    edges = neighbor_edges(positions, hi, box=box, centers=s1, selection=s2, include_self=block is None or block != (1, 1), inclusive=True)
    if block not in (None, (1, 1)):

        def ranks(sel, name: str, size: int) -> DataFrame:
            return numbered(positions.where(selected(sel)), "particle_id").select(F.col("particle_id").alias(name), F.floor(F.col("number") / size).alias(f"b_{name}"))

        edges = edges.join(ranks(s1, "center_id", block[0]), "center_id").join(ranks(s2, "neigh_id", block[1]), "neigh_id").where("b_center_id <> b_neigh_id")
    d = F.sqrt("d2")
    counts = edges.where(d >= lo).groupBy(F.least(F.floor((d - lo) / width), F.lit(nbins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = positions.sparkSession.range(nbins).select(F.col("id").cast("int").alias("bin"))
    rows = bins.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    if norm != "none":
        frames, n1, n2 = positions.where(either).agg(F.countDistinct("frame"), F.countDistinct(F.when(selected(s1), F.col("particle_id"))), F.countDistinct(F.when(selected(s2), F.col("particle_id")))).first()
        left, right = lo + F.col("bin") * width, lo + (F.col("bin") + 1) * width
        shell = 4.0 / 3.0 * math.pi * (right * right * right - left * left * left)
        per = float(frames)
        if norm == "rdf":
            pairs = n1 * n2 - (block[0] * block[1] * (n1 // block[0]) if block else 0)
            volume = box.select(F.avg(F.col("lx") * F.col("ly") * F.col("lz"))).first()[0] if isinstance(box, DataFrame) else box[0] * box[1] * box[2]
            per *= pairs / volume
        rows = rows.withColumn("n", F.col("n") / (shell * per))
    return rows.select("bin", (lo + (F.col("bin") + 0.5) * width).alias("r"), F.col("n").alias("value"))


def two_nn(vectors: DataFrame, metric=None) -> float:
    """Intrinsic dimension: N / sum of ln(d2 / d1) over all points of all frames, d1 and d2 the distances to the two nearest of the same frame; points with d1 = 0 are left out. metric: a function of (block of points, all points of the frame) to distances, Euclidean by default."""
    n, s = two_nn_sums(vectors, metric).agg(F.sum("n"), F.sum("s")).first()
    return n / s if n and s else math.nan


def two_nn_sums(vectors: DataFrame, metric=None, block: int = 4096) -> DataFrame:
    """(frame, n, s): counts and sums of ln(d2 / d1) by frame. A frame of over `block` points is cut into blocks, and each block meets each in a task of theirs, so no frame is one task's; of a meeting only the two least distances of each point go on."""
    ship(vectors.sparkSession)

    def euclid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, ((a[:, None, :] - b[None, :, :]) ** 2).sum(2)))

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        x, ids = _matrix(table.column("vec").combine_chunks()), table.column("id").to_numpy()
        q, p, q_ids, p_ids = x[asks], x[~asks], ids[asks], ids[~asks]
        out, step = np.full((len(q), 2), np.inf), max(1, 2_000_000 // max(1, p.size))
        for k in range(0, len(q), step):
            d = (metric or euclid)(q[k : k + step], p)
            d[q_ids[k : k + step, None] == p_ids[None]] = np.inf
            least = np.sort(np.partition(d, 1, axis=1)[:, :2], axis=1) if d.shape[1] > 1 else np.pad(d, ((0, 0), (0, 1)), constant_values=np.inf)
            out[k : k + step] = least
        frame = table.column("frame")
        return pa.table({"frame": pa.array([frame[0].as_py()] * len(q), frame.type), "id": q_ids, "d1": out[:, 0], "d2": out[:, 1]})

    kind = vectors.schema["frame"].dataType.simpleString()
    groups = vectors.groupBy("frame").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("groups"))
    rows = vectors.select("frame", "vec", F.monotonically_increasing_id().alias("id")).join(groups, "frame").withColumn("mine", F.pmod(F.xxhash64("id"), "groups").cast("int"))
    every = F.sequence(F.lit(0), F.col("groups") - 1)
    cells = F.concat(F.transform(every, lambda k: F.struct(F.col("mine").alias("i"), k.alias("j"), F.lit(True).alias("asks"))), F.transform(every, lambda k: F.struct(k.alias("i"), F.col("mine").alias("j"), F.lit(False).alias("asks"))))
    met = rows.select("frame", "vec", "id", F.explode(cells).alias("c")).select("frame", "vec", "id", "c.i", "c.j", "c.asks")
    least = met.groupBy("frame", "i", "j").applyInArrow(run, f"frame {kind}, id long, d1 double, d2 double")
    two = least.groupBy("frame", "id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.array("d1", "d2")))), 1, 2).alias("d"))
    some = two.select("frame", F.col("d")[0].alias("d1"), F.col("d")[1].alias("d2")).where("d1 > 0 and d2 < double('inf')")
    sums = some.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.sum(F.ln(F.col("d2") / F.col("d1"))).alias("s"))
    return groups.select("frame").join(sums, "frame", "left").select("frame", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("s", F.lit(0.0)).alias("s"))


def extrema_of(x: np.ndarray, y: np.ndarray, kind: str = "max", prominence: float | None = None) -> np.ndarray:
    """(m, 2) inner extrema, the middle of a plateau for its whole; prominence: least height over the higher of the two lowest points on the way to higher ground (or the end) on either side."""
    if kind not in ("min", "max"):
        raise ValueError("kind must be 'min' or 'max'")
    v = np.asarray(y, float) * (1 if kind == "max" else -1)
    step = np.flatnonzero(np.append(True, np.diff(v) != 0))
    run, ends = v[step], np.append(step[1:], len(v)) - 1
    found = []
    for k in range(1, len(run) - 1):
        if run[k] > run[k - 1] and run[k] > run[k + 1]:
            if prominence is not None:
                higher = np.flatnonzero(run[:k] > run[k])
                left = run[higher[-1] if len(higher) else 0 : k].min()
                higher = np.flatnonzero(run[k + 1 :] > run[k])
                right = run[k + 1 : k + 2 + higher[0] if len(higher) else None].min()
                if run[k] - max(left, right) < prominence:
                    continue
            found.append((step[k] + ends[k]) // 2)
    at = np.array(found, np.int64)
    return np.column_stack([np.asarray(x)[at], np.asarray(y)[at]])


def find_extrema(points: DataFrame, kind: str = "max", prominence: float | None = None, by: str = "series") -> DataFrame:
    """(by, x, y) of the extrema of each curve, from rows (by, x, y)."""
    ship(points.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("x")
        out = extrema_of(t.column("x").to_numpy(), t.column("y").to_numpy(), kind, prominence)
        return pa.table({by: pa.array([t.column(by)[0].as_py()] * len(out), t.column(by).type), "x": out[:, 0].astype(float), "y": out[:, 1].astype(float)})

    return points.select(by, F.col("x").cast("double"), F.col("y").cast("double")).groupBy(by).applyInArrow(run, f"{by} {points.schema[by].dataType.simpleString()}, x double, y double")
