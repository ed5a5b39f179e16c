"""Entropies, information gain and sample entropy."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.special import digamma, log_unit_ball
from ..session import discard, ship, written

BITS = {"bit": math.log(2), "nat": 1.0}


def entropy_of_counts(counts: DataFrame, by: Sequence[str] = (), base: float = 2.0) -> DataFrame:
    """(by..., n, h): -sum p log p of a column `c` of counts."""
    sums = counts.groupBy(*by).agg(F.sum("c").cast("double").alias("n"), F.sum(F.col("c") * F.ln("c")).alias("s"))
    return sums.select(*by, "n", ((F.ln("n") - F.col("s") / F.col("n")) / math.log(base)).alias("h"))


def shannon(data: DataFrame, columns: Sequence[str], base: float = 2.0) -> DataFrame:
    """(n, h): entropy of the rows as symbols."""
    return entropy_of_counts(data.groupBy(*columns).agg(F.count(F.lit(1)).alias("c")), base=base)


def bin_of(x: Column, lo, hi, n_bins: int) -> Column:
    """Bin in a fixed range, the last one closed; null outside."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.when((x >= lo) & (x <= hi), F.least(F.floor((x - lo) / ((hi - lo) / n_bins)), F.lit(n_bins - 1)).cast("int"))


def histogram_entropy(data: DataFrame, ranges: dict[str, tuple[float, float]], n_bins: int | dict[str, int], units: str = "frac") -> DataFrame:
    """(n, h) of a histogram over one or more columns; values outside any range are left out. units: bit, nat, or frac (over the log of the number of bins)."""
    if units not in ("frac", *BITS):
        raise ValueError("units must be frac, bit or nat")
    bins = n_bins if isinstance(n_bins, dict) else dict.fromkeys(ranges, n_bins)
    named = data.select(*[bin_of(F.col(c), lo, hi, bins[c]).alias(f"b_{c}") for c, (lo, hi) in ranges.items()]).dropna()
    counts = named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("c"))
    scale = math.prod(bins.values()) if units == "frac" else math.exp(BITS[units])
    return entropy_of_counts(counts, base=float(scale))


def info_gain(data: DataFrame, columns: Sequence[str], label: str, base: float = 2.0) -> DataFrame:
    """(gain, relative, h0, hc): entropy of all rows less the mean of the labels', by one pass of grouping sets. relative is NaN where h0 is 0."""
    symbols = [f"s{k}" for k in range(len(columns))]
    named = data.select(data[f"`{label}`"].alias("l"), *[data[f"`{c}`"].alias(s) for c, s in zip(columns, symbols, strict=True)])
    counts = named.groupBy("l", *symbols).agg(F.count(F.lit(1)).alias("k"))
    sets = counts.groupingSets([["l", *symbols], symbols], "l", *symbols).agg(F.grouping("l").alias("whole"), F.sum("k").alias("c"))
    each = entropy_of_counts(sets, ["whole", "l"], base)
    out = each.agg(F.sum(F.when(F.col("whole") == 1, F.col("h"))).alias("h0"), (F.sum(F.when(F.col("whole") == 0, F.col("h") * F.col("n"))) / F.sum(F.when(F.col("whole") == 0, F.col("n")))).alias("hc"))
    gain = F.col("h0") - F.col("hc")
    return out.select(gain.alias("gain"), F.when(F.col("h0") == 0, F.lit(float("nan"))).otherwise(gain / F.col("h0")).alias("relative"), "h0", "hc")


def entropy_gain(data: DataFrame, columns: Sequence[str], label: str, n_bins: int = 20) -> DataFrame:
    """Information gain of histograms over each column's own range, as fractions of the log of the number of bins."""
    named = data.select(data[f"`{label}`"].alias("l"), *[data[f"`{c}`"].alias(f"x{k}") for k, c in enumerate(columns)])
    at = range(len(columns))
    span = named.agg(*[f(f"x{k}").alias(f"{n}{k}") for k in at for n, f in (("lo", F.min), ("hi", F.max))])
    rows = named.crossJoin(F.broadcast(span))  # one row
    binned = rows.select("l", *[bin_of(F.col(f"x{k}"), F.col(f"lo{k}"), F.col(f"hi{k}"), n_bins).alias(f"b{k}") for k in at])
    return info_gain(binned, [f"b{k}" for k in at], "l", float(n_bins ** len(columns)))


def spacing_entropy(data: DataFrame, column: str, k: int = 1, units: str = "nat") -> float:
    """One-sided spacing estimator in one dimension: spacings x[i + k] - x[i] of the sorted values, 1e-10 at least, over all N - k.

    Values are dealt out by ranges, so that each task holds a run of the order and sums its own spacings; the driver adds those across the edges, from k values of either end of a run.
    """
    ship(data.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy() for b in batches]
        x = np.concatenate(parts) if parts else np.zeros(0)
        if len(x):
            s = float(np.log(np.maximum(x[k:] - x[:-k], 1e-10)).sum()) if len(x) > k else 0.0
            yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([s]), pa.array([x[:k].tolist()]), pa.array([x[-k:].tolist()])], ["n", "s", "head", "tail"])

    x = data.select(F.col(column).cast("double").alias("x")).dropna()
    runs = x.repartitionByRange(F.col("x")).sortWithinPartitions("x").mapInArrow(run, "n long, s double, head array<double>, tail array<double>").collect()
    runs.sort(key=lambda r: (r["head"][0], r["tail"][-1]))
    n, total, last = 0, 0.0, []
    for r in runs:
        # spacings that end in this run and start before it: those of its first k values
        for i, v in enumerate(r["head"]):
            back = k - i
            if len(last) >= back > 0:
                total += math.log(max(v - last[len(last) - back], 1e-10))
        total += r["s"]
        last = (last + r["tail"])[-k:] if r["n"] < k else r["tail"]
        n += r["n"]
    if n <= k:
        return 0.0
    return (digamma(n) - digamma(k) + math.log(2) + total / (n - k)) / BITS[units]


def knn_distance(points: DataFrame, columns: Sequence[str], k: int, norm: str = "euclid") -> DataFrame:
    """(id, d): distance to the k-th nearest other point, for rows (id, columns...).

    Equal points are one place with a count. Places are put into cells; a place looks into the cells around its own, and is settled if it finds k points within a cell's width, as no nearer one can lie elsewhere. The rest go on with cells of four times the width. The first width follows from the range of the inner 90 % of the points in each column, so far-off ones don't put all others into one cell. Exact; meant for three dimensions at most.
    """
    names = [f"x{i}" for i in range(len(columns))]
    named = points.select("id", *[F.col(c).cast("double").alias(x) for c, x in zip(columns, names, strict=True)])
    places = written(named.groupBy(*names).agg(F.count(F.lit(1)).alias("many")).withColumn("place", F.monotonically_increasing_id()))
    n, m = places.agg(F.sum("many"), F.count(F.lit(1))).first()
    if (n or 0) <= k:
        return points.select("id", F.lit(None).cast("double").alias("d")).limit(0)
    inner = places.approxQuantile(names, [0.05, 0.95], 0.01)
    whole = places.agg(*[F.max(x) - F.min(x) for x in names]).first()
    sides = [max(b - a if b > a else w, 1e-12) for (a, b), w in zip(inner, whole, strict=True)]
    width = (math.prod(sides) * 4 * (k + 1) / m) ** (1 / len(names))
    left, done = places, None
    while True:
        cell = lambda df, w: df.withColumns({f"g_{x}": F.floor(F.col(x) / w) for x in names})
        every = cell(places.select(F.col("place").alias("other"), F.col("many").alias("others"), *names), width).withColumnsRenamed({x: f"o_{x}" for x in names})
        around = cell(left, width)
        for x in names:
            around = around.withColumn(f"g_{x}", F.explode(F.array(*[F.col(f"g_{x}") + F.lit(s) for s in (-1, 0, 1)])))
        gaps = [F.abs(F.col(x) - F.col(f"o_{x}")) for x in names]
        d = F.greatest(*gaps) if norm == "chebyshev" and len(gaps) > 1 else gaps[0] if len(gaps) == 1 else F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))
        found = around.join(every, [f"g_{x}" for x in names]).select("place", "many", "other", "others", d.alias("d")).where(F.col("d") <= width)
        rank = F.sum(F.col("others") - F.when(F.col("place") == F.col("other"), 1).otherwise(0)).over(Window.partitionBy("place").orderBy("d", "other"))
        settled = written(found.withColumn("rank", rank).where(F.col("rank") >= k).groupBy("place").agg(F.min("d").alias("d")))
        done = settled if done is None else done.unionByName(settled)
        rest = written(left.join(settled, "place", "left_anti"))
        if left is not places:
            discard(left)
        if rest.isEmpty():
            break
        left, width = rest, width * 4
    return named.join(places.join(done, "place").select(*names, "d"), names).select("id", "d")


def kozachenko_leonenko(points: DataFrame, columns: Sequence[str], k: int = 4, base: float = 2.0, norm: str = "chebyshev") -> float:
    """Nearest-neighbour entropy: digamma(N) - digamma(k) + log of the unit ball's volume + d mean(ln distance). 0 for two points or fewer. Distances of 0 count as 1e-10."""
    n = points.count()
    if n <= 2:
        return 0.0
    d = len(columns)
    mean = knn_distance(points, columns, k, norm).agg(F.avg(F.ln(F.greatest(F.col("d"), F.lit(1e-10))))).first()[0]
    ball = d * math.log(2) if norm == "chebyshev" else log_unit_ball(d)
    return (digamma(n) - digamma(k) + ball + d * mean) / math.log(base)


def info_gain_kl(points: DataFrame, columns: Sequence[str], label: str, k: int = 4, base: float = 2.0, norm: str = "chebyshev") -> DataFrame:
    """(gain, relative, h0, hc) as info_gain gives it, by nearest-neighbour entropies of all points (id, columns..., label) and of each label's."""
    parts = points.groupBy(label).count().collect()  # a row per label
    total = sum(r["count"] for r in parts)
    h0 = kozachenko_leonenko(points, columns, k, base, norm)
    hc = sum(r["count"] / total * kozachenko_leonenko(points.where(F.col(label).eqNullSafe(F.lit(r[label]))), columns, k, base, norm) for r in parts)
    gain = h0 - hc
    return points.sparkSession.createDataFrame([(gain, gain / h0 if h0 else math.nan, h0, hc)], "gain double, relative double, h0 double, hc double")


def gaussian_sample(spark: SparkSession, n: int, seed: int, block: int = 1 << 20) -> DataFrame:
    """(id, x): n seeded normal numbers, made block by block on the executors; the first block is the seed's own stream, others have streams of the seed and their number."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("id").to_pylist():
                at = np.arange(k * block, min(n, (k + 1) * block))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.random.default_rng([seed, k] if k else seed).normal(size=len(at)))], ["id", "x"])

    return spark.range(-(-n // block)).mapInArrow(run, "id long, x double")


def negentropy(data: DataFrame, columns: Sequence[str], k: int = 4, seed: int = 1234, units: str = "bit") -> float:
    """Entropy of a seeded Gaussian sample of the same size less that of the standardised values, all columns taken as one series."""
    values = data.select(F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias("x"))
    n, mean, sd = values.agg(F.count("x"), F.avg("x"), F.stddev_samp("x")).first()
    own = values.select(F.monotonically_increasing_id().alias("id"), ((F.col("x") - mean) / sd).alias("x"))
    base = math.exp(BITS[units])
    return kozachenko_leonenko(gaussian_sample(data.sparkSession, n, seed), ["x"], k, base) - kozachenko_leonenko(own, ["x"], k, base)


def sample_entropy_of(x: np.ndarray, r: float, m: int = 2) -> float:
    """-ln(B / A): A and B count pairs of windows of m + 1 and m + 2 values that differ by less than r everywhere. Windows are compared with those only whose first value is near."""
    n = len(x)
    if n < m + 2:
        raise ValueError("Time-series too short")

    def pairs(width: int) -> int:
        w = np.lib.stride_tricks.sliding_window_view(x, width)
        w = w[np.argsort(w[:, 0], kind="stable")]
        to, total = np.searchsorted(w[:, 0], w[:, 0] + r, side="right"), 0  # the sum may round to a value whose difference is under r
        for i in range(len(w) - 1):
            total += int((np.abs(w[i + 1 : to[i]] - w[i]).max(1, initial=0) < r).sum())
        return total

    a, b = pairs(m + 1), pairs(m + 2)
    if not a or not b:
        raise RuntimeError("No matching sequences found.")
    return -math.log(b / a)


def sample_entropy(series: DataFrame, r: float, m: int = 2, strict: bool = True) -> DataFrame:
    """(particle_id, value) of each particle's series; strict: a series that is too short or has no match ends the run, else its value is null."""
    ship(series.sparkSession)
    kind = series.schema["particle_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        x = table.sort_by("frame").column("value").to_numpy()
        try:
            value = sample_entropy_of(x, r, m)
        except (ValueError, RuntimeError):
            if strict:
                raise
            value = None
        return pa.table({"particle_id": pa.array([table.column("particle_id")[0].as_py()], table.column("particle_id").type), "value": pa.array([value], pa.float64())})

    return series.select("particle_id", "frame", F.col("value").cast("double")).groupBy("particle_id").applyInArrow(run, f"particle_id {kind}, value double")
