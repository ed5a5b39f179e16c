"""Vector series: distances over time, spectra layout, reference sets and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import DISTANCES, normalized, soap_distance
from .series import later

#: References, at most: they are broadcast.
MOST_REFERENCES = 10_000


def normalize(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("vec", normalized(F.col("vec")))


def n_frames(series: DataFrame) -> int:
    return series.select("frame").distinct().count()


def timesoap(vectors: DataFrame, delay: int = 1, check: bool = False) -> DataFrame:
    """(particle_id, frame, value): distance of a particle's spectra `delay` frames apart; a frame without one `delay` on has no row. check: also that the series is longer than the delay, which counts its frames."""
    if delay < 1 or (check and delay >= n_frames(vectors)):
        raise ValueError("delay must be 1 at least and less than the number of frames")
    return later(vectors, "vec", delay).select("particle_id", "frame", soap_distance(F.col("vec"), F.col("later")).alias("value"))


def triangle(n_max: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(n_max) for b in range(a, n_max)]


def fill_spectrum(vec: Column, l_max: int, n_max: int) -> Column:
    """The full n x n block of each l, from its upper triangle: (l_max + 1) n (n + 1) / 2 components become (l_max + 1) n^2."""
    place = {p: k for k, p in enumerate(triangle(n_max))}
    index = [l * len(place) + place[min(a, b), max(a, b)] + 1 for l in range(l_max + 1) for a in range(n_max) for b in range(n_max)]
    return F.transform(F.array(*[F.lit(i) for i in index]), lambda i: F.element_at(vec, i))


def create_references(vectors: DataFrame, addresses: dict[str, tuple[int, int]], l_max: int, n_max: int, normalize_rows: bool = True) -> DataFrame:
    """(ref_name, n_max, l_max, spectrum) of the rows at name: (frame, particle)."""
    spark = vectors.sparkSession
    at = spark.createDataFrame([(k, int(f), int(p)) for k, (f, p) in addresses.items()], "ref_name string, frame int, particle_id long")
    found = vectors.join(F.broadcast(at), ["frame", "particle_id"])
    vec = normalized(F.col("vec")) if normalize_rows else F.col("vec")
    return found.select("ref_name", F.lit(n_max).alias("n_max"), F.lit(l_max).alias("l_max"), vec.alias("spectrum"))


def save_references(refs: DataFrame, path: str, override: bool = False) -> None:
    refs.write.mode("overwrite" if override else "errorifexists").parquet(path)


def load_references(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merge_references(*refs: DataFrame) -> DataFrame:
    """One set of all; ValueError unless all have the same n_max and l_max."""
    found = {tuple(r) for ref in refs for r in ref.select("n_max", "l_max").distinct().limit(2).collect()}
    if len(found) > 1:
        raise ValueError("references differ in n_max or l_max")
    out = refs[0]
    for r in refs[1:]:
        out = out.unionByName(r)
    return out


def _checked(refs: DataFrame) -> DataFrame:
    rows = refs.select("ref_name", "spectrum").limit(MOST_REFERENCES + 1).collect()
    if len(rows) > MOST_REFERENCES:
        raise ValueError(f"more than {MOST_REFERENCES} references: classify in parts and keep the nearest")
    return refs.sparkSession.createDataFrame(rows, "ref_name string, spectrum array<double>")


def reference_distances(vectors: DataFrame, refs: DataFrame, distance="soap", normalize_rows: bool = False) -> DataFrame:
    """(particle_id, frame, ref_name, distance) to every reference. distance: soap, simple, normalized, or a function of two columns."""
    measure = DISTANCES.get(distance, distance)
    vec = normalized(F.col("vec")) if normalize_rows else F.col("vec")
    rows = vectors.select("particle_id", "frame", vec.alias("vec")).crossJoin(F.broadcast(_checked(refs)))
    return rows.select("particle_id", "frame", "ref_name", measure(F.col("vec"), F.col("spectrum")).alias("distance"))


def classify(vectors: DataFrame, refs: DataFrame, distance="soap", normalize_rows: bool = False) -> DataFrame:
    """(particle_id, frame, ref_name, distance) of the nearest reference; the first by name of equally near ones. Found inside each row, without a shuffle."""
    measure = DISTANCES.get(distance, distance)
    known = sorted(_checked(refs).collect(), key=lambda r: r["ref_name"])
    table = F.array(*[F.struct(F.lit(r["ref_name"]).alias("ref_name"), F.array(*[F.lit(float(x)) for x in r["spectrum"]]).alias("spectrum")) for r in known])
    vec = normalized(F.col("vec")) if normalize_rows else F.col("vec")
    rows = vectors.select("particle_id", "frame", vec.alias("vec"))
    each = F.transform(table, lambda r: F.struct(measure(F.col("vec"), r["spectrum"]).alias("distance"), r["ref_name"].alias("ref_name")))
    return rows.withColumn("best", F.array_min(each)).select("particle_id", "frame", "best.ref_name", "best.distance")
