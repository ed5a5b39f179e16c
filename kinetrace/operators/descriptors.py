"""Descriptors per particle and frame from neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.select import selection as selected
from .neighbors import neighbor_edges, neighbor_lists
from .series import later


def spine_of(positions: DataFrame, centers=None) -> DataFrame:
    return positions.where(selected(centers)).select("frame", "particle_id")


def coordination_number(positions: DataFrame, r_cut: float | None = None, edges: DataFrame | None = None, centers=None, **options) -> DataFrame:
    """(particle_id, frame, value): number of neighbours, 0 for isolated particles. edges: as computed before, instead of r_cut."""
    edges = neighbor_edges(positions, r_cut, centers=centers, **options) if edges is None else edges
    counts = edges.groupBy("frame", F.col("center_id").alias("particle_id")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return spine_of(positions, centers).join(counts, ["frame", "particle_id"], "left").select("particle_id", "frame", F.coalesce("n", F.lit(0.0)).alias("value"))


def lens(positions: DataFrame, r_cut: float, delay: int = 1, centers=None, **options) -> DataFrame:
    """(particle_id, frame, value): (#A + #B - 2 #(A and B)) / (#A + #B) for the neighbours A in a frame and B `delay` frames on; 0 if both are empty. A frame without one `delay` on has no row. Each list is made once. Without a box, the frame's extent times 1.01 serves."""
    if delay < 1:
        raise ValueError("delay must be 1 at least")
    edges = neighbor_edges(positions, r_cut, centers=centers, **({"box_scale": 1.01} | options))
    pairs = later(neighbor_lists(edges, spine_of(positions, centers)), "nbrs", delay)
    total = F.size("nbrs") + F.size("later")
    value = F.when(total == 0, F.lit(0.0)).otherwise((total - 2 * F.size(F.array_intersect("nbrs", "later"))) / total)
    return pairs.select("particle_id", "frame", value.alias("value"))


def _ends(edges: DataFrame, positions: DataFrame, *columns: str) -> DataFrame:
    """Edges with the columns of the centre (p_) and of the neighbour (q_)."""
    p = positions.select("frame", F.col("particle_id").alias("center_id"), *[F.col(c).alias(f"p_{c}") for c in columns])
    q = positions.select("frame", F.col("particle_id").alias("neigh_id"), *[F.col(c).alias(f"q_{c}") for c in columns])
    return edges.select("frame", "center_id", "neigh_id").join(p, ["frame", "center_id"]).join(q, ["frame", "neigh_id"])


def orientational_order(positions: DataFrame, edges: DataFrame, order: int = 6, box=None, centers=None) -> DataFrame:
    """(particle_id, frame, value): |sum of exp(i n theta)| / N in the xy-plane; 0 with one neighbour or none. Angles are of raw differences; with a box (lx, ly), of minimum images."""
    e = _ends(edges, positions, "x", "y")
    dx, dy = F.col("q_x") - F.col("p_x"), F.col("q_y") - F.col("p_y")
    if box is not None:
        dx, dy = dx - box[0] * F.rint(dx / box[0]), dy - box[1] * F.rint(dy / box[1])
    angle = order * F.atan2(dy, dx)
    sums = e.groupBy("frame", F.col("center_id").alias("particle_id")).agg(F.sum(F.cos(angle)).alias("c"), F.sum(F.sin(angle)).alias("s"), F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("n") <= 1, 0.0).otherwise(F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("n"))
    return spine_of(positions, centers).join(sums, ["frame", "particle_id"], "left").select("particle_id", "frame", F.coalesce(value, F.lit(0.0)).alias("value"))


def mean_alignment(edges: DataFrame, vectors: DataFrame, metric=None) -> DataFrame:
    """(particle_id, frame, value): mean of metric(v_i, v_j) over neighbours whose vectors aren't zero; 0 if there is none, or v_i is zero.

    vectors(frame, particle_id, vx, vy, vz). metric: a function of two triples of columns; the cosine by default (a pandas UDF may serve for what columns can't say).
    """

    def cosine(a, b):
        dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
        return dot / (F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2]) * F.sqrt(b[0] * b[0] + b[1] * b[1] + b[2] * b[2]))

    moving = vectors.where("vx <> 0 or vy <> 0 or vz <> 0")
    e = _ends(edges.where("center_id <> neigh_id"), moving, "vx", "vy", "vz")
    a, b = ([F.col(f"{s}_{c}") for c in ("vx", "vy", "vz")] for s in "pq")
    means = e.groupBy("frame", F.col("center_id").alias("particle_id")).agg(F.avg((metric or cosine)(a, b)).alias("m"))
    return vectors.select("frame", "particle_id").join(means, ["frame", "particle_id"], "left").select("particle_id", "frame", F.coalesce("m", F.lit(0.0)).alias("value"))


def displacements(positions: DataFrame, reference: str = "first") -> DataFrame:
    """(frame, particle_id, vx, vy, vz) from the second frame on, numbered from 0: r(t) - r(first frame), or with reference 'previous' r(t) - r(t - 1)."""
    if reference not in ("first", "previous"):
        raise ValueError("reference must be 'first' or 'previous'")
    w = Window.partitionBy("particle_id").orderBy("frame")
    base = (lambda c: F.first(c).over(w)) if reference == "first" else (lambda c: F.lag(c).over(w))
    rows = positions.withColumns({f"v{a}": F.col(a) - base(a) for a in "xyz"} | {"before": F.lag("frame").over(w)})
    return rows.where("before is not null").select(F.col("before").alias("frame"), "particle_id", "vx", "vy", "vz")


def velocity_alignment(positions: DataFrame, edges: DataFrame, reference: str = "first", velocities: bool | None = None) -> DataFrame:
    """Cosine alignment with the neighbours' motion: velocities vx, vy, vz where the positions carry them, else displacements (one frame less)."""
    own = "vx" in positions.columns if velocities is None else velocities
    vectors = positions.select("frame", "particle_id", "vx", "vy", "vz") if own else displacements(positions, reference)
    return mean_alignment(edges, vectors)


def spatial_average(values: DataFrame, positions: DataFrame, r_cut: float, selection=None, **options) -> DataFrame:
    """Mean over neighbours (d <= r_cut) and the particle itself. values(particle_id, frame, value) or (particle_id, frame, vec); frames that only one side has fall away."""
    column = next((c for c in ("value", "vec") if c in values.columns), None)
    if column is None:
        raise ValueError("values must have a column value or vec")
    edges = neighbor_edges(positions, r_cut, centers=selection, selection=selection, include_self=True, inclusive=True, **options)
    rows = edges.join(values.select("frame", F.col("particle_id").alias("neigh_id"), column), ["frame", "neigh_id"])
    key = ["frame", F.col("center_id").alias("particle_id")]
    if column == "value":
        return rows.groupBy(*key).agg(F.avg("value").alias("value")).select("particle_id", "frame", "value")
    means = rows.select("frame", "center_id", F.posexplode("vec").alias("k", "v")).groupBy("frame", "center_id", "k").agg(F.avg("v").alias("m"))
    out = means.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("vec"))
    return out.select("particle_id", "frame", "vec")
