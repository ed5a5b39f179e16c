"""Per-frame spatial range join under minimum image, by cells.

Each particle has one cell; each centre looks into the 27 around its own. The join is an equi-join on (frame, cell), so it shuffles by key and its work grows with the number of neighbours, not with the square of a frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.select import selection as selected

AXES = ("x", "y", "z")
#: The strict cut-off is taken this much shorter.
SHRINK = 1e-6


def with_box(positions: DataFrame, box, scale: float = 1.0) -> DataFrame:
    """Adds lx, ly, lz. box: three lengths, a table (frame, lx, ly, lz), or None: each frame's extent times scale."""
    if isinstance(box, DataFrame):
        return positions.join(box.select("frame", "lx", "ly", "lz"), "frame")
    if box is not None:
        return positions.withColumns({f"l{a}": F.lit(float(v)) for a, v in zip(AXES, box, strict=True)})
    extent = positions.groupBy("frame").agg(*[((F.max(a) - F.min(a)) * scale).alias(f"l{a}") for a in AXES])
    return positions.join(extent, "frame")


def _cells(df: DataFrame, r_cut: float, periodic: bool) -> DataFrame:
    if not periodic:
        return df.withColumns({f"c{a}": F.floor(F.col(a) / r_cut).cast("int") for a in AXES})
    out = df
    for a in AXES:
        size = F.col(f"l{a}")
        out = out.withColumn(f"n{a}", F.when(size > 0, F.greatest(F.lit(3), F.floor(size / r_cut).cast("int"))).otherwise(1))
        out = out.withColumn(f"c{a}", F.when(size > 0, F.pmod(F.floor(F.col(a) / size * F.col(f"n{a}")).cast("int"), F.col(f"n{a}"))).otherwise(0))
    return out


def displacement(a: str, periodic: bool, left: str = "p", right: str = "q"):
    d = F.col(f"{left}.{a}") - F.col(f"{right}.{a}")
    size = F.col(f"{left}.l{a}")
    return F.when(size > 0, d - size * F.rint(d / size)).otherwise(d) if periodic else d


def neighbor_edges(positions: DataFrame, r_cut: float, box=None, respect_pbc: bool = True, centers=None, selection=None, include_self: bool = False, inclusive: bool = False, box_scale: float = 1.0) -> DataFrame:
    """(frame, center_id, neigh_id, d2): pairs closer than r_cut.

    positions(frame, particle_id, x, y, z, ...). The bound is strict and 1e-6 short; inclusive: d <= r_cut instead. A particle is no neighbour of itself, by its id whatever the selections; include_self adds it. Without a box the frame's extent serves, so the outermost particles meet across it.
    """
    sized = with_box(positions, box, box_scale) if respect_pbc else positions
    keep = ["frame", "particle_id", *AXES, *([f"l{a}" for a in AXES] if respect_pbc else [])]
    every = _cells(sized.where(selected(selection)), r_cut, respect_pbc)
    around = _cells(sized.where(selected(centers)), r_cut, respect_pbc)
    for a in AXES:
        flat = F.col(f"n{a}") < 3 if respect_pbc else F.lit(False)
        step = F.explode(F.when(flat, F.array(F.lit(0))).otherwise(F.array(*[F.lit(k) for k in (-1, 0, 1)])))
        around = around.withColumn("step", step)
        cell = F.col(f"c{a}") + F.col("step")
        around = around.withColumn(f"c{a}", F.pmod(cell, F.col(f"n{a}")) if respect_pbc else cell).drop("step")
    cell = [f"c{a}" for a in AXES]
    p, q = around.select(*keep, *cell).alias("p"), every.select("frame", "particle_id", *AXES, *cell).alias("q")
    on = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in ["frame", *cell]]
    d = [displacement(a, respect_pbc) for a in AXES]
    d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    near = d2 <= r_cut * r_cut if inclusive else d2 < (r_cut - SHRINK) ** 2
    apart = F.col("p.particle_id") != F.col("q.particle_id")
    rows = p.join(q, on).where((apart | F.lit(include_self)) & near)
    return rows.select(F.col("p.frame").alias("frame"), F.col("p.particle_id").alias("center_id"), F.col("q.particle_id").alias("neigh_id"), d2.alias("d2"))


def neighbor_lists(edges: DataFrame, spine: DataFrame) -> DataFrame:
    """(frame, particle_id, nbrs): an array for every row of the spine (frame, particle_id), empty for isolated particles."""
    lists = edges.groupBy("frame", F.col("center_id").alias("particle_id")).agg(F.sort_array(F.collect_list("neigh_id")).alias("nbrs"))
    return spine.select("frame", "particle_id").join(lists, ["frame", "particle_id"], "left").withColumn("nbrs", F.coalesce("nbrs", F.array().cast("array<long>")))
