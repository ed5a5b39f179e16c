"""Smooth overlap of atomic positions: power spectra of Gaussian densities in a radial basis of Gaussian-type orbitals."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, getcontext, localcontext
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.select import selection as selected
from ..session import ship
from .neighbors import AXES, displacement, neighbor_edges, with_box
from .vectors import triangle

SIGMA = 1.0
#: A basis function has fallen to this at its cut-off; a density is counted out to where it has.
THRESHOLD = 1e-3


def padded(r_cut: float) -> float:
    return r_cut + SIGMA * math.sqrt(-2 * math.log(THRESHOLD))


def _inverse(m: list[list[Decimal]]) -> list[list[Decimal]]:
    n = len(m)
    a = [row[:] + [Decimal(i == j) for j in range(n)] for i, row in enumerate(m)]
    for c in range(n):
        p = max(range(c, n), key=lambda r: abs(a[r][c]))
        a[c], a[p] = a[p], a[c]
        d = a[c][c]
        a[c] = [x / d for x in a[c]]
        for r in range(n):
            if r != c and a[r][c]:
                f = a[r][c]
                a[r] = [x - f * y for x, y in zip(a[r], a[c], strict=True)]
    return [row[n:] for row in a]


@lru_cache
def radial_basis(r_cut: float, n_max: int, l_max: int) -> tuple[np.ndarray, np.ndarray]:
    """Exponents (l, n) and orthonormalising matrices (l, n, n): the inverse square root of the overlap, by Denman and Beavers' iteration in long decimals, as the overlap is singular in doubles."""
    edges = np.linspace(1, r_cut, n_max)
    alpha = np.array([[-math.log(THRESHOLD / a**l) / a**2 for a in edges] for l in range(l_max + 1)])
    beta = np.zeros((l_max + 1, n_max, n_max))
    with localcontext():
        getcontext().prec = 120
        for l in range(l_max + 1):
            half = Decimal(math.gamma(l + 1.5)) / 2
            ex = [Decimal(x) for x in alpha[l]]
            power = Decimal(2 * l + 3) / 2
            y = [[half * (-power * (a + b).ln()).exp() for b in ex] for a in ex]
            z = [[Decimal(i == j) for j in range(n_max)] for i in range(n_max)]
            for _ in range(100):
                yi, zi = _inverse(y), _inverse(z)
                new = [[(p + q) / 2 for p, q in zip(r, s, strict=True)] for r, s in zip(y, zi, strict=True)]
                z = [[(p + q) / 2 for p, q in zip(r, s, strict=True)] for r, s in zip(z, yi, strict=True)]
                done = max(abs(p - q) for r, s in zip(y, new, strict=True) for p, q in zip(r, s, strict=True)) < Decimal(10) ** -80
                y = new
                if done:
                    break
            beta[l] = [[float(x) for x in row] for row in z]
    return alpha, beta


def harmonics(unit: np.ndarray, l_max: int) -> list[np.ndarray]:
    """Real spherical harmonics of unit vectors (m, 3): by l, an array (2 l + 1, m). Their products summed over the orders are (2 l + 1) / 4 pi times the Legendre polynomial of the angle between two vectors."""
    x, y, z = unit.T
    across = [(np.ones_like(x), np.zeros_like(x))]  # real and imaginary part of (x + i y)^m
    for _ in range(l_max):
        a, b = across[-1]
        across.append((a * x - b * y, a * y + b * x))
    out = [np.empty((2 * l + 1, len(x))) for l in range(l_max + 1)]
    edge = math.sqrt(1 / (4 * math.pi))
    for m, (a, b) in enumerate(across):
        edge *= math.sqrt((2 * m + 1) / (2 * m)) if m else 1.0
        before, now = np.zeros_like(z), np.full_like(z, edge)
        for l in range(m, l_max + 1):
            if l > m:
                scale = math.sqrt((4 * l * l - 1) / (l * l - m * m))
                less = math.sqrt(((l - 1) ** 2 - m * m) / (4 * (l - 1) ** 2 - 1)) if l - 1 > m else 0.0
                before, now = now, scale * (z * now - less * before)
            if m:
                out[l][2 * m - 1], out[l][2 * m] = math.sqrt(2) * now * a, math.sqrt(2) * now * b
            else:
                out[l][0] = now
    return out


def spectrum(delta: np.ndarray, kind: np.ndarray, kinds: int, r_cut: float, n_max: int, l_max: int) -> np.ndarray:
    """Power spectrum of one environment: delta (m, 3) from the centre to every density in reach, itself included; kind: species numbers. Order: pairs of species, l, then n <= n' (all n, n' for two species). The density's coefficients are sums over neighbours, so the work grows in proportion to these."""
    alpha, beta = radial_basis(r_cut, n_max, l_max)
    a = 1 / (2 * SIGMA**2)
    r = np.sqrt((delta**2).sum(1))
    safe = np.where(r > 0, r, 1.0)
    unit = np.where(r[:, None] > 0, delta / safe[:, None], 0.0)
    upper = tuple(np.array(triangle(n_max)).T)
    member = np.eye(kinds)[kind]
    blocks: dict[tuple[int, int], list[np.ndarray]] = {(i, j): [] for i in range(kinds) for j in range(i, kinds)}
    for l, angular in enumerate(harmonics(unit, l_max)):
        g = alpha[l]
        f = math.pi**1.5 * (a * r[:, None]) ** l * (a + g) ** -(l + 1.5) * np.exp(-a * g * r[:, None] ** 2 / (a + g)) @ beta[l].T
        c = [(f * member[:, i : i + 1]).T @ angular.T for i in range(kinds)]  # (n, 2 l + 1) of each species
        scale = math.pi * math.sqrt(8 / (2 * l + 1))
        for (i, j), out in blocks.items():
            full = scale * c[i] @ c[j].T
            out.append(full[upper] if i == j else full.ravel())
    return np.concatenate([x for out in blocks.values() for x in out])


def soap(positions: DataFrame, r_cut: float, n_max: int = 8, l_max: int = 8, box=None, respect_pbc: bool = True, centers=None, selection=None) -> DataFrame:
    """(particle_id, frame, vec). Species are the distinct types of the selection (one, without a column type); centres lie inside the selection. Periodic neighbours are minimum images.

    A range join finds what each density reaches; each environment's kernel then runs by itself, so a frame is no unit of work.
    """
    ship(positions.sparkSession)
    typed = positions if "type" in positions.columns else positions.withColumn("type", F.lit("X"))
    inside = typed.where(selected(selection))
    kinds = sorted(r["type"] for r in inside.select("type").distinct().collect())
    index = F.create_map(*[F.lit(x) for pair in enumerate(kinds) for x in pair[::-1]])
    periodic = respect_pbc and box is not None
    edges = neighbor_edges(inside, padded(r_cut), box=box, respect_pbc=periodic, centers=selected(centers), include_self=True, inclusive=True)
    sized = with_box(inside, box) if periodic else inside
    cols = ["frame", "particle_id", *AXES, "type", *([f"l{a}" for a in AXES] if periodic else [])]
    p, q = sized.select(*cols).alias("p"), sized.select(*cols).alias("q")
    e = edges.alias("e")
    met = e.join(p, (F.col("e.frame") == F.col("p.frame")) & (F.col("e.center_id") == F.col("p.particle_id"))).join(q, (F.col("e.frame") == F.col("q.frame")) & (F.col("e.neigh_id") == F.col("q.particle_id")))
    rows = met.select(F.col("e.frame").alias("frame"), F.col("e.center_id").alias("particle_id"), *[(-displacement(a, periodic)).alias(f"d{a}") for a in AXES], index[F.col("q.type")].alias("kind"))
    rows = rows.groupBy("particle_id", "frame").agg(*[F.collect_list(c).alias(c) for c in ("dx", "dy", "dz", "kind")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("dx", "dy", "dz", "kind")]
            vecs = [spectrum(np.array([x, y, z], float).T, np.array(k), len(kinds), r_cut, n_max, l_max) for x, y, z, k in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("particle_id"), b.column("frame"), pa.array(vecs, pa.list_(pa.float64()))], ["particle_id", "frame", "vec"])

    kind = rows.schema
    return rows.mapInArrow(run, f"particle_id {kind['particle_id'].dataType.simpleString()}, frame {kind['frame'].dataType.simpleString()}, vec array<double>")
