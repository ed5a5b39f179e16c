"""Facade: trajectories, the datasets computed from them, and their clusters. Objects are immutable; methods return new ones."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.select import selection as selected
from .operators import descriptors, onion, series, soap, tracking, vectors
from .operators.labels import clean_population, scan_summary, state_populations, transitions, window_means
from .operators.neighbors import neighbor_edges
from .provenance import LOG
from .sources import gro, tables, xtc, xyz


#: Older spellings of datasets' names.
NAMES = {"velocity_alignement": "velocity_alignment"}


@dataclass(frozen=True)
class Insight:
    """A dataset (particle_id, frame, value) or (particle_id, frame, vec) and what it is."""

    dataset: DataFrame
    meta: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if LOG.auto_record:
            LOG.record(self.dataset, self.meta)

    def dump_to_json(self, path: str) -> None:
        tables.dump(path, {"dataset": self.dataset}, meta=self.meta)

    @classmethod
    def load_from_json(cls, spark: SparkSession, path: str) -> Insight:
        fields, found = tables.load(spark, path, "dataset")
        meta = fields.get("meta", {})
        return cls(found["dataset"], meta | {"name": NAMES.get(meta["name"], meta["name"])} if "name" in meta else meta)

    def spatial_average(self, trj: Trajectory, r_cut: float, selection="all") -> Insight:
        out = descriptors.spatial_average(self.dataset, trj.positions, r_cut, selection, **trj.options())
        return Insight(out, self.meta | {"sp_av_r_cut": r_cut, "selection": str(selection)})

    def get_time_correlation(self, max_delay: int | None = None) -> DataFrame:
        return series.self_time_correlation(self.dataset, max_delay)

    def get_angular_velocity(self, delay: int = 1) -> Insight:
        if "vec" not in self.dataset.columns:
            raise ValueError("a dataset of vectors is needed")
        name = "timesoap" if self.meta.get("name") == "soap" else "angular_velocity"
        return Insight(vectors.timesoap(self.dataset, delay, check=True), self.meta | {"name": name, "delay": delay})

    def get_tica(self, lag_time: int, tica_dim: int) -> tuple[np.ndarray, np.ndarray, Insight]:
        if "vec" not in self.dataset.columns:
            raise ValueError("a dataset of vectors is needed")
        times, coefficients, out = series.tica(self.dataset, lag_time, tica_dim)
        return times, coefficients, Insight(out, self.meta | {"name": "tica", "lag_time": lag_time, "tica_dim": tica_dim})

    def get_onion(self, delta_t: int, bins: int | str = "auto", number_of_sigmas: float = 2.0) -> OnionInsight:
        states, labels = onion.onion(self.dataset, delta_t, bins, number_of_sigmas)
        return OnionInsight(labels, self.meta | {"delta_t": delta_t, "bins": bins, "number_of_sigmas": number_of_sigmas}, [s.as_dict() for s in states], onion.windows(self.dataset, delta_t))

    def get_onion_smooth(self, delta_t: int, bins: int | str = "auto", number_of_sigmas: float = 3.0, max_area_overlap: float = 0.8) -> OnionSmoothInsight:
        states, labels = onion.onion(self.dataset, delta_t, bins, number_of_sigmas, True, max_area_overlap)
        return OnionSmoothInsight(labels, self.meta | {"delta_t": delta_t, "bins": bins, "number_of_sigmas": number_of_sigmas, "max_area_overlap": max_area_overlap}, [s.as_dict() for s in states])

    def get_onion_analysis(self, delta_t_min: int = 1, delta_t_max: int | None = None, delta_t_num: int = 20, bins: int | str = "auto", number_of_sigmas: float = 3.0, max_area_overlap: float = 0.8) -> tuple[DataFrame, DataFrame]:
        """(summary (delta_t, n_clusters, unclassified), labels (particle_id, frame, delta_t, label)). n_clusters counts a scan's states."""
        states, labels = onion.onion_scan(self.dataset, delta_t_min, delta_t_max, delta_t_num, bins, number_of_sigmas, max_area_overlap)
        counts = self.dataset.sparkSession.createDataFrame([(k, len(v)) for k, v in states.items()], "delta_t int, n_clusters int")
        return scan_summary(labels).drop("n_clusters").join(counts, "delta_t").select("delta_t", "n_clusters", "unclassified"), labels


@dataclass(frozen=True)
class ClusterInsight:
    labels: DataFrame
    meta: dict = field(default_factory=dict)

    def dump_to_json(self, path: str) -> None:
        tables.dump(path, {"labels": self.labels}, meta=self.meta)

    @classmethod
    def load_from_json(cls, spark: SparkSession, path: str) -> ClusterInsight:
        fields, found = tables.load(spark, path, "labels")
        return cls(found["labels"], fields.get("meta", {}))

    def cleaned(self, threshold: float, assigned: int, excluded=None) -> ClusterInsight:
        return replace(self, labels=clean_population(self.labels, threshold, assigned, excluded))


@dataclass(frozen=True)
class OnionInsight(ClusterInsight):
    """Windows' labels (particle_id, window, label), their states, and the windows' values."""

    state_list: list[dict] = field(default_factory=list)
    reshaped_data: DataFrame | None = None

    def dump_to_json(self, path: str) -> None:
        tables.dump(path, {"labels": self.labels, "reshaped_data": self.reshaped_data}, meta=self.meta, state_list=self.state_list)

    @classmethod
    def load_from_json(cls, spark: SparkSession, path: str) -> OnionInsight:
        fields, found = tables.load(spark, path, "labels", "reshaped_data", needed=("state_list",))
        return cls(found["labels"], fields.get("meta", {}), fields["state_list"], found["reshaped_data"])

    def by_frame(self) -> DataFrame:
        dt = self.meta["delta_t"]
        return self.labels.select("particle_id", F.explode(F.sequence(F.col("window") * dt, (F.col("window") + 1) * dt - 1)).cast("int").alias("frame"), "label")

    def medoids(self) -> DataFrame:
        return window_means(self.reshaped_data.drop("window"), self.labels, self.meta["delta_t"])

    def state_populations(self) -> DataFrame:
        return state_populations(self.by_frame())

    def sankey(self, frames: Sequence[int]) -> DataFrame:
        return transitions(self.by_frame(), frames)


@dataclass(frozen=True)
class OnionSmoothInsight(ClusterInsight):
    """Frames' labels (particle_id, frame, label) and their states."""

    state_list: list[dict] = field(default_factory=list)

    def dump_to_json(self, path: str) -> None:
        tables.dump(path, {"labels": self.labels}, meta=self.meta, state_list=self.state_list)

    @classmethod
    def load_from_json(cls, spark: SparkSession, path: str) -> OnionSmoothInsight:
        fields, found = tables.load(spark, path, "labels", needed=("state_list",))
        return cls(found["labels"], fields.get("meta", {}), fields["state_list"])

    def state_populations(self) -> DataFrame:
        return state_populations(self.labels)

    def sankey(self, frames: Sequence[int]) -> DataFrame:
        return transitions(self.labels, frames)

    def dump_colored_trj(self, trj: Trajectory, path: str) -> None:
        xyz.write_text(xyz.colored_blocks(trj.positions, self.labels, comment="frame"), path)


@dataclass(frozen=True)
class Trajectory:
    """Positions (frame, particle_id, name, type, x, y, z[, vx, vy, vz]) and the box: three lengths, a table (frame, lx, ly, lz[, alpha, beta, gamma]), or None."""

    positions: DataFrame
    box: object = None
    dt: float = 1.0
    frames: tuple[int, int | None, int] | None = None
    source: DataFrame | None = None

    @classmethod
    def from_xyz(cls, spark: SparkSession, path: str, dt: float = 1.0, box=None) -> Trajectory:
        return cls(xyz.positions_of(xyz.read_xyz(spark, path, "auto")), box, dt)

    @classmethod
    def from_gro(cls, spark: SparkSession, path: str, dt: float = 1.0) -> Trajectory:
        positions, frames = gro.read_gro(spark, path)
        return cls(positions, frames, dt)

    @classmethod
    def from_xtc(cls, spark: SparkSession, path: str, topology: str, dt: float = 1.0) -> Trajectory:
        """Coordinates and boxes of an XTC file, names and types of a GRO file's first frame."""
        positions, frames = xtc.read_xtc(spark, path)
        return cls(xtc.named(positions, gro.read_gro(spark, topology)[0]), frames, dt)

    @classmethod
    def from_table(cls, spark: SparkSession, path: str, start: int = 0, stop: int | None = None, step: int = 1, box=None) -> Trajectory:
        return cls(tables.read_trajectory(spark, path, start, stop, step), box)

    def options(self) -> dict:
        return {"box": self.box}

    def n_atoms(self) -> int:
        return self.positions.select("particle_id").distinct().count()

    def n_frames(self) -> int:
        return self.positions.select("frame").distinct().count()

    def times(self) -> DataFrame:
        return self.positions.select("frame").distinct().select("frame", (F.col("frame") * self.dt).alias("time"))

    def get_coordinates(self, selection="all") -> DataFrame:
        return self.positions.where(selected(selection)).select("frame", "particle_id", "x", "y", "z")

    def with_slice(self, start: int = 0, stop: int | None = None, step: int = 1) -> Trajectory:
        """A slice replaces an earlier one; both are of the whole trajectory."""
        whole = self.positions if self.source is None else self.source
        box = xyz.frame_slice(self.box, start, stop, step) if isinstance(self.box, DataFrame) else self.box
        return replace(self, positions=xyz.frame_slice(whole, start, stop, step), box=box, frames=(start, stop, step), source=whole)

    def get_slice(self, start: int = 0, stop: int | None = None, step: int = 1) -> Trajectory:
        """The slice, kept in memory."""
        out = self.with_slice(start, stop, step)
        return replace(out, positions=out.positions.cache())

    def neighbors(self, r_cut: float, centers="all", selection="all", respect_pbc: bool = True) -> DataFrame:
        if respect_pbc and self.box is None:
            LOG.warning("No box: the extent of each frame serves as one.")
        return neighbor_edges(self.positions, r_cut, self.box, respect_pbc, centers, selection)

    def get_coord_number(self, r_cut: float, centers="all", selection="all", respect_pbc: bool = True, neighcounts: DataFrame | None = None) -> tuple[DataFrame, Insight]:
        edges = self.neighbors(r_cut, centers, selection, respect_pbc) if neighcounts is None else neighcounts
        out = descriptors.coordination_number(self.positions, edges=edges, centers=centers)
        return edges, Insight(out, {"name": "coord_number", "r_cut": r_cut, "centers": str(centers), "selection": str(selection)})

    def get_lens(self, r_cut: float, delay: int = 1, centers="all", selection="all", respect_pbc: bool = True) -> Insight:
        out = descriptors.lens(self.positions, r_cut, delay, centers, selection=selection, respect_pbc=respect_pbc, box=self.box)
        return Insight(out, {"name": "lens", "r_cut": r_cut, "delay": delay, "centers": str(centers), "selection": str(selection)})

    def get_soap(self, r_cut: float, n_max: int = 8, l_max: int = 8, selection="all", centers="all", respect_pbc: bool = True, path: str | None = None) -> Insight:
        meta = {"name": "soap", "r_cut": r_cut, "n_max": n_max, "l_max": l_max, "respect_pbc": respect_pbc, "selection": str(selection), "centers": str(centers)}
        make = lambda: soap.soap(self.positions, r_cut, n_max, l_max, self.box, respect_pbc, centers, selection)
        return Insight(tables.load_or_compute(self.positions.sparkSession, path, make, **meta), meta)

    def get_timesoap(self, r_cut: float | None = None, n_max: int | None = None, l_max: int | None = None, soap_insight: Insight | None = None, delay: int = 1, **options) -> tuple[Insight, Insight]:
        if soap_insight is None:
            if None in (r_cut, n_max, l_max):
                raise ValueError("r_cut, n_max and l_max are needed without a SOAP dataset")
            soap_insight = self.get_soap(r_cut, n_max, l_max, **options)
        if soap_insight.meta.get("name") != "soap":
            raise ValueError("the dataset isn't of SOAP spectra")
        return soap_insight, soap_insight.get_angular_velocity(delay)

    def get_orientational_op(self, r_cut: float, order: int = 6, centers="all", edges: DataFrame | None = None, respect_pbc: bool = True) -> tuple[DataFrame, Insight]:
        edges = self.neighbors(r_cut, centers, "all", respect_pbc) if edges is None else edges
        return edges, Insight(descriptors.orientational_order(self.positions, edges, order, centers=centers), {"name": "orientational_op", "r_cut": r_cut, "order": order, "centers": str(centers)})

    def get_velocity_alignment(self, r_cut: float, edges: DataFrame | None = None, respect_pbc: bool = True, reference: str = "first") -> tuple[DataFrame, Insight]:
        edges = self.neighbors(r_cut, "all", "all", respect_pbc) if edges is None else edges
        return edges, Insight(descriptors.velocity_alignment(self.positions, edges, reference), {"name": "velocity_alignment", "r_cut": r_cut})

    def get_rdf(self, distances_range: tuple[float, float], s1="all", s2="all", exclusion_block=None, nbins: int = 200, norm: str = "rdf") -> DataFrame:
        return series.rdf(self.positions, distances_range, self.box, s1, s2, exclusion_block, nbins, norm)

    def dump_colored_trj(self, labels: DataFrame, path: str) -> None:
        xyz.write_text(xyz.colored_blocks(self.positions, labels, self.box), path)

    def dump_xyz_with_insight(self, insights: Sequence[Insight], path: str) -> None:
        xyz.write_text(xyz.insight_blocks(self.positions, [i.dataset for i in insights], self.box), path)


def track_xyz(spark: SparkSession, input_xyz: str, output_xyz: str, search_range: float, memory: int = 1, adaptive_stop: float | None = 0.95, adaptive_step: float | None = 0.5, largest_group: int | None = tracking.LARGEST_GROUP) -> Trajectory:
    """Links the detections of an XYZ file, writes the tracks, and reads them back."""
    import os

    if not os.path.exists(input_xyz):
        raise FileNotFoundError(input_xyz)
    rows = xyz.read_xyz(spark, input_xyz, "auto").drop("path")
    out = tracking.track(rows, search_range, memory, adaptive_stop, adaptive_step, largest_group=largest_group).drop("row")
    xyz.write_text(xyz.track_blocks(out), output_xyz)
    return Trajectory.from_xyz(spark, output_xyz, 1.0)
