"""Label processing. Labels are rows (particle_id, frame, label) or, from a scan, (particle_id, frame, delta_t, label); -1 is unclassified."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _slices(labels: DataFrame) -> list[str]:
    return ["delta_t"] if "delta_t" in labels.columns else []


def population_fractions(labels: DataFrame) -> DataFrame:
    """([delta_t,] label, n, fraction)"""
    by = _slices(labels)
    counts = labels.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)])))  # over a row per label
    return counts.select(*by, "label", "n", (F.col("n") / total).alias("fraction"))


def clean_population(labels: DataFrame, threshold: float, assigned: int, excluded: int | Iterable[int] | None = None) -> DataFrame:
    """Labels whose share (of each delta_t) is at most the threshold become `assigned`, but for the excluded ones. Only counts are shuffled; the small table of labels goes back by a join."""
    keep = [] if excluded is None else [excluded] if isinstance(excluded, int) else list(excluded)
    by = _slices(labels)
    small = population_fractions(labels).where((F.col("fraction") <= threshold) & ~F.col("label").isin(keep))
    rows = labels.join(small.select(*by, "label", F.lit(True).alias("small")), [*by, "label"], "left")
    return rows.withColumn("label", F.when(F.col("small"), F.lit(assigned)).otherwise(F.col("label"))).select(*labels.columns)


def unknown_labels(labels: DataFrame, excluded: Iterable[int]) -> list[int]:
    """Those of the ids that no row has."""
    found = {r[0] for r in labels.where(F.col("label").isin(list(excluded))).select("label").distinct().collect()}
    return sorted(set(excluded) - found)


def state_populations(labels: DataFrame) -> DataFrame:
    """(frame, label, fraction)"""
    counts = labels.groupBy("frame", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("frame", "label", (F.col("n") / F.sum("n").over(Window.partitionBy("frame"))).alias("fraction"))


def transitions(labels: DataFrame, frames: Sequence[int]) -> DataFrame:
    """(frame, to_frame, label, to_label, n): particles that pass between labels from each chosen frame to the next."""
    order = sorted(frames)
    w = Window.partitionBy("particle_id").orderBy("frame")
    rows = labels.where(F.col("frame").isin(order)).select("particle_id", "frame", "label", F.lead("frame").over(w).alias("to_frame"), F.lead("label").over(w).alias("to_label"))
    return rows.where("to_frame is not null").groupBy("frame", "to_frame", "label", "to_label").agg(F.count(F.lit(1)).alias("n"))


def window_means(series: DataFrame, window_labels: DataFrame, delta_t: int) -> DataFrame:
    """(label, k, value): mean window of each label, k the place in the window. window_labels(particle_id, window, label)."""
    rows = series.withColumns({"window": F.floor(F.col("frame") / delta_t).cast("int"), "k": F.pmod(F.col("frame"), F.lit(delta_t)).cast("int")})
    return rows.join(window_labels, ["particle_id", "window"]).groupBy("label", "k").agg(F.avg("value").alias("value"))


def scan_summary(labels: DataFrame) -> DataFrame:
    """(delta_t, n_clusters, unclassified): by delta_t, the number of labels but -1 and the share of -1."""
    return labels.groupBy("delta_t").agg(F.countDistinct(F.when(F.col("label") != -1, F.col("label"))).alias("n_clusters"), F.avg((F.col("label") == -1).cast("double")).alias("unclassified"))
