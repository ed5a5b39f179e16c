"""Stored trajectories, datasets with a JSON sidecar, and reference sets: Parquet folders."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists, read_small, write_small
from .xyz import frame_slice

CHUNK = 100
FLOATS = {"float64": "double", "float32": "float"}


def write_trajectory(positions: DataFrame, path: str, chunk: int = CHUNK, override: bool = False, start: int = 0, stop: int | None = None, step: int = 1, usetype: str = "float64", attrs: dict | None = None) -> None:
    """Positions partitioned by chunks of frames, so that a slice of frames reads its chunks only."""
    kind = FLOATS[usetype]
    rows = frame_slice(positions, start, stop, step)
    rows = rows.select(*[F.col(c).cast(kind) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes])
    rows.withColumn("frame_chunk", F.floor(F.col("frame") / chunk).cast("int")).repartition("frame_chunk").write.partitionBy("frame_chunk").mode("overwrite" if override else "errorifexists").parquet(path)
    meta = {"chunk": chunk, "attrs": attrs or {}}
    positions.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta")


def read_trajectory(spark: SparkSession, path: str, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """A slice of frames, numbered anew; the chunks outside it aren't read."""
    meta = json.loads(spark.read.text(f"{path}/_meta").first()["value"])
    rows = spark.read.parquet(path).where(F.col("frame_chunk") >= start // meta["chunk"])
    if stop is not None:
        rows = rows.where(F.col("frame_chunk") <= max(0, stop - 1) // meta["chunk"])
    return frame_slice(rows.drop("frame_chunk"), start, stop, step)


def dump(path: str, tables: dict[str, DataFrame], **fields) -> None:
    """<base>.json with the fields, and `<name>_file` for each table, written as Parquet beside it."""
    base = path.removesuffix(".json")
    for name, df in tables.items():
        folder = f"{base}_{name}.parquet"
        df.write.mode("overwrite").parquet(folder)
        fields[f"{name}_file"] = os.path.basename(folder)
    write_small(next(iter(tables.values())).sparkSession, f"{base}.json", json.dumps(fields, indent=4))


def load(spark: SparkSession, path: str, *tables: str, needed: tuple[str, ...] = ()) -> tuple[dict, dict[str, DataFrame]]:
    """(fields, tables) of a sidecar; ValueError if it lacks a table or a needed field. A table may also be a local NPY file of shape (particle, frame[, component])."""
    fields = json.loads(read_small(spark, path))
    missing = [k for k in (*(f"{t}_file" for t in tables), *needed) if k not in fields]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    found = {}
    for t in tables:
        where = os.path.join(os.path.dirname(path), fields[f"{t}_file"])
        found[t] = from_array(spark, np.load(where, allow_pickle=False)) if where.endswith(".npy") else spark.read.parquet(where)
    return fields, found


def from_array(spark: SparkSession, a: np.ndarray) -> DataFrame:
    """(particle_id, frame, value) of an array (particle, frame), or (.., vec) of (particle, frame, component)."""
    if a.ndim not in (2, 3):
        raise ValueError("a dataset has two or three axes")
    rows = [(p, f, v) for p, one in enumerate(a.astype(float).tolist()) for f, v in enumerate(one)]
    return spark.createDataFrame(rows, f"particle_id long, frame int, {'value double' if a.ndim == 2 else 'vec array<double>'}")


def to_array(rows: DataFrame) -> np.ndarray:
    """The array of a small dataset, for callers that hold it in memory."""
    column = "vec" if "vec" in rows.columns else "label" if "label" in rows.columns else "value"
    pdf = rows.select("particle_id", "frame", column).orderBy("particle_id", "frame").toPandas()
    n = pdf["particle_id"].nunique()
    values = np.stack(pdf[column].to_numpy()) if column == "vec" else pdf[column].to_numpy()
    return values.reshape(n, -1, *values.shape[1:])


def load_or_compute(spark: SparkSession, path: str | None, compute: Callable[[], DataFrame], **parameters) -> DataFrame:
    """What is stored at path, if it was made with these parameters (ValueError else); or what compute() gives, stored there."""
    if path is None:
        return compute()
    side = path.removesuffix(".json") + ".json"
    if path_exists(spark, side):
        fields, tables = load(spark, side, "dataset")
        if fields.get("meta") != parameters:
            raise ValueError(f"{path} was made with {fields.get('meta')}")
        return tables["dataset"]
    dump(side, {"dataset": compute()}, meta=parameters)
    return load(spark, side, "dataset")[1]["dataset"]
