"""Descriptors and tracks of frames that arrive one after another.

State is kept by particle (or trajectory): what the next frame needs and no more. Rows of one key must arrive in order of frames; a frame that isn't later than the last one is left out, as late data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracking import link_step
from ..session import ship


def recent(frames: list, kept: list, first: int) -> tuple[list, list]:
    """What is kept of frames from `first` on."""
    n = next((k for k, f in enumerate(frames) if f >= first), len(frames))
    return frames[n:], kept[n:]


def lens(lists: DataFrame, delay: int = 1) -> DataFrame:
    """(particle_id, frame, value) of a stream of neighbour lists (particle_id long, frame int, nbrs array<long>): emitted for frame - delay when a frame arrives, if that one came. State: the lists of the last `delay` frames."""
    ship(lists.sparkSession)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frames, kept = (list(x) for x in state.get) if state.exists else ([], [])
        out = []
        for f, nbrs in sorted(((int(f), [int(i) for i in n]) for pdf in parts for f, n in zip(pdf["frame"], pdf["nbrs"], strict=True)), key=lambda r: r[0]):
            if frames and f <= frames[-1]:
                continue
            frames, kept = recent(frames, kept, f - delay)
            if frames and frames[0] == f - delay:
                a, b = set(kept[0]), set(nbrs)
                total = len(a) + len(b)
                out.append((key[0], frames[0], (total - 2 * len(a & b)) / total if total else 0.0))
            frames.append(f)
            kept.append(nbrs)
        state.update((frames, [list(k) for k in kept]))
        yield pd.DataFrame(out, columns=["particle_id", "frame", "value"])

    return lists.groupBy("particle_id").applyInPandasWithState(step, "particle_id long, frame int, value double", "frames array<int>, kept array<array<long>>", "append", GroupStateTimeout.NoTimeout)


def drift(vectors: DataFrame, delay: int = 1) -> DataFrame:
    """(particle_id, frame, value) of a stream of spectra (particle_id long, frame int, vec array<double>): distance to the spectrum `delay` frames on."""
    ship(vectors.sparkSession)

    def distance(a: np.ndarray, b: np.ndarray) -> float:
        n = np.sqrt((a @ a) * (b @ b))
        return float(np.sqrt(max(0.0, 2 - 2 * np.clip((a @ b) / n if n else 0.0, -1, 1))))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frames, kept = (list(x) for x in state.get) if state.exists else ([], [])
        out = []
        for f, v in sorted(((int(f), [float(x) for x in v]) for pdf in parts for f, v in zip(pdf["frame"], pdf["vec"], strict=True)), key=lambda r: r[0]):
            if frames and f <= frames[-1]:
                continue
            frames, kept = recent(frames, kept, f - delay)
            if frames and frames[0] == f - delay:
                out.append((key[0], frames[0], distance(np.array(kept[0]), np.array(v))))
            frames.append(f)
            kept.append(v)
        state.update((frames, [list(k) for k in kept]))
        yield pd.DataFrame(out, columns=["particle_id", "frame", "value"])

    return vectors.groupBy("particle_id").applyInPandasWithState(step, "particle_id long, frame int, value double", "frames array<int>, kept array<array<double>>", "append", GroupStateTimeout.NoTimeout)


def track(detections: DataFrame, search_range: float, memory: int = 1, adaptive_stop: float | None = None, adaptive_step: float | None = None, largest_group: int | None = None) -> DataFrame:
    """(trajectory, frame, x, y, z, particle_id) of a stream of detections (trajectory long, frame int, x, y, z double). A frame must arrive whole. Groups of candidates of any size are solved, unless largest_group says from which size on the reach is shortened, which ends the stream where it falls under adaptive_stop. State: where the live tracks are, and when each was last seen."""
    ship(detections.sparkSession)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        xs, ys, zs, seen, ids, fresh, last = state.get if state.exists else ([], [], [], [], [], 0, -1)
        where, seen, ids = np.array([xs, ys, zs], float).T.reshape(-1, 3), np.array(seen, np.int64), np.array(ids, np.int64)
        rows = pd.concat(list(parts))
        out = []
        for f, new in rows[rows["frame"] > last].groupby("frame", sort=True):
            alive = seen >= f - 1 - memory
            where, seen, ids = where[alive], seen[alive], ids[alive]
            xyz = new.sort_values(["x", "y", "z"])[["x", "y", "z"]].to_numpy(float)
            linked = link_step(where, xyz, search_range, adaptive_stop, adaptive_step, largest_group)
            for j, p in enumerate(xyz):
                if j in linked:
                    k = linked[j]
                    where[k], seen[k] = p, f
                else:
                    k = len(ids)
                    where, seen, ids, fresh = np.vstack([where, p]), np.append(seen, f), np.append(ids, fresh), fresh + 1
                out.append((key[0], int(f), *map(float, p), int(ids[k])))
            last = int(f)
        state.update((where[:, 0].tolist(), where[:, 1].tolist(), where[:, 2].tolist(), seen.tolist(), ids.tolist(), int(fresh), last))
        yield pd.DataFrame(out, columns=["trajectory", "frame", "x", "y", "z", "particle_id"])

    kept = "xs array<double>, ys array<double>, zs array<double>, seen array<long>, ids array<long>, fresh long, last long"
    return detections.groupBy("trajectory").applyInPandasWithState(step, "trajectory long, frame int, x double, y double, z double, particle_id long", kept, "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, width: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """(start, event_type, n, total) of a stream of events (ts, event_type, value), by tumbling windows of event time; data later than the watermark is dropped."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
