"""GRO text: fixed columns, lengths in nm, read into angstroms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship

POSITIONS = "frame int, particle_id long, resid int, resname string, name string, type string, x double, y double, z double, vx double, vy double, vz double"
FRAMES = "frame int, time double, lx double, ly double, lz double"


#: Elements of two letters that atom names begin with; any other name stands for its first letter.
TWO_LETTERS = ("CL", "BR", "NA", "MG", "ZN", "FE", "LI", "SI", "SE", "AL", "MN", "CU", "NI")


def element(name: str) -> str:
    bare = name.strip("0123456789").upper()
    return bare[:2] if bare[:2] in TWO_LETTERS else bare[:1] or name


def parse(text: str) -> Iterator[tuple[int, float | None, list[tuple], tuple[float, float, float]]]:
    """(frame, time, atoms, box) of each frame. Columns of numbers have the width that the distance between decimal points tells."""
    lines, at, frame = text.splitlines(), 0, 0
    while at + 1 < len(lines) and lines[at + 1].strip().isdigit():
        title, n = lines[at], int(lines[at + 1])
        time = float(title.split("t=")[1].split()[0]) if "t=" in title else None
        atoms = []
        for line in lines[at + 2 : at + 2 + n]:
            first = line.index(".", 20)
            width = line.index(".", first + 1) - first
            number = lambda k, w: float(line[k : k + w]) * 10 if line[k : k + w].strip() else None  # noqa: E731, B023
            xyz = [number(20 + k * width, width) for k in range(3)]
            speed = [number(20 + (3 + k) * width, width) for k in range(3)]
            name = line[10:15].strip()
            atoms.append((int(line[:5]), line[5:10].strip(), name, element(name), *xyz, *speed))
        box = tuple(float(x) * 10 for x in lines[at + 2 + n].split()[:3])
        yield frame, time, atoms, box
        at += 3 + n
        frame += 1


def read_gro(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(positions, frames) of a file; a file is parsed by one task."""
    ship(spark)
    whole = spark.read.text(path, wholetext=True)

    def atoms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column("value").to_pylist():
                for frame, _, rows, _ in parse(text):
                    cols = list(zip(*[(frame, k, *r) for k, r in enumerate(rows)], strict=True))
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 6]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in POSITIONS.split(", ")])

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column("value").to_pylist():
                for frame, time, _, box in parse(text):
                    yield pa.RecordBatch.from_arrays([pa.array([frame], pa.int32()), pa.array([time], pa.float64()), *(pa.array([x]) for x in box)], [x.split()[0] for x in FRAMES.split(", ")])

    return whole.mapInArrow(atoms, POSITIONS), whole.mapInArrow(boxes, FRAMES)
