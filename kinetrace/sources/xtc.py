"""XTC: compressed binary trajectories, lengths in nm, read into angstroms.

A frame is a header (magic, atoms, step, time, box), then either plain floats (nine atoms or fewer) or whole numbers, coordinates times a precision, packed into a bit stream: an atom in full, by its place in the frame's bounding box, then a run of up to eight atoms by their small distances from the one before, the first of which changes places with the atom in full. The width of small distances follows a fixed ladder and moves by a rung after a run.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

MAGIC, MAGIC_LARGE, PLAIN = 1995, 2023, 9
#: The format's ladder of small ranges (fixed values); the first nine rungs aren't used.
LADDER = (
    0, 0, 0, 0, 0, 0, 0, 0, 0, 8, 10, 12, 16, 20, 25, 32, 40, 50, 64, 80, 101, 128, 161, 203, 256, 322, 406, 512, 645, 812, 1024, 1290, 1625, 2048, 2580, 3250, 4096, 5060, 6501, 8192, 10321, 13003, 16384, 20642, 26007, 32768, 41285, 52015, 65536,
    82570, 104031, 131072, 165140, 208063, 262144, 330280, 416127, 524287, 660561, 832255, 1048576, 1321122, 1664510, 2097152, 2642245, 3329021, 4194304, 5284491, 6658042, 8388607, 10568983, 13316085, 16777216,
)
LOWEST = 9
POSITIONS = "frame int, particle_id long, x double, y double, z double"
FRAMES = "frame int, step int, time double, lx double, ly double, lz double, alpha double, beta double, gamma double"


class Bits:
    """Numbers of any width from bytes, the highest bit first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        self.at += n
        return int.from_bytes(self.data[first:last], "big") >> (last * 8 - self.at) & ((1 << n) - 1)

    def triple(self, n: int, sizes: list[int]) -> np.ndarray:
        """Three numbers packed as one of n bits, bytes from the lowest on: the last below sizes[2], the one before below sizes[1]."""
        value, shift = 0, 0
        while n > 0:
            value |= self.take(min(8, n)) << shift
            shift, n = shift + 8, n - 8
        value, c = divmod(value, sizes[2])
        a, b = divmod(value, sizes[1])
        return np.array([a, b, c], np.int64)


def unpack(data: bytes, atoms: int, low: list[int], high: list[int], rung: int) -> np.ndarray:
    """(atoms, 3) whole numbers of a packed frame."""
    bits, sizes = Bits(data), [b - a + 1 for a, b in zip(low, high, strict=True)]
    wide = any(s > 0xFFFFFF for s in sizes)
    width = (sizes[0] * sizes[1] * sizes[2]).bit_length()
    base = np.array(low, np.int64)
    out, at, run = np.empty((atoms, 3), np.int64), 0, 0
    while at < atoms:
        full = base + (np.array([bits.take(s.bit_length()) for s in sizes], np.int64) if wide else bits.triple(width, sizes))
        move = 0
        if bits.take(1):
            code = bits.take(5)
            move = code % 3 - 1
            run = code // 3
        before, slot = full, at
        for k in range(run):
            before = before + bits.triple(rung, [LADDER[rung]] * 3) - LADDER[rung] // 2
            if k == 0:  # the first small one stands before the one in full
                out[slot], slot = before, slot + 1
                out[slot], slot = full, slot + 1
            else:
                out[slot], slot = before, slot + 1
        if not run:
            out[slot], slot = full, slot + 1
        at = slot
        rung += move
    return out


def box_of(matrix: np.ndarray) -> tuple[float, ...]:
    """Lengths (angstroms) and angles (degrees) of a box of three vectors (nm); nulls become 0 and 90."""
    lengths = np.sqrt((matrix**2).sum(1))
    angles = []
    for i, j in ((1, 2), (0, 2), (0, 1)):
        both = lengths[i] * lengths[j]
        angles.append(float(np.degrees(np.arccos(np.clip(matrix[i] @ matrix[j] / both, -1, 1)))) if both else 90.0)
    return (*(lengths * 10).tolist(), *angles)


def parse(data: bytes) -> Iterator[tuple[int, int, float, np.ndarray, np.ndarray]]:
    """(frame, step, time, box vectors in nm, coordinates in nm) of each frame; ValueError where the bytes are none or cut short."""
    at, frame = 0, 0
    while at < len(data):
        try:
            magic, atoms, step, time = struct.unpack_from(">iiif", data, at)
            if magic not in (MAGIC, MAGIC_LARGE):
                raise ValueError("not an XTC frame")
            box = np.array(struct.unpack_from(">9f", data, at + 16), float).reshape(3, 3)
            at += 52
            if struct.unpack_from(">i", data, at)[0] != atoms:
                raise ValueError("an XTC frame contradicts its number of atoms")
            at += 4
            if atoms <= PLAIN:
                xyz = np.array(struct.unpack_from(f">{3 * atoms}f", data, at), float).reshape(-1, 3)
                at += 12 * atoms
            else:
                precision, *numbers = struct.unpack_from(">f7i", data, at)
                at += 32
                size = struct.unpack_from(">i" if magic == MAGIC else ">q", data, at)[0]
                at += 4 if magic == MAGIC else 8
                if at + size > len(data):
                    raise ValueError("an XTC frame is cut short")
                xyz = unpack(data[at : at + size], atoms, numbers[:3], numbers[3:6], numbers[6]) / precision
                at += -(-size // 4) * 4
        except struct.error as e:
            raise ValueError("an XTC frame is cut short") from e
        yield frame, step, time, box, xyz
        frame += 1


def read_xtc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(positions, frames) of a file, without names: these come from a topology. A file is unpacked by one task, a frame at a time."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def atoms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content").to_pylist():
                for frame, _, _, _, xyz in parse(data):
                    n = len(xyz)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, frame, np.int32)), pa.array(np.arange(n)), *(pa.array(xyz[:, k] * 10) for k in range(3))], ["frame", "particle_id", "x", "y", "z"])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content").to_pylist():
                rows = [(frame, step, time, *box_of(box)) for frame, step, time, box, _ in parse(data)]
                kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 7]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in FRAMES.split(", ")])

    return files.mapInArrow(atoms, POSITIONS), files.mapInArrow(heads, FRAMES)


def named(positions: DataFrame, topology: DataFrame) -> DataFrame:
    """Positions with the names and types that the first frame of a topology (particle_id, name, type) gives; ValueError unless both have the same particles."""
    first = topology.where(F.col("frame") == 0).select("particle_id", "name", "type")
    rows = positions.join(first, "particle_id", "left").select("frame", "particle_id", "name", "type", "x", "y", "z")
    if not rows.where("name is null").isEmpty() or first.count() != positions.where("frame = 0").count():
        raise ValueError("topology and trajectory differ in their particles")
    return rows
