"""Pattern packing by non-negative least squares.

Patterns are made over lengths in units of 8 tokens, rounded up: every multiset of one to three that fills a sequence exactly is a column, and non-negative least squares (active set method) fits repeat counts to the histogram of lengths; counts are rounded to what the histogram can give. Only lengths over 128 tokens take part; shorter pieces are better kept to fill what is left. Then the true lengths come in: each slot of a pattern takes lengths of its unit, longest first, and what is left over is packed best-fit, longest first, into the true spaces of the patterns' sequences and of new ones, a run of equal lengths at a time. All this sees the histogram alone, whose size doesn't depend on the number of documents. Pieces are then dealt to the places of their length by rank, which is counted in salted parts, so a length that half of all documents have is no hot spot.

Null texts count as empty (a document of the end id alone). Rows that repeat a doc_id are placed each, also equal ones. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, finished, map_arrow, materialize, partitions, spread, text_bytes
from .encode import encoder, vocabulary

CAPACITY, UNIT, SHORT = 2048, 8, 128
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths of a document: all full but the first, which takes the rest."""
    full, rest = divmod(n, capacity)
    return [rest] * (rest > 0) + [capacity] * full


def pieces(docs: DataFrame, encode: Callable[[list[bytes]], list[np.ndarray]], end: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece, with a salt; with_ids adds the ids themselves (binary, little-endian unsigned 32-bit)."""
    salts = partitions(docs.sparkSession)

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(text_bytes(batch.column("text"))), strict=True):
            ids, at = np.append(ids, np.array(end, ids.dtype)).astype("<u4"), 0
            for k, n in enumerate(cut_lengths(len(ids), capacity)):
                part = ids[at : at + n].tobytes()
                rows.append((doc_id, k, at, n, zlib.crc32(part), len(rows) % salts, *[part] * with_ids))
                at += n
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt", "ids"]
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names[: len(cols)])

    return map_arrow(docs.select("doc_id", "text"), one, PIECES + ", salt int" + ", ids binary" * with_ids)


def full_patterns(bins: int) -> np.ndarray:
    """Every multiset of one to three lengths with sum `bins`, longest first, filled up with 0."""
    b = np.arange(1, bins // 2 + 1)
    pairs = np.stack([bins - b, b, np.zeros_like(b)], 1)
    first, third = np.meshgrid(np.arange(1, bins + 1), np.arange(1, bins // 3 + 1), indexing="ij")
    second = bins - first - third
    keep = (first >= second) & (second >= third)
    return np.concatenate([[[bins, 0, 0]], pairs, np.stack([first[keep], second[keep], third[keep]], 1)])


def nnls(parts: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns with a count over zero and their counts, least squares of (sum of columns - target) under counts >= 0.

    Lawson and Hanson's active set method. Column j adds 1 to each row parts[j, :] names; row 0 takes nothing.
    """
    rows = len(target)
    chosen: list[int] = []
    x = np.zeros(0)
    dense = np.zeros((rows, 0))
    least = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(3 * rows):
        rest = target - dense @ x if chosen else target.copy()
        rest[0] = 0
        gain = rest[parts].sum(1)
        gain[chosen] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= least * 10:
            break
        column = np.bincount(parts[j], minlength=rows).astype(float)
        column[0] = 0
        chosen.append(j)
        x, dense = np.append(x, 0.0), np.column_stack([dense, column])
        while True:
            gram = dense.T @ dense
            s = np.linalg.solve(gram + np.eye(len(chosen)) * 1e-9, dense.T @ target)
            if s.min() > 0:
                x = s
                break
            low = s <= 0
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x = x + min(step, 1.0) * (s - x)
            keep = x > 1e-12 * max(1.0, x.max())
            chosen, x, dense = [c for c, k in zip(chosen, keep, strict=True) if k], x[keep], dense[:, keep]
            if not chosen:
                break
    return np.array(chosen, np.int64), x


Group = tuple[tuple[int, ...], int]


def fill(groups: list[Group], counts: np.ndarray, capacity: int) -> list[Group]:
    """(lengths, repeats): best-fit decreasing of a histogram of lengths into the space that groups of equal sequences leave and into new ones, equal lengths at a time."""
    spaces: list[list[Group]] = [[] for _ in range(capacity + 1)]
    many_at = np.zeros(capacity + 1, np.int64)

    def put(lengths: tuple[int, ...], many: int) -> None:
        space = capacity - sum(lengths)
        spaces[space].append((lengths, many))
        many_at[space] += 1

    for g in groups:
        put(*g)
    for b in range(capacity, 0, -1):
        left = int(counts[b])
        while left:
            at = np.flatnonzero(many_at[b:])
            if not len(at):
                each = capacity // b
                for k, many in ((each, left // each), (left % each, 1)):
                    if k and many:
                        put((b,) * k, many)
                break
            s = b + int(at[0])
            have, many = spaces[s].pop()
            many_at[s] -= 1
            fit = s // b
            full = min(many, left // fit)
            if full:
                put(have + (b,) * fit, full)
                left -= full * fit
                many -= full
            elif left:
                put(have + (b,) * left, 1)
                left, many = 0, many - 1
            if many:
                put(have, many)
    return [x for group in spaces for x in group]


def fitted(units: np.ndarray, bins: int) -> list[Group]:
    """(units, repeats) of the patterns: least squares on the histogram, rounded so that no unit is used more often than it is there."""
    left = units.astype(np.int64).copy()
    parts = full_patterns(bins)
    chosen, x = nnls(parts, left.astype(float)) if left.sum() else (np.zeros(0, np.int64), np.zeros(0))
    many = np.floor(x + 1e-9).astype(np.int64)
    for j, m in zip(chosen, many, strict=True):
        np.subtract.at(left, parts[j], m)
    left[0] = 0
    for k in np.argsort(-(x - many)):  # round up where the histogram still has what the pattern needs, down (again) where it lacks it
        need = np.bincount(parts[chosen[k]], minlength=bins + 1)
        need[0] = 0
        if x[k] - many[k] >= 0.5 and (left >= need).all():
            many[k] += 1
            left -= need
        while many[k] and (left < 0).any() and (need[left < 0] > 0).any():
            many[k] -= 1
            left += need
    return [(tuple(int(b) for b in parts[j] if b), int(m)) for j, m in zip(chosen, many, strict=True) if m]


def plan(histogram: np.ndarray, unit: int = UNIT, short: int = SHORT) -> list[Group]:
    """(lengths, repeats) of sequences that use every counted length exactly once. histogram[n]: pieces of n tokens, up to the capacity."""
    capacity = len(histogram) - 1
    bins, left = capacity // unit, histogram.astype(np.int64).copy()
    units = np.zeros(bins + 1, np.int64)
    sizes = np.arange(min(short, capacity) + 1, capacity + 1)
    np.add.at(units, np.minimum(-(-sizes // unit), bins), np.where(-(-sizes // unit) <= bins, left[sizes], 0))
    groups: list[Group] = []
    for pattern, many in fitted(units, bins):
        while many:
            slots = []
            for b in pattern:  # the longest length of the unit that is left, as often as the pattern has the unit
                top = b * unit
                while not left[top] - slots.count(top):
                    top -= 1
                slots.append(top)
            run = min(many, *(int(left[n]) // slots.count(n) for n in slots))
            for n in slots:
                left[n] -= run
            groups.append((tuple(slots), run))
            many -= run
    return fill(groups, left, capacity)


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (a written table, as it is read three times)."""
    counts = found.groupBy("length", "salt").count()
    histogram = np.zeros(capacity + 1, np.int64)
    for n, many in counts.groupBy("length").agg(F.sum("count")).collect():  # a row per length: 2048 at most
        histogram[n] = many
    places: dict[int, list[tuple[int, int, int]]] = {}  # length: first rank, first sequence, offset
    base, used = 0, np.zeros(capacity + 1, np.int64)
    for lengths, many in plan(histogram):
        at = 0
        for n in lengths:
            places.setdefault(n, []).append((int(used[n]), base, at))
            used[n] += many
            at += n
        base += many
    table = {n: np.array(v, np.int64) for n, v in places.items()}
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = found.withColumn("rn", F.row_number().over(order)).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("rn") - 1)

    def seats(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        seq, at = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for n in np.unique(length):
            mine = length == n
            row = table[n][np.searchsorted(table[n][:, 0], rank[mine], side="right") - 1]
            seq[mine], at[mine] = row[:, 1] + rank[mine] - row[:, 0], row[:, 2]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(at)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_arrow(ranked.select("length", "rank", "doc_id", "piece", "start", "ids_crc32"), seats, PIECES + ", sequence_id long, offset long")


def sequences(docs: DataFrame, encode: Callable[[list[bytes]], list[np.ndarray]], end: int, placed: DataFrame) -> DataFrame:
    """sequence_id and ids (binary) of the packed sequences. doc_ids must be unique and not null."""
    rows = pieces(docs, encode, end, with_ids=True).join(placed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    rows = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("c"))
    return rows.select("sequence_id", F.unhex(F.array_join(F.transform("c", lambda x: F.hex(x["ids"])), "")).alias("ids"))


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of the documents with their place, encoded by the byte-level vocabulary with end id 0."""
    path = path or vocabulary("byte_bpe_50k.json")
    found = materialize(pieces(spread(docs.select("doc_id", "text")), lambda texts: encoder(path, False).encode(texts), 0))
    return finished(place(found), found)


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir, "doc_id", "text"))
