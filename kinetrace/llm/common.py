"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_at_exit, remove_path, shared_dir, ship

#: Words are maximal runs of characters other than these (as Java regex and as translate() argument).
WS_CLASS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"


def tune(spark: SparkSession) -> None:
    """Ship the package and bound the Arrow batches, unless the session sets bounds of its own: documents may be long, so a batch holds few of them."""
    ship(spark)
    now = spark._jsparkSession.sessionState().conf()
    for key, value in (("maxRecordsPerBatch", 500), ("maxBytesPerBatch", 16 << 20)):
        if not now.contains(f"spark.sql.execution.arrow.{key}"):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


#: How tables of our own are written where the shared folder is a local path: Hadoop's default starts a process that sets the mode of each file and of the checksum file beside it, and that process shares all of the JVM's memory until it runs its program. Other stores don't read these.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage in a way that survives lost executors. What nobody discards goes when the application ends."""
    path = shared_dir(df.sparkSession)
    writer = df.write.option("compression", "zstd").options(**PLAIN_FILES)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    remove_at_exit(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and nothing reads any more."""
    for t in tables:
        remove_path(t.sparkSession, t.written_to)


def give_back() -> None:
    """Return to the system the memory that this Python process no longer uses."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished jobs now; it only learns of them when the driver collects its garbage. The driver's Python gives back what it no longer uses too."""
    gc.collect()
    give_back()
    spark.sparkContext._jvm.System.gc()


def free_executors(spark: SparkSession) -> None:
    """Let the executors' JVMs give back what finished tasks left: a heap grows with each stage and shrinks only when all of it is collected. A task for each core, so that an idle cluster gives every executor some."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).collect()  # a word from each


def finished(result: DataFrame, *tables: DataFrame) -> DataFrame:
    """A small result, written and read back, so that whoever reads it finds executors that hold nothing of the stages that made it. tables: what only the result read, deleted here."""
    out = materialize(result)
    discard(*tables)
    free_shuffles(result.sparkSession)
    free_executors(result.sparkSession)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    tune(spark)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """Deal an input that came in fewer splits than there are cores over more tasks; large inputs stay as they are read."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with the package on the workers, which are kept for later tasks: when a task ends its worker gives back what it used."""
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """The same with a function of one batch, which has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return in_arrow(df, run, schema)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches with rows, put together until they hold so many bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def crc_of_id(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string"))


def fold_of(doc_ids: pa.Array, modulus: int) -> np.ndarray:
    """crc32 of the id's decimal text, modulo a number; a null id counts as the empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % modulus for i in doc_ids.to_pylist()], np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Invertible mixing of 64-bit words (xor-shift-multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Bits and parts of a filter of ids, of fixed size: 16 MB.
FILTER_BITS, FILTER_PARTS = 27, 16


class IdFilter:
    """A broadcast bitmap of hashed ids, so that most rows a semi-join would drop are dropped before its shuffle. It lets strangers pass where bits are shared, so the exact join must follow."""

    def __init__(self, ids: DataFrame, column: str = "doc_id") -> None:
        size = 1 << FILTER_BITS - 3

        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, np.ndarray] = {}
            for b in batches:
                at = _bit_of(b.column(0))
                for k in np.unique(at >> FILTER_BITS - 4):
                    here = at[at >> FILTER_BITS - 4 == k] - (k << FILTER_BITS - 4)
                    np.bitwise_or.at(parts.setdefault(int(k), np.zeros(size // FILTER_PARTS, np.uint8)), here >> 3, np.uint8(1) << (here & 7).astype(np.uint8))
            for k, part in parts.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zstandard.compress(part.tobytes(), 1)])], ["part", "bits"])

        def part_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((_bit_of(batch.column(0)) >> FILTER_BITS - 4).astype(np.int32))], ["id", "part"])

        dealt = map_arrow(ids.select(column).where(F.col(column).isNotNull()), part_of, "id long, part int").repartition(FILTER_PARTS, "part")
        all_bits = np.zeros(size, np.uint8)
        for k, part in in_arrow(dealt.select("id"), bits, "part int, bits binary").collect():  # 16 parts of fixed size
            all_bits[k * (size // FILTER_PARTS) : (k + 1) * (size // FILTER_PARTS)] = np.frombuffer(zstandard.decompress(part), np.uint8)
        self.column, self.shared = column, ids.sparkSession.sparkContext.broadcast(all_bits)

    def passed(self, df: DataFrame) -> DataFrame:
        """The rows whose id may be among the ids; null ids are not."""
        keep = self.keeper()

        def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield keep(batch)

        return map_arrow(df, one, df.schema)

    def keeper(self) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        """The same of a batch, for functions that run on the workers."""
        column, shared = self.column, self.shared

        def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column(batch.schema.get_field_index(column))
            at = _bit_of(ids.fill_null(0))
            return batch.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) & ~ids.is_null().to_numpy(zero_copy_only=False)))

        return keep

    def destroy(self) -> None:
        self.shared.destroy()


def _bit_of(ids: pa.Array) -> np.ndarray:
    return (mix64(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int, base: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006 - a cache
    have = known.get(base)
    if have is None or len(have) < n:
        out, filled = np.ones(max(n, 1 << 16), np.uint64), 1
        while filled < len(out):
            step = min(filled, len(out) - filled)
            out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
            filled += step
        known[base] = have = out
    return have[:n]


_IS_WS = np.zeros(256, bool)
_IS_WS[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where the words of a text start and end."""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_IS_WS[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edge[::2], edge[1::2]


def word_hashes(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit polynomial hash of each word, with its byte span. lower: A-Z count as a-z.

    The hash of a word is sum(code[i] * B**i) over its own bytes, from differences of a prefix sum times a power of B's inverse, so no loop over words or bytes runs in Python.
    """
    start, end = word_spans(data)
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    byte = np.frombuffer(data, np.uint8)
    if lower:
        byte = np.where((byte >= 65) & (byte <= 90), byte + np.uint8(32), byte)
    sums = np.zeros(len(byte) + 1, np.uint64)
    np.cumsum(_CODES[byte] * _powers(len(byte), _BASE), out=sums[1:])
    raw = (sums[end] - sums[start]) * _powers(len(byte), _INVERSE)[start]
    return mix64(raw ^ (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), start, end


_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n word hashes."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out *= np.uint64(0xF1357AEA2E62A9C5)
        out += words[k : k + len(out)]
    return mix64(out)
