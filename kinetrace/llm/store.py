"""Token-ID output: a content-addressed store of id streams.

Rolling hashes over ids cut each document's stream into chunks; a chunk is stored once under its SHA-256; a recipe per document lists its chunks; a Merkle tree over the recipes proves the whole. A store is a folder of three Parquet tables:

    kind=chunks  key binary (SHA-256 of the ids as little-endian unsigned 16- or 32-bit integers), n int, ids binary
    recipes      part int, row long, doc_id long, at long, n_tokens long, keys binary, rest array<long>; parts in ascending doc_id order (nulls first), row and at count the part's rows and ids before; keys: 32 bytes a chunk; rest: the number of ids after each chunk
    manifest     part int, first long, n_docs long, n_tokens long, root binary: a row per part of the recipes with its Merkle root and the ids before it; part -1 has the root over the parts' and the totals; part -2 the number of chunks, of their ids, and a digest of the set of keys

open_store() opens a folder. Reading recomputes leaves, roots and the set of keys from the files, hashes chunks and adds up their lengths; whatever was changed, dropped, added or swapped is an error.

Null texts count as empty: such a document holds only the end id. Repeated doc_ids are separate documents, in order of their length and recipe; null ids come first. An empty table gives an empty store. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists, remove_at_exit, remove_path, shared_dir
from .common import documents, gathered, in_arrow, map_arrow, mix64, partitions, spread, text_bytes
from .encode import encoder, vocabulary

WINDOW, BLOCK = 16, 1 << 15
MEAN, LEAST, MOST = 256, 64, 1024
END = 2
#: Keys of chunks sent that a task remembers.
REMEMBERED = 1 << 16
#: Bytes of texts that are encoded at once, at least: words that they share are looked up once.
GATHERED = 2 << 20


def chunk_marks(ids: np.ndarray, mean: int = MEAN) -> np.ndarray:
    """Ends that the rolling hash allows: where that of the last 16 ids is 0 modulo `mean`. Streams may stand one after another, as no chunk is shorter than the window. Blocks that fit a core's cache overlap by a window."""
    out = [np.zeros(0, np.int64)]
    for at in range(0, len(ids), BLOCK):
        first = max(0, at - WINDOW + 1)
        h, k = mix64(ids[first : at + BLOCK].astype(np.uint64) + np.uint64(1)), 1
        while k < WINDOW:  # sums over twice as many ids
            h[k:] += h[:-k] << np.uint64(k)
            k *= 2
        out.append(np.flatnonzero(mix64(h[at - first :]) % np.uint64(mean) == 0) + at + 1)
    return np.concatenate(out)


def cut_points(marks: Sequence[int], start: int, end: int, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of the stream from start to end: the next mark `least` ids on at least and `most` at most; the stream's end ends one too."""
    out, at = [], start
    while end - at > least:
        k = bisect_left(marks, at + least)
        at = min(marks[k] if k < len(marks) else end, at + most, end)
        out.append(at)
    return out if at == end else [*out, end]


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256; an odd node moves up as it is."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@dataclass
class Store:
    chunks: DataFrame
    recipes: DataFrame
    manifest: DataFrame


CHUNKS = "key binary, n long, ids binary"
RECIPES = "part int, row long, doc_id long, at long, n_tokens long, keys binary, rest array<long>"
MANIFEST = "part int, first long, n_docs long, n_tokens long, root binary"


def open_store(spark: SparkSession, path: str) -> Store:
    """The store in a folder. Nothing is read or verified yet."""
    table = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}") if path_exists(spark, f"{path}/{name}") else spark.createDataFrame([], schema)
    return Store(table("kind=chunks", CHUNKS), table("recipes", RECIPES), table("manifest", MANIFEST))


def write_store(docs: DataFrame, encode: Callable[[list[bytes]], list[np.ndarray]], end: int | None, path: str | None = None) -> Store:
    """Cut, deduplicate and write to a new folder (by default one that goes when the application ends). encode: from UTF-8 texts to unsigned ids; end: id after each document.

    One pass encodes. A task sends a chunk once, as far as it remembers; chunks go to the task of their key, sorted, so that of equal ones the first stays and none is held. Recipes ride along, then are dealt out by ranges of all that orders them, so many rows of one doc_id are split too.
    """
    spark = docs.sparkSession
    if path is None:
        path = shared_dir(spark)
        remove_at_exit(spark, path)
    fields = "kind string, key binary, doc_id long, n long, ids binary, keys binary, rest array<long>"
    names = [x.split()[0] for x in fields.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in gathered(batches, GATHERED):
            if len(seen) > REMEMBERED:
                seen = set()
            rows = []
            streams = encode(text_bytes(batch.column("text")))
            tail = np.array([] if end is None else [end], streams[0].dtype)
            joined = np.concatenate([x for s in streams for x in (s, tail)])
            marks, data, size, to = chunk_marks(joined).tolist(), joined.tobytes(), joined.itemsize, 0
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), streams, strict=True):
                keys, rest, at, last = [], [], to, to + len(ids) + len(tail)
                first = at
                for to in cut_points(marks, at, last):
                    part = data[at * size : to * size]
                    key = hashlib.sha256(part).digest()
                    if key not in seen:
                        seen.add(key)
                        rows.append(("chunks", key, None, to - at, part, None, None))
                    keys.append(key)
                    rest.append(last - to)
                    at = to
                keys = b"".join(keys)
                rows.append(("drafts", hashlib.sha256(b"%d " % (doc_id or 0) + keys).digest(), doc_id, last - first, None, keys, rest))
            kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            n, key = batch.num_rows, batch.column("key")
            if not n:
                continue
            fresh = np.ones(n, bool)
            fresh[1:] = pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            fresh[0], last = key[0].as_py() != last, key[n - 1].as_py()
            yield batch.filter(pc.or_(pa.array(fresh), pc.equal(batch.column("kind"), "drafts")))

    sent = in_arrow(docs.select("doc_id", "text"), cut, fields).repartition(partitions(spark), "key").sortWithinPartitions("key")
    in_arrow(sent, once, fields).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    drafts = spark.read.schema(fields).parquet(path).where("kind = 'drafts'").select("doc_id", F.col("n").alias("n_tokens"), "keys", "rest", F.monotonically_increasing_id().alias("tie"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, at = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            ends = at + np.cumsum(batch.column("n_tokens").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), batch.column("doc_id"), pa.array(ends - batch.column("n_tokens").to_numpy()), *(batch.column(c) for c in ("n_tokens", "keys", "rest"))], [x.split()[0] for x in RECIPES.split(", ")])
            row, at = row + n, int(ends[-1]) if n else at

    order = [F.asc_nulls_first("doc_id"), F.asc("n_tokens"), F.asc("keys"), F.asc("tie")]
    ranged = drafts.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).drop("tie")
    in_arrow(ranged, placed, RECIPES).write.option("compression", "zstd").parquet(f"{path}/recipes")
    remove_path(spark, f"{path}/kind=drafts")
    store = open_store(spark, path)
    spark.createDataFrame(manifest(store), MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
    return open_store(spark, path)


def manifest(store: Store) -> list[tuple]:
    """The rows of the manifest as chunks and recipes give them. Leaves are hashed by the executors; only a digest per part reaches the driver."""
    leaf = F.sha2(F.concat(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "row", "at", "n_tokens", F.array_join(F.col("rest").cast("array<string>"), ","), F.lit("")).cast("binary"), F.col("keys")), 256)
    rows = store.recipes.select("part", "row", "n_tokens", F.unhex(leaf).alias("leaf")).repartition(partitions(store.recipes.sparkSession), "part").sortWithinPartitions("part", "row")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = []
        for batch in batches:
            for part, n, found in zip(*(batch.column(c).to_pylist() for c in ("part", "n_tokens", "leaf")), strict=True):
                if not done or part != done[-1][0]:
                    done.append([part, 0, 0, []])
                done[-1][1] += 1
                done[-1][2] += n
                done[-1][3].append(found)
                if len(done[-1][3]) >= 1 << 16:  # a bounded stack: full subtrees fold to their root
                    done[-1][3] = [merkle(done[-1][3])]
        for part, docs, tokens, leaves in done:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64()), pa.array([merkle(leaves)], pa.binary())], ["part", "n_docs", "n_tokens", "root"])

    out, before = [], 0
    for r in sorted(in_arrow(rows, roots, "part int, n_docs long, n_tokens long, root binary").collect()):  # a row per partition
        out.append((r["part"], before, r["n_docs"], r["n_tokens"], bytes(r["root"])))
        before += r["n_tokens"]
    mark = F.xxhash64("key", "n")
    n, ids, *digest = store.chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.bit_xor(mark), F.sum(mark.cast("decimal(38,0)"))).first()
    top = (-1, 0, sum(r[2] for r in out), before, merkle([r[4] for r in out]))
    return [(-2, 0, n, ids, hashlib.sha256(repr(digest).encode()).digest()), top, *out]


def verify(store: Store) -> None:
    """Compare chunks and recipes with the stored manifest: the set of keys, and roots, documents and tokens of each part."""
    stored = {tuple(r)[0]: (*tuple(r)[1:4], bytes(r["root"])) for r in store.manifest.collect()}  # a row per partition
    found = {r[0]: r[1:] for r in manifest(store)}
    wrong = sorted(p for p in stored.keys() | found.keys() if stored.get(p) != found.get(p))
    if wrong:
        raise ValueError(f"the store doesn't match its manifest in parts {wrong[:10]}")


def lines(store: Store) -> DataFrame:
    """(doc_id, start, n_tokens, row, after, key) of each chunk of each document; a document without ids has one row of nulls."""
    first = F.broadcast(store.manifest.where("part >= 0").select("part", "first"))  # a row per partition
    placed = store.recipes.join(first, "part").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "row", "keys", F.posexplode_outer("rest").alias("k", "after"))
    return placed.select("doc_id", "start", "n_tokens", "row", "after", F.expr("substring(keys, k * 32 + 1, 32)").alias("key"))


_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials modulo the CRC-32 polynomial, bits reflected."""
    a, b, out = a.copy(), b.copy(), np.zeros(np.broadcast(a, b).shape, np.uint32)
    b = np.broadcast_to(b, out.shape).copy()
    for _ in range(32):
        out ^= np.where(a & np.uint32(1 << 31), b, np.uint32(0))
        a <<= np.uint32(1)
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ _POLY, b >> np.uint32(1))
    return out


@lru_cache
def _shift_tables(k: int) -> np.ndarray:
    """(4, 256): what 2**k further bytes make of each value of each byte of a CRC-32."""
    step = np.array([1 << 23], np.uint32)  # x**8
    for _ in range(k):
        step = _times(step, step)
    values = np.arange(256, dtype=np.uint32)
    return np.stack([_times(values << np.uint32(8 * j), step) for j in range(4)])


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a CRC-32 adds to that of a text in which n_bytes bytes follow."""
    out, k = crc.astype(np.uint32), 0
    left = n_bytes.astype(np.int64)
    while left.any():
        odd = np.flatnonzero(left & 1)
        if len(odd):
            c, t = out[odd], _shift_tables(k)
            out[odd] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
        left, k = left >> 1, k + 1
    return out


def read_digests(store: Store) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of all ids as little-endian unsigned 32-bit integers), from the files alone.

    Each stored chunk is read once, checked against its key, and reduced to its CRC; the CRC of a document is the exclusive or of its chunks' CRCs, each shifted by the bytes that follow. So no ids are shuffled, and a chunk that many documents share costs a row each.
    """
    verify(store)

    def checked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        crcs, at = [], 0
        keys, ns, parts = (batch.column(c).to_pylist() for c in ("key", "n", "ids"))
        size = len(parts[0]) // ns[0]
        for key, n, data in zip(keys, ns, parts, strict=True):
            if hashlib.sha256(data).digest() != key or len(data) != n * size:
                raise ValueError(f"chunk {key.hex()} doesn't match its key")
        wide = memoryview(np.frombuffer(b"".join(parts), f"<u{size}").astype("<u4").tobytes())
        for n in ns:
            crcs.append(zlib.crc32(wide[at : at + 4 * n]))
            at += 4 * n
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(crcs, pa.int64())], ["key", "n", "crc"])

    def shifted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        crc = crc_shift(batch.column("crc").to_numpy().astype(np.uint32), batch.column("after").to_numpy() * 4)
        same = [*by, "n"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in same), pa.array(crc.astype(np.int64))], [*same, "crc"])

    by = ["doc_id", "start", "n_tokens", "row"]
    crcs = map_arrow(store.chunks, checked, "key binary, n long, crc long")
    missing = F.when(F.col("key").isNull(), F.lit(0)).otherwise(F.raise_error(F.lit("a chunk of a recipe is missing")).cast("long"))
    joined = lines(store).join(crcs, "key", "left").select(*by, F.coalesce("crc", missing).alias("crc"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("after", F.lit(0)).alias("after"))
    whole = map_arrow(joined, shifted, "doc_id long, start long, n_tokens long, row long, n long, crc long").groupBy(*by).agg(F.bit_xor("crc").alias("crc"), F.sum("n").alias("n"))
    return whole.select("doc_id", "start", "n_tokens", F.when(F.col("n") == F.col("n_tokens"), F.col("crc")).otherwise(F.raise_error(F.lit("the chunks of a recipe don't add up to its tokens"))).alias("ids_crc32"))


def read_documents(store: Store) -> DataFrame:
    """doc_id, start and ids (binary) of every document, put together again from its chunks."""
    verify(store)
    same = F.unhex(F.sha2("ids", 256)) == F.col("key")
    ids = F.when(same, F.col("ids")).when(F.col("key").isNull(), F.lit(b"")).otherwise(F.raise_error(F.lit("a chunk of a recipe is missing or doesn't match its key")).cast("binary"))
    found = lines(store).join(store.chunks, "key", "left").withColumn("ids", ids)
    rows = found.groupBy("doc_id", "start", "n_tokens", "row").agg(F.sort_array(F.collect_list(F.struct((-F.col("after")).alias("at"), "ids"))).alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    whole = F.unhex(F.array_join(F.transform("c", lambda x: F.hex(x["ids"])), ""))
    return rows.select("doc_id", "start", F.when(F.col("n") == F.col("n_tokens"), whole).otherwise(F.raise_error(F.lit("the chunks of a recipe don't add up to its tokens"))).alias("ids"))


def op3_token_store(spark: SparkSession, sf_dir: str, name: str = "word_bpe_49k.json") -> DataFrame:
    path = vocabulary(name)
    docs = spread(documents(spark, sf_dir, "doc_id", "text"))
    return read_digests(write_store(docs, lambda texts: encoder(path, True).encode(texts), END))
