"""N-gram Jaccard join by multiple-global-order filtering.

A document is the set of its distinct five-word shingles (A-Z lower-cased; a shorter text is one shingle). Two documents link when 100 * intersection >= 75 * union. Under any one order of all shingles, linked sets share one of their first n - ceil(0.75 n) + 1; this holds under several orders at once. The three orders: by count, rare ones first, as a sketch of all shingles' counts has it; by a hash; by length in bytes, long ones first.

1. One pass hashes the texts: set size, set digest, the sketch (of fixed size), a signature, and the prefixes under the second and third order as short fingerprints.
2. The first order's prefixes go to the tasks of their shingles, in packed blocks by shard; as many shards as the prefixes ask for. A shingle that very many documents have is dealt by document too. Lists of one document end there. Of documents with equal sets only the first stays listed.
3. Candidates are pairs of a list that the position filter, the signatures (counts of shingles in buckets) and both other orders' prefixes let pass: a pair must share a prefix shingle under every order before a text moves. Each listed document's best candidate among the heads of its lists is compared, and components are formed of the links found.
4. All candidates in different components, not yet compared, are compared. So groups of near copies cost a comparison per document, not per pair, yet no link between components is missed. A list is read by set size, so a document meets only those whose size allows a link; a long list is dealt in blocks.

Nulls: a null text has no words, and is linked with nothing; a row with a null doc_id has a null component and links nothing. Rows that repeat a doc_id are one document that links where one of its texts does; each has its own n_shingles. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IdFilter, discard, documents, free_shuffles, gram_hashes, in_arrow, map_arrow, materialize, mix64, partitions, spread, text_bytes, word_hashes
from .components import components

WORDS, PERCENT, ORDERS = 5, 75, 3
CELL_BITS, BLOCK_BITS = 24, 20
#: Prefix shingles of a shard, documents to a block of a long list, texts to a part of a hub, and the class (4096 documents) from which a shingle is dealt by document.
PER_SHARD, BLOCK, HUB, HOT_CLASS = 500_000, 1024, 256, 167
POSTED = ["token", "doc_id", "n", "rest", "head", "head_n", "head_rest"]
_SEEDS = [np.uint64(0x9AE16A3B2F90404F * (k + 1) % (1 << 64)) for k in range(ORDERS)]


def measured(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the shingles, and the bytes that the words of each have."""
    words, start, end = word_hashes(text, lower=True)
    if not len(words):
        return words, start
    n = min(WORDS, len(words))
    total = np.append(0, np.cumsum(end - start))
    found, at = np.unique(gram_hashes(words, n), return_index=True)
    return found, (total[n:] - total[:-n])[at]


def shingles(text: bytes) -> np.ndarray:
    return measured(text)[0]


def cells(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def prefix_size(n: int) -> int:
    """How many of a set's first shingles suffice that linked sets must share one of them."""
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def prefix(found: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The shingles of a set that come first by count."""
    return found[np.lexsort((mix64(found ^ _SEEDS[0]), classes[cells(found)]))[: prefix_size(len(found))]]


def prefix_marks(found: np.ndarray, size: np.ndarray, order: int) -> bytes:
    """Fingerprints of the shingles that come first under order 1 (by hash) or 2 (long ones first): two bytes each, or four in large sets."""
    n = len(found)
    key = mix64(found ^ _SEEDS[order])
    if order == 2:
        key = (key >> np.uint64(16)) | (np.uint64(65535) - np.minimum(size, 65535).astype(np.uint64)) << np.uint64(48)
    k = prefix_size(n)
    first = found[key <= np.partition(key, k - 1)[k - 1]]
    return np.unique(first.astype("<u4" if n > 1024 else "<u2")).tobytes()


def share(a: bytes, n: int, b: bytes, m: int) -> bool:
    """Whether two prefixes of sets of n and m shingles may share one."""
    x, y = np.frombuffer(a, "<u4" if n > 1024 else "<u2"), np.frombuffer(b, "<u4" if m > 1024 else "<u2")
    if x.dtype != y.dtype:
        x, y = np.unique(x.astype("<u2")), np.unique(y.astype("<u2"))
    return len(np.intersect1d(x, y, assume_unique=True)) > 0


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def may_link(n: int, m: int) -> bool:
    return 100 * min(n, m) >= PERCENT * max(n, m)


def signature(found: np.ndarray) -> bytes:
    """How many shingles fall into each of a quarter to half as many buckets (a power of two, 16 at least), 255 at most."""
    size = max(16, 1 << max(0, (len(found) - 1) // 4).bit_length())
    return np.minimum(np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8).tobytes()


def signature_distance(a: bytes, b: bytes) -> int:
    """Sum of the differences of two signatures, the longer one folded: never more than the sets differ by."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int32), np.frombuffer(b, np.uint8).astype(np.int32)
    size = min(len(x), len(y))
    return int(np.abs(x.reshape(-1, size).sum(0) - y.reshape(-1, size).sum(0)).sum())


def ends_of(pairs: DataFrame) -> DataFrame:
    """The documents that pairs (a, b) name, as often as they do."""
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))


def near_enough(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs (a, b, ...) that may link, a written table: signatures first (sets that link differ in a seventh of their sizes' sum at most, and signatures never differ by more than the sets), then, of what they let pass, the prefixes under the second and third order, which must meet."""
    names = pairs.columns

    def checked(rows: DataFrame, fields: tuple[str, ...], test) -> DataFrame:
        near = IdFilter(ends_of(rows))
        known = near.passed(sets.where("fp is not null").select("doc_id", "fp", "n", *fields)).dropDuplicates(["doc_id", "fp"])
        side = lambda x: known.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", *fields)])

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = zip(*(batch.column(f"{c}_{x}").to_pylist() for c in ("n", *fields) for x in "ab"), strict=True)
            yield batch.select(names).filter(pa.array([test(*r) for r in found], pa.bool_()))

        out = materialize(map_arrow(rows.join(side("a"), "a").join(side("b"), "b"), run, ", ".join(f"{k} {t}" for k, t in pairs.dtypes)).distinct())
        near.destroy()
        return out

    pairs = materialize(pairs)
    signed = checked(pairs, ("sig",), lambda n, m, p, q: (100 + PERCENT) * signature_distance(p, q) <= (100 - PERCENT) * (n + m))
    free_shuffles(sets.sparkSession)
    met = checked(signed, ("second", "third"), lambda n, m, p, q, r, s: share(p, n, q, m) and share(r, n, s, m))
    discard(pairs, signed)
    return met


def packed(counts: np.ndarray) -> bytes:
    """A block of counts, compressed: a byte each, then places and values of those that don't fit."""
    big = np.flatnonzero(counts > 255)
    return zstandard.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + big.astype("<u4").tobytes() + counts[big].astype("<u4").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    raw = zstandard.decompress(data)
    out = np.frombuffer(raw, np.uint8, 1 << BLOCK_BITS).astype(np.int64)
    at, count = np.frombuffer(raw, "<u4", offset=1 << BLOCK_BITS).reshape(2, -1)
    out[at] = count
    return out


def set_digests(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n, fp, ...) of every document, fp null for an empty set, and rows (block, counts) of each task's part of the sketch."""
    schema = "sketch boolean, doc_id long, n long, fp binary, sig binary, second binary, third binary, block int, counts binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            rows = []
            for text in text_bytes(batch.column("text")):
                s, size = measured(text)
                rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signature(s), prefix_marks(s, size, 1), prefix_marks(s, size, 2)) if len(s) else (0, None, None, None, None))
                np.add.at(counts, cells(s), 1)
            n = batch.num_rows
            if n:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([False] * n), batch.column("doc_id"), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        for k, part in enumerate(counts.reshape(-1, 1 << BLOCK_BITS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([True]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.binary())] * 4, pa.array([k], pa.int32()), pa.array([packed(part)], pa.binary())], names)

    return in_arrow(docs.select("doc_id", "text"), run, schema)


def classes_of(parts: DataFrame) -> np.ndarray:
    """Class of each cell: its count up to 127, then eight classes to a doubling. The sketch has a fixed size, so has what the driver gets."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + unpacked(data)
        for k, a in total.items():
            rank = np.where(a < 128, a, np.minimum(127 + 8 * (np.log2(np.maximum(a, 1)) - 7), 255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zstandard.compress(rank.tobytes(), 1)], pa.binary())], ["block", "counts"])

    out = np.zeros(1 << CELL_BITS, np.uint8)
    for k, data in in_arrow(parts.repartition(1 << (CELL_BITS - BLOCK_BITS), "block"), add, "block int, counts binary").collect():
        out[k << BLOCK_BITS : (k + 1) << BLOCK_BITS] = np.frombuffer(zstandard.decompress(data), np.uint8)
    return out


def postings(docs: DataFrame, firsts: IdFilter, classes, total: int) -> DataFrame:
    """(token, doc_id, n, rest, head, head_n, head_rest) of every prefix shingle, under the first order, that two documents or more have; rest is how many of the set's shingles stand at it or behind it; head is the list's first document. firsts: documents that may be the first of their set; others aren't listed. total: about how many prefix shingles there are. Of equal sets in a batch only the one of the least doc_id is listed. A list of a very frequent shingle is not one task's: it is dealt by document, and kept whole."""
    spark = docs.sparkSession
    shards, hot, keep = max(4 * partitions(spark), -(-total // PER_SHARD)), HOT_CLASS, firsts.keeper()

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = keep(batch)
        if not batch.num_rows:
            return
        distinct: dict[bytes, int] = {}
        for doc_id, text in sorted(zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True), key=lambda r: r[0]):
            distinct.setdefault(shingles(text).tobytes(), doc_id)
        sets = [np.frombuffer(k, np.uint64) for k in distinct]
        firsts = [prefix(s, classes.value) for s in sets]
        token = np.concatenate(firsts)
        size = [len(f) for f in firsts]
        ids = np.repeat(np.array(list(distinct.values()), np.int64), size)
        ns = np.repeat(np.array([len(s) for s in sets], np.int64), size)
        rest = np.concatenate([len(s) - np.arange(k) for s, k in zip(sets, size, strict=True)])
        by = np.where(classes.value[cells(token)] >= hot, mix64(ids.view(np.uint64)) ^ token, token)
        shard = (by % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        token, ids, ns, rest, shard = token[order], ids[order], ns[order], rest[order], shard[order]
        at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
        to = np.append(at[1:], len(shard))
        cut = lambda a, kind: pa.array([a[i:j].astype(kind).tobytes() for i, j in zip(at, to, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(shard[at].astype(np.int32)), cut(token, "<u8"), cut(ids, "<i8"), cut(ns, "<i4"), cut(rest, "<i4")], ["shard", "token", "ids", "ns", "rest"])

    def lists_of(parts: list[tuple]) -> pa.RecordBatch:
        token = np.frombuffer(b"".join(p[1] for p in parts), "<u8")
        ids, ns, rest = (np.frombuffer(b"".join(p[k] for p in parts), kind).astype(np.int64) for k, kind in ((2, "<i8"), (3, "<i4"), (4, "<i4")))
        order = np.lexsort((ids, token))
        token = token[order]
        same = token[1:] == token[:-1]
        keep = np.append(same, False) | np.append(False, same) | (classes.value[cells(token)] >= hot)
        token, order = token[keep], order[keep]
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))[: len(token)]
        head = np.repeat(first, np.diff(np.append(first, len(token))))
        cols = [x[order] for x in (ids, ns, rest)]
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), *map(pa.array, cols), *(pa.array(x[head]) for x in cols)], POSTED)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for b in batches:
            for p in zip(*(b.column(c).to_pylist() for c in ("shard", "token", "ids", "ns", "rest")), strict=True):
                if parts and parts[0][0] != p[0]:
                    yield lists_of(parts)
                    parts = []
                parts.append(p)
        if parts:
            yield lists_of(parts)

    blocks = map_arrow(docs.select("doc_id", "text"), pack, "shard int, token binary, ids binary, ns binary, rest binary")
    return in_arrow(blocks.repartition(max(partitions(spark), shards // 8), "shard").sortWithinPartitions("shard"), lists, ", ".join(f"{c} long" for c in POSTED))


def compare(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The linked ones of the pairs (a, b, a written table), a written table. Texts of b go to their a, in parts of about HUB; a task holds the texts of one a at a time."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB).alias("parts"))
    salted = pairs.select("a", "b").join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"))
    near = IdFilter(ends_of(pairs))
    texts = near.passed(docs.select("doc_id", "text")).withColumnRenamed("doc_id", "id")
    members = salted.join(texts, F.col("b") == F.col("id")).select("a", "salt", "b", "text")
    leaders = salted.select("a", "salt").distinct().join(texts, F.col("a") == F.col("id")).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    met = leaders.unionByName(members).repartition(partitions(docs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            out = []
            for a, salt, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b", "text")), strict=True):
                if (a, salt) != now:
                    now, held = (a, salt), []
                s = shingles((text or "").encode())
                if b is None:
                    if not any(np.array_equal(s, t) for t in held):
                        held.append(s)
                elif any(may_link(len(s), len(t)) and linked(s, t) for t in held):
                    out.append((a, b))
            if out:
                x, y = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    out = materialize(in_arrow(met, run, "a long, b long").distinct())
    near.destroy()
    return out


def meetings(component: np.ndarray, side: np.ndarray, ids: np.ndarray, ns: np.ndarray, rest: np.ndarray, old: int, block: int = 1 << 20) -> Iterator[np.ndarray]:
    """Sorted pairs of ids that may link, of the rows from `old` on with all before them, a bounded number of meetings at a time. Rows are of one list, by n."""
    n = len(ids)
    low = np.searchsorted(ns, -(-PERCENT * ns[old:] // 100))  # the smallest set that may link with each
    k = old
    while k < n:
        first = int(low[k - old])
        many = max(1, min(n - k, block // max(1, n - first)))
        x, y = np.meshgrid(np.arange(first, k + many), np.arange(k, k + many))
        x, y = x.ravel(), y.ravel()
        ok = (x < y) & (component[x] != component[y]) & ((side[x] < 0) | (side[x] != side[y])) & ((100 + PERCENT) * np.minimum(rest[x], rest[y]) >= PERCENT * (ns[x] + ns[y]))
        yield np.sort(np.stack([ids[x[ok]], ids[y[ok]]], 1), axis=1)
        k += many


def cross_pairs(named: DataFrame) -> DataFrame:
    """Pairs (a, b) of one list whose components differ, from rows (token, component, doc_id, n, rest). A list is read by n and meets what is held of it; only pairs across components are made, only where the sizes allow a link, and only where what stands behind the shingle in either set suffices: the first shingle that linked sets share always does. A list of over BLOCK documents is cut into groups, and each two groups meet in a task of theirs."""
    spark = named.sparkSession
    mixed = named.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("groups")).where("x <> y").select("token", "groups")
    rows = named.join(mixed, "token").withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("groups")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    dealt = rows.select("token", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "component", F.when(F.col("mine") == F.col("other"), -1).otherwise(F.col("mine")).cast("int").alias("side"), "doc_id", "n", "rest")
    dealt = dealt.repartition(partitions(spark), "token", "lo", "hi").sortWithinPartitions("token", "lo", "hi", "n", "doc_id")
    names = ("component", "side", "doc_id", "n", "rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("token", "lo", "hi")], 1)
            at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
            cols = [batch.column(c).to_numpy() for c in names]
            for i, j in zip(at, np.append(at[1:], len(key)), strict=True):
                new, old = [c[i:j] for c in cols], 0
                if now is not None and (key[i] == now).all():
                    live = int(np.searchsorted(held[3], -(-PERCENT * int(new[3][0]) // 100)))
                    old = len(held[0]) - live
                    new = [np.concatenate([h[live:], c]) for h, c in zip(held, new, strict=True)]
                now, held = key[i], new
                if len(new[0]) < 2:
                    continue
                for pairs in meetings(*new, old):
                    if len(pairs):
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return in_arrow(dealt, run, "a long, b long").distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every document."""
    spark = docs.sparkSession
    first = materialize(set_digests(docs), "sketch")
    sets = first.where("not sketch").select("doc_id", "n", "fp", "sig", "second", "third")
    classes = spark.sparkContext.broadcast(classes_of(first.where("sketch").select("block", "counts")))
    free_shuffles(spark)
    total = sets.agg(F.sum(F.col("n") * (100 - PERCENT) / 100 + 1)).first()[0] or 0
    equal = materialize(sets.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    firsts = IdFilter(equal.select(F.col("rep").alias("doc_id")))  # a copy that it lets pass costs work, no more
    free_shuffles(spark)
    listed = materialize(postings(docs, firsts, classes, int(total)))
    classes.destroy()
    firsts.destroy()
    free_shuffles(spark)

    # a document meets the head of each of its lists, in pairs that combine before the shuffle
    stars = listed.where(f"doc_id <> head and {100 + PERCENT} * least(rest, head_rest) >= {PERCENT} * (n + head_n)").groupBy(F.col("head").alias("a"), F.col("doc_id").alias("b")).count()
    stars = near_enough(stars, sets)
    best = materialize(stars.groupBy("b").agg(F.max(F.struct("count", -F.col("a"))).alias("m")).select((-F.col("m.col2")).alias("a"), "b"))
    discard(stars)
    free_shuffles(spark)
    links = compare(best, docs)
    free_shuffles(spark)

    groups = components(links)
    named = materialize(listed.join(groups, F.col("doc_id") == F.col("node"), "left").select("token", F.coalesce("component", "doc_id").alias("component"), "doc_id", "n", "rest"))
    discard(listed)
    free_shuffles(spark)
    tested = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = near_enough(cross_pairs(named).join(tested, ["a", "b"], "left_anti"), sets)
    free_shuffles(spark)
    more = compare(rest, docs)
    discard(named, rest, best)
    free_shuffles(spark)

    # equal sets hold together, and a document of several texts holds theirs together
    several = sets.where("fp is not null and doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("doc_id")
    bridges = sets.join(several, "doc_id", "left_semi").join(equal, "fp").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    groups = components(links.unionByName(more).unionByName(bridges))
    discard(links, more)
    rows = sets.join(equal, "fp", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    return rows.join(groups, F.col("rep") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spread(documents(spark, sf_dir, "doc_id", "text")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents (all their columns) that are their group's least doc_id; rows with a null doc_id stay."""
    gone = near_groups(docs.select("doc_id", "text")).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
