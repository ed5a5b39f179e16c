"""Substring dedup: a compressed FM-index per shard; passages are streamed backward through its wavelet matrix, and the intervals that started earlier are reported.

Two equal windows of 20 words have the same minimizer: the least hash among their runs of six words. So passages, not documents, are dealt to shards: a passage is all windows around one minimizer, and every earlier copy of a window lies in a passage of the same shard. Each passage thus meets one index, and the work grows with the input.

1. One pass hashes the words and finds each document's minimizers. A row whose words (20 at least) are all those of an earlier row loses everything and takes no further part.
2. Minimizers that occur once are dropped, by a count that combines before the shuffle. One that occurs over HOT times is split: each window around it is a passage of its own, dealt by all its words, so a boilerplate line in every document spreads over the shards by what stands around it.
3. Passages go to their shard; of equal ones a task sends the first it meets and any earlier one, the others are repeats already. There are as many shards as the number of passages asks for. A shard keeps each distinct passage at its earliest place, indexes them, streams them, and reports windows that start earlier too.
4. Reported intervals go back to the texts.

Rows are told apart by doc_id and the text's hash; under one doc_id the order is that of the hashes. Rows equal in both are copies of one another: one keeps its words (with 20 words or more). A window is compared by the 64-bit hashes of its words. Nulls: a null text has no words; rows with a null doc_id are returned whole and no other row's words count as repeats of theirs. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, finished, free_shuffles, gram_hashes, in_arrow, map_arrow, materialize, partitions, spread, text_bytes, word_hashes
from .fm import FMIndex

WINDOW, GRAM = 20, 6
#: Occurrences beyond which a minimizer is split, passages to a shard, and digests of passages sent that a task remembers.
HOT, PER_SHARD, REMEMBERED = 4096, 20_000, 1 << 16
PACKED = "shard int, ids binary, hashes binary, start binary, many binary, words binary"


def minimizers(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of windows with one minimizer, its first window, how many windows it has, and the minimizer's place."""
    grams = gram_hashes(words, GRAM)
    width = WINDOW - GRAM + 1
    if len(grams) < width:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    place = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(1) + np.arange(len(grams) - width + 1)
    start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return grams[place[start]], start, np.diff(np.append(start, len(place))), place[start]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, and the text."""
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text")


def first_pass(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_words, digest of the words, SHA-256 of the text with all words kept, and the hash and number of each passage."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for text in text_bytes(batch.column("text")):
            words = word_hashes(text)[0]
            whole = hashlib.sha256(b" ".join(text.split()))
            rows.append((len(words), whole.digest() if len(words) >= WINDOW else None, whole.hexdigest(), minimizers(words)[0].view(np.int64)))
        cols = list(zip(*rows, strict=True))
        offsets = pa.array(np.append(0, np.cumsum([len(x) for x in cols[3]])), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.string()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(cols[3])))], ["doc_id", "th", "n_words", "digest", "whole", "anchors"])

    return map_arrow(keyed(docs), one, "doc_id long, th long, n_words long, digest binary, whole string, anchors array<long>")


def passages(docs: DataFrame, shards: int) -> DataFrame:
    """Packed passages by shard, from documents with `runs` and `hot`: the numbers of the passages that may have copies, and of those among them to be split into windows. A passage that the task has sent from an earlier place is reported as a repeat, in a row without words."""
    names = [c.split()[0] for c in PACKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, tuple[int, int, int]] = {}
        for batch in batches:
            if len(sent) > REMEMBERED:
                sent = {}
            found, repeats, done = [], [], set()
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "runs", "hot")), text_bytes(batch.column("text")), strict=True)
            for doc_id, th, runs, hot, text in sorted(rows, key=lambda r: r[:2]):
                if (doc_id, th) in done:  # rows equal in both
                    continue
                done.add((doc_id, th))
                words = word_hashes(text)[0]
                anchor, start, count, _ = minimizers(words)
                parts = [(anchor[r], int(start[r]), int(count[r])) for r in runs]
                if hot:
                    whole = gram_hashes(words, WINDOW)
                    parts += [(whole[s], s, 1) for r in hot for s in range(int(start[r]), int(start[r] + count[r]))]
                for key, s, n in sorted(parts, key=lambda p: p[1]):
                    part = words[s : s + n + WINDOW - 1].tobytes()
                    digest, here = hashlib.blake2b(part, digest_size=16).digest(), (doc_id, th, s)
                    old = sent.get(digest)
                    if old is not None and old <= here:
                        if old < here:
                            repeats.append((doc_id, th, s, s + n + WINDOW - 1))
                        continue
                    sent[digest] = here
                    found.append((key, doc_id, th, s, n, part))
            if repeats:
                a = np.array(repeats, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([int(a[0, 1] % shards)], pa.int32()), *(pa.array([a[:, k].astype(kind).tobytes()], pa.binary()) for k, kind in enumerate(("<i8", "<i8", "<i4", "<i4"))), pa.nulls(1, pa.binary())], names)
            if not found:
                continue
            shard = (np.array([f[0] for f in found], np.uint64) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            at = np.flatnonzero(np.append(True, np.diff(shard[order]) != 0))
            fields = [np.array([f[k] for f in found], kind) for k, kind in ((1, "<i8"), (2, "<i8"), (3, "<i4"), (4, "<i4"))]
            cols: list[list] = [[] for _ in names]
            for i, j in zip(at, np.append(at[1:], len(order)), strict=True):
                mine = order[i:j]
                for c, x in zip(cols, (int(shard[mine[0]]), *(f[mine].tobytes() for f in fields), b"".join(found[m][5] for m in mine)), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names)

    return in_arrow(docs.select("doc_id", "th", "text", "runs", "hot"), run, PACKED)


def repeats_of(ids: np.ndarray, hashes: np.ndarray, start: np.ndarray, many: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc_id, text hash, first and end word of the intervals of one shard's passages that are covered by windows with an earlier copy."""
    size = many + WINDOW - 1
    at = np.cumsum(size) - size
    distinct: dict[bytes, int] = {}
    raw = words.tobytes()
    keep, later, last = [], [], None
    for k in np.lexsort((start, hashes, ids)).tolist():
        here = (ids[k], hashes[k], start[k], many[k])
        if here == last:  # sent again by another task, for a row equal in doc_id and text
            continue
        last = here
        key = raw[at[k] * 8 : (at[k] + size[k]) * 8]
        if key in distinct:
            later.append(k)
        else:
            distinct[key] = k
            keep.append(k)
    keep, later = np.array(keep, np.int64), np.array(later, np.int64)

    # the text: each distinct passage followed by 0
    length = size[keep]
    base = np.cumsum(length + 1) - (length + 1)
    flat = np.repeat(at[keep] - np.cumsum(length) + length, length) + np.arange(length.sum())
    place = np.repeat(base - np.cumsum(length) + length, length) + np.arange(length.sum())
    text = np.zeros(int((length + 1).sum()), np.int64)
    text[place] = np.unique(words[flat], return_inverse=True)[1] + 1
    which, offset = FMIndex(text, WINDOW).earlier(text, base + length, length)
    fresh = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1))[: len(which)])
    to = np.append(fresh[1:], len(which))[: len(fresh)] - 1
    rows = keep[which[fresh]]
    return np.append(ids[later], ids[rows]), np.append(hashes[later], hashes[rows]), np.append(start[later], start[rows] + offset[fresh]), np.append(start[later] + size[later], start[rows] + offset[to] + WINDOW)


def search(packed: DataFrame, shards: int) -> DataFrame:
    """(doc_id, th, s, e): word intervals to remove. A task handles one shard at a time."""
    tasks = max(partitions(packed.sparkSession), shards // 8)
    dealt = packed.repartition(tasks, "shard").sortWithinPartitions("shard")

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out = []
        for todo in ([r for r in rows if r[5] is None], [r for r in rows if r[5] is not None]):
            if todo:
                ids, hashes, first, second, words = (b"".join(r[k] or b"" for r in todo) for k in range(1, 6))
                cols = [np.frombuffer(ids, "<i8"), np.frombuffer(hashes, "<i8"), *(np.frombuffer(x, "<i4").astype(np.int64) for x in (first, second))]
                out.append(repeats_of(*cols, np.frombuffer(words, "<u8")) if words else cols)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in out])) for k in range(4)], ["doc_id", "th", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                if rows and rows[0][0] != row[0]:
                    yield from flush(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from flush(rows)

    return in_arrow(dealt, run, "doc_id long, th long, s long, e long")


def kept_words(text: bytes, spans: list) -> tuple[int, list[bytes]]:
    words = text.split()
    gone = np.zeros(len(words) + 1, np.int64)
    for x in spans:
        gone[x["s"]] += 1
        gone[x["e"]] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return len(words) - int(keep.sum()), [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def repeated_spans(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Written tables: the first pass with `copy` (an earlier row has the same words), and doc_id and th with their spans, for documents that lose some words. hot: occurrences beyond which a minimizer is split."""
    spark = docs.sparkSession
    seen = materialize(first_pass(docs).withColumn("rid", F.monotonically_increasing_id()))
    first = seen.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "th", "rid")).alias("first"))
    first = materialize(first.select("digest", F.col("first.rid").alias("first")))  # written for the same reason as the shared minimizers below
    marked = materialize(seen.join(first, "digest", "left").select("doc_id", "th", "n_words", "whole", F.coalesce(F.col("doc_id").isNotNull() & (F.col("rid") != F.col("first")), F.lit(False)).alias("copy"), "anchors"))
    discard(seen, first)
    rows = marked.where("not copy and doc_id is not null").select("doc_id", "th", F.posexplode("anchors").alias("run", "anchor"))
    shared = materialize(rows.groupBy("anchor").count().where("count > 1"))  # written, so that the join's sides are dealt anew and a hot anchor can be split
    total = shared.agg(F.sum(F.col("count") * F.when(F.col("count") > hot, WINDOW - GRAM + 1).otherwise(1))).first()[0] or 0
    shards = max(4 * partitions(spark), -(-total // PER_SHARD))
    marks = rows.join(shared.select("anchor", (F.col("count") > hot).alias("split")), "anchor")
    runs = marks.groupBy("doc_id", "th").agg(F.collect_list(F.when(~F.col("split"), F.col("run"))).alias("runs"), F.collect_list(F.when(F.col("split"), F.col("run"))).alias("hot"))
    free_shuffles(spark)
    runs = materialize(runs)
    discard(shared)
    free_shuffles(spark)
    spans = search(passages(keyed(docs).join(runs, ["doc_id", "th"]), shards), shards)
    spans = materialize(spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans")))
    discard(runs)
    free_shuffles(spark)
    return marked, spans


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    marked, spans = repeated_spans(docs, hot)

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [kept_words(t, s) for t, s in zip(text_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array([n for n, _ in found], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for _, w in found])], ["doc_id", "th", "gone", "kept"])

    cut = map_arrow(keyed(docs).join(spans, ["doc_id", "th"]), one, "doc_id long, th long, gone long, kept string").dropDuplicates(["doc_id", "th"])
    none = hashlib.sha256(b"").hexdigest()
    out = marked.drop("anchors").join(cut, ["doc_id", "th"], "left")
    out = out.select("doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"), F.when(F.col("copy"), none).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"))
    return finished(out, marked, spans)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spread(documents(spark, sf_dir, "doc_id", "text")))


def strip_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The documents (all their columns; n_chars follows the text) without repeated passages. A text that loses words becomes its kept words joined by blanks; a row that loses all of them is dropped. Of rows equal in doc_id and text (20 words or more) the one whose other columns are least stays."""
    marked, spans = repeated_spans(docs, hot)
    names, schema = docs.columns, docs.schema
    mark, th = "spans", "th"
    while mark in names:
        mark += "_"
    while th in names:
        th += "_"

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = batch.column(mark).to_pylist()
        texts = [t if s is None else b" ".join(kept_words((t or "").encode(), s)[1]).decode() for t, s in zip(batch.column("text").to_pylist(), found, strict=True)]
        cols = {n: batch.column(n) for n in names}
        cols["text"] = pa.array(texts, pa.string())
        if "n_chars" in cols:
            cols["n_chars"] = pa.array([old if s is None else len(t) for t, s, old in zip(texts, found, cols["n_chars"].to_pylist(), strict=True)], cols["n_chars"].type)
        yield pa.RecordBatch.from_pydict(cols).filter(pa.array([s is None or t != "" for t, s in zip(texts, found, strict=True)]))

    # by key: does a row of it keep its words, and are there several
    keys = marked.where(f"doc_id is not null and n_words >= {WINDOW}").groupBy("doc_id", F.col("th").alias(th)).agg(F.max((~F.col("copy")).cast("int")).alias("any"), F.count(F.lit(1)).alias("many"))
    odd = materialize(keys.where("any = 0 or many > 1"))
    rows = docs.withColumn(th, F.xxhash64("text"))
    single = rows.join(odd.select("doc_id", th), ["doc_id", th], "left_anti").select(*names, th)
    several = rows.join(odd.where("any = 1").select("doc_id", th), ["doc_id", th], "left_semi").groupBy("doc_id", th).agg(F.min(F.struct(*[n for n in names if n != "doc_id"])).alias(mark)).select(*[F.col("doc_id") if n == "doc_id" else F.col(f"`{mark}`.`{n}`") for n in names], th)
    joined = single.unionByName(several).join(spans.withColumnsRenamed({"spans": mark, "th": th}), ["doc_id", th], "left").select(*names, mark)
    return map_arrow(joined, one, schema)
