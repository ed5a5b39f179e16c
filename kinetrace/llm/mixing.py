"""Mixing sources to target weights: iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked to targets of each marginal in turn: a cell's weight is multiplied by what its source (language, topic) should have over what it has, and never grows beyond the cell's tokens, so a cell that gives all it has leaves the rest to the others. A document is then kept with the probability weight / tokens of its cell, decided by a digest of its id, so the same document always meets the same fate. Targets are shares that follow a power of the natural ones, times the budget; a value whose tokens fall short of that gives all of them, and the others share what is missing. The cells are a table of their own, as small as the marginals allow; raking is a chain of window sums over it.

Topics are learned from the text: signed hashed word counts, less the mean of the document's language, are clustered by k-means over all documents (whole numbers, so sums don't depend on the order of rows). Only the seeds come from a bounded sample: SEEDS documents by a hash of their id, farthest first.

Null languages and sources count as empty strings, null texts as empty; a text without words has the topic `none`. Rows that repeat a doc_id meet the same draw. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, free_shuffles, in_arrow, map_arrow, materialize, spread, text_bytes, word_hashes

#: Raking: rounds over all marginals, in so many steps that are written.
ROUNDS, STEPS = 12, 3
#: Share of all tokens to keep, and the powers of its natural share that a marginal's targets follow (1 keeps it, 0 makes all equal): mild enough that a language of a tenth of the tokens can have its share of the budget.
BUDGET, POWERS = 0.8, {"source": 0.7, "lang": 0.85, "topic": 0.9}
MARGINS = ("source", "lang", "topic")
#: Topics: how many, hashed dimensions, passes of k-means, and the sample that seeds it.
TOPICS, DIMS, PASSES, SEEDS = 8, 64, 5, 512
SCALE = 1 << 12


def frequencies(text: bytes) -> tuple[int, np.ndarray]:
    """Number of words, and the signed hashed counts of the lower-cased words per SCALE words."""
    words = word_hashes(text, lower=True)[0]
    at = (words >> np.uint64(58)).astype(np.int64)
    sign = 1.0 - 2.0 * (words & np.uint64(1)).astype(np.int64)
    return len(words), np.rint(np.bincount(at, sign, DIMS) * (SCALE / max(1, len(words)))).astype(np.int32)


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, tokens (words and one end) and v, the word frequencies. The one pass over texts."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "text")

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [frequencies(t) for t in text_bytes(batch.column("text"))]
        flat = pa.array(np.concatenate([v for _, v in found]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array([n + 1 for n, _ in found], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(0, DIMS * len(found) + 1, DIMS), pa.int32()), flat)], ["doc_id", "source", "lang", "tokens", "v"])

    return map_arrow(rows, one, "doc_id long, source string, lang string, tokens long, v array<int>")


def directions(rows: DataFrame) -> DataFrame:
    """Replaces v by q: 64 whole numbers of -127 to 127 that point where the document differs from the mean of its language; all 0 without words."""
    means = rows.where("tokens > 1").groupBy("lang").agg(F.array(*[F.sum(F.col("v")[k]) / F.count(F.lit(1)) for k in range(DIMS)]).alias("mean"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(15)))  # a language may have most documents
    met = rows.withColumn("salt", F.pmod(F.hash("doc_id", "tokens"), F.lit(16))).join(means.withColumn("salt", salts), ["lang", "salt"], "left").withColumn("mean", F.coalesce("mean", F.lit([0.0] * DIMS)))

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = batch.num_rows
        v = batch.column("v").flatten().to_numpy().reshape(n, DIMS).astype(float)
        v -= batch.column("mean").flatten().to_numpy().reshape(n, DIMS)
        v[batch.column("tokens").to_numpy() < 2] = 0
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        q = np.rint(127 * v / np.where(norm > 0, norm, 1)).astype(np.int8)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang", "tokens")), pa.array([x.tobytes() for x in q], pa.binary())], ["doc_id", "source", "lang", "tokens", "q"])

    return map_arrow(met.select("doc_id", "source", "lang", "tokens", "v", "mean"), one, "doc_id long, source string, lang string, tokens long, q binary")


def points(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, DIMS).astype(np.float64)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), 1)


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """k of the points: the first, then each time the one farthest from all chosen."""
    chosen = [0]
    gap = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def learned_centres(rows: DataFrame, topics: int = TOPICS, passes: int = PASSES) -> np.ndarray:
    """Centres of the topics, whole numbers: k-means over all rows (a written table with q). A pass sums by task; a row per topic and task meets in one, and the driver gets a row per topic."""
    some = rows.where("tokens > 1")
    sample = some.select("q").orderBy(F.xxhash64("doc_id"), "doc_id", "q").limit(SEEDS).collect()
    if not sample:
        return np.zeros((0, DIMS))
    centres = farthest_first(np.frombuffer(b"".join(bytes(r[0]) for r in sample), np.int8).reshape(-1, DIMS).astype(float), topics)
    for _ in range(passes):

        def sums(batches: Iterator[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(centres), DIMS + 1), np.int64)
            for b in batches:
                if b.num_rows:
                    x = points(b.column("q"))
                    at = nearest(x, centres)
                    member = np.eye(len(centres))[at]
                    total += np.rint(np.column_stack([member.T @ x, member.sum(0)])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres), dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.int64()))], ["topic", "s"])

        found = in_arrow(some.select("q"), sums, "topic int, s array<long>").groupBy("topic").agg(F.array(*[F.sum(F.col("s")[k]) for k in range(DIMS + 1)]).alias("s")).collect()
        s = np.array([r["s"] for r in sorted(found)], float)
        centres = np.where(s[:, -1:] > 0, np.rint(s[:, :-1] / np.maximum(s[:, -1:], 1)), centres)
    return centres


def with_topic(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = nearest(points(batch.column("q")), centres) if len(centres) else np.zeros(batch.num_rows, int)
        names = [f"topic{k}" if n > 1 else "none" for k, n in zip(at.tolist(), batch.column("tokens").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang")), pa.array(names, pa.string()), batch.column("tokens")], ["doc_id", "source", "lang", "topic", "tokens"])

    return map_arrow(rows, one, "doc_id long, source string, lang string, topic string, tokens long")


def cells_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic and tokens of every row (a written table)."""
    counts = materialize(counted(docs))
    rows = materialize(directions(counts))
    discard(counts)
    out = materialize(with_topic(rows, learned_centres(rows)))
    discard(rows)
    free_shuffles(docs.sparkSession)
    return out


def tempered(cells: DataFrame, margin: str, power: float, budget: float = BUDGET) -> DataFrame:
    """Target tokens of a marginal's values: budget times all tokens, by their natural share to the power; who has less gives all, and the others share the rest alike."""
    w = Window.partitionBy(F.lit(0))
    rising = w.orderBy("r", margin).rowsBetween(Window.unboundedPreceding, -1)
    each = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("t")).withColumn("p", F.pow("t", F.lit(power))).withColumn("r", F.col("t") / F.col("p"))
    each = each.withColumns({"full": F.coalesce(F.sum("t").over(rising), F.lit(0.0)), "gone": F.coalesce(F.sum("p").over(rising), F.lit(0.0)), "all_t": F.sum("t").over(w), "all_p": F.sum("p").over(w)})
    each = each.withColumn("level", (F.lit(budget) * F.col("all_t") - F.col("full")) / (F.col("all_p") - F.col("gone")))
    each = each.withColumn("level", F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", margin, "level"))).over(w)["level"])  # of the first that needn't give all
    return each.select(margin, F.least(F.col("t"), F.coalesce(F.col("level") * F.col("p"), F.col("t"))).alias(f"want_{margin}"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, steps: int = STEPS, budget: float = BUDGET, bounded: bool = True) -> DataFrame:
    """Adds w to cells (with a column `tokens`): weights whose marginals approach the targets, never over the cell's tokens if bounded. targets: by margin, a table of its values and want_<margin>; a value without a target keeps its weight."""
    out = cells.withColumn("w", F.col("tokens") * F.lit(budget))
    for m, t in targets.items():
        out = out.join(t, m, "left")
    done = []
    for k in range(rounds):
        for m in targets:
            over = Window.partitionBy(m)
            full = (F.col("w") >= F.col("tokens")) if bounded else F.lit(False)
            has, fixed = F.sum("w").over(over), F.sum(F.when(full, F.col("w")).otherwise(0.0)).over(over)
            want = F.col(f"want_{m}")
            grown = F.when(full | (has <= fixed), F.col("w")).otherwise(F.col("w") * (want - fixed) / (has - fixed))
            new = F.when(want.isNull(), F.col("w")).when(want <= has, F.col("w") * want / has).otherwise(grown)
            out = out.withColumn("w", F.least(F.col("tokens").cast("double"), new) if bounded else new)
        if (k + 1) % -(-rounds // steps) == 0 and k + 1 < rounds:  # a plan of all rounds would be long
            out = materialize(out)
            done.append(out)
            free_shuffles(cells.sparkSession)
    out = materialize(out.drop(*[f"want_{m}" for m in targets]))
    discard(*done)
    return out


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def calibrated(docs: DataFrame, powers: dict[str, float] = POWERS, budget: float = BUDGET) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability and kept of every row. One pass over the texts; all else works on 64 numbers a document, then on cells."""
    rows = cells_of(docs)
    cells = materialize(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    weighted = rake(cells, {m: tempered(cells, m, powers[m], budget) for m in MARGINS}, budget=budget)
    discard(cells)
    salts = F.explode(F.sequence(F.lit(0), F.lit(15)))  # a cell may hold a third of all documents
    chance = weighted.select(*MARGINS, F.least(F.lit(1.0), F.col("w") / F.col("tokens")).alias("probability"))
    found = rows.withColumn("salt", F.pmod(F.hash("doc_id", "tokens"), F.lit(16))).join(chance.withColumn("salt", salts), [*MARGINS, "salt"])
    return found.select("doc_id", *MARGINS, "tokens", "probability", (draw(F.col("doc_id")) < F.col("probability")).alias("kept"))


def reached(rows: DataFrame, powers: dict[str, float] = POWERS, budget: float = BUDGET) -> DataFrame:
    """(margin, value, target, expected, kept): tokens that each value should have in the sample, what the probabilities give on average, and what was drawn, from calibrated()'s rows."""
    out = None
    for m in MARGINS:
        have = rows.groupBy(m).agg(F.sum(F.col("tokens") * F.col("probability")).alias("expected"), F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(0)).alias("kept"))
        part = tempered(rows, m, powers[m], budget).join(have, m).select(F.lit(m).alias("margin"), F.col(m).alias("value"), F.col(f"want_{m}").alias("target"), "expected", "kept")
        out = part if out is None else out.unionByName(part)
    return out


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calibrated(spread(documents(spark, sf_dir, "doc_id", "text", "lang", "source")))
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "kept")


def mix(docs: DataFrame) -> DataFrame:
    """The documents (all their columns) that are drawn. Rows that repeat a doc_id stay together if one of them is drawn."""
    kept = calibrated(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
