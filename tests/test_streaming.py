"""Streams in several batches give what the batch operators give."""

import numpy as np
from pyspark.sql import functions as F

from kinetrace.operators import descriptors, tracking, vectors
from kinetrace.operators.neighbors import neighbor_edges, neighbor_lists
from kinetrace.sources.media import read_images
from kinetrace.sources.tables import from_array
from kinetrace.streaming import stateful


def streamed(spark, rows, cuts, build, tmp_path, mode="append"):
    """Rows written in batches by frame, read as a stream, one batch at a time."""
    source, out = str(tmp_path / "in"), []
    for lo, hi in cuts:
        rows.where((F.col("frame") >= lo) & (F.col("frame") < hi)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        q = build(stream).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda df, _: out.extend(df.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
    return out


def positions(spark):
    a = np.random.default_rng(0).uniform(0, 10, (6, 20, 3))
    rows = [(f, p, *map(float, a[f, p])) for f in range(6) for p in range(20)]
    return spark.createDataFrame(rows, "frame int, particle_id long, x double, y double, z double")


def values(rows):
    return {(r["particle_id"], r["frame"]): round(r["value"], 9) for r in rows}


def test_lens(spark, tmp_path):
    p = positions(spark)
    lists = neighbor_lists(neighbor_edges(p, 4.0, (10, 10, 10)), p).select("particle_id", "frame", "nbrs").cache()
    got = streamed(spark, lists, [(0, 2), (2, 6)], lambda s: stateful.lens(s, 2), tmp_path)
    assert values(got) == values(descriptors.lens(p, 4.0, 2, box=(10, 10, 10)).collect())


def test_drift(spark, tmp_path):
    """A missing frame pairs no others, as in a batch."""
    v = from_array(spark, np.random.default_rng(1).normal(size=(4, 8, 3))).where("frame <> 4").cache()
    got = streamed(spark, v, [(0, 3), (3, 8)], lambda s: stateful.drift(s, 2), tmp_path)
    assert values(got) == values(vectors.timesoap(v, 2).collect()) and len(got) == 16


def test_track(spark, tmp_path):
    a = np.cumsum(np.random.default_rng(2).normal(0, 0.1, (6, 4, 3)), 0) + np.arange(4)[:, None] * 5
    rows = spark.createDataFrame([(1, f, *map(float, a[f, p])) for f in range(6) for p in range(4)], "trajectory long, frame int, x double, y double, z double").cache()
    got = streamed(spark, rows, [(0, 1), (1, 4), (4, 6)], lambda s: stateful.track(s, 2.0), tmp_path)
    ids = lambda rs: {(r["frame"], round(r["x"], 9)): r["particle_id"] for r in rs}
    batch = tracking.track(rows.drop("trajectory"), 2.0, adaptive_stop=None, adaptive_step=None).collect()
    assert ids(got) == ids(batch) and len(got) == 24


def test_windows(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 60).cast("int").alias("frame"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("ts"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"))
    got = streamed(spark, rows, [(0, 60)], stateful.windowed, tmp_path)
    assert got and all(r["n"] <= 10 for r in got)


def test_images(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P5\n1 1\n255\nx")
    (tmp_path / "b.txt").write_text("no image")
    assert [r["path"].rsplit("/", 1)[1] for r in read_images(spark, str(tmp_path)).collect()] == ["a.pgm"]
