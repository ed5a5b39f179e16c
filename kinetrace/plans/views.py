"""Views of the test tables as trajectories, series and detections, in Spark and as common table expressions for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOX = (10.0, 10.0, 10.0)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Fifty particles; a frame is fifty rows."""
    e = table(spark, d, "embeddings")
    return e.select((F.col("vec_id") % 50).alias("particle_id"), F.floor(F.col("vec_id") / 50).cast("int").alias("frame"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def positions(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return v.select("frame", "particle_id", F.concat(F.lit("C"), (F.col("particle_id") % 5).cast("string")).alias("name"), F.when(F.col("particle_id") % 2 == 0, "A").otherwise("B").alias("type"), *[(F.col("vec")[k] * 10 + 5).alias(a) for k, a in enumerate("xyz")])


def series(spark: SparkSession, d: str) -> DataFrame:
    """Every user's events in order of time: series of unequal lengths."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    return e.select(F.col("user_id").alias("particle_id"), (F.row_number().over(w) - 1).cast("int").alias("frame"), "value")


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("particle_id", "frame", F.col("label").cast("int").alias("label"))


def detections(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d)
    x, y = F.col("k").cast("double"), (F.col("event_id") % 50).cast("double")
    return s.select(
        F.concat(F.lit("img_"), F.lpad((F.col("event_id") % 40).cast("string"), 3, "0"), F.lit(".png")).alias("image_path"), F.col("event_id").alias("det_id"), (F.col("k") % 5).cast("int").alias("cls"),
        ((F.col("event_id") * 37 % 1000) / 1000.0).alias("conf"), x.alias("x1"), y.alias("y1"), (x + 10 + F.col("event_id") % 7).alias("x2"), (y + 12).alias("y2"),
    )


V = "v AS (SELECT vec_id % 50 AS particle_id, (vec_id // 50)::INT AS frame, embedding::DOUBLE[] AS vec, label FROM embeddings)"
P = "p AS (SELECT (vec_id // 50)::INT AS frame, vec_id % 50 AS particle_id, 'C' || (vec_id % 50 % 5) AS name, CASE WHEN vec_id % 50 % 2 = 0 THEN 'A' ELSE 'B' END AS type, embedding[1]::DOUBLE * 10 + 5 AS x, embedding[2]::DOUBLE * 10 + 5 AS y, embedding[3]::DOUBLE * 10 + 5 AS z FROM embeddings)"
S = "s AS (SELECT user_id AS particle_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS frame, value FROM events)"
Y = "y AS (SELECT event_id, event_type, value, (props::JSON->>'$.k')::INT AS k FROM events)"
D = "d AS (SELECT 'img_' || lpad((event_id % 40)::VARCHAR, 3, '0') || '.png' AS image_path, event_id AS det_id, (k % 5)::INT AS cls, (event_id * 37 % 1000) / 1000.0::DOUBLE AS conf, k::DOUBLE AS x1, (event_id % 50)::DOUBLE AS y1, k::DOUBLE + 10 + event_id % 7 AS x2, (event_id % 50)::DOUBLE + 12 AS y2 FROM y)"


def edges(r_cut: float, name: str = "e", inclusive: bool = False, own: bool = False) -> str:
    d = [f"((a.{c} - b.{c}) - 10 * round_even((a.{c} - b.{c}) / 10, 0))" for c in "xyz"]
    d2 = " + ".join(f"{x} * {x}" for x in d)
    bound = f"<= {r_cut * r_cut}::DOUBLE" if inclusive else f"< {(r_cut - 1e-6) ** 2!r}::DOUBLE"
    return f"{name} AS (SELECT * FROM (SELECT a.frame, a.particle_id AS i, b.particle_id AS j, {d2} AS d2 FROM p a JOIN p b ON a.frame = b.frame{'' if own else ' AND a.particle_id <> b.particle_id'}) WHERE d2 {bound})"
