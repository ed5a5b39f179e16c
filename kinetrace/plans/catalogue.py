"""A query for each operator over the test tables, and the same in DuckDB's SQL where SQL can say it. Doubles are rounded to six decimals on both sides."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import kernel, kernel_distance, soap_distance, unit_distance
from ..functions.select import selection
from ..operators import descriptors, detections, information, labels, onion, series, soap, tracking, vectors
from ..operators.neighbors import neighbor_edges
from ..provenance import Log
from ..session import remove_at_exit, shared_dir
from ..sources import tables, xyz
from ..trajectory import ClusterInsight, Insight, OnionInsight, OnionSmoothInsight, Trajectory
from . import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
R_CUT = 1.5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c) -> F.Column:
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def one(spark: SparkSession, **values: float) -> DataFrame:
    return spark.createDataFrame([tuple(float(x) for x in values.values())], ", ".join(f"{k} double" for k in values)).select(*[r6(k).alias(k) for k in values])


def scratch(spark: SparkSession) -> str:
    """A shared folder that goes when the application ends."""
    path = shared_dir(spark)
    remove_at_exit(spark, path)
    return path


# scans, slices and selections


@query(f"WITH {v.P} SELECT ((frame - 2) // 2)::INT AS frame, particle_id, round(x, 6) + 0.0 AS x FROM p WHERE frame >= 2 AND frame < 8 AND (frame - 2) % 2 = 0")
def frame_slice(spark, d):
    return rounded(xyz.frame_slice(v.positions(spark, d), 2, 8, 2).select("frame", "particle_id", "x"), "x")


@query(f"WITH {v.P} SELECT frame, particle_id, name, type FROM p WHERE type = 'A' AND NOT name IN ('C1', 'C3') OR particle_id IN (0, 10)")
def atom_selection(spark, d):
    return v.positions(spark, d).where(selection("type A and not name C1 C3 or id 1 11")).select("frame", "particle_id", "name", "type")


@query(f"WITH {v.P} SELECT frame, particle_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM p WHERE type = 'B'")
def coordinates(spark, d):
    return rounded(Trajectory(v.positions(spark, d), v.BOX).get_coordinates("type B"), "x", "y", "z")


@query(f"WITH {v.P} SELECT (frame - 3)::INT AS frame, particle_id, round(x, 6) + 0.0 AS x FROM p WHERE frame >= 3 AND frame < 7")
def stored_trajectory(spark, d):
    path = scratch(spark)
    tables.write_trajectory(v.positions(spark, d), path, chunk=4)
    return rounded(tables.read_trajectory(spark, path, 3, 7).select("frame", "particle_id", "x"), "x")


@query(f"WITH {v.P} SELECT frame, particle_id, name, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, round(z, 5) + 0.0 AS z, (particle_id % 3 + 2)::BIGINT AS label FROM p")
def xyz_roundtrip(spark, d):
    path = scratch(spark)
    p = v.positions(spark, d)
    xyz.save_text(xyz.colored_blocks(p, p.select("frame", "particle_id", (F.col("particle_id") % 3).alias("label")), (10.0, 10.0, 10.0, 90.0, 90.0, 90.0)), path, 1)
    rows = xyz.read_xyz(spark, path, ["name", "x", "y", "z", "ID"])
    return rows.select("frame", F.col("row").alias("particle_id"), "name", *[(F.round(c, 5) + 0.0).alias(c) for c in "xyz"], F.col("ID").alias("label"))


# neighbours and descriptors


def _edges(spark, d, r=R_CUT, **options):
    return neighbor_edges(v.positions(spark, d), r, box=v.BOX, **options)


@query(f"WITH {v.P}, {v.edges(R_CUT)} SELECT frame, i AS center_id, j AS neigh_id, round(d2, 6) + 0.0 AS d2 FROM e")
def neighbor_pairs(spark, d):
    return rounded(_edges(spark, d), "d2")


@query(f"WITH {v.P}, {v.edges(R_CUT)} SELECT p.particle_id, p.frame, count(j)::DOUBLE AS value FROM p LEFT JOIN e ON p.frame = e.frame AND p.particle_id = i GROUP BY ALL")
def coord_number(spark, d):
    return descriptors.coordination_number(v.positions(spark, d), R_CUT, box=v.BOX)


def _lens_sql(r: float, delay: int) -> str:
    return f"""WITH {v.P}, {v.edges(r)}, n AS (SELECT p.frame, p.particle_id, coalesce(list(j) FILTER (WHERE j IS NOT NULL), []) AS nb FROM p LEFT JOIN e ON p.frame = e.frame AND p.particle_id = i GROUP BY ALL),
l AS (SELECT *, lead(nb, {delay}) OVER (PARTITION BY particle_id ORDER BY frame) AS nx, lead(frame, {delay}) OVER (PARTITION BY particle_id ORDER BY frame) AS fx FROM n)
SELECT particle_id, frame, CASE WHEN len(nb) + len(nx) = 0 THEN 0.0::DOUBLE ELSE round((len(nb) + len(nx) - 2 * len(list_intersect(nb, nx)))::DOUBLE / (len(nb) + len(nx)), 6) END AS value FROM l WHERE fx IS NOT NULL"""


@query(_lens_sql(R_CUT, 1))
def lens_delay1(spark, d):
    return rounded(descriptors.lens(v.positions(spark, d), R_CUT, 1, box=v.BOX), "value")


@query(_lens_sql(2.0, 2))
def lens_delay2(spark, d):
    return rounded(descriptors.lens(v.positions(spark, d), 2.0, 2, box=v.BOX), "value")


@query(f"""WITH {v.P}, {v.edges(R_CUT)}, t AS (SELECT e.frame, i, 6 * atan2(q.y - p.y, q.x - p.x) AS a FROM e JOIN p ON p.frame = e.frame AND p.particle_id = i JOIN p q ON q.frame = e.frame AND q.particle_id = j),
g AS (SELECT frame, i, sum(cos(a)) AS c, sum(sin(a)) AS s, count(*) AS n FROM t GROUP BY frame, i)
SELECT p.particle_id, p.frame, CASE WHEN n > 1 THEN round(sqrt(c * c + s * s) / n, 6) + 0.0 ELSE 0.0::DOUBLE END AS value FROM p LEFT JOIN g ON p.frame = g.frame AND p.particle_id = i""")
def orientational_op(spark, d):
    return rounded(descriptors.orientational_order(v.positions(spark, d), _edges(spark, d)), "value")


def _alignment_cosine() -> str:
    return "(" + " + ".join(f"a.v{c} * b.v{c}" for c in "xyz") + ") / (sqrt(" + " + ".join(f"a.v{c} * a.v{c}" for c in "xyz") + ") * sqrt(" + " + ".join(f"b.v{c} * b.v{c}" for c in "xyz") + "))"


def _alignment_sql(reference: str) -> str:
    base = "first(%s) OVER w" if reference == "first" else "lag(%s) OVER w"
    cols = ", ".join(f"{c} - {base % c} AS v{c}" for c in "xyz")
    cos = _alignment_cosine()
    return f"""WITH {v.P}, {v.edges(R_CUT)}, m AS (SELECT particle_id, lag(frame) OVER w AS frame, {cols} FROM p WINDOW w AS (PARTITION BY particle_id ORDER BY frame)), u AS (SELECT * FROM m WHERE frame IS NOT NULL),
g AS (SELECT e.frame, i, avg({cos}) AS c FROM e JOIN u a ON a.frame = e.frame AND a.particle_id = i JOIN u b ON b.frame = e.frame AND b.particle_id = j GROUP BY e.frame, i)
SELECT u.particle_id, u.frame, round(coalesce(c, 0), 6) + 0.0 AS value FROM u LEFT JOIN g ON u.frame = g.frame AND u.particle_id = i"""


@query(_alignment_sql("first"))
def velocity_alignment_first(spark, d):
    return rounded(descriptors.velocity_alignment(v.positions(spark, d), _edges(spark, d)), "value")


@query(_alignment_sql("previous"))
def velocity_alignment_prev(spark, d):
    return rounded(descriptors.velocity_alignment(v.positions(spark, d), _edges(spark, d), "previous"), "value")


@query(f"WITH {v.P}, {v.edges(R_CUT, inclusive=True, own=True)} SELECT i AS particle_id, e.frame, round(avg(q.x), 6) + 0.0 AS value FROM e JOIN p q ON q.frame = e.frame AND q.particle_id = j GROUP BY i, e.frame")
def spatial_average_scalar(spark, d):
    p = v.positions(spark, d)
    return rounded(descriptors.spatial_average(p.select("particle_id", "frame", F.col("x").alias("value")), p, R_CUT, box=v.BOX), "value")


@query(f"WITH {v.P}, {v.V}, {v.edges(R_CUT, inclusive=True, own=True)}, u AS (SELECT particle_id, frame, unnest(vec) AS c, unnest(range(64)) AS k FROM v) SELECT i AS particle_id, e.frame, k::INT AS k, round(avg(c), 6) + 0.0 AS value FROM e JOIN u ON u.frame = e.frame AND u.particle_id = j GROUP BY i, e.frame, k")
def spatial_average_vector(spark, d):
    out = descriptors.spatial_average(v.vectors(spark, d).drop("label"), v.positions(spark, d), R_CUT, box=v.BOX)
    return out.select("particle_id", "frame", F.posexplode("vec").alias("k", "value")).withColumn("value", r6("value"))


def _rdf_sql(norm: str, s1: str = "true", s2: str = "true") -> str:
    shell = "(4.0::DOUBLE / 3.0 * pi() * (pow((bin + 1) * 0.1::DOUBLE, 3) - pow(bin * 0.1::DOUBLE, 3)))"
    value = {"none": "n::DOUBLE", "density": f"n / ({shell} * f)", "rdf": f"n / ({shell} * f * (n1 * n2 - n1) / 1000.0::DOUBLE)"}[norm]
    return f"""WITH {v.P}, {v.edges(5.0, inclusive=True)}, h AS (SELECT least(floor(sqrt(d2) / 0.1::DOUBLE), 49) AS bin, count(*) AS c FROM e GROUP BY 1), m AS (SELECT count(DISTINCT frame) AS f, count(DISTINCT particle_id) AS n1, count(DISTINCT particle_id) AS n2 FROM p),
b AS (SELECT range AS bin, coalesce(c, 0) AS n FROM range(50) LEFT JOIN h ON h.bin = range) SELECT bin::INT AS bin, round((bin + 0.5) * 0.1::DOUBLE, 6) AS r, round({value}, 6) + 0.0 AS value FROM b, m"""


def _rdf(spark, d, norm):
    return rounded(series.rdf(v.positions(spark, d), (0.0, 5.0), v.BOX, nbins=50, norm=norm), "r", "value")


@query(_rdf_sql("rdf"))
def rdf_norm(spark, d):
    return _rdf(spark, d, "rdf")


@query(_rdf_sql("density"))
def rdf_density(spark, d):
    return _rdf(spark, d, "density")


@query(_rdf_sql("none"))
def rdf_none(spark, d):
    return _rdf(spark, d, "none")


# vectors

_COS = "(list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1}))))"
_DIST = "sqrt(greatest(0, 2 - 2 * least(1, greatest(-1, " + _COS + "))))"
_REFS = "r AS (SELECT 'ref' || label AS ref_name, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS s FROM v JOIN (SELECT label, min(frame * 50 + particle_id) AS pos FROM v GROUP BY label) USING (label) WHERE frame * 50 + particle_id = pos)"


def _references(spark, d) -> DataFrame:
    rows = v.vectors(spark, d)
    at = rows.groupBy("label").agg(F.min(F.struct("frame", "particle_id")).alias("a")).select("label", "a.frame", "a.particle_id").collect()  # a row per label
    return vectors.create_references(rows, {f"ref{r['label']}": (r["frame"], r["particle_id"]) for r in at}, 8, 8)


@query(f"WITH {v.V}, u AS (SELECT particle_id, frame, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS n FROM v) SELECT particle_id, frame, unnest(range(64))::INT AS k, round(unnest(n), 6) + 0.0 AS value FROM u")
def normalize_vec(spark, d):
    return vectors.normalize(v.vectors(spark, d)).select("particle_id", "frame", F.posexplode("vec").alias("k", "value")).withColumn("value", r6("value"))


@query(f"WITH {v.V}, l AS (SELECT *, lead(vec) OVER (PARTITION BY particle_id ORDER BY frame) AS w FROM v) SELECT particle_id, frame, round({_DIST.format('vec', 'w')}, 6) + 0.0 AS value FROM l WHERE w IS NOT NULL")
def soap_distance_lag(spark, d):
    return rounded(vectors.timesoap(v.vectors(spark, d)), "value")


@query(f"WITH {v.V} SELECT a.particle_id, a.frame, round(pow({_COS.format('a.vec', 'b.vec')}, 3), 6) + 0.0 AS k3, round(sqrt(greatest(0, 2 - 2 * {_COS.format('a.vec', 'b.vec')})), 6) + 0.0 AS dist FROM v a JOIN v b ON a.particle_id = b.particle_id AND b.frame = 0")
def kernel_soap_n(spark, d):
    rows = v.vectors(spark, d)
    first = rows.where("frame = 0").select("particle_id", F.col("vec").alias("w"))
    return rows.join(first, "particle_id").select("particle_id", "frame", r6(kernel(F.col("vec"), F.col("w"), 3)).alias("k3"), r6(soap_distance(F.col("vec"), F.col("w"))).alias("dist"))


@query(f"WITH {v.V}, i AS (SELECT l, a, b, l * 10 + CASE least(a, b) WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 7 ELSE 9 END + greatest(a, b) - least(a, b) + 1 AS pos, l * 16 + a * 4 + b AS k FROM range(6) x(l), range(4) y(a), range(4) z(b)) SELECT particle_id, frame, k::INT AS k, round(vec[pos], 6) + 0.0 AS value FROM v, i")
def soap_fill(spark, d):
    full = v.vectors(spark, d).select("particle_id", "frame", vectors.fill_spectrum(F.slice("vec", 1, 60), 5, 4).alias("vec"))
    return full.select("particle_id", "frame", F.posexplode("vec").alias("k", "value")).withColumn("value", r6("value"))


@query(f"WITH {v.V}, {_REFS} SELECT particle_id, frame, ref_name, round({_DIST.format('vec', 's')}, 6) + 0.0 AS distance FROM v, r")
def ref_distances(spark, d):
    return rounded(vectors.reference_distances(v.vectors(spark, d), _references(spark, d), normalize_rows=True), "distance")


@query(f"WITH {v.V}, {_REFS} SELECT particle_id, frame, arg_min(ref_name, dd) AS ref_name, round(min(dd), 6) + 0.0 AS distance FROM (SELECT particle_id, frame, ref_name, {_DIST.format('vec', 's')} AS dd FROM v, r) GROUP BY particle_id, frame")
def ref_classify(spark, d):
    return rounded(vectors.classify(v.vectors(spark, d), _references(spark, d), normalize_rows=True), "distance")


@query(f"WITH {v.V}, {_REFS} SELECT ref_name, round(list_sum(s), 6) + 0.0 AS total FROM r UNION ALL SELECT 'again_' || ref_name, round(list_sum(s), 6) + 0.0 FROM r")
def merge_refs(spark, d):
    refs = _references(spark, d)
    again = refs.withColumn("ref_name", F.concat(F.lit("again_"), "ref_name"))
    return vectors.merge_references(refs, again).select("ref_name", r6(F.aggregate("spectrum", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"""WITH {v.V}, l AS (SELECT vec AS a, lead(vec) OVER (PARTITION BY particle_id ORDER BY frame) AS b FROM v), q AS (SELECT row_number() OVER () AS id, a, b FROM l WHERE b IS NOT NULL),
u AS (SELECT id, unnest(range(64)) AS k, unnest(a) AS a, unnest(b) AS b FROM q), m AS (SELECT k, sum(a + b) / (2 * count(*)) AS m FROM u GROUP BY k)
SELECT x.k::INT AS i, y.k::INT AS j, round(sum(x.a * y.a + x.b * y.b) / (2 * count(*)) - first(mi.m) * first(mj.m), 6) + 0.0 AS c0, round(sum(x.a * y.b + x.b * y.a) / (2 * count(*)) - first(mi.m) * first(mj.m), 6) + 0.0 AS ct
FROM u x JOIN u y USING (id) JOIN m mi ON mi.k = x.k JOIN m mj ON mj.k = y.k GROUP BY x.k, y.k""")
def tica_cov(spark, d):
    c0, ct, _ = series.lagged_covariances(v.vectors(spark, d), 1)
    rows = [(i, j, float(c0[i, j]), float(ct[i, j])) for i in range(len(c0)) for j in range(len(c0))]
    return rounded(spark.createDataFrame(rows, "i int, j int, c0 double, ct double"), "c0", "ct")


@query()
def tica_project(spark, d):
    _, _, out = series.tica(v.vectors(spark, d), 1, 3)
    return out.select("particle_id", "frame", F.posexplode("vec").alias("k", "value")).withColumn("value", r6("value"))


@query()
def soap_kernel(spark, d):
    out = soap.soap(v.positions(spark, d), 2.0, 4, 3, box=v.BOX)
    return out.select("particle_id", "frame", F.posexplode("vec").alias("k", "value")).withColumn("value", r6("value"))


# series


@query(f"""WITH {v.S}, c AS (SELECT particle_id, frame, value - avg(value) OVER (PARTITION BY particle_id) AS d FROM s),
q AS (SELECT b.frame - a.frame AS lag, a.particle_id, avg(a.d * b.d) AS s FROM c a JOIN c b ON a.particle_id = b.particle_id AND b.frame >= a.frame GROUP BY ALL),
w AS (SELECT lag, avg(s) AS c, stddev_pop(s) / sqrt(count(*)) AS e FROM q GROUP BY lag)
SELECT lag::INT AS lag, round(c / z, 6) + 0.0 AS value, round(e / z, 6) + 0.0 AS error FROM w, (SELECT c AS z FROM w WHERE lag = 0)""")
def self_tcf(spark, d):
    return rounded(series.self_time_correlation(v.series(spark, d)), "value", "error")


@query(f"""WITH {v.S}, c AS (SELECT particle_id, frame, value - avg(value) OVER (PARTITION BY particle_id) AS d FROM s),
q AS (SELECT b.frame - a.frame AS lag, a.particle_id AS i, b.particle_id AS j, sum(a.d * b.d) AS s, count(*) AS n FROM c a JOIN c b ON b.frame >= a.frame AND a.particle_id <> b.particle_id GROUP BY ALL),
t AS (SELECT lag, sum(s) / sum(n) AS v, sum(n) AS n FROM q GROUP BY lag)
SELECT lag::INT AS lag, round(first(v), 6) + 0.0 AS value, round(sqrt(sum((s - v * q.n) * (s - v * q.n))) / first(t.n), 6) + 0.0 AS error FROM q JOIN t USING (lag) GROUP BY lag""")
def cross_tcf(spark, d):
    return rounded(series.cross_time_correlation(v.series(spark, d)), "value", "error")


@query(f"""WITH {v.V}, q AS (SELECT a.frame, a.particle_id, list_distance(a.vec, b.vec) AS d, row_number() OVER (PARTITION BY a.frame, a.particle_id ORDER BY list_distance(a.vec, b.vec)) AS rn FROM v a JOIN v b ON a.frame = b.frame AND a.particle_id <> b.particle_id),
t AS (SELECT frame, particle_id, min(d) FILTER (WHERE rn = 1) AS d1, min(d) FILTER (WHERE rn = 2) AS d2 FROM q WHERE rn <= 2 GROUP BY ALL) SELECT round(count(*) / sum(ln(d2 / d1)), 6) AS dimension FROM t WHERE d1 > 0""")
def two_nn(spark, d):
    return series.two_nn_sums(v.vectors(spark, d)).agg(r6(F.sum("n") / F.sum("s")).alias("dimension"))


@query(f"WITH {v.S}, q AS (SELECT particle_id, frame, value + frame * 0.0001::DOUBLE AS y FROM s), l AS (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS b FROM q WINDOW w AS (PARTITION BY particle_id ORDER BY frame)) SELECT particle_id AS series, frame::DOUBLE AS x, round(y, 6) AS y FROM l WHERE y > a AND y > b")
def find_extrema(spark, d):
    curve = v.series(spark, d).select(F.col("particle_id").alias("series"), F.col("frame").alias("x"), (F.col("value") + F.col("frame") * 0.0001).alias("y"))
    return rounded(series.find_extrema(curve, "max"), "y")


# information


@query(f"WITH {v.Y}, c AS (SELECT count(*) AS c FROM y GROUP BY event_type, k), n AS (SELECT sum(c) AS n FROM c) SELECT first(n)::DOUBLE AS n, round(-sum(c / n * log2(c / n)), 6) AS h FROM c, n")
def shannon_symbols(spark, d):
    return rounded(information.shannon(v.symbols(spark, d), ["event_type", "k"]), "h")


@query(f"WITH {v.Y}, c AS (SELECT count(*) AS c FROM y WHERE value >= 0 AND value <= 80 GROUP BY least(floor(value / 2.0), 39)), n AS (SELECT sum(c) AS n FROM c) SELECT first(n)::DOUBLE AS n, round(-sum(c / n * ln(c / n)) / ln(40), 6) AS h FROM c, n")
def shannon_hist(spark, d):
    return rounded(information.histogram_entropy(v.symbols(spark, d), {"value": (0, 80)}, 40), "h")


@query(f"WITH {v.P}, c AS (SELECT count(*) AS c FROM p WHERE x BETWEEN 0 AND 10 AND y BETWEEN 0 AND 10 GROUP BY least(floor(x / 0.5::DOUBLE), 19), least(floor(y / 0.5::DOUBLE), 19)), n AS (SELECT sum(c) AS n FROM c) SELECT first(n)::DOUBLE AS n, round(-sum(c / n * log2(c / n)), 6) AS h FROM c, n")
def shannon_hist_multi(spark, d):
    return rounded(information.histogram_entropy(v.positions(spark, d), {"x": (0, 10), "y": (0, 10)}, 20, "bit"), "h")


_PSI = "(SELECT -0.57721566490153286060651209 + sum(1.0::DOUBLE / r) FROM (SELECT row_number() OVER () AS r FROM {0}) WHERE r < (SELECT count(*) FROM {0}))"


@query(f"WITH {v.Y}, l AS (SELECT lead(value, 2) OVER (ORDER BY value) - value AS g FROM y) SELECT round({_PSI.format('y')} + 0.57721566490153286060651209 - 1 + ln(2) + avg(ln(greatest(g, 1e-10::DOUBLE))), 6) AS h FROM l WHERE g IS NOT NULL")
def kl_1d(spark, d):
    return one(spark, h=information.spacing_entropy(v.symbols(spark, d), "value", 2))


def _points(spark, d):
    return v.positions(spark, d).select((F.col("frame") * 50 + F.col("particle_id")).alias("id"), "x", "y")


def _kl_sql(dist: str, k: int, ball: str, log: str) -> str:
    psi = "-0.57721566490153286060651209::DOUBLE" if k == 1 else "(-0.57721566490153286060651209::DOUBLE + " + " + ".join(f"1.0::DOUBLE / {i}" for i in range(1, k)) + ")"
    return f"""WITH {v.P}, q AS (SELECT a.frame, a.particle_id, {dist} AS d, row_number() OVER (PARTITION BY a.frame, a.particle_id ORDER BY {dist}) AS rn FROM p a JOIN p b ON a.frame <> b.frame OR a.particle_id <> b.particle_id)
SELECT round(({_PSI.format('p')} - {psi} + {ball} + 2 * avg(ln(greatest(d, 1e-10::DOUBLE)))) / {log}, 6) AS h FROM q WHERE rn = {k}"""


@query(_kl_sql("greatest(abs(a.x - b.x), abs(a.y - b.y))", 4, "2 * ln(2)", "ln(2)"))
def kl_chebyshev(spark, d):
    return one(spark, h=information.kozachenko_leonenko(_points(spark, d), ["x", "y"], 4))


@query(_kl_sql("sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))", 1, "ln(pi())", "1"))
def kl_euclid(spark, d):
    return one(spark, h=information.kozachenko_leonenko(_points(spark, d), ["x", "y"], 1, 2.718281828459045, "euclid"))


@query()
def negentropy(spark, d):
    return one(spark, value=information.negentropy(v.positions(spark, d), ["x"]))


def _gain_sql(cte: str, source: str, symbol: str, label: str, log: str) -> str:
    return f"""WITH {cte}, a AS (SELECT {label} AS l, {symbol} AS s FROM {source}), c AS (SELECT l, s, count(*) AS c FROM a GROUP BY l, s), t AS (SELECT sum(c) AS n FROM c),
h0 AS (SELECT -sum(c / n * ln(c / n)) / {log} AS h FROM (SELECT sum(c) AS c FROM c GROUP BY s), t), k AS (SELECT l, sum(c) AS m FROM c GROUP BY l),
hc AS (SELECT sum(m / n * h) AS h FROM (SELECT l, first(m) AS m, -sum(c / m * ln(c / m)) / {log} AS h FROM c JOIN k USING (l) GROUP BY l), t)
SELECT round(h0.h - hc.h, 6) + 0.0 AS gain, round((h0.h - hc.h) / h0.h, 6) + 0.0 AS relative, round(h0.h, 6) + 0.0 AS h0, round(hc.h, 6) + 0.0 AS hc FROM h0, hc"""


@query(_gain_sql(v.Y, "y", "k", "event_type", "ln(2)"))
def info_gain(spark, d):
    return rounded(information.info_gain(v.symbols(spark, d), ["k"], "event_type"), "gain", "relative", "h0", "hc")


@query(_gain_sql(v.Y + ", z AS (SELECT *, min(value) OVER () AS lo, max(value) OVER () AS hi FROM y)", "z", "least(floor((value - lo) / ((hi - lo) / 20)), 19)", "event_type", "ln(20)"))
def info_gain_hist(spark, d):
    return rounded(information.entropy_gain(v.symbols(spark, d), ["value"], "event_type"), "gain", "relative", "h0", "hc")


@query(_gain_sql(v.V + ", z AS (SELECT label, vec[1] AS a, vec[2] AS b, min(vec[1]) OVER () AS la, max(vec[1]) OVER () AS ha, min(vec[2]) OVER () AS lb, max(vec[2]) OVER () AS hb FROM v)", "z", "[least(floor((a - la) / ((ha - la) / 10)), 9), least(floor((b - lb) / ((hb - lb) / 10)), 9)]", "label", "ln(100)"))
def info_gain_hist_multi(spark, d):
    rows = v.vectors(spark, d).select("label", F.col("vec")[0].alias("a"), F.col("vec")[1].alias("b"))
    return rounded(information.entropy_gain(rows, ["a", "b"], "label", 10), "gain", "relative", "h0", "hc")


@query(f"""WITH {v.S}, w AS (SELECT particle_id, frame, value AS a, lead(value, 1) OVER o AS b, lead(value, 2) OVER o AS c, lead(value, 3) OVER o AS e FROM s WINDOW o AS (PARTITION BY particle_id ORDER BY frame)),
q AS (SELECT x.particle_id, count(*) AS n3, count(*) FILTER (WHERE x.e IS NOT NULL AND y.e IS NOT NULL AND abs(x.e - y.e) < 8) AS n4 FROM w x JOIN w y ON x.particle_id = y.particle_id AND x.frame < y.frame AND abs(x.a - y.a) < 8 AND abs(x.b - y.b) < 8 AND abs(x.c - y.c) < 8 GROUP BY 1)
SELECT u.particle_id, CASE WHEN n4 > 0 THEN round(-ln(n4 / n3), 6) + 0.0 END AS value FROM (SELECT DISTINCT particle_id FROM s) u LEFT JOIN q USING (particle_id)""")
def sample_entropy(spark, d):
    return rounded(information.sample_entropy(v.series(spark, d), 8.0, strict=False), "value")


# labels

_L = "l AS (SELECT particle_id, frame, label::INT AS label FROM v)"


@query(f"WITH {v.V}, {_L}, f AS (SELECT label, count(*) / (SELECT count(*) FROM l)::DOUBLE AS f FROM l GROUP BY label) SELECT particle_id, frame, CASE WHEN f <= 0.1 AND label NOT IN (3) THEN 99 ELSE label END AS label FROM l JOIN f USING (label)")
def clean_population(spark, d):
    return labels.clean_population(v.labels(spark, d), 0.1, 99, [3])


@query(f"WITH {v.V}, {_L} SELECT frame, label, round(count(*) / (sum(count(*)) OVER (PARTITION BY frame))::DOUBLE, 6) AS fraction FROM l GROUP BY frame, label")
def state_population(spark, d):
    return rounded(labels.state_populations(v.labels(spark, d)), "fraction")


@query(f"WITH {v.V}, {_L} SELECT a.frame, b.frame AS to_frame, a.label, b.label AS to_label, count(*) AS n FROM l a JOIN l b ON a.particle_id = b.particle_id AND (a.frame, b.frame) IN ((0, 3), (3, 6), (6, 9)) GROUP BY ALL")
def sankey(spark, d):
    return labels.transitions(v.labels(spark, d), [0, 3, 6, 9])


_RUN = "(SELECT particle_id, frame, frame - row_number() OVER (PARTITION BY particle_id ORDER BY frame) AS g FROM s WHERE value >= 1 AND value <= 25)"
_RUNS = "SELECT particle_id, frame FROM (SELECT particle_id, frame, count(*) OVER (PARTITION BY particle_id, g) AS n FROM " + _RUN + ") WHERE n >= {0}"


def _inside() -> F.Column:
    return (F.col("value") >= 1) & (F.col("value") <= 25)


@query(f"WITH {v.S} {_RUNS.format(3)}")
def onion_runs(spark, d):
    return onion.assign_runs(v.series(spark, d), _inside(), 3)


@query(f"WITH {v.S} SELECT particle_id, frame // 4 AS window FROM s GROUP BY ALL HAVING count(*) = 4 AND bool_and(value >= 1 AND value <= 25)".replace("AS window", 'AS "window"'))
def onion_windows(spark, d):
    rows = onion.windows(v.series(spark, d), 4)
    return onion.assign_windows(rows, _inside()).select("particle_id", F.col("window").cast("int").alias("window"))


@query(f"WITH {v.S}, w AS (SELECT particle_id, frame // 4 AS w, bool_and(value >= 1 AND value <= 25) AS i FROM s GROUP BY ALL HAVING count(*) = 4) SELECT CASE WHEN i THEN 0 ELSE -1 END AS label, (frame % 4)::INT AS k, round(avg(value), 6) AS value FROM s JOIN w ON s.particle_id = w.particle_id AND frame // 4 = w GROUP BY ALL")
def medoids(spark, d):
    rows = onion.windows(v.series(spark, d), 4)
    marks = rows.groupBy("particle_id", "window").agg(F.when(F.bool_and(_inside()), 0).otherwise(-1).alias("label"))
    return rounded(labels.window_means(v.series(spark, d), marks, 4), "value")


@query(f"WITH {v.S}, r AS (" + " UNION ALL ".join(f"SELECT s.particle_id, s.frame, {k} AS delta_t, CASE WHEN q.frame IS NULL THEN -1 ELSE 0 END AS label FROM s LEFT JOIN ({_RUNS.format(k)}) q ON s.particle_id = q.particle_id AND s.frame = q.frame" for k in (2, 3, 5)) + ") SELECT delta_t::INT AS delta_t, count(DISTINCT CASE WHEN label <> -1 THEN label END) AS n_clusters, round(avg((label = -1)::INT), 6) AS unclassified FROM r GROUP BY delta_t")
def delta_t_summary(spark, d):
    s, out = v.series(spark, d), None
    for k in (2, 3, 5):
        hit = onion.assign_runs(s, _inside(), k).withColumn("label", F.lit(0))
        part = s.join(hit, ["particle_id", "frame"], "left").select("particle_id", "frame", F.lit(k).alias("delta_t"), F.coalesce("label", F.lit(-1)).alias("label"))
        out = part if out is None else out.unionByName(part)
    return rounded(labels.scan_summary(out), "unclassified")


@query()
def onion_full(spark, d):
    _, found = onion.onion(v.series(spark, d), 4, smooth=True)
    return found


# datasets, sidecars and dumps


@query(f"WITH {v.P} SELECT particle_id, frame, round(x, 6) + 0.0 AS value, 'x_of' AS name FROM p")
def insight_sidecar(spark, d):
    path = f"{scratch(spark)}/set.json"
    Insight(v.positions(spark, d).select("particle_id", "frame", F.col("x").alias("value")), {"name": "x_of"}).dump_to_json(path)
    back = Insight.load_from_json(spark, path)
    return rounded(back.dataset, "value").withColumn("name", F.lit(back.meta["name"]))


@query(f"WITH {v.V}, {_L} SELECT particle_id, frame, label FROM l")
def cluster_sidecar(spark, d):
    path = f"{scratch(spark)}/set.json"
    ClusterInsight(v.labels(spark, d)).dump_to_json(path)
    return ClusterInsight.load_from_json(spark, path).labels


@query(f"WITH {v.S} SELECT particle_id, (frame // 4)::INT AS \"window\", CASE WHEN bool_and(value >= 1 AND value <= 25) THEN 0 ELSE -1 END AS label, round(sum(value), 6) + 0.0 AS total, 7.5::DOUBLE AS mean FROM s GROUP BY ALL HAVING count(*) = 4")
def onion_sidecar(spark, d):
    rows = onion.windows(v.series(spark, d), 4)
    marks = rows.groupBy("particle_id", "window").agg(F.when(F.bool_and(_inside()), 0).otherwise(-1).alias("label"))
    path = f"{scratch(spark)}/set.json"
    OnionInsight(marks, {"delta_t": 4}, [{"mean": 7.5}], rows).dump_to_json(path)
    back = OnionInsight.load_from_json(spark, path)
    sums = back.reshaped_data.groupBy("particle_id", "window").agg(r6(F.sum("value")).alias("total"))
    return back.labels.join(sums, ["particle_id", "window"]).withColumn("mean", F.lit(back.state_list[0]["mean"]))


@query(f"WITH {v.S}, r AS ({_RUNS.format(3)}) SELECT s.particle_id, s.frame, CASE WHEN r.frame IS NULL THEN -1 ELSE 0 END AS label, 1 AS n_states FROM s LEFT JOIN r ON s.particle_id = r.particle_id AND s.frame = r.frame")
def onion_smooth_sidecar(spark, d):
    rows = v.series(spark, d)
    hit = onion.assign_runs(rows, _inside(), 3).withColumn("label", F.lit(0))
    path = f"{scratch(spark)}/set.json"
    OnionSmoothInsight(rows.join(hit, ["particle_id", "frame"], "left").select("particle_id", "frame", F.coalesce("label", F.lit(-1)).alias("label")), {}, [{"mean": 1.0}]).dump_to_json(path)
    back = OnionSmoothInsight.load_from_json(spark, path)
    return back.labels.withColumn("n_states", F.lit(len(back.state_list)))


@query(f"WITH {v.V}, {_REFS} SELECT ref_name, 8 AS n_max, round(list_sum(s), 6) + 0.0 AS total FROM r")
def references_stored(spark, d):
    path = scratch(spark)
    vectors.save_references(_references(spark, d), path)
    return vectors.load_references(spark, path).select("ref_name", "n_max", r6(F.aggregate("spectrum", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"WITH {v.P} SELECT particle_id, frame, round(x * 2, 6) + 0.0 AS value FROM p")
def stored_or_computed(spark, d):
    path = f"{scratch(spark)}/set.json"
    make = lambda: v.positions(spark, d).select("particle_id", "frame", (F.col("x") * 2).alias("value"))
    tables.load_or_compute(spark, path, make, factor=2)
    return rounded(tables.load_or_compute(spark, path, lambda: None, factor=2), "value")


_SIX = "10.00000 10.00000 10.00000 90.00000 90.00000 90.00000"


def _blocks(blocks: DataFrame) -> DataFrame:
    """(frame, n, header, first) of a dump's blocks."""
    lines = F.split("value", "\n")
    return blocks.select("frame", lines[0].cast("int").alias("n"), lines[1].alias("header"), lines[2].alias("first"))


@query(f"WITH {v.P} SELECT frame, count(*)::INT AS n, 'Lattice={_SIX} Properties=species:S:1:pos:R:3:type:I:1' AS header, min_by(printf('%s %.5f %.5f %.5f %d', name, x, y, z, particle_id % 3 + 2), particle_id) AS first FROM p GROUP BY frame")
def colored_dump(spark, d):
    p = v.positions(spark, d)
    return _blocks(xyz.colored_blocks(p, p.select("frame", "particle_id", (F.col("particle_id") % 3).alias("label")), v.BOX))


@query(f"""WITH {v.P} SELECT frame, count(*)::INT AS n, 'Lattice="' || printf('%.5f %.5f %.5f', 10.0 + frame, 10.0, 10.0) || ' 90.00000 90.00000 90.00000" Frame=' || frame AS header, min_by(printf('%s %.5f %.5f %.5f %.5f %.5f', name, x, y, z, x, y), particle_id) AS first FROM p GROUP BY frame""")
def insight_dump(spark, d):
    p = v.positions(spark, d)
    box = p.select("frame").distinct().select("frame", (F.lit(10.0) + F.col("frame")).alias("lx"), F.lit(10.0).alias("ly"), F.lit(10.0).alias("lz"))
    return _blocks(xyz.insight_blocks(p, [p.select("frame", "particle_id", F.col(c).alias("value")) for c in "xy"], box))


@query(f"WITH {v.P} SELECT frame, particle_id, name, 'C' AS type, round(floor(x * 100 + 0.5::DOUBLE) / 100, 6) + 0.0 AS x, round(floor(y * 100 + 0.5::DOUBLE) / 100, 6) + 0.0 AS y, round(floor(z * 100 + 0.5::DOUBLE) / 100, 6) + 0.0 AS z, 20.0::DOUBLE AS lx FROM p")
def gro_positions(spark, d):
    p = v.positions(spark, d)
    nm = [F.floor(F.col(c) * 100 + 0.5) / 1000 for c in "xyz"]
    line = F.format_string("%5d%-5s%5s%5d%8.3f%8.3f%8.3f", F.lit(1), F.lit("MOL"), "name", F.col("particle_id") + 1, *nm)
    blocks = xyz.frames_text(p.withColumn("line", line), F.lit("unused"))
    text = blocks.select("frame", F.concat(F.lit("a frame\n"), F.regexp_replace("value", "\nunused", ""), F.lit("\n   2.00000   2.00000   2.00000")).alias("value"))
    path = scratch(spark)
    xyz.save_text(text, path, 1)
    trj = Trajectory.from_gro(spark, path)
    return trj.positions.join(trj.box.select("frame", r6("lx").alias("lx")), "frame").select("frame", "particle_id", "name", "type", *[r6(c).alias(c) for c in "xyz"], "lx")


@query(f"WITH {v.P} SELECT ((frame - 1) // 3)::INT AS frame, particle_id, round(y, 6) + 0.0 AS y FROM p WHERE frame >= 1 AND frame < 8 AND (frame - 1) % 3 = 0")
def slice_kept(spark, d):
    return rounded(Trajectory(v.positions(spark, d), v.BOX).with_slice(0, 4).get_slice(1, 8, 3).positions.select("frame", "particle_id", "y"), "y")


@query(f"WITH {v.P}, q AS (SELECT frame, particle_id, x, y, z FROM p WHERE type = 'A') SELECT frame, particle_id::VARCHAR AS particle_id, round(x, 6) + 0.0 AS x FROM q")
def track_dump(spark, d):
    path = scratch(spark)
    xyz.save_text(xyz.track_blocks(v.positions(spark, d).where("type = 'A'")), path, 1)
    return xyz.read_xyz(spark, path, ["name", "x", "y", "z", "ID"]).select("frame", F.col("ID").cast("string").alias("particle_id"), r6("x").alias("x"))


# more of vectors, neighbours and information


@query(f"WITH {v.V}, l AS (SELECT *, lead(vec, 2) OVER (PARTITION BY particle_id ORDER BY frame) AS w FROM v) SELECT particle_id, frame, round({_DIST.format('vec', 'w')}, 6) + 0.0 AS value FROM l WHERE w IS NOT NULL")
def angular_velocity(spark, d):
    return rounded(Insight(v.vectors(spark, d).drop("label"), {"name": "velocity"}).get_angular_velocity(2).dataset, "value")


@query(f"WITH {v.V} SELECT a.particle_id, a.frame, round(sqrt(greatest(0, 2 - 2 * pow({_COS.format('a.vec', 'b.vec')}, 3))), 6) + 0.0 AS kernel3, round(sqrt(greatest(0, 2 - 2 * list_dot_product(a.vec, b.vec))), 6) + 0.0 AS unit FROM v a JOIN v b ON a.particle_id = b.particle_id AND b.frame = 0")
def vector_distances(spark, d):
    rows = v.vectors(spark, d)
    first = rows.where("frame = 0").select("particle_id", F.col("vec").alias("w"))
    met = rows.join(first, "particle_id")
    return met.select("particle_id", "frame", r6(kernel_distance(F.col("vec"), F.col("w"), 3)).alias("kernel3"), r6(unit_distance(F.col("vec"), F.col("w"))).alias("unit"))


_ALIGN = _alignment_sql("previous").replace(_alignment_cosine(), "(a.vx * b.vx + a.vy * b.vy + a.vz * b.vz)")


@query(_ALIGN)
def alignment_by_metric(spark, d):
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    return rounded(descriptors.mean_alignment(_edges(spark, d), descriptors.displacements(v.positions(spark, d), "previous"), dot), "value")


@query(f"""WITH {v.P}, {v.edges(5.0, inclusive=True, own=True)}, ra AS (SELECT particle_id, (dense_rank() OVER (ORDER BY particle_id) - 1) // 5 AS b FROM (SELECT DISTINCT particle_id FROM p WHERE type = 'A')), rb AS (SELECT particle_id, (dense_rank() OVER (ORDER BY particle_id) - 1) // 10 AS b FROM (SELECT DISTINCT particle_id FROM p)),
h AS (SELECT least(floor(sqrt(d2) / 0.25::DOUBLE), 19) AS bin, count(*) AS c FROM e JOIN ra ON i = ra.particle_id JOIN rb ON j = rb.particle_id WHERE ra.b <> rb.b GROUP BY 1), m AS (SELECT (SELECT count(DISTINCT frame) FROM p) AS f, (SELECT count(*) FROM ra) AS n1, (SELECT count(*) FROM rb) AS n2),
b AS (SELECT range AS bin, coalesce(c, 0) AS n FROM range(20) LEFT JOIN h ON h.bin = range)
SELECT bin::INT AS bin, round((bin + 0.5) * 0.25::DOUBLE, 6) AS r, round(n / ((4.0::DOUBLE / 3.0 * pi() * (pow((bin + 1) * 0.25::DOUBLE, 3) - pow(bin * 0.25::DOUBLE, 3))) * f * (n1 * n2 - 50 * (n1 // 5)) / 1000.0::DOUBLE), 6) + 0.0 AS value FROM b, m""")
def rdf_blocks(spark, d):
    return rounded(series.rdf(v.positions(spark, d), (0.0, 5.0), v.BOX, "type A", "all", (5, 10), 20), "r", "value")


def _entropy_by_neighbours(group: str) -> str:
    """Entropy of the points of each group: four neighbours, the largest of the coordinates' differences."""
    same = "true" if group == "0" else "a.label = b.label"
    return f"""(SELECT g, first(n) AS n, ({{psi}} + 0.57721566490153286060651209::DOUBLE - (1 + 1 / 2::DOUBLE + 1 / 3::DOUBLE) + 2 * ln(2) + 2 * avg(ln(greatest(d, 1e-10::DOUBLE)))) / ln(2) AS h FROM (
SELECT {group.replace('label', 'a.label')} AS g, count(*) OVER (PARTITION BY a.id) + 1 AS n, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS d, row_number() OVER (PARTITION BY a.id ORDER BY greatest(abs(a.x - b.x), abs(a.y - b.y))) AS rn FROM q a JOIN q b ON a.id <> b.id AND {same}) WHERE rn = 4 GROUP BY g)""".format(psi="(-0.57721566490153286060651209::DOUBLE + list_sum(list_transform(range(1, first(n)::BIGINT), lambda i: 1.0::DOUBLE / i)))")


@query(f"""WITH {v.V}, q AS (SELECT frame * 50 + particle_id AS id, vec[1] * 10 AS x, vec[2] * 10 AS y, label % 3 AS label FROM v), a AS {_entropy_by_neighbours('0')}, b AS {_entropy_by_neighbours('label')}, c AS (SELECT sum(n * h) / sum(n) AS hc FROM b)
SELECT round(a.h - hc, 6) + 0.0 AS gain, round((a.h - hc) / a.h, 6) + 0.0 AS relative, round(a.h, 6) + 0.0 AS h0, round(hc, 6) + 0.0 AS hc FROM a, c""")
def info_gain_neighbours(spark, d):
    rows = v.vectors(spark, d).select((F.col("frame") * 50 + F.col("particle_id")).alias("id"), (F.col("vec")[0] * 10).alias("x"), (F.col("vec")[1] * 10).alias("y"), (F.col("label") % 3).alias("label"))
    return rounded(information.info_gain_kl(rows, ["x", "y"], "label"), "gain", "relative", "h0", "hc")


@query(f"""WITH {v.S}, q AS (SELECT particle_id, frame, -(value + frame * 0.0001::DOUBLE) AS y FROM s), l AS (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS b FROM q WINDOW w AS (PARTITION BY particle_id ORDER BY frame)), k AS (SELECT * FROM l WHERE y > a AND y > b),
h AS (SELECT k.particle_id, k.frame, k.y, max(q.frame) FILTER (WHERE q.frame < k.frame AND q.y > k.y) AS lo, min(q.frame) FILTER (WHERE q.frame > k.frame AND q.y > k.y) AS hi FROM k JOIN q ON q.particle_id = k.particle_id GROUP BY ALL),
m AS (SELECT h.particle_id, h.frame, h.y, min(q.y) FILTER (WHERE q.frame < h.frame) AS lm, min(q.y) FILTER (WHERE q.frame > h.frame) AS rm FROM h JOIN q ON q.particle_id = h.particle_id AND q.frame >= coalesce(lo, -1) AND q.frame <= coalesce(hi, 1000000000) GROUP BY ALL)
SELECT particle_id AS series, frame::DOUBLE AS x, round(-y, 6) AS y FROM m WHERE y - greatest(lm, rm) >= 20""")
def find_minima(spark, d):
    curve = v.series(spark, d).select(F.col("particle_id").alias("series"), F.col("frame").alias("x"), (F.col("value") + F.col("frame") * 0.0001).alias("y"))
    return rounded(series.find_extrema(curve, "min", 20.0), "y")


@query(f"WITH {v.V}, l AS (SELECT label::INT AS label, frame % 3 AS delta_t FROM v) SELECT delta_t, label, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY delta_t))::DOUBLE, 6) AS fraction FROM l GROUP BY delta_t, label")
def population_fractions(spark, d):
    return rounded(labels.population_fractions(v.labels(spark, d).withColumn("delta_t", F.col("frame") % 3)), "fraction")


# onion clustering, whole


@query()
def onion_windows_full(spark, d):
    _, found = onion.onion(v.series(spark, d), 3)
    return found


@query()
def onion_vectors(spark, d):
    rows = v.vectors(spark, d).select("particle_id", "frame", F.slice("vec", 1, 2).alias("vec"))
    return onion.onion(rows, 2, 10, 2.0, smooth=True)[1]


@query()
def onion_scan(spark, d):
    summary, _ = Insight(v.series(spark, d)).get_onion_analysis(2, 8, 3)
    return rounded(summary, "unclassified")


# detections and tracks


@query(f"WITH {v.Y}, {v.D}, k AS (SELECT *, row_number() OVER (PARTITION BY image_path ORDER BY conf DESC, det_id) AS rn FROM d WHERE conf >= 0.25 AND cls IN (1, 2, 3)) SELECT image_path, det_id, cls, round(conf, 6) AS conf FROM k WHERE rn <= 20")
def det_filter_topk(spark, d):
    return rounded(detections.filter_detections(v.detections(spark, d), 0.25, [1, 2, 3], 20).select("image_path", "det_id", "cls", "conf"), "conf")


@query(f"WITH {v.Y}, {v.D} SELECT dense_rank() OVER (ORDER BY image_path)::INT - 1 AS frame, cls, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, 0.0::DOUBLE AS z FROM d")
def det_centers(spark, d):
    return detections.centres(v.detections(spark, d))


@query(f"WITH {v.Y}, {v.D}, i AS (SELECT DISTINCT image_path FROM d) SELECT image_path, CASE WHEN row_number() OVER (ORDER BY image_path) <= floor((SELECT count(*) FROM i) * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS part FROM i")
def train_val_split(spark, d):
    return detections.train_split(v.detections(spark, d))


@query(f"WITH {v.Y}, {v.D} SELECT image_path, string_agg(printf('%d %.6f %.6f %.6f %.6f', cls, (x1 + x2) / 2 / 200, (y1 + y2) / 2 / 100, (x2 - x1) / 200, (y2 - y1) / 100), chr(10) ORDER BY det_id) AS lines FROM d GROUP BY image_path")
def yolo_labels(spark, d):
    return detections.yolo_lines(v.detections(spark, d), 200.0, 100.0)


@query(f"""WITH RECURSIVE {v.Y}, {v.D}, k AS MATERIALIZED (SELECT image_path, det_id, cls, {{'c': cls, 'a': x1, 'b': y1, 'x': x2, 'y': y2}} AS o, row_number() OVER (PARTITION BY image_path ORDER BY conf DESC, det_id) AS rn FROM d WHERE conf >= 0.25),
s AS (SELECT image_path, rn, [o] AS kept, true AS stays FROM k WHERE rn = 1
UNION ALL SELECT image_path, rn, CASE WHEN free THEN list_append(kept, o) ELSE kept END, free FROM (SELECT k.image_path, k.rn, kept, o, len(list_filter(kept, lambda p: p.c = o.c AND greatest(0, least(p.x, o.x) - greatest(p.a, o.a)) * greatest(0, least(p.y, o.y) - greatest(p.b, o.b))
> 0.5::DOUBLE * ((p.x - p.a) * (p.y - p.b) + (o.x - o.a) * (o.y - o.b) - greatest(0, least(p.x, o.x) - greatest(p.a, o.a)) * greatest(0, least(p.y, o.y) - greatest(p.b, o.b))))) = 0 AS free FROM s JOIN k ON k.image_path = s.image_path AND k.rn = s.rn + 1))
SELECT k.image_path, det_id, cls FROM s JOIN k ON k.image_path = s.image_path AND k.rn = s.rn WHERE stays""")
def det_suppress(spark, d):
    return detections.suppress(v.detections(spark, d).where("conf >= 0.25"), 0.5).select("image_path", "det_id", "cls")


@query()
def track_link(spark, d):
    return tracking.track(v.positions(spark, d).select("frame", "x", "y", "z"), 0.4, 1).select("frame", r6("x").alias("x"), "particle_id")


@query("""SELECT 'info' AS level, 'read {"table": "embeddings", "rows": ' || count(*) || '}' AS message FROM embeddings""")
def run_log(spark, d):
    log = Log()
    log.log(f"read {json.dumps({'table': 'embeddings', 'rows': v.vectors(spark, d).count()})}")
    return log.table(spark).select("level", "message")
