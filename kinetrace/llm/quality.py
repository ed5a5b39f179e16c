"""Quality rules: robust multivariate outliers by minimum covariance determinant, in DataFrame and SQL functions only.

Statistics come from array functions inside each row, so texts are never shuffled. Windows of five words are compared by a 64-bit hash; texts in which a hash occurs twice (few) are compared again by the words themselves, so the counts are exact.

Estimates start twice, from all rows' moments and from medians and quartiles; each start concentrates, and a group takes the one whose covariance has the lesser determinant, so a cluster of outliers can't hide behind the spread that it makes itself.

A null text counts as empty, null languages and sources as empty strings; texts of any length are read whole. Rows are independent: repeated ones each get their row. A group of language and source is estimated by itself where it has 40 documents (a covariance of four statistics needs rows); the smaller ones of a language together, or all such together. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WS_CHARS, WS_CLASS, documents, materialize, spread

WINDOW = 5


def let(value: Column, body) -> Column:
    """Bind a value once: the optimizer would else compute it anew for each element of a lambda that names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of words; none for null or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WS_CLASS + "+"))


def repeated_words(words: Column) -> Column:
    """Number of words in five-word windows that the text holds twice or more."""

    def exact(w: Column) -> Column:
        gram = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("g"), i.alias("i")))

        def covered(s: Column) -> Column:
            n = F.size(s)
            twice = F.filter(F.transform(s, lambda x, k: F.when(((k > 0) & (F.try_element_at(s, k)["g"] == x["g"])) | ((k < n - 1) & (F.try_element_at(s, k + 2)["g"] == x["g"])), x["i"])), lambda x: x.isNotNull())
            return let(F.array_sort(twice), lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.try_element_at(p, k + 2) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

        return let(F.sort_array(gram), covered)

    def count(w: Column) -> Column:
        hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(h[i + k] for k in range(WINDOW)))))
        return let(hashes, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), exact(w)).otherwise(0))

    return let(words, lambda w: F.when(F.size(w) < WINDOW + 1, 0).otherwise(count(w))).cast("long")


def base_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns to keep, n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words. A null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    stats = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long")
    return docs.select("doc_id", *keep, stats.alias("s"), by_line.alias("b"), symbols.alias("n_symbols")).select("doc_id", *keep, "s.n_words", "s.word_chars", "n_symbols", "b.n_lines", "b.n_dup_lines", "s.n_repeat_words")


#: Transformed statistics, in thousandths: mean word length drawn to 5, and square roots of the shares of symbols, repeated lines and repeated words, short texts drawn to 0.
VECTOR = {
    "z1": "(word_chars + 100) / (n_words + 20)",
    "z2": "sqrt(n_symbols / (word_chars + 20))",
    "z3": "sqrt(n_dup_lines / (n_lines + 5))",
    "z4": "sqrt(n_repeat_words / (n_words + 20))",
}
#: Standard deviations, in thousandths, that every estimate is given at least: most texts have no symbol or repeat at all, and their spread would be 0.
FLOOR = (250.0, 50.0, 150.0, 120.0)
SHARE, STEPS, LEAST_ROWS, BINS, SALTS = 0.75, 5, 40, 400, 16
#: Squared distance beyond which a document is rejected: the 0.9999 quantile of chi-square with 4 degrees of freedom.
CUTOFF = 23.512742444991076
#: Quartiles of a normal distribution lie so many standard deviations apart.
QUARTILES = 1.349
#: Share / P(chi-square(6) <= its 0.75 quantile with 4 degrees of freedom): makes the covariance of the inner 75 % that of the whole.
CONSISTENCY = 1.4862
PAIRS = [(i, j) for i in range(1, 5) for j in range(1, i + 1)]


def vectors(stats: DataFrame) -> DataFrame:
    whole = {k: F.floor(F.expr(v) * 1000 + 0.5).cast("double") for k, v in VECTOR.items()}
    return stats.withColumns(whole).withColumns({"lang_key": F.coalesce("lang", F.lit("")), "source_key": F.coalesce("source", F.lit(""))})


def with_groups(rows: DataFrame) -> DataFrame:
    """Adds g: language and source, where they have 40 documents; else the language's small sources together, where those have 40; else all the rest together."""
    sizes = rows.groupBy("lang_key", "source_key").count()
    small = sizes.where(F.col("count") < LEAST_ROWS).groupBy("lang_key").agg(F.sum("count").alias("rest"))
    named = sizes.join(small, "lang_key", "left").select(
        "lang_key", "source_key",
        F.when(F.col("count") >= LEAST_ROWS, F.concat_ws("\u0001", F.lit("s"), "lang_key", "source_key")).when(F.col("rest") >= LEAST_ROWS, F.concat_ws("\u0001", F.lit("l"), "lang_key")).otherwise("r").alias("g"),
    )
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.hash("doc_id", "word_chars"), F.lit(SALTS))).join(named, ["lang_key", "source_key", "salt"])


def estimates(sums: DataFrame, factor: float) -> DataFrame:
    """Mean and the lower triangle of the covariance's Cholesky factor, from sums by g and start."""
    cov = {f"c{i}{j}": (F.col(f"s{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")) / F.col("n") * F.lit(factor) + (FLOOR[i - 1] ** 2 if i == j else 0.0) for i, j in PAIRS}
    out = sums.select("g", "start", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(1, 5)], *[v.alias(k) for k, v in cov.items()])
    for i, j in sorted(PAIRS, key=lambda p: (p[1], p[0])):
        rest = F.col(f"c{i}{j}")
        for k in range(1, j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.select("g", "start", *[f"m{i}" for i in range(1, 5)], *[f"l{i}{j}" for i, j in PAIRS])


def distances(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Adds start and d2, the squared Mahalanobis distance to the group's estimate, by forward substitution; a row for each start."""
    salted = params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a group may hold a third of all rows
    out = rows.join(salted, ["g", "salt"])
    for i in range(1, 5):
        rest = F.col(f"z{i}") - F.col(f"m{i}")
        for k in range(1, i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    d2 = F.col("y1") * F.col("y1") + F.col("y2") * F.col("y2") + F.col("y3") * F.col("y3") + F.col("y4") * F.col("y4")
    return out.select(*rows.columns, "start", d2.alias("d2"))


def moments() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(f"z{i}").alias(f"s{i}") for i in range(1, 5)], *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"s{i}{j}") for i, j in PAIRS]]


def starts(rows: DataFrame) -> DataFrame:
    """Two first estimates by g: 0 from the moments of all rows, 1 from medians and quartiles (exact: z are whole numbers, counted before the shuffle) without correlations."""
    classical = estimates(rows.groupBy("g").agg(*moments()).withColumn("start", F.lit(0)), 1.0)
    quarters = rows.groupBy("g").agg(*[F.percentile(f"z{i}", [0.25, 0.5, 0.75]).alias(f"q{i}") for i in range(1, 5)])
    spread = [(F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / F.lit(QUARTILES), F.lit(FLOOR[i - 1])) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in PAIRS]
    return classical.unionByName(quarters.select("g", F.lit(1).alias("start"), *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(1, 5)], *spread))


def minimum_covariance(rows: DataFrame) -> DataFrame:
    """Estimates by g: of two starts after five concentration steps the one with the least determinant.

    A step sums moments by group, start and bin of the distance (quarter units, a bounded number of bins), which combines before the shuffle however large a group is, then keeps the innermost bins that hold 75 % of the group. z are whole numbers, so sums don't depend on the order of rows.
    """
    params = starts(rows)
    names = ["n", *[f"s{i}" for i in range(1, 5)], *[f"s{i}{j}" for i, j in PAIRS]]
    for _ in range(STEPS):
        binned = distances(rows, params).withColumn("bin", F.least(F.floor(F.sqrt("d2") * 4), F.lit(BINS)))
        inner = binned.groupBy("g", "start", "bin").agg(*moments())
        w = Window.partitionBy("g", "start")
        inner = inner.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)}).where(F.col("upto") - F.col("n") < F.col("all") * SHARE)
        params = estimates(inner.groupBy("g", "start").agg(*[F.sum(x).alias(x) for x in names]), CONSISTENCY)
    determinant = F.col("l11") * F.col("l22") * F.col("l33") * F.col("l44")
    return params.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(determinant, "start"))).where("rn = 1").drop("rn")


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, mahalanobis2 (the squared distance to the group's estimate) and kept."""
    n = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"}
    stats = materialize(with_groups(vectors(base_statistics(docs, "lang", "source"))).drop("lang", "source"))
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = distances(stats, minimum_covariance(stats)).withColumn("base_failed", base_failed)
    return out.select("doc_id", *[c for c in stats.columns if c in n], "base_failed", F.round("d2", 4).alias("mahalanobis2"), (~F.col("base_failed") & (F.col("d2") <= CUTOFF)).alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spread(documents(spark, sf_dir, "doc_id", "text", "lang", "source")))


def _sql() -> str:
    """The same in DuckDB's SQL."""
    ws = r"[\x20\x09-\x0D]+"
    mom = "count(*)::DOUBLE AS n, " + ", ".join([f"sum(z{i}) AS s{i}" for i in range(1, 5)] + [f"sum(z{i} * z{j}) AS s{i}{j}" for i, j in PAIRS])
    again = ", ".join(f"sum({x}) AS {x}" for x in ["n", *[f"s{i}" for i in range(1, 5)], *[f"s{i}{j}" for i, j in PAIRS]])

    def est(sums: str, factor: float) -> str:
        cov = ", ".join([f"s{i} / n AS m{i}" for i in range(1, 5)] + [f"(s{i}{j} - s{i} * s{j} / n) / n * {factor}::DOUBLE + {FLOOR[i - 1] ** 2 if i == j else 0.0}::DOUBLE AS c{i}{j}" for i, j in PAIRS])
        low = ", ".join((f"sqrt(greatest({rest}, 1.0::DOUBLE))" if i == j else f"({rest}) / l{j}{j}") + f" AS l{i}{j}" for i, j in sorted(PAIRS, key=lambda p: (p[1], p[0])) for rest in ["".join([f"c{i}{j}", *[f" - l{i}{k} * l{j}{k}" for k in range(1, j)]])])
        return f"SELECT *, {low} FROM (SELECT g, start, {cov} FROM ({sums}))"

    def dist(params: str) -> str:
        ys = ", ".join(f"(z{i} - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(1, i)) + f") / l{i}{i} AS y{i}" for i in range(1, 5))
        return f"SELECT *, y1 * y1 + y2 * y2 + y3 * y3 + y4 * y4 AS d2 FROM (SELECT *, {ys} FROM v JOIN {params} USING (g))"

    fields = ", ".join(["g", "start", *[f"m{i}" for i in range(1, 5)], *[f"l{i}{j}" for i, j in PAIRS]])
    quarters = ", ".join(f"quantile_cont(z{i}, [0.25, 0.5, 0.75]) AS q{i}" for i in range(1, 5))
    spread = ", ".join([f"q{i}[2] AS m{i}" for i in range(1, 5)] + [f"greatest((q{i}[3] - q{i}[1]) / {QUARTILES}::DOUBLE, {FLOOR[i - 1]}::DOUBLE) AS l{i}{j}" if i == j else f"0.0::DOUBLE AS l{i}{j}" for i, j in PAIRS])
    first = est(f"SELECT g, 0 AS start, {mom} FROM v GROUP BY g", 1.0)
    steps = [f"p0 AS MATERIALIZED (SELECT {fields} FROM ({first}) UNION ALL SELECT {fields} FROM (SELECT g, 1 AS start, {spread} FROM (SELECT g, {quarters} FROM v GROUP BY g)))"]
    for k in range(1, STEPS + 1):
        inner = f"SELECT *, sum(n) OVER (PARTITION BY g, start ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY g, start) AS total FROM (SELECT g, start, bin, {mom} FROM (SELECT *, least(floor(sqrt(d2) * 4), {BINS}) AS bin FROM ({dist(f'p{k - 1}')})) GROUP BY g, start, bin)"
        steps.append(f"p{k} AS MATERIALIZED ({est(f'SELECT g, start, {again} FROM ({inner}) WHERE upto - n < total * {SHARE}::DOUBLE GROUP BY g, start', CONSISTENCY)})")
    steps.append(f"best AS MATERIALIZED (SELECT * FROM p{STEPS} QUALIFY row_number() OVER (PARTITION BY g ORDER BY l11 * l22 * l33 * l44, start) = 1)")
    z = ", ".join(f"floor(({v.replace('/', '::DOUBLE /')}) * 1000 + 0.5) AS {k}" for k, v in VECTOR.items())
    return f"""
WITH t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lk, coalesce(source, '') AS sk FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{ws}'), lambda x: x <> '') AS w FROM t),
grams AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 6),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS n FROM grams),
hit AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM counted WHERE n > 1),
rep AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words FROM hit GROUP BY doc_id),
b AS (SELECT t.doc_id, lk, sk, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM t JOIN w USING (doc_id) LEFT JOIN rep USING (doc_id)),
s AS MATERIALIZED (SELECT * EXCLUDE (lines), len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM b),
size AS (SELECT lk, sk, count(*) AS c FROM s GROUP BY lk, sk),
rest AS (SELECT lk, sum(c) AS r FROM size WHERE c < {LEAST_ROWS} GROUP BY lk),
named AS (SELECT size.lk, sk, CASE WHEN c >= {LEAST_ROWS} THEN 's' || chr(1) || size.lk || chr(1) || sk WHEN r >= {LEAST_ROWS} THEN 'l' || chr(1) || size.lk ELSE 'r' END AS g FROM size LEFT JOIN rest ON size.lk = rest.lk),
v AS MATERIALIZED (SELECT s.*, g, {z} FROM s JOIN named ON s.lk = named.lk AND s.sk = named.sk),
{", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bad AS base_failed, round(d2, 4) AS mahalanobis2, NOT bad AND d2 <= {CUTOFF} AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS bad FROM ({dist("best")}))"""


SQL = _sql()
