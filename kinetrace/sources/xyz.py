"""XYZ text: scan and sinks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship, written

#: How columns are read; any other is a number.
CONVERTERS = {"name": ("string", str), "type": ("string", str), "ID": ("long", int)}
_FIXED = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def parse(text: str, columns: Sequence[str]) -> Iterator[tuple]:
    """(frame, row, values...): a line of digits opens a frame, the next is a comment; lines with fewer tokens than columns are passed over, further tokens too."""
    lines, frame, at = text.splitlines(), -1, 0
    read = [CONVERTERS.get(c, ("double", float))[1] for c in columns]
    while at < len(lines):
        head = lines[at].strip()
        if not head.isdigit():
            at += 1
            continue
        frame += 1
        body = lines[at + 2 : at + 2 + int(head)]
        for row, line in enumerate(body):
            parts = line.split()
            if len(parts) >= len(columns):
                yield (frame, row, *(f(x) for f, x in zip(read, parts, strict=False)))
        at += 2 + int(head)


def columns_of(text: str) -> list[str]:
    """x y z with three columns, name x y z with four or more; ValueError else."""
    lines = text.splitlines()
    for k, line in enumerate(lines):
        if line.strip().isdigit() and k + 2 < len(lines):
            n = len(lines[k + 2].split())
            if n < 3:
                break
            return ["x", "y", "z"] if n == 3 else ["name", "x", "y", "z"]
    raise ValueError("an XYZ file has three columns of numbers, or a name and three")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): the lines of text files with their numbers from 0, read in splits. Each split counts its own lines from where those before it end; a row per split is gathered for that."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = text.groupBy("path", "block").agg(F.count(F.lit(1)).alias("lines"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(splits.select("path", "block", (before - F.col("first")).alias("shift")))
    return text.join(F.broadcast(starts), ["path", "block"]).select("path", (F.col("id") + F.col("shift")).alias("line"), "value")


def read_xyz(spark: SparkSession, path: str, columns: Sequence[str] | str = ("name", "x", "y", "z")) -> DataFrame:
    """(path, frame, row, columns...) of one or more files. columns 'auto': by the first frame.

    A file whose frames all have the number of rows of its first, with nothing between them, is read in splits, as a line's place tells its frame. Any other is parsed by one task, since a frame's place then follows from all before it.
    """
    lines = numbered_lines(spark, path)
    heads = lines.where("line = 0 and value rlike '^\\\\s*[0-9]+\\\\s*$'").select("path", (F.trim("value").cast("long") + 2).alias("size"))
    placed = lines.join(heads, "path").select("path", F.floor(F.col("line") / F.col("size")).cast("int").alias("frame"), F.pmod("line", "size").alias("k"), (F.col("size") - 2).cast("string").alias("n"), F.btrim("value", F.lit(" \t\r")).alias("value"))
    blank = F.when((F.col("k") == 0) & (F.col("value") == ""), F.col("frame"))
    odd = F.bool_or((F.col("k") == 0) & (F.col("value") != "") & (F.col("value") != F.col("n")))
    regular = written(placed.groupBy("path").agg((~odd & (F.coalesce(F.min(blank), F.lit(1 << 30)) > F.max(F.when(F.col("value") != "", F.col("frame"))))).alias("ok")))
    every = spark.read.format("binaryFile").load(path).select(F.col("path").alias("where"), F.col("_metadata.file_path").alias("path"))
    whole = [r[0] for r in every.join(regular.where("ok"), "path", "left_anti").select("where").collect()]  # names of irregular files
    if columns == "auto":
        first = placed.join(regular.where("ok"), "path").where("frame = 0 and k = 2").select("n", "value").first()
        sample = f"{first['n']}\n\n{first['value']}" if first else spark.read.text(whole, wholetext=True).first()["value"] if whole else ""
        columns = columns_of(sample)
    names = list(columns)
    kinds = [CONVERTERS.get(c, ("double", float))[0] for c in names]
    schema = ["path string", "frame int", "row long", *(f"{c} {t}" for c, t in zip(names, kinds, strict=True))]
    body = placed.join(regular.where("ok"), "path").where("k >= 2").withColumn("p", F.split("value", "\\s+")).where((F.col("value") != "") & (F.size("p") >= len(names)))
    out = body.select("path", "frame", (F.col("k") - 2).alias("row"), *[F.col("p")[k].cast(t).alias(c) for k, (c, t) in enumerate(zip(names, kinds, strict=True))])
    return out.unionByName(_parsed(spark, whole, names, ", ".join(schema))) if whole else out


def _parsed(spark: SparkSession, paths: list[str], names: list[str], schema: str) -> DataFrame:
    ship(spark)
    kinds = [pa.string(), pa.int32(), pa.int64(), *(_FIXED[CONVERTERS.get(c, ("double", float))[0]] for c in names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, text in zip(b.column("path").to_pylist(), b.column("value").to_pylist(), strict=True):
                rows: list[tuple] = []
                for r in parse(text, names):
                    rows.append((where, *r))
                    if len(rows) == 50_000:
                        yield table(rows)
                        rows = []
                if rows:
                    yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "frame", "row", *names])

    whole = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return whole.mapInArrow(run, schema)


def positions_of(rows: DataFrame) -> DataFrame:
    """(frame, particle_id, name, type, x, y, z) of read_xyz's rows: a particle is its place in the frame."""
    name = F.col("name") if "name" in rows.columns else F.lit("X")
    return rows.select("frame", F.col("row").alias("particle_id"), name.alias("name"), name.alias("type"), "x", "y", "z")


def frames_text(lines: DataFrame, comment) -> DataFrame:
    """(frame, value): each frame's block, from rows (frame, particle_id, line) and a column of its comment."""
    blocks = lines.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("particle_id", "line"))).alias("s"), F.first(comment).alias("comment"))
    return blocks.select("frame", F.concat_ws("\n", F.size("s").cast("string"), "comment", F.transform("s", lambda x: x["line"])).alias("value"))


def write_text(blocks: DataFrame, path: str) -> None:
    """One local file, in order of frames. Blocks come to the driver one partition at a time."""
    with open(path, "w") as out:
        for r in blocks.orderBy("frame").select("value").toLocalIterator():
            out.write(r["value"] + "\n")


def save_text(blocks: DataFrame, path: str, files: int | None = None) -> None:
    """A folder of part files by ranges of frames, for what a single local file can't hold."""
    ranged = blocks.repartitionByRange(files, "frame") if files else blocks.repartitionByRange("frame")
    ranged.sortWithinPartitions("frame").select("value").write.text(path)


def _with_lattice(rows: DataFrame, box) -> DataFrame:
    """Adds `lattice`: lengths and angles as six numbers of five decimals, null without a box. box: three lengths, six numbers, or a table (frame, lx, ly, lz[, alpha, beta, gamma])."""
    if box is None:
        return rows.withColumn("lattice", F.lit(None).cast("string"))
    if not isinstance(box, DataFrame):
        numbers = [*map(float, box), *[90.0] * (6 - len(box))]
        return rows.withColumn("lattice", F.lit(" ".join(f"{x:.5f}" for x in numbers)))
    angles = [F.col(a) if a in box.columns else F.lit(90.0) for a in ("alpha", "beta", "gamma")]
    return rows.join(box.select("frame", F.format_string(" ".join(["%.5f"] * 6), "lx", "ly", "lz", *angles).alias("lattice")), "frame", "left")


def _matched(positions: DataFrame, values: DataFrame, column: str, name: str, what: str) -> DataFrame:
    """Positions with a value each, under a name; ValueError unless every position has one, and the other way round."""
    rows = positions.join(values.select("frame", "particle_id", F.col(column).alias(name)), ["frame", "particle_id"], "left")
    if not rows.where(F.col(name).isNull()).isEmpty() or positions.count() != values.count():
        raise ValueError(f"{what} don't match the trajectory")
    return rows


def colored_blocks(positions: DataFrame, labels: DataFrame, box=None, comment: str | None = None) -> DataFrame:
    """Frames with `name x y z label + 2`. The lattice stands unquoted; zeros without a box. comment: 'frame' for `Frame i` instead. ValueError unless every position has its label."""
    rows = _with_lattice(_matched(positions, labels, "label", "label", "labels"), box)
    line = F.format_string("%s %.5f %.5f %.5f %s", "name", "x", "y", "z", (F.col("label") + 2).cast("string"))
    lattice = F.concat(F.lit("Lattice="), F.coalesce("lattice", F.lit("0.0 0.0 0.0 0.0 0.0 0.0")), F.lit(" Properties=species:S:1:pos:R:3:type:I:1"))
    head = F.concat(F.lit("Frame "), F.col("frame").cast("string")) if comment == "frame" else lattice
    return frames_text(rows.withColumn("line", line), head)


def insight_blocks(positions: DataFrame, insights: Sequence[DataFrame], box=None) -> DataFrame:
    """Frames with `name x y z` and a column for each of the insights (particle_id, frame, value); the lattice stands in quotes. ValueError unless every position has a value of each."""
    rows, names = positions, [f"i{k}" for k in range(len(insights))]
    for name, values in zip(names, insights, strict=True):
        rows = _matched(rows, values, "value", name, "insights")
    line = F.format_string("%s" + " %.5f" * (3 + len(names)), "name", "x", "y", "z", *names)
    head = F.concat(F.lit('Lattice="'), F.coalesce("lattice", F.lit("0 0 0 0 0 0")), F.lit('" Frame='), F.col("frame").cast("string"))
    return frames_text(_with_lattice(rows, box).withColumn("line", line), head)


def track_blocks(tracks: DataFrame) -> DataFrame:
    """Frames with `[name] x y z id`, six decimals, in order of particles."""
    named = "name" in tracks.columns
    line = F.format_string("%s " * named + "%.6f %.6f %.6f %s", *["name"] * named, "x", "y", "z", F.col("particle_id").cast("string"))
    return frames_text(tracks.withColumn("line", line), F.concat(F.lit("Frame "), F.col("frame").cast("string")))


def centre_blocks(centres: DataFrame) -> DataFrame:
    """Frames with `cls x y z` of detections' middles (frame, cls, x, y, z), under the header `class x y z`."""
    rows = centres.withColumn("particle_id", F.monotonically_increasing_id())
    return frames_text(rows.withColumn("line", F.format_string("%d %.6f %.6f %.1f", "cls", "x", "y", "z")), F.lit("class x y z"))


def array_blocks(spark: SparkSession, coords, comment: str = "", name: str = "C") -> DataFrame:
    """Frames of an array (frame, atom, 3)."""
    import numpy as np

    a = np.asarray(coords, float)
    if a.ndim != 3 or a.shape[2] != 3:
        raise ValueError("coordinates must be (frame, atom, 3)")
    rows = [(f, p, *map(float, a[f, p])) for f in range(a.shape[0]) for p in range(a.shape[1])]
    df = spark.createDataFrame(rows, "frame int, particle_id long, x double, y double, z double")
    return frames_text(df.withColumn("line", F.format_string("%s %.5f %.5f %.5f", F.lit(name), "x", "y", "z")), F.lit(comment))


def frame_slice(positions: DataFrame, start: int = 0, stop: int | None = None, step: int = 1, renumber: bool = True) -> DataFrame:
    """Frames start, start + step, ... before stop, as a filter that reaches the scan."""
    if step < 1:
        raise ValueError("step must be 1 at least")
    rows = positions.where(F.col("frame") >= start)
    if stop is not None:
        rows = rows.where(F.col("frame") < stop)
    if step > 1:
        rows = rows.where((F.col("frame") - start) % step == 0)
    return rows.withColumn("frame", F.floor((F.col("frame") - start) / step).cast("int")) if renumber else rows

