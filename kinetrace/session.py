"""Session helpers: the package is shipped to executors once per application, so no worker needs it installed."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="kinetrace-")) / "kinetrace_package.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(out))
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and all runs in one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "kinetrace-shared")
        os.makedirs(base[7:], exist_ok=True)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    """In whatever store the path names."""
    fs, where = _store(spark, path)
    return fs.exists(where)


def remove_path(spark: SparkSession, path: str) -> None:
    fs, where = _store(spark, path)
    fs.delete(where, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a path when the application ends, for tables that results not yet computed still read."""
    fs, where = _store(spark, path)
    fs.deleteOnExit(where)


def written(df: DataFrame) -> DataFrame:
    """A table in the shared folder, read back: cuts the lineage in a way that survives lost executors. What nobody discards goes when the application ends."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    remove_at_exit(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made and nothing reads any more."""
    for t in tables:
        remove_path(t.sparkSession, t.written_to)


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, in whatever store the path names."""
    fs, where = _store(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_small(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def local_session(cores: str = "*", shuffle_partitions: int = 8, name: str = "kinetrace") -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
