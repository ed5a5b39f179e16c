"""Log of what was done, and archive of the datasets that came of it."""

from __future__ import annotations

import json
import re
import zipfile
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from .session import shared_dir


class Log:
    """History of messages, and recorded datasets. A dataset whose meta equals that of one recorded before isn't recorded again."""

    def __init__(self, auto_record: bool = False) -> None:
        self.auto_record = auto_record
        self.history: list[tuple[str, str, str]] = []
        self.recorded: list[tuple[dict, str]] = []

    def _add(self, level: str, message: str) -> None:
        self.history.append((datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S"), level, message))

    def log(self, message: str) -> None:
        self._add("info", message)

    def warning(self, message: str) -> None:
        self._add("warning", message)

    def lines(self) -> list[str]:
        return [f"[{ts}] {'WARNING: ' if level == 'warning' else ''}{m}" for ts, level, m in self.history]

    def save_history(self, path: str) -> None:
        with open(path, "w") as out:
            out.writelines(f"{x}\n" for x in self.lines())

    def clear_history(self) -> None:
        self.history.clear()

    def table(self, spark: SparkSession) -> DataFrame:
        """(ts, level, message)"""
        return spark.createDataFrame(self.history, "ts string, level string, message string")

    def record(self, data: DataFrame, meta: dict) -> bool:
        """Writes the dataset to the shared folder; False if one with this meta is there."""
        if any(m == meta for m, _ in self.recorded):
            return False
        path = shared_dir(data.sparkSession)
        data.write.parquet(path)
        self.recorded.append((dict(meta), path))
        return True

    def extract(self, spark: SparkSession, path: str) -> list[str]:
        """A local ZIP of the recorded datasets, a folder of Parquet files each, named by their meta's values; a name that is taken gets _1, _2, and so on. One file at a time passes through the driver."""
        names: list[str] = []
        with zipfile.ZipFile(path, "w") as z:
            for meta, folder in self.recorded:
                base = file_name(meta)
                name, k = base, 0
                while name in names:
                    k += 1
                    name = f"{base}_{k}"
                names.append(name)
                files = spark.read.format("binaryFile").load(f"{folder}/*.parquet").orderBy("path").select("content")
                for k, r in enumerate(files.toLocalIterator()):
                    z.writestr(f"{name}/data/{k:05d}.parquet", bytes(r["content"]))
                z.writestr(f"{name}/meta.json", json.dumps(meta))
        return names


def file_name(meta: dict) -> str:
    return "_".join(re.sub(r"[^A-Za-z0-9.-]+", "_", str(v)).strip("_") for v in meta.values()) or "dataset"


LOG = Log()
