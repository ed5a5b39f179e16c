"""Images as rows (path, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

IMAGES = "*.{png,jpg,jpeg,bmp,ppm,pgm,pbm}"


def read_images(spark: SparkSession, path: str, pattern: str = IMAGES, recursive: bool = True) -> DataFrame:
    """Files of a folder (or one file) whose names match; contents are only read where a column asks for them."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return rows.select("path", "modificationTime", "length", "content")
