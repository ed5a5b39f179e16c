"""Detection tables: (image_path, det_id, cls, conf, x1, y1, x2, y2)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, path_exists, written
from .ranks import numbered

DETECTIONS = "image_path string, det_id long, cls int, conf double, x1 double, y1 double, x2 double, y2 double"
#: Training parameters and their defaults (fixed values).
HYPERPARAMETERS = {
    "lr0": 0.01,
    "lrf": 0.01,
    "momentum": 0.937,
    "weight_decay": 0.0005,
    "warmup_epochs": 3.0,
    "warmup_momentum": 0.8,
    "box": 7.5,
    "cls": 0.5,
    "dfl": 1.5,
    "hsv_h": 0.015,
    "hsv_s": 0.7,
    "hsv_v": 0.4,
    "degrees": 0.0,
    "translate": 0.1,
    "scale": 0.5,
    "shear": 0.0,
    "perspective": 0.0,
    "flipud": 0.0,
    "fliplr": 0.5,
    "bgr": 0.0,
    "mosaic": 1,
    "mixup": 0.0,
    "cutmix": 0.0,
    "copy_paste": 0.0,
}


def check_hyperparameters(given: dict) -> dict:
    """The defaults with what is given; ValueError names keys that aren't known."""
    unknown = sorted(set(given) - set(HYPERPARAMETERS))
    if unknown:
        raise ValueError(f"unknown hyperparameters: {', '.join(unknown)}")
    return HYPERPARAMETERS | given


def filter_detections(rows: DataFrame, confidence: float = 0.25, classes: Iterable[int] | None = None, max_det: int = 500) -> DataFrame:
    """Those at least as confident, of the classes; of an image the most confident max_det."""
    kept = rows.where(F.col("conf") >= confidence)
    if classes is not None:
        kept = kept.where(F.col("cls").isin(list(classes)))
    w = Window.partitionBy("image_path").orderBy(F.desc("conf"), "det_id")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_det).drop("rank")


def suppress(rows: DataFrame, iou: float = 0.7, agnostic: bool = False) -> DataFrame:
    """Non-maximum suppression: from the most confident box on, boxes of the class (or any, agnostic) that overlap a kept one by more than iou go."""
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["conf", "det_id"], ascending=[False, True])
        kept: list[int] = []
        left = np.ones(len(pdf), bool)
        box = pdf[["x1", "y1", "x2", "y2"]].to_numpy()
        area = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
        cls = pdf["cls"].to_numpy()
        for i in range(len(pdf)):
            if left[i]:
                kept.append(i)
                w = np.minimum(box[i, 2], box[i:, 2]) - np.maximum(box[i, 0], box[i:, 0])
                h = np.minimum(box[i, 3], box[i:, 3]) - np.maximum(box[i, 1], box[i:, 1])
                both = np.maximum(w, 0) * np.maximum(h, 0)
                left[i:] &= ~((agnostic | (cls[i:] == cls[i])) & (both > iou * (area[i] + area[i:] - both)))
        return pdf.iloc[kept]

    return rows.groupBy("image_path").applyInPandas(run, schema)


def centres(rows: DataFrame, classes: Iterable[int] | None = None) -> DataFrame:
    """(frame, cls, x, y, z): middles of the boxes; a frame is an image, in order of paths."""
    kept = rows if classes is None else rows.where(F.col("cls").isin(list(classes)))
    order = frame_numbers(kept)
    return kept.join(order, "image_path").select("frame", "cls", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), F.lit(0.0).alias("z"))


def frame_numbers(rows: DataFrame) -> DataFrame:
    """(image_path, frame): places of the paths in their order."""
    return numbered(rows, "image_path").select("image_path", F.col("number").cast("int").alias("frame"))


def train_split(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """(image_path, part): the first int(n * share) images by path train, the others validate."""
    order = frame_numbers(rows)
    n = order.count()
    return order.select("image_path", F.when(F.col("frame") < int(n * share), "train").otherwise("val").alias("part"))


def yolo_lines(rows: DataFrame, width: float, height: float) -> DataFrame:
    """(image_path, lines): `cls x y w h` of each box as shares of the image's size, six decimals, in order of det_id."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "cls", (F.col("x1") + F.col("x2")) / 2 / width, (F.col("y1") + F.col("y2")) / 2 / height, (F.col("x2") - F.col("x1")) / width, (F.col("y2") - F.col("y1")) / height)
    return rows.groupBy("image_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("det_id", line.alias("l")))), lambda s: s["l"]), "\n").alias("lines"))


def without_overlap(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Boxes that overlap none of the placed ones of their image."""
    a, b = rows.alias("a"), placed.alias("b")
    meets = (F.col("a.image_path") == F.col("b.image_path")) & (F.col("a.x1") < F.col("b.x2")) & (F.col("b.x1") < F.col("a.x2")) & (F.col("a.y1") < F.col("b.y2")) & (F.col("b.y1") < F.col("a.y2"))
    return a.join(b, meets, "left_anti")


def predict(images: DataFrame, detector: Callable[[bytes], Iterable[tuple[int, float, float, float, float, float]]], confidence: float = 0.25, iou: float = 0.7, max_det: int = 500, classes: Iterable[int] | None = None, agnostic: bool = False) -> DataFrame:
    """Detections of images (path, content), as spark.read.format('binaryFile') gives them. detector: bytes to (cls, conf, x1, y1, x2, y2) rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(path, k, *found) for path, data in zip(pdf["path"], pdf["content"], strict=True) for k, found in enumerate(detector(bytes(data)))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in DETECTIONS.split(", ")])

    found = images.select("path", "content").mapInPandas(run, DETECTIONS)
    return filter_detections(suppress(found.where(F.col("conf") >= confidence), iou, agnostic), confidence, classes, max_det)


def write_dataset(rows: DataFrame, path: str, width: float, height: float, names: dict[int, str], share: float = 0.8, images: DataFrame | None = None) -> None:
    """A training set as tables: labels/part=train|val (image_path, lines), images/part=train|val (image_path, content) of images (path, content) if these are given, and dataset.yaml (as a text folder) with its classes. Images without a box stay, with no lines."""
    every = rows.select("image_path") if images is None else images.select(F.col("path").alias("image_path"))
    parts = written(train_split(every, share))
    lines = parts.join(yolo_lines(rows, width, height), "image_path", "left").select("image_path", "part", F.coalesce("lines", F.lit("")).alias("lines"))
    lines.write.partitionBy("part").parquet(f"{path}/labels")
    if images is not None:
        images.select(F.col("path").alias("image_path"), "content").join(parts, "image_path").write.partitionBy("part").parquet(f"{path}/images")
    discard(parts)
    listed = "".join(f"\n- {names[k]}" for k in sorted(names))
    rows.sparkSession.createDataFrame([(f"path: {path}\ntrain: images/train\nval: images/val\nnc: {len(names)}\nnames:{listed}",)], "value string").coalesce(1).write.text(f"{path}/dataset.yaml")


def export_dataset(spark: SparkSession, path: str, target: str) -> None:
    """A dataset's tables as files in a local folder: images/train|val, labels/train|val (a text per image, by its name without suffix) and dataset.yaml. Rows come to the driver one partition at a time."""
    out = Path(target)
    for kind in ("images", "labels"):
        if not path_exists(spark, f"{path}/{kind}"):
            continue
        for r in spark.read.parquet(f"{path}/{kind}").toLocalIterator():
            name = r["image_path"].rsplit("/", 1)[-1]
            folder = out / kind / r["part"]
            folder.mkdir(parents=True, exist_ok=True)
            if kind == "images":
                (folder / name).write_bytes(bytes(r["content"]))
            else:
                (folder / f"{Path(name).stem}.txt").write_text(r["lines"] + "\n" * bool(r["lines"]))
    text = "\n".join(r[0] for r in spark.read.text(f"{path}/dataset.yaml").collect())
    (out / "dataset.yaml").write_text(text.replace(f"path: {path}", f"path: {out.resolve()}") + "\n")


Detector = Callable[[bytes], Iterable[tuple[int, float, float, float, float, float]]]


@dataclass(frozen=True)
class Vision:
    """A detector over images (path, content), its datasets and its training. trainer: a function of (dataset's path, hyperparameters, epochs, batch size, patience, image size) to a detector and how good it is, the higher the better."""

    images: DataFrame
    detector: Detector | None = None
    trainer: Callable[..., tuple[Detector, float]] | None = None
    found: DataFrame | None = None
    dataset: str | None = None
    fitness: float | None = None

    def predict(self, confidence: float = 0.25, iou: float = 0.7, max_det: int = 500, classes: Iterable[int] | None = None, agnostic: bool = False) -> Vision:
        if self.detector is None:
            raise ValueError("a detector is needed: give one, or train it")
        return replace(self, found=predict(self.images, self.detector, confidence, iou, max_det, classes, agnostic))

    def create_dataset(self, path: str, width: float, height: float, names: dict[int, str], share: float = 0.8, load: bool = True) -> Vision:
        """Writes the predictions as a dataset, and takes it for training unless load is false."""
        if self.found is None:
            raise ValueError("No prediction results available.")
        write_dataset(self.found, path, width, height, names, share, self.images)
        return replace(self, dataset=path) if load else self

    def set_training_dataset(self, path: str) -> Vision:
        if not path_exists(self.images.sparkSession, f"{path}/dataset.yaml"):
            raise FileNotFoundError(path)
        return replace(self, dataset=path)

    def train(self, hyperparams: dict | None = None, epochs: int = 100, batch_size: int = 16, patience: int = 20, imgsz: int | tuple[int, int] = 640) -> Vision:
        if self.dataset is None or self.trainer is None:
            raise ValueError("Training dataset has not been set." if self.dataset is None else "a trainer is needed")
        detector, fitness = self.trainer(self.dataset, check_hyperparameters(hyperparams or {}), epochs, batch_size, patience, imgsz)
        return replace(self, detector=detector, fitness=fitness)

    def tune_hyperparams(self, iterations: int = 15, epochs: int = 50, imgsz: int | tuple[int, int] = 640, batch_size: int = 16, seed: int = 0) -> dict[str, float]:
        """Best of the defaults and of `iterations` mutants, each of the best so far: a third or so of the values, at least one, are scaled by a factor around 1; values that are 0 may become positive."""
        if self.dataset is None or self.trainer is None:
            raise ValueError("Training dataset has not been set." if self.dataset is None else "a trainer is needed")
        rng = np.random.default_rng(seed)
        best, top = dict(HYPERPARAMETERS), -math.inf
        for k in range(iterations + 1):
            given = dict(best)
            if k:
                change = rng.random(len(given)) < 0.3
                change[rng.integers(len(given))] = True
                for name, moved in zip(given, change, strict=True):
                    if moved:
                        given[name] = float(max(0.0, (given[name] or 0.01) * rng.normal(1.0, 0.2)))
            fitness = self.trainer(self.dataset, given, epochs, batch_size, 20, imgsz)[1]
            if fitness > top:
                best, top = given, fitness
        return best

    def export_prediction_to_xyz(self, path: str, classes: Iterable[int] | None = None) -> None:
        if self.found is None:
            raise ValueError("No prediction results available.")
        from ..sources import xyz

        xyz.write_text(xyz.centre_blocks(centres(self.found, classes)), path)
