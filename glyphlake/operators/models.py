"""From pages to text: detector, line classifier, recogniser, page classifier.

Models are pluggable: an object with the four methods of Models, built once in
each Python worker. OnnxModels runs files through onnxruntime; StubModels
stands in for them in tests and claims no accuracy.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.text import page_text
from glyphlake.operators import ctc, dbpost, imageops


class Models(Protocol):
    labels: list[str]

    def detect(self, tensor: np.ndarray) -> np.ndarray:
        """(3, H, W) to a probability map (H, W)."""

    def turn(self, tensors: np.ndarray) -> np.ndarray:
        """(n, 3, 80, 160) to probabilities (n, 2)."""

    def read(self, tensors: np.ndarray) -> np.ndarray:
        """(n, 3, 48, W) to logits (n, T, classes)."""


@dataclass(frozen=True)
class OnnxModels:
    """Model files and their dictionary. A path is one on every machine, or, where ``shipped``, names a file that addFile() has sent."""

    detector: str
    recogniser: str
    dictionary: tuple[str, ...]
    classifier: str | None = None
    shipped: bool = False

    @property
    def labels(self) -> list[str]:
        return ctc.labels_of(list(self.dictionary))

    def _run(self, path: str, tensor: np.ndarray, width: int | None = None) -> np.ndarray:
        """The output whose last axis has ``width`` elements, or else the first."""
        session = _session(_local(path) if self.shipped else path)
        outputs = session.run(None, {session.get_inputs()[0].name: tensor.astype(np.float32)})
        return next((o for o in outputs if width is not None and o.shape[-1] == width), outputs[0])

    def detect(self, tensor):
        return self._run(self.detector, tensor[None]).reshape(tensor.shape[1:])

    def turn(self, tensors):
        """Batches are filled up to a multiple of eight with zeros, so that a session sees few shapes."""
        if not self.classifier:
            return np.tile(np.float32([1, 0]), (len(tensors), 1))
        full = np.zeros((-(-len(tensors) // 8) * 8, *tensors.shape[1:]), np.float32)
        full[: len(tensors)] = tensors
        return self._run(self.classifier, full, 2)[: len(tensors)]

    def read(self, tensors):
        return self._run(self.recogniser, tensors, len(self.dictionary) + 2)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    """A whole number and where it ends."""
    value = shift = 0
    while data[at] > 127:
        value |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
    return value | data[at] << shift, at + 1


def _fields(data: bytes):
    """(number, value) of each field of a message: whole numbers, or bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = {1: (8, at), 5: (4, at)}.get(key & 7) or _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def first_channels(model: bytes) -> int | None:
    """Output channels of a model file's first convolution, by its weight's shape; None if it has none."""
    graph = next((v for k, v in _fields(model) if k == 7), b"")
    weights: dict[bytes, int] = {}
    kernel = None
    for number, value in _fields(graph):
        if number == 5:  # a weight: dimensions, one by one or packed, and a name
            parts = list(_fields(value))
            dims = next((d if isinstance(d, int) else _varint(d, 0)[0] for k, d in parts if k == 1), 0)
            weights[next((v for k, v in parts if k == 8), b"")] = dims
        elif number == 1 and kernel is None:
            parts = list(_fields(value))
            if (4, b"Conv") in parts:
                kernel = [v for k, v in parts if k == 1][1]
    return weights.get(kernel) if kernel is not None else None


def options_for(path: str, **given) -> dbpost.Options:
    """Detector options with the box threshold that its model file calls for, unless it is given."""
    with open(path, "rb") as f:
        channels = first_channels(f.read())
    return dbpost.Options(**given) if channels is None else dbpost.Options.for_channels(channels, **given)


def _local(path: str) -> str:
    from pyspark import SparkFiles

    return SparkFiles.get(os.path.basename(path))


@lru_cache(8)
def _session(path: str):
    import onnxruntime

    return onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])


@dataclass(frozen=True)
class StubModels:
    """Text is where pixels are bright; every column's brightness is a class."""

    labels: tuple[str, ...] = ("a", "b", " ")

    def detect(self, tensor):
        return (tensor.mean(0) > 0.5).astype(np.float32) * 0.95

    def turn(self, tensors):
        upside = (tensors[:, :, :40].mean((1, 2, 3)) > tensors[:, :, 40:].mean((1, 2, 3))).astype(np.float32)
        return np.stack([1 - upside * 0.8, upside * 0.8], 1)

    def read(self, tensors):
        columns = tensors.mean((1, 2)).reshape(len(tensors), -1, 8).mean(2)
        cls = np.clip(((columns + 1) * 2).astype(int), 0, len(self.labels))
        return np.eye(len(self.labels) + 1, dtype=np.float32)[cls] * 4


LINES = "page long, line_no int, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double, x4 double, y4 double, box_score double, label int, label_score double, rotation int, target_width int, content_width int, steps array<struct<cls:int,prob:double>>"


#: Lines that a model is given at once, at most.
BATCH = 16
#: Bytes of all crops of a page, at most.
CROPS = (1 << 31) - 1


def _batches(members: list[int], size: int):
    return (members[i : i + size] for i in range(0, len(members), size))


def lines_of(image: np.ndarray, models: Models, options: dbpost.Options, classifier_threshold: float = 0.0, batch: int = BATCH) -> list[tuple]:
    """One tuple of LINES' fields, the page left out, for each line of a page; models see ``batch`` lines at once."""
    if not (0 <= classifier_threshold <= 1 and batch >= 1):
        raise ValueError("option out of range")
    tensor = imageops.detector_input(image, options.limit)
    boxes = dbpost.detect_boxes(models.detect(tensor), image.shape[1], image.shape[0], options)
    sizes = [imageops.perspective(corners)[:2] for corners, _ in boxes]
    if sum(3 * w * h for w, h in sizes) > CROPS:
        raise ValueError("the lines of a page take too many bytes")
    crops = [imageops.crop(image, corners) for corners, _ in boxes]
    turns = [p for part in _batches(list(range(len(crops))), batch) for p in models.turn(np.stack([imageops.classifier_input(crops[i]) for i in part]))]
    out, by_width = [], {}
    for i, (crop, p) in enumerate(zip(crops, turns)):
        label = int(p.argmax())
        rotation = 180 if label & 1 and p[label] > classifier_threshold else 0
        crops[i] = crop[::-1, ::-1] if rotation else crop
        h, w = crop.shape[:2]
        natural = int(np.ceil(w * 48 / max(1, h)))
        target = max(32, -(-natural // 32) * 32)
        by_width.setdefault(target, []).append(i)  # never padded to another line's width: that changes what is read
        out.append([i, *map(float, boxes[i][0].reshape(-1)), boxes[i][1], label, float(p[label]), rotation, target, min(target, natural), None])
    for target, members in by_width.items():
        for part in _batches(members, batch):
            logits = models.read(np.stack([imageops.recogniser_input(crops[i], target) for i in part]))
            for i, rows in zip(part, logits):
                cls = rows.argmax(1)
                prob = 1 / np.exp(rows.astype(np.float64) - rows.max(1, keepdims=True)).sum(1)
                out[i][-1] = [{"cls": int(c), "prob": float(q)} for c, q in zip(cls, prob)]
    return [tuple(x) for x in out]


def read_lines(pages: DataFrame, models: Models, options: dbpost.Options = dbpost.Options(), classifier_threshold: float = 0.0) -> DataFrame:
    """Lines with their steps, for pages (page, width, height, stride, pixel_format, data); a page without text has no rows."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                image = imageops.pixels(r.data, r.width, r.height, r.stride, r.pixel_format)
                rows += [(r.page, *x) for x in lines_of(image, models, options, classifier_threshold)]
            yield pd.DataFrame(rows, columns=_names(LINES))

    return pages.select("page", "width", "height", "stride", "pixel_format", "data").mapInPandas(run, LINES)


def _names(ddl: str) -> list[str]:
    depth, out, word = 0, [], ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(word.split()[0])
            word = ""
        else:
            word += ch
    return out


def recognise(pages: DataFrame, models: Models, options: dbpost.Options = dbpost.Options(), alignment: bool = False) -> DataFrame:
    """read_lines() with text, score and emitted decoded on the JVM; with ``alignment`` also spans, an array that may be empty but isn't null."""
    found = ctc.decode(read_lines(pages, models, options), list(models.labels))
    return ctc.with_spans(found, list(models.labels)) if alignment else found


def page_texts(lines: DataFrame) -> DataFrame:
    """(page, lines, text, packed_text) of recognised lines."""
    counts = lines.groupBy("page").agg(F.count(F.lit(1)).alias("lines"))
    return counts.join(page_text(lines), "page")


def page_orientation(pages: DataFrame, classify) -> DataFrame:
    """(page, label, score, degrees) by a classifier of four classes; ``classify`` maps (3, 224, 224) to four probabilities."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                p = np.asarray(classify(imageops.orientation_input(imageops.pixels(r.data, r.width, r.height, r.stride, r.pixel_format))), np.float64)
                if p.shape != (4,) or not np.isfinite(p).all():
                    raise ValueError("the page classifier has four finite outputs")
                rows.append((r.page, int(p.argmax()), float(p.max()), 90 * int(p.argmax())))
            yield pd.DataFrame(rows, columns=["page", "label", "score", "degrees"])

    return pages.select("page", "width", "height", "stride", "pixel_format", "data").mapInPandas(run, "page long, label int, score double, degrees int")


def synthetic_pages(pages: DataFrame) -> DataFrame:
    """Pages of 128 x 96 BGR pixels with two bright bars, the left edge by ``label`` (0 to 90)."""
    dark = F.repeat(F.lit("10"), F.lit(384))
    bar = F.concat(F.repeat(F.lit("10"), (3 * (F.col("label") + 10)).cast("int")), F.repeat(F.lit("FF"), (3 * (100 - F.col("label"))).cast("int")), F.repeat(F.lit("10"), F.lit(54)))
    half = F.concat(F.repeat(dark, F.lit(14)), F.repeat(bar, F.lit(20)), F.repeat(dark, F.lit(14)))
    data = F.unhex(F.repeat(half, F.lit(2)))
    return pages.select("page", F.lit(128).alias("width"), F.lit(96).alias("height"), F.lit(0).alias("stride"), F.lit(0).alias("pixel_format"), data.alias("data"))
