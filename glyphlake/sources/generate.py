"""Synthetic ground truth: pages of placed text lines, without pixels."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first seed, and page sizes in steps of 16.
SEED = 20260830
WIDTHS, HEIGHTS = range(640, 1801, 16), range(480, 1401, 16)
WORDS = ["invoice", "total", "street", "number", "delivery", "address", "account", "order", "sample", "date"]
SCHEMA = "file string, seed long, width int, height int, line int, text string, x0 int, y0 int, x1 int, y1 int, natural_width int, orientation_degrees int, cls_degrees int, font_size int"


def overlaps(a: tuple[int, int, int, int], b: tuple[int, int, int, int]) -> bool:
    return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


def placed(box: tuple[int, int, int, int], taken: list[tuple[int, int, int, int]], width: int, height: int, pad: int = 2) -> bool:
    """Whether the box, padded and clipped to the page, is free of those taken."""
    wide = (max(0, box[0] - pad), max(0, box[1] - pad), min(width, box[2] + pad), min(height, box[3] + pad))
    return not any(overlaps(wide, t) for t in taken)


def free_boxes(boxes: DataFrame, width: int, height: int, page: str = "page", line: str = "line", pad: int = 2) -> DataFrame:
    """Boxes (page, line, x0, y0, x1, y1) that placed() takes when those of a page come in order of line; one row each."""
    sides = ("x0", "y0", "x1", "y1")
    listed = boxes.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(F.col(line).alias("line"), *sides))).alias("_all"))
    empty = F.expr(f"cast(array() as {listed.schema['_all'].dataType.simpleString()})")
    low, high = lambda v: F.greatest(F.lit(0), v - pad), lambda v, most: F.least(F.lit(most), v + pad)

    def take(taken, b):
        meets = F.exists(taken, lambda t: (low(b["x0"]) < t["x1"]) & (t["x0"] < high(b["x1"], width)) & (low(b["y0"]) < t["y1"]) & (t["y0"] < high(b["y1"], height)))
        return F.when(meets, taken).otherwise(F.concat(taken, F.array(b)))

    kept = listed.select(page, F.explode(F.aggregate("_all", empty, take)).alias("_b"))
    return kept.select(page, F.col("_b.line").alias(line), *(F.col(f"_b.{c}").alias(c) for c in sides))


def cls_degrees(orientation: int) -> int:
    return {0: 0, 180: 180, -180: 180, 90: 180, -90: 0, 270: 0}[orientation]


def page(number: int) -> list[tuple]:
    rng = random.Random(SEED + number)
    width, height = rng.choice(WIDTHS), rng.choice(HEIGHTS)
    taken: list[tuple[int, int, int, int]] = []
    rows = []
    for _ in range(rng.randint(6, 14)):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4)))
        size, orientation = rng.randint(14, 40), rng.choice([0, 0, 0, 180, 90, -90])
        long, short = int(len(text) * size * 0.55), int(size * 1.3)
        w, h = (short, long) if orientation in (90, -90) else (long, short)
        for _ in range(40):  # places are tried until one is free
            if w >= width or h >= height:
                break
            x, y = rng.randrange(width - w), rng.randrange(height - h)
            if placed((x, y, x + w, y + h), taken, width, height):
                taken.append((x, y, x + w, y + h))
                natural = -(-long * 48 // max(1, short))
                rows.append((f"img-{number:04d}.jpg", SEED + number, width, height, len(rows), text, x, y, x + w, y + h, natural, orientation, cls_degrees(orientation), size))
                break
    return rows


def distinct_fonts(fonts: DataFrame, name: str = "font") -> DataFrame:
    """One row for each font name, without case."""
    return fonts.groupBy(F.lower(name).alias("key")).agg(F.min(name).alias(name))


def pages(spark: SparkSession, count: int = 100) -> DataFrame:
    """Lines of ``count`` pages; page i depends on its seed alone, wherever it is made."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([r for i in pdf["id"] for r in page(int(i))], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return spark.range(count).mapInPandas(run, SCHEMA)
