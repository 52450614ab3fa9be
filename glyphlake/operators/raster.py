"""Steps over a page's pixels, one page at a time: thresholds, components, contours, scores.

Pixel tables (page, y, x, p) go through DataFrame forms; whole maps through
numpy within one page.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.geometry import POINTS


def binarize(probabilities: Column, threshold: float = 0.2) -> Column:
    """1 where a value is above the threshold; a value that is not finite is an error."""
    bad = F.exists(probabilities, lambda p: F.isnan(p) | (F.abs(p) == float("inf")))
    return F.when(bad, F.raise_error(F.lit("probability map holds a value that is not finite")).cast("array<int>")).otherwise(F.transform(probabilities, lambda p: F.when(p > threshold, 1).otherwise(0)))


def dilate_pixels(on: DataFrame, page: str = "page") -> DataFrame:
    """Pixels (page, y, x) that are on, or whose right, lower or lower right neighbour is, within the page."""
    shifts = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)))).alias("s")
    moved = on.select(page, "y", "x", shifts).select(page, (F.col("y") - F.col("s.dy")).alias("y"), (F.col("x") - F.col("s.dx")).alias("x"))
    return moved.filter("y >= 0 and x >= 0").distinct()


def boundary_pixels(on: DataFrame, page: str = "page") -> DataFrame:
    """Adds ``boundary``: whether one of the eight neighbours is off or outside (on has distinct pixels)."""
    around = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    shifts = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in around))).alias("s")
    votes = on.select(page, "y", "x", shifts).groupBy(page, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).agg(F.count(F.lit(1)).alias("_n"))
    return on.join(votes, [page, "y", "x"], "left").withColumn("boundary", F.coalesce(F.col("_n"), F.lit(0)) < 8).drop("_n")


def row_extremes(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least and largest x of each row; a hull needs no others."""
    return points.groupBy(*keys, "y").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"))


def without_repeats(values: Column) -> Column:
    """An array without elements that equal the one before."""
    return F.filter(values, lambda v, i: (i == 0) | ~v.eqNullSafe(F.get(values, i - 1)))


def polygon_scores(pixels: DataFrame, quads: DataFrame, page: str = "page") -> DataFrame:
    """(page, quad, score): the mean p of the pixels (page, y, x, p) inside or on quads (page, quad, x1..y4), 0 if there are none.

    Corners are cut to whole numbers. Pixels and quads meet by page only, within the quad's box.
    """
    corner = [F.col(c).cast("int") for c in POINTS]
    placed = quads.select(page, "quad", *(c.alias(f"_{n}") for c, n in zip(corner, POINTS)))
    xs, ys = [F.col(f"_{n}") for n in POINTS[::2]], [F.col(f"_{n}") for n in POINTS[1::2]]
    x, y = F.col("x"), F.col("y")
    near = (x >= F.least(*xs)) & (x <= F.greatest(*xs)) & (y >= F.least(*ys)) & (y <= F.greatest(*ys))
    crossings, edge = F.lit(0), F.lit(False)
    for k in range(4):
        ax, ay, bx, by = xs[k], ys[k], xs[(k + 1) % 4], ys[(k + 1) % 4]
        on = (x >= F.least(ax, bx)) & (x <= F.greatest(ax, bx)) & (y >= F.least(ay, by)) & (y <= F.greatest(ay, by))
        edge = edge | (on & ((bx - ax) * (y - ay) == (by - ay) * (x - ax)))
        at = (bx - ax) * (y - ay) / F.when(by != ay, by - ay) + ax
        crossings = crossings + F.when(((ay > y) != (by > y)) & (at > x), 1).otherwise(0)
    inside = pixels.join(placed, page).filter(near).filter(edge | (crossings % 2 == 1))
    scores = inside.groupBy(page, "quad").agg(F.avg("p").alias("score"))
    return quads.select(page, "quad").join(scores, [page, "quad"], "left").select(page, "quad", F.coalesce("score", F.lit(0.0)).alias("score"))


def threshold_map(probability: np.ndarray, threshold: float = 0.2) -> np.ndarray:
    if not np.isfinite(probability).all():
        raise ValueError("probability map holds a value that is not finite")
    return probability > np.float32(threshold)


def dilate(bitmap: np.ndarray) -> np.ndarray:
    padded = np.pad(bitmap, ((0, 1), (0, 1)))
    return padded[:-1, :-1] | padded[:-1, 1:] | padded[1:, :-1] | padded[1:, 1:]


def boundary(bitmap: np.ndarray) -> np.ndarray:
    """On pixels at the edge of the map or with an off neighbour among eight."""
    padded = np.pad(bitmap, 1)
    h, w = bitmap.shape
    inner = np.ones_like(bitmap)
    for dy in range(3):
        for dx in range(3):
            inner &= padded[dy : dy + h, dx : dx + w]
    return bitmap & ~inner


def label_regions(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, int]:
    """Region numbers from 1 in row-major order of each region's first pixel; 0 where the mask is off.

    Runs of each row are joined to touching runs of the row above by union-find.
    """
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    change = np.diff(padded, axis=1)
    rows, starts = np.nonzero(change == 1)
    _, ends = np.nonzero(change == -1)
    parent = np.arange(len(rows))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(rows, np.arange(h + 1))
    reach = 1 if diagonal else 0
    for y in range(1, h):
        above, above_end = first[y - 1], first[y]
        for i in range(first[y], first[y + 1]):
            while above < above_end and ends[above] + reach <= starts[i]:
                above += 1
            j = above
            while j < above_end and starts[j] < ends[i] + reach:
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                j += 1
    labels, numbers = np.zeros((h, w), np.int32), {}
    for i in range(len(rows)):
        labels[rows[i], starts[i] : ends[i]] = numbers.setdefault(root(i), len(numbers) + 1)
    return labels, len(numbers)


def foreground_contours(bitmap: np.ndarray) -> list[np.ndarray]:
    """For each 8-connected region, in row-major order of its first pixel, its boundary pixels as (x, y)."""
    labels, n = label_regions(bitmap, diagonal=True)
    return _grouped(labels, boundary(bitmap), n)


def _grouped(labels: np.ndarray, chosen: np.ndarray, n: int) -> list[np.ndarray]:
    ys, xs = np.nonzero(chosen)
    own = labels[ys, xs]
    order = np.argsort(own, kind="stable")
    cuts = np.searchsorted(own[order], np.arange(1, n + 2))
    return [np.stack([xs[order[a:b]], ys[order[a:b]]], 1) for a, b in zip(cuts[:-1], cuts[1:])]


def hole_contours(bitmap: np.ndarray) -> list[np.ndarray]:
    """For each 4-connected background region that doesn't touch the edge of the map, its entries (x, y).

    A background pixel is entered once for each of its four neighbours that is on.
    """
    labels, n = label_regions(~bitmap, diagonal=False)
    outer = set(np.concatenate([labels[0], labels[-1], labels[:, 0], labels[:, -1]]).tolist()) if bitmap.size else set()
    padded = np.pad(bitmap, 1).astype(np.int8)
    sides = padded[:-2, 1:-1] + padded[2:, 1:-1] + padded[1:-1, :-2] + padded[1:-1, 2:]
    ys, xs = np.nonzero((labels > 0) & (sides > 0))
    times = sides[ys, xs]
    own, entries = np.repeat(labels[ys, xs], times), np.repeat(np.stack([xs, ys], 1), times, axis=0)
    order = np.argsort(own, kind="stable")
    cuts = np.searchsorted(own[order], np.arange(1, n + 2))
    return [entries[order[a:b]] for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]), 1) if k not in outer]


def polygon_score(probability: np.ndarray, polygon: np.ndarray) -> float:
    """Mean probability of the pixels inside or on a polygon whose corners are cut to whole numbers; 0 if there are none."""
    h, w = probability.shape
    low = np.clip(np.floor(polygon.min(0)), 0, [w - 1, h - 1]).astype(int)
    high = np.clip(np.ceil(polygon.max(0)), 0, [w - 1, h - 1]).astype(int)
    corners = polygon.astype(np.int64) - low  # towards zero, then moved
    xs, ys = np.meshgrid(np.arange(high[0] - low[0] + 1), np.arange(high[1] - low[1] + 1))
    odd, edge = np.zeros(xs.shape, bool), np.zeros(xs.shape, bool)
    for (ax, ay), (bx, by) in zip(corners, np.roll(corners, -1, 0)):
        between_y = (np.minimum(ay, by) <= ys) & (ys <= np.maximum(ay, by))
        between_x = (np.minimum(ax, bx) <= xs) & (xs <= np.maximum(ax, bx))
        edge |= between_x & between_y & ((bx - ax) * (ys - ay) == (by - ay) * (xs - ax))
        if ay != by:
            crossing = (ay > ys) != (by > ys)
            at = np.float32(bx - ax) * (ys - ay) / np.float32(by - ay) + np.float32(ax)
            odd ^= crossing & (at > xs)
    inside = odd | edge
    values = probability[low[1] : high[1] + 1, low[0] : high[0] + 1][inside]
    return float(np.float32(values.astype(np.float64).mean())) if len(values) else 0.0
