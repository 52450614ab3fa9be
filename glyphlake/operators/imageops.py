"""Pixels of one page or line in numpy, and the row-wise operators over them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from glyphlake.functions.geometry import EPSILON
from glyphlake.functions.sizing import MAX_CROP_PIXELS, MAX_IMAGE_PIXELS

#: Means and deviations by channel in the order B, G, R of the detector and R, G, B of the page classifier.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def pixels(data: bytes, width: int, height: int, stride: int = 0, pixel_format: int = 0) -> np.ndarray:
    """(height, width, 3) in B, G, R from packed or padded rows; alpha is left out."""
    if width * height > MAX_IMAGE_PIXELS:
        raise ValueError(f"a page of more than {MAX_IMAGE_PIXELS} pixels")
    channels = 3 if pixel_format in (0, 1) else 4
    row = width * channels
    stride = stride or row
    if stride < row or (height - 1) * stride + row > len(data):
        raise ValueError("buffer or stride too small")
    flat = np.frombuffer(data, np.uint8)
    rows = np.lib.stride_tricks.as_strided(flat, (height, row), (stride, 1)).reshape(height, width, channels)[:, :, :3]
    return np.ascontiguousarray(rows[:, :, ::-1] if pixel_format in (1, 3) else rows)


def rotate(image: np.ndarray, degrees: int) -> np.ndarray:
    """Counter-clockwise by whole quarter turns."""
    if degrees not in (0, 90, 180, 270):
        raise ValueError("pages turn by quarters")
    return np.ascontiguousarray(np.rot90(image, degrees // 90))


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, half-pixel centres, edges repeated; weights of 11 bits, and the two rows of a sum cut to 4 and 16 bits."""
    h, w = image.shape[:2]

    def taps(n, size):
        at = ((np.arange(n) + 0.5) * (size / n) - 0.5).astype(np.float32)
        low = np.floor(at).astype(int)
        share = at - low.astype(np.float32)
        share = np.where((low < 0) | (low >= size - 1), np.float32(0), share)
        low = np.clip(low, 0, size - 1)
        weight = lambda x: np.rint(x * np.float32(2048)).astype(np.int64)
        return low, np.minimum(low + 1, size - 1), weight(np.float32(1) - share), weight(share)

    x0, x1, a0, a1 = taps(width, w)
    y0, y1, b0, b1 = taps(height, h)
    wide = (image[:, x0].astype(np.int64) * a0[None, :, None] + image[:, x1].astype(np.int64) * a1[None, :, None]) >> 4
    total = (wide[y0] * b0[:, None, None] >> 16) + (wide[y1] * b1[:, None, None] >> 16)
    return np.clip((total + 2) >> 2, 0, 255).astype(np.uint8)


def planar(image: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(image.transpose(2, 0, 1))


def detector_input(image: np.ndarray, limit: int = 960) -> np.ndarray:
    """(3, H, W) floats: tiny pages padded with zeros, sides multiples of 32, channels normalised in B, G, R order."""
    h, w = image.shape[:2]
    if w + h < 64:
        image = np.pad(image, ((0, max(0, 32 - h)), (0, max(0, 32 - w)), (0, 0)))
        h, w = image.shape[:2]
    ratio = min(1.0, limit / max(h, w))
    side = lambda v: max(32, int(np.floor(int(v * ratio) / 32 + 0.5)) * 32)
    scaled = resize(image, side(w), side(h)).astype(np.float32) / 255
    return planar((scaled - np.float32(MEAN)) / np.float32(DEVIATION))


def line_input(image: np.ndarray, height: int, width: int, target: int, pad: float) -> np.ndarray:
    """(3, height, target) floats from -1 to 1, the rest ``pad``."""
    out = np.full((3, height, target), pad, np.float32)
    out[:, :, :width] = planar(resize(image, width, height).astype(np.float32) * np.float32(2 / 255) - 1)
    return out


def classifier_input(image: np.ndarray) -> np.ndarray:
    h, w = image.shape[:2]
    image = image[:, : min(w, 4 * h)]
    return line_input(image, 80, min(160, int(np.ceil(image.shape[1] * 80 / h))), 160, -1.0)


def recogniser_input(image: np.ndarray, target: int) -> np.ndarray:
    h, w = image.shape[:2]
    return line_input(image, 48, min(target, int(np.ceil(w * 48 / max(1, h)))), target, 0.0)


def orientation_input(image: np.ndarray) -> np.ndarray:
    """(3, 224, 224): shorter side 256 (half to even), centre crop, R, G, B normalised."""
    h, w = image.shape[:2]
    scale = 256 / min(h, w)
    scaled = resize(image, int(np.rint(w * scale)), int(np.rint(h * scale)))
    top, left = (scaled.shape[0] - 224) // 2, (scaled.shape[1] - 224) // 2
    rgb = scaled[top : top + 224, left : left + 224, ::-1].astype(np.float32)
    alpha = (1 / (255 * np.float64(DEVIATION))).astype(np.float32)
    beta = (-np.float64(MEAN) / np.float64(DEVIATION)).astype(np.float32)
    return planar(rgb * alpha + beta)


def perspective(quad) -> tuple[int, int, bool, np.ndarray]:
    """Width, height, whether the crop stands upright, and the matrix from the unit square to the quad."""
    q = np.asarray(quad, np.float64).reshape(4, 2)
    side = lambda i, j: float(np.hypot(*(q[i] - q[j])))
    width, height = int(max(side(0, 1), side(2, 3))), int(max(side(0, 3), side(1, 2)))
    skew = q[0] - q[1] + q[2] - q[3]
    system = np.stack([q[1] - q[2], q[3] - q[2]], 1)
    flat = (np.abs(skew) <= EPSILON).all()  # a parallelogram, also one without area
    if not np.isfinite(q).all() or width < 1 or height < 1 or not flat and abs(np.linalg.det(system)) <= EPSILON:
        raise ValueError("invalid quadrilateral")
    g, h = (0.0, 0.0) if flat else np.linalg.solve(system, skew)
    return width, height, height >= 1.5 * width, np.vstack([np.stack([q[1] - q[0] + g * q[1], q[3] - q[0] + h * q[3], q[0]], 1), [g, h, 1.0]])


def _cubic(t: np.ndarray) -> list[np.ndarray]:
    """Weights of the taps -1, 0, 1, 2 around a fraction t, a = -0.75."""
    a = -0.75
    near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    return [far(t + 1), near(t), near(1 - t), far(2 - t)]


def crop(image: np.ndarray, quad, rows: tuple[int, int] | None = None) -> np.ndarray:
    """The quad as an upright image by bicubic sampling; quads taller than 1.5 widths are laid on their side.

    ``rows`` gives a band of the crop as it is sampled, for work in parts.
    """
    width, height, vertical, m = perspective(quad)
    if width * height > MAX_CROP_PIXELS:
        raise ValueError(f"a crop of more than {MAX_CROP_PIXELS} pixels")
    first, last = rows or (0, height)
    u, v = np.meshgrid(np.arange(width) / width, np.arange(first, last) / height)
    below = m[2, 0] * u + m[2, 1] * v + 1
    sx, sy = (m[0, 0] * u + m[0, 1] * v + m[0, 2]) / below, (m[1, 0] * u + m[1, 1] * v + m[1, 2]) / below
    x, y = np.floor(sx).astype(int), np.floor(sy).astype(int)
    wx, wy = _cubic(sx - x), _cubic(sy - y)
    out = np.zeros((*u.shape, 3))
    for j in range(4):
        yy = np.clip(y + j - 1, 0, image.shape[0] - 1)
        line = np.zeros_like(out)
        for i in range(4):
            line += wx[i][..., None] * image[yy, np.clip(x + i - 1, 0, image.shape[1] - 1)]
        out += wy[j][..., None] * line
    done = np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)
    return np.ascontiguousarray(np.rot90(done, -1)) if vertical else done


CROPS = "page long, line_no int, width int, height int, data binary"


def crop_lines(lines: DataFrame) -> DataFrame:
    """A crop for each row of (page, line_no, page_width, page_height, stride, pixel_format, data, x1..y4), where it lies."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                image = crop(pixels(r.data, r.page_width, r.page_height, r.stride, r.pixel_format), [r.x1, r.y1, r.x2, r.y2, r.x3, r.y3, r.x4, r.y4])
                rows.append((r.page, r.line_no, image.shape[1], image.shape[0], image.tobytes()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CROPS.split(", ")])

    names = ["page", "line_no", "page_width", "page_height", "stride", "pixel_format", "data", "x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4"]
    return lines.select(*names).mapInPandas(run, CROPS)


INPUTS = "page long, channels int, height int, width int, values array<float>"


def model_inputs(pages: DataFrame, prepare) -> DataFrame:
    """(page, channels, height, width, values): the tensor that ``prepare`` makes of each page's pixels, flat."""

    def run(batches):
        for pdf in batches:
            made = [prepare(pixels(r.data, r.width, r.height, r.stride, r.pixel_format)) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame({"page": pdf["page"], **{n: np.array([m.shape[i] for m in made], np.int32) for i, n in enumerate(("channels", "height", "width"))}, "values": [m.ravel() for m in made]})

    return pages.select("page", "width", "height", "stride", "pixel_format", "data").mapInPandas(run, INPUTS)
