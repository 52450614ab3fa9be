"""Sizes: detector input, line widths, crops, strides, worker counts. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes a pixel by format (0 BGR24, 1 RGB24, 2 BGRA32, 3 RGBA32).
BYTES = {0: 3, 1: 3, 2: 4, 3: 4}
MAX_IMAGE_PIXELS, MAX_CROP_PIXELS = 40_000_000, 16_000_000


def _int(x: Column) -> Column:
    return x.cast("int")


def bytes_per_pixel(pixel_format: Column) -> Column:
    return F.when(pixel_format.isin(0, 1), 3).when(pixel_format.isin(2, 3), 4).otherwise(F.raise_error(F.lit("unknown pixel format")).cast("int"))


def swaps_red_blue(pixel_format: Column) -> Column:
    return pixel_format.isin(1, 3)


def stride(given: Column, width: Column, pixel_format: Column) -> Column:
    """0 means packed; a stride shorter than a row is an error."""
    row = width * bytes_per_pixel(pixel_format)
    return F.when(given == 0, row).when(given >= row, given).otherwise(F.raise_error(F.lit("stride is shorter than a row")).cast("int"))


def fits_buffer(length: Column, stride_: Column, width: Column, height: Column, pixel_format: Column) -> Column:
    """Whether a buffer of that length holds the last row too."""
    row = (width * bytes_per_pixel(pixel_format)).cast("long")
    return (stride_ >= row) & ((height - 1).cast("long") * stride_ + row <= length)


def detector_size(width: Column, height: Column, limit: int = 960) -> tuple[Column, Column]:
    """Input size of the detector: at most ``limit`` on the longer side, multiples of 32, at least 32."""
    tiny = width + height < 64
    w, h = F.when(tiny, F.greatest(width, F.lit(32))).otherwise(width), F.when(tiny, F.greatest(height, F.lit(32))).otherwise(height)
    ratio = F.least(F.lit(1.0), F.lit(float(limit)) / F.greatest(w, h))
    side = lambda v: _int(F.greatest(F.lit(32), F.floor(F.floor(v * ratio) / 32 + 0.5) * 32))
    return side(w), side(h)


def _ceil_div(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b)


def natural_width(width: Column, height: Column, line: int = 48) -> Column:
    """Width of a line scaled to ``line`` pixels of height."""
    return _int(F.ceil(width * float(line) / F.greatest(F.lit(1), height)))


def recogniser_target(width: Column, height: Column, adaptive: bool = True, fixed: int = 320) -> Column:
    """Tensor width: the natural width rounded up to 32, 32 at least, or the fixed one."""
    if not adaptive:
        return F.lit(fixed)
    return _int(F.greatest(F.lit(32), _ceil_div(natural_width(width, height), F.lit(32)) * 32))


def recogniser_width(width: Column, height: Column, target: Column) -> Column:
    return F.least(target, natural_width(width, height))


def classifier_window(width: Column, height: Column) -> Column:
    """Pixels of width the classifier looks at: no more than four times the height."""
    return F.least(width, height * 4)


def classifier_width(width: Column, height: Column) -> Column:
    return _int(F.least(F.lit(160), F.ceil(classifier_window(width, height) * 80.0 / height)))


def orientation_size(width: Column, height: Column, side: int = 256, crop: int = 224) -> dict[str, Column]:
    """Scaled size (shorter side 256, half to even) and where the centre crop begins."""
    scale = F.lit(float(side)) / F.least(width, height)
    w, h = _int(F.rint(width * scale)), _int(F.rint(height * scale))
    return {"scaled_width": w, "scaled_height": h, "left": _int(F.floor((w - crop) / 2)), "top": _int(F.floor((h - crop) / 2))}


def rotated_size(width: Column, height: Column, degrees: Column) -> tuple[Column, Column]:
    turned = degrees.isin(90, 270)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def line_workers(asked: Column, cpus: Column) -> Column:
    return F.least(F.least(F.when(asked > 0, asked).otherwise(F.least(cpus, F.lit(4))), cpus), F.lit(16))


def crop_workers(lines: Column, cpus: Column) -> Column:
    return F.greatest(lines, F.least(cpus, F.lit(16)))


def recogniser_threads(cpus: Column, workers: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(8), _int(F.floor(cpus / workers))))


def line_budget(base: Column, workers: Column, active: Column, most: Column) -> Column:
    return F.greatest(base, F.least(most, _int(F.floor(base * workers / active))))


def checked_pixels(width: Column, height: Column, most: int = MAX_IMAGE_PIXELS) -> Column:
    area = width.cast("long") * height
    return F.when(area <= most, area).otherwise(F.raise_error(F.lit(f"more than {most} pixels")).cast("long"))


def drawn_degrees(degrees: Column) -> Column:
    """What the line classifier should say of a line drawn at that angle."""
    return F.when(degrees.isin(0, 90), F.when(degrees == 90, 180).otherwise(0)).when(degrees.isin(180, -180), 180).when(degrees.isin(-90, 270), 0).otherwise(F.raise_error(F.lit("unknown angle")).cast("int"))
