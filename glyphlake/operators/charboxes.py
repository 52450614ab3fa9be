"""Boxes of single characters: decoded runs placed on the quad of their line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions.geometry import POINTS, Perspective


def character_boxes(spans: DataFrame, line: str = "line") -> DataFrame:
    """Adds bx1, by1 ... bx4, by4 to spans (line, span, start, end, quad x1..y4, time_steps, content_width, tensor_width, rotation).

    Neighbours share the midpoint of the blank between them; the outer edges are
    the runs' own. Columns count over the tensor's width, of which the content
    is the leading part; a line read upside down counts from its end. Spans
    that overlap or leave the line, and quads without a perspective, are errors.
    """
    order = Window.partitionBy(line).orderBy("start", "end")
    before, after = F.lag("end").over(order), F.lead("start").over(order)
    placed = spans.withColumns({"_before": before, "_after": after})
    start, end = F.col("start"), F.col("end")
    wrong = (start < 0) | (start >= F.col("time_steps")) | (end <= start) | (end > F.col("time_steps")) | (F.col("_before") > start) | ~F.col("rotation").isin(0, 180) | (F.col("content_width") <= 0) | (F.col("tensor_width") < F.col("content_width"))
    # A missing neighbour must not make the test null, and an error must not be optimised away: it is the left edge's value.
    left = F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.lit("span out of range")).cast("double")).otherwise(F.coalesce((F.col("_before") + start) / 2, start.cast("double")))
    right = F.coalesce((end + F.col("_after")) / 2, end.cast("double"))
    scale = F.col("tensor_width").cast("double") / F.col("content_width") / F.col("time_steps")
    placed = placed.withColumns({"_a": left * scale, "_b": right * scale})
    turned = F.col("rotation") == 180
    clamp = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    placed = placed.withColumns({"_t0": clamp(F.when(turned, 1 - F.col("_b")).otherwise(F.col("_a"))), "_t1": clamp(F.when(turned, 1 - F.col("_a")).otherwise(F.col("_b")))})
    transform = Perspective.of([F.col(p).cast("double") for p in POINTS])
    quad = transform.span(F.col("_t0"), F.greatest("_t0", "_t1"))
    valid = F.coalesce(transform.valid, F.lit(False))
    boxed = {f"b{p}": F.when(valid, v).otherwise(F.raise_error(F.lit("invalid quadrilateral")).cast("double")) for p, v in zip(POINTS, quad)}
    return placed.select(*spans.columns, *(v.alias(k) for k, v in boxed.items()))


def from_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """character_boxes() for lines with an array ``spans`` of (text, score, start, end); a null array is an error, an empty one gives no rows."""
    known = F.when(F.col("spans").isNull(), F.raise_error(F.lit("spans were not captured: decode with captured()")).cast("array<struct<span:int,text:string,score:double,start:int,end:int>>")).otherwise(F.col("spans"))
    rest = [c for c in lines.columns if c != "spans"]
    return character_boxes(lines.select(*rest, F.explode(known).alias("_s")).select(*rest, "_s.*"), line)
