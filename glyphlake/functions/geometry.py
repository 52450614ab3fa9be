"""Quadrilaterals x1, y1 ... x4, y4 (top left, top right, bottom right, bottom left) as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a skew or determinant must exceed to count.
EPSILON = 1e-12
POINTS = ("x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4")


def points(quad: list[Column]) -> list[tuple[Column, Column]]:
    return list(zip(quad[::2], quad[1::2]))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))


def cross(o: tuple[Column, Column], a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def aabb(quad: list[Column]) -> list[Column]:
    """Smallest and largest x and y: min_x, min_y, max_x, max_y."""
    return [F.least(*quad[::2]), F.least(*quad[1::2]), F.greatest(*quad[::2]), F.greatest(*quad[1::2])]


def iou(a: list[Column], b: list[Column]) -> Column:
    """Overlap of two axis-aligned boxes over their union; 0 if they don't overlap."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(w * h / (area(a) + area(b) - w * h))


def signed_area(quad: list[Column]) -> Column:
    p = points(quad)
    return sum((a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])), F.lit(0.0)) / 2


def perimeter(quad: list[Column]) -> Column:
    p = points(quad)
    return sum((distance(a, b) for a, b in zip(p, p[1:] + p[:1])), F.lit(0.0))


def unclip_distance(quad: list[Column], ratio: float = 1.4) -> Column:
    return F.abs(signed_area(quad)) * ratio / perimeter(quad)


def is_positive_convex(quad: list[Column]) -> Column:
    """All four turns are to the same, positive side."""
    p = points(quad)
    out = F.lit(True)
    for i in range(4):
        out = out & (cross(p[i], p[(i + 1) % 4], p[(i + 2) % 4]) > 0)
    return out


def point_in_quad(x: Column, y: Column, quad: list[Column]) -> Column:
    """Inside or on an edge: no two edges see the point on different sides."""
    p = points(quad)
    turns = [cross(a, b, (x, y)) for a, b in zip(p, p[1:] + p[:1])]
    return ~((F.greatest(*turns) > 0) & (F.least(*turns) < 0))


def to_source(x: Column, y: Column, width: Column, height: Column, degrees: Column) -> tuple[Column, Column]:
    """A point of a page turned counter-clockwise by degrees, on the page of width and height as it was."""
    sx = F.when(degrees == 90, width - 1 - y).when(degrees == 180, width - 1 - x).when(degrees == 270, y).otherwise(x)
    sy = F.when(degrees == 90, x).when(degrees == 180, height - 1 - y).when(degrees == 270, height - 1 - x).otherwise(y)
    return sx, sy


def order_clockwise(quad: list[Column]) -> list[Column]:
    """Corners as top left, top right, bottom right, bottom left.

    Top left has the least x + y and bottom right the most; of the other two the
    smaller y - x is top right. If a corner would be taken twice or the order
    crosses itself (squares on their tip), corners go by angle around their
    centre, from the least x + y, then y, then x.
    """
    p = points(quad)
    numbered = F.array(*(F.struct(F.lit(i).alias("i"), x.alias("x"), y.alias("y"), (x + y).alias("s"), (y - x).alias("d")) for i, (x, y) in enumerate(p)))
    pick = lambda a, key, last=False: F.element_at(F.array_sort(F.transform(a, lambda v: F.struct((-v[key] if last else v[key]).alias("k"), v["i"].alias("i"), v["x"].alias("x"), v["y"].alias("y"), v["d"].alias("d")))), 1)
    tl, br = pick(numbered, "s"), pick(numbered, "s", last=True)
    rest = F.array_sort(F.transform(F.filter(numbered, lambda v: (v["i"] != tl["i"]) & (v["i"] != br["i"])), lambda v: F.struct(v["d"].alias("d"), (-v["i"]).alias("i"), v["x"].alias("x"), v["y"].alias("y"))))
    simple = [(c["x"], c["y"]) for c in (tl, F.get(rest, F.lit(0)), br, F.get(rest, F.lit(1)))]
    fine = is_positive_convex([v for c in simple for v in c])
    cx, cy = sum((x for x, _ in p), F.lit(0.0)) / 4, sum((y for _, y in p), F.lit(0.0)) / 4
    turned = F.array_sort(F.transform(numbered, lambda v: F.struct(F.atan2(v["y"] - cy, v["x"] - cx).alias("a"), v["i"].alias("i"), v["x"].alias("x"), v["y"].alias("y"), v["s"].alias("s"))))
    first = F.element_at(F.array_sort(F.transform(turned, lambda v, k: F.struct(v["s"].alias("s"), v["y"].alias("y"), v["x"].alias("x"), k.alias("k")))), 1)["k"]
    out = []
    for k in range(4):
        at = F.get(turned, F.pmod(first + k, F.lit(4)))
        out += [F.when(fine, simple[k][0]).otherwise(at["x"]), F.when(fine, simple[k][1]).otherwise(at["y"])]
    return out


def quad_frame(quad: list[Column]) -> dict[str, Column]:
    """Centre, length of the longer edge, of the other, and the longer one's angle in degrees."""
    p = points(quad)
    across, down = distance(p[0], p[1]), distance(p[0], p[3])
    long = across >= down
    dx = F.when(long, p[1][0] - p[0][0]).otherwise(p[3][0] - p[0][0])
    dy = F.when(long, p[1][1] - p[0][1]).otherwise(p[3][1] - p[0][1])
    return {
        "center_x": sum((x for x, _ in p), F.lit(0.0)) / 4,
        "center_y": sum((y for _, y in p), F.lit(0.0)) / 4,
        "long_edge": F.greatest(across, down),
        "short_edge": F.least(across, down),
        "angle": F.degrees(F.atan2(dy, dx)),
    }


@dataclass
class Perspective:
    """Crop size and the map from the unit square to the quad; ``valid`` tells whether it exists."""

    width: Column
    height: Column
    vertical: Column
    valid: Column
    a: Column
    b: Column
    c: Column
    d: Column
    e: Column
    f: Column
    g: Column
    h: Column

    @classmethod
    def of(cls, quad: list[Column]) -> Perspective:
        """The unit square's corners go to the quad's.

        With corner weights 1, 1 + g, 1 + g + h, 1 + h, the third corner's
        image gives g (p1 - p2) + h (p3 - p2) = p0 - p1 + p2 - p3, two equations
        solved by Cramer's rule. A parallelogram has no right side, and g and h
        are zero, whatever the determinant.
        """
        p = points(quad)
        width = F.floor(F.greatest(distance(p[0], p[1]), distance(p[2], p[3])))
        height = F.floor(F.greatest(distance(p[0], p[3]), distance(p[1], p[2])))
        towards = [tuple(p[k][i] - p[2][i] for i in (0, 1)) for k in (1, 3)]
        skew = tuple(p[0][i] - p[1][i] + p[2][i] - p[3][i] for i in (0, 1))
        det = lambda u, v: u[0] * v[1] - v[0] * u[1]
        flat = (F.abs(skew[0]) <= EPSILON) & (F.abs(skew[1]) <= EPSILON)
        whole = F.when(F.abs(det(*towards)) > EPSILON, det(*towards))
        g = F.when(flat, 0.0).otherwise(det(skew, towards[1]) / whole)
        h = F.when(flat, 0.0).otherwise(det(towards[0], skew) / whole)
        valid = (width >= 1) & (height >= 1) & g.isNotNull()
        rows = [c for i in (0, 1) for c in (p[1][i] - p[0][i] + g * p[1][i], p[3][i] - p[0][i] + h * p[3][i], p[0][i])]
        return cls(width.cast("int"), height.cast("int"), height >= 1.5 * width, valid, *rows, g, h)

    def size(self) -> tuple[Column, Column]:
        """Width and height of the crop, which stands upright quads on their side."""
        return F.when(self.vertical, self.height).otherwise(self.width), F.when(self.vertical, self.width).otherwise(self.height)

    def map(self, u: Column, v: Column) -> tuple[Column, Column]:
        below = self.g * u + self.h * v + 1.0
        return (self.a * u + self.b * v + self.c) / below, (self.d * u + self.e * v + self.f) / below

    def span(self, t0: Column, t1: Column) -> list[Column]:
        """The quad of the part of a line from t0 to t1 (0 to 1)."""
        flat = [(t0, F.lit(0.0)), (t1, F.lit(0.0)), (t1, F.lit(1.0)), (t0, F.lit(1.0))]
        tall = [(F.lit(0.0), 1 - t0), (F.lit(0.0), 1 - t1), (F.lit(1.0), 1 - t1), (F.lit(1.0), 1 - t0)]
        out = []
        for (u, v), (s, t) in zip(flat, tall):
            out += self.map(F.when(self.vertical, s).otherwise(u), F.when(self.vertical, t).otherwise(v))
        return out


def to_map(value: Column, from_size: Column, to_size: Column) -> Column:
    """A detector coordinate on the source: half to even, clipped to [0, size]."""
    return F.greatest(F.lit(0.0), F.least(to_size.cast("double"), F.rint(value / from_size * to_size)))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def color_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0)))


def contrast_ink(r: Column, g: Column, b: Column) -> Column:
    """Dark ink over a light background, light ink over a dark one."""
    return F.when(luma(r, g, b) > 140, F.lit("17,17,17")).otherwise(F.lit("245,245,247"))
