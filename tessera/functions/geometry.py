"""Extents, planes, triangles and texts of point-cloud tools, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def within(x: Column, y: Column, box: tuple[float, float, float, float], slack: float = 0.005) -> Column:
    """Inside an extent (min x, min y, max x, max y) that is wider by a tolerance on every side."""
    return x.between(box[0] - slack, box[2] + slack) & y.between(box[1] - slack, box[3] + slack)


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def unit(a: Vector) -> Vector:
    """A vector of length 1; null where the length is 0."""
    length = F.sqrt(dot(a, a))
    return tuple(F.when(length > 0, v / length) for v in a)


def plane(a: Vector, b: Vector, c: Vector, upright: bool = True) -> tuple[Vector, Vector]:
    """The centroid and unit normal of the plane through three points, the normal upward if wanted; null for points in a line."""
    centre = tuple((p + q + r) / 3 for p, q, r in zip(a, b, c, strict=True))
    normal = unit(cross(minus(b, a), minus(c, a)))
    return centre, (tuple(F.when(normal[2] < 0, -v).otherwise(v) for v in normal) if upright else normal)


def plane_distance(point: Vector, centre: Vector, normal: Vector) -> Column:
    """Signed: positive on the side that the normal points to."""
    return dot(normal, minus(point, centre))


def z_on_plane(x: Column, y: Column, centre: Vector, normal: Vector) -> Column:
    """The height of the plane at a place; null for a vertical one."""
    return F.when(normal[2] != 0, centre[2] - (normal[0] * (x - centre[0]) + normal[1] * (y - centre[1])) / normal[2])


def turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Twice the signed area of a triangle: positive if it turns left."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def in_triangle(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Inside or on the edge of a triangle, whichever way it turns."""
    (ax, ay), (bx, by), (cx, cy) = [(F.lit(p), F.lit(q)) for p, q in corners]
    sides = [turn(ax, ay, bx, by, x, y), turn(bx, by, cx, cy, x, y), turn(cx, cy, ax, ay, x, y)]
    return (F.greatest(*sides) <= 0) | (F.least(*sides) >= 0)


def in_circle(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Inside the circle through three corners that turn left."""
    rows = [(F.lit(px) - x, F.lit(py) - y) for px, py in corners]
    (ax, ay), (bx, by), (cx, cy) = rows
    a, b, c = (px * px + py * py for px, py in rows)
    return ax * (by * c - b * cy) - ay * (bx * c - b * cx) + a * (bx * cy - by * cx) > 0


def convex(corners: list[tuple[float, float]]) -> bool:
    """Whether a polygon has three corners or more and goes back and forth at most once along each axis."""
    if len(corners) < 3:
        return False
    for axis in (0, 1):
        steps = [b[axis] - a[axis] for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]
        signs = [s > 0 for s in steps if s]
        if sum(p != q for p, q in zip(signs, signs[1:] + signs[:1], strict=True)) > 2:
            return False
    return True


def byte_size(n: Column, units: tuple[str, ...] = ("KB", "MB", "GB", "TB")) -> Column:
    """A size in bytes as text, with two decimals from the first of the units on; what is beyond the last one is told in it."""
    text = F.concat(n.cast("string"), F.lit(" B"))
    for power, name in enumerate(units, 1):
        text = F.when(n >= 1024**power, F.concat((n / float(1024**power)).cast("decimal(20,2)").cast("string"), F.lit(f" {name}"))).otherwise(text)
    return text


def safe_base64(raw: Column) -> Column:
    return F.translate(F.base64(raw), "+/", "-_")


def plus(a: Vector, b: Vector) -> Vector:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def times(a: Vector, b: Vector | Column | float) -> Vector:
    """A vector by a scalar, or by another one component by component."""
    return tuple(p * q for p, q in zip(a, b if isinstance(b, tuple) else (b,) * len(a), strict=True))


def over(a: Vector, b: Vector | Column | float) -> Vector:
    """A vector divided by a scalar or a vector; null where that is 0."""
    return tuple(F.try_divide(p, q if isinstance(q, Column) else F.lit(q)) for p, q in zip(a, b if isinstance(b, tuple) else (b,) * len(a), strict=True))


# Cross products this small are 0, squared distances this small are coincident, extents of circles are wider by this.
SNAP, COINCIDENT, BOUND = 1e-12, 1e-5, 0.005


def snapped_turn(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The cross product of a - p and b - p; 0 where it is too small to tell its sign."""
    found = (ax - px) * (by - py) - (bx - px) * (ay - py)
    return F.when(F.abs(found) >= SNAP, found).otherwise(F.lit(0.0))


def coincident(x: Column, y: Column, corners: list[tuple[Column, Column]]) -> Column:
    """Whether a place is, but for rounding, one of some corners."""
    return F.least(*[(cx - x) * (cx - x) + (cy - y) * (cy - y) for cx, cy in corners]) <= COINCIDENT


def circle_extent(corners: list[tuple[Column, Column]]) -> tuple[Column, Column, Column, Column]:
    """min x, min y, max x, max y of the circle through three corners, a little wider; about their centroid where they lie in a line."""
    (ax, ay), (bx, by), (cx, cy) = corners
    dx1, dy1, dx2, dy2 = bx - ax, by - ay, cx - ax, cy - ay
    twice = 2 * (dx1 * dy2 - dy1 * dx2)
    one, two = dx1 * dx1 + dy1 * dy1, dx2 * dx2 + dy2 * dy2
    ux, uy = F.try_divide(dy2 * one - dy1 * two, twice), F.try_divide(dx1 * two - dx2 * one, twice)
    x, y = F.coalesce(ax + ux, (ax + bx + cx) / 3), F.coalesce(ay + uy, (ay + by + cy) / 3)
    reach = F.coalesce(F.sqrt(ux * ux + uy * uy), F.lit(0.0)) + BOUND
    return x - reach, y - reach, x + reach, y + reach


def triangle_within(corners: list[tuple[Column, Column]], box: tuple) -> Column:
    """All corners in a closed extent (min x, min y, max x, max y)."""
    return (F.least(*[x for x, _ in corners]) >= box[0]) & (F.least(*[y for _, y in corners]) >= box[1]) & (F.greatest(*[x for x, _ in corners]) <= box[2]) & (F.greatest(*[y for _, y in corners]) <= box[3])


def triangle_overlaps(corners: list[tuple[Column, Column]], box: tuple) -> Column:
    """Whether a triangle may share a place with an extent: no side has the whole extent on its outer side. Corners in either turn."""
    (ax, ay), (bx, by), (cx, cy) = corners
    left = F.signum(turn(ax, ay, bx, by, cx, cy))
    ends = [(F.lit(float(box[i])), F.lit(float(box[j]))) for i in (0, 2) for j in (1, 3)]
    sides = [F.greatest(*[left * turn(px, py, qx, qy, ex, ey) for ex, ey in ends]) >= 0 for (px, py), (qx, qy) in zip(corners, corners[1:] + corners[:1], strict=True)]
    return triangle_within(corners, box) | (sides[0] & sides[1] & sides[2])


def near_plane(point: Vector, corners: list[Vector], most: float) -> Column:
    """Whether a point is at most so far from the plane of a triangle."""
    centre, normal = plane(*corners)
    return F.abs(plane_distance(point, centre, normal)) <= most


def in_square(x: Column, y: Column, low_x: Column, low_y: Column, side: Column) -> Column:
    """In a square that is open at its upper sides, as a node of a quadtree is."""
    return (x >= low_x) & (y >= low_y) & (x < low_x + side) & (y < low_y + side)


def texture_coordinates(x: Column, y: Column, box: tuple[Column, Column, Column, Column]) -> tuple[Column, Column]:
    """The place in an extent (min x, min y, max x, max y) as shares of its sides."""
    return F.try_divide(x - box[0], box[2] - box[0]), F.try_divide(y - box[1], box[3] - box[1])


def height_coordinate(z: Column, low: Column, high: Column) -> Column:
    """The place of a height in a texture of the whole range."""
    return (z - low) * F.try_divide(F.lit(1.0), high - low)


def ratio_to_centre(qx: Column, qy: Column, centre_x: Column, centre_y: Column, cell_x: Column, cell_y: Column) -> Column:
    """The squared distance from a cell's centre, each axis as a share of the cell's size."""
    dx, dy = (qx - centre_x) / cell_x, (qy - centre_y) / cell_y
    return dx * dx + dy * dy


def convex_corners(xs: Column, ys: Column) -> Column:
    """`convex` for polygons in rows: arrays of their corners' coordinates, in order."""
    def changes(values: Column) -> Column:
        steps = F.transform(values, lambda v, i: F.signum((F.get(values, (i + 1) % F.size(values)) - v).cast("double")))
        moves = F.filter(steps, lambda s: s != 0)
        turned = F.transform(moves, lambda s, i: (F.get(moves, (i + 1) % F.size(moves)) != s).cast("int"))
        return F.aggregate(turned, F.lit(0), lambda t, v: t + v)

    return (F.size(xs) >= 3) & (changes(xs) <= 2) & (changes(ys) <= 2)
