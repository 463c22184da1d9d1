"""Delaunay triangulation of points of any number, exact, in rounds that merge cells of a quadtree.

Cells of a bounded number of points are triangulated side by side. A triangle whose circumcircle lies within its cell, whose outer
sides are open at the border of all points, has no point of another cell in its circle: it is final. Of a cell go on
only the points that still miss triangles, and the edges at which final triangles end. Four (or sixteen) cells that meet in their parent
are triangulated again, from these points alone: their triangulation holds all triangles that the parent still misses, on
the open side of those edges, and others where final triangles lie already, which are left out. So what moves up is about what lies along the
seams, and the root, open on all sides, closes the rest.

Coordinates are whole numbers, and both predicates exact. Where four points lie on a circle, heights that differ by
less than any number decide, by the order of the points, so all cells agree on one triangulation.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import written

#: Points of a cell that is triangulated first, at most, unless they lie within one cell of the finest level.
LIMIT = 8192
#: Levels of the quadtree at most, and levels that one round merges.
LEVELS, MERGED = 16, 2

Point = tuple[int, int]


def turn(a: Point, b: Point, c: Point) -> int:
    """Twice the area of a triangle, positive if it turns left."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def inside(a: Point, b: Point, c: Point, d: Point) -> bool:
    """Whether d lies in the circle through a, b and c, which turn left. On the circle the points' heights decide, raised by
    amounts of which each is beyond comparison with that of the next point in their order."""
    if d in (a, b, c):
        return False
    ax, ay, bx, by, cx, cy = a[0] - d[0], a[1] - d[1], b[0] - d[0], b[1] - d[1], c[0] - d[0], c[1] - d[1]
    found = (ax * ax + ay * ay) * (bx * cy - by * cx) + (bx * bx + by * by) * (cx * ay - cy * ax) + (cx * cx + cy * cy) * (ax * by - ay * bx)
    if found:
        return found > 0
    raised = sorted(((a, turn(d, b, c)), (b, turn(a, d, c)), (c, turn(a, b, d)), (d, -turn(a, b, c))), reverse=True)
    return next(weight for _, weight in raised if weight) > 0


class Mesh:
    """Directed edges in pairs (e and e ^ 1); `after` and `before` are the next edges around an edge's origin to the left
    and to the right."""

    def __init__(self, points: list[Point]):
        self.points, self.origin, self.after, self.before = points, [], [], []

    def edge(self, a: int, b: int) -> int:
        e = len(self.origin)
        self.origin += [a, b]
        self.after += [e, e + 1]
        self.before += [e, e + 1]
        return e

    def splice(self, a: int, b: int) -> None:
        after, before = self.after, self.before
        x, y = after[a], after[b]
        before[x], before[y] = b, a
        after[a], after[b] = y, x

    def join(self, a: int, b: int) -> int:
        """An edge from where a ends to where b begins, with the same face at its left."""
        e = self.edge(self.origin[a ^ 1], self.origin[b])
        self.splice(e, self.before[a ^ 1])
        self.splice(e ^ 1, b)
        return e

    def drop(self, e: int) -> None:
        self.splice(e, self.before[e])
        self.splice(e ^ 1, self.before[e ^ 1])
        self.origin[e] = self.origin[e ^ 1] = -1

    def at(self, e: int) -> Point:
        return self.points[self.origin[e]]

    def right(self, p: Point, e: int) -> bool:
        return turn(p, self.at(e ^ 1), self.at(e)) > 0

    def halves(self, low: int, high: int) -> tuple[int, int]:
        """Triangulates points[low:high], sorted and different; returns the hull's edge that leaves the first point with
        the outside at its right, and the one that leaves the last point with the outside at its left."""
        if high - low == 2:
            e = self.edge(low, low + 1)
            return e, e ^ 1
        if high - low == 3:
            e, f = self.edge(low, low + 1), self.edge(low + 1, low + 2)
            self.splice(e ^ 1, f)
            way = turn(*self.points[low:high])
            if way == 0:
                return e, f ^ 1
            g = self.join(f, e)
            return (e, f ^ 1) if way > 0 else (g ^ 1, g)
        middle = (low + high) // 2
        (left_out, left), (right, right_out) = self.halves(low, middle), self.halves(middle, high)
        while True:  # down to the lower common tangent
            if turn(self.at(right), self.at(left), self.at(left ^ 1)) > 0:
                left = self.before[left ^ 1]
            elif self.right(self.at(left), right):
                right = self.after[right ^ 1]
            else:
                break
        base = self.join(right ^ 1, left)
        if self.origin[left] == self.origin[left_out]:
            left_out = base ^ 1
        if self.origin[right] == self.origin[right_out]:
            right_out = base
        while True:  # and up, an edge across at a time
            one = self.candidate(base, self.after[base ^ 1], self.after)
            two = self.candidate(base, self.before[base], self.before)
            fits_one, fits_two = self.right(self.at(one ^ 1), base), self.right(self.at(two ^ 1), base)
            if not fits_one and not fits_two:
                return left_out, right_out
            if not fits_one or fits_two and inside(self.at(one ^ 1), self.at(one), self.at(two), self.at(two ^ 1)):
                base = self.join(two, base ^ 1)
            else:
                base = self.join(base ^ 1, one ^ 1)

    def candidate(self, base: int, e: int, around: list[int]) -> int:
        """The next edge beside the base, once edges that the circle test rejects are gone."""
        if self.right(self.at(e ^ 1), base):
            while inside(self.at(base ^ 1), self.at(base), self.at(e ^ 1), self.at(around[e] ^ 1)):
                following = around[e]
                self.drop(e)
                e = following
        return e


def triangulated(points: list[Point]) -> tuple[list[tuple[int, int, int]], set[int]]:
    """The triangles (turning left) of sorted different points, as their numbers, and the numbers on the hull."""
    if len(points) < 3:
        return [], set(range(len(points)))
    mesh = Mesh(points)
    mesh.halves(0, len(points))
    faces, seen, hull = [], set(), set()
    for e in range(len(mesh.origin)):
        if mesh.origin[e] < 0 or e in seen:
            continue
        ring, f = [], e
        while f not in seen:
            seen.add(f)
            ring.append(mesh.origin[f])
            f = mesh.before[f ^ 1]
        if len(ring) == 3 and turn(*(points[i] for i in ring)) > 0:
            faces.append(tuple(ring))
        else:
            hull |= set(ring)
    return faces, hull


def circle_within(a: Point, b: Point, c: Point, box: tuple[int | None, int | None, int | None, int | None]) -> bool:
    """Whether the circle through three points surely lies strictly inside a box (min x, min y, max x, max y; none is open)."""
    bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    twice = 2 * (bx * cy - by * cx)
    ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / twice, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / twice
    radius = (ux * ux + uy * uy) ** 0.5
    x, y, slack = a[0] + ux, a[1] + uy, 1e-9 * (1 + radius + abs(a[0]) + abs(a[1]))
    low = (box[0] is None or x - radius > box[0] + slack) and (box[1] is None or y - radius > box[1] + slack)
    return low and (box[2] is None or x + radius < box[2] - slack) and (box[3] is None or y + radius < box[3] - slack)


def settled(points: list[Point], border: set[tuple[int, int]], box: tuple) -> tuple[list, set[int], set[tuple[int, int]]]:
    """A cell's final triangles, the points that go on, and the edges at whose left triangles are still missing.

    `border` has those edges of earlier rounds. Triangles on their right lie where final ones do."""
    faces, hull = triangulated(points)
    left = {(f[i], f[(i + 1) % 3]): k for k, f in enumerate(faces) for i in range(3)}
    open_ = set(range(len(faces)))
    if border:
        todo = [left[e] for e in border if e in left]
        open_ = set(todo)
        while todo:
            f = faces[todo.pop()]
            for i in range(3):
                edge = f[(i + 1) % 3], f[i]
                other = left.get(edge)
                if other is not None and other not in open_ and edge not in border and edge[::-1] not in border:
                    open_.add(other)
                    todo.append(other)
    final = {k for k in open_ if circle_within(*(points[i] for i in faces[k]), box)}
    rest = open_ - final
    missing = lambda e: left.get(e) is None or left[e] in rest
    edges = {e for e in border if missing(e)}
    edges |= {e for k in final for i in range(3) if missing(e := (faces[k][(i + 1) % 3], faces[k][i]))}
    return [faces[k] for k in final], hull | {i for k in rest for i in faces[k]} | {i for e in edges for i in e}, edges


COLUMNS = ["kind", "depth", "cx", "cy", "x1", "y1", "p1", "x2", "y2", "p2", "x3", "y3", "p3"]
DDL = ", ".join(f"{c} long" for c in COLUMNS)
#: Kinds of rows: points, border edges, triangles.
POINT, EDGE, TRIANGLE = range(3)


def merge(corner: Point, side: int, most: Point):
    """For applyInArrow: the rows of a cell, of its children or points of its own, settled."""

    def run(table: pa.Table) -> pa.Table:
        rows = np.stack([table.column(c).to_numpy() for c in COLUMNS], axis=1)
        depth, cx, cy = (int(v) for v in rows[0, 1:4])
        size = side >> depth
        x, y = corner[0] + cx * size, corner[1] + cy * size
        box = (x - 1 if cx else None, y - 1 if cy else None, x + size if x + size <= most[0] else None, y + size if y + size <= most[1] else None)
        own = sorted((int(r[4]), int(r[5]), int(r[6])) for r in rows[rows[:, 0] == POINT])
        points = [p[:2] for p in own]
        number = {p: i for i, p in enumerate(points)}
        border = {(number[int(r[4]), int(r[5])], number[int(r[7]), int(r[8])]) for r in rows[rows[:, 0] == EDGE]}
        faces, kept, edges = settled(points, border, box)
        out = [(POINT, depth, cx, cy, *own[i], *[0] * 6) for i in kept] + [(EDGE, depth, cx, cy, *own[a], *own[b], 0, 0, 0) for a, b in edges]
        for f in faces:
            at = f.index(min(f))  # the first point leads
            out.append((TRIANGLE, depth, cx, cy, *own[f[at]], *own[f[at - 2]], *own[f[at - 1]]))
        made = np.array(out, np.int64).reshape(-1, len(COLUMNS))
        return pa.table([pa.array(made[:, i]) for i in range(len(COLUMNS))], COLUMNS)

    return run


def cells(points: DataFrame, corner: Point, side: int, levels: int, limit: int) -> DataFrame:
    """points (x1, y1, p1) with the cell each is triangulated in first: the largest of at most `limit` points."""
    shift = side.bit_length() - 1 - levels
    at = lambda name, low: F.shiftright(F.col(name) - F.lit(low), shift)
    placed = points.select("*", at("x1", corner[0]).alias("fx"), at("y1", corner[1]).alias("fy"))
    finest = placed.groupBy("fx", "fy").agg(F.count("*").alias("n"))
    depth = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("depth")
    up = lambda c: F.call_function("shiftright", F.col(c), F.lit(levels) - F.col("depth"))
    spread = finest.select("fx", "fy", "n", depth).withColumns({"cx": up("fx"), "cy": up("fy")})
    nodes = spread.groupBy("depth", "cx", "cy").agg(F.sum("n").alias("all"))
    fitting = spread.join(nodes, ["depth", "cx", "cy"]).where((F.col("all") <= limit) | (F.col("depth") == levels))
    first = fitting.groupBy("fx", "fy").agg(F.min("depth").alias("depth"))
    found = placed.join(first, ["fx", "fy"])
    return found.select(F.lit(POINT).cast("long").alias("kind"), F.col("depth").cast("long").alias("depth"), up("fx").alias("cx"), up("fy").alias("cy"), "x1", "y1", "p1", *[F.lit(0).cast("long").alias(c) for c in COLUMNS[7:]])


def delaunay(points: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b, c, ax, ay, bx, by, cx, cy): the triangles of points (point_id, qx, qy), turning left, the corner that is first by x and y ahead.

    Points at one place are one, with their smallest point_id; rows with a null coordinate are left out. Fewer than three points, or
    points in a line, have no triangles. A task holds `limit` points, or what its children still miss triangles
    around: points along seams and on the hull.
    """
    places = points.where(F.col("qx").isNotNull() & F.col("qy").isNotNull()).groupBy(F.col("qx").cast("long").alias("x1"), F.col("qy").cast("long").alias("y1")).agg(F.min("point_id").cast("long").alias("p1"))
    places = written(places.fillna(-1, ["p1"]), "places")
    facts = places.agg(F.min("x1"), F.min("y1"), F.max("x1"), F.max("y1"), F.count("*")).first()
    x0, y0, x1, y1, n = (int(v or 0) for v in facts)
    side = 1 << (max(x1 - x0, y1 - y0) + 1).bit_length()
    wanted = 3 + max(0, (n // limit).bit_length() // 2)
    levels = min(LEVELS, side.bit_length() - 1, wanted + 4)
    fn = merge((x0, y0), side, (x1, y1))
    started = written(cells(places, (x0, y0), side, levels, limit).groupBy("depth", "cx", "cy").applyInArrow(fn, DDL), "triangles")
    found, state = [started.where(F.col("kind") == TRIANGLE)], started.where(F.col("kind") != TRIANGLE)
    depth = state.agg(F.max("depth")).first()[0] or 0
    while depth > 0:
        depth = max(0, depth - MERGED)
        moved = state.where(F.col("depth") > depth)
        up = lambda c, d=depth: F.call_function("shiftright", F.col(c), (F.col("depth") - d).cast("int")).alias(c)
        moved = moved.select("kind", F.lit(depth).cast("long").alias("depth"), up("cx"), up("cy"), *COLUMNS[4:])
        done = written(moved.groupBy("depth", "cx", "cy").applyInArrow(fn, DDL), "triangles")
        found.append(done.where(F.col("kind") == TRIANGLE))
        state = state.where(F.col("depth") <= depth).union(done.where(F.col("kind") != TRIANGLE))
    every = reduce(DataFrame.union, found)
    names = {"p1": "a", "p2": "b", "p3": "c", "x1": "ax", "y1": "ay", "x2": "bx", "y2": "by", "x3": "cx", "y3": "cy"}
    return every.select(*[F.col(k).alias(v) for k, v in names.items()])
