"""The triangulation against the empty-circle rule, for one cell and for many, on random, regular and degenerate points."""

import random

import numpy as np
import pytest

from tessera.operators import delaunay as d
from tessera.sources import points as src


def doubled_area(points, faces):
    return sum(d.turn(*(points[i] for i in f)) for f in faces)


def hull_area(points):
    """Twice the area of the convex hull, by a monotone chain."""
    def chain(ps):
        out = []
        for p in ps:
            while len(out) > 1 and d.turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out

    ring = chain(points)[:-1] + chain(points[::-1])[:-1]
    return sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def kinds():
    rng = random.Random(3)
    yield "random", {(rng.randrange(10_000), rng.randrange(10_000)) for _ in range(700)}
    yield "grid", {(x, y) for x in range(25) for y in range(20)}
    yield "circle", {(5 * x, 5 * y) for x, y in ((3, 4), (4, 3), (5, 0), (0, 5), (-3, 4), (-4, 3), (-5, 0), (3, -4), (0, -5), (-3, -4), (4, -3), (-4, -3))}
    yield "line", {(3 * i, 7 * i) for i in range(80)}
    yield "clusters", {(int(rng.gauss(c, 3)), int(rng.gauss(c * c, 3))) for c in (0, 500, 9000) for _ in range(150)}
    yield "few", {(1, 1)}
    yield "two", {(1, 1), (5, 9)}
    yield "arc", {(i, i * i) for i in range(-60, 60)}
    yield "large", {(rng.randrange(-(10**9), 10**9), rng.randrange(-(10**9), 10**9)) for _ in range(150)}


@pytest.mark.parametrize(("name", "points"), list(kinds()), ids=lambda v: v if isinstance(v, str) else "")
def test_cells_agree_with_the_whole(spark, name, points):
    points = sorted(points)
    faces, _ = d.triangulated(points)
    whole = {tuple(points[i] for i in f[f.index(min(f)) :] + f[: f.index(min(f))]) for f in faces}
    for f in faces:
        a, b, c = (points[i] for i in f)
        assert d.turn(a, b, c) > 0 and not any(d.inside(a, b, c, p) for p in points)
    assert doubled_area(points, faces) == (hull_area(points) if len(points) > 2 else 0)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "point_id long, qx long, qy long").repartition(3)
    for limit in (7, 40):
        got = [((r.ax, r.ay), (r.bx, r.by), (r.cx, r.cy)) for r in d.delaunay(df, limit).collect()]
        assert len(got) == len(set(got)) and set(got) == whole


def test_no_points_and_repeated_ones(spark):
    df = spark.createDataFrame([(5, 0, 0), (4, 0, 0), (3, 9, 0), (2, 0, 9), (1, None, 3)], "point_id long, qx long, qy long")
    assert d.delaunay(df.where("false")).count() == 0
    assert [tuple(r)[:3] for r in d.delaunay(df).collect()] == [(4, 3, 2)]


def test_customers(spark):
    """The empty circle for every triangle of a table's points, the hull's area, and what moves up from cells."""
    pts = src.customers(spark, "/root/testdata/sf0.01")
    rows = d.delaunay(pts, 300).collect()
    points = np.array(sorted((r.qx, r.qy) for r in pts.select("qx", "qy").distinct().collect()), object)
    faces = [((r.ax, r.ay), (r.bx, r.by), (r.cx, r.cy)) for r in rows]
    for a, b, c in faces:
        p = points - np.array([0, 0], object)
        ax, ay, bx, by, cx, cy = (v[i] - p[:, i] for v in (a, b, c) for i in (0, 1))
        found = (ax * ax + ay * ay) * (bx * cy - by * cx) + (bx * bx + by * by) * (cx * ay - cy * ax) + (cx * cx + cy * cy) * (ax * by - ay * bx)
        assert (found <= 0).all()
    assert sum(d.turn(*f) for f in faces) == hull_area([tuple(p) for p in points])


def test_few_points_leave_a_cell():
    """Of a cell amid others, points go on along its seams only."""
    rng = random.Random(8)
    points = sorted({(rng.randrange(10**6), rng.randrange(10**6)) for _ in range(4000)})
    faces, kept, edges = d.settled(points, set(), (-1, -1, 10**6, 10**6))
    assert len(faces) > 7000 and len(kept) < 800 and edges
