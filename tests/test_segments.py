"""Segments by tiles and scales from the data, against plain versions."""

import random
from collections import Counter

import pytest

from tessera.functions import scales
from tessera.operators import segments


def flood(cells, tolerance, width, steps):
    steps = [*steps, *[(-a, -b) for a, b in steps]]
    out, left = {}, set(cells)
    for start in sorted(cells):
        if start in left:
            found, todo = [], [start]
            left.discard(start)
            while todo:
                r, c = todo.pop()
                found.append((r, c))
                for dr, dc in steps:
                    near = (r + dr, c + dc)
                    if near in left and abs(cells[near] - cells[r, c]) <= tolerance:
                        left.discard(near)
                        todo.append(near)
            label = min(r * width + c for r, c in found)
            out |= {p: (label, len(found)) for p in found}
    return out


@pytest.mark.parametrize("steps", [segments.FOUR, segments.EIGHT])
def test_segments_equal_flooding(spark, steps):
    rng = random.Random(6)
    noise = {(r, c): rng.randrange(4) for r in range(41) for c in range(37) if rng.random() < 0.85}
    comb = {(r, c): 0 if r == 0 or c % 2 == 0 else 9 for r in range(30) for c in range(30)}
    corner = {(2, 2): 1, (3, 3): 1, (4, 2): 1, (9, 9): 5}
    for cells in (noise, comb, corner, {(7, 7): 1}):
        df = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "r int, c int, v int").repartition(3)
        want = flood(cells, 1, 64, steps)
        for tile in (4, 16, 256):
            got = {(x.r, x.c): (x.label, x["size"]) for x in segments.segments(df, 1, 64, steps, tile).collect()}
            assert got == want
    few = segments.large_segments(segments.segments(df, 1, 64), 2).collect()
    assert [tuple(r) for r in few] == [(7, 7, 0, 1)]
    assert segments.segments(df.where("false"), 1, 64).count() == 0
    assert segments.segments(spark.createDataFrame([(0, 0, None), (0, 1, 2)], "r int, c int, v int"), 1, 64).count() == 1


@pytest.mark.parametrize("steps", [segments.FOUR, segments.EIGHT])
def test_columns_past_the_width(spark, steps):
    """Cells whose scan index is equal are one: a row for each index, as by the SQL of the queries."""
    rng = random.Random(8)
    cells = {(r, c): rng.randrange(12) for r in range(9) for c in range(50) if rng.random() < 0.8}
    every = [*steps, *[(-a, -b) for a, b in steps]]
    label = {r * 16 + c: r * 16 + c for r, c in cells}
    links = [(r * 16 + c, (r + a) * 16 + c + b) for r, c in cells for a, b in every if (r + a, c + b) in cells and abs(cells[r, c] - cells[r + a, c + b]) <= 1]
    while any(label[x] < label[y] and not label.update({y: label[x]}) for x, y in links):
        pass
    sizes = Counter(label.values())
    want = sorted((i // 16, i % 16, k, sizes[k]) for i, k in label.items())
    df = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "r int, c int, v int").repartition(3)
    for tile in (4, 256):
        assert sorted(map(tuple, segments.segments(df, 1, 16, steps, tile).collect())) == want


def test_scale_base():
    assert [scales.scale_base(n) for n in (10, 1000, 256, 36, 7, 1)] == [10, 10, 2, 6, 7, 1]


@pytest.mark.parametrize("step", [1, 10, 100])
def test_planted_scale(spark, step):
    """Values that are multiples of 1, 10 and 100 in a scale of 1000ths: their common scale is found, and none changes."""
    rng = random.Random(step)
    values = sorted(rng.sample(range(100_000), 900))
    df = spark.createDataFrame([(v * step + 17,) for v in values] * 2, "q long").repartition(7)
    differences = scales.neighbour_differences(df, "q")
    want = sorted((b - a) * step for a, b in zip(values, values[1:], strict=False))
    assert sorted(d for r in differences.collect() for d in [r.difference] * r.n) == want
    assert scales.common_scale(differences, 0.001).first().scale == pytest.approx(0.001 * step)
    one = scales.neighbour_differences(df.limit(1), "q")
    assert one.count() == 0 and scales.typical_scale(one, 0.001).first().scale == 0.001


def test_typical_scale(spark):
    """Mean steps of 100 in a scale of 1000ths need tenths; steps of 1, or beyond the scale, leave it."""
    for step, want in ((100, 0.1), (1, 0.001), (10**5, 0.001)):
        df = spark.createDataFrame([(step * i,) for i in range(50)], "q long").repartition(4)
        assert scales.typical_scale(scales.neighbour_differences(df, "q"), 0.001).first().scale == pytest.approx(want)
