"""Parts of masks against a flood fill."""

import numpy as np
import pytest

from docloom.operators.masks import page_parts, parts_of, parts_of_grids, touching
from docloom.plans.registry import QUERIES

SCHEMA = "image bigint, x int, y int"


def flooded(pixels):
    """Parts by a flood over the four sides, pixel by pixel, numbered by their first pixel."""
    out = []
    for image in sorted({p[0] for p in pixels if None not in p}):
        left, part = {(y, x) for i, x, y in pixels if i == image and None not in (x, y)}, 0
        while left:
            queue = [min(left)]
            left.discard(queue[0])
            for y, x in queue:
                for near in ((y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x)):
                    if near in left:
                        left.discard(near)
                        queue.append(near)
            ys, xs = zip(*queue)
            out.append((image, part, len(queue), min(xs), max(xs), min(ys), max(ys)))
            part += 1
    return out


@pytest.mark.parametrize("density", [0.3, 0.6, 0.9])
def test_random_masks(spark, density):
    rng = np.random.default_rng(int(density * 10))
    pixels = [(image, int(x) - 3, int(y) - 5) for image in range(4) for y, x in np.argwhere(rng.random((40, 30)) < density)]
    pixels += pixels[:50] + [(None, 1, 1), (9, None, 1), (9, 1, None)]
    got = sorted(tuple(r) for r in parts_of(spark.createDataFrame(pixels, SCHEMA).repartition(3)).collect())
    assert got == flooded(pixels)


def test_snakes_and_combs(spark):
    """Long paths and joins far below the first row."""
    snake = [(1, x, y) for y in range(0, 60, 2) for x in range(30)] + [(1, 29 if y % 4 == 1 else 0, y) for y in range(1, 59, 2)]
    comb = [(2, x, y) for x in range(0, 40, 2) for y in range(20)] + [(2, x, 20) for x in range(39)]
    ring = [(3, x, y) for x in range(10) for y in range(10) if x in (0, 9) or y in (0, 9)] + [(3, 5, 5)]
    got = sorted(tuple(r) for r in parts_of(spark.createDataFrame(snake + comb + ring, SCHEMA)).collect())
    assert got == flooded(snake + comb + ring) and [r[0] for r in got] == [1, 2, 3, 3]


def test_page(spark):
    pixels = [(1, x, y) for x in range(10) for y in range(10)] + [(1, x, 50) for x in range(100)] + [(2, x, y) for x in range(50) for y in range(50)] + [(3, 0, 0)]
    pixels += [(4, x, y) for x in range(40) for y in (*range(0, 40), *range(50, 90))]
    sizes = spark.createDataFrame([(i, 100, 100) for i in range(1, 6)], "image bigint, width int, height int")
    got = sorted(tuple(r) for r in page_parts(parts_of(spark.createDataFrame(pixels, SCHEMA)), sizes).collect())
    assert got == [(2, 0, 2500, 0, 49, 0, 49), (4, 0, 1600, 0, 39, 0, 39)]


def test_no_pixels(spark):
    assert parts_of(spark.createDataFrame([], SCHEMA)).collect() == []


def test_touching_is_by_columns():
    y, x0, x1 = np.array([0, 0, 1, 1, 3]), np.array([0, 5, 1, 4, 0]), np.array([2, 9, 3, 5, 9])
    assert sorted(zip(*(v.tolist() for v in touching(y, x0, x1)))) == [(0, 2), (1, 3)]


def test_grids(spark):
    """Arrays of pixels, some of an image twice, with null pixels, short last rows and nothing set; no row is made for a pixel."""
    rng = np.random.default_rng(8)
    grids = [(image % 7, 5 + image % 7, [None if v < 0.1 else bool(v < 0.7) for v in rng.random(n)]) for image, n in enumerate([83, 60, 1, 7, 200, 11, 12, 90, 64, 3])]
    grids += [(20, 4, [False] * 9), (21, 4, []), (22, 4, None), (None, 4, [True])]
    pixels = sorted({(i, k % w, k // w) for i, w, lit in grids for k, v in enumerate(lit or []) if v and i is not None})
    rows = spark.createDataFrame(grids, "image bigint, width int, lit array<boolean>").repartition(2)
    assert sorted(tuple(r) for r in parts_of_grids(rows).collect()) == flooded(pixels)
    plan = QUERIES["mask_pages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
