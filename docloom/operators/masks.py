"""Connected parts of masks: runs of a row are the nodes, runs that touch in the next row the edges."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Degrees that a slant is looked for among, and by how much columns are finer than rows.
ANGLES, FINER = range(-20, 21), 50
#: Shares of an image's area, width and height above which a part looks like a page.
PAGE_AREA, PAGE_SIDE = 0.08, 0.35
_PARTS = "image bigint, part bigint, area bigint, left_x bigint, right_x bigint, top_y bigint, bottom_y bigint"


def runs_of(pixels: DataFrame) -> DataFrame:
    """(image, y, x0, x1) of the unbroken stretches of set pixels (image, x, y) in each row; a pixel may be given twice."""
    order = Window.partitionBy("image", "y").orderBy("x")
    numbered = pixels.select("image", "y", "x").withColumn("stretch", F.col("x") - F.dense_rank().over(order))
    return numbered.groupBy("image", "y", "stretch").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("stretch")


def touching(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (run, run in the next row) that have a column in common, of runs sorted by row and column.

    Runs of a row are apart and in order, so those that touch a run are neighbours: from the first that
    ends at or behind its start to the last that starts at or before its end.
    """
    span = int(max(x1.max(initial=0), 0)) + 2
    below_from = np.searchsorted(y * span + x1, (y + 1) * span + x0, "left")
    below_to = np.searchsorted(y * span + x0, (y + 1) * span + x1, "right")
    n = np.maximum(below_to - below_from, 0)
    upper = np.repeat(np.arange(len(y)), n)
    return upper, np.repeat(below_from, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the pairs (a, b): roots are hung under smaller ones and paths halved."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if np.array_equal(x, y):
            return root
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, high, low)
        while not np.array_equal(root, root[root]):
            root = root[root]


def merged(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in order by row and column, those of a row that overlap or touch as one; columns begin at 0."""
    order = np.lexsort((x0, y))
    y, x0, x1 = y[order], x0[order], x1[order]
    span = int(x1.max(initial=0)) + 3
    apart = (y * span + x0)[1:] > np.maximum.accumulate(y * span + x1)[:-1] + 1
    first = np.flatnonzero(np.append(True, apart))
    return y[first], x0[first], np.maximum.reduceat(x1, first)


def _part_rows(table: pa.Table) -> pa.Table:
    y, x0, x1 = (pa.compute.list_flatten(table[c]).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
    y0, left = y.min(), x0.min()
    y, x0, x1 = merged(y - y0, x0 - left, x1 - left)
    part = joined(len(y), *touching(y, x0, x1))
    y, x0, x1 = y + y0, x0 + left, x1 + left
    first, which = np.unique(part, return_inverse=True)
    least = lambda v: np.minimum.reduceat(v[np.argsort(which, kind="stable")], np.searchsorted(np.sort(which), np.arange(len(first))))
    area = np.bincount(which, weights=x1 - x0 + 1).astype(np.int64)
    columns = [pa.array(np.full(len(first), table["image"][0].as_py())), pa.array(np.arange(len(first), dtype=np.int64)), pa.array(area)]
    columns += [pa.array(v) for v in (least(x0), -least(-x1), least(y), -least(-y))]
    return pa.table(columns, ["image", "part", "area", "left_x", "right_x", "top_y", "bottom_y"])


def parts_of(pixels: DataFrame) -> DataFrame:
    """(image, part, area, left_x, right_x, top_y, bottom_y) of the connected parts of the set pixels (image, x, y).

    Pixels are connected over their four sides; parts are numbered from 0 by their first pixel, row by
    row. Pixels become runs in Spark; the runs of one image, which its size bounds, are joined in one task.
    Pixels with a null place or image are left out; an image without set pixels has no parts.
    """
    clean = pixels.where("image is not null and x is not null and y is not null")
    clean = clean.select(F.col("image").cast("bigint"), F.col("x").cast("bigint"), F.col("y").cast("bigint"))
    runs = runs_of(clean).select("image", *[F.array(c).alias(c) for c in ("y", "x0", "x1")])
    return runs.groupBy("image").applyInArrow(_part_rows, _PARTS)


def _grid_runs(batches):
    """Rows (image, width, lit) as (image, y, x0, x1), a list of runs for each."""
    for batch in batches:
        n = batch.num_rows
        sizes = pa.compute.fill_null(pa.compute.list_value_length(batch.column(2)), 0).to_numpy()
        lit = pa.compute.fill_null(batch.column(2).flatten(), False).to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(n), sizes)
        at, width = np.arange(len(lit)) - bounds[owner], batch.column(1).to_numpy().astype(np.int64)[owner]
        y, x = np.divmod(at, width)
        after = np.append(lit[1:], False)
        after[bounds[1:][bounds[1:] > 0] - 1] = False
        begin = np.flatnonzero(lit & ((x == 0) | ~np.append(False, lit[:-1])))
        end = np.flatnonzero(lit & ((x == width - 1) | ~after))
        cuts = pa.array(np.searchsorted(begin, bounds).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(v, pa.int64())) for v in (y[begin], x[begin], x[end])]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["image", "y", "x0", "x1"])


def parts_of_grids(grids: DataFrame) -> DataFrame:
    """What `parts_of` gives, of images (image, width, lit) whose pixels are one array of booleans, row by row.

    Runs are found where an image lies and shuffled as one row for each, so no row is made for a pixel.
    Grids of one image lie over each other; null pixels are not set.
    """
    rows = grids.where("image is not null and width > 0").select(F.col("image").cast("bigint"), F.col("width").cast("bigint"), "lit")
    runs = rows.mapInArrow(_grid_runs, "image bigint, y array<bigint>, x0 array<bigint>, x1 array<bigint>").where(F.size("y") > 0)
    return runs.groupBy("image").applyInArrow(_part_rows, _PARTS)


def page_parts(parts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Of each image (image, width, height) the largest part that looks like a page, the first of equals; images without one are left out."""
    wide, high = F.col("right_x") - F.col("left_x") + 1, F.col("bottom_y") - F.col("top_y") + 1
    like = (F.col("area") > F.col("width") * F.col("height") * PAGE_AREA) & (wide > F.col("width") * PAGE_SIDE) & (high > F.col("height") * PAGE_SIDE)
    best = Window.partitionBy("image").orderBy(F.desc("area"), "part")
    found = parts.join(sizes, "image").where(like).withColumn("rank", F.row_number().over(best)).where("rank = 1")
    return found.drop("rank", "width", "height")


def _variances(owner: np.ndarray, mass: np.ndarray, groups: int) -> np.ndarray:
    """Variance of the positive masses of each group; less than any number for a group without one."""
    owner, mass = owner[mass > 0], mass[mass > 0]
    n = np.bincount(owner, minlength=groups)
    largest = float(n.max(initial=0)) ** 2 * float(mass.max(initial=0)) ** 2
    total, squares = (np.zeros(groups, np.int64 if largest < 2**62 else object) for _ in range(2))  # whole numbers of any size
    mass = mass.astype(total.dtype)
    np.add.at(total, owner, mass)
    np.add.at(squares, owner, mass * mass)
    spread = (n.astype(total.dtype) * squares - total * total).astype(float)
    return np.where(n > 0, spread / np.maximum(n.astype(float) * n, 1), -np.inf)


def _angle_rows(turns: list[tuple[float, float]]):
    """Marks sorted by image; of an image that is not at its end only the masses of its bins are held."""
    nothing = np.iinfo(np.int64).min  # the bin of marks without a place

    def ended(images, known, scores):
        found = np.isfinite(scores).any(axis=0)
        angle = np.array(ANGLES, float)[scores.argmax(axis=0)]
        return pa.RecordBatch.from_arrays([pa.array(images, mask=~known).filter(pa.array(found)), pa.array(angle[found])], ["image", "angle"])

    def run(batches):
        image, has, held = None, False, [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(turns)
        for batch in batches:
            if not batch.num_rows:
                continue
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            value, x, y, v = (pa.compute.fill_null(batch.column(k), 0).to_numpy() for k in range(4))
            placed = (batch.column(1).is_valid().to_numpy(zero_copy_only=False)) & (batch.column(2).is_valid().to_numpy(zero_copy_only=False))
            begins = np.append(image is None or (value[0], known[0]) != (image, has), (value[1:] != value[:-1]) | (known[1:] != known[:-1]))
            group = np.cumsum(begins) - (image is None)
            last, scores = int(group[-1]), []
            for k, (sine, cosine) in enumerate(turns):
                place = np.where(placed, np.floor(x * sine / FINER + y * cosine).astype(np.int64), nothing)
                place, mass = np.append(held[k][0], place), np.append(held[k][1], v)
                owner = np.append(np.zeros(len(held[k][0]), np.int64), group)
                order = np.lexsort((place, owner))
                place, owner = place[order], owner[order]
                first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])))
                mass, place, owner = np.add.reduceat(mass[order], first), place[first], owner[first]
                stays = np.searchsorted(owner, last)
                held[k] = place[stays:], mass[stays:]
                scores.append(_variances(owner[:stays], mass[:stays], last))
            if last:
                ids, names = (np.append([] if image is None else [own], column[begins]) for own, column in ((image, value), (has, known)))
                yield ended(ids[:last].astype(np.int64), names[:last].astype(bool), np.array(scores))
            image, has = value[-1], known[-1]
        if image is not None:
            scores = [_variances(np.zeros(len(mass), np.int64), mass, 1) for _, mass in held]
            yield ended(np.array([image]), np.array([has]), np.array(scores))

    return run


def skew_angles(marks: DataFrame) -> DataFrame:
    """(image, angle) of the marks (image, x, y, v), whole numbers: the slant at which the masses by row vary most, the smallest of equals.

    Columns are FINER times as fine as rows. The marks are shuffled once, by image, and sorted; each angle is tried
    where they lie, so nothing is written for an angle, and of a large image a task holds its bins and not its marks.
    Marks without a place are a bin of their own; images without a positive mass have no angle.
    """
    turns = [(round(math.sin(math.radians(a)), 6), round(math.cos(math.radians(a)), 6)) for a in ANGLES]
    clean = marks.select(*[F.col(c).cast("bigint").alias(c) for c in ("image", "x", "y", "v")])
    return clean.repartition("image").sortWithinPartitions("image").mapInArrow(_angle_rows(turns), "image bigint, angle double")
