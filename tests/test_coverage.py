"""Coverage of polygons by spans: equal to the mask of each row, whatever the shapes, and without a loop over rows."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from screenlab.functions import imaging
from screenlab.operators import dataset

SHAPES = pa.list_(pa.list_(pa.list_(pa.float64())))


def screens(n, seed):
    """Rectangles, polygons with corners on and off centres of pixels, self-crossing ones, and broken points; canvases of several sizes."""
    rng = random.Random(seed)
    at = lambda: rng.choice([rng.uniform(-5, 25), float(rng.randrange(-4, 24)), rng.randrange(-8, 50) / 2])

    def shape():
        if rng.random() < 0.05:
            return None
        if rng.random() < 0.4:
            a, b, c, d = at(), at(), at(), at()
            points, k = rng.choice([[[a, b], [c, b], [c, d], [a, d]], [[a, b], [a, d], [c, d], [c, b]]]), rng.randrange(4)
            return points[k:] + points[:k]
        points = [[at(), at()] for _ in range(rng.randrange(9))]
        if points and rng.random() < 0.2:
            points[rng.randrange(len(points))] = rng.choice([None, [], [1.0], [1.0, 2.0, 3.0], [None, 1.0], [float("inf"), 2.0], [-1e18, 1e17]])
        return points

    rows = [None if rng.random() < 0.05 else [shape() for _ in range(rng.choice([0, 1, 1, 2, 5]))] for _ in range(n)]
    return rows, [rng.choice([[20, 15]] * 5 + [[40, 9], [0, 5], [-3, 4], None, [], [3]]) for _ in rows]


def masked(shapes, canvas):
    if not shapes or canvas is None or len(canvas) != 2 or min(canvas) <= 0:
        return 0
    shapes = [[[np.nan if v is None else v for v in p] for p in s if p is not None and len(p) == 2] for s in shapes if s is not None]
    return int(imaging.filled([s for s in shapes if len(s) > 2], *canvas).sum())


@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_covered_is_the_sum_of_the_mask(monkeypatch, most):
    monkeypatch.setattr(imaging, "CROSSINGS", most)
    rows, canvases = screens(800, most)
    shapes, sizes = pa.array(rows, SHAPES), pa.array(canvases, pa.list_(pa.int32()))
    want = [masked(*r) for r in zip(rows, canvases, strict=True)]
    assert imaging.covered(shapes, sizes).tolist() == want and max(want) > 100
    assert imaging.covered(shapes.slice(3, 90), sizes.slice(3, 90)).tolist() == want[3:93] and not len(imaging.covered(shapes[:0], sizes[:0]))


def test_coverage_of_broken_rows(spark):
    rows, canvases = screens(300, 7)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(zip(rows, canvases, strict=True))], "i int, polygons array<array<array<double>>>, canvas_size array<int>").repartition(3)
    assert {r["i"]: r["n_positive"] for r in dataset.polygon_coverage(df).collect()} == {i: masked(*r) for i, r in enumerate(zip(rows, canvases, strict=True))}


def test_coverage_of_many_rows_takes_no_loop(spark):
    """Tens of thousands of rows take less time than masks of one in forty; and a canvas that no mask would fit."""
    n, at = 40_000, lambda k: [[[[float(k % 300), 5.0], [k % 300 + 9.0, 5.0], [k % 300 + 9.0, 44.0], [float(k % 300), 44.0]]]]
    shapes, sizes = pa.array([at(k)[0] for k in range(n)], SHAPES), pa.array([[320, 240]] * n)
    began = time.process_time()
    got = imaging.covered(shapes, sizes)
    took = time.process_time() - began
    began = time.process_time()
    assert got[: n // 40].tolist() == [int(imaging.filled(at(k)[0], 320, 240).sum()) for k in range(n // 40)]
    assert took < time.process_time() - began
    corner = lambda x, y: F.array(F.lit(float(x)), F.lit(float(y)))
    wide = spark.range(3).select(F.array(F.array(corner(0, 0), corner(1e6, 0), corner(0, 1e5)), F.array(corner(0, 0), corner(1e6, 0), corner(1e6, 1e5), corner(0, 1e5))).alias("polygons"), F.array(F.lit(1_000_000), F.lit(100_000)).alias("canvas_size"))
    assert [r["n_positive"] for r in dataset.polygon_coverage(wide).collect()] == [10**11] * 3
