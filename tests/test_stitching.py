"""Stitching against least squares, known shifts and whole-array blending."""

import numpy as np
import pytest
from test_raster import array_of, image_of

from voxara.operators import blocks, stitching
from voxara.plans.script import Session

TILES = "tile bigint, w int, h int, d int, px double, py double, pz double"


def test_solve_equals_least_squares():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 12, 40), rng.integers(0, 12, 40)
    keep = a < b
    a, b = np.r_[a[keep], range(11), 12], np.r_[b[keep], range(1, 12), 13]
    weights, diff = rng.uniform(0.2, 1, len(a)), rng.normal(size=(len(a), 2))
    start = rng.normal(size=(15, 2))
    got = stitching.solve(15, a, b, diff, weights, start)
    groups = {0: range(12), 12: (12, 13), 14: (14,)}
    for first, members in groups.items():
        assert np.allclose(got[first], start[first])
        rows = [i for i in range(len(a)) if a[i] in members]
        free = [m for m in members if m != first]
        if free:
            m, want = np.zeros((len(rows), len(free))), np.zeros((len(rows), 2))
            for r, i in enumerate(rows):
                root = np.sqrt(weights[i])
                want[r] = root * diff[i]
                for node, sign in ((b[i], 1), (a[i], -1)):
                    if node == first:
                        want[r] -= root * sign * start[first]
                    else:
                        m[r, free.index(node)] += root * sign
            assert np.allclose(got[free], np.linalg.lstsq(m, want, rcond=None)[0])


def test_pairs_are_those_that_overlap(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(int, rng.integers(1, 9, 3)), *map(float, rng.integers(0, 30, 3))) for i in range(40)]
    for slack in (0.0, 1.5):
        want = {(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and all(p[4 + k] - slack <= q[4 + k] + q[1 + k] - 1 + slack and q[4 + k] - slack <= p[4 + k] + p[1 + k] - 1 + slack for k in range(3))}
        assert {tuple(r) for r in stitching.overlaps(spark.createDataFrame(rows, TILES), slack).collect()} == want


def test_best_shift():
    rng = np.random.default_rng(3)
    b = rng.normal(size=(9, 7, 5))
    a = 2 * b[3:8, 1:6, 2:5] + 1
    a[0, 0, 0] = np.nan
    shift, score, ma, mb, da, db = stitching.best_shift(a, b)
    assert shift == (1, 0, 1) and score == 1 and np.isclose(da, 2 * db) and np.isclose(ma, 2 * mb + 1)
    assert stitching.best_shift(np.ones((3, 3, 3)), np.ones((5, 5, 5)))[1] == 0


@pytest.mark.parametrize("block", [(7, 6, 5), (64, 64, 64)])
def test_displaced_tiles_are_put_back(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr(stitching, "BLOCK", block)
    rng = np.random.default_rng(4)
    a = rng.integers(1, 255, (20, 14, 6)).astype(float)
    true = {0: (0, 0, 0), 1: (9, 0, 0), 2: (0, 6, 0), 3: (9, 6, 0)}
    off = {0: (0, 0, 0), 1: (1, -1, 0), 2: (-1, 1, 0), 3: (0, 2, 1)}
    first = spark.createDataFrame([(t, 11, 8, 6, *p) for t, p in true.items()], "tile bigint, w int, h int, d int, ox int, oy int, oz int")
    supposed = spark.createDataFrame([(t, 11, 8, 6, *(float(p[k] + off[t][k]) for k in range(3))) for t, p in true.items()], TILES)
    pixels = stitching.split(image_of(spark, a), first)
    assert pixels.count() == 4 * 11 * 8 * 6
    points = stitching.grid_points(supposed, stitching.overlaps(supposed, 2), (3, 3, 3), (1, 1, 1))
    matches = stitching.match(pixels, points, (2, 3, 1), (1, 1, 1))
    placed = stitching.place(supposed, matches)
    assert {r.tile: (r.px, r.py, r.pz) for r in placed.collect()} == true
    step = (5, 4, 3)
    fields = stitching.world_to_local(placed, matches, step, False)
    image, goodness = stitching.stitch(pixels, placed, fields, step, (20, 14, 6), "float32")
    got = array_of(image)
    inner = np.zeros(a.shape, bool)
    inner[1:19, 1:13, 1:5] = True
    assert np.allclose(got[inner], a[inner]) and (got[~inner] == 0).all() and np.allclose(array_of(goodness), 0, atol=1e-4)
    part = array_of(stitching.stitch(pixels, placed, fields, step, (6, 5, 3), "float32", (7, 4, 2))[0])
    assert np.allclose(part, got[7:13, 4:9, 2:5])


def test_blending_weighs_by_distance_and_evens_grey_values(spark):
    a = np.full((10, 4, 4), 100.0)
    first = spark.createDataFrame([(0, 6, 4, 4, 0, 0, 0), (1, 6, 4, 4, 4, 0, 0)], "tile bigint, w int, h int, d int, ox int, oy int, oz int")
    pixels = stitching.split(image_of(spark, a), first).selectExpr("tile", "x", "y", "z", "v + 10 * tile AS v")
    placed = spark.createDataFrame([(0, 6.0, 4.0, 4.0, 0.0, 0.0, 0.0, 1.0, 0.0), (1, 6.0, 4.0, 4.0, 4.0, 0.0, 0.0, 0.5, 45.0)], "tile bigint, w double, h double, d double, px double, py double, pz double, gain double, offset double")
    fields = stitching.world_to_local(placed, None, (3, 3, 3), False)
    plain, spread = stitching.stitch(pixels, placed, fields, (3, 3, 3), (10, 4, 4), "float32", normalize=False)
    got, dev = array_of(plain), array_of(spread)
    assert np.allclose(got[1:4, 1, 1], 100) and np.allclose(got[6:9, 1, 1], 110)
    assert np.isclose(got[4, 1, 1], 100) and np.isclose(got[5, 1, 1], 110) and dev[4, 1, 1] == 0
    assert np.allclose(array_of(stitching.stitch(pixels, placed, fields, (3, 3, 3), (10, 4, 4), "float32")[0])[1:9, 1, 1], 100)
    round_ = array_of(stitching.stitch(pixels, placed, fields, (3, 3, 3), (10, 4, 4), "float32", normalize=False, circle=0.0)[0])
    w0, w1 = 1 - np.hypot(4 - 3, 1 - 2) / 2, 1 - np.hypot(0 - 3, 1 - 2) / 2
    assert np.isclose(round_[4, 1, 0], (w0 * 100 + max(w1, 0) * 110) / (w0 + max(w1, 0)))


def test_missing_zeros_and_fractions(spark):
    ramp = np.arange(12.0).reshape(12, 1, 1) * np.ones((1, 4, 4)) + 5
    ramp[6] = 0
    first = spark.createDataFrame([(0, 12, 4, 4, 0, 0, 0)], "tile bigint, w int, h int, d int, ox int, oy int, oz int")
    pixels = stitching.split(image_of(spark, ramp), first)
    placed = spark.createDataFrame([(0, 12.0, 4.0, 4.0, 0.5, 0.0, 0.0, 1.0, 0.0)], "tile bigint, w double, h double, d double, px double, py double, pz double, gain double, offset double")
    fields = stitching.world_to_local(placed, None, (4, 4, 4), False)
    got = array_of(stitching.stitch(pixels, placed, fields, (4, 4, 4), (12, 4, 4), "float32", zeroes_are_missing=True)[0])[:, 1, 1]
    assert np.allclose(got[2:5], np.arange(2, 5) - 0.5 + 5) and (got[6:8] == 0).all() and np.allclose(got[9:10], 9 - 0.5 + 5)
    moved = fields.selectExpr("tile", "i", "j", "k", "sx + 0.5 AS sx", "sy", "sz")
    whole = array_of(stitching.stitch(pixels, placed, moved, (4, 4, 4), (12, 4, 4), "float32")[0])[:, 1, 1]
    assert np.allclose(whole[1:11], ramp[1:11, 1, 1])


def test_tiles_that_disagree_share_what_is_left(spark):
    placed = spark.createDataFrame([(0, 9.0, 9.0, 9.0, 0.0, 0.0, 0.0, 1.0, 0.0), (1, 9.0, 9.0, 9.0, 4.0, 0.0, 0.0, 1.0, 0.0)], "tile bigint, w double, h double, d double, px double, py double, pz double, gain double, offset double")
    matches = spark.createDataFrame([(0, 1, 6, 4, 4, -3.0, 0.0, 0.0, 1.0)], "a bigint, b bigint, x bigint, y bigint, z bigint, sx double, sy double, sz double, score double")
    rows = stitching.world_to_local(placed, matches, (4, 4, 4)).collect()
    assert {(r.tile, r.sx, r.sy) for r in rows} == {(0, -0.5, 0.0), (1, 0.5, 0.0)} and len(rows) == 2 * 27


def test_stitching_commands(spark):
    a = np.random.default_rng(5).integers(1, 255, (12, 6, 6)).astype(float)
    session = Session(spark)
    first = spark.createDataFrame([(0, 8, 6, 6, 0, 0, 0), (1, 8, 6, 6, 4, 0, 0)], "tile bigint, w int, h int, d int, ox int, oy int, oz int")
    session.tables["pixels"] = stitching.split(image_of(spark, a), first)
    session.tables["tiles"] = spark.createDataFrame([(0, 8, 6, 6, 0.0, 0.0, 0.0), (1, 8, 6, 6, 5.0, 0.0, 0.0)], TILES)
    session.run("newimage(out, float32, 1, 1, 1)\nmatchtiles(pixels, tiles, matches, [3, 3, 3], [1, 1, 1], [2, 1, 1])\ndetermine_world_to_local(tiles, matches, placed, fields, [4, 4, 4], true)\nstitch_ver3(out, good, pixels, placed, fields, [4, 4, 4], 0, 0, 0, 12, 6, 6, true, -1)")
    assert np.allclose(array_of(session.images["out"])[1:11, 1:5, 1:5], a[1:11, 1:5, 1:5]) and array_of(session.images["good"]).max() < 1e-3
    session.run("stitch_ver2(out, pixels, placed, fields, [4, 4, 4], 2, 1, 1, 4, 4, 4)")
    assert np.allclose(array_of(session.images["out"]), a[2:6, 1:5, 1:5])
