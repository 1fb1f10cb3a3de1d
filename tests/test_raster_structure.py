"""Operators that SQL doesn't express, against brute force, known shapes and other block sizes."""

import heapq
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxara.operators import analyzers, blocks, distance, formulas, fourier, generate, neighbourhood, regions, skeletons, statistics, structure, thresholds
from voxara.raster import Image


def image_of(spark, a, dtype="float32"):
    rows = [(*map(int, p), float(a[p])) for p in np.ndindex(a.shape)]
    return Image(spark.createDataFrame(rows, "x bigint, y bigint, z bigint, v double"), a.shape, dtype)


def array_of(image):
    out = np.full(image.dims, np.nan)
    pdf = image.df.toPandas()
    assert len(pdf) == image.count and not pdf.duplicated(["x", "y", "z"]).any()
    out[pdf["x"], pdf["y"], pdf["z"]] = pdf["v"]
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    for module in (blocks, regions, neighbourhood):
        monkeypatch.setattr(module, "BLOCK", (5, 4, 6))


def noise(shape, seed=0):
    return np.random.default_rng(seed).integers(0, 255, shape).astype(float)


def test_block_size_does_not_matter(spark, small_blocks):
    a = noise((11, 9, 8))
    im = image_of(spark, a)
    ops = {
        "cylindricality": lambda: structure.cylindricality(im), "theta": lambda: structure.plate_orientation(im)[2], "curvature": lambda: structure.mean_curvature(im), "sato": lambda: structure.sato(im, 1.0),
        "frangi": lambda: structure.frangi(im, 1.0, c=20), "canny": lambda: structure.canny(im, 1.0, 10, 30), "label": lambda: regions.label(im.map((F.col("v") > 120).cast("double"), "uint8"), 1.0, "All"),
        "maxima": lambda: regions.local_maxima(im), "thin": lambda: skeletons.line_skeleton(im.map((F.col("v") > 60).cast("double"), "uint8")), "surface": lambda: skeletons.surface_skeleton(im.map((F.col("v") > 60).cast("double"), "uint8")),
        "classes": lambda: skeletons.classify_skeleton(im.map((F.col("v") > 200).cast("double"), "uint8")), "sdmap": lambda: distance.seeded_distance(im.map((F.col("v") > 230).cast("double")), im.map((F.col("v") > 80).cast("double"))),
    }
    small = {name: array_of(f()) for name, f in ops.items()}
    for module in (blocks, regions, neighbourhood):
        module.BLOCK = (64, 64, 64)
    for name, f in ops.items():
        np.testing.assert_allclose(small[name], array_of(f()), rtol=1e-9, atol=1e-9, err_msg=name)


def test_band_pass_and_inverse(spark):
    a = noise((8, 6, 5))
    im = image_of(spark, a)
    np.testing.assert_allclose(array_of(fourier.ifft(fourier.fft(im), im.dims)), a, atol=1e-9)
    got = array_of(fourier.band_pass(im, 2, 5, zero_edges=False))
    whole = np.fft.fftn(a)
    keep = np.empty(a.shape)
    for p in np.ndindex(a.shape):
        f = [min(c, n - c) for c, n in zip(p, a.shape)]
        high, low = (sum((f[i] * math.sqrt(2) * math.pi * s / a.shape[i]) ** 2 for i in range(3)) for s in (2.5, 1.0))
        keep[p] = (1 - math.exp(-high)) * math.exp(-low)
    np.testing.assert_allclose(got, np.fft.ifftn(whole * keep).real, atol=1e-9)


def test_threshold_methods_part_two_modes():
    n = np.zeros(256)
    k = np.arange(256)
    n += 1000 * np.exp(-((k - 60) ** 2) / 200) + 700 * np.exp(-((k - 180) ** 2) / 300)
    for name, f in thresholds.METHODS.items():
        low, high = (60, 185) if name in ("Percentile", "Moments", "RenyiEntropy", "Shanbhag", "Yen") else (70, 175)
        assert low <= f(np.round(n)) <= high, name
        assert 0 <= f(np.zeros(256)) <= 255 and 0 <= f(np.eye(256)[7]) <= 255


def test_orientation_of_cylinder_and_plate(spark):
    z, x = np.indices((13, 13, 13))[2], np.indices((13, 13, 13))[0]
    y = np.indices((13, 13, 13))[1]
    rod = ((x - 6) ** 2 + (y - 6) ** 2 < 9).astype(float) * 100
    energy, phi, theta = structure.cylinder_orientation(image_of(spark, rod))
    assert array_of(theta)[6, 9, 6] < 1e-6 and array_of(energy)[6, 9, 6] > 0
    plate = (abs(x - 6) < 2).astype(float) * 100
    _, phi, theta = structure.plate_orientation(image_of(spark, plate))
    assert abs(array_of(theta)[8, 6, 6] - math.pi / 2) < 1e-6 and abs(math.sin(array_of(phi)[8, 6, 6])) < 1e-6
    line = array_of(structure.sato(image_of(spark, rod), 2.0))
    vessel = array_of(structure.frangi(image_of(spark, rod), 2.0))
    assert line[6, 6, 6] == line[:, :, 6].max() > 0 and line[0, 0, 6] == 0 and vessel[6, 6, 6] > vessel[0, 0, 6]
    step = (x > 6).astype(float) * 100 - (x == 7) * 50
    edges = array_of(structure.canny(image_of(spark, step), 1.0, 5, 10))
    assert set(np.flatnonzero(edges[:, 6, 6])) == {7} and edges[:, 6, 6].any() and (z >= 0).all()


def test_seeded_distance_equals_dijkstra(spark, small_blocks):
    a = noise((9, 8, 5), 3)
    seeds, geometry = (a > 235).astype(float), (a > 90).astype(float)
    for kind in ("All", "Nearest"):
        steps = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o) and (kind == "All" or sum(map(abs, o)) == 1)]
        want, heap = np.full(a.shape, np.inf), [(0.0, p) for p in map(tuple, np.argwhere(seeds))]
        for _, p in heap:
            want[p] = 0
        while heap:
            d, p = heapq.heappop(heap)
            if d > want[p]:
                continue
            for o in steps:
                q = tuple(np.add(p, o))
                if all(0 <= c < n for c, n in zip(q, a.shape)) and geometry[q] == geometry[p] and d + math.dist(p, q) < want[q] - 1e-12:
                    want[q] = d + math.dist(p, q)
                    heapq.heappush(heap, (want[q], q))
        np.testing.assert_allclose(array_of(distance.seeded_distance(image_of(spark, seeds), image_of(spark, geometry), kind)), want)


def test_inpainting_takes_a_nearest_value(spark):
    a = noise((7, 6, 5), 5) + 1
    a[noise((7, 6, 5), 6) < 150] = 0
    got = array_of(distance.inpaint_nearest(image_of(spark, a)))
    known = np.argwhere(a)
    for p in np.argwhere(a == 0):
        d = ((known - p) ** 2).sum(1)
        assert got[tuple(p)] in {a[tuple(q)] for q in known[d == d.min()]}
    assert (got[a != 0] == a[a != 0]).all()
    assert (array_of(distance.inpaint_nearest(image_of(spark, np.zeros((3, 2, 1))))) == 0).all()


def test_maxima_and_colours(spark):
    a = np.zeros((20, 3, 3))
    a[3, 1, 1], a[6, 1, 1], a[15, 1, 1] = 5, 2, 4
    im = image_of(spark, a)
    maxima = regions.local_maxima(im)
    assert sorted(np.unique(array_of(maxima))) == [0, 1, 2, 3]
    left = array_of(regions.clean_maxima(im, maxima))
    assert left[3, 1, 1] and not left[6, 1, 1] and left[15, 1, 1]
    b = noise((6, 6, 4), 8) // 60
    coloured, named = array_of(regions.greedy_coloring(image_of(spark, b))), array_of(regions.label(image_of(spark, b), connectivity="All"))
    for p in np.ndindex(b.shape):
        for o in itertools.product((-1, 0, 1), repeat=3):
            q = tuple(np.add(p, o))
            if all(0 <= c < n for c, n in zip(q, b.shape)) and b[p] and b[q]:
                assert (coloured[p] == coloured[q]) == (named[p] == named[q]) or (named[p] != named[q] and coloured[p] != coloured[q])
    grown = array_of(regions.grow_labels(image_of(spark, np.array([2.0, 1, 1, 1, 1, 3, 0, 1]).reshape(8, 1, 1)), 1, 0)).ravel()
    assert grown.tolist() == [2, 2, 2, 3, 3, 3, 0, 1]


def components(a, reach):
    left, n = {tuple(p) for p in np.argwhere(a)}, 0
    while left:
        todo, n = [left.pop()], n + 1
        while todo:
            p = todo.pop()
            for o in itertools.product((-1, 0, 1), repeat=3):
                q = tuple(np.add(p, o))
                if 0 < sum(map(abs, o)) <= reach and q in left:
                    left.discard(q)
                    todo.append(q)
    return n


@pytest.mark.parametrize("f", [skeletons.line_skeleton, skeletons.surface_skeleton])
def test_thinning_keeps_topology(spark, f):
    a = (noise((9, 8, 7), 11) > 90).astype(float)
    thin = array_of(f(image_of(spark, a, "uint8")))
    assert (thin <= a).all() and thin.sum() < a.sum()
    assert components(thin, 3) == components(a, 3)
    assert components(np.pad(1 - thin, 1, constant_values=1), 1) == components(np.pad(1 - a, 1, constant_values=1), 1)
    assert (array_of(f(image_of(spark, thin, "uint8"))) == thin).all()


def test_skeletons_of_known_shapes(spark):
    bar = np.zeros((15, 5, 5))
    bar[2:13, 1:4, 1:4] = 1
    line = array_of(skeletons.line_skeleton(image_of(spark, bar, "uint8")))
    assert 5 <= line.sum() <= 11 and components(line, 3) == 1
    sheet = np.zeros((12, 12, 5))
    sheet[1:11, 1:11, 1:4] = 1
    assert array_of(skeletons.surface_skeleton(image_of(spark, sheet, "uint8"))).sum() > 25
    cross = np.zeros((11, 11, 1))
    cross[5, 1:10], cross[1:10, 5] = 1, 1
    vertices, edges = skeletons.trace_skeleton(image_of(spark, cross, "uint8"))
    assert vertices.count() == 5 and edges.count() == 4
    rows = edges.collect()
    assert sum(r.points for r in rows) + 4 + 5 == cross.sum() and all(r.v1 < r.v2 for r in rows)
    filled = array_of(skeletons.fill_skeleton(image_of(spark, cross, "uint8"), edges, "points"))
    assert filled[5, 2, 0] == rows[0].points


def test_network_cleaning(spark):
    vertices = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(8)], "id bigint, x double, y double, z double")
    edges = spark.createDataFrame([(0, 0, 1, 2, 1.0), (1, 1, 2, 3, 2.0), (2, 2, 3, 4, 3.0), (3, 2, 4, 1, 0.5), (4, 5, 6, 1, 1.0), (5, 6, 5, 1, 1.0)], "id bigint, v1 bigint, v2 bigint, points bigint, length double")
    v, e = skeletons.clean_network(vertices, edges)
    got = {(r.v1, r.v2): (r.points, r.length) for r in e.collect()}
    assert got == {(0, 2): (5, 3.0), (2, 3): (4, 3.0), (2, 4): (1, 0.5), (5, 5): (2, 2.0)}
    assert {r.id for r in v.collect()} == {0, 2, 3, 4, 5}
    v, e = skeletons.prune_network(vertices, edges, 1.0)
    assert {(r.v1, r.v2) for r in e.collect()} == {(0, 3), (5, 5)}


def test_line_pixels_touch_the_line():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a, b = rng.uniform(-2, 12, 3), rng.uniform(-2, 12, 3)
        got = generate.line_pixels(tuple(a), tuple(b), (10, 10, 10))
        many = {tuple(np.floor(a + t * (b - a) + 0.5).astype(int)) for t in np.linspace(0, 1, 20_001)}
        inside = {p for p in many if all(0 <= c < 10 for c in p)}
        assert inside <= set(got) and len(got) == len(set(got)) and len(got) - len(inside) <= 1


def test_shape_analysers_equal_brute_force(spark):
    a = np.zeros((9, 8, 7))
    r = np.random.default_rng(4)
    for label in (1, 2):
        for _ in range(12):
            a[tuple(r.integers(0, n) for n in a.shape)] = label
    for row in analyzers.analyze(image_of(spark, a), tuple(analyzers.COLUMNS)).collect():
        p = np.argwhere(a == row.label).astype(float)
        c = p.mean(0)
        assert np.allclose([row.cx, row.cy, row.cz], c) and math.isclose(row.rmax, np.linalg.norm(p - c, axis=1).max())
        values, vectors = np.linalg.eigh(np.cov(p.T, bias=True))
        along = (p - c) @ vectors[:, ::-1]
        assert np.allclose([row.d1, row.d2, row.d3], np.ptp(along, 0)) and np.allclose([row.l1, row.l2, row.l3], np.sqrt(values[::-1]))
        assert math.isclose(row.bounding_scale, np.sqrt((along**2 / values[::-1]).sum(1)).max())
        ball = np.array([row.sphere_x, row.sphere_y, row.sphere_z])
        d = np.linalg.norm(p - ball, axis=1)
        assert d.max() <= row.sphere_r + 1e-6 and (d > row.sphere_r - 1e-6).sum() >= 2
        for move in np.random.default_rng(5).normal(0, 0.05, (40, 3)):
            assert np.linalg.norm(p - ball - move, axis=1).max() >= row.sphere_r - 1e-9
        corners = {(x + i, y + j) for x, y, _ in p for i in (0, 1) for j in (0, 1)}
        outline = analyzers.hull(np.array(sorted(corners)))
        for q, s in zip(outline, np.roll(outline, -1, 0)):
            assert all((s[0] - q[0]) * (y - q[1]) - (s[1] - q[1]) * (x - q[0]) >= -1e-9 for x, y in corners)
        assert row.convex_area >= len({(x, y) for x, y, _ in p}) and row.value == 0


def test_statistic_of_methods(spark):
    im = image_of(spark, noise((8, 8, 4)), "uint8")
    for name in thresholds.METHODS:
        assert 0 <= statistics.auto_threshold_value(im, name) <= 255


def test_sampled_bilateral_is_near_the_whole(spark):
    im = image_of(spark, noise((9, 9, 6), 2))
    whole, part = array_of(neighbourhood.bilateral(im, (1.0, 1.0, 1.0), 80)), array_of(neighbourhood.bilateral_sampled(im, 1.0, 80, 2000))
    assert np.abs(whole - part).mean() < 3 and np.abs(whole - array_of(im)).mean() > 10


def test_slabs_do_not_matter(spark, monkeypatch):
    im = image_of(spark, noise((9, 8, 7), 4))
    whole = [array_of(f()) for f in (lambda: neighbourhood.rank_filter("medianfilter", im), lambda: neighbourhood.local_threshold(im))]
    monkeypatch.setattr(neighbourhood, "STACK_BYTES", 1)
    for a, f in zip(whole, (lambda: neighbourhood.rank_filter("medianfilter", im), lambda: neighbourhood.local_threshold(im))):
        assert (array_of(f()) == a).all()


@pytest.mark.parametrize("text", ["", "1 +", "(1", "1 2", "y1", "raise(1)", "system('x')", "x0; 1", "max(1"])
def test_broken_formulas_are_refused(spark, text):
    with pytest.raises(ValueError):
        formulas.column_of(text, {"x0": F.lit(1.0)})


def test_formulas_keep_precedence(spark):
    row = spark.range(1).select(*[formulas.column_of(t, {"x0": F.lit(3.0)}).alias(f"c{i}") for i, t in enumerate(("-x0^2", "2^3^2", "1 + 2 * 3 < 8", "1 / 0", "10 - 4 - 3", "min(4, x0, 9) * pi", "x0 = 3 ? 7 : 8"))]).first()
    assert row[:3] == (-9.0, 512.0, 1.0) and row[3] is None and row[4] == 3.0 and math.isclose(row[5], 3 * math.pi) and row[6] == 7.0
