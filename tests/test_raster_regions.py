"""Operators that SQL can't express, on small arrays against plain NumPy."""

import math

import numpy as np
import pytest
from test_raster import array_of, image_of

from voxara.operators import analyzers, distance, neighbourhood, regions, statistics, transforms


def flood(seeds: set, allowed: np.ndarray, steps: list) -> np.ndarray:
    out, todo = np.zeros(allowed.shape, bool), list(seeds)
    for p in todo:
        out[p] = True
    while todo:
        p = todo.pop()
        for o in steps:
            q = tuple(i + j for i, j in zip(p, o, strict=True))
            if all(0 <= i < s for i, s in zip(q, allowed.shape, strict=True)) and allowed[q] and not out[q]:
                out[q] = True
                todo.append(q)
    return out


def steps_of(connectivity: str) -> list:
    return [p for o in regions.FORWARD[connectivity] for p in (o, tuple(-c for c in o))]


def test_envelope_agrees_with_all_pairs():
    r = np.random.default_rng(3)
    for n in (1, 2, 17):
        f = np.where(r.random(n) < 0.6, r.integers(0, 40, n), distance.FAR).astype(float)
        want = [min([f[q] + (p - q) ** 2 for q in range(n) if f[q] < distance.FAR], default=distance.FAR) for p in range(n)]
        assert np.allclose(distance.envelope(f), want)


def test_distance_without_background(spark):
    a = image_of(spark, np.ones((3, 2, 2)))
    assert (array_of(distance.squared_distance(a)) == distance.FAR).all()
    with pytest.raises(ValueError):
        distance.thickness(a)


def test_distance_across_groups(spark, monkeypatch):
    monkeypatch.setattr(distance, "LINES", 2)
    a = (np.random.default_rng(4).random((7, 6, 5)) < 0.9).astype(float)
    zero = np.argwhere(a == 0)
    want = np.array([((zero - p) ** 2).sum(1).min() for p in np.ndindex(a.shape)]).reshape(a.shape)
    assert (array_of(distance.squared_distance(image_of(spark, a))) == want).all()


def test_dual_threshold(spark):
    a = np.random.default_rng(5).integers(0, 100, (8, 7, 3)).astype(float)
    want = flood({tuple(p) for p in np.argwhere(a >= 85)}, a >= 50, steps_of("Nearest"))
    assert (array_of(regions.dual_threshold(image_of(spark, a), 50, 85)) == want).all()


def test_grow_leaves_other_colours(spark):
    a = np.random.default_rng(6).integers(0, 4, (6, 6, 2)).astype(float)
    want = np.where(flood({tuple(p) for p in np.argwhere(a == 2)}, a == 1, steps_of("All")) & (a == 1), 2, a)
    assert (array_of(regions.grow(image_of(spark, a), 2, 1, "All")) == want).all()


def test_local_maxima(spark):
    a = np.random.default_rng(7).integers(0, 5, (7, 6, 3)).astype(float)
    want = np.zeros(a.shape, bool)
    for p in np.ndindex(a.shape):
        if a[p]:
            plateau = flood({p}, a == a[p], steps_of("All"))
            rim = [tuple(i + j for i, j in zip(q, o, strict=True)) for q in np.argwhere(plateau) for o in steps_of("All")]
            want[p] = all(a[q] <= a[p] for q in rim if all(0 <= i < s for i, s in zip(q, a.shape, strict=True)))
    got = array_of(regions.local_maxima(image_of(spark, a)))
    assert ((got > 0) == want).all()
    assert sorted(set(got[got > 0])) == list(range(1, int(got.max()) + 1))


def test_principal_axes(spark):
    a = np.zeros((9, 9, 9))
    a[1:8, 4, 4] = 1
    row = analyzers.analyze(image_of(spark, a), ("pca", "volume")).first()
    assert row.volume == 7 and (row.cx, row.cy, row.cz) == (4, 4, 4)
    assert math.isclose(row.l1, 2) and row.l2 == row.l3 == 0 and math.isclose(row.e, 1)
    assert math.isclose(abs(math.cos(row.phi1) * math.sin(row.theta1)), 1)
    with pytest.raises(ValueError):
        analyzers.analyze(image_of(spark, a), ("girth",))


def test_particles_by_volume(spark):
    a = np.zeros((5, 5, 1))
    a[0, 0] = a[2:5, 2:5] = 1
    rows = regions.analyze_particles(image_of(spark, a), ("coordinates", "isonedge"), least=2).collect()
    assert [(r.x, r.y, r.z, r.isonedge) for r in rows] == [(2, 2, 0, 1)]


@pytest.mark.parametrize("method", ["Median", "MaxEntropy", "Triangle", "IsoData"])
def test_histogram_methods_part_two_groups(spark, method):
    r = np.random.default_rng(8)
    a = np.clip(np.concatenate([r.normal(40, 6, 700), r.normal(200, 6, 300)]).round(), 0, 255).reshape(-1, 1, 1)
    t = statistics.auto_threshold_value(image_of(spark, a, "uint8"), method)
    assert 30 <= t < 200


def test_bilateral_keeps_constants_and_edges(spark):
    a = np.zeros((8, 4, 1))
    a[4:] = 100
    out = array_of(neighbourhood.bilateral(image_of(spark, a), (1, 1, 1), 5))
    assert np.allclose(out, a, atol=1e-6)


def test_local_bernsen(spark):
    a = np.full((5, 5, 1), 200.0)
    assert array_of(neighbourhood.local_threshold(image_of(spark, a, "uint8"), (1, 1, 0), "Bernsen")).sum() == 0


def test_rotation_there_and_back(spark):
    a = np.random.default_rng(9).random((5, 5, 2))
    im = image_of(spark, a)
    c = (2, 2, 0)
    turned = transforms.rotate(transforms.rotate(im, math.pi / 2, input_center=c, output_center=c), -math.pi / 2, input_center=c, output_center=c)
    assert np.allclose(array_of(turned), a)


def test_resample_rejects_unknown_interpolation(spark):
    with pytest.raises(ValueError):
        transforms.shift(image_of(spark, np.ones((2, 2, 1))), (0, 0, 0), "Quintic")


def test_cubic_interpolation_keeps_lines_and_pixels(spark):
    a = np.arange(12.0).reshape(12, 1, 1)
    half = array_of(transforms.shift(image_of(spark, a), (0.5, 0, 0), "Cubic"))
    assert np.allclose(half[2:-2].ravel(), a[2:-2].ravel() - 0.5)
    assert np.allclose(array_of(transforms.shift(image_of(spark, a), (0, 0, 0), "Cubic")), a)
