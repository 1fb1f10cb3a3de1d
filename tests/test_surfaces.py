"""Surface areas and curvatures against known bodies and brute force."""

import heapq
import itertools
import math
from collections import Counter

import numpy as np
import pytest
from test_raster import array_of, image_of

from voxara.operators import analyzers, blocks, surfaces
from voxara.plans.script import Session


def ball(size, radius):
    return (((np.indices((size,) * 3) - (size - 1) / 2) ** 2).sum(0) <= radius**2).astype(float)


def area_of(spark, a, level=0.5):
    return surfaces.surface_area(image_of(spark, a), level).first()["v"]


def test_polygons_of_neighbouring_cells_meet():
    a = np.pad(np.random.default_rng(1).integers(0, 2, (5, 6, 7)), 1)
    sides = Counter()
    for at in np.ndindex(*(n - 1 for n in a.shape)):
        mask = sum(int(a[tuple(np.add(at, c))]) << i for i, c in enumerate(surfaces.CORNERS))
        for t in surfaces.triangles(mask):
            corners = [tuple(sorted(tuple(np.add(at, surfaces.CORNERS[c])) for c in surfaces.EDGES[e])) for e in t]
            for pair in itertools.combinations(corners, 2):
                sides[frozenset(pair)] += 1
    assert sides and {n % 2 for n in sides.values()} == {0}


def test_cases_have_areas_of_their_turns():
    def turned(mask, axes, flips):
        return sum(1 << sum((c >> axes[i] & 1 ^ flips[i]) << i for i in range(3)) for c in range(8) if mask >> c & 1)

    table = surfaces.case_areas(0.5)
    assert table[0] == table[255] == 0
    for mask in (1, 3, 7, 15, 9):  # loops that are flat or have one way to be cut
        for axes in itertools.permutations(range(3)):
            for flips in itertools.product((0, 1), repeat=3):
                assert math.isclose(table[turned(mask, axes, flips)], table[mask], abs_tol=1e-12) or mask == 7
    assert math.isclose(table[1], math.sqrt(3) / 8) and math.isclose(table[15], 1)


@pytest.mark.parametrize("block", [(3, 4, 2), (64, 64, 64)])
def test_areas_of_known_bodies(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    one = np.zeros((4, 4, 4))
    one[1, 2, 1] = 1
    assert math.isclose(area_of(spark, one), math.sqrt(3))
    slab = np.zeros((6, 5, 7))
    slab[:, :, 2:4] = 200.0
    assert math.isclose(area_of(spark, slab, 1.0), 2 * 5 * 4)
    assert area_of(spark, np.ones((4, 4, 4)), 0.5) == 0 and area_of(spark, np.ones((4, 4, 1)), 0.5) == 0
    r = ball(14, 5)
    assert 1.0 < area_of(spark, r) / (4 * math.pi * 25) < 1.13


def test_grey_values_place_the_surface(spark):
    at = np.indices((16, 16, 16)) - 7.5
    smooth = np.maximum(0, 20 - np.sqrt((at**2).sum(0)) * 2)
    assert math.isclose(area_of(spark, smooth, 10.0), 4 * math.pi * 25, rel_tol=0.02)


@pytest.mark.parametrize("block", [(3, 4, 2), (64, 64, 64)])
def test_label_areas(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    a = np.random.default_rng(2).integers(0, 4, (7, 6, 5)).astype(float)
    got = {r.label: r.surface_area for r in surfaces.label_areas(image_of(spark, a)).collect()}
    for label in (1, 2, 3):
        padded = np.pad((a == label) * 255.0, 1)
        cells = np.stack([padded[c[0] : c[0] + 8, c[1] : c[1] + 7, c[2] : c[2] + 6] for c in surfaces.CORNERS], axis=-1).reshape(-1, 8)
        assert math.isclose(got[label], surfaces.areas(cells, 128.0).sum())
    rows = analyzers.analyze(image_of(spark, a), ("surfacearea", "volume")).collect()
    assert {r.label: r.surface_area for r in rows} == got and sum(r.volume for r in rows) == (a > 0).sum()


def brute_curvature(a, radius, zero=False):
    """{pixel: (kappa1, kappa2)} with neighbourhoods grown pixel by pixel from a queue of distances."""
    shape = a.shape

    def value(p):
        if zero and any(not 0 <= c < n for c, n in zip(p, shape, strict=True)):
            return 0
        return a[tuple(min(max(c, 0), n - 1) for c, n in zip(p, shape, strict=True))]

    steps = [d for d in itertools.product((-1, 0, 1), repeat=3) if any(d)]
    plus = lambda p, d: tuple(x + y for x, y in zip(p, d, strict=True))
    faces = [d for d in steps if sum(map(abs, d)) == 1]
    surface = {p for p in np.ndindex(*shape) if a[p] and any(not value(plus(p, d)) for d in faces)}
    out = {}
    for p0 in surface:
        known, queue, normal = {}, [(0.0, p0)], None
        while queue:
            later = []
            while queue:
                far, p = heapq.heappop(queue)
                if p in known and known[p] <= far:
                    continue
                known[p] = far
                for d in steps:
                    t = plus(p, d)
                    further = far + math.sqrt(sum(c * c for c in d))
                    if t in surface and further <= radius + 1e-6:
                        flat = lambda q: sum(c * c for c in q) - np.dot(q, normal) ** 2  # noqa: B023, E731
                        if normal is None or flat(np.subtract(t, p0)) >= flat(np.subtract(p, p0)) - 1e-5:
                            heapq.heappush(later, (further, t))
            points = np.array(list(known), float)
            if len(points) >= 3:
                normal = np.linalg.eigh(np.cov(points.T, bias=True))[1][:, 0]
            queue = later
        points = np.array(list(known), float)
        axes = np.linalg.eigh(np.cov(points.T, bias=True))[1] if len(points) > 1 else np.eye(3)
        n = axes[:, 0]
        empty = [d for d in steps if not value(plus(p0, d))]
        if sum(np.dot(d, n) > 0 for d in empty) < len(empty) / 2:
            n = -n
        x, y, z = (points - p0) @ axes[:, 2], (points - p0) @ axes[:, 1], (points - p0) @ n
        m = np.stack([x * x, x * y, y * y, np.ones_like(x)], axis=1)
        values = np.linalg.eigvalsh(m.T @ m)
        if values[0] <= 1e-9 * values[-1]:
            out[p0] = (math.nan, math.nan)
            continue
        ca, cb, cc, _ = np.linalg.lstsq(m, z, rcond=None)[0]
        root = math.hypot(ca - cc, cb)
        out[p0] = (ca + cc + root, ca + cc - root)
    return out


@pytest.mark.parametrize("block", [(4, 5, 6), (64, 64, 64)])
@pytest.mark.parametrize("boundary", ["Nearest", "Zero"])
def test_curvature_equals_brute_force(spark, monkeypatch, block, boundary):
    monkeypatch.setattr(blocks, "BLOCK", block)
    # An uneven body: equal variances along two axes would leave frames, and thus normals, to chance.
    at = np.indices((11, 9, 10)).reshape(3, -1).T
    skew = (at - [4.6, 4.2, 5.3]) @ np.array([[0.21, 0.03, 0.02], [0.05, 0.27, 0.04], [0.01, 0.06, 0.24]])
    a = ((skew**2).sum(1) < 1).reshape(11, 9, 10)
    a[8:, 1:4, 2:5] |= True
    want = brute_curvature(a, 2.5, boundary == "Zero")
    k1, k2 = (array_of(k) for k in surfaces.curvature(image_of(spark, a), 2.5, boundary))
    got = {p: (k1[p], k2[p]) for p in np.ndindex(*a.shape) if not math.isnan(k1[p])}
    real = {p for p, k in want.items() if not math.isnan(k[0])}
    assert set(got) == real
    near = [p for p in real if np.allclose(got[p], want[p], atol=1e-6)]
    assert len(near) >= 0.97 * len(real)


def test_curvatures_of_balls_and_cylinders(spark):
    k1, k2 = (array_of(k) for k in surfaces.curvature(image_of(spark, ball(23, 9.5)), 5))
    assert abs(np.nanmedian(k1) + 1 / 9.5) < 0.04 and abs(np.nanmedian(k2) + 1 / 9.5) < 0.04
    at = np.indices((21, 21, 12)) - 10.0
    rod = ((at[:2] ** 2).sum(0) <= 64).astype(float)
    k1, k2 = (array_of(k)[:, :, 5:7] for k in surfaces.curvature(image_of(spark, rod), 4))
    assert abs(np.nanmedian(k1)) < 0.03 and abs(np.nanmedian(k2) + 1 / 8) < 0.04
    k1, k2 = (array_of(k)[:, :, 5:7] for k in surfaces.curvature(image_of(spark, 1 - rod), 4, "Nearest", 0.0))
    assert abs(np.median(k1[k1 != 0]) - 1 / 8) < 0.04 and k1.min() >= k2.min()


def test_surface_commands(spark):
    session = Session(spark)
    session.images["b"] = image_of(spark, ball(11, 4))
    session.run("surfacearea(b, s, 0.5)\ncurvature(b, 3, p, q)")
    assert session.images["p"].df.filter("v is null").isEmpty() and not session.images["p"].df.filter("isnan(v)").isEmpty()
    assert math.isclose(session.values["s"], area_of(spark, ball(11, 4)))
    assert array_of(session.images["p"]).shape == array_of(session.images["q"]).shape == (11, 11, 11)
