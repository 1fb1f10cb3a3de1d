"""Cross-sections against brute force with a fixed seed and known cylinders."""

import math

import numpy as np
from pyspark.sql import functions as F
from test_raster import array_of, image_of

from voxara.operators import analyzers, cross_sections
from voxara.plans.script import Session


def plane_of(phi, theta):
    d = np.array([math.sin(theta) * math.cos(phi), math.sin(theta) * math.sin(phi), math.cos(theta)])
    right = np.cross(d, (0, 0, 1))
    if np.linalg.norm(right) < 1e-4:
        right = np.cross(d, (1, 0, 0))
    right /= np.linalg.norm(right)
    return np.cross(right, d), right


def half_away(x):
    return np.trunc(np.round(x, 9) + np.copysign(0.5, x)).astype(int)


def brute(spark, a, energy, phi, theta, radius, count, seed):
    """Rows (position, pixels of the region) in the order of Spark's hash of the seed and positions."""
    at = np.argwhere((a != 0) & (energy != 0))
    df = spark.createDataFrame([tuple(map(int, p)) for p in at], "x bigint, y bigint, z bigint")
    order = sorted(((r.h, r.z, r.y, r.x) for r in df.select(F.xxhash64(F.lit(seed), "x", "y", "z").alias("h"), "*").collect()))
    out = []
    for _, z, y, x in order:
        up, right = plane_of(phi[x, y, z], theta[x, y, z])
        plane, whole = {}, True
        for i in range(-radius, radius + 1):
            for j in range(-radius, radius + 1):
                p = half_away(np.array([x, y, z]) + i * up + j * right)
                if (p < 0).any() or (p >= a.shape).any():
                    whole = False
                    continue
                plane[i, j] = a[tuple(p)]
        if not whole:
            continue
        region, left = {(0, 0)}, [(0, 0)]
        while left:
            i, j = left.pop()
            for n in ((i + k, j + m) for k in (-1, 0, 1) for m in (-1, 0, 1)):
                if n not in region and plane.get(n) == plane[0, 0]:
                    region.add(n)
                    left.append(n)
        if len(region) > 3 and all(max(abs(i), abs(j)) < radius for i, j in region):
            out.append(((x, y, z), {(i + radius, j + radius) for i, j in region}, up, right))
    return out[:count]


def test_sections_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    a = (rng.random((13, 12, 11)) < 0.35).astype(float) * 3
    energy = (rng.random(a.shape) < 0.8).astype(float)
    phi, theta = rng.uniform(-math.pi, math.pi, a.shape), rng.uniform(0, math.pi, a.shape)
    theta[:, :, 5] = 0
    length = rng.integers(1, 4, a.shape).astype(float)
    images = [image_of(spark, x) for x in (a, energy, phi, theta)]
    for count in (5, 1000):
        want = brute(spark, a, energy, phi, theta, 3, count, 7)
        got = sorted(cross_sections.cross_sections(*images, radius=3, count=count, seed=7, length=image_of(spark, length)).collect(), key=lambda r: r.number)
        assert len(got) == len(want) > 0 and [r.number for r in got] == list(range(len(got)))
        padded = np.pad(length, 2)
        for r, (pos, region, up, right) in zip(got, want, strict=True):
            assert (r.x3, r.y3, r.z3) == pos and {(n // 7, n % 7) for n in r.region} == region and r.volume == len(region)
            centre = np.mean(list(region), axis=0)
            assert np.allclose((r.cx2, r.cy2), centre) and np.allclose((r.cx3, r.cy3, r.cz3), np.array(pos) + (centre[0] - 3) * up + (centre[1] - 3) * right)
            samples = []
            for i, j in region:
                p = np.round(np.array(pos) + (i - 3) * up + (j - 3) * right, 9)
                low = np.floor(p).astype(int)
                samples.append(round(sum(np.prod(np.where(o, p - low, 1 - (p - low))) * padded[tuple(low + o + 2)] for o in map(np.array, np.ndindex(2, 2, 2))), 9))
            assert np.isclose(r.length_min, min(samples)) and np.isclose(r.length_max, max(samples)) and np.isclose(r.length_mean, np.mean(samples))


def test_measurements_are_those_of_labels(spark):
    points = np.argwhere(np.random.default_rng(2).random((6, 5)) < 0.5)
    a = np.zeros((6, 5, 1))
    a[points[:, 0], points[:, 1], 0] = 1
    points = points[np.lexsort((points[:, 0], points[:, 1]))]
    want = analyzers.analyze(image_of(spark, a), cross_sections.ANALYZERS).first()
    got = cross_sections.measured(points)
    assert all(np.isclose(got[c], want[c]) for c in analyzers.headers(cross_sections.ANALYZERS)[1:])


def test_sections_of_a_cylinder(spark):
    at = np.indices((24, 24, 24)) - 11.5
    along = np.array([1.0, 1.0, 0.0]) / math.sqrt(2)
    far = at - (along[:, None, None, None] * np.tensordot(along, at, 1))
    rod = ((far**2).sum(0) <= 16).astype(float)
    ones = np.ones(rod.shape)
    found = cross_sections.cross_sections(*(image_of(spark, x) for x in (rod, ones, ones * math.pi / 4, ones * math.pi / 2)), radius=7, count=20)
    rows = found.collect()
    assert len(rows) == 20 and abs(np.mean([r.volume for r in rows]) - math.pi * 16) < 5
    assert all(np.linalg.norm(np.cross(np.array([r.cx3, r.cy3, r.cz3]) - 11.5, along)) < 0.7 for r in rows)
    image = cross_sections.slices(found, 7, 20)
    assert array_of(image).shape == (15, 15, 20)
    filled = array_of(cross_sections.slices(found, 7, 20, 9.0))
    assert [int((filled[:, :, r.number] == 9).sum()) for r in rows] == [r.volume for r in rows]
    drawn = array_of(cross_sections.marked(image_of(spark, rod), found, 7, 5))
    assert set(np.unique(drawn)) == {0.0, 5.0}


def test_no_section_and_commands(spark):
    a = np.zeros((9, 9, 9))
    a[3:6, 3:6, :] = 1
    session = Session(spark)
    for name, x in (("o", a), ("e", a), ("p", a * 0), ("t", a * 0), ("n", a * 0)):
        session.images[name] = image_of(spark, x)
    session.run("csa(o, n, p, t, none, 3, 5)\ncsa(o, e, p, t, some, 3, 5, 9, cuts, drawn, e)\ncsaheaders()")
    assert session.tables["none"].count() == 0
    rows = session.tables["some"].collect()
    assert len(rows) == 5 and {(r.volume, r.length_mode) for r in rows} == {(9, 1.0)}
    assert array_of(session.images["cuts"]).shape == (7, 7, 5) and array_of(session.images["drawn"]).shape == a.shape
    assert session.output[-1].endswith("length_mode")
