"""Commands with tables against the operators' meaning on small arrays."""

import numpy as np
import pytest
from test_raster import array_of, image_of

from voxara.plans.script import Session


@pytest.fixture
def session(spark):
    s = Session(spark)
    rng = np.random.default_rng(1)
    s.arrays = {n: rng.integers(0, 8, (6, 5, 4)).astype(float) for n in "abw"}
    s.images |= {n: image_of(spark, a, "uint8") for n, a in s.arrays.items()}
    return s


def test_histograms_of_two_images(session):
    a, b, w = (session.arrays[n].ravel() for n in "abw")
    session.run("whist(a, w, h, 0, 8, 4)\nhist2(a, 0, 8, 4, b, 0, 8, 2, t)\nwhist2(a, 0, 8, 4, b, 0, 8, 2, w, u)")
    assert [r.n for r in session.tables["h"].orderBy("bin").collect()] == np.histogram(a, 4, (0, 8), weights=w)[0].tolist()
    for name, weights in (("t", None), ("u", w)):
        want = np.histogram2d(a, b, (4, 2), ((0, 8), (0, 8)), weights=weights)[0]
        got = np.zeros((4, 2))
        for r in session.tables[name].collect():
            got[r.bin_a, r.bin_b] = r.n
        assert np.allclose(got, want)


def test_labels_cylinders_and_pixels(session, spark):
    a = session.arrays["a"]
    session.tables["p"] = spark.createDataFrame([(0, 1.4, 2.0, 3.0), (1, 9.0, 0.0, 0.0)], "id int, x double, y double, z double")
    session.run("newimage(big, uint8, 12, 5, 8)\nscalelabels(a, big)\nscalelabels(a, twice, [2, 1, 1])\nget(a, q, p)\ncarttocyl(a, c, [3, 4, 4], [2, 2, 0])")
    assert np.array_equal(array_of(session.images["big"]), a.repeat(2, 0).repeat(2, 2)) and np.array_equal(array_of(session.images["twice"]), a.repeat(2, 0))
    assert [r.v for r in session.tables["q"].orderBy("id").collect()] == [a[1, 2, 3], None]
    c = array_of(session.images["c"])
    assert np.array_equal(c[2], np.stack([a[4, 2], a[2, 4], a[0, 2], a[2, 0]]))


def test_displacements(session, spark):
    grid = [(i, j, k, 1.0, 0.0, 0.0) for i in range(2) for j in range(2) for k in range(2)]
    session.tables["d"] = spark.createDataFrame(grid, "i bigint, j bigint, k bigint, sx double, sy double, sz double")
    session.tables["p"] = spark.createDataFrame([(0, 2.0, 1.0, 1.0)], "point bigint, x double, y double, z double")
    session.run("pullback(a, back, [0, 0, 0], [5, 4, 3], [6, 5, 4], d)\npointstodeformed(p, q, [0, 0, 0], [5, 4, 3], [6, 5, 4], d)\nfilterdisplacements(d, f)")
    assert np.array_equal(array_of(session.images["back"])[:5], session.arrays["a"][1:])
    assert tuple(session.tables["q"].first()) == (0, 3.0, 1.0, 1.0) and session.tables["f"].filter("sx is null").isEmpty()
    with pytest.raises(ValueError):
        session.run("pullback(a, back, [0, 0, 0], [5, 4, 3], [6, 5, 4], d, Cubic)")


@pytest.mark.parametrize(("name", "want"), [("real", lambda z: z.real), ("imag", lambda z: z.imag), ("conjugate", np.conj), ("arg", np.angle), ("normalize", lambda z: z / abs(z)), ("normsquared", lambda z: abs(z) ** 2)])
def test_complex_pixels(session, name, want):
    z = session.arrays["a"] + 1j * (session.arrays["b"] + 1)
    session.run(f"add(b, 1)\ncomplex(a, b, z)\n{name}(z)\nrealimage(z, r)")
    rows = session.tables["z"].toPandas()
    got = np.zeros(z.shape, complex)
    got[rows.x, rows.y, rows.z] = rows.re + 1j * rows.im
    assert np.allclose(got, want(z)) and np.allclose(array_of(session.images["r"]), want(z).real)
