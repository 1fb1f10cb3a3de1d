"""What a group of lines, a label or a file may hold on larger tables, and the same results beside it."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxara.operators import analyzers, distance, lines, regions
from voxara.raster import Image
from voxara.sources import files, raw, volumes


def test_equal_distances_take_the_last_place_and_long_gaps_their_envelope(monkeypatch):
    rng = np.random.default_rng(5)
    for offsets in (64, 2):
        monkeypatch.setattr(distance, "OFFSETS", offsets)
        f = np.where(rng.random((40, 30)) < 0.2, rng.integers(0, 60, (40, 30)).astype(float), distance.FAR)
        f[0] = distance.FAR
        f[1] = np.where(np.arange(30) == 29, 3.0, distance.FAR)
        cost = f[:, None, :] + (np.arange(30)[:, None] - np.arange(30)) ** 2.0
        want = 29 - np.argmin(cost[:, :, ::-1], axis=2)
        got = distance.nearest_apexes(f)
        assert (got[1:] == want[1:]).all()
        assert (got[0] == np.arange(30)).all() and (distance.envelopes(f, got)[0] == distance.FAR).all()


def test_a_long_line_is_a_group_of_its_own(spark, monkeypatch):
    assert lines.edges((8, 8), 2_000_000) == (1, 1)
    assert max(a * b * 700 for a, b in [lines.edges((8, 5000), 700)]) <= lines.PIXELS
    monkeypatch.setattr(lines, "PIXELS", 12)
    monkeypatch.setattr(lines, "ROWS", 7)
    w, h, d = dims = (3, 4, 20)
    v = np.random.default_rng(6).integers(0, 9, dims).astype(float)
    df = spark.createDataFrame([(*map(int, p), float(v[p])) for p in np.ndindex(dims)], "x bigint, y bigint, z bigint, v double")
    sizes = lines.over_lines(df, 2, dims, lambda a: [np.full(a[0].shape, len(a[0]), float)]).select("v").distinct().collect()
    assert [r.v for r in sizes] == [1.0]
    for axis in range(3):
        pdf = lines.over_lines(df, axis, dims, lambda a: [np.cumsum(a[0], 1)]).toPandas()
        got = np.zeros(dims)
        got[pdf["x"], pdf["y"], pdf["z"]] = pdf["v"]
        assert len(pdf) == w * h * d and (got == np.cumsum(v, axis)).all()


def test_a_label_is_measured_by_its_outermost_pixels(spark):
    n = 3000
    rows = [(x, y, z, 7.0) for z in range(n) for x in range(3) for y in range(2)] + [(10 + i, 2 * i, i % 3, 9.0) for i in range(4)] + [(30, 3, 5, 4.0), (33, 3, 5, 5.0)]
    im = Image(spark.createDataFrame(rows, "x bigint, y bigint, z bigint, v double"), (40, 12, n))
    labelled = im.df.selectExpr("x", "y", "z", "cast(v as bigint) as label")
    kept = {r.label: r.n for r in analyzers.corners(labelled).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert kept[7] == 4
    got = {r.label: r for r in analyzers.analyze(im, tuple(c for c in analyzers.COLUMNS if c != "surfacearea")).collect()}
    for label in (7, 9, 4, 5):
        p = np.array([r[:3] for r in rows if r[3] == label], float)
        r = got[label]
        assert np.allclose([r.cx, r.cy, r.cz], p.mean(0)) and r.volume == len(p)
        assert np.allclose(sorted([r.l1, r.l2, r.l3]), np.sqrt(np.maximum(np.linalg.eigvalsh(np.cov(p.T, bias=True)), 0)), atol=1e-6)
        assert np.isclose(r.rmax, np.sqrt(((p - p.mean(0)) ** 2).sum(1).max()))
        centre, radius = analyzers.bounding_ball(p)
        assert np.allclose([r.sphere_x, r.sphere_y, r.sphere_z, r.sphere_r], [*centre, radius])
        assert np.allclose([r.convex_area, r.convex_perimeter], analyzers.hull_measures(p[:, :2]))
        axis = np.array([np.sin(r.theta1) * np.cos(r.phi1), np.sin(r.theta1) * np.sin(r.phi1), np.cos(r.theta1)])
        along = (p - p.mean(0)) @ axis
        assert np.isclose(r.d1, max(along.max(), 0) - min(along.min(), 0))


def test_frames_are_cut_between_labels():
    frames = [pd.DataFrame({"label": part}) for part in ([1, 1, 2], [2, 2], [2], [3, 4], [], [4], [5])]
    assert [f["label"].tolist() for f in analyzers.whole_labels(iter(frames))] == [[1, 1], [2, 2, 2, 2, 3], [4, 4], [5]]


def test_lines_and_slices_go_to_files_in_spans(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(raw, "SPAN", 40)
    dims = (5, 3, 11)
    v = np.random.default_rng(7).integers(0, 250, dims).astype(float)
    im = Image(spark.createDataFrame([(*map(int, p), float(v[p])) for p in np.ndindex(dims)], "x bigint, y bigint, z bigint, v double"), dims, "uint16")
    files.write_nrrd(im, f"{tmp_path}/a.nrrd")
    volumes.write_tiff(im, f"{tmp_path}/a.tif")
    assert files.write_sequence(im, str(tmp_path)).count() == 11
    for path in ("a.nrrd", "a.tif", "*.png"):
        back = volumes.read_image(spark, f"{tmp_path}/{path}")
        pdf, got = back.df.toPandas(), np.full(dims, -1.0)
        got[pdf["x"], pdf["y"], pdf["z"]] = pdf["v"]
        assert back.dims == dims and len(pdf) == v.size and (got == v).all(), path
    runs = list(files.slices_of(bytes(range(66)) * 5, dims, 2))
    assert [len(f["data"][0]) for f in runs] == [60] * 5 + [30] and [int(f["z"][0]) for f in runs] == [0, 2, 4, 6, 8, 10]
    gap = Image(im.df.filter("not (x = 2 and y = 1 and z = 4)"), dims, "uint16")
    with pytest.raises(ValueError, match="32 lines of 33"):
        raw.write_raw(gap, f"{tmp_path}/gap")


def test_a_sequence_is_read_by_few_tasks(spark, tmp_path):
    dims = (3, 2, 150)
    v = np.arange(900).reshape(dims) % 251.0
    im = Image(spark.createDataFrame([(*map(int, p), float(v[p])) for p in np.ndindex(dims)], "x bigint, y bigint, z bigint, v double"), dims, "uint8")
    files.write_sequence(im, str(tmp_path)).count()
    (tmp_path / "note.txt").write_text("no image")
    back = files.read_sequence(spark, f"{tmp_path}/*.png")
    assert back.dims == dims and back.df.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert {(r.x, r.y, r.z): r.v for r in back.df.collect()} == {p: v[p] for p in np.ndindex(dims)}
    with pytest.raises(Exception, match="No image matches"):
        files.read_sequence(spark, f"{tmp_path}/*.PNG")


def test_local_maxima_read_neighbours_within_blocks(spark, monkeypatch):
    def no_rows(*_):
        raise AssertionError("a row for each neighbour")

    monkeypatch.setattr(regions, "_shifted", no_rows)
    for dims in ((9, 1, 70), (6, 5, 4)):
        v = np.random.default_rng(8).integers(-3, 40, dims).astype(float)
        im = Image(spark.createDataFrame([(*map(int, p), float(v[p])) for p in np.ndindex(dims)], "x bigint, y bigint, z bigint, v double"), dims, "float32")
        got = {(r.x, r.y, r.z): r.v for r in regions.local_maxima(im).df.collect()}
        near = lambda p: [q for q in np.ndindex(dims) if q != p and max(abs(a - b) for a, b in zip(p, q, strict=True)) == 1]  # noqa: B023, E731
        region, number = {}, 0
        for p in sorted((p for p in np.ndindex(dims) if v[p] != 0), key=lambda p: p[::-1]):
            if p in region:
                continue
            part = [p]
            for q in part:
                part += [r for r in near(q) if v[r] == v[p] and r not in part]
            top = all(v[r] <= v[p] for q in part for r in near(q))
            number += top
            region |= dict.fromkeys(part, float(number) if top else 0.0)
        assert got == {p: region.get(p, 0.0) for p in np.ndindex(dims)}


def test_hulls_and_balls_of_many_labels_are_measured_side_by_side():
    rng = np.random.default_rng(9)
    box = np.array(list(np.ndindex(3, 3, 3)))
    parts = [rng.integers(0, size, (n, 3)) for n in (1, 2, 3, 4, 5, 9, 40) for size in ((1, 1, 9), (2, 1, 3), (3, 3, 3), (8, 8, 500), (9, 1, 9)) for _ in range(6)]
    parts += [box, box[box[:, 0] == 1], np.array([(x, x * x if x < 30 else -900, 0) for x in range(31)]), np.array([(0, 0, 0), (5, 3, 0), (0, 0, 2000), (1, 7, 1999)]) + [0, 0, 600_000]]
    start = np.cumsum([0] + [len(p) for p in parts[:-1]])
    points = np.concatenate(parts)
    areas, perimeters = analyzers.hulls_measures(points[:, :2], start)
    centres, radii = analyzers.bounding_balls(points, start)
    for p, area, perimeter, centre, radius in zip(parts, areas, perimeters, centres, radii, strict=True):
        c = analyzers.hull(np.vstack([p[:, :2] + d for d in ((0, 0), (1, 0), (0, 1), (1, 1))]))
        after = np.roll(c, -1, 0)
        assert np.isclose(area, abs((c[:, 0] * after[:, 1] - c[:, 1] * after[:, 0]).sum()) / 2)
        assert np.isclose(perimeter, np.sqrt(((after - c) ** 2).sum(1)).sum())
        d = np.linalg.norm(p - centre, axis=1)
        assert d.max() <= radius + 1e-8
        # A ball is the smallest if the points on it surround its centre: no direction leads nearer to all of them.
        on = (p - centre)[d >= radius - 1e-7 * (1 + radius)]
        steps = np.vstack([rng.normal(size=(300, 3)), on, -on])
        assert radius == 0 or ((steps @ on.T).min(1) <= 1e-6 * (1 + radius) * np.linalg.norm(steps, axis=1)).all()
