"""Raster operators: every query with SQL against DuckDB at the smallest size, and small arrays against NumPy."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from voxara.operators import generate, neighbourhood, pointwise, regions, statistics, transforms
from voxara.plans import raster_queries
from voxara.raster import Image, new_image
from voxara.sources import raw

SF = "/root/testdata/sf0.001"
TABLE = raster_queries.table()


def image_of(spark, a: np.ndarray, dtype="float32") -> Image:
    at = np.indices(a.shape).reshape(3, -1)
    return Image(spark.createDataFrame(pd.DataFrame({"x": at[0], "y": at[1], "z": at[2], "v": a.ravel().astype(float)})), a.shape, dtype)


def array_of(image: Image) -> np.ndarray:
    pdf = image.df.toPandas()
    out = np.full(image.dims, np.nan)
    out[pdf.x, pdf.y, pdf.z] = pdf.v
    assert len(pdf) == image.count
    return out


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in TABLE.items() if sql))
def test_query_matches_sql(spark, name):
    run, sql = TABLE[name]
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want, got = con.execute(sql).df(), run(spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    texts = [c for c in columns if want[c].dtype == object or pd.api.types.is_string_dtype(want[c])]
    a, b = (d[columns].astype({c: str if c in texts else float for c in columns}).round(6).sort_values([*texts, *(c for c in columns if c not in texts)]) for d in (got, want))
    assert (a[texts].to_numpy() == b[texts].to_numpy()).all()
    numbers = [c for c in columns if c not in texts]
    assert np.allclose(a[numbers].to_numpy(), b[numbers].to_numpy(), atol=2e-6, equal_nan=True)


def test_saturation_and_nan(spark):
    a = image_of(spark, np.array([[[250.0]], [[3.0]]]), "uint8")
    assert array_of(pointwise.with_number("add", a, 10)).ravel().tolist() == [255, 13]
    assert array_of(pointwise.with_number("subtract", a, 10)).ravel().tolist() == [240, 0]
    assert array_of(pointwise.convert(image_of(spark, np.array([[[math.nan]], [[2.5]]])), "uint8")).ravel().tolist() == [0, 3]


def test_sizes_must_agree(spark):
    with pytest.raises(ValueError):
        pointwise.with_image("add", new_image(spark, (2, 2, 1)), new_image(spark, (3, 2, 1)))


def test_blocks_agree_with_whole(spark, monkeypatch):
    a = np.random.default_rng(1).integers(0, 255, (9, 8, 7)).astype(float)
    whole = array_of(neighbourhood.gaussian(image_of(spark, a), (1, 1, 1)))
    monkeypatch.setattr(neighbourhood, "BLOCK", (4, 4, 4))
    assert np.allclose(whole, array_of(neighbourhood.gaussian(image_of(spark, a), (1, 1, 1))))


def test_gaussian_keeps_a_constant(spark):
    assert np.allclose(array_of(neighbourhood.gaussian(image_of(spark, np.full((6, 5, 4), 7.0)), (1, 1, 1))), 7)


def test_derivative_of_a_ramp(spark):
    ramp = generate.ramp(new_image(spark, (24, 3, 1), "float32"))
    assert np.allclose(array_of(neighbourhood.derivative(ramp, (1, 1, 1), 0))[8:16], 1, atol=0.02)


@pytest.mark.parametrize("connectivity", ["Nearest", "All"])
def test_labels_agree_with_flood_fill(spark, connectivity):
    a = (np.random.default_rng(2).random((7, 6, 5)) < 0.4).astype(float)
    near = {p for o in regions.FORWARD[connectivity] for p in (o, tuple(-c for c in o))}
    want, n = np.zeros(a.shape), 0
    for z, y, x in np.ndindex(5, 6, 7):
        if a[x, y, z] and not want[x, y, z]:
            n += 1
            todo = [(x, y, z)]
            want[x, y, z] = n
            while todo:
                p = todo.pop()
                for o in near:
                    q = tuple(i + j for i, j in zip(p, o, strict=True))
                    if all(0 <= i < s for i, s in zip(q, a.shape, strict=True)) and a[q] and not want[q]:
                        want[q] = n
                        todo.append(q)
    assert (array_of(regions.label(image_of(spark, a), connectivity=connectivity)) == want).all()


def test_flood_fill_and_small_regions(spark):
    a = np.zeros((5, 5, 1))
    a[0, 0] = a[2:5, 2:5] = 1
    assert array_of(regions.flood_fill(image_of(spark, a), (3, 3, 0), 9)).sum() == 82
    assert array_of(regions.remove_small(image_of(spark, a), 2)).sum() == 9


def test_otsu_parts_two_groups(spark):
    a = np.array([10.0] * 50 + [200.0] * 30).reshape(80, 1, 1)
    assert 10 <= statistics.auto_threshold_value(image_of(spark, a, "uint8")) < 200


def test_raw_round_trip(spark, tmp_path):
    a = np.arange(24.0).reshape(4, 3, 2)
    path = raw.write_raw(image_of(spark, a, "uint16"), str(tmp_path / "a"))
    assert path.endswith("_4x3x2.raw")
    assert (array_of(raw.read_raw(spark, path, "uint16")) == a).all()


def test_table_box(spark, tmp_path):
    a = np.arange(60.0).reshape(4, 3, 5)
    raw.write_table(image_of(spark, a), str(tmp_path / "t"))
    box = raw.read_table(spark, str(tmp_path / "t"), (4, 3, 5), "float32", (1, 1, 2), (2, 2, 2))
    assert (array_of(box) == a[1:3, 1:3, 2:4]).all()


def test_rotations_undo(spark):
    a = np.arange(24.0).reshape(4, 3, 2)
    assert (array_of(transforms.rotate_ccw(transforms.rotate_cw(image_of(spark, a)))) == a).all()
