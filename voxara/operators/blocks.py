"""Kernels over dense blocks with halos: one shuffle brings a block and its halo to one task, whatever the radius."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxara.raster import AXES, Image, check_same, pixel_round

#: Pixels of a block along each axis.
BLOCK = (64, 64, 64)
Kernel = Callable[[list[np.ndarray], tuple[int, int, int]], Sequence[np.ndarray]]


def joined(images: Sequence[Image]) -> DataFrame:
    """x, y, z, v0, v1 ...: images of one size, pixel by pixel."""
    df = images[0].df.select(*AXES, F.col("v").alias("v0"))
    for i, im in enumerate(images[1:], 1):
        check_same(images[0], im)
        df = df.join(im.df.select(*AXES, F.col("v").alias(f"v{i}")), list(AXES))
    return df


Fold = Callable[[list[np.ndarray], tuple[int, int, int]], pd.DataFrame]


def fold_blocks(df: DataFrame, dims: tuple[int, int, int], fold: Fold, schema: str, halo: tuple[int, int, int] = (0, 0, 0), boundary: str = "Nearest") -> DataFrame:
    """The rows that fold makes of each block: of its value columns' arrays [x, y, z] with halos, and its first pixel.

    Value columns are all of df but x, y and z, in order. Outside the image pixels are 0 (Zero) or the nearest ones
    (Nearest; an axis of one pixel has no halo); pixels that df lacks are 0.
    """
    if boundary == "Nearest":
        halo = tuple(r if n > 1 else 0 for r, n in zip(halo, dims, strict=True))
    columns = [c for c in df.columns if c not in AXES]
    inside = F.lit(True)
    for a, n, d, r in zip(AXES, BLOCK, dims, halo, strict=True):
        df = df.withColumn(f"b{a}", F.explode(F.sequence(F.floor((F.col(a) - r) / n), F.floor((F.col(a) + r) / n))))
        inside = inside & (F.col(f"b{a}") >= 0) & (F.col(f"b{a}") * n < d)
    block = BLOCK

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = tuple(int(pdf[f"b{a}"].iloc[0]) * n for a, n in zip(AXES, block, strict=True))
        stop = [min(f + n, d) for f, n, d in zip(first, block, dims, strict=True)]
        low = [max(0, f - r) for f, r in zip(first, halo, strict=True)]
        high = [min(d, s + r) for d, s, r in zip(dims, stop, halo, strict=True)]
        pads = [(w - (f - r), s + r - h) for w, f, r, s, h in zip(low, first, halo, stop, high, strict=True)]
        place = tuple(pdf[a].to_numpy() - w for a, w in zip(AXES, low, strict=True))
        arrays = []
        for c in columns:
            values = np.zeros([h - w for h, w in zip(high, low, strict=True)])
            values[place] = pdf[c].to_numpy()
            arrays.append(np.pad(values, pads, mode="edge" if boundary == "Nearest" else "constant"))
        return fold(arrays, first)

    return df.filter(inside).groupBy("bx", "by", "bz").applyInPandas(run, schema)


def over_blocks(df: DataFrame, dims: tuple[int, int, int], kernel: Kernel, halo: tuple[int, int, int] = (0, 0, 0), boundary: str = "Nearest", outputs: int = 1) -> DataFrame:
    """x, y, z, v0 ... of the outputs of a kernel over df's value columns: arrays of the block alone, of arrays with its halo (see fold_blocks)."""
    halo = tuple(r if n > 1 else 0 for r, n in zip(halo, dims, strict=True))

    def pixels(arrays: list[np.ndarray], first: tuple[int, int, int]) -> pd.DataFrame:
        out = kernel(arrays, first)
        at = np.indices(out[0].shape).reshape(3, -1)
        return pd.DataFrame({**{a: at[i] + first[i] for i, a in enumerate(AXES)}, **{f"v{i}": np.asarray(o).ravel().astype(float) for i, o in enumerate(out)}})

    schema = "x bigint, y bigint, z bigint" + "".join(f", v{i} double" for i in range(outputs))
    return fold_blocks(df, dims, pixels, schema, halo, boundary)


def as_image(image: Image, df: DataFrame, column: str = "v0", dtype: str | None = None) -> Image:
    """An image of image's size from a column of a block result."""
    kind = dtype or image.dtype
    return image.with_rows(df.select(*AXES, pixel_round(F.col(column), kind).alias("v")), dtype=kind)
