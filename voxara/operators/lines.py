"""Kernels over lines along one axis: a group holds as many whole lines as PIXELS allows, one at least, and never the volume."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxara.raster import AXES

#: Pixels of a group of lines; a line that alone has more is a group.
PIXELS = 1 << 17
#: Rows of one batch of results.
ROWS = 1 << 16


def edges(others: tuple[int, int], n: int, most: int = 0) -> tuple[int, int]:
    """How many lines of n pixels a group has along each of the other two axes, most at most if that isn't 0."""
    fit = max(1, PIXELS // n)
    short = min(min(others), max(1, math.isqrt(fit)))
    long = min(max(others), max(1, fit // short))
    short, long = (min(short, most), min(long, most)) if most else (short, long)
    return (short, long) if others[0] <= others[1] else (long, short)


def over_lines(df: DataFrame, axis: int, dims: tuple[int, int, int], kernel: Callable[[list[np.ndarray]], Sequence[np.ndarray]], size: int = 0, most: int = 0) -> DataFrame:
    """x, y, z and df's value columns after a kernel over their lines: arrays [line, size] of arrays [line, n]; pixels that df lacks are 0. most: see edges."""
    others = [i for i in range(3) if i != axis]
    columns = [c for c in df.columns if c not in AXES]
    n = dims[axis]
    size = size or n
    edge = edges((dims[others[0]], dims[others[1]]), max(n, size), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays: list[np.ndarray] = []
        for b in batches:
            at = [b.column(a).to_numpy() for a in AXES]
            if not arrays:
                first = [int(at[i][0]) // e * e for i, e in zip(others, edge, strict=True)]
                shape = [min(e, dims[i] - f) for i, e, f in zip(others, edge, first, strict=True)]
                arrays = [np.zeros((*shape, n)) for _ in columns]
            place = (at[others[0]] - first[0], at[others[1]] - first[1], at[axis])
            for values, c in zip(arrays, columns, strict=True):
                values[place] = b.column(c).to_numpy(zero_copy_only=False)
        out = [np.asarray(o).ravel() for o in kernel([a.reshape(-1, n) for a in arrays])]
        for start in range(0, len(out[0]), ROWS):
            i = np.arange(start, min(start + ROWS, len(out[0])))
            line = i // size
            made = {axis: i % size, others[0]: line // shape[1] + first[0], others[1]: line % shape[1] + first[1]}
            yield pa.RecordBatch.from_arrays([pa.array(made[k]) for k in range(3)] + [pa.array(o[start : start + ROWS]) for o in out], names=[*AXES, *columns])

    keys = [F.floor(F.col(AXES[i]) / e).alias(f"g{AXES[i]}") for i, e in zip(others, edge, strict=True)]
    return df.groupBy(*keys).applyInArrow(run, ", ".join(f"{a} bigint" for a in AXES) + "".join(f", {c} double" for c in columns))
