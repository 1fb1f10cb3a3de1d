"""Raw image files: pixels row by row, x fastest, little-endian; dimensions stand at the end of the name as _WxHxD."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from voxara.raster import AXES, Image

#: Pixels that a task writes at once, a whole line at least.
SPAN = 1 << 18
_SIZES = re.compile(r"_(\d+)x(\d+)(?:x(\d+))?\.raw$")


def dims_of(path: str) -> tuple[int, int, int]:
    m = _SIZES.search(path)
    if not m:
        raise ValueError(f"{path} doesn't end in _WxHxD.raw")
    return int(m[1]), int(m[2]), int(m[3] or 1)


def read_raw(spark: SparkSession, path: str, dtype: str, dims: tuple[int, int, int] | None = None) -> Image:
    """Records of one image row each, so that the file is read in splits."""
    w, h, d = dims or dims_of(path)
    kind = np.dtype(dtype).newbyteorder("<")
    rows = spark.sparkContext.binaryRecords(path, w * kind.itemsize).zipWithIndex().map(lambda r: (r[1], bytearray(r[0])))
    lines = spark.createDataFrame(rows, "line bigint, data binary")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                v = np.concatenate([np.frombuffer(b, kind) for b in f["data"]]).astype(float)
                line = np.repeat(f["line"].to_numpy(), w)
                yield pd.DataFrame({"x": np.tile(np.arange(w), len(f)), "y": line % h, "z": line // h, "v": v})

    return Image(lines.mapInPandas(decode, "x bigint, y bigint, z bigint, v double"), (w, h, d), dtype)


def put_lines(image: Image, path: str, size: int, start: int = 0, line_step: int = 0, slice_step: int = 0, order: str = "<") -> None:
    """Writes an image's lines into a file of size bytes, each with those beside it by a task: line y of slice z at start + y * line_step + z * slice_step.

    The file is made of zeros where it is missing or has another size. Steps of 0 are those of lines one after the other. A task that is run
    again writes the same bytes to the same place. The path must lie where driver and executors can seek in files, such as
    a shared folder; a file:// before it is cut off.
    """
    w, h, d = image.dims
    kind, path = np.dtype(image.dtype).newbyteorder(order), path.removeprefix("file://")
    line_step = line_step or w * kind.itemsize
    slice_step = slice_step or h * line_step
    if not os.path.exists(path) or os.path.getsize(path) != size:
        with open(path, "wb") as f:
            f.truncate(size)

    edge = max(1, SPAN // max(w, 1))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, size, first = np.zeros((0, w), kind), 0, 0
        seen = np.zeros((0, w), bool)
        for b in batches:
            x, y, z = (b.column(a).to_numpy() for a in AXES)
            if not size:
                first = (int(z[0]) * h + int(y[0])) // edge * edge
                size = min(edge, h * d - first)
                lines, seen = np.zeros((size, w), kind), np.zeros((size, w), bool)
            lines[z * h + y - first, x], seen[z * h + y - first, x] = b.column("v").to_numpy().astype(kind), True
        number = first + np.arange(size)
        at = start + number % h * line_step + number // h * slice_step
        whole = seen.all(1)
        # Whole lines one after the other in the file are written at once.
        cuts = np.flatnonzero((np.diff(at) != lines.itemsize * w) | ~whole[1:] | ~whole[:-1]) + 1
        with open(path, "r+b") as f:
            for low, high in zip(np.r_[0, cuts], np.r_[cuts, size], strict=True):
                if whole[low]:
                    f.seek(int(at[low]))
                    f.write(lines[low:high].tobytes())
        yield pa.RecordBatch.from_pydict({"lines": [int(whole.sum())]})

    span = F.floor((F.col("z") * h + F.col("y")) / edge).alias("span")
    written = image.df.groupBy(span).applyInArrow(put, "lines bigint").agg(F.sum("lines")).first()[0] or 0
    if written != h * d:
        raise ValueError(f"{written} lines of {h * d} were written to {path}")


def write_raw(image: Image, prefix: str) -> str:
    """One file, written by the tasks; returns its path."""
    w, h, d = image.dims
    path = f"{prefix}_{w}x{h}x{d}.raw"
    put_lines(image, path, w * h * d * np.dtype(image.dtype).itemsize)
    return path


def write_table(image: Image, path: str) -> None:
    """Pixels as Parquet in blocks along z, so that a box reads few files."""
    image.df.withColumn("zb", (F.col("z") / 64).cast("bigint")).repartition("zb").write.partitionBy("zb").parquet(path)


def read_table(spark: SparkSession, path: str, dims: tuple[int, int, int], dtype: str, position: tuple | None = None, size: tuple | None = None) -> Image:
    """The pixels of a box (all without one), by partition pruning and pushed filters."""
    df = spark.read.parquet(path)
    if position and size:
        df = df.filter((F.col("zb") >= position[2] // 64) & (F.col("zb") <= (position[2] + size[2] - 1) // 64))
        for a, p, n in zip(AXES, position, size, strict=True):
            df = df.filter((F.col(a) >= p) & (F.col(a) < p + n))
        df = df.select(*[(F.col(a) - p).alias(a) for a, p in zip(AXES, position, strict=True)], "v")
        dims = tuple(size)
    return Image(df.select(*AXES, "v"), dims, dtype)
