"""Drawing: pixels inside a shape get a value; each is a projection over the coordinates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxara.raster import AXES, Image, pix, pixel_round


def _places() -> list[Column]:
    return [F.col(a) for a in AXES]


def _fill(image: Image, inside: Column, value: float) -> Image:
    return image.map(F.when(inside, F.lit(float(value))).otherwise(pix()))


def ramp(image: Image, dimension: int = 0) -> Image:
    return image.map(_places()[dimension].cast("double"))


def set_edges(image: Image, value: float = 0.0, radius: int = 1) -> Image:
    edge = F.lit(False)
    for p, n in zip(_places(), image.dims, strict=True):
        if n > 1:
            edge = edge | (p < radius) | (p >= n - radius)
    return _fill(image, edge, value)


def box(image: Image, position: tuple, size: tuple, value: float = 1.0) -> Image:
    inside = F.lit(True)
    for p, a, n in zip(_places(), position, size, strict=True):
        inside = inside & (p >= a) & (p < a + n)
    return _fill(image, inside, value)


def _squared(point: tuple) -> Column:
    return sum(((p - float(c)) * (p - float(c)) for p, c in zip(_places(), point, strict=True)), F.lit(0.0))


def sphere(image: Image, position: tuple, radius: float, value: float = 1.0) -> Image:
    return _fill(image, _squared(position) < radius * radius, value)


def ellipsoid(image: Image, position: tuple, lengths: tuple, value: float = 1.0, first: tuple = (1, 0, 0), second: tuple = (0, 1, 0)) -> Image:
    """Axis directions first, second and their cross product."""
    third = (first[1] * second[2] - first[2] * second[1], first[2] * second[0] - first[0] * second[2], first[0] * second[1] - first[1] * second[0])
    total = F.lit(0.0)
    for axis, length in zip((first, second, third), lengths, strict=True):
        norm = math.sqrt(sum(a * a for a in axis))
        along = sum(((p - float(c)) * (a / norm) for p, c, a in zip(_places(), position, axis, strict=True)), F.lit(0.0))
        total = total + (along / float(length)) * (along / float(length))
    return _fill(image, total < 1, value)


def capsule(image: Image, start: tuple, end: tuple, radius: float, value: float = 1.0) -> Image:
    d = [float(b - a) for a, b in zip(start, end, strict=True)]
    long = sum(c * c for c in d) or 1.0
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(((p - float(a)) * c for p, a, c in zip(_places(), start, d, strict=True)), F.lit(0.0)) / long))
    gap = sum(((p - float(a) - t * c) * (p - float(a) - t * c) for p, a, c in zip(_places(), start, d, strict=True)), F.lit(0.0))
    return _fill(image, gap < radius * radius, value)


def noise(image: Image, mean: float = 0.0, deviation: float = 1.0, seed: int = 0) -> Image:
    """Gaussian noise that depends on seed and coordinates alone (Box-Muller over hashes), so a repeated task gives the same."""
    uniform = lambda k: (F.pmod(F.xxhash64(*_places(), F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return image.map(pix() + mean + deviation * F.sqrt(-2 * F.ln(uniform(1))) * F.cos(2 * math.pi * uniform(2)))


def ramp3(image: Image) -> Image:
    """The sum of a pixel's coordinates."""
    return image.map(sum(_places(), F.lit(0)).cast("double"))


def line_pixels(start: tuple, end: tuple, dims: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    """The pixels that a line passes through, in order; a pixel at (x, y, z) reaches half a pixel to each side. As many as the line is long."""
    a, d = [float(c) for c in start], [float(q) - float(p) for p, q in zip(start, end, strict=True)]
    cuts = {0.0, 1.0}
    for p, length in zip(a, d, strict=True):
        if length:
            low, high = sorted((p, p + length))
            cuts |= {(k + 0.5 - p) / length for k in range(math.floor(low - 0.5) + 1, math.ceil(high - 0.5))}
    ts = sorted(t for t in cuts if 0 <= t <= 1)
    at = lambda t: tuple(math.floor(p + t * length + 0.5) for p, length in zip(a, d, strict=True))
    found = dict.fromkeys(at((t + u) / 2) for t, u in zip(ts, ts[1:], strict=False)) if any(d) else {at(0.0): None}
    return [p for p in found if all(0 <= c < n for c, n in zip(p, dims, strict=True))]


def line(image: Image, start: tuple, end: tuple, value: float = 1.0) -> Image:
    """A line one pixel wide, no longer than the image, drawn by a join of its pixels."""
    drawn = image.df.sparkSession.createDataFrame(line_pixels(start, end, image.dims) or [], "x bigint, y bigint, z bigint").withColumn("hit", F.lit(True))
    return image.with_rows(image.df.join(drawn, list(AXES), "left").select(*AXES, pixel_round(F.when(F.col("hit"), F.lit(float(value))).otherwise(F.col("v")), image.dtype).alias("v")))


def draw_graph(image: Image, vertices: DataFrame, edges: DataFrame, radius: float = 2.0, vertex_color: float = 1.0, edge_color: float = 1.0) -> Image:
    """Edges (id, v1, v2) as lines, then vertices (id, x, y, z) as spheres. Tasks list each line's and sphere's own pixels."""
    side = lambda v, n: vertices.select(F.col("id").alias(v), *[F.col(a).alias(f"{a}{n}") for a in AXES])
    ends = edges.join(side("v1", 1), "v1").join(side("v2", 2), "v2").select(*[f"{a}{n}" for n in (1, 2) for a in AXES])
    dims = image.dims

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [p for r in f.itertuples(index=False) for p in line_pixels(r[:3], r[3:], dims)]
            yield pd.DataFrame(rows, columns=list(AXES), dtype="int64")

    lines = ends.mapInPandas(run, "x bigint, y bigint, z bigint").select(*AXES, F.lit(0).alias("rank"))
    ball = vertices.select(*[F.col(a).alias(f"c{a}") for a in AXES])
    for a, n in zip(AXES, dims, strict=True):
        low, high = F.greatest(F.ceil(F.col(f"c{a}") - radius), F.lit(0)), F.least(F.floor(F.col(f"c{a}") + radius), F.lit(n - 1))
        ball = ball.withColumn(a, F.explode(F.when(low <= high, F.sequence(low, high))))
    far = sum(((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in AXES), F.lit(0.0))
    balls = ball.filter(far < radius * radius).select(*[F.col(a).cast("bigint").alias(a) for a in AXES], F.lit(1).alias("rank"))
    drawn = lines.union(balls).groupBy(*AXES).agg(F.max("rank").alias("rank"))
    colour = F.when(F.col("rank") == 1, float(vertex_color)).when(F.col("rank") == 0, float(edge_color)).otherwise(F.col("v"))
    return image.with_rows(image.df.join(drawn, list(AXES), "left").select(*AXES, pixel_round(colour, image.dtype).alias("v")))
