"""Geometry: filters and projections over the coordinates, which need no shuffle, and interpolated resampling."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxara.raster import AXES, Image, new_image, pixel_round


def crop(image: Image, position: tuple, size: tuple) -> Image:
    df = image.df
    for a, p, n in zip(AXES, position, size, strict=True):
        df = df.filter((F.col(a) >= p) & (F.col(a) < p + n))
    return image.with_rows(df.select(*[(F.col(a) - p).alias(a) for a, p in zip(AXES, position, strict=True)], "v"), tuple(size))


def flip(image: Image, dimension: int) -> Image:
    return image.with_rows(image.df.select(*[(image.dims[i] - 1 - F.col(a) if i == dimension else F.col(a)).alias(a) for i, a in enumerate(AXES)], "v"))


def rotate_cw(image: Image) -> Image:
    w, h, d = image.dims
    return image.with_rows(image.df.select((h - 1 - F.col("y")).alias("x"), F.col("x").alias("y"), "z", "v"), (h, w, d))


def rotate_ccw(image: Image) -> Image:
    w, h, d = image.dims
    return image.with_rows(image.df.select(F.col("y").alias("x"), (w - 1 - F.col("x")).alias("y"), "z", "v"), (h, w, d))


def reslice(image: Image, direction: str) -> Image:
    """The face named by direction becomes the first slice."""
    w, h, d = image.dims
    out = {
        "top": ((F.col("x"), F.col("z"), F.col("y")), (w, d, h)), "bottom": ((F.col("x"), d - 1 - F.col("z"), h - 1 - F.col("y")), (w, d, h)),
        "left": ((F.col("z"), F.col("y"), F.col("x")), (d, h, w)), "right": ((d - 1 - F.col("z"), F.col("y"), w - 1 - F.col("x")), (d, h, w)),
    }[direction.lower()]
    return image.with_rows(image.df.select(*[c.alias(a) for c, a in zip(out[0], AXES, strict=True)], "v"), out[1])


def translate(image: Image, shift: tuple[int, int, int]) -> Image:
    """Whole-pixel shift; what comes in from outside is 0."""
    moved = image.df.select(*[(F.col(a) + s).alias(a) for a, s in zip(AXES, shift, strict=True)], F.col("v").alias("w"))
    out = image.df.join(moved, list(AXES), "left").select(*AXES, F.coalesce("w", F.lit(0.0)).alias("v"))
    return image.with_rows(out)


def scale_nearest(image: Image, factor: tuple[int, int, int]) -> Image:
    """Enlarged by whole factors: each pixel becomes a block, so labels stay sharp."""
    df = image.df
    for a, f in zip(AXES, factor, strict=True):
        df = df.withColumn(a, F.explode(F.sequence(F.col(a) * f, F.col(a) * f + (f - 1))))
    return image.with_rows(df, tuple(n * f for n, f in zip(image.dims, factor, strict=True)))


def copy_into(source: Image, target: Image, location: tuple) -> Image:
    moved = source.df.select(*[(F.col(a) + p).alias(a) for a, p in zip(AXES, location, strict=True)], F.col("v").alias("w"))
    return target.with_rows(target.df.join(moved, list(AXES), "left").select(*AXES, F.coalesce("w", "v").alias("v")))


def montage(image: Image, columns: int, rows: int, factor: float = 1.0, first: int = 0, last: int | None = None, step: int = 0, border: int = 0, border_color: float = 0.0) -> Image:
    """Slices first, first + step ... up to last side by side in rows, scaled in the plane, with a border between them.

    step 0: such that the slices up to last fill the cells. Cells without a slice, and borders, have the border's colour.
    """
    d = image.dims[2]
    last = d - 1 if last is None else min(last, d - 1)
    step = step or max(1, (last - first) // (rows * columns))
    k = ((F.col("z") - first) / step).cast("bigint")
    used = image.with_rows(image.df.filter((F.col("z") >= first) & (F.col("z") <= last) & ((F.col("z") - first) % step == 0) & (k < columns * rows)))
    if factor != 1:
        used = scale(used, (factor, factor, 1))
        used = used.with_rows(used.df.filter((F.col("z") >= first) & (F.col("z") <= last) & ((F.col("z") - first) % step == 0) & (k < columns * rows)))
    w, h = used.dims[:2]
    placed = used.df.select((F.col("x") + k % columns * (w + border)).alias("x"), (F.col("y") + (k / columns).cast("bigint") * (h + border)).alias("y"), F.lit(0).cast("bigint").alias("z"), F.col("v").alias("w"))
    out = new_image(image.df.sparkSession, ((w + border) * columns - border, (h + border) * rows - border, 1), image.dtype, border_color)
    return out.with_rows(out.df.join(placed, list(AXES), "left").select(*AXES, F.coalesce("w", "v").alias("v")))


def resample(image: Image, dims: tuple[int, int, int], source: Callable[[Column, Column, Column], tuple[Column, Column, Column]], interpolation: str = "Linear", boundary: str = "Zero") -> Image:
    """An image of size dims whose pixel at (x, y, z) is interpolated at source(x, y, z) of the input.

    Nearest, Linear or Cubic (Keys' convolution, a = -1/2); beyond the input pixels are 0 (Zero) or the nearest ones (Nearest). Corners of weight 0 aren't
    joined, so whole-pixel positions read one pixel each.
    """
    if interpolation not in ("Nearest", "Linear", "Cubic"):
        raise ValueError(f"Interpolation {interpolation} isn't supported")
    places = source(*(F.col(a).cast("double") for a in AXES))
    grid = new_image(image.df.sparkSession, dims).df.select(*AXES, *[p.alias(f"s{a}") for a, p in zip(AXES, places, strict=True)])
    for a, n in zip(AXES, image.dims, strict=True):
        s = F.col(f"s{a}")
        if interpolation == "Nearest" or n == 1:
            corners = F.array(F.struct(F.floor(s + 0.5).alias("at"), F.lit(1.0).alias("w")))
        elif interpolation == "Cubic":
            t = s - F.floor(s)
            far = [t + 1, t, 1 - t, 2 - t]
            weights = [1.5 * d * d * d - 2.5 * d * d + 1 if k in (1, 2) else -0.5 * d * d * d + 2.5 * d * d - 4 * d + 2 for k, d in enumerate(far)]
            corners = F.filter(F.array(*[F.struct((F.floor(s) + k - 1).alias("at"), w.alias("w")) for k, w in enumerate(weights)]), lambda c: c["w"] != 0)
        else:
            t = s - F.floor(s)
            corners = F.filter(F.array(F.struct(F.floor(s).alias("at"), (1 - t).alias("w")), F.struct((F.floor(s) + 1).alias("at"), t.alias("w"))), lambda c: c["w"] > 0)
        grid = grid.withColumn(f"c{a}", F.explode(corners))
    clip = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1)) if boundary == "Nearest" else c
    corners = grid.select(*AXES, *[clip(F.col(f"c{a}.at"), n).alias(f"i{a}") for a, n in zip(AXES, image.dims, strict=True)], (F.col("cx.w") * F.col("cy.w") * F.col("cz.w")).alias("w"))
    values = image.df.select(*[F.col(a).alias(f"i{a}") for a in AXES], "v")
    sums = corners.join(values, [f"i{a}" for a in AXES], "left").groupBy(*AXES).agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))).alias("v"))
    return image.with_rows(sums.select(*AXES, pixel_round(F.col("v"), image.dtype).alias("v")), tuple(dims))


def shift(image: Image, by: tuple[float, float, float], interpolation: str = "Linear", boundary: str = "Zero") -> Image:
    """Translation by any amount."""
    return resample(image, image.dims, lambda *p: tuple(c - float(s) for c, s in zip(p, by, strict=True)), interpolation, boundary)


def rotate(image: Image, angle: float, axis: tuple = (0, 0, 1), dims: tuple | None = None, input_center: tuple | None = None, output_center: tuple | None = None, interpolation: str = "Linear", boundary: str = "Zero") -> Image:
    """Rotation by angle (radians) around axis: out = R (in - input_center) + output_center; the centres are by default those of the images."""
    dims = tuple(dims or image.dims)
    a = input_center or tuple(n / 2 for n in image.dims)
    b = output_center or tuple(n / 2 for n in dims)
    norm = math.sqrt(sum(c * c for c in axis))
    u = [c / norm for c in axis]
    cos, sin = math.cos(angle), math.sin(angle)
    cross = [[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]]
    turn = [[cos * (i == j) + sin * cross[i][j] + (1 - cos) * u[i] * u[j] for j in range(3)] for i in range(3)]

    def source(*p: Column) -> tuple[Column, Column, Column]:
        d = [c - float(o) for c, o in zip(p, b, strict=True)]
        # Rounded, so that turns by right angles read whole pixels.
        return tuple(F.round(sum((d[i] * turn[i][j] for i in range(3)), F.lit(0.0)) + float(a[j]), 9) for j in range(3))

    return resample(image, dims, source, interpolation, boundary)


def cart_to_cyl(image: Image, dims: tuple, origin: tuple = (0, 0, 0), interpolation: str = "Linear", boundary: str = "Zero") -> Image:
    """x of the result is the distance from origin, y the azimuth with the height as a full turn; positions are rounded before the origin is added."""

    def source(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        t = y / dims[1] * (2 * math.pi)
        return F.round(x * F.cos(t)) + float(origin[0]), F.round(x * F.sin(t)) + float(origin[1]), z + float(origin[2])

    return resample(image, dims, source, interpolation, boundary)


def pixels_at(image: Image, positions: DataFrame) -> DataFrame:
    """positions (any columns, with x, y, z of any number type) with the value v of the pixel that each is rounded to; null outside the image."""
    near = positions.select("*", *[F.round(F.col(a)).cast("bigint").alias(f"_{a}") for a in AXES])
    values = image.df.select(*[F.col(a).alias(f"_{a}") for a in AXES], "v")
    return near.join(values, [f"_{a}" for a in AXES], "left").drop(*[f"_{a}" for a in AXES])


def scale(image: Image, factor: tuple[float, float, float], interpolation: str = "Linear", boundary: str = "Nearest") -> Image:
    """Enlarged or reduced by any factor, without averaging."""
    dims = tuple(max(1, round(n * f)) for n, f in zip(image.dims, factor, strict=True))
    return resample(image, dims, lambda *p: tuple(c / float(f) for c, f in zip(p, factor, strict=True)), interpolation, boundary)


def generic_transform(image: Image, dims: tuple, position: tuple, reference: list[tuple], deformed: list[tuple], exponent: float = 2.5, interpolation: str = "Linear", boundary: str = "Zero") -> Image:
    """The pixel at p reads the input at p + position plus the mean of the shifts deformed - reference, weighted by the distance to each reference point to the power -exponent.

    At a reference point its own shift counts alone. The lists of point pairs are given and go into the plan.
    """
    def source(*p: Column) -> tuple[Column, Column, Column]:
        at = [c + float(o) for c, o in zip(p, position, strict=True)]
        if not reference:
            return tuple(at)
        gaps = [F.sqrt(sum(((c - float(q)) * (c - float(q)) for c, q in zip(at, r, strict=True)), F.lit(0.0))) for r in reference]
        total = sum((F.pow(F.greatest(g, F.lit(1e-7)), -float(exponent)) for g in gaps), F.lit(0.0))
        out = []
        for k in range(3):
            shifts = [float(d[k]) - float(r[k]) for r, d in zip(reference, deformed, strict=True)]
            mean = sum((F.pow(F.greatest(g, F.lit(1e-7)), -float(exponent)) * s for g, s in zip(gaps, shifts, strict=True)), F.lit(0.0)) / total
            for g, s in zip(gaps, shifts, strict=True):
                mean = F.when(g < 1e-7, F.lit(s)).otherwise(mean)
            out.append(F.round(at[k] + mean, 9))
        return tuple(out)

    return resample(image, tuple(dims), source, interpolation, boundary)
