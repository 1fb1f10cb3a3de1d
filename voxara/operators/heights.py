"""Height maps: images of one slice whose pixel (x, y) is a z coordinate of a volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxara.raster import AXES, Image, pix, pixel_round


def _with_height(geometry: Image, heights: Image) -> DataFrame:
    if heights.dims != (*geometry.dims[:2], 1):
        raise ValueError(f"A height map of {geometry.dims[0]} x {geometry.dims[1]} pixels is needed, not {heights.dims}")
    return geometry.df.join(heights.df.select("x", "y", F.col("v").alias("h")), ["x", "y"])


def _set(geometry: Image, heights: Image, where: Column, value: float) -> Image:
    new = F.when(where, F.lit(float(value))).otherwise(pix())
    return geometry.with_rows(_with_height(geometry, heights).select(*AXES, pixel_round(new, geometry.dtype).alias("v")))


def draw_height_map(geometry: Image, heights: Image, value: float) -> Image:
    """The value at each column's rounded height; heights outside the volume draw nothing."""
    return _set(geometry, heights, F.col("z") == F.round("h"), value)


def set_before(geometry: Image, heights: Image, value: float) -> Image:
    """The value at all pixels above the map, z < height."""
    return _set(geometry, heights, F.col("z") < F.col("h"), value)


def set_after(geometry: Image, heights: Image, value: float) -> Image:
    """The value at all pixels below the map, z > height."""
    return _set(geometry, heights, F.col("z") > F.col("h"), value)


def shift_z(image: Image, shifts: Image, subtract_mean: bool = False, interpolation: str = "Linear", boundary: str = "Zero") -> Image:
    """Each column moves along z by its own amount: the result at z is the input at z - shift, 0 or the nearest pixel beyond the ends."""
    mean = (shifts.df.agg(F.avg("v")).first()[0] or 0.0) if subtract_mean else 0.0
    shifts = Image(shifts.df.withColumn("v", F.col("v") - float(mean)), shifts.dims, "float32")
    depth = image.dims[2]
    source = F.col("z") - F.col("h")
    grid = _with_height(image, shifts).select("x", "y", "z", source.alias("s"))
    if interpolation == "Nearest":
        corners = F.array(F.struct(F.floor(F.col("s") + 0.5).alias("at"), F.lit(1.0).alias("w")))
    else:
        part = F.col("s") - F.floor("s")
        corners = F.filter(F.array(F.struct(F.floor("s").alias("at"), (1 - part).alias("w")), F.struct((F.floor("s") + 1).alias("at"), part.alias("w"))), lambda c: c["w"] > 0)
    each = grid.select("x", "y", "z", F.explode(corners).alias("c"))
    at = F.least(F.greatest(F.col("c.at"), F.lit(0)), F.lit(depth - 1)) if boundary == "Nearest" else F.col("c.at")
    each = each.select("x", "y", "z", at.alias("s"), F.col("c.w").alias("w"))
    values = image.df.select("x", "y", F.col("z").alias("s"), "v")
    sums = each.join(values, ["x", "y", "s"], "left").groupBy(*AXES).agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))).alias("v"))
    return image.with_rows(sums.select(*AXES, pixel_round(F.col("v"), image.dtype).alias("v")))
