"""Displacement fields on a grid of reference points: projection of points, pull-back of images, and removal of outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxara.raster import AXES, Image, new_image, pixel_round

#: For each axis the first grid point and the step, and how many points there are.
Grid = tuple[tuple[float, float, int], tuple[float, float, int], tuple[float, float, int]]
SHIFTS = ("sx", "sy", "sz")


def _corners(at: Column, count: int) -> Column:
    """The two neighbours of a grid position with their weights; beyond the grid the nearest point alone."""
    t = F.least(F.greatest(at, F.lit(0.0)), F.lit(float(count - 1)))
    low = F.floor(t)
    both = F.array(F.struct(low.alias("g"), (1 - (t - low)).alias("w")), F.struct((low + 1).alias("g"), (t - low).alias("w")))
    return F.filter(both, lambda c: c["w"] > 0)


def interpolated(points: DataFrame, shifts: DataFrame, grid: Grid) -> DataFrame:
    """points (x, y, z and other columns, one of which is a key named point) with sx, sy, sz interpolated from shifts (i, j, k, sx, sy, sz) on the grid."""
    each = points
    for a, (start, step, count) in zip(AXES, grid, strict=True):
        each = each.withColumn(f"c{a}", F.explode(_corners((F.col(a) - float(start)) / float(step), count)))
    each = each.select("point", *[F.col(f"c{a}.g").alias(g) for a, g in zip(AXES, "ijk", strict=True)], (F.col("cx.w") * F.col("cy.w") * F.col("cz.w")).alias("w"))
    sums = each.join(shifts, ["i", "j", "k"]).groupBy("point").agg(*[F.sum(F.col("w") * F.col(s)).alias(s) for s in SHIFTS])
    return points.join(sums, "point")


def points_to_deformed(points: DataFrame, shifts: DataFrame, grid: Grid) -> DataFrame:
    """points (point, x, y, z) of the reference moved by their interpolated shifts."""
    return interpolated(points, shifts, grid).select("point", *[(F.col(a) + F.col(s)).alias(a) for a, s in zip(AXES, SHIFTS, strict=True)])


def pull_back(deformed: Image, shifts: DataFrame, grid: Grid, dims: tuple | None = None, position: tuple = (0, 0, 0)) -> Image:
    """The deformed image in reference coordinates: a pixel at p reads the deformed image, linearly, at p + position and its shift; 0 beyond."""
    dims = tuple(dims or deformed.dims)
    w, h, _ = dims
    pixels = new_image(deformed.df.sparkSession, dims).df.select((F.col("x") + F.col("y") * w + F.col("z") * (w * h)).alias("point"), *[(F.col(a) + float(p)).alias(a) for a, p in zip(AXES, position, strict=True)])
    moved = points_to_deformed(pixels, shifts, grid)
    for a, n in zip(AXES, deformed.dims, strict=True):
        t = F.round(F.col(a), 9)
        low = F.floor(t)
        two = F.array(F.struct(low.alias("g"), (1 - (t - low)).alias("w")), F.struct((low + 1).alias("g"), (t - low).alias("w")))
        one = F.array(F.struct(F.floor(t + 0.5).alias("g"), F.lit(1.0).alias("w")))
        moved = moved.withColumn(f"c{a}", F.explode(one if n == 1 else F.filter(two, lambda c: c["w"] > 0)))
    each = moved.select("point", *[F.col(f"c{a}.g").alias(a) for a in AXES], (F.col("cx.w") * F.col("cy.w") * F.col("cz.w")).alias("w"))
    sums = each.join(deformed.df, list(AXES), "left").groupBy("point").agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))).alias("v"))
    place = [F.col("point") % w, (F.col("point") / w).cast("bigint") % h, (F.col("point") / (w * h)).cast("bigint")]
    return deformed.with_rows(sums.select(*[p.alias(a) for a, p in zip(AXES, place, strict=True)], pixel_round(F.col("v"), deformed.dtype).alias("v")), dims)


def filter_displacements(shifts: DataFrame, radius: int = 5, limit: float = 3.0) -> DataFrame:
    """shifts with null for those that differ, along any axis, by more than limit from the median of the grid points within radius along each axis.

    Grid points meet their neighbours by equality of grid positions, so the join grows with the neighbourhood alone.
    """
    near = shifts.select(*[F.col(g).alias(f"_{g}") for g in "ijk"], *[F.col(s).alias(f"_{s}") for s in SHIFTS])
    for g in "ijk":
        near = near.withColumn(g, F.explode(F.sequence(F.col(f"_{g}") - radius, F.col(f"_{g}") + radius)))
    medians = near.groupBy("i", "j", "k").agg(*[F.expr(f"percentile(_{s}, 0.5)").alias(f"m{s}") for s in SHIFTS])
    joined = shifts.join(medians, ["i", "j", "k"])
    bad = F.lit(False)
    for s in SHIFTS:
        bad = bad | (F.abs(F.col(s) - F.col(f"m{s}")) > limit)
    return joined.select("i", "j", "k", *[F.when(~bad, F.col(s)).alias(s) for s in SHIFTS])


def best_shift(scores: DataFrame) -> DataFrame:
    """point and its shift of the largest score; of equal ones the first in the order x, y, z."""
    order = Window.partitionBy("point").orderBy(F.desc("score"), *SHIFTS)
    return scores.select("*", F.row_number().over(order).alias("_rank")).filter("_rank = 1").drop("_rank")


def block_match(reference: Image, deformed: Image, points: DataFrame, search: tuple[int, int, int], radius: tuple[int, int, int]) -> DataFrame:
    """point, sx, sy, sz, score of points (point, x, y, z, whole numbers): the whole-pixel shift within search whose blocks of radius correlate best.

    Each point's pixels meet the deformed image's by equality of positions, for each shift that is tried, so the work is
    that of points times shifts times block pixels; Pearson's correlation comes from sums. Blocks cut by the image's
    border are compared where both exist; blocks without contrast score 0.
    """
    cells = points
    for a, r in zip(AXES, radius, strict=True):
        cells = cells.withColumn(f"d{a}", F.explode(F.sequence(F.lit(-r), F.lit(r))))
    block = cells.select("point", *[(F.col(a) + F.col(f"d{a}")).alias(a) for a in AXES]).join(reference.df, list(AXES)).select("point", *AXES, F.col("v").alias("a"))
    for s, n in zip(SHIFTS, search, strict=True):
        block = block.withColumn(s, F.explode(F.sequence(F.lit(-n), F.lit(n))))
    moved = block.select("point", *SHIFTS, "a", *[(F.col(a) + F.col(s)).alias(a) for a, s in zip(AXES, SHIFTS, strict=True)]).join(deformed.df, list(AXES))
    scores = moved.groupBy("point", *SHIFTS).agg(F.corr("a", "v").alias("score"))
    return best_shift(scores.select("point", *SHIFTS, F.round(F.when(F.col("score").isNull() | F.isnan("score"), 0.0).otherwise(F.col("score")), 12).alias("score")))
