"""Queries of stitching: slabs of the volume with wrong supposed positions are matched, placed and blended, which gives the volume back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.operators import stitching
from voxara.plans.volume import U8, Query, saturated, u8
from voxara.raster import Image
from voxara.store import kept

#: Slices from one slab to the next, slices of a slab, and what is looked at of an overlap.
STEP, DEPTH, RADIUS, SEARCH = 24, 40, (3, 3, 5), (1, 1, 3)
GRID = (7, 7, 20)
_SLABS = f"s AS (SELECT t::BIGINT AS tile, least({DEPTH}, m + 1 - {STEP} * t) AS d, {STEP} * t AS oz FROM (SELECT max(z) AS m FROM u8), (SELECT unnest(range(100000)) AS t) WHERE {STEP} * t + {DEPTH - STEP} <= m)"


def slabs(volume: Image) -> DataFrame:
    """Tiles with their true first pixels (ox, oy, oz) and supposed positions (px, py, pz), which are up to 1 and 3 pixels off."""
    depth = volume.dims[2]
    t = F.col("id")
    count = max(1, -(-(depth - (DEPTH - STEP)) // STEP))
    return volume.df.sparkSession.range(count).select(
        t.alias("tile"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.least(F.lit(DEPTH), F.lit(depth) - STEP * t).cast("int").alias("d"), F.lit(0).alias("ox"), F.lit(0).alias("oy"), (STEP * t).alias("oz"),
        (t % 2).cast("double").alias("px"), F.lit(0.0).alias("py"), (STEP * t + (t * 7) % 4).cast("double").alias("pz"),
    )


def matched(volume: Image) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pixels, tiles, matches); every other slab is darker, with less contrast."""
    tiles = slabs(volume)
    pixels = stitching.split(volume, tiles).withColumn("v", F.when(F.col("tile") % 2 == 1, F.col("v") * 0.5 + 10).otherwise(F.col("v")))
    points = stitching.grid_points(tiles, stitching.overlaps(tiles, 3), (8, 8, 8), RADIUS)
    return pixels, tiles, stitching.match(pixels, points, SEARCH, RADIUS)


def table() -> dict[str, Query]:
    def run(f: Callable[[DataFrame, DataFrame, DataFrame, tuple], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            volume = u8(spark, sf_dir)
            volume = volume.with_rows(kept(volume.df))
            pixels, tiles, matches = matched(volume)
            return f(kept(pixels), tiles, kept(matches), volume.dims)

        return query

    def stitched(pixels: DataFrame, tiles: DataFrame, matches: DataFrame, dims: tuple) -> tuple[Image, Image]:
        placed = kept(stitching.place(tiles, matches))
        return stitching.stitch(pixels, placed, kept(stitching.world_to_local(placed, matches, GRID)), GRID, dims, "uint8")

    out: dict[str, Query] = {}
    placed = lambda pixels, tiles, matches, dims: stitching.place(tiles, matches).select("tile", *[F.round(c, 6).alias(c) for c in ("px", "py", "pz", "gain", "offset")])
    out["stitch_place"] = run(placed), f"WITH {U8}, {_SLABS} SELECT tile, 0.0::DOUBLE AS px, 0.0::DOUBLE AS py, oz::DOUBLE AS pz, CASE WHEN tile % 2 = 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS gain, CASE WHEN tile % 2 = 1 THEN -20.0 ELSE 0.0 END::DOUBLE AS offset FROM s"
    out["stitch_ver2"] = run(lambda *a: stitched(*a)[0].df), f"WITH {U8}, n AS (SELECT max(z) AS m FROM u8) SELECT x, y, z, CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 AND z BETWEEN 1 AND m - 1 THEN {saturated('v')} ELSE 0 END::DOUBLE AS v FROM u8, n"
    out["stitch_ver3"] = run(lambda *a: stitched(*a)[1].df), f"WITH {U8} SELECT x, y, z, 0.0::DOUBLE AS v FROM u8"
    fields = lambda pixels, tiles, matches, dims: stitching.world_to_local(stitching.place(tiles, matches), matches, GRID).select("tile", "i", "j", "k", *[(F.round(c, 6) + 0.0).alias(c) for c in stitching.SHIFTS])
    out["determine_world_to_local"] = run(fields), f"WITH {U8}, {_SLABS} SELECT tile, i::INT AS i, j::INT AS j, k::INT AS k, 0.0::DOUBLE AS sx, 0.0::DOUBLE AS sy, 0.0::DOUBLE AS sz FROM s, range(2) a(i), range(2) b(j), (SELECT unnest(range(100)) AS k) WHERE k <= ceil((d - 1) / {GRID[2]}.0)"
    return out
