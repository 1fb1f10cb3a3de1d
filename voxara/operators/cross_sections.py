"""Cross-sections of fibres: planes across the local direction at sampled pixels, a region grown in each, and its measurements.

Which pixels are sampled follows from a hash of a seed and their positions. Planes that leave the image are ruled out by their
corners before any pixel is read; the others meet foreground pixels by equality of positions, and a task has one plane.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxara.operators import analyzers
from voxara.raster import AXES, Image, check_same, pix
from voxara.store import kept

ANALYZERS = ("coordinates2d", "volume", "pca2d", "convexhull2d", "bounds2d")
LENGTHS = ("length_min", "length_max", "length_mean", "length_mode")
PLANE = ("ux", "uy", "uz", "rx", "ry", "rz")
#: Regions of fewer pixels are not measured.
LEAST = 4


def headers(lengths: bool = False) -> list[str]:
    """Columns of the result: those of ANALYZERS within the plane, the sampled pixel, the region's centre in the image, and fibre lengths."""
    return [*analyzers.headers(ANALYZERS)[1:], "x3", "y3", "z3", "cx3", "cy3", "cz3", *(LENGTHS if lengths else ())]


def _plane(phi: Column, theta: Column) -> list[Column]:
    """Of a direction, the unit vectors u (along the plane's x) and r (along its y): r is across z, or across x where the direction is z."""
    x, y, z = F.sin(theta) * F.cos(phi), F.sin(theta) * F.sin(phi), F.cos(theta)
    flat, steep = F.sqrt(x * x + y * y), F.sqrt(y * y + z * z)
    upright = flat < 0.0001
    r = [F.when(upright, 0.0).otherwise(y / flat), F.when(upright, z / steep).otherwise(-x / flat), F.when(upright, -y / steep).otherwise(0.0)]
    u = [r[1] * z - r[2] * y, r[2] * x - r[0] * z, r[0] * y - r[1] * x]
    return [*u, *r]


def _at(i: Column, j: Column) -> list[Column]:
    """The pixel of the image at i, j of a plane about its middle."""
    return [F.round(F.round(F.col(a) + i * F.col(f"u{a}") + j * F.col(f"r{a}"), 9)).cast("bigint") for a in AXES]


def candidates(original: Image, energy: Image, phi: Image, theta: Image, radius: int, seed: int) -> DataFrame:
    """rank, x, y, z and the plane's axes of the foreground pixels with an orientation whose planes lie within the image."""
    for im in (energy, phi, theta):
        check_same(original, im)
    both = original.df.filter(pix() != 0).select(*AXES)
    for name, im in (("energy", energy), ("phi", phi), ("theta", theta)):
        both = both.join(im.df.select(*AXES, F.col("v").alias(name)), list(AXES))
    axes = kept(both.filter("energy <> 0").select(*AXES, *[c.alias(n) for c, n in zip(_plane(F.col("phi"), F.col("theta")), PLANE, strict=True)]))
    inside = F.lit(True)
    for a, n in zip(AXES, original.dims, strict=True):
        reach = radius * (F.abs(f"u{a}") + F.abs(f"r{a}"))  # of the plane's corners
        inside = inside & (F.round(F.round(F.col(a) - reach, 9)) >= 0) & (F.round(F.round(F.col(a) + reach, 9)) < n)
    return axes.filter(inside).select(F.xxhash64(F.lit(seed), *AXES).alias("rank"), *AXES, *PLANE)


def grown(plane: np.ndarray, start: tuple[int, int]) -> np.ndarray:
    """Places (n x 2) of the 8-connected pixels of start's value, in the order y, x."""
    value, seen, left = plane[start], {start}, [start]
    while left:
        x, y = left.pop()
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                at = x + i, y + j
                if at not in seen and 0 <= at[0] < plane.shape[0] and 0 <= at[1] < plane.shape[1] and plane[at] == value:
                    seen.add(at)
                    left.append(at)
    return np.array(sorted(seen, key=lambda p: (p[1], p[0])))


def measured(points: np.ndarray) -> dict[str, float]:
    """ANALYZERS' columns of a region's places, as analyzers.analyze has them for a label."""
    p = points.astype(float)
    centre = p.mean(0)
    values, axes = (a[0] for a in analyzers.principal_axes(np.cov(p.T, bias=True)[None]))
    axes = np.where(axes[:, 1:] < 0, -axes, axes)
    roots = np.sqrt(values)
    shape = [*centre, float(analyzers.eccentricity(values[None])[0]), *roots, math.atan2(axes[0][1], axes[0][0]), *(float(c[0]) for c in analyzers.extents(p, np.zeros(1, int), centre[None], axes[None], roots[None]))]
    area, round_ = analyzers.hull_measures(p)
    found = [("coordinates2d", points[0]), ("volume", [len(p)]), ("pca2d", shape), ("convexhull2d", [area, round_]), ("bounds2d", [p[:, 0].min(), p[:, 0].max(), p[:, 1].min(), p[:, 1].max()])]
    return {c: float(v) for name, row in found for c, v in zip(analyzers.COLUMNS[name], row, strict=True)}


def sections(original: Image, chosen: DataFrame, radius: int) -> DataFrame:
    """rank, headers, the plane's axes, and slice (values of the plane, x first), region (numbers of its pixels) of the chosen whose region has LEAST pixels and doesn't touch the plane's edge."""
    size = 2 * radius + 1
    side = F.sequence(F.lit(-radius), F.lit(radius))
    places = chosen.select("*", F.explode(side).alias("i")).select("*", F.explode(side).alias("j"))
    named = places.select("rank", *[F.col(a).alias(f"{a}3") for a in AXES], *PLANE, "i", "j", *[c.alias(a) for c, a in zip(_at(F.col("i"), F.col("j")), AXES, strict=True)])
    met = named.join(original.df.filter(pix() != 0), list(AXES)).select("rank", "x3", "y3", "z3", *PLANE, "i", "j", "v")
    names = headers()

    key, others = ["rank", "x3", "y3", "z3"], ["x3", "y3", "z3", *PLANE]

    def one(rows: pd.DataFrame) -> dict | None:
        plane = np.zeros((size, size))
        plane[rows["i"].to_numpy() + radius, rows["j"].to_numpy() + radius] = rows["v"].to_numpy()
        points = grown(plane, (radius, radius))
        if len(points) < LEAST or points.min() <= 0 or points.max() >= size - 1:
            return None
        row = measured(points) | {"rank": int(rows["rank"].iloc[0]), **{n: float(rows[n].iloc[0]) for n in others}, "slice": plane.ravel(), "region": points[:, 0] * size + points[:, 1]}
        for a in AXES:
            row[f"c{a}3"] = row[f"{a}3"] + (row["cx2"] - radius) * row[f"u{a}"] + (row["cy2"] - radius) * row[f"r{a}"]
        return row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        columns = ["rank", *names, *PLANE, "slice", "region"]
        for pdf in chain(batches, [None]):
            rows = rest if pdf is None else pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if rows is None or rows.empty:
                continue
            keys = rows[key].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), *([len(rows)] if pdf is None else [])]
            found = [r for a, b in zip(cuts, cuts[1:], strict=False) if (r := one(rows.iloc[a:b])) is not None]
            rest = rows.iloc[cuts[-1] :]
            if found:
                yield pd.DataFrame(found)[columns]

    schema = "rank bigint, " + ", ".join(f"{n} double" for n in (*names, *PLANE)) + ", slice array<double>, region array<bigint>"
    return met.repartition("rank").sortWithinPartitions(*key).mapInPandas(run, schema)


def with_lengths(found: DataFrame, length: Image, radius: int) -> DataFrame:
    """found with the least, largest, mean and commonest (of equal ones the least) length over each region, read by linear interpolation, 0 beyond the image."""
    size = 2 * radius + 1
    places = found.select("rank", "x3", "y3", "z3", *PLANE, F.explode("region").alias("n"))
    i, j = F.floor(F.col("n") / size) - radius, F.col("n") % size - radius
    at = places.select("rank", "x3", "y3", "z3", "n", *[F.round(F.col(f"{a}3") + i * F.col(f"u{a}") + j * F.col(f"r{a}"), 9).alias(f"p{a}") for a in AXES])
    for a in AXES:
        low = F.floor(f"p{a}")
        two = F.array(F.struct(low.alias("g"), (1 - (F.col(f"p{a}") - low)).alias("w")), F.struct((low + 1).alias("g"), (F.col(f"p{a}") - low).alias("w")))
        at = at.withColumn(f"c{a}", F.explode(F.filter(two, lambda c: c["w"] > 0)))
    each = at.select("rank", "x3", "y3", "z3", "n", *[F.col(f"c{a}.g").alias(a) for a in AXES], (F.col("cx.w") * F.col("cy.w") * F.col("cz.w")).alias("w")).join(length.df, list(AXES), "left")
    key = ["rank", "x3", "y3", "z3"]
    samples = each.groupBy(*key, "n").agg(F.round(F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))), 9).alias("l"))
    counts = samples.groupBy(*key, "l").agg(F.count("*").alias("k"))
    common = counts.groupBy(*key).agg(F.min("l").alias("length_min"), F.max("l").alias("length_max"), (F.sum(F.col("l") * F.col("k")) / F.sum("k")).alias("length_mean"), (-F.max(F.struct("k", (-F.col("l")).alias("m")))["m"]).alias("length_mode"))
    return found.join(common, key)


def cross_sections(original: Image, energy: Image, phi: Image, theta: Image, radius: int = 40, count: int = 1000, seed: int = 123, length: Image | None = None) -> DataFrame:
    """Up to count sections, the first in the order of their hash, numbered from 0 (column number), with the columns of sections and headers.

    Planes are taken in that order, and then twice as many if too few of them had a region, until there are enough or none is left.
    """
    if count < 1:
        raise ValueError("The number of sections must be positive")
    order = ["rank", "z", "y", "x"]
    every, wanted, have = kept(candidates(original, energy, phi, theta, radius, seed)), 2 * count, 0
    found, left = None, every
    while have < count:
        chosen = kept(left.orderBy(*order).limit(wanted))
        more = kept(sections(original, chosen, radius))
        found = more if found is None else found.union(more)
        have += more.count()
        end = chosen.agg(F.max(F.struct(*order)).alias("m")).first()["m"]
        if chosen.count() < wanted or end is None:
            break
        left, wanted = every.filter(F.struct(*order) > F.struct(*[F.lit(v).cast("bigint").alias(c) for c, v in zip(order, end, strict=True)])), 2 * wanted
    best = found.orderBy("rank", "z3", "y3", "x3").limit(count)
    numbered = kept(best.select("*", F.lit(1).alias("_one")).groupBy("_one").agg(F.array_sort(F.collect_list(F.struct("rank", "z3", "y3", "x3"))).alias("_keys")).select(F.posexplode("_keys").alias("number", "k")).select("number", "k.*"))
    out = numbered.join(best, ["rank", "z3", "y3", "x3"])
    return with_lengths(out, length, radius) if length else out


def slices(found: DataFrame, radius: int, count: int, fill: float | None = None) -> Image:
    """The planes of sections as slices of an image, in order; the regions' pixels are fill, if that is given."""
    size = 2 * radius + 1
    each = found.select("number", "region", F.posexplode("slice").alias("n", "v"))
    value = F.when(F.array_contains("region", F.col("n").cast("bigint")), F.lit(float(fill))).otherwise(F.col("v")) if fill is not None else F.col("v")
    df = each.select(F.floor(F.col("n") / size).alias("x"), (F.col("n") % size).cast("bigint").alias("y"), F.col("number").cast("bigint").alias("z"), value.alias("v"))
    return Image(df, (size, size, count), "float32")


def marked(original: Image, found: DataFrame, radius: int, color: float) -> Image:
    """An image of original's size that has color where planes of sections lie, and 0 elsewhere."""
    side = F.sequence(F.lit(-radius), F.lit(radius))
    places = found.select(*[F.col(f"{a}3").alias(a) for a in AXES], *PLANE, F.explode(side).alias("i")).select("*", F.explode(side).alias("j"))
    hit = places.select(*[c.alias(a) for c, a in zip(_at(F.col("i"), F.col("j")), AXES, strict=True)]).distinct().withColumn("hit", F.lit(float(color)))
    return original.with_rows(original.df.join(hit, list(AXES), "left").select(*AXES, F.coalesce("hit", F.lit(0.0)).alias("v")))
