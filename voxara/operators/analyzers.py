"""Measurements of labelled regions.

Sums and extremes are aggregates with a fixed state for a label of any size. Hulls, bounding balls and extents are those
of a region's outermost pixels along x and z, so a task gets these alone and not the region.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxara.operators import surfaces
from voxara.raster import AXES, Image, pix

#: Each analyser's columns.
COLUMNS: dict[str, list[str]] = {
    "coordinates": ["x", "y", "z"], "coordinates2d": ["x", "y"], "isonedge": ["isonedge"], "volume": ["volume"],
    "bounds": ["minx", "maxx", "miny", "maxy", "minz", "maxz"], "bounds2d": ["minx", "maxx", "miny", "maxy"],
    "pca": ["cx", "cy", "cz", "e", "l1", "l2", "l3", "phi1", "theta1", "phi2", "theta2", "phi3", "theta3", "rmax", "d1", "d2", "d3", "bounding_scale"],
    "pca2d": ["cx2", "cy2", "e2", "l1_2", "l2_2", "alpha", "rmax2", "d1_2", "d2_2", "bounding_scale2"],
    "convexhull2d": ["convex_area", "convex_perimeter"], "boundingsphere": ["sphere_x", "sphere_y", "sphere_z", "sphere_r"], "value": ["value"], "surfacearea": ["surface_area"],
}
_SHAPED = ("pca", "pca2d", "convexhull2d", "boundingsphere")


def names_of(analyzers: tuple[str, ...]) -> list[str]:
    names = list(dict.fromkeys(a.lower() for a in analyzers))
    if unknown := [a for a in names if a not in COLUMNS]:
        raise ValueError(f"No analyser {unknown[0]}; there are {', '.join(COLUMNS)}")
    return names


def headers(analyzers: tuple[str, ...]) -> list[str]:
    """The result columns of analysers, in order."""
    return ["label", *dict.fromkeys(c for a in names_of(analyzers) for c in COLUMNS[a])]


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of plane points, counterclockwise (monotone chain)."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(order: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def chains(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the corners of each label's lower hull, of points in order of label and x with one y for each.

    A point that isn't below the line between its neighbours is no corner, so all such are left out at once, again and again.
    """
    kept = np.arange(len(label))
    while len(kept) > 2:
        a, b, c = kept[:-2], kept[1:-1], kept[2:]
        lost = (label[a] == label[c]) & ((x[b] - x[a]) * (y[c] - y[a]) <= (y[b] - y[a]) * (x[c] - x[a]))
        if not lost.any():
            break
        kept = np.delete(kept, np.flatnonzero(lost) + 1)
    return kept


def hulls_measures(points: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Areas and perimeters (2 x labels) of the convex hulls of plane pixels, which reach from their place to the next, of the labels whose points begin at start."""
    n = len(start)
    label = np.repeat(np.arange(n), np.diff(np.r_[start, len(points)]))
    label, x, y = (np.r_[c, d] for c, d in ((label, label), (points[:, 0], points[:, 0] + 1), (points[:, 1], points[:, 1])))
    order = np.lexsort((y, x, label))
    label, x, y = label[order], x[order], y[order]
    first = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (x[1:] != x[:-1])])
    label, x, low, high = label[first], x[first], np.minimum.reduceat(y, first), np.maximum.reduceat(y, first) + 1
    area, around = np.zeros(n), np.zeros(n)
    for side, sign in ((low, 1), (high, -1)):
        at = chains(label, x, sign * side)
        a, b = at[:-1], at[1:]
        a, b = a[label[a] == label[b]], b[label[a] == label[b]]
        area -= sign * np.bincount(label[a], (x[b] - x[a]) * (side[a] + side[b]) / 2, n)
        around += np.bincount(label[a], np.hypot(x[b] - x[a], side[b] - side[a]), n)
    ends = np.flatnonzero(np.r_[True, label[1:] != label[:-1]] | np.r_[label[1:] != label[:-1], True])
    return np.stack([area, around + np.bincount(label[ends], high[ends] - low[ends], n)])


def hull_measures(points: np.ndarray) -> list[float]:
    """Area and perimeter of the convex hull of plane pixels, which reach from their place to the next."""
    return list(hulls_measures(np.asarray(points), np.array([0]))[:, 0])


def smallest_balls(support: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, radii, bits of the points on it) of the smallest ball around each row of support (rows x at most 5 x 3), which passes through the last point."""
    rows, k, _ = support.shape
    best, centre, bits = np.full((2, rows), np.inf), np.zeros((rows, 3)), np.zeros(rows, int)
    origin = support[:, -1]
    for mask in sorted(range(1, 1 << (k - 1)), key=int.bit_count):
        if mask.bit_count() > 3:
            continue
        rest = [support[:, i] - origin for i in range(k - 1) if mask >> i & 1]
        half = [(r * r).sum(1, keepdims=True) / 2 for r in rest]
        if len(rest) == 1:
            over, under = rest[0], np.full((rows, 1), 2.0)
        elif len(rest) == 2:
            n = np.cross(*rest)
            over, under = half[0] * np.cross(rest[1], n) + half[1] * np.cross(n, rest[0]), (n * n).sum(1, keepdims=True)
        else:
            n = [np.cross(rest[i - 2], rest[i - 1]) for i in range(3)]
            over, under = sum(h * c for h, c in zip(half, n, strict=True)), (rest[0] * n[0]).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            c = origin + over / under  # points in a line or plane too few for them have no ball, which others then have
        d = np.linalg.norm(support - c[:, None], axis=2)
        reach = np.where(under[:, 0] == 0, np.inf, d.max(1))
        # Balls through their points come before those that leave some out by rounding alone.
        found = np.stack([np.where(reach <= d[:, -1] + 1e-9 * (1 + d[:, -1]), reach, np.finfo(float).max), reach])
        better = (found[0] < best[0] * (1 - 1e-12)) | ((found[0] == best[0]) & (found[1] < best[1]))
        best[:, better], centre[better], bits[better] = found[:, better], c[better], mask | 1 << (k - 1)
    return centre, best[1], bits


def bounding_balls(points: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centres, radii) of the smallest balls around the labels whose points begin at start: balls of few supporting points, to which the farthest point is added until none is outside."""
    points = points.astype(float)
    centres, radii = points[start], np.zeros(len(start))
    support, count = np.zeros((len(start), 5, 3)), np.ones(len(start), int)
    support[:, 0] = centres
    live, size = np.arange(len(start)), np.diff(np.r_[start, len(points)])
    while len(live):
        d = np.linalg.norm(points - np.repeat(centres[live], size, 0), axis=1)
        top = np.maximum.reduceat(d, start)
        outside = top > radii[live] * (1 + 1e-12) + 1e-9
        far = np.flatnonzero(d == np.repeat(top, size))
        far = far[np.searchsorted(far, start)][outside]
        support[live[outside], count[live[outside]]] = points[far]
        points = points[np.repeat(outside, size)]
        live, size = live[outside], size[outside]
        start = np.cumsum(size) - size
        count[live] += 1
        for k in range(2, 6):
            who = live[count[live] == k]
            if len(who):
                centres[who], radii[who], bits = smallest_balls(support[who, :k])
                on = bits[:, None] >> np.arange(k) & 1
                support[who, :k] = np.take_along_axis(support[who, :k], np.argsort(-on, axis=1, kind="stable")[:, :, None], 1)
                count[who] = on.sum(1)
    return centres, radii


def bounding_ball(points: np.ndarray) -> tuple[np.ndarray, float]:
    """(centre, radius) of the smallest ball around points."""
    centres, radii = bounding_balls(np.asarray(points), np.array([0]))
    return centres[0], float(radii[0])


def principal_axes(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (the largest first) and axes of each matrix of m."""
    values, vectors = np.linalg.eigh(m)
    return np.maximum(values[:, ::-1], 0.0), np.swapaxes(vectors[:, :, ::-1], 1, 2)


def extents(points: np.ndarray, start: np.ndarray, centre: np.ndarray, axes: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Of the labels whose points begin at start: largest distance from the centre, extents along the axes, and the factor by which the ellipsoid of the axes' lengths must grow to hold all points."""
    n = np.diff(np.r_[start, len(points)])
    p = points - np.repeat(centre, n, 0)
    along = np.einsum("pk,pak->pa", p, np.repeat(axes, n, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        factor = np.sqrt(((along / np.repeat(lengths, n, 0)) ** 2).sum(1))
    factor[~np.isfinite(factor)] = 0.0
    spans = np.maximum(np.maximum.reduceat(along, start), 0) - np.minimum(np.minimum.reduceat(along, start), 0)
    return [np.sqrt(np.maximum.reduceat((p * p).sum(1), start)), *spans.T, np.maximum.reduceat(factor, start)]


def eccentricity(values: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(values[:, 0] > 1e-6, np.sqrt(np.maximum(0.0, 1 - (values[:, -1] / values[:, 0]) ** 2)), 0.0)


def whole_labels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames that are sorted by label, cut anew between labels."""
    held: list[pd.DataFrame] = []
    for f in frames:
        if not len(f):
            continue
        cut = int(np.searchsorted(f["label"].to_numpy(), f["label"].iloc[-1]))
        if held and (cut or held[-1]["label"].iloc[-1] != f["label"].iloc[0]):
            yield pd.concat([*held, f[:cut]], ignore_index=True)
            held = []
        elif cut:
            yield f[:cut]
        held.append(f[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def corners(labelled: DataFrame) -> DataFrame:
    """label, x, y, z, z2: of each label the first and last pixels along z of those that are first or last along x.

    Largest distances, extents, hulls and balls are those of these pixels, which are at most two for each column of the image.
    """
    rows = labelled.groupBy("label", "y", "z").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    ends = rows.select("label", "y", "z", F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("x"))
    return ends.groupBy("label", "x", "y").agg(F.min("z").alias("z"), F.max("z").alias("z2"))


def measured(labelled: DataFrame, moments: DataFrame, shaped: list[str]) -> DataFrame:
    """label and the columns of the analysers of shapes; many labels are measured side by side."""
    added = [c for n in shaped for c in COLUMNS[n]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_labels(frames):
            label = np.repeat(f["label"].to_numpy(), 2)
            start = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
            points = np.repeat(f[["x", "y", "z"]].to_numpy(), 2, 0)
            points[1::2, 2] = f["z2"]
            one = f.iloc[start // 2]
            new: dict[str, np.ndarray] = {}
            for name in shaped:
                if name in ("pca", "pca2d"):
                    used = AXES if name == "pca" else AXES[:2]
                    centre = one[[f"_c{a}" for a in used]].to_numpy()
                    values, axes = principal_axes(np.stack([np.stack([one[f"_{min(a, b)}{max(a, b)}"] for b in used], 1) for a in used], 1))
                    axes = np.where(axes[:, :, -1:] < 0, -axes, axes)
                    if name == "pca":
                        angles = [c for i in range(3) for c in (np.arctan2(axes[:, i, 1], axes[:, i, 0]), np.arccos(np.clip(axes[:, i, 2], -1.0, 1.0)))]
                    else:
                        angles = [np.arctan2(axes[:, 0, 1], axes[:, 0, 0])]
                    result = [*centre.T, eccentricity(values), *np.sqrt(values).T, *angles, *extents(points[:, : len(used)], start, centre, axes, np.sqrt(values))]
                elif name == "convexhull2d":
                    result = hulls_measures(points[:, :2], start)
                else:
                    centre, radius = bounding_balls(points, start)
                    result = [*centre.T, radius]
                new |= dict(zip(COLUMNS[name], result, strict=True))
            yield pd.DataFrame({"label": label[start]} | {c: new[c] for c in added})

    points = corners(labelled).join(moments, "label").repartition("label").sortWithinPartitions("label", "x", "y")
    return points.mapInPandas(run, "label bigint" + "".join(f", {c} double" for c in added))


def analyze(image: Image, analyzers: tuple[str, ...] = ("coordinates", "volume"), value: float = 0.0) -> DataFrame:
    """One row for each nonzero label, with the columns of each analyser (see COLUMNS).

    coordinates: the first pixel in the order z, y, x. isonedge: 1 if a pixel lies on the image's border (an axis of one
    pixel is all border). pca: centre, eccentricity of the meridian, root eigenvalues of the covariance, the axes' azimuth
    and polar angle, largest distance from the centre, extents along the axes, and the scale of the bounding ellipsoid;
    pca2d the same in the plane. convexhull2d: of the pixels' corners in the plane. value: a constant. surfacearea: by marching cubes, see surfaces.label_areas.
    """
    names, out = names_of(analyzers), []
    if {"coordinates", "coordinates2d"} & set(names):
        out.append(F.min(F.struct("z", "y", "x")).alias("_first"))
    if "isonedge" in names:
        edge = F.lit(False)
        for a, n in zip(AXES, image.dims, strict=True):
            edge = edge | (F.col(a) <= 0) | (F.col(a) >= n - 1)
        out.append(F.max(edge.cast("int")).alias("isonedge"))
    out.append(F.count("*").alias("volume"))
    if {"bounds", "bounds2d"} & set(names):
        out += [f(a).alias(f"{n}{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))]
    if {"pca", "pca2d"} & set(names):
        out += [F.avg(a).alias(f"_c{a}") for a in AXES] + [F.covar_pop(a, b).alias(f"_{a}{b}") for i, a in enumerate(AXES) for b in AXES[i:]]
    labelled = image.df.filter(pix() != 0).select(*AXES, pix().cast("bigint").alias("label"))
    found = labelled.groupBy("label").agg(*out)
    if "_first" in found.columns:
        found = found.select("*", *[F.col(f"_first.{a}").alias(a) for a in AXES]).drop("_first")
    if "value" in names:
        found = found.withColumn("value", F.lit(float(value)))
    shaped = [n for n in names if n in _SHAPED]
    if shaped:
        moments = [c for c in found.columns if c.startswith("_")]
        found = found.join(measured(labelled, found.select("label", *moments), shaped), "label")
    if "surfacearea" in names:
        found = found.join(surfaces.label_areas(image), "label")
    return found.select(*headers(analyzers))
