"""Distance maps and local thickness.

A squared distance map is separable: one pass for each axis, each pass a kernel over the lines along that axis, so
a task holds lines and never the volume.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from voxara.operators import neighbourhood
from voxara.operators.blocks import as_image, over_blocks
from voxara.operators.lines import over_lines
from voxara.raster import AXES, Image, check_same, pix
from voxara.store import kept

#: Most lines of a group along each of the other axes.
LINES = 1 << 14
#: Offsets at which lines are searched side by side.
OFFSETS = 64
#: Squared distance where the image has no background.
FAR = 1e18


def nearest_apex(f: np.ndarray) -> np.ndarray:
    """For each p a q that makes f[q] + (p - q)^2 least; some f must be less than FAR."""
    n = len(f)
    apex, bound = [], []
    for q in np.flatnonzero(f < FAR):
        while apex:
            p = apex[-1]
            s = (f[q] + q * q - f[p] - p * p) / (2.0 * (q - p))
            if s > bound[-1]:
                break
            apex.pop()
            bound.pop()
        bound.append(s if apex else -math.inf)
        apex.append(q)
    return np.asarray(apex)[np.searchsorted(np.asarray(bound), np.arange(n), side="right") - 1]


def envelope(f: np.ndarray) -> np.ndarray:
    """min over q of f[q] + (p - q)^2 for each p."""
    return envelopes(f[None], nearest_apexes(f[None]))[0]


def nearest_apexes(f: np.ndarray) -> np.ndarray:
    """nearest_apex of each row of f; its own place where all of a row is FAR. Of equal ones the last is taken.

    Rows are searched side by side at growing offsets, up to the largest distance found; rows in which that takes more
    than OFFSETS steps get their own lower envelope.
    """
    n = f.shape[1]
    place = np.arange(n)
    at = np.broadcast_to(place, f.shape).copy()
    finite = np.flatnonzero((f < FAR).any(1))
    f, q = f[finite], at[finite]
    best = f.copy()
    for o in range(1, n):
        if best.max(initial=0.0) < o * o:
            break
        if o > OFFSETS:
            for i in np.flatnonzero(best.max(1) >= o * o):
                q[i] = nearest_apex(f[i])
            break
        for here, there, last in ((slice(None, -o), slice(o, None), True), (slice(o, None), slice(None, -o), False)):
            cost = f[:, there] + o * o
            better = cost <= best[:, here] if last else cost < best[:, here]
            best[:, here][better] = cost[better]
            q[:, here][better] = np.broadcast_to(place[there], better.shape)[better]
    at[finite] = q
    return at


def envelopes(f: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f[q] + (p - q)^2 of each row and p; FAR stays."""
    least = np.take_along_axis(f, q, 1)
    return np.where(least < FAR, least + (np.arange(f.shape[1]) - q) ** 2.0, least)


def _distances(arrays: list[np.ndarray]) -> list[np.ndarray]:
    return [envelopes(arrays[0], nearest_apexes(arrays[0]))]


def squared_distance(image: Image, background: float = 0.0) -> Image:
    """Each pixel's squared distance to the nearest background pixel; FAR in an image without background."""
    df = image.df.select(*AXES, F.when(pix() == background, 0.0).otherwise(FAR).alias("v"))
    for axis, n in enumerate(image.dims):
        if n > 1:
            df = over_lines(df, axis, image.dims, _distances, most=LINES)
    return image.with_rows(df, dtype="float32")


def distance(image: Image, background: float = 0.0) -> Image:
    return squared_distance(image, background).map(F.sqrt(pix()), "float32")


def round_ridge(image: Image) -> Image:
    """Squared distances whose roots are rounded."""
    r = F.round(F.sqrt(pix()))
    return image.map(r * r)


def draw_spheres(image: Image) -> Image:
    """Each nonzero pixel draws a sphere whose squared radius is its value; where spheres overlap, the largest counts."""
    largest = image.df.agg(F.max("v")).first()[0] or 0.0
    if largest >= FAR:
        raise ValueError("An image without background has no finite radii")
    reach = math.ceil(math.sqrt(largest))
    radius = tuple(min(reach, n - 1) if n > 1 else 0 for n in image.dims)
    places = sorted((sum(c * c for c in o), o) for o in neighbourhood.offsets(radius, "Rectangular"))

    def kernel(block: np.ndarray) -> np.ndarray:
        out = np.zeros([n - 2 * r for n, r in zip(block.shape, radius, strict=True)])
        top = block.max(initial=0.0)
        for squared, o in places:
            if squared >= top:
                break
            part = block[tuple(slice(r + c, n - r + c) for r, c, n in zip(radius, o, block.shape, strict=True))]
            np.maximum(out, np.where(part > squared, part, 0.0), out)
        return out

    return neighbourhood.blockwise(image, kernel, radius, "Zero")


def finalize_thickness(image: Image) -> Image:
    """Squared radii to diameters."""
    return image.map(2 * F.sqrt(pix()), "float32")


def thickness(image: Image, background: float = 0.0, round_distances: bool = False) -> Image:
    """Local thickness: the diameter of the largest sphere within the foreground that covers a pixel. Spheres are drawn at every foreground pixel, as those off the ridge lie within others."""
    squared = squared_distance(image, background)
    return finalize_thickness(draw_spheres(round_ridge(squared) if round_distances else squared))


def inpaint_nearest(image: Image, flag: float = 0.0) -> Image:
    """Pixels of the flag value (NaN too) get the value of a nearest other pixel; an image without others stays as it is.

    The separable distance passes carry the value along, so a task holds lines and never the volume.
    """
    missing = F.isnan(pix()) if math.isnan(flag) else pix() == flag
    df = image.df.select(*AXES, "v", F.when(missing, FAR).otherwise(0.0).alias("d"))
    for axis, n in enumerate(image.dims):
        if n > 1:
            df = over_lines(df, axis, image.dims, _nearest_values, most=LINES)
    return image.with_rows(df)


def _nearest_values(arrays: list[np.ndarray]) -> list[np.ndarray]:
    v, d = arrays
    q = nearest_apexes(d)
    return [np.take_along_axis(v, q, 1), envelopes(d, q)]


def containment(largest: int, offset: tuple[int, int, int]) -> np.ndarray:
    """At s: the largest |p + offset|^2 over whole points p with |p|^2 < s, for s up to largest; -1 where there is no point.

    A ball of squared radius s lies within one of squared radius r at that offset if this is less than r.
    """
    r = math.isqrt(max(0, largest - 1))
    p = np.arange(r + 1)
    x, y, z = np.meshgrid(p, p, p, indexing="ij")
    own = (x * x + y * y + z * z).ravel()
    far = ((x + offset[0]) ** 2 + (y + offset[1]) ** 2 + (z + offset[2]) ** 2).ravel()
    best = np.full(largest + 1, -1)
    used = own < largest
    np.maximum.at(best, own[used] + 1, far[used])
    return np.maximum.accumulate(best)


def maximal_balls(image: Image) -> Image:
    """Of a squared distance map, the pixels whose ball lies within no ball of a neighbouring pixel (faces, edges, corners); others are 0."""
    largest = image.df.agg(F.max("v")).first()[0] or 0.0
    if largest >= FAR:
        raise ValueError("An image without background has no finite radii")
    tables = [containment(int(largest), o) for o in ((1, 0, 0), (1, 1, 0), (1, 1, 1))]
    halo = tuple(1 if n > 1 else 0 for n in image.dims)
    steps = [o for o in neighbourhood.offsets(halo, "Rectangular") if any(o)]

    def kernel(block: np.ndarray) -> np.ndarray:
        own = block[tuple(slice(h, n - h) for h, n in zip(halo, block.shape, strict=True))]
        s = np.round(own).astype(int)
        stays = own > 0
        for o in steps:
            there = block[tuple(slice(h + c, n - h + c) for h, c, n in zip(halo, o, block.shape, strict=True))]
            stays &= ~(tables[sum(map(abs, o)) - 1][s] < there)
        return np.where(stays, own, 0.0)

    return neighbourhood.blockwise(image, kernel, halo, "Zero")


def seeded_distance(seeds: Image, geometry: Image, connectivity: str = "All") -> Image:
    """The length of the shortest path of neighbouring pixels from a nonzero seed over pixels of that seed's geometry value; infinite where none leads.

    A round settles every block against its neighbours' edge pixels; rounds go on while any pixel changes, as many as
    blocks that a shortest path crosses.
    """
    check_same(seeds, geometry)
    steps = [(o, math.sqrt(sum(c * c for c in o))) for o in neighbourhood.offsets(tuple(1 if n > 1 else 0 for n in seeds.dims), "Rectangular") if any(o) and (connectivity == "All" or sum(map(abs, o)) == 1)]
    halo = tuple(1 if n > 1 else 0 for n in seeds.dims)
    inner = tuple(slice(1, -1) if h else slice(None) for h in halo)

    def kernel(arrays: list[np.ndarray], _first) -> list[np.ndarray]:
        # Geometry is shifted by one so that 0 stands for what lies outside the image.
        d, g = np.where(arrays[1] == 0, math.inf, arrays[0]), arrays[1]
        while True:
            new = d.copy()
            for o, length in steps:
                to = tuple(slice(max(0, c), n + min(0, c)) for c, n in zip(o, d.shape, strict=True))
                come = tuple(slice(max(0, -c), n + min(0, -c)) for c, n in zip(o, d.shape, strict=True))
                same = (g[to] == g[come]) & (g[to] != 0)
                new[to] = np.where(same, np.minimum(new[to], d[come] + length), new[to])
            if (new == d).all():
                return [d[inner], g[inner], (d != arrays[0])[inner]]
            d = new

    df = geometry.df.select(*AXES, F.when(pix() >= 0, pix() + 1).otherwise(pix()).alias("v1"))
    df = seeds.df.select(*AXES, F.when(pix() != 0, 0.0).otherwise(F.lit(math.inf)).alias("v0")).join(df, list(AXES)).select(*AXES, "v0", "v1")
    while True:
        out = kept(over_blocks(df, seeds.dims, kernel, halo, "Zero", 3))
        df = out.select(*AXES, "v0", "v1")
        if out.filter("v2 <> 0").isEmpty():
            return as_image(seeds, df, "v0", "float32")
