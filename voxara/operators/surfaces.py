"""Areas and curvatures of surfaces between foreground and background.

Areas are those of marching cubes: each cell of eight pixels has a polygon around its foreground corners. What polygons a
cell has follows from a rule, not a table, so ambiguous faces and polygons that aren't flat may be cut otherwise than in
published tables. Blocks send partial sums alone.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxara.operators.blocks import as_image, fold_blocks, over_blocks
from voxara.raster import AXES, Image, pix

#: Corner c of a cell is at (c & 1, c >> 1 & 1, c >> 2 & 1); edges join corners that differ along one axis.
CORNERS = np.array([[c >> a & 1 for a in range(3)] for c in range(8)])
EDGES = [(c, c | 1 << a) for a in range(3) for c in range(8) if not c >> a & 1]
#: Of a label's surface, where between background and foreground it lies: grey value 128 of 0 and 255.
LABEL_LEVEL = 128 / 255
#: Centres whose neighbourhoods grow at once.
CENTRES = 2_000


@cache
def polygons(mask: int) -> tuple[tuple[int, ...], ...]:
    """Loops of edges around the corners in mask (bit c: corner c is foreground).

    On a face whose foreground corners are opposite each other they are parted.
    """
    inside = [mask >> c & 1 for c in range(8)]
    crossed = {e: [] for e, (a, b) in enumerate(EDGES) if inside[a] != inside[b]}
    for axis in range(3):
        u, v = (1 << a for a in range(3) if a != axis)
        for side in (0, 1 << axis):
            ring = [side, side | u, side | u | v, side | v]
            edges = [EDGES.index((min(a, b), max(a, b))) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
            met = [i for i in range(4) if edges[i] in crossed]
            if len(met) == 4:  # edges i - 1 and i are those of corner i
                pairs = [(edges[i - 1], edges[i]) for i in range(4) if inside[ring[i]]]
            else:
                pairs = [tuple(edges[i] for i in met)] if met else []
            for a, b in pairs:
                crossed[a].append(b)
                crossed[b].append(a)
    loops, left = [], set(crossed)
    while left:
        loop = [min(left)]
        while (step := next((e for e in crossed[loop[-1]] if e in left and e not in loop), None)) is not None:
            loop.append(step)
        left -= set(loop)
        loops.append(tuple(loop))
    return tuple(loops)


def triangles(mask: int) -> np.ndarray:
    """The edges (n x 3) of the triangles of a cell: each loop is a fan about its edge of least number."""
    return np.array([(p[0], p[i], p[i + 1]) for p in polygons(mask) for i in range(1, len(p) - 1)], int).reshape(-1, 3)


def areas(corners: np.ndarray, level: float) -> np.ndarray:
    """The area in each cell of corner values (cells x 8) between values below level and the others."""
    masks = ((corners >= level) << np.arange(8)).sum(1)
    a, b = np.array(EDGES).T
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (level - corners[:, a]) / (corners[:, b] - corners[:, a])
    points = CORNERS[a] + np.clip(np.nan_to_num(t), 0, 1)[:, :, None] * (CORNERS[b] - CORNERS[a])
    out = np.zeros(len(corners))
    for mask in np.unique(masks):
        cuts = triangles(int(mask))
        if len(cuts):
            cells = masks == mask
            p, q, r = (points[cells][:, cuts[:, i]] for i in range(3))
            out[cells] = np.linalg.norm(np.cross(q - p, r - p), axis=2).sum(1) / 2
    return out


@cache
def case_areas(level: float) -> np.ndarray:
    """The area of each of the 256 cells of zeros and ones at a level between them."""
    return areas(((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(float), level)


def _cells(a: np.ndarray) -> np.ndarray:
    """Corner values of all cells of an array, as shape (cells along x, y, z, 8)."""
    n = np.array(a.shape) - 1
    return np.stack([a[tuple(slice(o, o + k) for o, k in zip(c, n, strict=True))] for c in CORNERS], axis=-1)


def surface_area(image: Image, level: float = 1.0) -> DataFrame:
    """One row, v: the area between pixels below level and the others, in squared pixels; the image's border is no surface."""
    dims = image.dims

    def fold(arrays: list[np.ndarray], first: tuple[int, int, int]) -> pd.DataFrame:
        a = arrays[0]
        last = [f + n - 2 == d for f, n, d in zip(first, a.shape, dims, strict=True)]
        cells = _cells(a[tuple(slice(1, -1) if end else slice(1, None) for end in last)]).reshape(-1, 8)
        if not len(cells):
            return pd.DataFrame({"area": [0.0]})
        mixed = (cells.min(1) < level) & (cells.max(1) >= level)
        return pd.DataFrame({"area": [float(areas(cells[mixed], level).sum()) if mixed.any() else 0.0]})

    if min(dims) == 1:
        return image.df.agg(F.lit(0.0).alias("v"))
    return fold_blocks(image.df, dims, fold, "area double", (1, 1, 1)).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("v"))


def label_areas(image: Image) -> DataFrame:
    """label, surface_area of every nonzero label; what lies outside the image is none of it, so every surface is closed."""
    dims = image.dims

    def fold(arrays: list[np.ndarray], first: tuple[int, int, int]) -> pd.DataFrame:
        a = arrays[0]
        last = [f + n - 2 == d for f, n, d in zip(first, a.shape, dims, strict=True)]
        cells = _cells(a[tuple(slice(None) if end else slice(None, -1) for end in last)]).reshape(-1, 8)
        cells = cells[(cells != cells[:, :1]).any(1)]
        table, labels, found = case_areas(LABEL_LEVEL), [], []
        for c in range(8):
            mine = cells[:, c]
            new = (mine != 0) & ~(cells[:, :c] == mine[:, None]).any(1)
            masks = ((cells[new] == mine[new][:, None]) << np.arange(8)).sum(1)
            labels.append(mine[new])
            found.append(table[masks])
        names, place = np.unique(np.concatenate(labels), return_inverse=True)
        return pd.DataFrame({"label": names.astype(np.int64), "area": np.bincount(place, np.concatenate(found), len(names))})

    return fold_blocks(image.df, dims, fold, "label bigint, area double", (1, 1, 1), "Zero").groupBy("label").agg(F.sum("area").alias("surface_area"))


def _neighbourhoods(points: np.ndarray, links: tuple[np.ndarray, np.ndarray], steps: np.ndarray, centres: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(centre's place in centres, point) of the points within radius of each centre along the surface.

    links: CSR rows of neighbours of every point, steps their distances. Neighbourhoods grow in rounds; once a centre has
    three points, its normal is estimated after each round, and growth goes on to points that lie no nearer to the centre than
    those before them, seen along the normal, so that it doesn't pass round bends to the surface's other side.
    """
    starts, ends = links
    count = len(points)
    key = np.arange(len(centres), dtype=np.int64) * count + centres
    known, dist = key, np.zeros(len(key))
    front, reach = key, dist
    normals = np.zeros((len(centres), 3))
    while len(front):
        who, at = front // count, front % count
        sizes = starts[at + 1] - starts[at]
        row = np.repeat(np.arange(len(front)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[at][row]
        to, far = ends[place], reach[row] + steps[place]
        near = far <= radius + 1e-6
        row, to, far = row[near], to[near], far[near]
        n = normals[who[row]]
        old, new = points[at[row]] - points[centres[who[row]]], points[to] - points[centres[who[row]]]
        flat = lambda d: (d * d).sum(1) - (d * n).sum(1) ** 2  # noqa: B023, E731
        outward = ~n.any(1) | (flat(new) >= flat(old) - 1e-5)
        key, far = (who[row] * count + to)[outward], far[outward]
        order = np.lexsort((far, key))
        key, far = key[order], far[order]
        least = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        key, far = key[least], far[least]
        spot = np.searchsorted(known, key)
        same = (spot < len(known)) & (known[np.minimum(spot, len(known) - 1)] == key)
        better = ~same | (far < dist[np.minimum(spot, len(known) - 1)])
        front, reach = key[better], far[better]
        dist[spot[same & better]] = far[same & better]
        known, dist = np.r_[known, key[~same]], np.r_[dist, far[~same]]
        order = np.argsort(known, kind="stable")
        known, dist = known[order], dist[order]
        who = known // count
        sizes = np.bincount(who, minlength=len(centres))
        enough = sizes >= 3
        normals[enough] = _frames(points[known % count], who, sizes)[enough][:, :, 0]
    return known // count, known % count


def _frames(p: np.ndarray, who: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Axes (columns, of least variance first) of each group of points."""
    total = lambda w: np.bincount(who, w, len(sizes))
    mean = np.stack([total(p[:, i]) for i in range(3)], axis=1) / sizes[:, None]
    d = p - mean[who]
    m = np.empty((len(sizes), 3, 3))
    for i in range(3):
        for j in range(3):
            m[:, i, j] = total(d[:, i] * d[:, j]) / sizes
    return np.linalg.eigh(m)[1]


def _curvatures(solid: np.ndarray, inner: np.ndarray, margin: np.ndarray, radius: float, mode: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices, kappa1, kappa2) of the surface pixels of solid within inner; margin: pixels of the image; mode: how solid goes on beyond the array."""
    padded = np.pad(solid, 1, mode=mode)
    view = lambda d: padded[tuple(slice(1 + o, 1 + o + n) for o, n in zip(d, solid.shape, strict=True))]
    around = [d for d in np.ndindex(3, 3, 3) if d != (1, 1, 1)]
    around = [tuple(int(c) - 1 for c in d) for d in around]
    faces = [d for d in around if sum(map(abs, d)) == 1]
    surface = solid & margin & ~np.logical_and.reduce([view(d) for d in faces])
    points = np.argwhere(surface)
    if not (surface & inner).any():
        return np.zeros((0, 3), int), np.zeros(0), np.zeros(0)
    number = np.full(np.array(solid.shape) + 2, -1)
    number[1:-1, 1:-1, 1:-1][surface] = np.arange(len(points))
    near = np.stack([number[tuple((points + 1 + d).T)] for d in around], axis=1)
    starts = np.r_[0, np.cumsum((near >= 0).sum(1))]
    steps = np.broadcast_to(np.sqrt((np.array(around) ** 2).sum(1)), near.shape)[near >= 0]
    centres = np.flatnonzero(inner[surface])
    background = np.stack([~padded[tuple((points[centres] + 1 + d).T)] for d in around], axis=1)
    k1, k2 = np.empty(len(centres)), np.empty(len(centres))
    at = points.astype(float)
    for i in range(0, len(centres), CENTRES):
        part = centres[i : i + CENTRES]
        who, member = _neighbourhoods(at, (starts, near[near >= 0]), steps, part, radius)
        frames = _frames(at[member], who, np.bincount(who, minlength=len(part)))
        normal = frames[:, :, 0]
        seen = background[i : i + CENTRES]
        normal = np.where(((seen & ((normal @ np.array(around).T) > 0)).sum(1) < seen.sum(1) / 2)[:, None], -normal, normal)
        d = at[member] - at[part][who]
        x, y, z = ((d * axis[who]).sum(1) for axis in (frames[:, :, 2], frames[:, :, 1], normal))
        terms = [x * x, x * y, y * y, np.ones_like(x)]
        total = lambda w: np.bincount(who, w, len(part))  # noqa: B023, E731
        m = np.stack([np.stack([total(p * q) for q in terms], axis=1) for p in terms], axis=1)
        values = np.linalg.eigvalsh(m)
        good = values[:, 0] > 1e-9 * values[:, -1]
        m[~good] = np.eye(4)
        a, b, c, _ = np.linalg.solve(m, np.stack([total(p * z) for p in terms], axis=1)[:, :, None])[:, :, 0].T
        root = np.sqrt((a - c) ** 2 + b * b)
        k1[i : i + CENTRES], k2[i : i + CENTRES] = (np.where(good, a + c + sign * root, np.nan) for sign in (1, -1))
    return points[centres], k1, k2


def curvature(image: Image, radius: float = 5.0, boundary: str = "Nearest", elsewhere: float = math.nan) -> tuple[Image, Image]:
    """The largest and the smallest principal curvature at foreground pixels that touch background by a face; elsewhere at others.

    A quadric a x^2 + b x y + c y^2 + d is fitted, by least squares, to the surface pixels within radius along the surface, in the
    frame of their principal axes with the normal towards background: curvature is negative where the body bulges. NaN where pixels are too few.
    """
    reach = math.ceil(radius) + 1
    halo = tuple(reach if n > 1 else 0 for n in image.dims)
    dims = image.dims

    def kernel(arrays: list[np.ndarray], first: tuple[int, int, int]) -> list[np.ndarray]:
        solid = arrays[0] != 0
        places = [np.arange(n) + f - h for n, f, h in zip(solid.shape, first, halo, strict=True)]
        x, y, z = ((p >= 0) & (p < d) for p, d in zip(places, dims, strict=True))
        margin = x[:, None, None] & y[None, :, None] & z[None, None, :]
        inner = tuple(slice(h, n - h) for h, n in zip(halo, solid.shape, strict=True))
        own = np.zeros(solid.shape, bool)
        own[inner] = True
        at, *kappas = _curvatures(solid, own, margin, radius, "edge" if boundary == "Nearest" else "constant")
        out = []
        for k in kappas:
            full = np.full(solid.shape, float(elsewhere))
            full[tuple(at.T)] = k
            out.append(full[inner])
        return out

    df = over_blocks(image.df.select(*AXES, pix()), dims, kernel, halo, boundary, 2)
    df = df.select(*AXES, *[F.coalesce(k, F.lit(math.nan)).alias(k) for k in ("v0", "v1")])  # NaN leaves a kernel as null
    return as_image(image, df, "v0", "float32"), as_image(image, df, "v1", "float32")
