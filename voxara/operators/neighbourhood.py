"""Neighbourhood filters over blocks with halos.

Pixels are dealt to blocks of BLOCK pixels and, near a face, to the neighbouring blocks as well; each block is then
one dense array with its halo, so a filter needs one shuffle whatever its radius, and a task holds one block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from voxara.raster import AXES, Image, pixel_round

BLOCK = (64, 64, 64)


def blockwise(image: Image, kernel: Callable[[np.ndarray], np.ndarray], halo: tuple[int, int, int], boundary: str = "Nearest", dtype: str | None = None) -> Image:
    """kernel gets a block [x, y, z] with its halo and returns the block without it. Outside the image pixels are 0 (Zero) or the nearest ones (Nearest)."""
    dims, halo = image.dims, tuple(min(r, 10**6) if n > 1 else 0 for r, n in zip(halo, image.dims, strict=True))
    df = image.df
    for a, n, r in zip(AXES, BLOCK, halo, strict=True):
        df = df.withColumn(f"b{a}", F.explode(F.sequence(F.floor((F.col(a) - r) / n), F.floor((F.col(a) + r) / n))))
    inside = None
    for a, n, d in zip(AXES, BLOCK, dims, strict=True):
        c = (F.col(f"b{a}") >= 0) & (F.col(f"b{a}") * n < d)
        inside = c if inside is None else inside & c
    kind = dtype or image.dtype

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = [int(pdf[f"b{a}"].iloc[0]) * n for a, n in zip(AXES, BLOCK, strict=True)]
        stop = [min(f + n, d) for f, n, d in zip(first, BLOCK, dims, strict=True)]
        low = [max(0, f - r) for f, r in zip(first, halo, strict=True)]
        high = [min(d, s + r) for d, s, r in zip(dims, stop, halo, strict=True)]
        block = np.zeros([h - w for h, w in zip(high, low, strict=True)])
        block[tuple(pdf[a].to_numpy() - w for a, w in zip(AXES, low, strict=True))] = pdf["v"].to_numpy()
        pads = [(w - (f - r), s + r - h) for w, f, r, s, h in zip(low, first, halo, stop, high, strict=True)]
        out = kernel(np.pad(block, pads, mode="edge" if boundary == "Nearest" else "constant"))
        at = np.indices(out.shape).reshape(3, -1)
        return pd.DataFrame({**{a: at[i] + first[i] for i, a in enumerate(AXES)}, "v": out.ravel().astype(float)})

    out = df.filter(inside).groupBy("bx", "by", "bz").applyInPandas(run, "x bigint, y bigint, z bigint, v double")
    return image.with_rows(out.select(*AXES, pixel_round(F.col("v"), kind).alias("v")), dtype=kind)


def offsets(radius: tuple[int, int, int], kind: str) -> list[tuple[int, int, int]]:
    """Offsets of a Rectangular or Ellipsoidal neighbourhood."""
    out = []
    for o in np.ndindex(*(2 * r + 1 for r in radius)):
        p = tuple(i - r for i, r in zip(o, radius, strict=True))
        if kind == "Rectangular" or sum((c / r) ** 2 for c, r in zip(p, radius, strict=True) if r) <= 1 + 1e-9:
            out.append(p)
    return out


def _shifted(block: np.ndarray, radius: tuple, o: tuple) -> np.ndarray:
    return block[tuple(slice(r + c, n - r + c) for r, c, n in zip(radius, o, block.shape, strict=True))]


REDUCTIONS = ("minfilter", "maxfilter", "medianfilter", "meanfilter", "variancefilter", "stddevfilter")
#: Bytes of the neighbours' values that a kernel stacks at a time.
STACK_BYTES = 1 << 26


def _by_slabs(block: np.ndarray, radius: tuple, places: list[tuple], f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """f(stack of all neighbours' values, the pixels' own values) for slabs along x whose stacks take at most STACK_BYTES, or one plane."""
    own = _shifted(block, radius, (0, 0, 0))
    step = max(1, STACK_BYTES // (8 * len(places) * own.shape[1] * own.shape[2]))
    out = np.empty(own.shape)
    for x in range(0, own.shape[0], step):
        slab = block[x : min(x + step, own.shape[0]) + 2 * radius[0]]
        out[x : x + step] = f(np.stack([_shifted(slab, radius, o) for o in places]), own[x : x + step])
    return out


def _moments(block: np.ndarray, radius: tuple, places: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample variance over the neighbours, summed up one neighbour after the other around the pixel's own value."""
    own = _shifted(block, radius, (0, 0, 0))
    total, squares = np.zeros(own.shape), np.zeros(own.shape)
    for o in places:
        d = _shifted(block, radius, o) - own
        total += d
        squares += d * d
    n = len(places)
    return own + total / n, np.maximum(squares - total * total / n, 0.0) / max(1, n - 1)


def rank_filter(name: str, image: Image, radius: tuple = (1, 1, 1), kind: str = "Ellipsoidal", boundary: str = "Nearest") -> Image:
    radius = tuple(r if n > 1 else 0 for r, n in zip(radius, image.dims, strict=True))
    places = offsets(radius, kind)

    def kernel(block: np.ndarray) -> np.ndarray:
        if name in ("minfilter", "maxfilter"):
            best = np.minimum if name == "minfilter" else np.maximum
            out = _shifted(block, radius, places[0]).copy()
            for o in places[1:]:
                best(out, _shifted(block, radius, o), out)
            return out
        if name == "medianfilter":
            return _by_slabs(block, radius, places, lambda stack, _own: np.median(stack, 0))
        mean, variance = _moments(block, radius, places)
        return mean if name == "meanfilter" else variance if name == "variancefilter" else np.sqrt(variance)

    return blockwise(image, kernel, radius, boundary)


def opening(image: Image, radius: tuple = (1, 1, 1), kind: str = "Ellipsoidal", boundary: str = "Nearest") -> Image:
    return rank_filter("maxfilter", rank_filter("minfilter", image, radius, kind, boundary), radius, kind, boundary)


def closing(image: Image, radius: tuple = (1, 1, 1), kind: str = "Ellipsoidal", boundary: str = "Nearest") -> Image:
    return rank_filter("minfilter", rank_filter("maxfilter", image, radius, kind, boundary), radius, kind, boundary)


def derivative_taps(sigma: float, order: int) -> np.ndarray:
    """A sampled Gaussian of unit sum, or its first or second derivative, over three sigmas."""
    r = max(1, int(np.ceil(3 * sigma)))
    t = np.arange(-r, r + 1)
    g = np.exp(-t * t / (2 * sigma * sigma))
    g /= g.sum()
    return g if order == 0 else -t / sigma**2 * g if order == 1 else (t * t / sigma**4 - 1 / sigma**2) * g


def gaussian(image: Image, sigma: tuple[float, float, float], orders: tuple[int, int, int] = (0, 0, 0), boundary: str = "Nearest", dtype: str | None = None) -> Image:
    """Separable convolution with Gaussians (order 0) or their derivatives."""
    taps = [derivative_taps(s, o) if n > 1 and s > 0 else np.ones(1) for s, o, n in zip(sigma, orders, image.dims, strict=True)]

    def kernel(block: np.ndarray) -> np.ndarray:
        for axis, k in enumerate(taps):
            n = block.shape[axis] - len(k) + 1
            block = sum(c * np.take(block, range(i, i + n), axis) for i, c in enumerate(k[::-1]))
        return block

    return blockwise(image, kernel, tuple(len(k) // 2 for k in taps), boundary, dtype)


def derivative(image: Image, sigma: tuple, first: int, second: int = -1, boundary: str = "Nearest") -> Image:
    orders = [0, 0, 0]
    orders[first] += 1
    if second >= 0:
        orders[second] += 1
    return gaussian(image, sigma, tuple(orders), boundary, "float32")


def gradient_magnitude(image: Image, sigma: float = 1.0) -> Image:
    parts = [derivative(image, (sigma,) * 3, i).df.select(*AXES, F.col("v").alias(f"d{i}")) for i in range(3) if image.dims[i] > 1]
    df = parts[0]
    for p in parts[1:]:
        df = df.join(p, list(AXES))
    squares = sum((F.col(c) * F.col(c) for c in df.columns if c.startswith("d")), F.lit(0.0))
    return image.with_rows(df.select(*AXES, F.sqrt(squares).alias("v")), dtype="float32")


def high_pass(image: Image, sigma: tuple, shift: float = 0.0) -> Image:
    low = gaussian(image, sigma, dtype="float32").df.select(*AXES, F.col("v").alias("g"))
    return image.with_rows(image.df.join(low, list(AXES)).select(*AXES, pixel_round(F.col("v") - F.col("g") + shift, image.dtype).alias("v")))


def vawe(image: Image, radius: tuple, noise: float, kind: str = "Ellipsoidal", boundary: str = "Nearest") -> Image:
    """Variance-weighted mean: flat neighbourhoods get their mean, those with more variance than the noise keep their pixel."""
    radius = tuple(r if n > 1 else 0 for r, n in zip(radius, image.dims, strict=True))
    places = offsets(radius, kind)

    def kernel(block: np.ndarray) -> np.ndarray:
        (mean, local), own, g = _moments(block, radius, places), _shifted(block, radius, (0, 0, 0)), noise * noise
        m = np.where(g <= local, g / np.where(local > 0, local, 1.0), 1.0)
        return own - m * (own - mean)

    return blockwise(image, kernel, radius, boundary)


def bilateral(image: Image, spatial: tuple[float, float, float], radiometric: float, boundary: str = "Nearest") -> Image:
    """Means weighted by Gaussians of distance and of difference in value, over three spatial sigmas."""
    radius = tuple(int(np.ceil(3 * s)) if n > 1 else 0 for s, n in zip(spatial, image.dims, strict=True))
    places = offsets(radius, "Rectangular")

    def kernel(block: np.ndarray) -> np.ndarray:
        own = _shifted(block, radius, (0, 0, 0))
        total, weights = np.zeros(own.shape), np.zeros(own.shape)
        for o in places:
            there = _shifted(block, radius, o)
            far = sum((c / s) ** 2 for c, s in zip(o, spatial, strict=True) if c)
            w = np.exp(-0.5 * far - 0.5 * ((there - own) / radiometric) ** 2)
            total += w * there
            weights += w
        return total / weights

    return blockwise(image, kernel, radius, boundary)


def bilateral_sampled(image: Image, spatial: float, radiometric: float, samples: int = 0, boundary: str = "Nearest", seed: int = 0) -> Image:
    """bilateral with so many neighbours (0: a tenth of all, 50 at least), drawn once with probabilities by the spatial Gaussian, which then needs no weight of its own."""
    radius = tuple(int(np.ceil(3 * spatial)) if n > 1 else 0 for n in image.dims)
    places = offsets(radius, "Rectangular")
    weight = np.exp([-0.5 * sum(c * c for c in o) / spatial**2 for o in places])
    count = samples or max(50, len(places) // 10)
    drawn = [places[i] for i in np.random.default_rng(seed).choice(len(places), count, p=weight / weight.sum())] + [(0, 0, 0)]

    def kernel(block: np.ndarray) -> np.ndarray:
        own = _shifted(block, radius, (0, 0, 0))
        total, weights = np.zeros(own.shape), np.zeros(own.shape)
        for o in drawn:
            there = _shifted(block, radius, o)
            w = np.exp(-0.5 * ((there - own) / radiometric) ** 2)
            total += w * there
            weights += w
        return total / weights

    return blockwise(image, kernel, radius, boundary)


def gradient(image: Image, sigma: float = 1.0) -> list[Image]:
    """The derivatives along each used axis."""
    return [derivative(image, (sigma,) * 3, i) for i in range(3) if image.dims[i] > 1]


def _otsu(stack: np.ndarray) -> np.ndarray:
    """For each pixel the value of its neighbourhood (axis 0) that parts it with the largest variance between the classes up to it and above; of equal ones the largest."""
    ordered = np.sort(stack, 0)
    n = len(ordered)
    sums = np.cumsum(ordered, 0)
    w = np.arange(1, n).reshape(-1, 1, 1, 1)
    between = (sums[:-1] * n - sums[-1] * w) ** 2 / (w * (n - w))
    # Equal values belong to one class, so only the last of them parts.
    between = np.where(ordered[1:] > ordered[:-1], between, -1.0)
    best = n - 2 - np.argmax(between[::-1], 0)
    return np.where(between.max(0) < 0, ordered[-1], np.take_along_axis(ordered, best[None], 0)[0])


def local_threshold(image: Image, radius: tuple = (1, 1, 1), method: str = "Otsu", argument: float | None = None, boundary: str = "Nearest") -> Image:
    """1 where a pixel is above its rectangular neighbourhood's threshold: Otsu, Mean, MidGrey, Median, Niblack or Bernsen."""
    if method not in ("Otsu", "Mean", "MidGrey", "Median", "Niblack", "Bernsen"):
        raise ValueError(f"No local threshold method {method}")
    radius = tuple(r if n > 1 else 0 for r, n in zip(radius, image.dims, strict=True))
    places = offsets(radius, "Rectangular")

    def threshold(stack: np.ndarray, own: np.ndarray) -> np.ndarray:
        x = argument if argument is not None else 1.0 if method == "Niblack" else 0.0
        if method == "Otsu":
            cut = _otsu(stack)
        elif method in ("Mean", "Median"):
            cut = (stack.mean(0) if method == "Mean" else np.median(stack, 0)) - x
        elif method == "Niblack":
            cut = stack.mean(0) + x * stack.std(0, ddof=1)
        else:
            low, high = stack.min(0), stack.max(0)
            cut = (low + high) / 2
            if method == "MidGrey":
                cut = cut - x
            else:
                least, centre = (argument if argument is not None else 127.5), 127.5
                cut = np.where(high - low < least, np.where(cut >= centre, low, high), cut)
        return (own > cut).astype(float)

    return blockwise(image, lambda block: _by_slabs(block, radius, places, threshold), radius, boundary)
