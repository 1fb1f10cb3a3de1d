"""Structure and orientation: eigenvalues of structure tensors and Hessians within blocks with halos, and what is made of them."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from voxara.operators.blocks import as_image, joined, over_blocks
from voxara.operators.neighbourhood import derivative_taps
from voxara.operators.regions import grow
from voxara.raster import AXES, Image, pix, pixel_round


def _reach(sigma: float) -> int:
    return max(1, math.ceil(3 * sigma)) if sigma > 0 else 0


def _convolve(block: np.ndarray, sigma: float, orders: tuple[int, int, int], used: list[bool]) -> np.ndarray:
    """Gaussians (order 0) or their derivatives along the used axes; the block shrinks by the kernel's reach along these."""
    for axis, order in enumerate(orders):
        if used[axis] and sigma > 0:
            taps = derivative_taps(sigma, order)
            n = block.shape[axis] - len(taps) + 1
            block = sum(c * np.take(block, range(i, i + n), axis) for i, c in enumerate(taps[::-1]))
        elif order:
            block = np.zeros_like(block)
    return block


def _orders(*axes: int) -> tuple[int, int, int]:
    return tuple(axes.count(i) for i in range(3))


def _symmetric(parts: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    m = np.empty((*parts[0, 0].shape, 3, 3))
    for (i, j), p in parts.items():
        m[..., i, j] = m[..., j, i] = p
    return m


def _angles(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """phi in [-pi, pi] and theta in [0, pi/2] of unit vectors; of the two opposite directions the one with z of at least 0."""
    v = np.where(v[..., 2:] < 0, -v, v)
    return np.arctan2(v[..., 1], v[..., 0]), np.arccos(np.clip(v[..., 2], -1, 1))


def _tensor_outputs(image: Image, derivative_sigma: float, smoothing_sigma: float, outputs: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], count: int):
    """outputs of the structure tensor's eigenvalues (largest first) and eigenvectors, as columns v0, v1 ..."""
    used = [n > 1 for n in image.dims]
    halo = tuple(_reach(derivative_sigma) + _reach(smoothing_sigma) if u else 0 for u in used)

    def kernel(arrays: list[np.ndarray], _first) -> list[np.ndarray]:
        d = [_convolve(arrays[0], derivative_sigma, _orders(i), used) for i in range(3)]
        parts = {(i, j): _convolve(d[i] * d[j], smoothing_sigma, (0, 0, 0), used) for i in range(3) for j in range(i, 3)}
        values, vectors = np.linalg.eigh(_symmetric(parts))
        return outputs(values[..., ::-1], vectors[..., ::-1])

    return over_blocks(joined([image]), image.dims, kernel, halo, "Nearest", count)


def cylindricality(image: Image, derivative_sigma: float = 1.0, smoothing_sigma: float = 1.0) -> Image:
    """(l2 - l3) / l1 times the energy l1 + l2 + l3; 0 where the tensor is 0."""

    def outputs(v: np.ndarray, _vectors: np.ndarray) -> list[np.ndarray]:
        top = np.where(v[..., 0] > 0, v[..., 0], 1.0)
        return [np.where(v[..., 0] > 0, (v[..., 1] - v[..., 2]) / top * v.sum(-1), 0.0)]

    return as_image(image, _tensor_outputs(image, derivative_sigma, smoothing_sigma, outputs, 1), dtype="float32")


def _orientation(image: Image, derivative_sigma: float, smoothing_sigma: float, which: int) -> tuple[Image, Image, Image]:
    found = _tensor_outputs(image, derivative_sigma, smoothing_sigma, lambda v, e: [v.sum(-1), *_angles(e[..., :, which])], 3)
    return tuple(as_image(image, found, f"v{i}", "float32") for i in range(3))


def cylinder_orientation(image: Image, derivative_sigma: float = 1.0, smoothing_sigma: float = 1.0) -> tuple[Image, Image, Image]:
    """(energy, phi, theta): the direction of least change. Of the two opposite directions the one with z of at least 0."""
    return _orientation(image, derivative_sigma, smoothing_sigma, 2)


def plate_orientation(image: Image, derivative_sigma: float = 1.0, smoothing_sigma: float = 1.0) -> tuple[Image, Image, Image]:
    """(energy, phi, theta): the direction of most change, a plane's normal."""
    return _orientation(image, derivative_sigma, smoothing_sigma, 0)


def mean_curvature(image: Image, sigma: float = 1.0) -> Image:
    """Minus half the divergence of the gradient's direction, times the gradient's norm."""
    used = [n > 1 for n in image.dims]
    halo = tuple(2 * _reach(sigma) if u else 0 for u in used)

    def kernel(arrays: list[np.ndarray], _first) -> list[np.ndarray]:
        g = [_convolve(arrays[0], sigma, _orders(i), used) for i in range(3)]
        norm = np.sqrt(sum(x * x for x in g)) + 1e-8
        total = sum(_convolve(x / norm, sigma, _orders(i), used) for i, x in enumerate(g))
        inner = tuple(slice(_reach(sigma), -_reach(sigma)) if u else slice(None) for u in used)
        return [-0.5 * total * norm[inner]]

    return as_image(image, over_blocks(joined([image]), image.dims, kernel, halo), dtype="float32")


def _hessian_filter(image: Image, sigma: float, response: Callable[[np.ndarray], np.ndarray], scale: float) -> Image:
    used = [n > 1 for n in image.dims]
    halo = tuple(_reach(sigma) if u else 0 for u in used)
    most = {"uint8": 255.0, "uint16": 65535.0}.get(image.dtype, 1.0)

    def kernel(arrays: list[np.ndarray], _first) -> list[np.ndarray]:
        parts = {(i, j): _convolve(arrays[0], sigma, _orders(i, j), used) for i in range(3) for j in range(i, 3)}
        with np.errstate(all="ignore"):
            return [np.nan_to_num(response(np.linalg.eigvalsh(_symmetric(parts))[..., ::-1]), nan=0.0, posinf=0.0, neginf=0.0) * (scale or most)]

    return as_image(image, over_blocks(joined([image]), image.dims, kernel, halo))


def sato(image: Image, sigma: float, scale: float = 0.0, gamma23: float = 1.0, gamma12: float = 1.0, alpha: float = 0.5) -> Image:
    """Sato's line filter of the Hessian's eigenvalues. scale 0: the largest pixel of uint8 or uint16, or 1."""

    def response(v: np.ndarray) -> np.ndarray:
        one, two, three = (v[..., i] for i in range(3))
        line = np.abs(three) * np.power(two / three, gamma23)
        falls, rises = np.power(1 + one / np.abs(two), gamma12), np.power(1 - alpha * one / np.abs(two), gamma12)
        ordered = (three < two) & (two < one)
        return np.where(ordered & (one <= 0), line * falls, np.where((three < two) & (two < 0) & (one > 0) & (one < np.abs(two) / alpha), line * rises, 0.0))

    return _hessian_filter(image, sigma, response, scale)


def frangi(image: Image, sigma: float, scale: float = 0.0, c: float = 0.25, alpha: float = 0.5, beta: float = 0.5) -> Image:
    """Frangi's vesselness of the Hessian's eigenvalues in the order of their magnitudes. scale as in sato."""

    def response(v: np.ndarray) -> np.ndarray:
        v = np.take_along_axis(v, np.argsort(np.abs(v), -1, kind="stable"), -1)
        one, two, three = (np.abs(v[..., i]) for i in range(3))
        plate, blob, all_ = two / three, one / np.sqrt(two * three), (v * v).sum(-1)
        out = (1 - np.exp(-(plate**2) / (2 * alpha**2))) * np.exp(-(blob**2) / (2 * beta**2)) * (1 - np.exp(-all_ / (2 * c * c)))
        return np.where((v[..., 1] > 0) | (v[..., 2] > 0), 0.0, out)

    return _hessian_filter(image, sigma, response, scale)


def _between(a: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    """Linear interpolation at real positions inside the array."""
    low = [np.clip(np.floor(p).astype(int), 0, n - 1) for p, n in zip(at, a.shape, strict=True)]
    high = [np.minimum(p + 1, n - 1) for p, n in zip(low, a.shape, strict=True)]
    part = [p - q for p, q in zip(at, low, strict=True)]
    out = 0.0
    for corner in np.ndindex(2, 2, 2):
        w = 1.0
        for c, f in zip(corner, part, strict=True):
            w = w * (f if c else 1 - f)
        out = out + w * a[tuple(h if c else q for c, q, h in zip(corner, low, high, strict=True))]
    return out


def canny_classes(image: Image, sigma: float, lower: float, upper: float) -> Image:
    """The first part of Canny's edge detection: 0, or at maxima of the gradient along its direction 1 from lower on and 2 from upper on."""
    used = [n > 1 for n in image.dims]
    halo = tuple(_reach(sigma) + 1 if u else 0 for u in used)

    def kernel(arrays: list[np.ndarray], _first) -> list[np.ndarray]:
        g = [_convolve(arrays[0], sigma, _orders(i), used) for i in range(3)]
        inner = tuple(slice(1, -1) if u else slice(None) for u in used)
        own = [x[inner] for x in g]
        norm = np.sqrt(sum(x * x for x in own))
        unit = [np.where(norm > 0, x / np.where(norm > 0, norm, 1.0), 0.0) for x in own]
        place = np.indices(norm.shape).astype(float) + np.array([1.0 if u else 0.0 for u in used]).reshape(3, 1, 1, 1)
        sides = [np.sqrt(sum(_between(x, [p + s * d for p, d in zip(place, unit, strict=True)]) ** 2 for x in g)) for s in (1, -1)]
        top = (norm > sides[0] + 1e-12) & (norm > sides[1] + 1e-12)
        return [np.where(top & (norm >= lower), np.where(norm >= upper, 2.0, 1.0), 0.0)]

    return as_image(image, over_blocks(joined([image]), image.dims, kernel, halo))


def canny_edges(classes: Image) -> Image:
    """The second part: 1 at strong edges and at weak ones joined to them."""
    return grow(classes, 2, 1).map((pix() > 1).cast("double"))


def canny(image: Image, sigma: float, lower: float, upper: float) -> Image:
    return canny_edges(canny_classes(image, sigma, lower, upper))


def _angle_to(phi: Column, theta: Column, phim: float, thetam: float) -> Column:
    dot = (F.cos(phi) * math.cos(phim) + F.sin(phi) * math.sin(phim)) * F.sin(theta) * math.sin(thetam) + F.cos(theta) * math.cos(thetam)
    return F.acos(F.abs(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))))


def orientation_difference(phi: Image, theta: Image, phim: float, thetam: float) -> Image:
    """The angle between each orientation and a main one, from 0 to half pi."""
    return phi.with_rows(joined([phi, theta]).select(*AXES, _angle_to(F.col("v0"), F.col("v1"), phim, thetam).alias("v")), dtype="float32")


def _rgb(hue: Column, saturation: Column, value: Column) -> list[Column]:
    """Red, green and blue from 0 to 255, of a hue in radians and a saturation and value from 0 to 1."""
    sixth = F.pmod(hue * 57.2957795, F.lit(360.0)) / 60
    i = F.floor(sixth)
    part = sixth - i
    p, q, t = value * (1 - saturation), value * (1 - saturation * part), value * (1 - saturation * (1 - part))
    order = [(value, t, p), (q, value, p), (p, value, t), (p, q, value), (t, p, value)]
    out = []
    for c in range(3):
        chain = F.when(saturation <= 0, value)
        for k, sector in enumerate(order):
            chain = chain.when(i == k, sector[c])
        out.append(pixel_round(chain.otherwise((value, p, q)[c]) * 255, "uint8"))
    return out


def _coloured(geometry: Image, phi: Image, theta: Image, hue: Column, saturation: Column) -> tuple[Image, Image, Image]:
    top = geometry.df.agg(F.max("v")).first()[0] or 1.0
    df = joined([geometry, phi, theta])
    colours = _rgb(hue, saturation, F.col("v0") / float(top))
    return tuple(geometry.with_rows(df.select(*AXES, c.alias("v")), dtype="uint8") for c in colours)


def main_orientation_color(geometry: Image, phi: Image, theta: Image, phim: float, thetam: float) -> tuple[Image, Image, Image]:
    """Red, green and blue: hue is twice the angle to the main orientation, value the geometry over its maximum."""
    return _coloured(geometry, phi, theta, 2 * _angle_to(F.col("v1"), F.col("v2"), phim, thetam), F.lit(1.0))


def axelsson_color(geometry: Image, phi: Image, theta: Image) -> tuple[Image, Image, Image]:
    """Red, green and blue: hue is twice phi, saturation falls with the direction's z, value is the geometry over its maximum."""
    return _coloured(geometry, phi, theta, 2 * F.col("v1"), 1 - F.abs(F.cos(F.col("v2"))))
