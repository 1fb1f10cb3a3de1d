"""Fourier transforms by separable passes: each pass is a kernel over the lines along one axis, so a task holds lines and never the volume."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxara.operators.generate import set_edges
from voxara.operators.lines import over_lines
from voxara.raster import AXES, Image, pix


def _pass(df: DataFrame, axis: int, dims: tuple[int, int, int], size: int, inverse: bool = False, half: bool = False) -> DataFrame:
    """Transforms lines along an axis of dims to size values; half: the other half of a line is the conjugate (real data)."""

    def run(arrays: list[np.ndarray]) -> list[np.ndarray]:
        if half and not inverse:
            out = np.fft.rfft(arrays[0], axis=1)
        else:
            lines = arrays[0] + 1j * arrays[1]
            if half:
                real = np.fft.irfft(lines, size, axis=1)
                return [real, np.zeros_like(real)]
            out = np.fft.ifft(lines, axis=1) if inverse else np.fft.fft(lines, axis=1)
        return [out.real, out.imag]

    return over_lines(df, axis, dims, run, size)


def fft(image: Image) -> DataFrame:
    """x, y, z, re, im of the unnormalised transform; x runs to half the width, as the rest is the conjugate."""
    w, h, d = image.dims
    df = _pass(image.df.select(*AXES, pix().alias("re"), F.lit(0.0).alias("im")), 0, image.dims, w // 2 + 1, half=True)
    for axis, n in ((1, h), (2, d)):
        if n > 1:
            df = _pass(df, axis, (w // 2 + 1, h, d), n)
    return df


def ifft(transform: DataFrame, dims: tuple[int, int, int]) -> Image:
    """The real image of size dims that a transform is of."""
    w, h, d = dims
    kept = (w // 2 + 1, h, d)
    transform = transform.select(*AXES, "re", "im")
    for axis, n in ((2, d), (1, h)):
        if n > 1:
            transform = _pass(transform, axis, kept, n, True)
    df = _pass(transform, 0, kept, w, True, True)
    return Image(df.select(*AXES, F.col("re").alias("v")), dims, "float32")


def band_pass(image: Image, least: float = 3.0, most: float = 40.0, zero_edges: bool = True) -> Image:
    """Removes variations smaller than least and larger than most pixels, by Gaussian transfer functions of half these sizes."""
    low, high = max(0.0, least / 2), max(0.0, most / 2)
    if zero_edges and (width := math.ceil(1.5 * low)) > 0:
        image = set_edges(image, 0, width)
    a, b = F.lit(0.0), F.lit(0.0)
    for axis, n in zip(AXES, image.dims, strict=True):
        f = F.col(axis) if axis == "x" else F.least(F.col(axis), F.lit(n) - F.col(axis))
        a = a + F.pow(f * (math.sqrt(2) * math.pi * high / n), 2)
        b = b + F.pow(f * (math.sqrt(2) * math.pi * low / n), 2)
    keep = (1 - F.exp(-a)) * F.exp(-b)
    return ifft(fft(image).select(*AXES, (F.col("re") * keep).alias("re"), (F.col("im") * keep).alias("im")), image.dims)


def power_spectrum(image: Image) -> Image:
    """The squared magnitudes of the transform."""
    w, h, d = image.dims
    return Image(fft(image).select(*AXES, (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("v")), (w // 2 + 1, h, d), "float32")
