"""Parts of tomographic reconstruction: filters of back-projection and removal of dead detector pixels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from voxara.operators.neighbourhood import rank_filter
from voxara.raster import AXES, Image, pix, pixel_round

#: Windows over the ramp, as functions of the frequency over the cut-off, from 0 to 1.
WINDOWS = {
    "Ramp": lambda t: np.ones_like(t), "Shepp-Logan": lambda t: np.sinc(t / 2), "Cosine": lambda t: np.cos(math.pi * t / 2), "Hamming": lambda t: 0.54 + 0.46 * np.cos(math.pi * t), "Hann": lambda t: 0.5 + 0.5 * np.cos(math.pi * t),
    "Blackman": lambda t: 0.42 + 0.5 * np.cos(math.pi * t) + 0.08 * np.cos(2 * math.pi * t), "Parzen": lambda t: np.where(t <= 0.5, 1 - 6 * t * t * (1 - t), 2 * np.maximum(1 - t, 0) ** 3),
}


def projection_filter(size: int, kind: str = "Ramp", cut_off: float = 1.0) -> np.ndarray:
    """A filter's values at size frequencies from 0 to the highest.

    Ideal ramp is linear. The others start from the transform of the sampled ramp kernel (1/4 at 0, -1/(pi k)^2 at odd k),
    which keeps the mean, and apply a window over the ramp's value divided by the cut-off.
    """
    if kind == "Ideal ramp":
        return np.linspace(0, 1, size)
    if kind not in WINDOWS:
        raise ValueError(f"No filter {kind}; there are Ideal ramp, {', '.join(WINDOWS)}")
    k = np.arange(-(size - 1), size - 1)
    taps = np.where(k % 2 == 1, -1 / (math.pi * np.where(k == 0, 1, k)) ** 2, 0.0)
    taps[k == 0] = 0.25
    ramp = 2 * np.fft.fft(np.fft.ifftshift(taps)).real[:size]
    out = ramp * WINDOWS[kind](np.abs(ramp) / cut_off)
    return np.where((np.arange(size) > 0) & (np.abs(ramp) > cut_off), 0.0, out)


def create_filter(spark: SparkSession, size: int = 100, kind: str = "Ramp", cut_off: float = 1.0) -> Image:
    """The filter as an image of one row."""
    rows = [(i, 0, 0, float(v)) for i, v in enumerate(projection_filter(size, kind, cut_off))]
    return Image(spark.createDataFrame(rows, "x bigint, y bigint, z bigint, v double"), (size, 1, 1), "float32")


def remove_dead_pixels(image: Image, radius: int = 1, magnitude: float = 10.0) -> Image:
    """In each slice, NaN pixels and those that differ from the median of their square by more than magnitude standard deviations of that difference get the median."""
    if radius <= 0 or magnitude <= 0:
        raise ValueError("Radius and magnitude must be positive")
    medians = rank_filter("medianfilter", image, (radius, radius, 0), "Rectangular").df.select(*AXES, F.col("v").alias("m"))
    both = image.df.join(medians, list(AXES)).withColumn("gap", F.abs(pix() - F.col("m")))
    spread = both.groupBy("z").agg(F.stddev_samp("gap").alias("s"))
    new = F.when(F.isnan(pix()) | (F.col("gap") > magnitude * F.col("s")), F.col("m")).otherwise(pix())
    return image.with_rows(both.join(F.broadcast(spread), "z").select(*AXES, pixel_round(new, image.dtype).alias("v")))
