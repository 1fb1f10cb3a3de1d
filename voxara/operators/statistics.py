"""Whole-image statistics, projections, histograms, binning and automatic thresholds: group-by aggregates with map-side combine."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxara.operators import thresholds
from voxara.raster import AXES, Image, check_same, pix, pixel_round


def _number() -> Column:
    """The pixel value, null for NaN."""
    return F.when(~F.isnan(pix()), pix())


#: Statistics over pixels; minima and maxima skip NaN.
STATISTICS: dict[str, Callable[[], Column]] = {
    "sum": lambda: F.sum("v"), "squaresum": lambda: F.sum(pix() * pix()), "minval": lambda: F.min(_number()), "maxval": lambda: F.max(_number()), "mean": lambda: F.avg("v"), "stddev": lambda: F.stddev_samp("v"),
}
PROJECTIONS = {"sumproject": "sum", "meanproject": "mean", "minproject": "minval", "maxproject": "maxval"}
BINNING = {"mean": "mean", "sum": "sum", "min": "minval", "max": "maxval"}


def statistic(name: str, image: Image) -> DataFrame:
    return image.df.agg(STATISTICS[name]().alias("v"))


def statistics(image: Image) -> DataFrame:
    """All of STATISTICS in one pass."""
    return image.df.agg(*[c().alias(n) for n, c in STATISTICS.items()])


def masked_mean(image: Image, ignored: float, square_root: bool = False) -> DataFrame:
    used = F.when(~(F.isnan(pix()) if math.isnan(ignored) else pix() == ignored), pix())
    return image.df.agg((F.sqrt(F.avg(used * used)) if square_root else F.avg(used)).alias("v"))


def project(name: str, image: Image, dimension: int = 2) -> Image:
    """The image without one dimension: the others move up."""
    keep = [i for i in range(3) if i != dimension]
    out = image.df.groupBy(*[AXES[i] for i in keep]).agg(STATISTICS[PROJECTIONS[name]]().alias("v"))
    a, b = (F.col(AXES[i]) for i in keep)
    return image.with_rows(out.select(a.alias("x"), b.alias("y"), F.lit(0).alias("z"), "v"), (image.dims[keep[0]], image.dims[keep[1]], 1), "float32" if name in ("sumproject", "meanproject") else image.dtype)


def project_values(name: str, image: Image, values: Image, dimension: int = 2) -> Image:
    """The value, in a second image, at the place of the least (minproject) or largest (maxproject) pixel; of equal ones the first."""
    check_same(image, values)
    keep = [i for i in range(3) if i != dimension]
    both = image.df.join(values.df.select(*AXES, F.col("v").alias("w")), list(AXES))
    place = F.col(AXES[dimension])
    best = F.min(F.struct("v", place.alias("p"), "w")) if name == "minproject" else F.min(F.struct((-pix()).alias("v"), place.alias("p"), "w"))
    out = both.groupBy(*[AXES[i] for i in keep]).agg(best.alias("b"))
    a, b = (F.col(AXES[i]) for i in keep)
    return values.with_rows(out.select(a.alias("x"), b.alias("y"), F.lit(0).alias("z"), F.col("b.w").alias("v")), (image.dims[keep[0]], image.dims[keep[1]], 1))


def bin_of(v: Column, low: float, high: float, bins: int) -> Column:
    """The bin of a value; values outside go to the first or last, NaN to the first."""
    k = F.floor((v - low) / (high - low) * bins)
    return F.when(F.isnan(v), F.lit(0)).otherwise(F.least(F.greatest(k, F.lit(0)), F.lit(bins - 1))).cast("bigint")


def histogram(image: Image, low: float, high: float, bins: int, weight: Image | None = None) -> DataFrame:
    """bin, bin_start, n of every bin, empty ones too."""
    df, n = image.df, F.count("*").cast("double")
    if weight:
        check_same(image, weight)
        df, n = df.join(weight.df.select(*AXES, F.col("v").alias("w")), list(AXES)), F.sum("w")
    counts = df.groupBy(bin_of(pix(), low, high, bins).alias("bin")).agg(n.alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.lit(float(low)) + F.col("bin") * ((high - low) / bins)).alias("bin_start"), F.coalesce("n", F.lit(0.0)).alias("n"))


def histogram2(a: Image, low_a: float, high_a: float, bins_a: int, b: Image, low_b: float, high_b: float, bins_b: int, weight: Image | None = None) -> DataFrame:
    """bin_a, bin_b, n of the pairs of bins that occur."""
    check_same(a, b)
    df, n = a.df.join(b.df.select(*AXES, F.col("v").alias("v2")), list(AXES)), F.count("*").cast("double")
    if weight:
        df, n = df.join(weight.df.select(*AXES, F.col("v").alias("w")), list(AXES)), F.sum("w")
    return df.groupBy(bin_of(pix(), low_a, high_a, bins_a).alias("bin_a"), bin_of(F.col("v2"), low_b, high_b, bins_b).alias("bin_b")).agg(n.alias("n"))


def bin_image(image: Image, factor: tuple[int, int, int], kind: str = "mean") -> Image:
    dims = tuple(max(1, n // f) for n, f in zip(image.dims, factor, strict=True))
    places = [(F.col(a) / F.lit(f)).cast("bigint").alias(a) for a, f in zip(AXES, factor, strict=True)]
    inside = [F.col(a) < d for a, d in zip(AXES, dims, strict=True)]
    out = image.df.select(*places, "v").filter(inside[0] & inside[1] & inside[2]).groupBy(*AXES).agg(STATISTICS[BINNING[kind]]().alias("v"))
    return image.with_rows(out.select(*AXES, pixel_round(pix(), image.dtype).alias("v")), dims)


def masked_bin(image: Image, factor: int, bad: float = 0.0, undefined: float = 0.0) -> Image:
    """Means over pixels that aren't bad; undefined where all are."""
    good = image.df.select(*AXES, F.when(pix() != bad, pix()).alias("v"))
    places = [(F.col(a) / F.lit(factor)).cast("bigint").alias(a) for a in AXES]
    dims = tuple(max(1, n // factor) for n in image.dims)
    inside = [F.col(a) < d for a, d in zip(AXES, dims, strict=True)]
    out = good.select(*places, "v").filter(inside[0] & inside[1] & inside[2]).groupBy(*AXES).agg(F.coalesce(F.avg("v"), F.lit(float(undefined))).alias("v"))
    return image.with_rows(out.select(*AXES, pixel_round(pix(), image.dtype).alias("v")), dims)


def normalize_z(image: Image, target: float = math.nan) -> Image:
    """Slices shifted to one mean: target, or the mean of the whole image. Slice means are one small row each."""
    means = image.df.groupBy("z").agg(F.avg("v").alias("m"), F.count("*").alias("k"))
    whole = F.lit(float(target)) if not math.isnan(target) else F.col("whole")
    shifts = means if not math.isnan(target) else means.crossJoin(means.agg((F.sum(F.col("m") * F.col("k")) / F.sum("k")).alias("whole")))
    return image.with_rows(image.df.join(shifts.select("z", (whole - F.col("m")).alias("shift")), "z").select(*AXES, pixel_round(pix() + F.col("shift"), image.dtype).alias("v")))


def otsu(hist: DataFrame) -> float:
    """The bin start that parts a histogram with the largest variance between classes. A histogram has a bounded number of bins."""
    rows = sorted(hist.select("bin_start", "n").collect())
    total, mass = sum(r.n for r in rows), sum(r.n * r.bin_start for r in rows)
    best, at, w, m = -1.0, rows[0].bin_start, 0.0, 0.0
    for r in rows[:-1]:
        w += r.n
        m += r.n * r.bin_start
        if 0 < w < total:
            between = w * (total - w) * (m / w - (mass - m) / (total - w)) ** 2
            if between >= best:  # of equal bins the last
                best, at = between, r.bin_start
    return at


def isodata(hist: DataFrame) -> float:
    """The value halfway between the means below and above it."""
    rows = sorted(hist.select("bin_start", "n").collect())
    t = sum(r.bin_start * r.n for r in rows) / (sum(r.n for r in rows) or 1)
    for _ in range(1000):
        low, high = [r for r in rows if r.bin_start <= t], [r for r in rows if r.bin_start > t]
        mean = lambda part: sum(r.bin_start * r.n for r in part) / sum(r.n for r in part) if sum(r.n for r in part) else t
        new = (mean(low) + mean(high)) / 2
        if abs(new - t) < 1e-9:
            break
        t = new
    return t


def _counts(hist: DataFrame) -> tuple[list[float], list[float]]:
    rows = sorted(hist.select("bin_start", "n").collect())
    return [r.bin_start for r in rows], [r.n for r in rows]


def median_bin(hist: DataFrame) -> float:
    """The first bin at which half of the pixels are reached."""
    starts, n = _counts(hist)
    half, seen = sum(n) / 2, 0.0
    for start, k in zip(starts, n, strict=True):
        seen += k
        if seen >= half:
            return start
    return starts[-1]


def max_entropy(hist: DataFrame) -> float:
    """Kapur, Sahoo and Wong: the largest sum of the entropies below and above."""
    starts, n = _counts(hist)
    total = sum(n) or 1.0
    p = [k / total for k in n]
    h = [-q * math.log(q) if q > 0 else 0.0 for q in p]
    whole, best, at, mass, part = sum(h), -math.inf, starts[0], 0.0, 0.0
    for start, q, e in zip(starts, p, h, strict=True):
        mass, part = mass + q, part + e
        if 1e-12 < mass < 1 - 1e-12 and (score := math.log(mass * (1 - mass)) + part / mass + (whole - part) / (1 - mass)) > best:
            best, at = score, start
    return at


def triangle(hist: DataFrame) -> float:
    """Zack, Rogers and Latt: the bin farthest below the line from the peak to the farther end."""
    starts, n = _counts(hist)
    used = [i for i, k in enumerate(n) if k > 0]
    if not used:
        return starts[0]
    peak = max(used, key=lambda i: n[i])
    end = used[0] if peak - used[0] > used[-1] - peak else used[-1]
    if peak == end:
        return starts[peak]
    line = lambda i: n[peak] + (n[end] - n[peak]) * (i - peak) / (end - peak)
    return starts[max(range(min(peak, end), max(peak, end) + 1), key=lambda i: line(i) - n[i])]


def _of_counts(method: Callable[[np.ndarray], int]) -> Callable[[DataFrame], float]:
    def run(hist: DataFrame) -> float:
        starts, n = _counts(hist)
        return starts[method(np.array(n))]

    return run


METHODS = {name: _of_counts(f) for name, f in thresholds.METHODS.items()} | {"Otsu": otsu, "IsoData": isodata, "Median": median_bin, "MaxEntropy": max_entropy, "Triangle": triangle}


def moment_threshold(method: str, mean: Column, deviation: Column, low: Column, high: Column, arguments: tuple[float | None, ...] = ()) -> Column:
    """The methods that need mean, deviation, minimum and maximum alone, for a whole image or a neighbourhood."""
    given = lambda i, default: arguments[i] if len(arguments) > i and arguments[i] is not None else default
    if method == "Mean":
        return mean - given(0, 0.0)
    if method == "MidGrey":
        return (low + high) / 2 - given(0, 0.0)
    if method == "Niblack":
        return mean + given(0, 1.0) * deviation - given(1, 0.0)
    if method == "Phansalkar":
        return mean * (1 + given(2, 2.0) * F.exp(-given(3, 10.0) * mean) + given(0, 0.25) * (deviation / given(1, 0.5) - 1))
    if method == "Sauvola":
        return mean * (1 + given(0, 1.0) * (deviation / given(1, 1.0) - 1))
    raise ValueError(f"No threshold method {method}")


MOMENT_METHODS = ("Mean", "MidGrey", "Niblack", "Phansalkar", "Sauvola")


def auto_threshold_value(image: Image, method: str = "Otsu", low: float = 0.0, high: float = 256.0, bins: int = 256, arguments: tuple[float | None, ...] = ()) -> float:
    """The threshold of a histogram method, or of one that needs moments alone; those take one pass without a histogram."""
    if method in MOMENT_METHODS:
        return image.df.agg(moment_threshold(method, *(STATISTICS[s]() for s in ("mean", "stddev", "minval", "maxval")), arguments)).first()[0]
    return METHODS[method](histogram(image, low, high, bins))
