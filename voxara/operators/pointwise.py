"""Point processes: projections over pixel values, and joins of two images on their coordinates."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxara.operators import formulas
from voxara.raster import AXES, Image, check_same, pix, pixel_round



def _nan() -> Column:
    return F.lit(float("nan"))


def _inf() -> Column:
    return F.lit(float("inf"))


def _log(v: Column) -> Column:
    """As in IEEE arithmetic: log(0) is minus infinity, a negative number's is NaN."""
    return F.when(v == 0, -_inf()).when(v < 0, _nan()).otherwise(F.ln(v))


def _divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b)).when(a == 0, _nan()).when(a > 0, _inf()).otherwise(-_inf())


#: Commands of one image without arguments.
UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "negate": lambda v: -v, "exponentiate": F.exp, "square": lambda v: v * v, "squareroot": lambda v: F.when(v < 0, _nan()).otherwise(F.sqrt(F.greatest(v, F.lit(0.0)))),
    "log": _log, "log10": lambda v: F.when(v == 0, -_inf()).when(v < 0, _nan()).otherwise(F.log10(v)), "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "inv": lambda v: _divide(F.lit(1.0), v), "round": lambda v: F.round(v), "ceil": lambda v: F.ceil(v).cast("double"), "floor": lambda v: F.floor(v).cast("double"),
}
#: Commands of an image and a number or a second image.
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "invsubtract": lambda a, b: b - a, "multiply": lambda a, b: a * b, "divide": _divide,
    "max": F.greatest, "min": F.least, "threshold": lambda a, b: (a > b).cast("double"),
}


def unary(name: str, image: Image) -> Image:
    return image.map(UNARY[name](pix()))


def with_number(name: str, image: Image, x: float) -> Image:
    return image.map(BINARY[name](pix(), F.lit(float(x))))


def with_image(name: str, image: Image, other: Image, allow_broadcast: bool = False) -> Image:
    """An inner join on the coordinates. Integer division truncates. allow_broadcast: coordinates are clamped to the other image's box."""
    if not allow_broadcast:
        check_same(image, other)
    side = other.df.select(*[F.col(a).alias(f"_{a}") for a in AXES], F.col("v").alias("w"))
    at = [F.least(F.col(a), F.lit(n - 1)) if allow_broadcast else F.col(a) for a, n in zip(AXES, other.dims, strict=True)]
    joined = image.df.join(side, [c == F.col(f"_{a}") for c, a in zip(at, AXES, strict=True)])
    v = BINARY[name](pix(), F.col("w"))
    if name == "divide" and image.dtype != "float32" and other.dtype != "float32":
        v = F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double")
    return image.with_rows(joined.select(*AXES, pixel_round(v, image.dtype).alias("v")))


def threshold_range(image: Image, low: float, high: float) -> Image:
    return image.map(((pix() > low) & (pix() <= high)).cast("double"))


def threshold_periodic(image: Image, start: float, end: float, low: float, high: float) -> Image:
    """1 where the value is in ]low, high] modulo the period."""
    period = end - start
    wrap = lambda x: F.pmod(x - start, F.lit(float(period))) + start
    a, b, v = wrap(F.lit(float(low))), wrap(F.lit(float(high))), wrap(pix())
    return image.map(F.when(a <= b, (v > a) & (v <= b)).otherwise((v > a) | (v <= b)).cast("double"))


def double_threshold(image: Image, first: float, second: float) -> Image:
    return image.map(F.when(pix() < first, 0.0).when(pix() < second, 1.0).otherwise(2.0))


def linmap(image: Image, in_low: float, in_high: float, out_low: float, out_high: float) -> Image:
    return image.map((pix() - in_low) / (in_high - in_low) * (out_high - out_low) + out_low)


def replace_value(image: Image, a: float, b: float) -> Image:
    """NaN can be replaced like any value."""
    return image.map(F.when(F.isnan(pix()) if math.isnan(a) else pix() == a, F.lit(float(b))).otherwise(pix()))


def clamp(image: Image, low: float, high: float) -> Image:
    return image.map(F.least(F.greatest(pix(), F.lit(float(low))), F.lit(float(high))))


def ensure_finite(image: Image, replacement: float = 0.0) -> Image:
    return image.map(F.when(F.isnan(pix()) | (F.abs(pix()) == _inf()), F.lit(float(replacement))).otherwise(pix()))


def convert(image: Image, dtype: str) -> Image:
    return image.map(pix(), dtype)


def swap_byte_order(image: Image) -> Image:
    """The bytes of integer pixels of up to 32 bits in reverse; larger ones don't fit the pixels' doubles."""
    size = {"uint8": 1, "uint16": 2, "uint32": 4, "int8": 1, "int16": 2, "int32": 4}.get(image.dtype)
    if size is None:
        raise ValueError(f"The bytes of {image.dtype} pixels can't be swapped")
    n = pix().cast("bigint")
    out = sum((F.shiftleft(F.shiftright(n, 8 * i).bitwiseAND(F.lit(255)), 8 * (size - 1 - i)) for i in range(size)), F.lit(0).cast("bigint"))
    if image.dtype.startswith("int"):
        out = F.when(out >= 1 << (8 * size - 1), out - (1 << 8 * size)).otherwise(out)
    return image.map(out.cast("double"))


def evaluate(expression: str, image: Image, *others: Image) -> Image:
    """A formula (see formulas.py) over x0 (the image), x1, x2 ... (the others) and the coordinates x, y, z; NaN where it has no value."""
    df = image.df.select(*AXES, pix().alias("x0"))
    for n, o in enumerate(others, 1):
        check_same(image, o)
        df = df.join(o.df.select(*AXES, pix().alias(f"x{n}")), list(AXES))
    v = formulas.column_of(expression, {c: F.col(c) for c in df.columns})
    return image.with_rows(df.select(*AXES, pixel_round(F.coalesce(v, F.lit(float("nan"))), image.dtype).alias("v")))


#: Commands of complex images, whose rows have re and im.
COMPLEX: dict[str, Callable[[Column, Column], tuple[Column, Column]]] = {
    "real": lambda a, b: (a, F.lit(0.0)), "imag": lambda a, b: (b, F.lit(0.0)), "conjugate": lambda a, b: (a, -b), "arg": lambda a, b: (F.atan2(b, a), F.lit(0.0)),
    "normsquared": lambda a, b: (a * a + b * b, F.lit(0.0)), "abs": lambda a, b: (F.sqrt(a * a + b * b), F.lit(0.0)), "negate": lambda a, b: (-a, -b),
    "normalize": lambda a, b: (_divide(a, F.sqrt(a * a + b * b)), _divide(b, F.sqrt(a * a + b * b))),
}


def complex_unary(name: str, df):
    a, b = COMPLEX[name](F.col("re"), F.col("im"))
    return df.select(*AXES, a.alias("re"), b.alias("im"))
