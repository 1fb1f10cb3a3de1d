"""Images as keyed pixel tables.

An Image is a DataFrame (x, y, z, v) with one row for each pixel of a dense box, plus its dimensions and pixel type.
Pixel values are doubles that hold a value of the type; integer types saturate and round half away from zero.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Least and largest value of each integer type; float32 has none.
BOUNDS: dict[str, tuple[float, float] | None] = {
    "uint8": (0, 255), "uint16": (0, 65535), "uint32": (0, 4294967295), "uint64": (0, 18446744073709551615.0),
    "int8": (-128, 127), "int16": (-32768, 32767), "int32": (-2147483648, 2147483647), "int64": (-9223372036854775808.0, 9223372036854775807.0), "float32": None,
}
AXES = ("x", "y", "z")


def pixel_round(v: Column, dtype: str) -> Column:
    """A double as a value of dtype: rounded half away from zero and clamped; NaN is 0 in integer types."""
    if (bounds := BOUNDS[dtype]) is None:
        return v.cast("double")
    return F.when(F.isnan(v), F.lit(0.0)).otherwise(F.least(F.greatest(F.round(v), F.lit(float(bounds[0]))), F.lit(float(bounds[1]))))


def pix() -> Column:
    """The pixel value."""
    return F.col("v")


@dataclass(frozen=True)
class Image:
    df: DataFrame
    dims: tuple[int, int, int]
    dtype: str = "float32"

    @property
    def count(self) -> int:
        return self.dims[0] * self.dims[1] * self.dims[2]

    def map(self, v: Column, dtype: str | None = None) -> Image:
        """A point process: a projection over v, which Spark fuses with those before and after it."""
        kind = dtype or self.dtype
        return replace(self, df=self.df.select(*AXES, pixel_round(v, kind).alias("v")), dtype=kind)

    def with_rows(self, df: DataFrame, dims: tuple[int, int, int] | None = None, dtype: str | None = None) -> Image:
        return Image(df.select(*[F.col(a).cast("bigint").alias(a) for a in AXES], F.col("v").cast("double").alias("v")), dims or self.dims, dtype or self.dtype)


def new_image(spark: SparkSession, dims: tuple[int, int, int], dtype: str = "uint8", value: float = 0.0) -> Image:
    """A dense image of one value, generated without a shuffle."""
    w, h, d = dims
    i = F.col("id")
    df = spark.range(w * h * d).select((i % w).alias("x"), ((i / w).cast("bigint") % h).alias("y"), (i / (w * h)).cast("bigint").alias("z"), F.lit(float(value)).alias("v"))
    return Image(df, dims, dtype)


def check_same(a: Image, b: Image) -> None:
    if a.dims != b.dims:
        raise ValueError(f"Image sizes differ: {a.dims} and {b.dims}")
