"""Commands over two images, tables of points, displacement fields and complex pixels, which have tables or several targets."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from voxara.operators import pointwise, registration, statistics, transforms
from voxara.raster import Image

if TYPE_CHECKING:
    from voxara.plans.script import Session

Value = str | float | bool | tuple
COMPLEX = ("real", "imag", "conjugate", "arg", "normalize", "normsquared")


def weighted_histogram(s: Session, image: str, weight: str, target: str, low: float = 0.0, high: float = 256.0, bins: int = 256) -> None:
    s.tables[target] = statistics.histogram(s.image(image), low, high, bins, s.image(weight))


def histogram2(s: Session, first: str, low1: float, high1: float, bins1: int, second: str, low2: float, high2: float, bins2: int, *targets: str) -> None:
    """targets: the table; before it, for whist2, the image of weights."""
    *weight, target = targets
    s.tables[target] = statistics.histogram2(s.image(first), low1, high1, bins1, s.image(second), low2, high2, bins2, *map(s.image, weight))


def _cut(s: Session, first: str, *rest: Value, inputs: int) -> None:
    """Targets for bin starts and files may follow; bins are columns of the table."""
    histogram2(s, first, *rest[: 7 + inputs])


def scale_labels(s: Session, source: str, target: str, factor: tuple | int = (0, 0, 0)) -> None:
    """Factors of 0 are those from the source's size to the target's."""
    im, given = s.image(source), factor if isinstance(factor, tuple) else (factor,) * 3
    if not all(given):
        given = tuple(f or max(1, n // m) for f, n, m in zip(given, s.image(target).dims, im.dims, strict=True))
    s.images[target] = transforms.scale_nearest(im, given)


def cart_to_cyl(s: Session, source: str, target: str, size: tuple = (0, 0, 0), origin: tuple = (0, 0, 0), interpolation: str = "Linear", boundary: str = "Zero") -> None:
    """A size of 0 is that of the target, or of the source where there is no target yet."""
    im = s.image(source)
    like = s.images.get(target, im).dims
    s.images[target] = transforms.cart_to_cyl(im, tuple(n or m for n, m in zip(size, like, strict=True)), origin, interpolation, boundary)


def get(s: Session, image: str, target: str, positions: str) -> None:
    """The pixels at a table's x, y, z as its column v."""
    s.tables[target] = transforms.pixels_at(s.image(image), s.tables[positions])


def _grid(start: tuple, step: tuple, end: tuple) -> registration.Grid:
    """Grid points from start to before end."""
    return tuple((float(a), float(n), max(1, -(-int(b - a) // int(n)))) for a, n, b in zip(start, step, end, strict=True))


def pull_back(s: Session, deformed: str, target: str, start: tuple, step: tuple, end: tuple, shifts: str, interpolation: str = "Linear", position: tuple = (0, 0, 0), size: tuple = (0, 0, 0)) -> None:
    if interpolation != "Linear":
        raise ValueError("Pull-back is linear")
    s.images[target] = registration.pull_back(s.image(deformed), s.tables[shifts], _grid(start, step, end), size if any(size) else None, position)


def points_to_deformed(s: Session, points: str, target: str, start: tuple, step: tuple, end: tuple, shifts: str) -> None:
    s.tables[target] = registration.points_to_deformed(s.tables[points], s.tables[shifts], _grid(start, step, end))


def filter_displacements(s: Session, shifts: str, target: str, limit: float = 3.0, radius: int = 5) -> None:
    s.tables[target] = registration.filter_displacements(s.tables[shifts], radius, limit)


def complex_image(s: Session, real: str, imaginary: str, target: str) -> None:
    """A table of complex pixels (x, y, z, re, im) of two images."""
    side = s.image(imaginary).df.withColumnRenamed("v", "im")
    s.tables[target] = s.image(real).df.withColumnRenamed("v", "re").join(side, ["x", "y", "z"])


def real_image(s: Session, table: str, target: str) -> None:
    """The real parts of complex pixels as an image as large as the pixels reach."""
    df = s.tables[table]
    last = df.agg(*[F.max(a) for a in "xyz"]).first()
    dims = tuple(int(n) + 1 if n is not None else 1 for n in last)
    s.images[target] = Image(df.select("x", "y", "z", F.col("re").alias("v")), dims, "float32")


def _complex(name: str) -> Callable:
    def run(s: Session, table: str) -> None:
        s.tables[table] = pointwise.complex_unary(name, s.tables[table])

    return run


def commands() -> dict[str, Callable]:
    return {
        "whist": weighted_histogram, "hist2": lambda s, *a: _cut(s, *a, inputs=1), "whist2": lambda s, *a: _cut(s, *a, inputs=2), "scalelabels": scale_labels, "carttocyl": cart_to_cyl, "get": get, "pullback": pull_back,
        "pointstodeformed": points_to_deformed, "filterdisplacements": filter_displacements, "complex": complex_image, "realimage": real_image, **{n: _complex(n) for n in COMPLEX},
    }
