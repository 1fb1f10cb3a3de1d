"""Thinning, classes of skeleton points, and networks traced from line skeletons.

Thinning takes border points of one direction after the other, and of each direction the eight classes of coordinates
modulo 2 in turn. Points of one class are no neighbours, so all simple ones of a class go at once without changing the
topology, and the result depends on neither blocks nor the order of rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxara.operators.blocks import as_image, joined, over_blocks
from voxara.operators.regions import _around, _shifted, linked_labels, regions
from voxara.raster import AXES, Image, pix
from voxara.store import kept

#: The 26 neighbours of a point, and for each the bits of those it touches: all kinds (26) or by faces (6).
AROUND = [o for o in np.ndindex(3, 3, 3) if o != (1, 1, 1)]
_GAP = np.abs(np.array(AROUND)[:, None] - np.array(AROUND)[None])
TOUCH_26 = [sum(1 << j for j in range(26) if j != i and _GAP[i, j].max() == 1) for i in range(26)]
TOUCH_6 = [sum(1 << j for j in range(26) if _GAP[i, j].sum() == 1) for i in range(26)]
FACES = sum(1 << i for i, o in enumerate(AROUND) if sum(abs(c - 1) for c in o) == 1)
NEAR_18 = sum(1 << i for i, o in enumerate(AROUND) if sum(abs(c - 1) for c in o) <= 2)
DIRECTIONS = [(0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0), (0, 0, -1), (0, 0, 1)]
#: Steps of one thinning round, as many pixels as it can look over.
ROUND = 8 * len(DIRECTIONS)


def neighbour_bits(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bits of the nonzero neighbours of points at [n, 3] of an array padded by one."""
    bits = np.zeros(len(at), np.int64)
    for i, o in enumerate(AROUND):
        bits |= (a[at[:, 0] + o[0] - 1, at[:, 1] + o[1] - 1, at[:, 2] + o[2] - 1] != 0).astype(np.int64) << i
    return bits


def _spread(start: np.ndarray, within: np.ndarray, touch: list[int]) -> np.ndarray:
    reach = start
    while True:
        new = reach.copy()
        for i, t in enumerate(touch):
            new |= np.where(reach >> i & 1, t, 0)
        new &= within
        if (new == reach).all():
            return reach
        reach = new


def simple(bits: np.ndarray) -> np.ndarray:
    """Points whose removal changes no topology: one 26-component of foreground around it, and one 6-component of background that it touches by a face within its 18 neighbours."""
    back = ~bits & NEAR_18
    one = (_spread(bits & -bits, bits, TOUCH_26) == bits) & (bits != 0)
    faces = back & FACES
    return one & (faces != 0) & (faces & ~_spread(faces & -faces, back, TOUCH_6) == 0)


def _is_surface(bits: np.ndarray) -> np.ndarray:
    """Points none of whose eight 2 x 2 x 2 cubes holds more than four foreground points, and of which some cube holds three or more."""
    most = np.zeros(len(bits), int)
    for corner in np.ndindex(2, 2, 2):
        cube = [i for i, o in enumerate(AROUND) if all(c in ((0, 1) if k == 0 else (1, 2)) for c, k in zip(o, corner, strict=True))]
        most = np.maximum(most, 1 + sum(bits >> i & 1 for i in cube))
    return (most <= 4) & (most >= 3)


def _count(bits: np.ndarray) -> np.ndarray:
    return sum(bits >> i & 1 for i in range(26))


def thin_round(a: np.ndarray, first: tuple[int, int, int], surfaces: bool) -> None:
    """One round over an array padded by one, in place; first: the position of a[0, 0, 0], which fixes the classes."""
    inner = (slice(1, -1),) * 3
    for d in DIRECTIONS:
        beyond = a[tuple(slice(1 + c, n - 1 + c) for c, n in zip(d, a.shape, strict=True))]
        border = np.argwhere((a[inner] != 0) & (beyond == 0)) + 1
        if not len(border):
            continue
        own = (border + np.array(first)) % 2
        for corner in np.ndindex(2, 2, 2):
            at = border[(own == corner).all(1)]
            if not len(at):
                continue
            bits = neighbour_bits(a, at)
            gone = (_count(bits) > 1) & simple(bits)
            if surfaces:
                gone &= ~_is_surface(bits)
            at = at[gone]
            a[at[:, 0], at[:, 1], at[:, 2]] = 0


def _thin(image: Image, surfaces: bool) -> tuple[Image, DataFrame]:
    halo = tuple(ROUND + 1 if n > 1 else 0 for n in image.dims)

    def kernel(arrays: list[np.ndarray], first: tuple[int, int, int]) -> list[np.ndarray]:
        a = np.pad((arrays[0] > 0).astype(np.uint8), 1)
        before = a.copy()
        thin_round(a, tuple(f - h - 1 for f, h in zip(first, halo, strict=True)), surfaces)
        inner = tuple(slice(1 + h, n - 1 - h) for h, n in zip(halo, a.shape, strict=True))
        return [a[inner].astype(float), (a != before)[inner]]

    out = kept(over_blocks(joined([image]), image.dims, kernel, halo, "Zero", 2))
    return as_image(image, out), out.filter("v1 <> 0")


def line_thin(image: Image) -> Image:
    """One round of thinning to lines; positive pixels are foreground and become 1."""
    return _thin(image, False)[0]


def surface_thin(image: Image, retain_surfaces: bool = True) -> Image:
    """One round of thinning that leaves surfaces one pixel thick, or thins these too."""
    return _thin(image, retain_surfaces)[0]


def _skeleton(image: Image, surfaces: bool) -> Image:
    while True:
        image, changed = _thin(image, surfaces)
        if changed.isEmpty():
            return image


def line_skeleton(image: Image) -> Image:
    """Rounds of thinning to lines until nothing changes."""
    return _skeleton(image, False)


def surface_skeleton(image: Image, retain_surfaces: bool = True) -> Image:
    return _skeleton(image, retain_surfaces)


def classify_skeleton(image: Image) -> Image:
    """Classes of a line skeleton's points: 2 end (one neighbour), 3 curve (two neighbours that don't touch), 4 branch (others beside an end or curve point), 5 junction (the rest)."""
    halo = tuple(2 if n > 1 else 0 for n in image.dims)

    def kernel(arrays: list[np.ndarray], _first) -> list[np.ndarray]:
        a = np.pad((arrays[0] > 0).astype(np.uint8), 1)
        at = np.argwhere(a)
        bits = neighbour_bits(np.pad(a, 1), at + 1)
        count, low = _count(bits), bits & -bits
        touching = np.zeros(len(at), bool)
        for i, t in enumerate(TOUCH_26):
            touching |= (low >> i & 1 == 1) & (t & bits & ~low != 0)
        kind = np.where(count == 1, 2, np.where((count == 2) & ~touching, 3, 5))
        a[at[:, 0], at[:, 1], at[:, 2]] = kind
        thin = np.pad(np.isin(a, (2, 3)).astype(np.uint8), 1)
        beside = neighbour_bits(thin, at + 1) != 0
        a[at[:, 0], at[:, 1], at[:, 2]] = np.where((kind == 5) & beside, 4, kind)
        inner = tuple(slice(1 + h, n - 1 - h) for h, n in zip(halo, a.shape, strict=True))
        return [a[inner].astype(float)]

    return as_image(image, over_blocks(joined([image]), image.dims, kernel, halo, "Zero"))


def trace_skeleton(image: Image) -> tuple[DataFrame, DataFrame]:
    """(vertices: id, x, y, z; edges: id, v1, v2, points, length) of a line skeleton.

    Touching end, branch and junction points are one vertex, at their mean; a branch of curve points is an edge between
    the vertices that it touches, v1 <= v2. Where ends of one vertex alone are touched, that vertex is both. Vertices that
    touch without curve points between are one. A closed curve without vertices has none and is left out. Lengths sum the
    steps from point to point, those to the vertices' touching points included. Ids are the least pixel index of a part.
    """
    dims = image.dims
    classes = kept(classify_skeleton(image).df.filter(pix() > 0))
    whole = Image(classes, dims, "uint8")
    ends = whole.map(F.when(pix() == 3, 0.0).otherwise(1.0))
    knots = kept(regions(ends, pix() != 0, "All").select(*AXES, "region"))
    curves = kept(regions(whole, pix() == 3, "All").select(*AXES, "region"))
    vertices = knots.groupBy(F.col("region").alias("id")).agg(*[F.avg(a).alias(a) for a in AXES])
    here = [F.col(a).alias(f"{a}0") for a in AXES]
    steps = F.explode(F.array(*[F.struct(*[(F.col(a) + c).alias(a) for a, c in zip(AXES, o, strict=True)], F.sqrt(F.lit(float(sum(c * c for c in o)))).alias("length")) for o in _around("All")]))
    touched = curves.select(F.col("region").alias("id"), *here, steps.alias("p")).select("id", "x0", "y0", "z0", "p.*").join(knots.withColumnRenamed("region", "vertex"), list(AXES))
    # Of the points by which a curve's end point touches a vertex the nearest counts.
    nearest = touched.groupBy("id", "x0", "y0", "z0", "vertex").agg(F.min("length").alias("length"))
    ends_of = nearest.groupBy("id").agg(F.min("vertex").alias("v1"), F.max("vertex").alias("v2"), F.sum("length").alias("to_ends"))
    inside = _shifted(curves.select(*AXES, F.col("region").alias("id"), *here), "All", "id", "x0", "y0", "z0").join(curves.withColumnRenamed("region", "id"), [*AXES, "id"])
    far = F.sqrt(sum(((F.col(a) - F.col(f"{a}0")) * (F.col(a) - F.col(f"{a}0")) for a in AXES), F.lit(0)).cast("double"))
    lengths = inside.groupBy("id").agg((F.sum(far) / 2).alias("inside"))
    points = curves.groupBy(F.col("region").alias("id")).agg(F.count("*").alias("points"))
    edges = points.join(ends_of, "id").join(lengths, "id", "left").select("id", "v1", "v2", "points", (F.col("to_ends") + F.coalesce("inside", F.lit(0.0))).alias("length"))
    return vertices, edges


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree of every vertex; an edge from a vertex to itself counts twice."""
    ends = edges.select(F.explode(F.array("v1", "v2")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return vertices.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def clean_network(vertices: DataFrame, edges: DataFrame, isolated: bool = True, straight: bool = True) -> tuple[DataFrame, DataFrame]:
    """Vertices of degree 2 vanish and the edges that they join become one, whose points and lengths add up; vertices of degree 0 vanish too.

    An edge from a vertex to itself keeps its vertex; of a ring of degree-2 vertices alone the least vertex stays.
    """
    edges = kept(edges)
    degree = kept(degrees(vertices, edges))
    if straight:
        loops = edges.filter("v1 = v2").select(F.col("v1").alias("id"))
        through = degree.filter("degree = 2").select("id").join(loops, "id", "left_anti")
        ends = edges.select("id", F.explode(F.array("v1", "v2")).alias("v"))
        at = ends.join(through.withColumnRenamed("id", "v"), "v").groupBy("v").agg(F.min("id").alias("a"), F.max("id").alias("b"))
        links = at.filter("a <> b").select("a", "b")
        named = kept(ends.join(linked_labels(edges.select("id"), links), "id"))
        sums = edges.join(named.select("id", "label").distinct(), "id").groupBy("label").agg(F.sum("points").alias("points"), F.sum("length").alias("length"))
        # Outer ends are those at other vertices; a ring has none and keeps its least vertex.
        outer = named.join(through.withColumnRenamed("id", "v"), "v", "left_anti").groupBy("label").agg(F.min("v").alias("v1"), F.max("v").alias("v2"))
        ring = named.groupBy("label").agg(F.min("v").alias("v0"))
        edges = kept(sums.join(ring, "label").join(outer, "label", "left").select(F.col("label").alias("id"), F.coalesce("v1", "v0").alias("v1"), F.coalesce("v2", "v0").alias("v2"), "points", "length"))
        used = edges.select(F.explode(F.array("v1", "v2")).alias("id")).distinct()
        vertices = vertices.join(through.join(used, "id", "left_anti"), "id", "left_anti")
    if isolated:
        vertices = vertices.join(edges.select(F.explode(F.array("v1", "v2")).alias("id")).distinct(), "id", "left_semi")
    return vertices, edges


def prune_network(vertices: DataFrame, edges: DataFrame, longest: float, straight: bool = True, isolated: bool = True) -> tuple[DataFrame, DataFrame]:
    """Without the edges shorter than longest that end in a vertex without other edges."""
    leaves = degrees(vertices, edges).filter("degree = 1").select(F.col("id").alias("leaf"))
    short = edges.filter((F.col("length") < longest) & (F.col("v1") != F.col("v2")))
    gone = short.select("id", F.explode(F.array("v1", "v2")).alias("leaf")).join(leaves, "leaf").select("id").distinct()
    return clean_network(vertices, edges.join(gone, "id", "left_anti"), isolated, straight)


def remove_edges(vertices: DataFrame, edges: DataFrame, flagged: DataFrame, straight: bool = True, isolated: bool = True) -> tuple[DataFrame, DataFrame]:
    """Without the edges whose id is in flagged."""
    return clean_network(vertices, edges.join(flagged.select("id"), "id", "left_anti"), isolated, straight)


def points_and_lines(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points: point, x, y, z; lines: line, points): vertices numbered from 0 in the order of their ids, and the pair of numbers of each edge."""
    order = kept(vertices.repartitionByRange("id").sortWithinPartitions("id").select("id", *AXES, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("m")))
    start, bases = 0, []
    for r in sorted(order.groupBy("part").agg(F.count("*").alias("n"), F.min("m").alias("m")).collect(), key=lambda r: r.part):
        bases.append((r.part, start - r.m))
        start += r.n
    base = vertices.sparkSession.createDataFrame(bases or [(0, 0)], "part int, base bigint")
    points = kept(order.join(F.broadcast(base), "part").select((F.col("m") + F.col("base")).alias("point"), *AXES, "id"))
    side = lambda x: points.select(F.col("id").alias(x), F.col("point").alias(f"p{x}"))
    lines = edges.join(side("v1"), "v1").join(side("v2"), "v2").select(F.col("id").alias("line"), F.array("pv1", "pv2").alias("points"))
    return points.drop("id"), lines


def fill_skeleton(image: Image, edges: DataFrame, column: str = "length") -> Image:
    """The curve points of a line skeleton with a column's value of their edge; other pixels stay."""
    whole = Image(kept(classify_skeleton(image).df.filter(pix() > 0)), image.dims, "uint8")
    curves = regions(whole, pix() == 3, "All").select(*AXES, F.col("region").alias("id"))
    values = curves.join(edges.select("id", F.col(column).cast("double").alias("n")), "id")
    return image.with_rows(image.df.join(values, list(AXES), "left").select(*AXES, F.coalesce("n", "v").alias("v")), dtype="float32")


def write_vtk(points: DataFrame, lines: DataFrame, path: str) -> None:
    """A legacy VTK file of points and lines, streamed row by row through the driver, as the format is one file."""
    with open(path, "w", encoding="ascii") as f:
        f.write(f"# vtk DataFile Version 3.0\nnetwork\nASCII\nDATASET POLYDATA\nPOINTS {points.count()} float\n")
        for p in points.orderBy("point").toLocalIterator():
            f.write(f"{p.x} {p.y} {p.z}\n")
        count, total = lines.select(F.count("*"), F.coalesce(F.sum(F.size("points") + 1), F.lit(0))).first()
        f.write(f"LINES {count} {total}\n")
        for r in lines.orderBy("line").toLocalIterator():
            f.write(" ".join(map(str, [len(r.points), *r.points])) + "\n")
