"""Connected regions, and tables of their measurements.

Regions are found within blocks first; only pixels at the blocks' faces meet across blocks, and what they join is a
graph of block regions, far smaller than the image.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.operators import analyzers
from voxara.operators.blocks import BLOCK, fold_blocks
from voxara.raster import AXES, Image, pix
from voxara.store import kept

#: Neighbours with a larger linear index, by faces (Nearest) or faces, edges and corners (All).
FORWARD = {
    "Nearest": [(1, 0, 0), (0, 1, 0), (0, 0, 1)],
    "All": [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (z, y, x) > (0, 0, 0)],
}
#: Edges between block regions that one task joins; more go through rounds of joins.
TASK_EDGES = 200_000


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes the least node that edges (a[i], b[i]) reach, by rounds of hooking and pointer jumping."""
    parent = np.arange(n)
    while len(a):
        pa, pb = parent[a], parent[b]
        low = np.minimum(pa, pb)
        np.minimum.at(parent, pa, low)
        np.minimum.at(parent, pb, low)
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
        open_ = parent[a] != parent[b]
        a, b = a[open_], b[open_]
    return parent


def block_regions(v: np.ndarray, inside: np.ndarray, connectivity: str) -> np.ndarray:
    """Of an array [z, y, x], the number (in C order) of the first pixel of each pixel's region; regions are of equal values."""
    number = np.arange(v.size).reshape(v.shape)
    left, right = [], []
    for o in FORWARD[connectivity]:
        here = tuple(slice(max(0, -c), n - max(0, c)) for c, n in zip(o[::-1], v.shape, strict=True))
        there = tuple(slice(max(0, c), n - max(0, -c)) for c, n in zip(o[::-1], v.shape, strict=True))
        same = inside[here] & inside[there] & (v[here] == v[there])
        left.append(number[here][same])
        right.append(number[there][same])
    return roots(v.size, np.concatenate(left), np.concatenate(right)).reshape(v.shape)


def linked_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label: for each node the least id that edges (a, b) reach.

    Few edges are joined in one task. Otherwise labels go to neighbours and then to their labels' labels, so rounds grow
    with the logarithm of a region's extent; each round is a table.
    """
    edges = kept(edges.select("a", "b").distinct())
    if edges.count() <= TASK_EDGES:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            ids, at = np.unique(np.r_[pdf["a"].to_numpy(), pdf["b"].to_numpy()], return_inverse=True)
            return pd.DataFrame({"id": ids, "label": ids[roots(len(ids), at[: len(pdf)], at[len(pdf) :])]})

        found = edges.select("a", "b", F.lit(0).alias("all")).groupBy("all").applyInPandas(run, "id bigint, label bigint")
        return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    both = kept(edges.union(edges.select(F.col("b"), F.col("a"))))
    labels = kept(nodes.select("id", F.col("id").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        # A label's own node takes the least label that its region's nodes see.
        seen = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        hooks = seen.groupBy("old").agg(F.min("label").alias("hook"))
        moved = seen.join(hooks, "old").select("id", "old", F.least("label", "hook").alias("label"))
        far = moved.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = kept(moved.join(far, "label", "left").select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        if new.filter("old <> label").isEmpty():
            return new.select("id", "label")
        labels = new.select("id", "label")


def _index(dims: tuple[int, int, int]) -> Column:
    w, h, _ = dims
    return F.col("x") + F.col("y") * w + F.col("z") * (w * h)


def regions(image: Image, inside: Column, connectivity: str = "Nearest") -> DataFrame:
    """x, y, z, v, region of the pixels that inside holds for: region is the linear index of the first pixel of the region of equal values."""
    dims = image.dims
    w, h, _ = dims

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = [int(pdf[f"b{a}"].iloc[0]) * n for a, n in zip(AXES, BLOCK, strict=True)]
        size = [min(n, d - f) for n, d, f in zip(BLOCK, dims, first, strict=True)]
        x, y, z = (pdf[a].to_numpy() - f for a, f in zip(AXES, first, strict=True))
        v, here = np.zeros(size[::-1]), np.zeros(size[::-1], bool)
        v[z, y, x], here[z, y, x] = pdf["v"].to_numpy(), True
        root = block_regions(v, here, connectivity)[z, y, x]
        rx, ry, rz = root % size[0], root // size[0] % size[1], root // (size[0] * size[1])
        face = np.zeros(len(x), bool)
        for c, f, n, d in zip((x, y, z), first, size, dims, strict=True):
            face |= ((c == 0) & (f > 0)) | ((c == n - 1) & (f + n < d))
        region = (rx + first[0]) + (ry + first[1]) * w + (rz + first[2]) * (w * h)
        return pd.DataFrame({"x": x + first[0], "y": y + first[1], "z": z + first[2], "v": pdf["v"].to_numpy(), "region": region, "face": face})

    blocks = [F.floor(F.col(a) / n).alias(f"b{a}") for a, n in zip(AXES, BLOCK, strict=True)]
    found = image.df.filter(inside).select(*AXES, "v", *blocks).groupBy("bx", "by", "bz").applyInPandas(run, "x bigint, y bigint, z bigint, v double, region bigint, face boolean")
    if all(d <= n for d, n in zip(dims, BLOCK, strict=True)):
        return found.drop("face")
    found = kept(found)
    faces = found.filter("face").select(*AXES, "v", "region")
    steps = F.explode(F.array(*[F.struct(*[(F.col(a) + c).alias(a) for a, c in zip(AXES, o, strict=True)]) for o in FORWARD[connectivity]]))
    moved = faces.select(steps.alias("p"), "v", F.col("region").alias("a")).select("p.*", "v", "a")
    edges = moved.join(faces.withColumnRenamed("region", "b"), [*AXES, "v"]).filter("a <> b").select("a", "b")
    merged = linked_labels(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), edges).withColumnsRenamed({"id": "region"})
    return found.drop("face").join(merged, "region", "left").select(*AXES, "v", F.coalesce("label", "region").alias("region"))


def numbered(found: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """found with n: the number of its region from 1 on, in the order of their first pixels. Counts per range give each range's start."""
    spark = found.sparkSession
    first = found.filter(F.col("region") == _index(dims)).select("region")
    ranged = kept(first.repartitionByRange("region").sortWithinPartitions("region").select("region", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("m")))
    start, base = 0, []
    for r in sorted(ranged.groupBy("part").agg(F.count("*").alias("n"), F.min("m").alias("m")).collect(), key=lambda r: r.part):
        base.append((r.part, start - r.m + 1))
        start += r.n
    bases = spark.createDataFrame(base or [(0, 0)], "part int, base bigint")
    return found.join(ranged.join(F.broadcast(bases), "part").select("region", (F.col("m") + F.col("base")).alias("n")), "region")


def label(image: Image, region_color: float = 0.0, connectivity: str = "Nearest") -> Image:
    """Each region of equal nonzero pixels (or of pixels of region_color, if that isn't 0) gets a number from 1 on, in the order of its first pixel; others are 0."""
    found = kept(regions(image, pix() == region_color if region_color else pix() != 0, connectivity))
    named = numbered(found, image.dims).select(*AXES, F.col("n").cast("double").alias("n"))
    return image.with_rows(image.df.select(*AXES).join(named, list(AXES), "left").select(*AXES, F.coalesce("n", F.lit(0.0)).alias("v")), dtype="uint64")


def flood_fill(image: Image, start: tuple | list[tuple], fill: float, connectivity: str = "All") -> Image:
    """The regions of equal pixels that hold a start point (one, or a list of them) get the fill value."""
    points = [start] if not isinstance(start[0], (tuple, list)) else start
    seeds = image.df.sparkSession.createDataFrame([tuple(int(c) for c in p) for p in points], "x bigint, y bigint, z bigint")
    found = kept(regions(image, F.lit(True), connectivity))
    own = found.join(F.broadcast(seeds), list(AXES), "left_semi").select("region").distinct().withColumn("hit", F.lit(True))
    return image.with_rows(found.join(F.broadcast(own), "region", "left").select(*AXES, F.when(F.col("hit"), F.lit(float(fill))).otherwise(pix()).alias("v")))


def analyze_labels(image: Image) -> DataFrame:
    """label, volume, centre and bounds of every nonzero label."""
    out = [F.count("*").alias("volume")]
    for a in AXES:
        out += [F.avg(a).alias(f"c{a}"), F.min(a).alias(f"min{a}"), F.max(a).alias(f"max{a}")]
    return image.df.filter(pix() != 0).groupBy(pix().cast("bigint").alias("label")).agg(*out)


def _foreground(image: Image) -> Image:
    return image.map((pix() != 0).cast("double"), "uint8")


def remove_small(image: Image, least: int, connectivity: str = "Nearest") -> Image:
    """Regions of nonzero pixels with fewer than least pixels become 0."""
    found = kept(regions(_foreground(image), pix() != 0, connectivity))
    small = found.groupBy("region").count().filter(F.col("count") < least).select("region")
    gone = found.join(small, "region", "left_semi").select(*AXES, F.lit(True).alias("gone"))
    return image.with_rows(image.df.join(gone, list(AXES), "left").select(*AXES, F.when(F.col("gone"), F.lit(0.0)).otherwise(pix()).alias("v")))


def grow(image: Image, source: float, target: float, connectivity: str = "Nearest") -> Image:
    """Pixels of target that a path over target pixels joins to a pixel of source become source."""
    part = pix().isin(float(source), float(target))
    found = kept(regions(image.map(part.cast("double"), "uint8"), pix() != 0, connectivity).select(*AXES, "region"))
    seeds = image.df.filter(pix() == source).join(found, list(AXES)).select("region").distinct()
    grown = found.join(seeds, "region", "left_semi").select(*AXES, F.lit(True).alias("seed"))
    return image.with_rows(image.df.join(grown, list(AXES), "left").select(*AXES, F.when(F.col("seed"), F.lit(float(source))).otherwise(pix()).alias("v")))


def dual_threshold(image: Image, lower: float, upper: float, connectivity: str = "Nearest") -> Image:
    """1 at pixels of at least upper, and at those of at least lower that are joined to one."""
    classes = image.map(F.when(pix() < lower, 0.0).when(pix() < upper, 1.0).otherwise(2.0), "uint8")
    return grow(classes, 2, 1, connectivity).map((pix() > 1).cast("double"), image.dtype)


def _around(connectivity: str) -> list[tuple[int, int, int]]:
    return [p for o in FORWARD[connectivity] for p in (o, tuple(-c for c in o))]


def _shifted(df: DataFrame, connectivity: str, *columns: str) -> DataFrame:
    """The neighbours' positions of every row of df, with columns of that row."""
    around = F.explode(F.array(*[F.struct(*[(F.col(a) + c).alias(a) for a, c in zip(AXES, o, strict=True)]) for o in _around(connectivity)]))
    return df.select(around.alias("p"), *columns).select("p.*", *columns)


def local_maxima(image: Image, connectivity: str = "All") -> Image:
    """A number from 1 on at each region of equal nonzero pixels without a larger neighbour, 0 elsewhere."""
    found = kept(regions(image, pix() != 0, connectivity))

    def lower(arrays: list[np.ndarray], _first) -> pd.DataFrame:
        v, region = arrays
        inner = tuple(slice(1, -1) if n > 1 else slice(None) for n in dims)
        own, lies = v[inner], np.zeros(v[inner].shape, bool)
        for o in _around(connectivity):
            if all(c == 0 or n > 1 for c, n in zip(o, dims, strict=True)):
                lies |= v[tuple(slice(1 + c, 1 + c + n) if d > 1 else slice(None) for c, n, d in zip(o, own.shape, dims, strict=True))] > own
        return pd.DataFrame({"region": np.unique(region[inner][lies & (region[inner] > 0)]).astype(np.int64) - 1})

    # The pixels of no region are 0; region 0 is told from none by adding 1. Numbers of pixels are exact as doubles up to 2^53.
    dims = image.dims
    lost = fold_blocks(found.select(*AXES, "v", (F.col("region") + 1).cast("double").alias("r")), dims, lower, "region bigint", (1, 1, 1)).distinct()
    left = kept(found.join(lost, "region", "left_anti").select(*AXES, "region"))
    named = numbered(left, image.dims).select(*AXES, F.col("n").cast("double").alias("n"))
    return image.with_rows(image.df.select(*AXES).join(named, list(AXES), "left").select(*AXES, F.coalesce("n", F.lit(0.0)).alias("v")), dtype="int32")


def clean_maxima(image: Image, maxima: Image, radius_multiplier: float = 1.0) -> Image:
    """maxima without those that are nearer to a larger maximum than that one's radius (its value in image) times radius_multiplier.

    A maximum is placed at its centroid; of equal radii the smaller number stays. Maxima are compared within cells as
    wide as the largest reach, so pairs are those of neighbouring cells alone.
    """
    at = maxima.df.filter(pix() != 0).select(*AXES, pix().cast("bigint").alias("n")).join(image.df, list(AXES)).groupBy("n").agg(*[F.avg(a).alias(a) for a in AXES], F.max("v").alias("r"))
    at = kept(at)
    reach = max(1.0, float((at.agg(F.max("r")).first()[0] or 0.0) * radius_multiplier))
    cell = at.select("*", *[F.floor(F.col(a) / reach).alias(f"c{a}") for a in AXES])
    near = cell.select(F.col("n").alias("m"), F.col("r").alias("s"), *[F.col(a).alias(f"{a}2") for a in AXES], *[F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)).alias("cx"), "cy", "cz"])
    for c in ("cy", "cz"):
        near = near.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    far = sum(((F.col(a) - F.col(f"{a}2")) * (F.col(a) - F.col(f"{a}2")) for a in AXES), F.lit(0.0))
    larger = (F.col("s") > F.col("r")) | ((F.col("s") == F.col("r")) & (F.col("m") < F.col("n")))
    lost = cell.join(near, ["cx", "cy", "cz"]).filter(larger & (far < (F.col("s") * radius_multiplier) * (F.col("s") * radius_multiplier))).select(F.col("n").cast("double").alias("v")).distinct().withColumn("lost", F.lit(True))
    return maxima.with_rows(maxima.df.join(lost, "v", "left").select(*AXES, F.when(F.col("lost"), F.lit(0.0)).otherwise(pix()).alias("v")))


def label_maxima(image: Image, maxima: Image) -> Image:
    """image with each maximum's number drawn at its pixels."""
    drawn = maxima.df.filter(pix() != 0).select(*AXES, pix().alias("n"))
    return image.with_rows(image.df.join(drawn, list(AXES), "left").select(*AXES, F.coalesce("n", "v").alias("v")))


def grow_labels(image: Image, allowed: float, background: float = 0.0, connectivity: str = "Nearest") -> Image:
    """Every other colour grows into pixels of allowed, all at the same pace; where two meet, the smaller colour wins. background pixels neither grow nor give way.

    Each round adds one layer of pixels, found from those of the round before alone.
    """
    front = kept(image.df.filter((pix() != allowed) & (pix() != background)))
    free = kept(image.df.filter(pix() == allowed).select(*AXES))
    grown = None
    while True:
        front = kept(_shifted(front.withColumnRenamed("v", "own"), connectivity, "own").join(free, list(AXES)).groupBy(*AXES).agg(F.min("own").alias("v")))
        if front.isEmpty():
            break
        grown = front if grown is None else grown.union(front)
        free = kept(free.join(front, list(AXES), "left_anti"))
    if grown is None:
        return image
    return image.with_rows(image.df.join(grown.withColumnRenamed("v", "own"), list(AXES), "left").select(*AXES, F.coalesce("own", "v").alias("v")))


def morphological_reconstruction(seed: Image, mask: Image) -> Image:
    """Nonzero seed pixels spread over nonzero mask pixels to faces, edges and corners; a new pixel gets the largest of its neighbours of the round before."""
    front = kept(seed.df.filter(pix() != 0))
    free = kept(mask.df.filter(pix() != 0).select(*AXES).join(seed.df.filter(pix() == 0).select(*AXES), list(AXES)))
    # Only neighbours that the mask holds count, as seeds outside of it do not spread.
    front = front.join(mask.df.filter(pix() != 0).select(*AXES), list(AXES))
    grown = None
    while True:
        front = kept(_shifted(front.withColumnRenamed("v", "own"), "All", "own").join(free, list(AXES)).groupBy(*AXES).agg(F.max("own").alias("v")))
        if front.isEmpty():
            break
        grown = front if grown is None else grown.union(front)
        free = kept(free.join(front, list(AXES), "left_anti"))
    if grown is None:
        return seed
    return seed.with_rows(seed.df.join(grown.withColumnRenamed("v", "own"), list(AXES), "left").select(*AXES, F.coalesce("own", "v").alias("v")))


def fill_particles(image: Image, results: DataFrame, fill: float, connectivity: str = "Nearest") -> Image:
    """Regions of nonzero pixels that hold the position X, Y, Z (or x, y, z) of a row of results get the fill value, other regions become 1."""
    found = kept(regions(_foreground(image), pix() != 0, connectivity).select(*AXES, "region"))
    points = results.select(*[F.round(F.col(a)).cast("bigint").alias(a) for a in AXES])
    hit = found.join(points, list(AXES), "left_semi").select("region").distinct().withColumn("hit", F.lit(True))
    drawn = found.join(hit, "region", "left").select(*AXES, F.when(F.col("hit"), F.lit(float(fill))).otherwise(1.0).alias("n"))
    return image.with_rows(image.df.select(*AXES).join(drawn, list(AXES), "left").select(*AXES, F.coalesce("n", F.lit(0.0)).alias("v")))


def greedy_coloring(image: Image, connectivity: str = "All") -> Image:
    """Regions of equal nonzero pixels get colours from 1 on, such that regions that touch differ.

    Rounds: a region takes the least colour that its coloured neighbours leave once all neighbours with a smaller first pixel have one.
    """
    found = kept(regions(image, pix() != 0, connectivity).select(*AXES, "region"))
    touch = _shifted(found.withColumnRenamed("region", "a"), connectivity, "a").join(found.withColumnRenamed("region", "b"), list(AXES)).filter("b < a").select("a", "b").distinct()
    touch = kept(touch)
    colours = kept(found.select("region").distinct().select("region", F.lit(0).alias("c")))
    while True:
        seen = touch.join(colours.select(F.col("region").alias("b"), "c"), "b").groupBy(F.col("a").alias("region")).agg(F.min("c").alias("least"), F.collect_set("c").alias("used"))
        free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("used") + 1), "used"))
        new = colours.join(seen, "region", "left").select("region", F.when(F.col("c") > 0, F.col("c")).when(F.col("least").isNull(), 1).when(F.col("least") > 0, free).otherwise(0).alias("c"))
        colours = kept(new)
        if colours.filter("c = 0").isEmpty():
            break
    drawn = found.join(colours, "region").select(*AXES, F.col("c").cast("double").alias("n"))
    return image.with_rows(image.df.select(*AXES).join(drawn, list(AXES), "left").select(*AXES, F.coalesce("n", F.lit(0.0)).alias("v")))


def analyze_particles(image: Image, names: tuple[str, ...] = ("coordinates", "volume"), connectivity: str = "Nearest", least: int = 0) -> DataFrame:
    """Measurements of the connected regions of nonzero pixels that have at least least pixels."""
    out = analyzers.analyze(label(_foreground(image), 1.0, connectivity), tuple(dict.fromkeys((*names, "volume")))).filter(F.col("volume") >= least)
    return out.select(*analyzers.headers(names))


def draw_ellipsoids(image: Image, results: DataFrame, fill: float, kind: str = "principal") -> Image:
    """Draws the ellipsoid of each row of results (columns of pca, and volume for kind volume) into the image.

    Semi-axes are the root eigenvalues (principal), times bounding_scale (bounding), or scaled to the particle's volume
    (volume). A row's pixels come from its own bounding box, so the work is that of the boxes.
    """
    scale = {"principal": F.lit(1.0), "bounding": F.col("bounding_scale"), "volume": F.pow(F.col("volume") / (4 / 3 * math.pi * F.col("l1") * F.col("l2") * F.col("l3")), 1 / 3)}[kind]
    axes = [(F.sin(f"theta{i}") * F.cos(f"phi{i}"), F.sin(f"theta{i}") * F.sin(f"phi{i}"), F.cos(f"theta{i}")) for i in (1, 2, 3)]
    rows = results.select("cx", "cy", "cz", *[(F.col(f"l{i}") * scale).alias(f"r{i}") for i in (1, 2, 3)], *[c.alias(f"a{i}{k}") for i, axis in enumerate(axes, 1) for k, c in zip(AXES, axis, strict=True)])
    reach = F.greatest("r1", "r2", "r3")
    for a, n in zip(AXES, image.dims, strict=True):
        low, high = F.greatest(F.ceil(F.col(f"c{a}") - reach), F.lit(0)), F.least(F.floor(F.col(f"c{a}") + reach), F.lit(n - 1))
        rows = rows.withColumn(a, F.explode(F.when(low <= high, F.sequence(low, high))))
    total = F.lit(0.0)
    for i in (1, 2, 3):
        along = sum(((F.col(k) - F.col(f"c{k}")) * F.col(f"a{i}{k}") for k in AXES), F.lit(0.0))
        total = total + F.pow(along / F.col(f"r{i}"), 2)
    inside = rows.filter(total < 1).select(*[F.col(a).cast("bigint").alias(a) for a in AXES]).distinct().withColumn("hit", F.lit(True))
    return image.with_rows(image.df.join(inside, list(AXES), "left").select(*AXES, F.when(F.col("hit"), F.lit(float(fill))).otherwise(pix()).alias("v")))
