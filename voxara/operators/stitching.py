"""Stitching of overlapping tiles: pairs that overlap, block matching within overlaps, least-squares placement, and weighted blending.

Tiles are a table (tile, w, h, d, px, py, pz) of sizes and supposed positions of first pixels, and their pixels one of
(tile, x, y, z, v). Tiles, pairs and grid points are few beside pixels, which move only to the points and output blocks
that need them: by equality of cells, never tile against tile.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxara.operators.blocks import BLOCK
from voxara.raster import AXES, Image, pixel_round
from voxara.store import kept

SIZES, PLACES, SHIFTS = ("w", "h", "d"), ("px", "py", "pz"), ("sx", "sy", "sz")
#: Points of a pair's matches with a lower correlation are not used.
LEAST_SCORE = 0.5
#: Conjugate gradient steps stop at this part of the first residual.
TOLERANCE = 1e-13


def split(image: Image, tiles: DataFrame) -> DataFrame:
    """Pixels (tile, x, y, z, v) of crops of image: tiles (tile, w, h, d, ox, oy, oz) have sizes and first pixels."""
    cell = [n for n in image.dims]
    for size, n in zip(SIZES, range(3), strict=True):
        cell[n] = max(1, tiles.agg(F.max(size)).first()[0] or 1)
    spread = tiles
    for a, s, n in zip(AXES, SIZES, cell, strict=True):
        spread = spread.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(f"o{a}") / n), F.floor((F.col(f"o{a}") + F.col(s) - 1) / n))))
    own = image.df.select(*AXES, "v", *[F.floor(F.col(a) / n).alias(f"c{a}") for a, n in zip(AXES, cell, strict=True)])
    both = own.join(spread, ["cx", "cy", "cz"])
    inside = F.lit(True)
    for a, s in zip(AXES, SIZES, strict=True):
        inside = inside & (F.col(a) >= F.col(f"o{a}")) & (F.col(a) < F.col(f"o{a}") + F.col(s))
    return both.filter(inside).select("tile", *[(F.col(a) - F.col(f"o{a}")).alias(a) for a in AXES], "v")


def overlaps(tiles: DataFrame, slack: float = 0.0) -> DataFrame:
    """a, b (a < b) of the tiles whose boxes overlap by a pixel at least where positions may be off by slack; met by the cells of a grid as wide as the largest tile."""
    width = [max(1.0, float(tiles.agg(F.max(s)).first()[0] or 1)) + 2 * slack for s in SIZES]
    boxes = tiles
    for a, s, p, n in zip(AXES, SIZES, PLACES, width, strict=True):
        low, high = F.col(p) - slack, F.col(p) + F.col(s) - 1 + slack
        boxes = boxes.withColumn(f"l{a}", low).withColumn(f"h{a}", high).withColumn(f"c{a}", F.explode(F.sequence(F.floor(low / n), F.floor(high / n))))
    side = lambda t: boxes.select("cx", "cy", "cz", F.col("tile").alias(t), *[F.col(f"{e}{a}").alias(f"{e}{a}{t}") for e in "lh" for a in AXES])
    both = side("a").join(side("b"), ["cx", "cy", "cz"]).filter("a < b")
    for a in AXES:
        both = both.filter((F.col(f"l{a}a") <= F.col(f"h{a}b")) & (F.col(f"l{a}b") <= F.col(f"h{a}a")))
    return both.select("a", "b").distinct()


def grid_points(tiles: DataFrame, pairs: DataFrame, step: tuple[int, int, int], radius: tuple[int, int, int]) -> DataFrame:
    """point, a, b, x, y, z (pixels of a) and qx, qy, qz (the same places supposedly, in b): a grid about the middle of each overlap, whose blocks lie in it where that is wide enough."""
    of = lambda t: tiles.select(F.col("tile").alias(t), *[F.col(c).alias(f"{c}_{t}") for c in (*SIZES, *PLACES)])
    each = pairs.join(of("a"), "a").join(of("b"), "b")
    for a, s, p, n, r in zip(AXES, SIZES, PLACES, step, radius, strict=True):
        gap = F.col(f"{p}_b") - F.col(f"{p}_a")  # b's first pixel in a
        low, high = F.greatest(F.lit(0.0), gap), F.least(F.col(f"{s}_a"), gap + F.col(f"{s}_b")) - 1
        steps = F.greatest(F.lit(0), F.floor(((high - low) / 2 - r) / n))
        middle = F.floor((low + high) / 2 + 0.5)
        each = each.withColumn(a, F.explode(F.transform(F.sequence(-steps, steps), lambda i: middle + i * n))).withColumn(f"q{a}", F.floor(F.col(a) - gap + 0.5))
    named = each.select("a", "b", *[F.col(c).cast("bigint").alias(c) for c in (*AXES, "qx", "qy", "qz")])
    return named.select(F.concat_ws("/", "a", "b", *AXES).alias("point"), "*")


def best_shift(a: np.ndarray, b: np.ndarray) -> tuple[tuple[int, ...], float, float, float, float, float]:
    """The shift (first of the best in order) of block a within the larger block b with the highest Pearson correlation over pixels that both have, that correlation, and the means and deviations there."""
    room = [m - n for m, n in zip(b.shape, a.shape, strict=True)]
    best = ((0, 0, 0), -2.0, math.nan, math.nan, math.nan, math.nan)
    full = np.isfinite(a)
    for at in np.ndindex(*(n + 1 for n in room)):
        part = b[tuple(slice(i, i + n) for i, n in zip(at, a.shape, strict=True))]
        both = full & np.isfinite(part)
        if both.sum() * 2 < full.sum():
            continue
        p, q = a[both], part[both]
        dp, dq = p - p.mean(), q - q.mean()
        norm = math.sqrt((dp @ dp) * (dq @ dq))
        score = round(float(dp @ dq) / norm, 12) if norm > 0 else 0.0
        if score > best[1]:
            best = (tuple(i - n // 2 for i, n in zip(at, room, strict=True)), score, float(p.mean()), float(q.mean()), float(p.std()), float(q.std()))
    return best


def match(pixels: DataFrame, points: DataFrame, search: tuple[int, int, int], radius: tuple[int, int, int]) -> DataFrame:
    """a, b, x, y, z, sx, sy, sz, score, ma, mb, da, db for each point: place x + s in b, less what was supposed, looks most like the block of radius about x in a.

    A task has the two blocks of a point. ma to db are the means and deviations of the matched parts.
    """
    sides = []
    for t, axes, wide in (("a", AXES, radius), ("b", ("qx", "qy", "qz"), tuple(r + s for r, s in zip(radius, search, strict=True)))):
        part = points.select("point", F.col(t).alias("tile"), *[F.col(q).alias(f"m{x}") for q, x in zip(axes, AXES, strict=True)])
        cells = part
        for a, r in zip(AXES, wide, strict=True):
            n = 2 * r + 1
            cells = cells.withColumn(f"c{a}", F.explode(F.sequence(F.floor((F.col(f"m{a}") - r) / n), F.floor((F.col(f"m{a}") + r) / n))))
        own = pixels.select("tile", *AXES, "v", *[F.floor(F.col(a) / (2 * r + 1)).alias(f"c{a}") for a, r in zip(AXES, wide, strict=True)])
        met = own.join(cells, ["tile", "cx", "cy", "cz"])
        for a, r in zip(AXES, wide, strict=True):
            met = met.filter(F.abs(F.col(a) - F.col(f"m{a}")) <= r)
        sides.append(met.select("point", F.lit(t == "a").alias("mine"), *[(F.col(a) - F.col(f"m{a}") + r).cast("int").alias(f"i{a}") for a, r in zip(AXES, wide, strict=True)], "v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = []
        for mine, wide in ((True, radius), (False, tuple(r + s for r, s in zip(radius, search, strict=True)))):
            rows = pdf[pdf["mine"] == mine]
            block = np.full([2 * r + 1 for r in wide], np.nan)
            block[rows["ix"], rows["iy"], rows["iz"]] = rows["v"]
            blocks.append(block)
        shift, *found = best_shift(*blocks)
        return pd.DataFrame([(pdf["point"].iloc[0], *map(float, shift), *found)], columns=["point", *SHIFTS, "score", "ma", "mb", "da", "db"])

    scored = sides[0].union(sides[1]).groupBy("point").applyInPandas(run, "point string, sx double, sy double, sz double, score double, ma double, mb double, da double, db double")
    return points.join(scored, "point").filter(F.col("score") >= LEAST_SCORE).select("a", "b", *AXES, "qx", "qy", "qz", *[(F.col(f"q{a}") + F.col(s) - F.col(a)).alias(s) for a, s in zip(AXES, SHIFTS, strict=True)], "score", "ma", "mb", "da", "db")


def solve(count: int, a: np.ndarray, b: np.ndarray, differences: np.ndarray, weights: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Values (count x columns) that fit value[b] - value[a] = differences best by weighted squares; of each connected group the first keeps its start.

    Conjugate gradients on the graph's Laplacian, so that nothing of the size of its square is made.
    """
    group = np.arange(count)
    while True:
        new = group.copy()
        np.minimum.at(new, a, group[b])
        np.minimum.at(new, b, group[a])
        new = new[new]
        if (new == group).all():
            break
        group = new
    free = (group != np.arange(count))[:, None]

    def spread(x: np.ndarray) -> np.ndarray:
        flow, out = weights[:, None] * (x[b] - x[a]), np.zeros_like(x)
        np.add.at(out, b, flow)
        np.add.at(out, a, -flow)
        return np.where(free, out, 0.0)

    want = np.zeros_like(start)
    np.add.at(want, b, weights[:, None] * differences)
    np.add.at(want, a, -weights[:, None] * differences)
    x = start.copy()
    left = np.where(free, want, 0.0) - spread(x)
    way, size = left.copy(), (left * left).sum(0)
    first = size.max(initial=0.0)
    for _ in range(10 * count + 10):
        if size.max(initial=0.0) <= TOLERANCE**2 * max(first, 1.0):
            break
        moved = spread(way)
        with np.errstate(divide="ignore", invalid="ignore"):
            length = np.nan_to_num(size / (way * moved).sum(0))
            x, left = x + length * way, left - length * moved
            new = (left * left).sum(0)
            way, size = left + np.nan_to_num(new / size) * way, new
    return x


def place(tiles: DataFrame, matches: DataFrame) -> DataFrame:
    """tile, w, h, d, px, py, pz, gain, offset: positions and grey scales that fit all matches best, weighted by score.

    Of tiles that matches connect, the one of least number stays where it is and as it is. Pairs' means and weights are aggregated
    before one task, which has a row for each tile and each pair of overlapping tiles, solves for all.
    """
    sums = [F.sum("score").alias("weight"), *[(F.sum(F.col(s) * F.col("score")) / F.sum("score")).alias(s) for s in SHIFTS]]
    scale = F.when((F.col("da") > 0) & (F.col("db") > 0), F.log(F.col("da") / F.col("db")))
    pairs = matches.groupBy("a", "b").agg(*sums, F.avg(scale).alias("scale"), F.avg("ma").alias("ma"), F.avg("mb").alias("mb"))
    kind = tiles.select(F.lit(0).alias("kind"), "tile", F.lit(0).cast("bigint").alias("b"), *[F.col(c).cast("double").alias(c) for c in (*SIZES, *PLACES)], F.lit(1.0).alias("weight"))
    rows = kind.unionByName(pairs.select(F.lit(1).alias("kind"), F.col("a").alias("tile"), "b", *[F.col(s).alias(n) for s, n in zip(SHIFTS, PLACES, strict=True)], F.coalesce("scale", F.lit(0.0)).alias("w"), F.col("ma").alias("h"), F.col("mb").alias("d"), "weight"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["kind"] == 0].sort_values("tile", ignore_index=True)
        links = pdf[pdf["kind"] == 1].sort_values(["tile", "b"], ignore_index=True)
        number = pd.Series(np.arange(len(own)), index=own["tile"])
        a, b = number[links["tile"]].to_numpy(), number[links["b"]].to_numpy()
        weights, start = links["weight"].to_numpy(), own[list(PLACES)].to_numpy()
        # s: a point's place in b less that in a, so b lies that much before a.
        at = solve(len(own), a, b, -links[list(PLACES)].to_numpy(), weights, start)
        gain = np.exp(solve(len(own), a, b, links[["w"]].to_numpy(), weights, np.zeros((len(own), 1))))[:, 0]
        # gain * v + offset are to agree where tiles overlap.
        offset = solve(len(own), a, b, (gain[a] * links["h"] - gain[b] * links["d"]).to_numpy()[:, None], weights, np.zeros((len(own), 1)))[:, 0]
        return own.assign(**{p: np.round(at[:, i], 9) for i, p in enumerate(PLACES)}, gain=gain, offset=offset)[["tile", *SIZES, *PLACES, "gain", "offset"]]

    schema = "tile bigint, w double, h double, d double, px double, py double, pz double, gain double, offset double"
    return rows.groupBy(F.lit(0).alias("_all")).applyInPandas(run, schema)


def world_to_local(placed: DataFrame, matches: DataFrame, step: tuple[int, int, int], local: bool = True) -> DataFrame:
    """tile, i, j, k, sx, sy, sz: at grid points of each tile (pixel i * step of it and so on), what to add to world coordinates, besides the tile's position, to get the tile's.

    Where local, each of two tiles takes half of what a match says beyond their positions, at the grid point nearest to
    the match, as the mean over matches; grid points without any have the mean of those of the tile around them, weighted by the inverse square distance, or 0.
    """
    grid = placed
    for s, n, g in zip(SIZES, step, "ijk", strict=True):
        grid = grid.withColumn(g, F.explode(F.sequence(F.lit(0), F.ceil((F.col(s) - 1) / n).cast("int"))))
    grid = grid.select("tile", "i", "j", "k")
    if not local:
        return grid.select("*", *[F.lit(0.0).alias(s) for s in SHIFTS])
    of = lambda t: placed.select(F.col("tile").alias(t), *[F.col(p).alias(f"{p}_{t}") for p in PLACES])
    both = matches.join(of("a"), "a").join(of("b"), "b")
    for s, p in zip(SHIFTS, PLACES, strict=True):
        both = both.withColumn(f"e{s}", (F.col(s) + F.col(f"{p}_b") - F.col(f"{p}_a")) / 2)
    # The world place midway: a reads it half of the rest before, b half of it behind.
    near = lambda c, n: F.floor(c / n + 0.5).cast("int")
    mine = both.select(F.col("a").alias("tile"), *[near(F.col(a), n).alias(g) for a, n, g in zip(AXES, step, "ijk", strict=True)], *[(-F.col(f"e{s}")).alias(s) for s in SHIFTS])
    other = both.select(F.col("b").alias("tile"), *[near(F.col(a) + F.col(s), n).alias(g) for a, s, n, g in zip(AXES, SHIFTS, step, "ijk", strict=True)], *[F.col(f"e{s}").alias(s) for s in SHIFTS])
    known = mine.union(other).groupBy("tile", "i", "j", "k").agg(*[F.avg(s).alias(s) for s in SHIFTS])
    rows = grid.join(known, ["tile", "i", "j", "k"], "left")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        at, have = pdf[["i", "j", "k"]].to_numpy() * np.array(step), pdf["sx"].notna().to_numpy()
        values = pdf[list(SHIFTS)].to_numpy(float)
        if have.any():
            for n in np.flatnonzero(~have):
                w = 1 / ((at[have] - at[n]) ** 2).sum(1)
                values[n] = (w[:, None] * values[have]).sum(0) / w.sum()
        return pdf.assign(**{s: np.nan_to_num(values[:, c]) for c, s in enumerate(SHIFTS)})

    return rows.groupBy("tile").applyInPandas(fill, "tile bigint, i int, j int, k int, sx double, sy double, sz double")


def _weights(kind: float, p: np.ndarray, size: np.ndarray, flat: bool) -> np.ndarray:
    """Of tile pixels p: by distance from the tile's faces (kind below 0), or from the middle of a circle of diameter kind (0: the largest that fits)."""
    if kind < 0:
        sides = 2 * np.minimum(p, size - 1 - p) / size[:2].min() if flat else 2 * np.minimum(p, size - 1 - p) / size.min()
        return sides[:, 0] * sides[:, 1] * (1 if flat else sides[:, 2])
    diameter = kind or size[:2].min()
    return np.maximum(0, 1 - np.hypot(p[:, 0] - size[0] / 2, p[:, 1] - size[1] / 2) / (diameter / 2))


def _cubic(t: np.ndarray) -> np.ndarray:
    """Keys' weights of the pixels -1, 0, 1 and 2 at fractions t."""
    return np.stack([-0.5 * t**3 + t**2 - 0.5 * t, 1.5 * t**3 - 2.5 * t**2 + 1, -1.5 * t**3 + 2 * t**2 + 0.5 * t, 0.5 * t**3 - 0.5 * t**2], axis=-1)


def _read(a: np.ndarray, p: np.ndarray, missing: bool) -> np.ndarray:
    """Cubic interpolation of a at p, 0 beyond; missing: 0 where a pixel that counts is 0. Axes of one pixel aren't interpolated."""
    padded = np.pad(a, 2)
    low = np.floor(np.round(p, 9)).astype(int)
    taps = [np.zeros((len(p), 4)) if n == 1 else _cubic(np.round(p[:, i], 9) - low[:, i]) for i, n in enumerate(a.shape)]
    for i, n in enumerate(a.shape):
        if n == 1:
            taps[i][:, 1] = 1
            low[:, i] = 0
    out, whole = np.zeros(len(p)), np.ones(len(p), bool)
    for o in np.ndindex(4, 4, 4):
        w = taps[0][:, o[0]] * taps[1][:, o[1]] * taps[2][:, o[2]]
        at = tuple(np.clip(low[:, i] + o[i] + 1, 0, padded.shape[i] - 1) for i in range(3))
        v = padded[at]
        out += w * v
        whole &= (w == 0) | (v != 0)
    return np.where(whole, out, 0.0) if missing else out


def stitch(pixels: DataFrame, placed: DataFrame, fields: DataFrame, step: tuple[int, int, int], dims: tuple[int, int, int], dtype: str, position: tuple[int, int, int] = (0, 0, 0), normalize: bool = True, circle: float = -1.0, zeroes_are_missing: bool = False) -> tuple[Image, Image]:
    """The blended image of world box dims at position, and the deviation of the tiles from it at each pixel.

    Every output block gets the pixels that it reads of each tile, and tiles' fields (see world_to_local). Pixels that read 0 or
    lie on a tile's faces have no weight; where no tile has any, the image is 0.
    """
    reach = fields.groupBy("tile").agg(*[f(s).alias(f"{n}{s}") for s in SHIFTS for n, f in (("l", F.min), ("h", F.max))])
    field = fields.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("i", "j", "k", *SHIFTS))).alias("field"))
    info = kept(placed.join(reach, "tile").join(field, "tile"))
    at = pixels.join(info.drop("field", "gain", "offset", *SIZES), "tile")
    for a, p, s, o, n, d in zip(AXES, PLACES, SHIFTS, position, BLOCK, dims, strict=True):
        world = F.col(a) + F.col(p) - o
        low = F.greatest(F.lit(0), F.floor((world - F.col(f"h{s}") - 3) / n))
        high = F.least(F.lit((d - 1) // n), F.floor((world - F.col(f"l{s}") + 3) / n))
        at = at.withColumn(f"b{a}", F.explode(F.when(low <= high, F.sequence(low, high))))
    keys = ["bx", "by", "bz"]
    mine = at.select(*keys, "tile", *AXES, "v")
    counts = [-(-d // n) for d, n in zip(dims, BLOCK, strict=True)]
    i = F.col("id")
    blocks = placed.sparkSession.range(math.prod(counts)).select((i % counts[0]).alias("bx"), (F.floor(i / counts[0]) % counts[1]).alias("by"), F.floor(i / (counts[0] * counts[1])).alias("bz"))
    about = mine.select(*keys, "tile").distinct().join(info, "tile").unionByName(blocks, allowMissingColumns=True)
    block = BLOCK

    def run(rows: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
        first = np.array([int(tiles[k].iloc[0]) for k in keys]) * block
        shape = np.minimum(first + block, dims) - first
        x = np.indices(shape).reshape(3, -1).T + first + position
        total, weight, square = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
        for t in tiles[tiles["tile"].notna()].sort_values("tile").itertuples():
            own = rows[rows["tile"] == t.tile]
            size = np.array([t.w, t.h, t.d])
            flat = size[2] == 1
            low = own[list(AXES)].min().to_numpy()
            a = np.zeros(own[list(AXES)].max().to_numpy() - low + 1)
            a[tuple((own[list(AXES)].to_numpy() - low).T)] = own["v"]
            p = x - np.array([t.px, t.py, t.pz])
            p = p + _field(t.field, p, step)
            inside = np.flatnonzero(((p >= 0) & (p <= size - 1)).all(1))
            v = _read(a, p[inside] - low, zeroes_are_missing)
            w = np.where(v != 0, _weights(circle, p[inside], size, flat), 0.0)
            if normalize:
                v = v * t.gain + t.offset
            weight[inside] += w
            total[inside] += w * v
            square[inside] += w * v * v
        seen = weight > 0
        mean = np.divide(total, weight, out=np.zeros(len(x)), where=seen)
        spread = np.sqrt(np.maximum(np.divide(square, weight, out=np.zeros(len(x)), where=seen) - mean**2, 0))
        out = x - position
        return pd.DataFrame({"x": out[:, 0], "y": out[:, 1], "z": out[:, 2], "v": mean, "s": spread})

    about = about.toDF(*about.columns)  # columns of its own, for the grouping
    found = mine.groupBy(*keys).cogroup(about.groupBy(*keys)).applyInPandas(run, "x bigint, y bigint, z bigint, v double, s double")
    every = kept(found)
    image = lambda c: Image(every.select(*AXES, pixel_round(F.col(c), dtype).alias("v")), dims, dtype)
    return image("v"), image("s")


def _field(rows: list, p: np.ndarray, step: tuple[int, int, int]) -> np.ndarray:
    """Shifts at tile pixels p, linear between the field's grid points and those of the nearest ones beyond."""
    rows = [tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in rows]
    table = np.array(rows, float)
    count = table[:, :3].max(0).astype(int) + 1
    grid = np.zeros((*count, 3))
    grid[tuple(table[:, :3].astype(int).T)] = table[:, 3:]
    at = np.clip(p / np.array(step), 0, count - 1)
    low = np.minimum(np.floor(at).astype(int), np.maximum(count - 2, 0))
    t, out = at - low, np.zeros_like(p, dtype=float)
    for o in np.ndindex(2, 2, 2):
        w = np.prod(np.where(o, t, 1 - t), axis=1)
        out += w[:, None] * grid[tuple(np.minimum(low[:, i] + o[i], count[i] - 1) for i in range(3))]
    return out
