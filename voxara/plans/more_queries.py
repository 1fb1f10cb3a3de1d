"""Queries of filters by convolution, regions, structure, transforms, skeletons, files and session commands, with their DuckDB SQL."""

from __future__ import annotations

import math
import os
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.operators import analyzers, distance, fourier, generate, heights, neighbourhood, pointwise, regions, registration, skeletons, statistics, structure, tomography, transforms
from voxara.plans.script import Session
from voxara.plans.volume import AROUND, EMB, U8, Query, emb, of, pixel_sql, saturated, u8
from voxara.raster import AXES, Image, new_image, pix
from voxara.sources import files, raw, volumes
from voxara.store import kept, shared_folder

#: n: offsets to the neighbours of a pixel by faces (n6) or of all kinds (n26).
OFFSETS = "n26 AS (SELECT i - 1 AS i, j - 1 AS j, k - 1 AS k FROM range(3) a(i), range(3) b(j), range(3) c(k) WHERE i <> 1 OR j <> 1 OR k <> 1), n6 AS (SELECT * FROM n26 WHERE abs(i) + abs(j) + abs(k) = 1)"


def regions_sql(source: str, neighbours: str = "n6") -> str:
    """CTEs f (the pixels of source with id), e (pairs of neighbours of equal value) and r (id, root: the least id of its region)."""
    return (
        f"f AS MATERIALIZED (SELECT x + 8 * y + 64 * z AS id, x, y, z, v FROM {source}), {OFFSETS}, "
        f"q AS MATERIALIZED (SELECT id, v, x + i AS x, y + j AS y, z + k AS z FROM f, {neighbours}), e AS MATERIALIZED (SELECT q.id AS a, f.id AS b FROM q JOIN f USING (x, y, z, v)), "
        "t(id, other) AS (SELECT id, id FROM f UNION SELECT t.id, e.b FROM t JOIN e ON t.other = e.a), r AS MATERIALIZED (SELECT id, min(other) AS root FROM t GROUP BY id)"
    )


def reach_sql(seeds: str, within: str, neighbours: str = "n6") -> str:
    """CTE t (x, y, z): the pixels of within that a path over such pixels joins to a seed, seeds included."""
    return f"{OFFSETS}, t(x, y, z) AS (SELECT x, y, z FROM {seeds} UNION SELECT w.x, w.y, w.z FROM t, {neighbours} n JOIN {within} w ON w.x = t.x + i AND w.y = t.y + j AND w.z = t.z + k)"


def convolved(source: str, orders: tuple[int, int, int], sigma: float = 1.0) -> tuple[str, str]:
    """(CTEs, name of the last): passes along x, y and z with sampled Gaussians or their derivatives; the nearest pixels stand beyond the image."""
    r = math.ceil(3 * sigma)
    weight = {0: "1", 1: f"-t / {sigma * sigma}", 2: f"(t * t / {sigma**4} - 1 / {sigma * sigma})"}
    out, tag = [], "".join(map(str, orders))
    for axis, order in zip(AXES, orders, strict=True):
        name = f"{source}_{tag}{axis}"
        top = "7" if axis != "z" else "(SELECT max(z) FROM emb)"
        taps = f"(SELECT t, exp(-t * t / {2.0 * sigma * sigma}) / sum(exp(-t * t / {2.0 * sigma * sigma})) OVER () * {weight[order]} AS w FROM (SELECT i - {r} AS t FROM range({2 * r + 1}) a(i)))"
        moved = ", ".join(f"least(greatest({a} - t, 0), {top}) AS c" if a == axis else a for a in AXES)
        on = " AND ".join(f"b.{a} = q.c" if a == axis else f"b.{a} = q.{a}" for a in AXES)
        out.append(f"{name} AS MATERIALIZED (SELECT {', '.join(f'q.{a}' if a != axis else 'q.own AS ' + a for a in AXES)}, sum(q.w * b.v) AS v FROM (SELECT {moved}, {axis} AS own, w FROM {source}, {taps}) q JOIN {source} b ON {on} GROUP BY ALL)")
        source = name
    return ", ".join(out), source


def _values(spark: SparkSession, found: dict[str, object]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in found.items()], "name string, value string")


def _values_sql(found: dict[str, object]) -> str:
    rows = ", ".join("('{}', '{}')".format(k, str(v).replace("'", "''")) for k, v in found.items())
    return f"SELECT * FROM (VALUES {rows}) t(name, value)"


def table() -> dict[str, Query]:
    return filters() | thresholds() | region_queries() | shapes() | registration_queries() | skeleton_queries() | file_queries() | session_queries()


def filters() -> dict[str, Query]:
    out: dict[str, Query] = {}
    with_u8 = f"WITH {U8}"
    smooth, last = convolved("u8", (0, 0, 0))
    out["gaussfilter"] = of(u8, lambda im: neighbourhood.gaussian(im, (1, 1, 1))), f"{with_u8}, {smooth} SELECT x, y, z, ({saturated('v')})::DOUBLE AS v FROM {last}"
    out["highpassfilter"] = of(u8, lambda im: neighbourhood.high_pass(im, (1, 1, 1), 128)), f"{with_u8}, {smooth} SELECT x, y, z, ({saturated('u8.v - g.v + 128')})::DOUBLE AS v FROM u8 JOIN {last} g USING (x, y, z)"
    d = [convolved("u8", tuple(int(i == k) for i in range(3))) for k in range(3)]
    out["derivative"] = of(u8, lambda im: neighbourhood.derivative(im, (1, 1, 1), 0)), f"{with_u8}, {d[0][0]} SELECT x, y, z, v FROM {d[0][1]}"
    second, name = convolved("u8", (1, 1, 0))
    out["derivative_xy"] = of(u8, lambda im: neighbourhood.derivative(im, (1, 1, 1), 0, 1)), f"{with_u8}, {second} SELECT x, y, z, v FROM {name}"
    out["gradient_y"] = of(u8, lambda im: neighbourhood.gradient(im)[1]), f"{with_u8}, {d[1][0]} SELECT x, y, z, v FROM {d[1][1]}"
    out["gradientmagnitude"] = of(u8, neighbourhood.gradient_magnitude), f"{with_u8}, {', '.join(c for c, _ in d)} SELECT x, y, z, sqrt(a.v * a.v + b.v * b.v + c.v * c.v) AS v FROM {d[0][1]} a JOIN {d[1][1]} b USING (x, y, z) JOIN {d[2][1]} c USING (x, y, z)"
    ball = "abs(i) + abs(j) + abs(k) <= 1"
    once = lambda source, target, agg: (
        f"q_{target} AS MATERIALIZED (SELECT x, y, z, least(greatest(x + i, 0), 7) AS cx, least(greatest(y + j, 0), 7) AS cy, least(greatest(z + k, 0), m) AS cz FROM {source}, o, d WHERE {ball}), "
        f"{target} AS MATERIALIZED (SELECT q.x, q.y, q.z, {agg}(b.v) AS v FROM q_{target} q JOIN {source} b ON b.x = cx AND b.y = cy AND b.z = cz GROUP BY ALL)"
    )
    for kind, first, second in (("opening", "min", "max"), ("closing", "max", "min")):
        out[f"{kind}filter"] = of(u8, getattr(neighbourhood, kind)), f"{with_u8}, {AROUND}, {once('u8', 'one', first)}, {once('one', 'two', second)} SELECT x, y, z, v FROM two"
    wide = (
        "d AS (SELECT max(z) AS m FROM u8), o AS (SELECT i - 2 AS i, j - 2 AS j, k - 2 AS k FROM range(5) a(i), range(5) b(j), range(5) c(k)), "
        "q AS MATERIALIZED (SELECT x, y, z, v, i * i + j * j + k * k AS far, least(greatest(x + i, 0), 7) AS cx, least(greatest(y + j, 0), 7) AS cy, least(greatest(z + k, 0), m) AS cz FROM u8, o, d), "
        "p AS (SELECT q.x, q.y, q.z, b.v, exp(-0.5 * far / 0.25 - 0.5 * pow((b.v - q.v) / 30, 2)) AS w FROM q JOIN u8 b ON b.x = cx AND b.y = cy AND b.z = cz)"
    )
    out["bilateralfilter"] = of(u8, lambda im: neighbourhood.bilateral(im, (0.5, 0.5, 0.5), 30)), f"{with_u8}, {wide} SELECT x, y, z, ({saturated('sum(w * v) / sum(w)')})::DOUBLE AS v FROM p GROUP BY x, y, z"
    out["bilateralfilterapprox"] = of(u8, lambda im: neighbourhood.bilateral_sampled(im, 1.0, 60)), None
    out["maxfilter_ellipsoidal"] = of(u8, lambda im: neighbourhood.rank_filter("maxfilter", im)), f"{with_u8}, {AROUND} SELECT x, y, z, max(v) AS v FROM p WHERE {ball} GROUP BY x, y, z"
    ranked = f"{with_u8}, {AROUND}, l AS (SELECT x, y, z, v, max(CASE WHEN i = 0 AND j = 0 AND k = 0 THEN v END) OVER w AS own, row_number() OVER (PARTITION BY x, y, z ORDER BY v) AS n, sum(v) OVER (PARTITION BY x, y, z ORDER BY v ROWS UNBOUNDED PRECEDING) AS s, sum(v) OVER w AS t, lead(v) OVER (PARTITION BY x, y, z ORDER BY v) AS after FROM p WINDOW w AS (PARTITION BY x, y, z)), c AS (SELECT x, y, z, any_value(own) AS own, max(v) AS top, arg_max(v, (pow(s * 27 - t * n, 2) / (n * (27 - n)), v)) FILTER (n < 27 AND after > v) AS cut FROM l GROUP BY x, y, z)"
    out["localthreshold_otsu"] = of(u8, lambda im: neighbourhood.local_threshold(im, (1, 1, 1), "Otsu")), f"{ranked} SELECT x, y, z, CASE WHEN own > coalesce(cut, top) THEN 1 ELSE 0 END::DOUBLE AS v FROM c"
    formula = "if(x0 > 128 and not (y == 2), -x0 ^ 2 / 300 + 300, max(x0, 10 * x) % 77) + (z < 9 ? 1 : 0)"
    out["px_eval_formula"] = of(u8, lambda im: pointwise.evaluate(formula, im)), pixel_sql(saturated("CASE WHEN v > 128 AND y <> 2 THEN -pow(v, 2) / 300 + 300 ELSE fmod(greatest(v, 10.0::DOUBLE * x), 77) END + CASE WHEN z < 9 THEN 1 ELSE 0 END"))
    out["px_swapbyteorder_signed"] = of(u8, lambda im: pointwise.swap_byte_order(pointwise.convert(im, "int16"))), pixel_sql("CASE WHEN v * 256 >= 32768 THEN v * 256 - 65536 ELSE v * 256 END")
    complex_ = lambda im: im.df.select(*AXES, pix().alias("re"), (pix() * pix() + 1).alias("im"))
    parts = {"real": ("v", "0"), "imag": ("v * v + 1", "0"), "conjugate": ("v", "-(v * v + 1)"), "arg": ("atan2(v * v + 1, v)", "0"), "normsquared": ("v * v + (v * v + 1) * (v * v + 1)", "0"), "abs": ("sqrt(v * v + (v * v + 1) * (v * v + 1))", "0"), "negate": ("-v", "-(v * v + 1)")}
    for name, (re, im_) in parts.items():
        out[f"px_complex_{name}"] = of(emb, lambda im, n=name: pointwise.complex_unary(n, complex_(im))), f"WITH {EMB} SELECT x, y, z, ({re})::DOUBLE AS re, ({im_})::DOUBLE AS im FROM emb"
    turn = lambda axis, n, to: (
        f"SELECT {', '.join('f AS ' + a if a == axis else a for a in AXES)}, sum(re * cos(2 * pi() * f * {axis} / {n}) + im * sin(2 * pi() * f * {axis} / {n})) AS re, sum(im * cos(2 * pi() * f * {axis} / {n}) - re * sin(2 * pi() * f * {axis} / {n})) AS im"
        f" FROM {{0}}, (SELECT range::BIGINT AS f FROM range({to})) GROUP BY ALL"
    )
    steps = f"c0 AS (SELECT x, y, z, v AS re, 0.0 AS im FROM emb WHERE z < 40), c1 AS MATERIALIZED ({turn('x', 8, 5).format('c0')}), c2 AS MATERIALIZED ({turn('y', 8, 8).format('c1')}), c3 AS MATERIALIZED ({turn('z', 40, 40).format('c2')})"
    slab = lambda im: transforms.crop(im, (0, 0, 0), (8, 8, 40))
    rounded = lambda df: df.select(*AXES, (F.round("re", 6) + 0.0).alias("re"), (F.round("im", 6) + 0.0).alias("im"))
    out["fft"] = of(emb, lambda im: rounded(fourier.fft(slab(im)))), f"WITH {EMB}, {steps} SELECT x, y, z, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM c3"
    out["ifft"] = of(emb, lambda im: fourier.ifft(fourier.fft(im), im.dims).map(F.round(pix(), 6) + 0.0)), f"WITH {EMB} SELECT x, y, z, round(v, 6) + 0.0 AS v FROM emb"
    out["powerspectrum"] = of(emb, lambda im: fourier.power_spectrum(slab(im)).map(F.round(pix(), 6))), f"WITH {EMB}, {steps} SELECT x, y, z, round(re * re + im * im, 6) AS v FROM c3"
    out["bandpassfilter"] = of(emb, lambda im: fourier.band_pass(im, 2, 5)), None
    return out


def thresholds() -> dict[str, Query]:
    bins = (
        f"WITH {U8}, c AS (SELECT least(greatest(floor(v), 0), 255)::INT AS k, count(*)::DOUBLE AS n FROM u8 GROUP BY 1), h AS (SELECT range::INT AS k, coalesce(n, 0) / sum(n) OVER () AS p FROM range(256) LEFT JOIN c ON k = range), "
        "s AS MATERIALIZED (SELECT k, p, sum(p) OVER w AS low, sum(p * p) OVER w AS sq, sum(p * k) OVER w AS m, sum(p * p) OVER () AS all_sq, sum(p * k) OVER () AS mean FROM h WINDOW w AS (ORDER BY k)), "
    )
    end = " SELECT x, y, z, CASE WHEN v > cut THEN 1 ELSE 0 END::DOUBLE AS v FROM u8, best"
    sql: dict[str, str | None] = dict.fromkeys(("Intermodes", "Li", "MinError", "Minimum", "RenyiEntropy"))
    sql["Percentile"] = "best AS (SELECT k AS cut FROM s ORDER BY round(abs(low - 0.5), 12), k LIMIT 1)"
    sql["Yen"] = "best AS (SELECT k AS cut FROM (SELECT k, -CASE WHEN sq * (all_sq - sq) > 0 THEN ln(greatest(sq * (all_sq - sq), 1e-300)) ELSE 0 END + 2 * CASE WHEN low * (1 - low) > 0 THEN ln(greatest(low * (1 - low), 1e-300)) ELSE 0 END AS crit FROM s WHERE sq * (all_sq - sq) > 1e-14) ORDER BY round(crit, 10) DESC, k LIMIT 1)"
    sql["Huang"] = (
        "ends AS (SELECT min(k) AS a, max(k) AS b FROM h WHERE p > 0), cuts AS (SELECT k AS t, m / low AS lo, (mean - m) / (1 - low) AS hi FROM s, ends WHERE k >= a AND k < b), "
        "u AS (SELECT t, p, 1 / (1 + abs(k - CASE WHEN k <= t THEN lo ELSE hi END) / (b - a)) AS u FROM cuts, h, ends), e AS (SELECT t, sum(CASE WHEN u > 1e-6 AND u < 1 - 1e-6 THEN p * (-u * ln(u) - (1 - u) * ln(1 - u)) ELSE 0 END) AS e FROM u GROUP BY t), best AS (SELECT t AS cut FROM e ORDER BY round(e, 12), t LIMIT 1)"
    )
    sql["Moments"] = (
        "mo AS (SELECT sum(p * k) AS m1, sum(p * k * k) AS m2, sum(p * k * k * k) AS m3 FROM h), co AS (SELECT *, (m1 * m3 - m2 * m2) / (m2 - m1 * m1) AS c0, (m1 * m2 - m3) / (m2 - m1 * m1) AS c1 FROM mo), "
        "z AS (SELECT m1, (-c1 - sqrt(c1 * c1 - 4 * c0)) / 2 AS z0, (-c1 + sqrt(c1 * c1 - 4 * c0)) / 2 AS z1 FROM co), best AS (SELECT min(k) AS cut FROM s, z WHERE low > (z1 - m1) / (z1 - z0))"
    )
    sql["Shanbhag"] = (
        "ends AS (SELECT min(k) AS a, max(k) AS b FROM s WHERE low > 1e-12 AND 1 - low > 1e-12), b1 AS (SELECT t.k AS t, -sum(0.5 / t.low * i.p * ln(1 - 0.5 / t.low * j.low)) AS e FROM s t JOIN s i ON i.k BETWEEN 1 AND t.k JOIN s j ON j.k = i.k - 1 GROUP BY t.k), "
        "b2 AS (SELECT t.k AS t, -sum(0.5 / (1 - t.low) * i.p * ln(greatest(1 - 0.5 / (1 - t.low) * (1 - i.low), 1e-300))) AS e FROM s t JOIN s i ON i.k > t.k WHERE 1 - t.low > 1e-12 GROUP BY t.k), best AS (SELECT b1.t AS cut FROM b1 JOIN b2 USING (t), ends WHERE t BETWEEN a AND b ORDER BY round(abs(b1.e - b2.e), 12), t LIMIT 1)"
    )
    cut = lambda n: (lambda im: pointwise.with_number("threshold", im, statistics.auto_threshold_value(im, n)))
    out: dict[str, Query] = {f"autothreshold_{name.lower()}": (of(u8, cut(name)), None if s is None else bins + s + end) for name, s in sql.items()}
    value = lambda im: im.df.sparkSession.createDataFrame([(float(statistics.auto_threshold_value(im, "Percentile")),)], "v double")
    out["autothresholdvalue"] = of(u8, value), bins + sql["Percentile"] + " SELECT cut::DOUBLE AS v FROM best"
    return out


def region_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    small = lambda im: pointwise.with_number("threshold", im, 140)
    sparse = lambda im: pointwise.with_number("threshold", im, 150)
    base = f"WITH RECURSIVE {U8}, s AS MATERIALIZED (SELECT x, y, z, CASE WHEN v > 140 THEN 1 ELSE 0 END::DOUBLE AS v FROM u8), on_ AS MATERIALIZED (SELECT * FROM s WHERE v <> 0)"
    found = f"{base}, {regions_sql('on_')}"
    named = "SELECT u8.x, u8.y, u8.z, {0} AS v FROM u8 LEFT JOIN (SELECT f.x, f.y, f.z, g.* FROM f JOIN ({1}) g USING (id)) g USING (x, y, z)"
    ranks = "SELECT id, root, dense_rank() OVER (ORDER BY root) AS n, count(*) OVER (PARTITION BY root) AS size FROM r"
    out["label"] = of(u8, lambda im: regions.label(small(im))), f"{found} {named.format('coalesce(n, 0)::DOUBLE', ranks)}"
    out["regionremoval"] = of(u8, lambda im: regions.remove_small(small(im), 4)), f"{found} {named.format('CASE WHEN size >= 4 THEN 1 ELSE 0 END::DOUBLE', ranks)}"
    first = "any_value(f.x) FILTER (f.id = root) AS x, any_value(f.y) FILTER (f.id = root) AS y, any_value(f.z) FILTER (f.id = root) AS z"
    out["analyzeparticles_counts"] = of(u8, lambda im: regions.analyze_particles(small(im), ("coordinates", "volume", "bounds2d"), least=2).drop("label")), f"{found} SELECT {first}, count(*) AS volume, min(f.x) AS minx, max(f.x) AS maxx, min(f.y) AS miny, max(f.y) AS maxy FROM f JOIN r USING (id) GROUP BY root HAVING count(*) >= 2"
    out["analyzeparticles"] = of(u8, lambda im: regions.analyze_particles(small(im), tuple(analyzers.COLUMNS))), None
    start = f"{base}, p0 AS (SELECT x, y, z, v FROM s WHERE x = 0 AND y = 0 AND z = 0), w AS MATERIALIZED (SELECT s.x, s.y, s.z FROM s, p0 WHERE s.v = p0.v), {reach_sql('p0', 'w', 'n26')}"
    out["floodfill"] = of(u8, lambda im: regions.flood_fill(small(im), (0, 0, 0), 9)), f"{start} SELECT s.x, s.y, s.z, CASE WHEN t.x IS NULL THEN s.v ELSE 9 END AS v FROM s LEFT JOIN t USING (x, y, z)"
    two = f"WITH RECURSIVE {U8}, s AS MATERIALIZED (SELECT x, y, z, CASE WHEN v < 130 THEN 0 WHEN v < 170 THEN 1 ELSE 2 END::DOUBLE AS v FROM u8), hi AS MATERIALIZED (SELECT x, y, z FROM s WHERE v = 2), w AS MATERIALIZED (SELECT x, y, z FROM s WHERE v > 0), {reach_sql('hi', 'w')}"
    out["grow"] = of(u8, lambda im: regions.grow(pointwise.double_threshold(im, 130, 170), 2, 1)), f"{two} SELECT s.x, s.y, s.z, CASE WHEN t.x IS NULL THEN s.v ELSE 2 END AS v FROM s LEFT JOIN t USING (x, y, z)"
    out["dualthreshold"] = of(u8, lambda im: regions.dual_threshold(im, 130, 170)), f"{two} SELECT s.x, s.y, s.z, CASE WHEN t.x IS NULL THEN 0 ELSE 1 END::DOUBLE AS v FROM s LEFT JOIN t USING (x, y, z)"
    seeds = lambda im: im.map(F.when(pix() >= 170, 1.0).otherwise(0.0))
    masks = lambda im: im.map(F.when(pix() >= 130, 1.0).otherwise(0.0))
    out["morphorec"] = of(u8, lambda im: regions.morphological_reconstruction(seeds(im), masks(im))), f"{two.replace('FROM t, n6 n', 'FROM t, n26 n')} SELECT s.x, s.y, s.z, CASE WHEN t.x IS NULL THEN 0 ELSE 1 END::DOUBLE AS v FROM s LEFT JOIN t USING (x, y, z)"
    equal = f"WITH RECURSIVE {U8}, on_ AS MATERIALIZED (SELECT * FROM u8 WHERE v <> 0), {regions_sql('on_', 'n26')}, bad AS (SELECT DISTINCT root FROM r JOIN q USING (id) JOIN u8 b ON b.x = q.x AND b.y = q.y AND b.z = q.z WHERE b.v > q.v)"
    out["localmaxima"] = of(u8, regions.local_maxima), f"{equal} {named.format('coalesce(n, 0)::DOUBLE', 'SELECT id, dense_rank() OVER (ORDER BY root) AS n FROM r WHERE root NOT IN (SELECT root FROM bad)')}"
    held = lambda im: im.df.filter("v > 170").orderBy("z", "y", "x").limit(5).select(*AXES)
    out["fillparticles"] = of(u8, lambda im: regions.fill_particles(small(im), held(im), 7)), f"{found}, hits AS (SELECT DISTINCT root FROM (SELECT x, y, z FROM u8 WHERE v > 170 ORDER BY z, y, x LIMIT 5) JOIN f USING (x, y, z) JOIN r USING (id)) {named.format('CASE WHEN root IS NULL THEN 0 WHEN root IN (SELECT root FROM hits) THEN 7 ELSE 1 END::DOUBLE', 'SELECT id, root FROM r')}"
    out["labelmaxima"] = of(u8, lambda im: regions.label_maxima(im, sparse(im))), pixel_sql("CASE WHEN v > 150 THEN 1 ELSE v END")
    out["cleanmaxima"] = of(u8, lambda im: regions.clean_maxima(im.map(pix() / 60, "float32"), regions.label(sparse(im)))), None
    out["growlabels"] = of(u8, lambda im: regions.grow_labels(pointwise.double_threshold(im, 125, 170), 1, 0)), f"{two.replace('v < 130', 'v < 125')} SELECT s.x, s.y, s.z, CASE WHEN t.x IS NULL THEN s.v ELSE 2 END AS v FROM s LEFT JOIN t USING (x, y, z)"
    out["greedycoloring"] = of(u8, lambda im: regions.greedy_coloring(pointwise.with_number("divide", transforms.crop(im, (0, 0, 0), (8, 8, 40)), 64))), None
    sixteen = lambda im: pointwise.with_number("divide", im, 16)
    ids = "l AS (SELECT x, y, z, round(v / 16)::BIGINT AS label FROM u8)"
    out["analyzelabels_2d"] = of(u8, lambda im: analyzers.analyze(sixteen(im), ("coordinates2d", "bounds2d", "value"), 3)), f"WITH {U8}, {ids} SELECT label, first(x ORDER BY z, y, x) AS x, first(y ORDER BY z, y, x) AS y, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy, 3.0::DOUBLE AS value FROM l WHERE label <> 0 GROUP BY label"
    centres = lambda im: analyzers.analyze(sixteen(im), ("pca", "convexhull2d", "boundingsphere", "pca2d")).select("label", "cx", "cy", "cz", (F.pow("l1", 2) + F.pow("l2", 2) + F.pow("l3", 2)).alias("spread"))
    out["analyzelabels_pca"] = of(u8, centres), f"WITH {U8}, {ids} SELECT label, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, var_pop(x) + var_pop(y) + var_pop(z) AS spread FROM l WHERE label <> 0 GROUP BY label"
    balls = lambda spark: spark.createDataFrame([(9.5, 7.0, 5.0, 4.0, 4.0, 4.0, 0.3, 0.4, 1.2, 1.1, -0.7, 1.9, 1.0)], "cx double, cy double, cz double, l1 double, l2 double, l3 double, phi1 double, theta1 double, phi2 double, theta2 double, phi3 double, theta3 double, bounding_scale double")
    grid = "g AS (SELECT (i % 20)::BIGINT AS x, (i // 20 % 15)::BIGINT AS y, (i // 300)::BIGINT AS z FROM range(3000) t(i))"
    square = [(0.0, math.pi / 2), (math.pi / 2, math.pi / 2), (0.0, 0.0)]

    def straight(spark: SparkSession) -> DataFrame:
        df = balls(spark)
        for i, (phi, theta) in enumerate(square, 1):
            df = df.withColumn(f"phi{i}", F.lit(phi)).withColumn(f"theta{i}", F.lit(theta))
        return df.withColumn("l2", F.lit(2.5))

    out["drawellipsoids"] = (lambda spark, sf_dir: regions.draw_ellipsoids(new_image(spark, (20, 15, 10)), straight(spark), 6).df), f"WITH {grid} SELECT x, y, z, CASE WHEN pow((x - 9.5) / 4, 2) + pow((y - 7) / 2.5, 2) + pow((z - 5) / 4, 2) < 1 THEN 6 ELSE 0 END::DOUBLE AS v FROM g"
    return out


def shapes() -> dict[str, Query]:
    out: dict[str, Query] = {}
    blank = lambda spark: new_image(spark, (20, 15, 10), "uint8")
    grid = "g AS (SELECT (i % 20)::BIGINT AS x, (i // 20 % 15)::BIGINT AS y, (i // 300)::BIGINT AS z FROM range(3000) t(i))"
    out["draw_line"] = (lambda spark, sf_dir: generate.line(blank(spark), (1, 1, 1), (8, 8, 8), 3).df), f"WITH {grid} SELECT x, y, z, CASE WHEN x = y AND y = z AND x BETWEEN 1 AND 8 THEN 3 ELSE 0 END::DOUBLE AS v FROM g"

    def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
        vertices = spark.createDataFrame([(0, 3.0, 7.0, 5.0), (1, 16.0, 7.0, 5.0)], "id bigint, x double, y double, z double")
        edges = spark.createDataFrame([(0, 0, 1)], "id bigint, v1 bigint, v2 bigint")
        return generate.draw_graph(blank(spark), vertices, edges, 2.5, 9, 4).df

    ball = "pow(y - 7, 2) + pow(z - 5, 2) + pow(x - {}, 2) < 6.25"
    out["drawgraph"] = graph, f"WITH {grid} SELECT x, y, z, CASE WHEN {ball.format(3)} OR {ball.format(16)} THEN 9 WHEN y = 7 AND z = 5 AND x BETWEEN 3 AND 16 THEN 4 ELSE 0 END::DOUBLE AS v FROM g"
    flat = lambda im: new_image(im.df.sparkSession, (*im.dims[:2], 1), "float32").map(F.col("x") * 1.0 + F.col("y") * 0.5)
    h = "x + 0.5 * y"
    out["drawheightmap"] = of(u8, lambda im: heights.draw_height_map(im, flat(im), 3)), pixel_sql(f"CASE WHEN z = round({h}) THEN 3 ELSE v END")
    out["setbeforeheightmap"] = of(u8, lambda im: heights.set_before(im, flat(im), 3)), pixel_sql(f"CASE WHEN z < {h} THEN 3 ELSE v END")
    out["setafterheightmap"] = of(u8, lambda im: heights.set_after(im, flat(im), 3)), pixel_sql(f"CASE WHEN z > {h} THEN 3 ELSE v END")
    out["shiftz"] = of(emb, lambda im: heights.shift_z(im, flat(im))), f"WITH {EMB}, q AS (SELECT x, y, z, floor(z - ({h}))::BIGINT AS a, z - ({h}) - floor(z - ({h})) AS t FROM emb) SELECT q.x, q.y, q.z, (1 - t) * coalesce(l.v, 0) + t * coalesce(r.v, 0) AS v FROM q LEFT JOIN emb l ON l.x = q.x AND l.y = q.y AND l.z = q.a LEFT JOIN emb r ON r.x = q.x AND r.y = q.y AND r.z = q.a + 1"
    out["generictransform"] = of(u8, lambda im: transforms.generic_transform(im, im.dims, (0, 0, 0), [(1, 1, 1), (6, 6, 30)], [(2, 1, 3), (7, 6, 32)])), f"WITH {U8} SELECT a.x, a.y, a.z, coalesce(b.v, 0) AS v FROM u8 a LEFT JOIN u8 b ON b.x = a.x + 1 AND b.y = a.y AND b.z = a.z + 2"
    out["montage_border"] = of(u8, lambda im: transforms.montage(im, 3, 3, first=10, last=80, border=2, border_color=7)), f"WITH {U8}, c AS (SELECT x + (z - 10) // 7 % 3 * 10 AS x, y + (z - 10) // 7 // 3 * 10 AS y, v FROM u8 WHERE z BETWEEN 10 AND 80 AND (z - 10) % 7 = 0 AND (z - 10) // 7 < 9), g AS (SELECT (i % 28)::BIGINT AS x, (i // 28)::BIGINT AS y FROM range(784) t(i)) SELECT g.x, g.y, 0::BIGINT AS z, coalesce(c.v, 7) AS v FROM g LEFT JOIN c USING (x, y)"
    taps = " UNION ALL ".join(f"SELECT {k} AS k, {w} AS w" for k, w in ((-2, -0.0625), (-1, 0.5625), (0, 0.5625), (1, -0.0625)))
    out["translate_cubic"] = of(emb, lambda im: transforms.shift(im, (0.5, 0, 0), "Cubic")), f"WITH {EMB}, c AS ({taps}), q AS (SELECT x, y, z, x + k AS s, w FROM emb, c) SELECT q.x, q.y, q.z, sum(w * coalesce(b.v, 0)) AS v FROM q LEFT JOIN emb b ON b.x = q.s AND b.y = q.y AND b.z = q.z GROUP BY q.x, q.y, q.z"
    angle = lambda im, scale, by: im.map(pix() * scale + by, "float32")
    phi, theta = (lambda im: angle(im, 5, 0)), (lambda im: angle(transforms.flip(im, 0), 2, 1))
    turned = f"WITH {EMB}, o AS (SELECT a.x, a.y, a.z, a.v + 0.5 AS g, 5 * a.v AS p, 2 * b.v + 1 AS t FROM emb a JOIN emb b ON b.x = 7 - a.x AND b.y = a.y AND b.z = a.z)"
    alpha = "acos(abs(least(greatest((cos(p) * cos(0.4) + sin(p) * sin(0.4)) * sin(t) * sin(1.1) + cos(t) * cos(1.1), -1), 1)))"
    out["orientationdifference"] = of(emb, lambda im: structure.orientation_difference(phi(im), theta(im), 0.4, 1.1)), f"{turned} SELECT x, y, z, {alpha} AS v FROM o"

    def colour_sql(hue: str, saturation: str) -> str:
        six = f"c AS (SELECT x, y, z, {hue} * 57.2957795 AS h, {saturation} AS s, g / max(g) OVER () AS w FROM o), e AS (SELECT *, (h - 360 * floor(h / 360)) / 60 AS k FROM c), f AS (SELECT *, w * (1 - s) AS p, w * (1 - s * (k - floor(k))) AS q, w * (1 - s * (1 - (k - floor(k)))) AS t FROM e)"
        pick = lambda *names: "CASE floor(k)::INT " + " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(names[:5])) + f" ELSE {names[5]} END"
        sets = {"r": ("w", "q", "p", "p", "t", "w"), "g": ("t", "w", "w", "q", "p", "p"), "b": ("p", "p", "t", "w", "w", "q")}
        return f"{turned}, {six} SELECT x, y, z, " + ", ".join(f"({saturated(f'255 * CASE WHEN s <= 0 THEN w ELSE {pick(*n)} END')})::DOUBLE AS {c}" for c, n in sets.items()) + " FROM f"

    def three(images: tuple[Image, ...]) -> DataFrame:
        df = images[0].df.withColumnRenamed("v", "r")
        for name, im in zip("gb", images[1:], strict=True):
            df = df.join(im.df.withColumnRenamed("v", name), list(AXES))
        return df

    bright = lambda im: angle(im, 1, 0.5)
    out["mainorientationcolor"] = of(emb, lambda im: three(structure.main_orientation_color(bright(im), phi(im), theta(im), 0.4, 1.1))), colour_sql(f"2 * {alpha}", "1.0")
    out["axelssoncolor"] = of(emb, lambda im: three(structure.axelsson_color(bright(im), phi(im), theta(im)))), colour_sql("2 * p", "1 - abs(cos(t))")
    for name, f in {
        "cylindricality": structure.cylindricality, "cylinderorientation": lambda im: structure.cylinder_orientation(im)[1], "plateorientation": lambda im: structure.plate_orientation(im)[2], "meancurvature": structure.mean_curvature,
        "satofilter": lambda im: structure.sato(im, 1.0), "frangifilter": lambda im: structure.frangi(im, 1.0), "canny": lambda im: structure.canny(im, 1.0, 5, 15), "cannypart1": lambda im: structure.canny_classes(im, 1.0, 5, 15),
    }.items():
        out[name] = of(u8, f), None
    two = lambda im: pointwise.with_number("threshold", im, 110)
    line = "SELECT a.x, a.y, a.z, min(b.v + (a.{d} - b.{d}) * (a.{d} - b.{d})) AS v FROM {t} a JOIN {t} b ON {on} GROUP BY ALL"
    far = f"WITH {U8}, f AS (SELECT x, y, z, CASE WHEN v > 110 THEN 1e18 ELSE 0 END::DOUBLE AS v FROM u8), " + ", ".join(f"d{d} AS MATERIALIZED ({line.format(d=d, t=t, on=' AND '.join(f'a.{a} = b.{a}' for a in AXES if a != d))})" for d, t in (("x", "f"), ("y", "dx"), ("z", "dy")))
    inside = (
        "b AS MATERIALIZED (SELECT i - 12 AS i, j - 12 AS j, k - 12 AS k FROM range(25) a(i), range(25) c(j), range(25) e(k)), n AS (SELECT * FROM (VALUES (1, 1, 0, 0), (2, 1, 1, 0), (3, 1, 1, 1)) t(kind, u, v, w)), "
        "s AS (SELECT DISTINCT v::BIGINT AS r FROM dz WHERE v > 0), t AS MATERIALIZED (SELECT r, kind, max((i + u) * (i + u) + (j + n.v) * (j + n.v) + (k + w) * (k + w)) AS far FROM s, n JOIN b ON true WHERE i * i + j * j + k * k < r GROUP BY ALL), "
        "o AS (SELECT i - 1 AS i, j - 1 AS j, k - 1 AS k FROM range(3) a(i), range(3) c(j), range(3) e(k)), bad AS (SELECT DISTINCT a.x, a.y, a.z FROM (SELECT x, y, z, v, x + i AS cx, y + j AS cy, z + k AS cz, abs(i) + abs(j) + abs(k) AS kind FROM dz, o WHERE v > 0) a JOIN dz c ON c.x = cx AND c.y = cy AND c.z = cz JOIN t ON t.r = a.v AND t.kind = a.kind WHERE t.far < c.v)"
    )
    out["danielsson2"] = of(u8, lambda im: distance.maximal_balls(distance.squared_distance(two(im)))), f"{far}, {inside} SELECT dz.x, dz.y, dz.z, CASE WHEN bad.x IS NULL THEN dz.v ELSE 0 END AS v FROM dz LEFT JOIN bad USING (x, y, z)"
    out["inpaintn"] = of(u8, lambda im: distance.inpaint_nearest(im.map(F.when((F.col("x") + F.col("z")) % 3 == 0, 0.0).otherwise(F.greatest(pix(), F.lit(1.0)))))), None
    out["sdmap"] = of(u8, lambda im: distance.seeded_distance(pointwise.with_number("threshold", im, 200), pointwise.with_number("threshold", im, 110))), None
    return out


def registration_queries() -> dict[str, Query]:
    grid = (0.0, 7.0, 2), (0.0, 7.0, 2), (0.0, 100.0, 6)

    def shifts(spark: SparkSession) -> DataFrame:
        i = F.col("id")
        df = spark.range(24).select((i % 2).alias("i"), (i / 2).cast("bigint").alias("h"), "id").select("i", (F.col("h") % 2).alias("j"), (F.col("h") / 2).cast("bigint").alias("k"), "id")
        return df.select("i", "j", "k", (F.col("i") + 0.5).alias("sx"), (F.col("j") * 0.0).alias("sy"), (F.col("k") * 2.0).alias("sz"))

    points = lambda spark: spark.range(40).select(F.col("id").alias("point"), (F.col("id") % 8).cast("double").alias("x"), (F.col("id") / 5).alias("y"), (F.col("id") * 13.0).alias("z"))
    moved = "x + least(greatest(x / 7, 0), 1) + 0.5 AS x, y AS y, z + 2 * least(greatest(z / 100, 0), 5) AS z"
    out: dict[str, Query] = {"pointstodeformed": (lambda spark, sf_dir: registration.points_to_deformed(points(spark), shifts(spark), grid), f"WITH p AS (SELECT i AS point, (i % 8)::DOUBLE AS x, i / 5 AS y, i * 13.0::DOUBLE AS z FROM range(40) t(i)) SELECT point, {moved} FROM p")}
    whole = lambda spark: shifts(spark).select("i", "j", "k", F.lit(1.0).alias("sx"), F.lit(0.0).alias("sy"), (F.col("k") * 0 + 2.5).alias("sz"))
    out["pullback"] = of(emb, lambda im: registration.pull_back(im, whole(im.df.sparkSession), grid)), f"WITH {EMB} SELECT a.x, a.y, a.z, 0.5 * coalesce(b.v, 0) + 0.5 * coalesce(c.v, 0) AS v FROM emb a LEFT JOIN emb b ON b.x = a.x + 1 AND b.y = a.y AND b.z = a.z + 2 LEFT JOIN emb c ON c.x = a.x + 1 AND c.y = a.y AND c.z = a.z + 3"
    wild = lambda spark: spark.range(60).select((F.col("id") % 5).alias("i"), ((F.col("id") / 5).cast("bigint") % 4).alias("j"), (F.col("id") / 20).cast("bigint").alias("k"), F.when(F.col("id") % 17 == 3, 50.0).otherwise(F.col("id") % 3 * 1.0).alias("sx"), F.lit(0.0).alias("sy"), F.lit(1.0).alias("sz"))
    grid_sql = "g AS (SELECT i % 5 AS i, i // 5 % 4 AS j, i // 20 AS k, CASE WHEN i % 17 = 3 THEN 50.0 ELSE i % 3 END::DOUBLE AS sx, 0.0::DOUBLE AS sy, 1.0::DOUBLE AS sz FROM range(60) t(i)), m AS (SELECT a.i, a.j, a.k, median(b.sx) AS m FROM g a JOIN g b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1 GROUP BY ALL)"
    out["filterdisplacements"] = (lambda spark, sf_dir: registration.filter_displacements(wild(spark), 1, 3)), f"WITH {grid_sql} SELECT i, j, k, CASE WHEN abs(sx - m) <= 3 THEN sx END AS sx, CASE WHEN abs(sx - m) <= 3 THEN sy END AS sy, CASE WHEN abs(sx - m) <= 3 THEN sz END AS sz FROM g JOIN m USING (i, j, k)"
    shifted = lambda im: transforms.translate(im, (1, 0, -2))
    middle = lambda spark: spark.range(20).select(F.col("id").alias("point"), F.lit(4).cast("bigint").alias("x"), F.lit(4).cast("bigint").alias("y"), (F.col("id") * 20 + 20).alias("z"))
    match = lambda im: registration.block_match(im, shifted(im), middle(im.df.sparkSession), (2, 1, 3), (2, 2, 2)).select("point", "sx", "sy", "sz")
    out["blockmatch"] = of(emb, match), "SELECT i AS point, 1 AS sx, 0 AS sy, -2 AS sz FROM range(20) t(i)"
    around = "d AS (SELECT max(z) AS m FROM u8), o AS (SELECT i - 1 AS i, j - 1 AS j FROM range(3) a(i), range(3) b(j)), q AS MATERIALIZED (SELECT x, y, z, v, least(greatest(x + i, 0), 7) AS cx, least(greatest(y + j, 0), 7) AS cy FROM u8, o), p AS MATERIALIZED (SELECT q.x, q.y, q.z, any_value(q.v) AS v, median(b.v) AS m FROM q JOIN u8 b ON b.x = cx AND b.y = cy AND b.z = q.z GROUP BY ALL)"
    out["deadpixelremoval"] = of(u8, lambda im: tomography.remove_dead_pixels(im, 1, 3)), f"WITH {U8}, {around} SELECT x, y, z, CASE WHEN abs(v - m) > 3 * stddev_samp(abs(v - m)) OVER (PARTITION BY z) THEN m ELSE v END AS v FROM p"
    out["createfbpfilter"] = (lambda spark, sf_dir: tomography.create_filter(spark, 64, "Ideal ramp").df), "SELECT i::BIGINT AS x, 0::BIGINT AS y, 0::BIGINT AS z, i / 63.0::DOUBLE AS v FROM range(64) t(i)"
    out["createfbpfilter_hann"] = (lambda spark, sf_dir: tomography.create_filter(spark, 64, "Hann", 0.8).df), None
    return out


def skeleton_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    body = lambda im: pointwise.with_number("threshold", transforms.crop(im, (0, 0, 0), (8, 8, 60)), 115)
    for name, f in {"linethin": skeletons.line_thin, "surfacethin": skeletons.surface_thin, "lineskeleton": skeletons.line_skeleton, "surfaceskeleton": skeletons.surface_skeleton}.items():
        out[name] = of(u8, lambda im, f=f: f(body(im))), None
    thin = lambda im: pointwise.with_number("threshold", im, 150)
    near = (
        f"WITH {U8}, {OFFSETS}, s AS MATERIALIZED (SELECT x, y, z FROM u8 WHERE v > 150), q AS (SELECT x, y, z, i, j, k, x + i AS cx, y + j AS cy, z + k AS cz FROM s, n26), n AS MATERIALIZED (SELECT q.x, q.y, q.z, i, j, k FROM q JOIN s b ON b.x = cx AND b.y = cy AND b.z = cz), "
        "c AS (SELECT x, y, z, count(*) AS n, max(i) - min(i) <= 1 AND max(j) - min(j) <= 1 AND max(k) - min(k) <= 1 AS touch FROM n GROUP BY ALL), a AS MATERIALIZED (SELECT s.x, s.y, s.z, CASE WHEN n = 1 THEN 2 WHEN n = 2 AND NOT touch THEN 3 ELSE 5 END AS kind FROM s LEFT JOIN c USING (x, y, z)), "
        "beside AS (SELECT DISTINCT n.x, n.y, n.z FROM n JOIN a ON a.x = n.x + i AND a.y = n.y + j AND a.z = n.z + k WHERE a.kind IN (2, 3))"
    )
    out["classifyskeleton"] = of(u8, lambda im: skeletons.classify_skeleton(thin(im))), f"{near} SELECT u8.x, u8.y, u8.z, coalesce(CASE WHEN a.kind = 5 AND beside.x IS NOT NULL THEN 4 ELSE a.kind END, 0)::DOUBLE AS v FROM u8 LEFT JOIN a USING (x, y, z) LEFT JOIN beside USING (x, y, z)"
    out["tracelineskeleton"] = of(u8, lambda im: skeletons.trace_skeleton(skeletons.line_skeleton(body(im)))[1]), None
    out["fillskeleton"] = of(u8, lambda im: (lambda s: skeletons.fill_skeleton(s, skeletons.trace_skeleton(s)[1]))(skeletons.line_skeleton(body(im)))), None

    def net(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        vertices = spark.range(30).select("id", *[(F.col("id") * k % 10).cast("double").alias(a) for a, k in zip(AXES, (3, 7, 9), strict=True)])
        edges = spark.range(26).select("id", (F.col("id") * 7 % 29).alias("v1"), (F.col("id") * 11 % 27).alias("v2"), F.lit(1).cast("bigint").alias("points"), (F.col("id") % 5 + 1).cast("double").alias("length"))
        return vertices, edges

    base = "v AS (SELECT i AS id FROM range(30) t(i)), e AS (SELECT i AS id, i * 7 % 29 AS v1, i * 11 % 27 AS v2, 1::BIGINT AS points, (i % 5 + 1)::DOUBLE AS length FROM range(26) t(i))"
    degree = "ends AS (SELECT id, v1 AS v FROM e UNION ALL SELECT id, v2 FROM e), deg AS (SELECT v.id, count(ends.v) AS degree FROM v LEFT JOIN ends ON ends.v = v.id GROUP BY v.id)"
    out["network_degrees"] = (lambda spark, sf_dir: skeletons.degrees(*net(spark))), f"WITH {base}, {degree} SELECT id, degree FROM deg"
    out["pruneskeleton"] = (lambda spark, sf_dir: skeletons.prune_network(*net(spark), 3, False, True)[1]), f"WITH {base}, {degree}, leaf AS (SELECT id FROM deg WHERE degree = 1) SELECT * FROM e WHERE NOT (length < 3 AND v1 <> v2 AND (v1 IN (SELECT id FROM leaf) OR v2 IN (SELECT id FROM leaf)))"
    out["removeedges"] = (lambda spark, sf_dir: (lambda v, e: skeletons.remove_edges(v, e, e.filter("id % 4 = 0"), False, True)[1])(*net(spark))), f"WITH {base} SELECT * FROM e WHERE id % 4 <> 0"
    through = (
        f"WITH RECURSIVE {base}, {degree}, mid AS (SELECT id FROM deg WHERE degree = 2 AND id NOT IN (SELECT v1 FROM e WHERE v1 = v2)), link AS (SELECT a.id AS a, b.id AS b FROM ends a JOIN ends b ON a.v = b.v JOIN mid ON mid.id = a.v), "
        "t(id, other) AS (SELECT id, id FROM e UNION SELECT t.id, b FROM t JOIN link ON link.a = t.other), r AS (SELECT id, min(other) AS label FROM t GROUP BY id), "
        "sums AS (SELECT label, sum(points)::BIGINT AS points, sum(length) AS length FROM e JOIN r USING (id) GROUP BY label), o AS (SELECT label, min(v) FILTER (v NOT IN (SELECT id FROM mid)) AS v1, max(v) FILTER (v NOT IN (SELECT id FROM mid)) AS v2, min(v) AS v0 FROM ends JOIN r USING (id) GROUP BY label)"
    )
    out["cleanskeleton"] = (lambda spark, sf_dir: skeletons.clean_network(*net(spark))[1]), f"{through} SELECT label AS id, coalesce(v1, v0) AS v1, coalesce(v2, v0) AS v2, points, length FROM sums JOIN o USING (label)"
    out["getpointsandlines"] = (lambda spark, sf_dir: skeletons.points_and_lines(net(spark)[0].filter("id % 3 <> 2"), net(spark)[1])[1].select("line", F.get("points", F.lit(0)).alias("a"), F.get("points", F.lit(1)).alias("b"))), f"WITH {base}, p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM v WHERE id % 3 <> 2) SELECT e.id AS line, a.n AS a, b.n AS b FROM e JOIN p a ON a.id = v1 JOIN p b ON b.id = v2"
    return out


def _files(im: Image, write: Callable[[Image, str], object], read: Callable[[SparkSession, str], Image]) -> Image:
    """What is read back of an image written under the shared folder, as a table, so that the files may go."""
    spark = im.df.sparkSession
    folder = f"{shared_folder(spark).removeprefix('file://')}/files-{uuid.uuid4().hex}"
    os.makedirs(folder, exist_ok=True)
    path = write(im, folder)
    back = read(spark, path if isinstance(path, str) else folder)
    out = Image(kept(back.df), back.dims, back.dtype)
    shutil.rmtree(folder)
    return out


def file_queries() -> dict[str, Query]:
    def named(f: Callable, name: str) -> Callable[[Image, str], str]:
        def run(im: Image, folder: str) -> str:
            f(im, f"{folder}/{name}")
            return f"{folder}/{name}"

        return run

    def vol(im: Image, folder: str) -> str:
        path = f"{folder}/a.vol"
        head = f"X: {im.dims[0]}\nY: {im.dims[1]}\nZ: {im.dims[2]}\nVoxel-Size: 1\nInt-Endian: 0123\n.\n".encode()
        raw.put_lines(im, path, len(head) + im.count, len(head))
        with open(path, "r+b") as f:
            f.write(head)
        return path

    def block(im: Image, folder: str) -> str:
        path = f"{folder}/b_8x8x{im.dims[2]}.raw"
        volumes.write_raw_block(transforms.crop(im, (2, 1, 3), (4, 5, 6)), path, (2, 1, 3))
        return path

    whole = pixel_sql("v")
    raw_file = lambda im, folder: raw.write_raw(im, f"{folder}/a")
    box = f"WITH {U8} SELECT x - 1 AS x, y - 2 AS y, z - 10 AS z, v FROM u8 WHERE x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 5 AND z BETWEEN 10 AND 109"
    at = (1, 2, 10), (5, 4, 100)
    pairs = {
        "file_raw": (raw_file, volumes.read_image, whole), "file_readraw": (raw_file, lambda s, p: raw.read_raw(s, p, "uint8"), whole), "file_readrawblock": (raw_file, lambda s, p: volumes.read_block(s, p, *at), box),
        "file_nrrd": (named(files.write_nrrd, "a.nrrd"), volumes.read_image, whole), "file_tif": (named(volumes.write_tiff, "a.tif"), volumes.read_image, whole), "file_vol": (vol, volumes.read_image, whole),
        "file_readblock": (named(volumes.write_tiff, "a.tif"), lambda s, p: volumes.read_block(s, p, *at), box),
        "file_zarr": (named(volumes.write_zarr, "a.zarr"), volumes.read_image, whole), "file_zarrblock": (named(lambda im, p: volumes.write_zarr(im, p, (4, 8, 32), False), "a.zarr"), lambda s, p: volumes.read_block(s, p, *at), box),
        "file_sequence": (lambda im, folder: [files.write_sequence(im, folder).count(), f"{folder}/*.png"][1], files.read_sequence, whole),
        "file_sequenceblock": (lambda im, folder: [files.write_sequence(im, folder).count(), f"{folder}/*.png"][1], lambda s, p: volumes.read_block(s, p, *at), box),
        "file_writerawblock": (block, lambda s, p: raw.read_raw(s, p, "uint8"), pixel_sql("CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 5 AND z BETWEEN 3 AND 8 THEN v ELSE 0 END")),
    }
    out: dict[str, Query] = {name: (of(u8, lambda im, w=w, r=r: _files(im, w, r)), sql) for name, (w, r, sql) in pairs.items()}
    one = lambda im: transforms.crop(im, (0, 0, 7), (8, 8, 1))
    out["file_png"] = of(u8, lambda im: _files(one(im), named(files.write_png, "a.png"), volumes.read_image)), f"WITH {U8} SELECT x, y, 0::BIGINT AS z, v FROM u8 WHERE z = 7"
    return out


def session_queries() -> dict[str, Query]:
    def scripted(script: str, result: Callable[[Session], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            s = Session(spark)
            s.images["a"] = u8(spark, sf_dir)
            s.tables["points"] = spark.range(8).select(F.col("id").alias("x"), F.col("id").alias("y"), F.col("id").alias("z"), F.col("id").cast("double").alias("v"))
            s.run(script)
            return result(s)

        return run

    image = lambda name: (lambda s: s.images[name].df)
    out: dict[str, Query] = {
        "cmd_set_number": (scripted("set(a, 7)", image("a")), pixel_sql("7")),
        "cmd_set_pixel": (scripted("set(a, [1, 2, 3], 9)", image("a")), pixel_sql("CASE WHEN x = 1 AND y = 2 AND z = 3 THEN 9 ELSE v END")),
        "cmd_set_points": (scripted("set(a, points)", image("a")), pixel_sql("CASE WHEN x = y AND y = z THEN x ELSE v END")),
        "cmd_set_image": (scripted("newlike(b, a, int16)\nset(b, a)\nadd(b, 1000)", image("b")), pixel_sql("v + 1000")),
        "cmd_newlike": (scripted("newlike(b, a, uint16, 3, 0, 5)", image("b")), "SELECT (i % 3)::BIGINT AS x, (i // 3 % 8)::BIGINT AS y, (i // 24)::BIGINT AS z, 0.0::DOUBLE AS v FROM range(120) t(i)"),
        "cmd_ensuresize": (scripted("ensuresize(a, 2, 2, 2)", image("a")), "SELECT (i % 2)::BIGINT AS x, (i // 2 % 2)::BIGINT AS y, (i // 4)::BIGINT AS z, 0.0::DOUBLE AS v FROM range(8) t(i)"),
        "cmd_clear": (scripted("newlike(b, a)\nclear(b)\nadd(a, 1)", lambda s: s.images["a"].df if "b" not in s.images else s.images["b"].df), pixel_sql(saturated("v + 1"))),
        "cmd_nop": (scripted("nop(a)", image("a")), pixel_sql("v")),
        "cmd_prepare": (scripted("prepareanalyzeparticles(a, 5)", image("a")), pixel_sql("CASE WHEN v <> 0 THEN 5 ELSE 0 END")),
    }
    values = lambda *names: (lambda s: _values(s.spark, {n: s.values.get(n, "-") for n in names}))
    said = lambda s: _values(s.spark, dict(enumerate(s.output)))
    meta = 'setmeta(a, unit, mm)\nsetmeta(a, unit, um, 2, 1)\nsetmeta(a, made, "2020 CE")\ncopymeta(a, b)\ngetmeta(b, unit, u, 2, 1)\ngetmeta(a, none, d, 0, 0, x)\ngetmeta(a, unit, w, -1)\nlistmeta(a, n)\nmetarowcount(a, unit, r)\nmetacolumncount(a, unit, 1, c)\nclearmeta(a)\nlistmeta(a, e)'
    whole = {"u": "um", "d": "x", "w": "mm\n, , um", "n": "unit, made", "r": 2, "c": 3, "e": ""}
    texts: dict[str, tuple[str, Callable, dict[str, object]]] = {
        "cmd_meta": (meta, values(*whole), whole),
        "cmd_newvalue": ("newvalue(i, int, 5)\nnewvalue(r, real, 2)\nnewvalue(b, bool, true)\nnewvalue(t)\nset(t, hello)\nset(i, 7)", values("i", "r", "b", "t"), {"i": 7, "r": 2.0, "b": True, "t": "hello"}),
        "cmd_headers": ('headers("volume, coordinates", h)', values("h"), {"h": "volume, x, y, z"}),
        "cmd_listanalyzers": ("listanalyzers()", said, {0: ", ".join(analyzers.COLUMNS)}),
        "cmd_help": ("help(morphorec)", lambda s: _values(s.spark, {0: s.output[0].split(":")[0]}), {0: "morphorec"}),
        "cmd_print": ("print(one)\nhello(you)\nhello()", said, {0: "one", 1: "Hello you!", 2: "Hello there!"}),
        "cmd_submitjob": ('submitjob("newvalue(q, int, 3)")\nwaitforjobs()', values("q"), {"q": 3}),
        "cmd_list": ("newimage(b, uint16, 4, 5)\nclear(a)\nnewvalue(k, int, 1)\nlist()", said, {0: "b, 4 x 5 x 1, uint16", 1: "k = 1"}),
        "cmd_settings": ("distribute(slurm)\ndelaying(false)\nmaxmemory(1000)\nmaxjobs(5)\nchunksize([8, 8, 8])\nprintscripts(true)\ngetmaxmemory(m)", lambda s: _values(s.spark, {k: s.options[k] for k in ("distribute", "delaying", "maxjobs", "chunksize", "printscripts")} | {"m": s.values["m"]}), {"distribute": "slurm", "delaying": False, "maxjobs": 5, "chunksize": (8, 8, 8), "printscripts": True, "m": 1000.0}),
        "cmd_timing": ("add(a, 1)\nresettiming()\nadd(a, 1)\nadd(a, 2)\ntiming()", lambda s: _values(s.spark, {0: s.output[0].split(",")[0]}), {0: "add: 2 times"}),
        "cmd_echo": ("echo(true)\nadd(a, 1)", said, {0: "add(a, 1)"}),
    }
    for name, (script, result, found) in texts.items():
        out[name] = scripted(script, result), _values_sql(found).replace("\n", "' || chr(10) || '")

    def info(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = f"{shared_folder(spark).removeprefix('file://')}/info-{uuid.uuid4().hex}"
        os.makedirs(folder)
        s = Session(spark)
        s.run(f'newimage(b, uint16, 4, 5, 3)\nwriteraw(b, "{folder}/b")\nwritetif(b, "{folder}/b.tif")\nfileinfo("{folder}/b_4x5x3.raw", i)\nrawinfo("{folder}/b_4x5x3.raw")\nfileinfo("{folder}/b.tif")\nisimagefile("{folder}/none_1x1x1.raw", n)\nisimagefile("{folder}/b.tif", y)')
        s.run(f'newlikefile(c, "{folder}/b.tif")\nread(d, "{folder}/b.tif")\ngetmapfile(d, f)\nsetmeta(c, k, v)\nwritemeta(c, "{folder}/m.json")\nclearmeta(c)\nreadmeta(c, "{folder}/m.json")\ngetmeta(c, k, g)')
        numbers = [int(r.v) for r in s.images["i"].df.orderBy("x").collect()]
        out = {"size": numbers, "raw": s.output[0], "tif": s.output[1], "none": s.values["n"], "yes": s.values["y"], "like": s.images["c"].dims, "from": s.values["f"].rpartition("/")[2], "meta": s.values["g"]}
        shutil.rmtree(folder)
        return _values(spark, out)

    out["cmd_fileinfo"] = info, _values_sql({"size": [4, 5, 3, 2], "raw": "4 x 5 x 3, uint16", "tif": "4 x 5 x 3, uint16", "none": False, "yes": True, "like": (4, 5, 3), "from": "b.tif", "meta": "v"})
    return out
