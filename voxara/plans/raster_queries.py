"""Queries of the raster operators over a volume made of the embeddings table, each with its DuckDB SQL (see volume.py)."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxara.operators import analyzers, distance, generate, neighbourhood, pointwise, regions, statistics, transforms
from voxara.plans import more_queries, scan_queries, stitch_queries, surface_queries
from voxara.plans.volume import AROUND, EMB, U8, Query, emb, of, pixel_sql, saturated, u8
from voxara.raster import AXES, new_image, pix


def table() -> dict[str, Query]:
    out: dict[str, Query] = {}
    real = {
        "abs": "abs(v)", "negate": "-v", "exponentiate": "exp(v)", "square": "v * v", "squareroot": "CASE WHEN v < 0 THEN 'nan'::DOUBLE ELSE sqrt(greatest(v, 0)) END",
        "log": "CASE WHEN v = 0 THEN '-inf'::DOUBLE WHEN v < 0 THEN 'nan'::DOUBLE ELSE ln(abs(v)) END", "log10": "CASE WHEN v = 0 THEN '-inf'::DOUBLE WHEN v < 0 THEN 'nan'::DOUBLE ELSE log10(abs(v)) END",
        "sin": "sin(v)", "cos": "cos(v)", "tan": "tan(v)", "inv": "CASE WHEN v = 0 THEN 'nan'::DOUBLE ELSE 1 / v END", "round": "round(v)", "ceil": "ceil(v)", "floor": "floor(v)",
    }
    for name, sql in real.items():
        out[f"px_{name}"] = of(emb, lambda im, n=name: pointwise.unary(n, im)), f"WITH {EMB} SELECT x, y, z, ({sql})::DOUBLE AS v FROM emb"
    numbers = {
        "add": (100, saturated("v + 100")), "subtract": (100, saturated("v - 100")), "invsubtract": (100, saturated("100 - v")), "multiply": (2, saturated("v * 2")), "divide": (4, saturated("v / 4")),
        "max": (128, "greatest(v, 128)"), "min": (128, "least(v, 128)"), "threshold": (128, "CASE WHEN v > 128 THEN 1 ELSE 0 END"),
    }
    for name, (x, sql) in numbers.items():
        out[f"px_{name}_number"] = of(u8, lambda im, n=name, x=x: pointwise.with_number(n, im, x)), pixel_sql(sql)
    second = "b AS (SELECT 7 - x AS x, y, z, v AS w FROM u8)"
    images = {
        "add": saturated("v + w"), "subtract": saturated("v - w"), "invsubtract": saturated("w - v"), "multiply": saturated("v * w"), "divide": "CASE WHEN w = 0 THEN CASE WHEN v > 0 THEN 255 ELSE 0 END ELSE trunc(v / w) END",
        "max": "greatest(v, w)", "min": "least(v, w)", "threshold": "CASE WHEN v > w THEN 1 ELSE 0 END",
    }
    for name, sql in images.items():
        out[f"px_{name}_image"] = of(u8, lambda im, n=name: pointwise.with_image(n, im, transforms.flip(im, 0))), f"WITH {U8}, {second} SELECT x, y, z, ({sql})::DOUBLE AS v FROM u8 JOIN b USING (x, y, z)"
    out["px_add_broadcast"] = (
        of(u8, lambda im: pointwise.with_image("add", im, transforms.crop(im, (0, 0, 0), (8, 8, 1)), True)),
        f"WITH {U8}, b AS (SELECT x, y, v AS w FROM u8 WHERE z = 0) SELECT x, y, z, ({saturated('v + w')})::DOUBLE AS v FROM u8 JOIN b USING (x, y)",
    )
    out["px_thresholdrange"] = of(u8, lambda im: pointwise.threshold_range(im, 100, 150)), pixel_sql("CASE WHEN v > 100 AND v <= 150 THEN 1 ELSE 0 END")
    out["px_thresholdperiodic"] = of(u8, lambda im: pointwise.threshold_periodic(im, 0, 256, 200, 300)), pixel_sql("CASE WHEN v > 200 OR v <= 44 THEN 1 ELSE 0 END")
    out["px_doublethreshold"] = of(u8, lambda im: pointwise.double_threshold(im, 100, 150)), pixel_sql("CASE WHEN v < 100 THEN 0 WHEN v < 150 THEN 1 ELSE 2 END")
    out["px_linmap"] = of(u8, lambda im: pointwise.linmap(im, 50, 200, 0, 255)), pixel_sql(saturated("(v - 50) / 150 * 255"))
    out["px_replace"] = of(u8, lambda im: pointwise.replace_value(im, 128, 7)), pixel_sql("CASE WHEN v = 128 THEN 7 ELSE v END")
    out["px_clamp"] = of(u8, lambda im: pointwise.clamp(im, 100, 150)), pixel_sql("least(greatest(v, 100), 150)")
    out["px_ensurefinite"] = of(emb, lambda im: pointwise.ensure_finite(pointwise.unary("log", im), -1)), f"WITH {EMB} SELECT x, y, z, CASE WHEN v <= 0 THEN -1 ELSE ln(abs(v) + CASE WHEN v = 0 THEN 1 ELSE 0 END) END::DOUBLE AS v FROM emb"
    out["px_convert"] = of(emb, lambda im: pointwise.convert(pointwise.with_number("multiply", im, 300), "int8")), f"WITH {EMB} SELECT x, y, z, ({saturated('v * 300', -128, 127)})::DOUBLE AS v FROM emb"
    out["px_swapbyteorder"] = of(u8, lambda im: pointwise.swap_byte_order(pointwise.convert(im, "uint16"))), pixel_sql("v * 256")
    out["px_eval"] = of(u8, lambda im: pointwise.evaluate("x0 / 2 + x1 / 4 + z % 3", im, transforms.flip(im, 0))), f"WITH {U8}, {second} SELECT x, y, z, ({saturated('v / 2 + w / 4 + z % 3')})::DOUBLE AS v FROM u8 JOIN b USING (x, y, z)"
    out["px_complex"] = (
        of(emb, lambda im: pointwise.complex_unary("normalize", im.df.select(*AXES, pix().alias("re"), (pix() * pix() + 1).alias("im")))),
        f"WITH {EMB} SELECT x, y, z, v / sqrt(v * v + (v * v + 1) * (v * v + 1)) AS re, (v * v + 1) / sqrt(v * v + (v * v + 1) * (v * v + 1)) AS im FROM emb",
    )

    grid = "g AS (SELECT (i % 20)::BIGINT AS x, (i // 20 % 15)::BIGINT AS y, (i // 300)::BIGINT AS z FROM range(3000) t(i))"
    blank = lambda spark: new_image(spark, (20, 15, 10), "uint8")
    drawn = {
        "newimage": (lambda im: im, "0"), "ramp": (lambda im: generate.ramp(im, 1), "y"), "ramp3": (generate.ramp3, "x + y + z"),
        "setedges": (lambda im: generate.set_edges(im, 9, 2), "CASE WHEN x < 2 OR x >= 18 OR y < 2 OR y >= 13 OR z < 2 OR z >= 8 THEN 9 ELSE 0 END"),
        "box": (lambda im: generate.box(im, (3, 4, 2), (5, 6, 3), 7), "CASE WHEN x >= 3 AND x < 8 AND y >= 4 AND y < 10 AND z >= 2 AND z < 5 THEN 7 ELSE 0 END"),
        "sphere": (lambda im: generate.sphere(im, (9.5, 7, 5), 4, 3), "CASE WHEN (x - 9.5) * (x - 9.5) + (y - 7) * (y - 7) + (z - 5) * (z - 5) < 16 THEN 3 ELSE 0 END"),
        "ellipsoid": (lambda im: generate.ellipsoid(im, (9.5, 7, 5), (8, 4, 2), 3), "CASE WHEN pow((x - 9.5) / 8, 2) + pow((y - 7) / 4, 2) + pow((z - 5) / 2, 2) < 1 THEN 3 ELSE 0 END"),
        "capsule": (lambda im: generate.capsule(im, (4, 7, 5), (14, 7, 5), 3.1, 2), "CASE WHEN pow(x - least(greatest(x, 4), 14), 2) + pow(y - 7, 2) + pow(z - 5, 2) < 9.61 THEN 2 ELSE 0 END"),
    }
    for name, (f, sql) in drawn.items():
        out[f"draw_{name}"] = (lambda spark, sf_dir, f=f: f(blank(spark)).df), f"WITH {grid} SELECT x, y, z, ({sql})::DOUBLE AS v FROM g"
    out["draw_noise"] = (lambda spark, sf_dir: generate.noise(new_image(spark, (20, 15, 10), "float32"), 1, 2, 3).df), None

    stats = "sum(v) AS sum, sum(v * v) AS squaresum, min(v) AS minval, max(v) AS maxval, avg(v) AS mean, stddev_samp(v) AS stddev"
    out["stat_all"] = of(u8, statistics.statistics), f"WITH {U8} SELECT {stats} FROM u8"
    one = {"sum": "sum(v)", "squaresum": "sum(v * v)", "minval": "min(v)", "maxval": "max(v)", "mean": "avg(v)", "stddev": "stddev_samp(v)"}
    for name, sql in one.items():
        out[f"stat_{name}"] = of(u8, lambda im, n=name: statistics.statistic(n, im)), f"WITH {U8} SELECT ({sql})::DOUBLE AS v FROM u8"
    out["stat_maskedmean"] = of(u8, lambda im: statistics.masked_mean(im, 128)), f"WITH {U8} SELECT avg(v) FILTER (v <> 128) AS v FROM u8"
    for name, kind in statistics.PROJECTIONS.items():
        for d, (a, b) in enumerate((("y", "z"), ("x", "z"), ("x", "y"))):
            out[f"{name}_{AXES[d]}"] = of(u8, lambda im, n=name, d=d: statistics.project(n, im, d)), f"WITH {U8} SELECT {a} AS x, {b} AS y, 0::BIGINT AS z, ({one[kind]})::DOUBLE AS v FROM u8 GROUP BY {a}, {b}"
    for name, order in (("minproject", "v"), ("maxproject", "v DESC")):
        out[f"{name}_values"] = of(u8, lambda im, n=name: statistics.project_values(n, im, generate.ramp(im.with_rows(im.df, dtype="float32"), 2), 2)), f"WITH {U8} SELECT x, y, 0::BIGINT AS z, first(z ORDER BY {order}, z)::DOUBLE AS v FROM u8 GROUP BY x, y"
    bin_ = "least(greatest(floor(v / 256 * 16), 0), 15)::BIGINT"
    every = "LEFT JOIN c USING (bin)"
    out["hist"] = of(u8, lambda im: statistics.histogram(im, 0, 256, 16)), f"WITH {U8}, c AS (SELECT {bin_} AS bin, count(*)::DOUBLE AS n FROM u8 GROUP BY 1), r AS (SELECT range AS bin FROM range(16)) SELECT bin, bin * 16.0::DOUBLE AS bin_start, coalesce(n, 0)::DOUBLE AS n FROM r {every}"
    out["whist"] = of(u8, lambda im: statistics.histogram(im, 0, 256, 16, transforms.flip(im, 0))), f"WITH {U8}, {second}, c AS (SELECT {bin_} AS bin, sum(w)::DOUBLE AS n FROM u8 JOIN b USING (x, y, z) GROUP BY 1), r AS (SELECT range AS bin FROM range(16)) SELECT bin, bin * 16.0::DOUBLE AS bin_start, coalesce(n, 0)::DOUBLE AS n FROM r {every}"
    pair = f"{bin_} AS bin_a, {bin_.replace('v /', 'w /')} AS bin_b"
    out["hist2"] = of(u8, lambda im: statistics.histogram2(im, 0, 256, 16, transforms.flip(im, 0), 0, 256, 16)), f"WITH {U8}, {second} SELECT {pair}, count(*)::DOUBLE AS n FROM u8 JOIN b USING (x, y, z) GROUP BY ALL"
    out["whist2"] = of(u8, lambda im: statistics.histogram2(im, 0, 256, 16, transforms.flip(im, 0), 0, 256, 16, im)), f"WITH {U8}, {second} SELECT {pair}, sum(v)::DOUBLE AS n FROM u8 JOIN b USING (x, y, z) GROUP BY ALL"
    for kind, sql in (("mean", "avg(v)"), ("sum", "sum(v)"), ("min", "min(v)"), ("max", "max(v)")):
        out[f"bin_{kind}"] = of(u8, lambda im, k=kind: statistics.bin_image(im, (2, 2, 2), k)), f"WITH {U8}, m AS (SELECT max(z) + 1 AS d FROM u8) SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, ({saturated(sql)})::DOUBLE AS v FROM u8, m WHERE z // 2 < d // 2 GROUP BY ALL"
    out["maskedbin"] = of(u8, lambda im: statistics.masked_bin(im, 2, 128, 5)), f"WITH {U8}, m AS (SELECT max(z) + 1 AS d FROM u8) SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, ({saturated('coalesce(avg(v) FILTER (v <> 128), 5)')})::DOUBLE AS v FROM u8, m WHERE z // 2 < d // 2 GROUP BY ALL"
    out["normalizez"] = of(emb, lambda im: statistics.normalize_z(im)), f"WITH {EMB} SELECT x, y, z, v + (SELECT avg(v) FROM emb) - avg(v) OVER (PARTITION BY z) AS v FROM emb"
    out["autothreshold_otsu"] = of(u8, lambda im: pointwise.with_number("threshold", im, statistics.auto_threshold_value(im))), (
        f"WITH {U8}, h AS (SELECT v, count(*)::DOUBLE AS n FROM u8 GROUP BY v), c AS (SELECT v, sum(n) OVER w AS w, sum(n * v) OVER w AS m, sum(n) OVER () AS t, sum(n * v) OVER () AS s FROM h WINDOW w AS (ORDER BY v)), "
        "best AS (SELECT v AS cut FROM c WHERE w < t ORDER BY w * (t - w) * pow(m / w - (s - m) / (t - w), 2) DESC, v LIMIT 1) SELECT x, y, z, CASE WHEN v > cut THEN 1 ELSE 0 END::DOUBLE AS v FROM u8, best"
    )

    out["crop"] = of(u8, lambda im: transforms.crop(im, (1, 2, 10), (5, 4, 100))), f"WITH {U8} SELECT x - 1 AS x, y - 2 AS y, z - 10 AS z, v FROM u8 WHERE x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 5 AND z BETWEEN 10 AND 109"
    last = "(SELECT max(z) FROM u8)"
    moves = {
        "flip_x": (lambda im: transforms.flip(im, 0), "7 - x", "y", "z"), "flip_z": (lambda im: transforms.flip(im, 2), "x", "y", f"{last} - z"),
        "rot90cw": (transforms.rotate_cw, "7 - y", "x", "z"), "rot90ccw": (transforms.rotate_ccw, "y", "7 - x", "z"),
        "reslice_top": (lambda im: transforms.reslice(im, "top"), "x", "z", "y"), "reslice_left": (lambda im: transforms.reslice(im, "left"), "z", "y", "x"),
    }
    for name, (f, *sql) in moves.items():
        out[name] = of(u8, f), f"WITH {U8} SELECT {sql[0]} AS x, {sql[1]} AS y, {sql[2]} AS z, v FROM u8"
    out["translate"] = of(u8, lambda im: transforms.translate(im, (2, 1, -3))), f"WITH {U8} SELECT a.x, a.y, a.z, coalesce(b.v, 0) AS v FROM u8 a LEFT JOIN u8 b ON a.x = b.x + 2 AND a.y = b.y + 1 AND a.z = b.z - 3"
    out["scalelabels"] = of(u8, lambda im: transforms.scale_nearest(im, (2, 1, 2))), f"WITH {U8} SELECT x * 2 + i AS x, y, z * 2 + j AS z, v FROM u8, range(2) t(i), range(2) s(j)"
    out["copy_into"] = of(u8, lambda im: transforms.copy_into(transforms.crop(im, (0, 0, 0), (2, 2, 2)), im, (3, 3, 3))), f"WITH {U8} SELECT a.x, a.y, a.z, coalesce(b.v, a.v) AS v FROM u8 a LEFT JOIN u8 b ON a.x = b.x + 3 AND a.y = b.y + 3 AND a.z = b.z + 3 AND b.x < 2 AND b.y < 2 AND b.z < 2"
    out["montage"] = of(u8, lambda im: transforms.montage(im, 5, 4, first=2, step=3)), f"WITH {U8} SELECT x + (z - 2) // 3 % 5 * 8 AS x, y + (z - 2) // 3 // 5 * 8 AS y, 0::BIGINT AS z, v FROM u8 WHERE z >= 2 AND (z - 2) % 3 = 0 AND (z - 2) // 3 < 20"

    around = f"WITH {U8}, {AROUND} SELECT x, y, z, ({{agg}})::DOUBLE AS v FROM p WHERE {{which}} GROUP BY x, y, z"
    ranks = {"minfilter": "min(v)", "maxfilter": "max(v)", "medianfilter": "median(v)", "meanfilter": saturated("avg(v)"), "variancefilter": saturated("var_samp(v)"), "stddevfilter": saturated("stddev_samp(v)")}
    for name, sql in ranks.items():
        out[f"{name}_rectangular"] = of(u8, lambda im, n=name: neighbourhood.rank_filter(n, im, (1, 1, 1), "Rectangular")), around.format(which="true", agg=sql)
    out["minfilter_ellipsoidal"] = of(u8, lambda im: neighbourhood.rank_filter("minfilter", im)), around.format(which="abs(i) + abs(j) + abs(k) <= 1", agg="min(v)")
    own = "first(v) FILTER (i = 0 AND j = 0 AND k = 0)"
    local = {"Mean": "avg(v)", "MidGrey": "(min(v) + max(v)) / 2", "Median": "median(v)", "Niblack": "avg(v) + stddev_samp(v)"}
    for name, sql in local.items():
        out[f"localthreshold_{name.lower()}"] = of(u8, lambda im, n=name: neighbourhood.local_threshold(im, (1, 1, 1), n)), around.format(which="true", agg=f"CASE WHEN {own} > {sql} THEN 1 ELSE 0 END")
    out["vawefilter"] = of(u8, lambda im: neighbourhood.vawe(im, (1, 1, 1), 20, "Rectangular")), around.format(which="true", agg=saturated(f"{own} - CASE WHEN 400 <= var_samp(v) THEN 400 / var_samp(v) ELSE 1 END * ({own} - avg(v))"))

    two = lambda im: pointwise.with_number("threshold", im, 110)
    line = "SELECT a.x, a.y, a.z, min(b.v + (a.{d} - b.{d}) * (a.{d} - b.{d})) AS v FROM {t} a JOIN {t} b ON {on} GROUP BY ALL"
    far = f"WITH {U8}, f AS (SELECT x, y, z, CASE WHEN v > 110 THEN 1e18 ELSE 0 END::DOUBLE AS v FROM u8), " + ", ".join(f"d{d} AS ({line.format(d=d, t=t, on=' AND '.join(f'a.{a} = b.{a}' for a in AXES if a != d))})" for d, t in (("x", "f"), ("y", "dx"), ("z", "dy")))
    out["dmap2"] = of(u8, lambda im: distance.squared_distance(two(im))), f"{far} SELECT x, y, z, v FROM dz"
    out["dmap"] = of(u8, lambda im: distance.distance(two(im))), f"{far} SELECT x, y, z, sqrt(v) AS v FROM dz"
    out["rounddistanceridge2"] = of(u8, distance.round_ridge), pixel_sql(saturated("round(sqrt(v)) * round(sqrt(v))"))
    out["finalizetmap"] = of(u8, distance.finalize_thickness), pixel_sql("2 * sqrt(v)")
    balls = "b AS (SELECT x, y, z, v AS r FROM dz WHERE v > 0), e AS (SELECT b.x + i - 7 AS x, b.y + j - 7 AS y, b.z + k - 20 AS z, max(r) AS v FROM b, range(15) t(i), range(15) u(j), range(41) w(k) WHERE (i - 7) * (i - 7) + (j - 7) * (j - 7) + (k - 20) * (k - 20) < r GROUP BY ALL), s AS (SELECT x, y, z, e.v FROM u8 JOIN e USING (x, y, z))"
    out["drawspheres2"] = of(u8, lambda im: distance.draw_spheres(distance.squared_distance(two(im)))), f"{far}, {balls} SELECT a.x, a.y, a.z, coalesce(s.v, 0) AS v FROM u8 a LEFT JOIN s USING (x, y, z)"
    out["tmap"] = of(u8, lambda im: distance.thickness(two(im))), f"{far}, {balls} SELECT a.x, a.y, a.z, 2 * sqrt(coalesce(s.v, 0)) AS v FROM u8 a LEFT JOIN s USING (x, y, z)"

    out["translate_linear"] = of(emb, lambda im: transforms.shift(im, (0.25, 0, 0))), f"WITH {EMB} SELECT a.x, a.y, a.z, a.v * 0.75 + coalesce(b.v, 0) * 0.25 AS v FROM emb a LEFT JOIN emb b ON b.x = a.x - 1 AND b.y = a.y AND b.z = a.z"
    out["scale_linear"] = of(emb, lambda im: transforms.scale(im, (2, 1, 1))), f"WITH {EMB} SELECT a.x * 2 + i AS x, a.y, a.z, CASE WHEN i = 0 THEN a.v ELSE (a.v + b.v) / 2 END AS v FROM emb a JOIN range(2) t(i) ON true JOIN emb b ON b.x = least(a.x + 1, 7) AND b.y = a.y AND b.z = a.z"
    out["scale_nearest"] = of(u8, lambda im: transforms.scale(im, (0.5, 0.5, 1), "Nearest")), f"WITH {U8} SELECT x // 2 AS x, y // 2 AS y, z, v FROM u8 WHERE x % 2 = 0 AND y % 2 = 0"
    out["rotate_quarter"] = of(u8, lambda im: transforms.rotate(im, 1.5707963267948966, input_center=(3.5, 3.5, 0), output_center=(3.5, 3.5, 0))), f"WITH {U8} SELECT 7 - y AS x, x AS y, z, v FROM u8"
    out["carttocyl"] = of(u8, lambda im: transforms.cart_to_cyl(im, (4, 4, im.dims[2]), (4, 4, 0))), (
        f"WITH {U8}, c AS (SELECT r::BIGINT AS x, t::BIGINT AS y, 4 + r * [1, 0, -1, 0][t + 1] AS i, 4 + r * [0, 1, 0, -1][t + 1] AS j FROM range(4) a(r), range(4) b(t)) SELECT c.x, c.y, u8.z, u8.v FROM c JOIN u8 ON u8.x = i AND u8.y = j"
    )
    out["get"] = (lambda spark, sf_dir: transforms.pixels_at(u8(spark, sf_dir), spark.range(40).select((F.col("id") % 9).cast("double").alias("x"), (F.col("id") / 8).alias("y"), F.col("id").alias("z")))), f"WITH {U8}, p AS (SELECT (i % 9)::DOUBLE AS x, i / 8 AS y, i AS z FROM range(40) t(i)) SELECT p.x, p.y, p.z, u8.v FROM p LEFT JOIN u8 ON u8.x = p.x AND u8.y = round(p.y) AND u8.z = p.z"
    moments = {"Mean": "avg(v)", "MidGrey": "(min(v) + max(v)) / 2", "Niblack": "avg(v) + stddev_samp(v)", "Sauvola": "avg(v) * (1 + (stddev_samp(v) / 1 - 1))", "Phansalkar": "avg(v) * (1 + 2 * exp(-10 * avg(v)) + 0.25 * (stddev_samp(v) / 0.5 - 1))"}
    for name, sql in moments.items():
        out[f"autothreshold_{name.lower()}"] = of(u8, lambda im, n=name: pointwise.with_number("threshold", im, statistics.auto_threshold_value(im, n))), f"WITH {U8}, best AS MATERIALIZED (SELECT ({sql})::DOUBLE AS cut FROM u8) SELECT x, y, z, CASE WHEN v > cut THEN 1 ELSE 0 END::DOUBLE AS v FROM u8 CROSS JOIN best"
    out["autothreshold_median"] = of(u8, lambda im: pointwise.with_number("threshold", im, statistics.auto_threshold_value(im, "Median"))), f"WITH {U8} SELECT x, y, z, CASE WHEN v > (SELECT quantile_disc(v, 0.5) FROM u8) THEN 1 ELSE 0 END::DOUBLE AS v FROM u8"
    for name in ("IsoData", "MaxEntropy", "Triangle"):
        out[f"autothreshold_{name.lower()}"] = of(u8, lambda im, n=name: pointwise.with_number("threshold", im, statistics.auto_threshold_value(im, n))), None

    out["analyzelabels"] = of(u8, lambda im: regions.analyze_labels(pointwise.with_number("divide", im, 16))), f"WITH {U8} SELECT round(v / 16)::BIGINT AS label, count(*) AS volume, " + ", ".join(f"avg({a}) AS c{a}, min({a}) AS min{a}, max({a}) AS max{a}" for a in AXES) + " FROM u8 WHERE round(v / 16) <> 0 GROUP BY 1"
    parts = "label, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy, min(z) AS minz, max(z) AS maxz, count(*) AS volume, max(CASE WHEN x IN (0, 7) OR y IN (0, 7) OR z IN (0, m) THEN 1 ELSE 0 END)::INT AS isonedge"
    first = "first({0} ORDER BY z, y, x) AS {0}"
    out["analyzelabels_all"] = of(u8, lambda im: analyzers.analyze(pointwise.with_number("divide", im, 16), ("coordinates", "isonedge", "volume", "bounds"))), f"WITH {U8}, l AS (SELECT x, y, z, round(v / 16)::BIGINT AS label, max(z) OVER () AS m FROM u8) SELECT {parts}, {', '.join(first.format(a) for a in AXES)} FROM l WHERE label <> 0 GROUP BY label"
    out |= more_queries.table() | scan_queries.table() | surface_queries.table() | stitch_queries.table()
    # A last sort costs little and has a join's rows gathered before any is handed out.
    return {name: (run, f"{sql} ORDER BY ALL" if sql and " JOIN " in sql and "ORDER BY ALL" not in sql[-20:] else sql) for name, (run, sql) in out.items()}
