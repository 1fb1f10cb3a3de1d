"""Queries of cone-beam scans of the volume, with their DuckDB SQL.

The scan is made from the volume: sums along rays at the angles of a half or a whole turn, as transmissions. Each of its
steps is an SQL CTE of its own: line weights, the filter as a matrix over detector columns, and sums over projections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.operators import reconstruction, transforms
from voxara.operators.reconstruction import Settings
from voxara.plans.volume import U8, Query, of, u8
from voxara.raster import Image, pix

#: Columns of the detector, padding at each side of a line, and what pixels of the volume absorb.
WIDTH, PAD, ABSORBS = 14, 10, 0.001
HALF = Settings(source_to_ra=60.0, propagation_distance=15.0, angles=tuple(18.0 * i for i in range(12)), hswp=1.5, bhc=0.1, center_shift=0.25)
FULL = Settings(source_to_ra=200.0, propagation_distance=50.0, rec_as_180_deg_scan=False, angles=tuple(30.0 * i for i in range(12)), roi_size=(8, 8, 0), center_shift=0.5)


def transmissions(spark: SparkSession, sf_dir: str, s: Settings) -> Image:
    volume = u8(spark, sf_dir)
    sums = reconstruction.project_volume(volume.with_rows(volume.df, dtype="float32"), s.angles, WIDTH)
    return sums.map(F.exp(pix() * -ABSORBS))


def transmissions_sql(s: Settings) -> str:
    """CTEs to t (x, y, z, v): transmissions; and m, the last y."""
    step = s.angles[1] - s.angles[0]
    return (
        f"{U8}, n AS (SELECT max(z) AS m FROM u8), ang AS (SELECT i::BIGINT AS a, i * {step} AS deg FROM range({len(s.angles)}) t(i)), "
        f"c AS MATERIALIZED (SELECT z, v, a, round((y - 3.5) * cos(radians(deg)) - (x - 3.5) * sin(radians(deg)) + {WIDTH / 2}, 9) AS p FROM u8, ang), "
        "q AS (SELECT floor(p)::BIGINT AS x, z AS y, a AS z, v * (1 - (p - floor(p))) AS v FROM c UNION ALL SELECT floor(p)::BIGINT + 1, z, a, v * (p - floor(p)) FROM c), "
        "s AS MATERIALIZED (SELECT x, y, z, sum(v) AS v FROM q GROUP BY ALL), "
        f"g AS MATERIALIZED (SELECT x::BIGINT AS x, y::BIGINT AS y, a AS z FROM range({WIDTH}) b(x), (SELECT unnest(range(m + 1)) AS y FROM n), ang), "
        f"t AS MATERIALIZED (SELECT g.x, g.y, g.z, exp(-{ABSORBS} * coalesce(s.v, 0)) AS v FROM g LEFT JOIN s USING (x, y, z))"
    )


def filtered_sql(s: Settings) -> str:
    """CTEs from t to fl: preprocessed projections."""
    size, cone = WIDTH + 2 * PAD, f"degrees(atan2({WIDTH / 2}, {s.source_to_ra}))"
    middle = f"(SELECT least(greatest({s.central_angle}, min(deg) + 90 + {cone}), max(deg) - 90 - {cone}) FROM ang)"
    up, across = f"(y - (m + 1) / 2 - {s.camera_z_shift})", f"(x - {WIDTH / 2} - {s.center_shift})"
    oblique = f"{s.source_to_ra} / sqrt({s.source_to_ra**2} + pow({across}, 2) + pow({up}, 2))"
    logged = f"o AS (SELECT x, y, z, -ln(least(greatest(v, 0.00001), 0.99999)) AS v FROM t), h AS (SELECT x, y, z, v + {s.bhc} * v * v AS v FROM o)"
    if s.rec_as_180_deg_scan:
        square = lambda t: f"pow(sin(radians(45 * {t})), 2)"
        share = (
            f"CASE WHEN b BETWEEN -k AND k - 2 * c THEN {square('(b + k) / (k - c)')} WHEN b - 360 BETWEEN -k AND k - 2 * c THEN {square('(b - 360 + k) / (k - c)')} "
            "WHEN b BETWEEN k - 2 * c AND 180 - k - 2 * c OR b + 360 BETWEEN k - 2 * c AND 180 - k - 2 * c OR b - 360 BETWEEN k - 2 * c AND 180 - k - 2 * c THEN 1 "
            f"WHEN b BETWEEN 180 - k - 2 * c AND 180 + k THEN {square('(180 + k - b) / (k + c)')} WHEN b + 360 BETWEEN 180 - k - 2 * c AND 180 + k THEN {square('(180 + k - b - 360) / (k + c)')} ELSE 0 END"
        )
    else:
        share = "1"
    far = f"abs({up} / (0.5 * (m + 1)))"
    weighted = (
        f"r AS MATERIALIZED (SELECT h.*, {oblique} AS w, degrees(atan2({across}, {s.source_to_ra})) AS c, (1 - {far}) * {cone} + {far} * {s.hswp} * {cone} AS k, deg - ({middle} - 90) AS b FROM h, n, ang WHERE ang.a = h.z), "
        f"l AS MATERIALIZED (SELECT x, y, z, v * w * ({share}) AS v FROM r)"
    )
    matrix = (
        f"f AS (SELECT f, 2 * (0.25 - sum(CASE WHEN k % 2 <> 0 THEN cos(2 * pi() * k * f / {size}) / pow(pi() * k, 2) ELSE 0 END)) AS ramp FROM range({size // 2 + 1}) a(f), (SELECT unnest(range({-(size // 2)}, {size // 2})) AS k) GROUP BY f), "
        f"e AS (SELECT d, sum(ramp * cos(2 * pi() * f * d / {size}) * CASE WHEN f IN (0, {size // 2}) THEN 1 ELSE 2 END) / {size} AS tap FROM f, range({size}) b(d) GROUP BY d), "
        f"k AS MATERIALIZED (SELECT i, CASE WHEN j < 0 THEN -1 - j WHEN j >= {WIDTH} THEN {2 * WIDTH - 1} - j ELSE j END AS x, sum(tap) AS tap FROM range({WIDTH}) a(i), (SELECT unnest(range({-PAD}, {WIDTH + PAD})) AS j), e WHERE d = (i - j + {size}) % {size} GROUP BY ALL)"
    )
    return f"{logged}, {weighted}, {matrix}, fl AS MATERIALIZED (SELECT k.i::BIGINT AS x, y, z, sum(l.v * tap) AS v FROM l JOIN k USING (x) GROUP BY k.i, y, z)"


def back_projected_sql(s: Settings) -> str:
    """The volume of fl."""
    d = s.source_to_ra
    return (
        f"p AS (SELECT x, y, z, a, x - 3.5 AS px, y - 3.5 AS py, z + 0.5 - (m + 1) / 2 AS pz, cos(radians(deg)) AS c, sin(radians(deg)) AS s FROM (SELECT DISTINCT x, y, z FROM u8), n, ang), "
        f"w AS (SELECT x, y, z, a, {d} / ({d} + px * c + py * s) AS near, (py * c - px * s) AS side, pz FROM p), "
        f"i AS MATERIALIZED (SELECT x, y, z, a, near * near AS weight, side * near + {s.center_shift} + {WIDTH / 2} AS u, pz * near + (m + 1) / 2 AS v FROM w, n), "
        "j AS (SELECT i.x, i.y, i.z, a, weight * (CASE WHEN du = 0 THEN 1 - (u - floor(u)) ELSE u - floor(u) END) * (CASE WHEN dv = 0 THEN 1 - (v - floor(v)) ELSE v - floor(v) END) AS weight, floor(u)::BIGINT + du AS cu, floor(v)::BIGINT + dv AS cv FROM i, range(2) b(du), range(2) e(dv)) "
        f"SELECT j.x, j.y, j.z, sum(weight * coalesce(fl.v, 0)) * pi() / 2 / {len(s.angles)} AS v FROM j LEFT JOIN fl ON fl.x = cu AND fl.y = cv AND fl.z = a GROUP BY ALL"
    )


def table() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out["projectvolume"] = (lambda spark, sf_dir: transmissions(spark, sf_dir, HALF).df), f"WITH {transmissions_sql(HALF)} SELECT * FROM t"
    out["fbppreprocess"] = (lambda spark, sf_dir: reconstruction.preprocess(transmissions(spark, sf_dir, HALF), HALF).df), f"WITH {transmissions_sql(HALF)}, {filtered_sql(HALF)} SELECT x, y, z, v FROM fl"
    out["fbp"] = (
        lambda spark, sf_dir: reconstruction.back_project(reconstruction.preprocess(transmissions(spark, sf_dir, FULL), FULL), FULL).df,
        f"WITH {transmissions_sql(FULL)}, {filtered_sql(FULL)}, {back_projected_sql(FULL)}",
    )

    def flat(im: Image) -> DataFrame:
        floats = im.with_rows(im.df, dtype="float32")
        slices = lambda first: transforms.crop(floats, (0, 0, first), (8, 8, 3))
        return reconstruction.flat_field(floats, slices(0).map(pix() + 300), slices(5)).df

    out["flatfield"] = of(u8, flat), (
        f"WITH {U8}, f AS (SELECT x, y, avg(v + 300) AS f FROM u8 WHERE z < 3 GROUP BY x, y), d AS (SELECT x, y, avg(v) AS d FROM u8 WHERE z BETWEEN 5 AND 7 GROUP BY x, y) SELECT x, y, u8.z, (u8.v - d) / (f - d) AS v FROM u8 JOIN f USING (x, y) JOIN d USING (x, y)"
    )
    return out
