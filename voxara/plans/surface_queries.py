"""Queries of surface areas and curvatures, with their DuckDB SQL: cells by joins of their corners, areas by a table of the 256 kinds of cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxara.operators import analyzers, cross_sections, pointwise, structure, surfaces
from voxara.plans.volume import U8, Query, of, u8
from voxara.raster import AXES


def cases_sql(level: float) -> str:
    """CTE cases (mask, area): bit i + 2 j + 4 k of mask is the corner at (i, j, k)."""
    return f"cases AS MATERIALIZED (SELECT * FROM (VALUES {', '.join(f'({m}, {float(a)!r}::DOUBLE)' for m, a in enumerate(surfaces.case_areas(level)))}) t(mask, area))"




def table() -> dict[str, Query]:
    out: dict[str, Query] = {}
    binary = lambda im: pointwise.with_number("threshold", im, 140)
    corners = "o AS (SELECT i, j, k, (1 << (i + 2 * j + 4 * k)) AS bit FROM range(2) a(i), range(2) b(j), range(2) c(k))"
    out["surfacearea"] = (
        of(u8, lambda im: surfaces.surface_area(binary(im), 0.5)),
        f"WITH {U8}, {cases_sql(0.5)}, {corners}, q AS (SELECT x - i AS x, y - j AS y, z - k AS z, CASE WHEN v > 140 THEN bit ELSE 0 END AS bit FROM u8, o), m AS (SELECT sum(bit)::INT AS mask FROM q GROUP BY x, y, z HAVING count(*) = 8) SELECT coalesce(sum(area), 0)::DOUBLE AS v FROM m JOIN cases USING (mask)",
    )
    labelled = (
        f"{cases_sql(surfaces.LABEL_LEVEL)}, {corners}, q AS (SELECT x - i AS x, y - j AS y, z - k AS z, label, bit FROM l, o WHERE label <> 0), m AS (SELECT label, sum(bit)::INT AS mask FROM q GROUP BY x, y, z, label), a AS (SELECT label, sum(area)::DOUBLE AS surface_area FROM m JOIN cases USING (mask) GROUP BY label)"
    )
    out["analyzelabels_surfacearea"] = (
        of(u8, lambda im: analyzers.analyze(pointwise.with_number("divide", im, 16), ("volume", "surfacearea"))),
        f"WITH {U8}, l AS (SELECT x, y, z, round(v / 16)::BIGINT AS label FROM u8), {labelled}, n AS (SELECT label, count(*) AS volume FROM l GROUP BY label) SELECT label, volume, surface_area FROM n JOIN a USING (label)",
    )
    solid = lambda im: pointwise.with_number("threshold", im, 120)
    both = lambda k: k[0].df.join(k[1].df.withColumnRenamed("v", "k2"), list(AXES)).select(*AXES, F.col("v").alias("k1"), "k2")
    out["curvature"] = of(u8, lambda im: both(surfaces.curvature(solid(im), 2.5)).filter(~F.isnan("k1"))), None
    fibres = lambda im: cross_sections.cross_sections(pointwise.with_number("threshold", im, 145), *structure.cylinder_orientation(im, 0.5, 0.5), radius=2, count=300)
    out["csa"] = of(u8, lambda im: fibres(im).select("number", *[F.round(n, 6).alias(n) for n in cross_sections.headers()])), None
    return out
