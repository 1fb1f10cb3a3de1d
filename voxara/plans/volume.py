"""What the queries of the raster operators share: the volume made of the embeddings table, and its SQL.

emb: x = k mod 8, y = k div 8, z = vec_id of component k. u8: emb mapped from [-0.5, 0.5] to 0..255 and rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.raster import AXES, Image, pix, pixel_round

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]
EMB = "emb AS MATERIALIZED (SELECT (k % 8)::BIGINT AS x, (k // 8)::BIGINT AS y, vec_id AS z, embedding[k + 1]::DOUBLE AS v FROM embeddings, range(64) t(k))"
U8 = EMB + ", u8 AS MATERIALIZED (SELECT x, y, z, least(greatest(round((v + 0.5) * 255), 0), 255) AS v FROM emb)"

#: p: every pixel's 27 neighbours (the nearest pixels beyond the image) with their offsets i, j, k.
AROUND = (
    "d AS (SELECT max(z) AS m FROM u8), o AS (SELECT i - 1 AS i, j - 1 AS j, k - 1 AS k FROM range(3) a(i), range(3) b(j), range(3) c(k)), "
    "q AS MATERIALIZED (SELECT x, y, z, i, j, k, least(greatest(x + i, 0), 7) AS cx, least(greatest(y + j, 0), 7) AS cy, least(greatest(z + k, 0), m) AS cz FROM u8, o, d), "
    "p AS (SELECT q.x, q.y, q.z, b.v, i, j, k FROM q JOIN u8 b ON b.x = cx AND b.y = cy AND b.z = cz)"
)


def emb(spark: SparkSession, sf_dir: str) -> Image:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    depth = (table.agg(F.max("vec_id")).first()[0] or 0) + 1
    df = table.select(F.col("vec_id").alias("z"), F.posexplode("embedding").alias("k", "e"))
    df = df.select((F.col("k") % 8).cast("bigint").alias("x"), (F.col("k") / 8).cast("bigint").alias("y"), "z", F.col("e").cast("double").alias("v"))
    return Image(df, (8, 8, depth), "float32")


def u8(spark: SparkSession, sf_dir: str) -> Image:
    image = emb(spark, sf_dir)
    return image.with_rows(image.df.select(*AXES, pixel_round((pix() + 0.5) * 255, "uint8").alias("v")), dtype="uint8")


def of(base: Callable, f: Callable[[Image], Image | DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(base(spark, sf_dir))
        return out.df if isinstance(out, Image) else out

    return run


def pixel_sql(expression: str, base: str = "u8") -> str:
    return f"WITH {U8} SELECT x, y, z, ({expression})::DOUBLE AS v FROM {base}"


def saturated(expression: str, low: int = 0, high: int = 255) -> str:
    return f"least(greatest(round({expression}), {low}), {high})"
