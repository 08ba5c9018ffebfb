"""What the geometry queries share: registry, derived inputs in Spark and in DuckDB, rounding.

The test tables hold no geometry. A point of an integer key k comes from two multiplicative
congruences of k + 1, in degrees; everything else is made of such points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sphera.functions import cells
from sphera.functions.points import Vec, from_degrees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) as a query, with its DuckDB equivalent."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    """Rounded to 6 digits, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def big(c: Column) -> Column:
    return c.cast("bigint")


def position(key: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees of an integer key."""
    k = key.cast("bigint") + 1
    return F.lit(-90.0) + F.lit(180.0) * ((k * 7919) % 100003) / F.lit(100003.0), F.lit(-180.0) + F.lit(360.0) * ((k * 104729) % 99991) / F.lit(99991.0)


def points(spark: SparkSession, sf_dir: str, name: str, key: str, *more: str) -> DataFrame:
    """id, lat, lng, x, y, z of the rows of a table, and `more` of its columns."""
    lat, lng = position(F.col(key))
    df = table(spark, sf_dir, name).select(F.col(key).cast("bigint").alias("id"), *more, lat.alias("lat"), lng.alias("lng"))
    p = from_degrees(F.col("lat"), F.col("lng"))
    return df.withColumns({"x": p.x, "y": p.y, "z": p.z})


def cell_points(spark: SparkSession, sf_dir: str, name: str, key: str, *more: str) -> DataFrame:
    """points with their leaf `cell`."""
    return cells.encode(points(spark, sf_dir, name, key, *more), Vec.named())


# --- DuckDB -------------------------------------------------------------------------------------


def d_points(name: str, source: str, key: str, *more: str) -> str:
    """CTEs `name` with id, lat, lng, x, y, z."""
    extra = "".join(f", {m}" for m in more)
    return (
        f"{name}_k AS (SELECT {key}::BIGINT AS id{extra}, -90e0 + 180e0 * ((({key}::BIGINT + 1) * 7919) % 100003) / 100003e0 AS lat, "
        f"-180e0 + 360e0 * ((({key}::BIGINT + 1) * 104729) % 99991) / 99991e0 AS lng FROM {source}), "
        f"{name} AS (SELECT *, cos(radians(lng)) * cos(radians(lat)) AS x, sin(radians(lng)) * cos(radians(lat)) AS y, sin(radians(lat)) AS z FROM {name}_k)"
    )


#: Fixed values of the curve, one level at a time: position of 2 i + j under each orientation, and what a position does to the orientation.
D_POS = "[0,1,3,2,0,3,1,2,2,3,1,0,2,1,3,0]"
D_TURN = "[1,0,0,3]"


def d_encode(name: str, source: str) -> str:
    """CTEs `name`: source (with x, y, z) and face, i, j and the leaf `cell`."""
    ij = lambda c: f"greatest(0, least(1073741823, floor(1073741824e0 * CASE WHEN {c} >= 0 THEN 0.5e0 * sqrt(1 + 3 * {c}) ELSE 1 - 0.5e0 * sqrt(1 - 3 * {c}) END)))::BIGINT"
    return (
        f"{name}_f AS (SELECT *, CASE WHEN abs(x) > abs(y) AND abs(x) > abs(z) THEN CASE WHEN x < 0 THEN 3 ELSE 0 END "
        f"WHEN abs(y) > abs(z) AND abs(y) >= abs(x) THEN CASE WHEN y < 0 THEN 4 ELSE 1 END ELSE CASE WHEN z < 0 THEN 5 ELSE 2 END END::BIGINT AS face FROM {source}), "
        f"{name}_u AS (SELECT *, CASE face WHEN 0 THEN y/x WHEN 1 THEN -x/y WHEN 2 THEN -x/z WHEN 3 THEN z/x WHEN 4 THEN z/y ELSE -y/z END AS u, "
        f"CASE face WHEN 0 THEN z/x WHEN 1 THEN z/y WHEN 2 THEN -y/z WHEN 3 THEN y/x WHEN 4 THEN -x/y ELSE -x/z END AS v FROM {name}_f), "
        f"{name}_i AS (SELECT *, {ij('u')} AS i, {ij('v')} AS j FROM {name}_u), "
        f"{name} AS (SELECT * EXCLUDE (n), {d_signed('((face::HUGEINT << 60) + n) * 2 + 1')} AS cell FROM (SELECT *, {d_curve('face', 'i', 'j')} AS n FROM {name}_i))"
    )


def d_curve(face: str, i: str, j: str) -> str:
    """Position on the curve of a leaf."""
    at = f"{D_POS}[((a & 3) * 4 + (({i} >> k) & 1) * 2 + (({j} >> k) & 1) + 1)::BIGINT]"
    return f"(list_reduce(list_transform(range(29, -1, -1), lambda q: q::HUGEINT), lambda a, k: (((a >> 2) * 4 + {at})::HUGEINT * 4 + xor(a & 3, {D_TURN}[({at} + 1)::BIGINT]::HUGEINT))::HUGEINT, ({face} & 1)::HUGEINT) >> 2)"


def d_signed(value: str) -> str:
    """A HUGEINT below 2**64 as the bigint with the same bits."""
    return f"(CASE WHEN {value} >= 9223372036854775808 THEN {value} - 18446744073709551616 ELSE {value} END)::BIGINT"


def d_lsb(c: str) -> str:
    return f"({c} & (-{c}))"


def d_level(c: str) -> str:
    return f"(30 - bit_count({d_lsb(c)} - 1) // 2)::BIGINT"


def d_parent(c: str, level: int) -> str:
    bit = 1 << 2 * (30 - level)
    return f"(({c} & (-{bit})) | {bit})"


def d_r6(e: str) -> str:
    return f"(round({e}, 6) + 0e0)"
