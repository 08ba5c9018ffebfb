"""Registry of the geometry queries and their DuckDB oracles."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphera.functions import cells
from sphera.functions.points import angle_to_km, haversine
from sphera.plans import cellshapes, codec, edgeplans, formats, indexplans, moreplans, polygonplans, predicateplans, scalars, shapes, spatial  # noqa: F401  (they register their queries)
from sphera.plans.base import ORACLES, QUERIES, cell_points


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers within 5000 km of 40 north, 10 east, counted per level-4 cell."""
    df = cell_points(spark, sf_dir, "customer", "c_custkey")
    near = df.where(angle_to_km(haversine(F.col("lat"), F.col("lng"), F.lit(40.0), F.lit(10.0))) <= 5000)
    return near.groupBy(cells.parent(F.col("cell"), 4).alias("cell")).agg(F.count("*").alias("n"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
