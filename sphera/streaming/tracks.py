"""Events with positions as a stream: cells for each event, counts for each window and cell.

The source library has no streams; everything here is a composition of its scalar operators, which keep
no state, and of a windowed count whose state the watermark bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphera.functions import cells
from sphera.functions.points import Vec, from_degrees
from sphera.plans.base import position


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files of a folder, with the schema of those there now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events*.parquet").parquet(path)


def with_cells(events: DataFrame, key: str = "event_id") -> DataFrame:
    """events with lat, lng and the leaf `cell` of each one's position."""
    lat, lng = position(F.col(key))
    df = events.withColumns({"lat": lat, "lng": lng})
    p = from_degrees(F.col("lat"), F.col("lng"))
    df = df.withColumns({"__x": p.x, "__y": p.y, "__z": p.z})
    return cells.encode(df, Vec.named("__")).drop("__x", "__y", "__z")


def counts(events: DataFrame, level: int = 2, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, cell, n: events by window and cell of a level."""
    df = with_cells(events).withWatermark("ts", late)
    by = df.groupBy(F.window("ts", window), cells.parent(F.col("cell"), level).alias("cell")).agg(F.count("*").alias("n"))
    return by.select(F.col("window.start").alias("start"), "cell", "n")
