"""Search tiles of a bounding box, and the plan of searches over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tile_grid(spark: SparkSession, south: float, north: float, west: float, east: float, rows: int, cols: int) -> DataFrame:
    """(tile, south, north, west, east), row by row from the south-west corner."""
    r, c = F.floor(F.col("id") / cols), F.pmod("id", F.lit(cols))
    high, wide = (north - south) / rows, (east - west) / cols
    return spark.range(rows * cols).select(
        F.col("id").alias("tile"), (south + r * high).alias("south"), (south + (r + 1) * high).alias("north"), (west + c * wide).alias("west"), (west + (c + 1) * wide).alias("east"),
    )


def searches(tiles: DataFrame, keywords: DataFrame) -> DataFrame:
    """Every keyword in every tile: the plan has tiles x keywords rows by definition."""
    return tiles.crossJoin(F.broadcast(keywords))
