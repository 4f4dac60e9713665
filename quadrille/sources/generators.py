"""Synthetic boxes and streams, map features by tag, and de-duplication of co-located vehicles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags that mark features, as key and values (an empty list: any value).
TREE = {"natural": ["tree"]}
TRAFFIC_SIGNAL = {"highway": ["traffic_signals"]}
ROAD = {"highway": []}
BUILDING = {"building": []}
WATER = {"water": [], "waterway": [], "natural": ["water"]}
WOOD = {"landuse": ["forest"], "natural": ["wood"]}
FEATURES = {"TREE": TREE, "TRAFFIC_SIGNAL": TRAFFIC_SIGNAL, "ROAD": ROAD, "BUILDING": BUILDING, "WATER": WATER, "WOOD": WOOD}


def boxes(spark: SparkSession, n: int, dimensions: int, *, points: bool = False, seed: int = 1, payload: int = 16) -> DataFrame:
    """Random tuples: begins in [0, 100), extents in [0, 10)."""
    out = [F.col("id").cast("string").alias("key")]
    for d in range(dimensions):
        lo = F.rand(seed + 2 * d) * 100
        out += [lo.alias(f"lo_{d}"), (lo if points else lo + F.rand(seed + 2 * d + 1) * 10).alias(f"hi_{d}")]
    out += [F.substring(F.sha2(F.col("id").cast("string"), 512), 1, payload).alias("data"), F.col("id").alias("version_ts"), F.col("id").alias("received_ts"), F.lit("TUPLE").alias("kind")]
    return spark.range(n).select(*out)


def stream_boxes(spark: SparkSession, elements: int, rounds: int, dimensions: int, *, covered: float = 0.1, seed: int = 1) -> DataFrame:
    """A fixed set of elements that move: ``rounds`` versions of each key, with a side of ``covered`` of 100."""
    base = spark.range(elements * rounds).withColumn("round", F.floor(F.col("id") / elements))
    out = [(F.col("id") % elements).cast("string").alias("key")]
    for d in range(dimensions):
        lo = F.rand(seed + d) * 100 * (1 - covered)
        out += [lo.alias(f"lo_{d}"), (lo + 100 * covered).alias(f"hi_{d}")]
    return base.select(*out, F.lit(None).cast("string").alias("data"), F.col("id").alias("version_ts"), F.col("round").alias("received_ts"), F.lit("TUPLE").alias("kind"))


def has_tags(tags: Column, wanted: dict[str, list[str]]) -> Column:
    out = F.lit(False)
    for k, values in wanted.items():
        v = F.element_at(tags, k)
        out = out | (F.coalesce(v.isin(values), F.lit(False)) if values else v.isNotNull())
    return out


def map_features(elements: DataFrame, feature: str) -> DataFrame:
    """Elements ``id, tags map<string,string>, points array<struct<x,y>>`` of a kind, as GeoJSON lines."""
    some = elements.where(has_tags(F.col("tags"), FEATURES[feature]))
    pair = lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]"))
    points = F.concat(F.lit("["), F.array_join(F.transform("points", pair), ","), F.lit("]"))
    closed = (F.size("points") > 3) & (F.get("points", F.lit(0)) == F.element_at("points", -1))
    shape = (
        F.when(F.size("points") == 1, F.concat(F.lit('{"type":"Point","coordinates":'), pair(F.get("points", F.lit(0))), F.lit("}")))
        .when(closed, F.concat(F.lit('{"type":"Polygon","coordinates":['), points, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"type":"LineString","coordinates":'), points, F.lit("}")))
    )
    return some.select(F.concat(F.lit('{"type":"Feature","id":'), F.col("id").cast("string"), F.lit(',"geometry":'), shape, F.lit(',"properties":'), F.to_json("tags"), F.lit("}")).alias("value"))


def without_colocated(vehicles: DataFrame, id_: str = "id", at: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """One vehicle for each place: the one with the smallest id."""
    least = F.min_by(F.struct(*vehicles.columns), F.col(id_)).alias("r")
    return vehicles.groupBy(*at).agg(least).select("r.*")


def round_watermarks(rows: DataFrame, id_: str = "id", order: str = "seq") -> DataFrame:
    """Mark rows that begin a new round of ids: those smaller than the one before, as ``new_round``.

    For one feed, whose rows have one order; at scale give each feed its own ``feed`` column.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(*(["feed"] if "feed" in rows.columns else [F.lit(0)])).orderBy(order)
    return rows.withColumn("new_round", F.coalesce(F.col(id_) < F.lag(id_).over(w), F.lit(False)))
