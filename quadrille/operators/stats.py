"""Statistics of tuples, cells and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrille.functions.boxes import dimensions_of


def cell_histogram(df: DataFrame, sizes: list[float]) -> DataFrame:
    """``cell_d.., n``: tuples in each grid cell; a tuple counts in every cell that its box touches."""
    cells = df.select(*(f"{k}_{d}" for d in range(len(sizes)) for k in ("lo", "hi"))).where("lo_0 is not null")
    for d, s in enumerate(sizes):
        cells = cells.withColumn(f"cell_{d}", F.explode(F.sequence(F.floor(F.col(f"lo_{d}") / s), F.floor(F.col(f"hi_{d}") / s))))
    names = [f"cell_{d}" for d in range(len(sizes))]
    return cells.groupBy(*names).agg(F.count("*").alias("n"))


def balance(counts: DataFrame, n: str = "n") -> DataFrame:
    """Number, least, most, mean and population standard deviation of counts."""
    return counts.agg(F.count("*").alias("regions"), F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("deviation"))


def moving_mean(df: DataFrame, value: str, order: list[str], keys: list[str], rows: int = 5) -> DataFrame:
    """The mean of a value's last ``rows`` rows in each group, as ``moving_mean``."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)
    return df.withColumn("moving_mean", F.avg(value).over(w))


def burst_rate(df: DataFrame, ts: str, seconds: int = 5) -> DataFrame:
    """The most rows in a bucket of so many seconds, for each second of it."""
    counts = df.groupBy(F.window(ts, f"{seconds} seconds")).agg(F.count("*").alias("n"))
    return counts.agg(F.max("n").alias("most"), (F.max("n") / seconds).alias("rate"))


def region_sizes(df: DataFrame, region: str = "region_id") -> DataFrame:
    d = dimensions_of(df)
    return df.groupBy(region).agg(F.count("*").alias("tuples"), *(f(f"{k}_{i}").alias(f"{k}_{i}") for i in range(d) for k, f in (("lo", F.min), ("hi", F.max))))
