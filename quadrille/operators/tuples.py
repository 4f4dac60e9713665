"""The tuple schema: ``key, lo_d, hi_d, data, version_ts, received_ts, kind``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TUPLE, DELETE, INVALIDATION, WATERMARK, IDLE_REMOVED = "TUPLE", "DELETE", "INVALIDATION", "WATERMARK", "IDLE_REMOVED"


def now_us() -> Column:
    return F.unix_micros(F.current_timestamp())


def columns(n: int) -> list[str]:
    return ["key", *(f"{k}_{d}" for d in range(n) for k in ("lo", "hi")), "data", "version_ts", "received_ts", "kind"]


def to_tuples(df: DataFrame, key, axes: list, version, data=None, received=None, kind: str = TUPLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows as tuples. Each axis is a point's expression or a pair of low and high ones."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    out = [as_col(key).cast("string").alias("key")]
    for d, axis in enumerate(axes):
        lo, hi = axis if isinstance(axis, tuple) else (axis, axis)
        out += [as_col(lo).cast("double").alias(f"lo_{d}"), as_col(hi).cast("double").alias(f"hi_{d}")]
    version = as_col(version)
    out.append((as_col(data) if data is not None else F.lit(None).cast("string")).alias("data"))
    out.append(version.cast("long").alias("version_ts"))
    out.append((as_col(received) if received is not None else version).cast("long").alias("received_ts"))
    return df.select(*out, F.lit(kind).alias("kind"), *keep)


def check(df: DataFrame, n: int) -> DataFrame:
    """Fail on rows whose boxes are not of ``n`` dimensions or end before they begin."""
    bad = F.lit(False)
    for d in range(n):
        bad = bad | (F.col(f"lo_{d}") > F.col(f"hi_{d}")) | (F.col(f"lo_{d}").isNull() != F.col("lo_0").isNull())
    return df.withColumn("key", F.when(bad, F.raise_error("a tuple has a malformed box")).otherwise(F.col("key")))


def tombstones(keys: DataFrame, n: int, ts: Column | None = None) -> DataFrame:
    """Deletions of the keys: full-space tuples that hide older versions."""
    none = [F.lit(None).cast("double").alias(f"{k}_{d}") for d in range(n) for k in ("lo", "hi")]
    at = now_us() if ts is None else ts
    return keys.select(F.col("key").cast("string").alias("key"), *none, F.lit(None).cast("string").alias("data"), at.cast("long").alias("version_ts"), now_us().alias("received_ts"), F.lit(DELETE).alias("kind"))
