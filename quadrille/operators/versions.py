"""Version resolution: which of a key's versions a query sees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrille.operators.tuples import DELETE


@dataclass(frozen=True)
class TableConfig:
    """``duplicates`` keeps several versions: all, the newest ``versions``, those within ``ttl_us``.

    ``unique_keys`` states that no key repeats, which skips resolution and lets predicates on
    boxes reach the files.
    """

    duplicates: bool = False
    versions: int = 0
    ttl_us: int = 0
    unique_keys: bool = False
    spatial_index: bool = True

    def __post_init__(self):
        if not self.duplicates and (self.versions or self.ttl_us):
            raise ValueError("versions and time to live need duplicates")


def ranked(df: DataFrame, ties: list[str]) -> Column:
    """1 for a key's newest version. ``ties`` order equal versions, the later first."""
    return F.row_number().over(W.partitionBy("key").orderBy(F.col("version_ts").desc(), *(F.col(c).desc() for c in ties)))


def newest(df: DataFrame, n: int = 1, ties: list[str] | None = None) -> DataFrame:
    ties = [c for c in df.columns if c not in ("key", "version_ts")] if ties is None else ties
    return df.withColumn("_rank", ranked(df, ties)).where(F.col("_rank") <= n).drop("_rank")


def within(df: DataFrame, ttl_us: int, now: Column | int | None = None) -> DataFrame:
    base = F.unix_micros(F.current_timestamp()) if now is None else now if isinstance(now, Column) else F.lit(now)
    return df.where(F.col("version_ts") >= base - F.lit(ttl_us))


def resolve(df: DataFrame, config: TableConfig = TableConfig(), *, now: Column | int | None = None, ties: list[str] | None = None, include_deleted: bool = False) -> DataFrame:
    """The versions that the table's rules keep; deletions hide their keys and are dropped."""
    if config.unique_keys:
        out = df
    elif not config.duplicates:
        out = newest(df, 1, ties)
    else:
        out = within(df, config.ttl_us, now) if config.ttl_us else df
        out = newest(out, config.versions, ties) if config.versions else out
    return out if include_deleted or "kind" not in out.columns else out.where(F.col("kind") != DELETE)


def compact(spark: SparkSession, df: DataFrame, path: str, config: TableConfig = TableConfig(), *, major: bool = True, ties: list[str] | None = None) -> DataFrame:
    """Write what resolution keeps; a major compaction of a table without duplicates drops deletions."""
    out = resolve(df, config, ties=ties, include_deleted=not major or config.duplicates)
    out.sortWithinPartitions("key", "version_ts").write.mode("overwrite").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def merge_runs(*runs: DataFrame, config: TableConfig = TableConfig()) -> DataFrame:
    """Several sorted runs as one table, resolved by key."""
    both = runs[0]
    for r in runs[1:]:
        both = both.unionByName(r)
    return resolve(both, config)
