"""The one-shot queries on a table of tuples. Versions are resolved first, boxes are tested after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.boxes import Box, meets_box
from quadrille.operators.filters import Filter, apply_filters
from quadrille.operators.versions import TableConfig, resolve


def key_query(table: DataFrame, key: str, config: TableConfig = TableConfig(), **how) -> DataFrame:
    """The key is the window's partition key, so its predicate reaches the scan."""
    return resolve(table.where(F.col("key") == key), config, **how)


def range_query(table: DataFrame, box: Box, filters: list[Filter] = (), config: TableConfig = TableConfig(), **how) -> DataFrame:
    return apply_filters(resolve(table, config, **how).where(meets_box(box)), filters)


def version_time_query(table: DataFrame, after_us: int, config: TableConfig = TableConfig(), **how) -> DataFrame:
    return resolve(table, config, **how).where(F.col("version_ts") > after_us)


def insert_time_query(table: DataFrame, after_us: int, config: TableConfig = TableConfig(), **how) -> DataFrame:
    return resolve(table, config, **how).where(F.col("received_ts") > after_us)


def range_and_time_query(table: DataFrame, box: Box, after_us: int, config: TableConfig = TableConfig(), *, by: str = "received_ts", **how) -> DataFrame:
    """``by`` names the time: ``received_ts`` (insertion) or ``version_ts``."""
    return range_query(table, box, (), config, **how).where(F.col(by) > after_us)


def region_scan(table: DataFrame, box: Box) -> DataFrame:
    """Tuples, all versions, whose boxes meet a region."""
    return table.where(meets_box(box))
