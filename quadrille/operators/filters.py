"""User-defined filters on tuples and on pairs of tuples, by registered name and a text value."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.functions import geometry


@dataclass(frozen=True)
class Filter:
    """A registered filter and its value."""

    name: str
    value: str = ""

    def on_tuple(self, data: Column, key: Column) -> Column:
        return REGISTRY[self.name][0](self.value, data, key)

    def on_pair(self, data_1: Column, key_1: Column, data_2: Column, key_2: Column) -> Column:
        return REGISTRY[self.name][1](self.value, data_1, key_1, data_2, key_2)


def _unsupported(*_):
    raise NotImplementedError("the filter does not support this use")


def _property(value: str, data: Column) -> Column:
    name, _, wanted = value.partition(":")
    return F.coalesce(F.from_json(data, "properties map<string,string>")["properties"][name] == wanted, F.lit(False))


def _safe(f: Callable, *texts) -> bool:
    try:
        return bool(f(*texts))
    except Exception:  # a filter that fails drops its tuple
        return False


def geometry_udf(f: Callable, *args):
    @F.pandas_udf(T.BooleanType())
    def judged(a, b):
        return pd.Series([_safe(f, x, y, *args) for x, y in zip(a, b, strict=True)])

    return judged


def _spatial_tuple(value: str, data: Column, key: Column) -> Column:
    if not value:
        return F.lit(True)
    if value.lstrip().startswith("{"):
        return geometry_udf(geometry.intersect_text)(data, F.lit(value))
    return _property(value, data)


def _spatial_pair(metres: float):
    def test(value: str, data_1: Column, key_1: Column, data_2: Column, key_2: Column) -> Column:
        near = geometry_udf(geometry.near_text, metres)(data_1, data_2)
        return (_property(value, data_1) | _property(value, data_2)) & near if value else near

    return test


#: name: (expression on a tuple, expression on a pair)
REGISTRY: dict[str, tuple[Callable, Callable]] = {
    "key": (lambda v, d, k: k == v, lambda v, d1, k1, d2, k2: (k1 == v) & (k2 == v)),
    "contains": (lambda v, d, k: F.contains(d.cast("string"), F.lit(v)), lambda v, d1, k1, d2, k2: F.contains(d1.cast("string"), F.lit(v)) & F.contains(d2.cast("string"), F.lit(v))),
    "property": (lambda v, d, k: _property(v, d), lambda v, d1, k1, d2, k2: _property(v, d1) | _property(v, d2)),
    "geojson": (_spatial_tuple, _spatial_pair(5.0)),
    "geojson_strict": (_spatial_tuple, _spatial_pair(0.0)),
    "geojson_simple": (_unsupported, lambda v, d1, k1, d2, k2: geometry_udf(geometry.near_text, 0.0)(d1, d2)),
}


#: Pair filters on geometries: the metres they allow.
SHAPED = {"geojson": 5.0, "geojson_strict": 0.0, "geojson_simple": 0.0}


def register(name: str, on_tuple: Callable = _unsupported, on_pair: Callable = _unsupported) -> None:
    """Add a filter made of column expressions: ``on_tuple(value, data, key)`` and ``on_pair(value, data, key, data, key)``."""
    REGISTRY[name] = (on_tuple, on_pair)


def apply_filters(df: DataFrame, filters: list[Filter], prefix: str = "") -> DataFrame:
    """Keep tuples that pass all filters; an unknown outcome drops the tuple."""
    for f in filters:
        df = df.where(F.coalesce(f.on_tuple(F.col(prefix + "data"), F.col(prefix + "key")), F.lit(False)))
    return df


def apply_pair_filters(df: DataFrame, filters: list[Filter], one: str, two: str) -> DataFrame:
    """Keep pairs that pass all filters. The conditions stand bare, so that those on one side alone reach it."""
    for f in filters:
        df = df.where(f.on_pair(F.col(one + "data"), F.col(one + "key"), F.col(two + "data"), F.col(two + "key")))
    return df


@F.pandas_udf(T.StructType().add("point", T.BooleanType()).add("x", T.DoubleType()).add("y", T.DoubleType()))
def _shape(data: pd.Series) -> pd.DataFrame:
    """Of a text: whether it is a point, and where; no answer for texts that are no geometry."""
    rows = []
    for text in data:
        try:
            g = geometry.parse(text)
            plain = g.kind == "Point" and all(map(math.isfinite, g.points[0]))
            rows.append((True, *g.points[0]) if plain else (False, None, None))
        except Exception:  # a filter that fails drops its tuple
            rows.append((None, None, None))
    return pd.DataFrame({"point": pd.Series([r[0] for r in rows], dtype=object), "x": pd.Series([r[1] for r in rows], dtype="float64"), "y": pd.Series([r[2] for r in rows], dtype="float64")})


def _metres(a: str, b: str) -> Column:
    """``geometry.metres`` of two points."""
    at = lambda p, c: F.col(f"{p}_shape")[c]
    lon, lat = F.radians(at(b, "x") - at(a, "x")), F.radians(at(b, "y") - at(a, "y"))
    h = F.pow(F.sin(lat / 2), F.lit(2.0)) + F.cos(F.radians(at(a, "y"))) * F.cos(F.radians(at(b, "y"))) * F.pow(F.sin(lon / 2), F.lit(2.0))
    return F.lit(2 * geometry.RADIUS) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def pair_parts(left: DataFrame, right: DataFrame, filters: list[Filter], a: str, b: str) -> tuple[list[tuple], list[Filter]]:
    """Parts ``(left, right, condition, filter)`` that share no pair, to be joined each by itself, and the filters
    that are left for all of them.

    Geometries are read once for each row instead of once for each pair. Two points are compared by columns,
    equal ones by the join's keys; pairs with another geometry keep the filter. Where one side must have a
    property, pairs of two rows without it are not met at all.
    """
    f = next((f for f in filters if f.name in SHAPED), None)
    if f is None:
        return [(left, right, None, None)], list(filters)
    rest = [g for g in filters if g is not f]
    wanted = f.value if f.name != "geojson_simple" else ""
    has = _property(wanted, F.col("data")) if wanted else F.lit(True)
    tasks = 2 * left.sparkSession.sparkContext.defaultParallelism
    # Few rows can have many pairs: a small table's few files would leave them to as many tasks.
    one, two = (t.repartition(tasks, "key").withColumns({"_has": has, "_shape": _shape("data")}).where(F.col("_shape")["point"].isNotNull()) for t in (left, right))
    point, within = F.col("_shape")["point"], SHAPED[f.name]
    same = (F.col(f"{a}_shape")["x"] == F.col(f"{b}_shape")["x"]) & (F.col(f"{a}_shape")["y"] == F.col(f"{b}_shape")["y"])
    near = same | (_metres(a, b) < within) if within else same
    shapes = [(one.where(point), two.where(point), near, None)]
    others = [t.isStreaming or not t.where(~point).isEmpty() for t in (one, two)]
    if others[0]:
        shapes.append((one.where(~point), two, None, f))
    if others[1]:
        shapes.append((one.where(point), two.where(~point), None, f))
    if wanted:
        shapes = [p for x, y, t, g in shapes for p in ((x.where("_has"), y, t, g), (x.where("not _has"), y.where("_has"), t, g))]
    return shapes, rest
