"""Versions, queries, joins, partitioners and filters, against small cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quadrille.functions import geometry
from quadrille.functions.boxes import Box
from quadrille.operators import joins, partition, queries, tuples, versions
from quadrille.operators.filters import Filter, apply_filters, apply_pair_filters, register
from quadrille.operators.versions import TableConfig


def table(spark, rows, n=2):
    """Rows ``key, bounds, data``; versions count up."""
    schema = "key string, " + ", ".join(f"{k}_{d} double" for d in range(n) for k in ("lo", "hi")) + ", data string, version_ts long, received_ts long, kind string"
    out = [(k, *(map(float, b) if b else [None] * 2 * n), data, i + 1, i + 1, "TUPLE") for i, (k, b, data) in enumerate(rows)]
    return spark.createDataFrame(out, schema)


def test_newest_version_wins(spark):
    t = table(spark, [("1", (1, 2, 1, 2), "value"), ("2", (1.5, 2.5, 1.5, 2.5), "value2"), ("1", (1, 2, 1, 2), "value1")])
    got = queries.range_query(t, Box.of(0, 5, 0, 5)).collect()
    assert {r.key: r.data for r in got} == {"1": "value1", "2": "value2"}
    moved = t.unionByName(table(spark, [("2", (90, 91, 90, 91), "gone")]).withColumn("version_ts", F.lit(9).cast("long")))
    assert [r.key for r in queries.range_query(moved, Box.of(0, 5, 0, 5)).collect()] == ["1"]
    full = table(spark, [("1", None, "v")])
    assert queries.range_query(full, Box.of(0, 1, 0, 1)).count() == 1


def test_resolvers(spark):
    rows = [("abc", float(i), v) for i, v in enumerate([1, 2, 1, 4, 3, 1])]
    t = spark.createDataFrame(rows, "key string, seq double, version_ts long")
    got = lambda c, **k: sorted(r.version_ts for r in versions.resolve(t, c, **k).collect())
    assert got(TableConfig()) == [4]
    assert got(TableConfig(duplicates=True, ttl_us=3), now=6) == [3, 4]
    assert got(TableConfig(duplicates=True, versions=3)) == [2, 3, 4]
    assert got(TableConfig(duplicates=True, versions=3, ttl_us=2), now=6) == [4]
    assert got(TableConfig(duplicates=True)) == [1, 1, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        TableConfig(versions=2)


def test_deletions_hide_keys(spark):
    t = table(spark, [("1", (0, 1, 0, 1), "a"), ("2", (0, 1, 0, 1), "b")])
    gone = tuples.tombstones(t.where("key = '1'").select("key"), 2, F.lit(10))
    both = t.unionByName(gone)
    assert [r.key for r in versions.resolve(both).collect()] == ["2"]
    assert versions.resolve(both, include_deleted=True).count() == 2


def test_time_queries_are_strict(spark):
    t = table(spark, [("1", (1, 10, 1, 10.9), "x"), ("2", (-11, 0, -11, 0.9), "y")])
    assert queries.version_time_query(t, 1).count() == 1 and queries.insert_time_query(t, 2).count() == 0
    assert queries.range_and_time_query(t, Box.of(2, 100, 2, 100), 1).count() == 0


A = [("1a", (1, 2, 1, 2), ""), ("2a", (4, 5, 4, 5), ""), ("3a", (-10, 5, 0, 5), ""), ("4a", (-4, 5, 24, 55), ""), ("5a", (-40, 5, 40, 55), "")]
BB = [("1b", (1.5, 2.5, 1.5, 2.5), ""), ("2b", (2.5, 5.5, 2.5, 5.5), ""), ("3b", (2.5, 50.5, 20.5, 75.5), ""), ("4b", (20.5, 25.5, 20.5, 115.5), ""), ("5b", (-2.5, 5.5, 20.5, 125.5), "")]


def test_join_with_query_box(spark):
    a, b = table(spark, A), table(spark, BB)
    got = joins.spatial_join(table(spark, A[:2]), table(spark, BB[:2]), Box.of(3, 10, 3, 10)).collect()
    assert [(r.l_key, r.r_key, r.lo_0, r.hi_0, r.lo_1, r.hi_1) for r in got] == [("2a", "2b", 2.5, 5.5, 2.5, 5.5)]
    assert joins.spatial_join(a, b, Box.of(3, 10, 3, 10)).count() == joins.spatial_join(b, a, Box.of(3, 10, 3, 10)).count() == 2
    assert joins.spatial_join(a, b, Box.of(-40, -30, 40, 55)).count() == 0
    assert joins.spatial_join(a.limit(0), b.limit(0)).count() == 0


def test_grid_join_equals_nested_loop(spark):
    rng = random.Random(5)

    def some(n, big):
        rows = []
        for i in range(n):
            if i % 40 == 0:
                rows.append((f"f{i}", None, ""))
                continue
            size = 60 if big and i % 25 == 0 else 3
            lo = [rng.randint(-20, 20) for _ in range(2)]
            rows.append((f"k{i}", tuple(x for v in lo for x in (v, v + rng.randint(0, size))), ""))
        return table(spark, rows)

    a, b = some(200, True), some(150, True)
    got = {(r.l_key, r.r_key) for r in joins.overlap_join(a, b, cell=[2.0, 2.0]).collect()}
    n = joins.overlap_join(a, b, cell=[2.0, 2.0]).count()
    box = lambda r: Box() if r.lo_0 is None else Box.of(r.lo_0, r.hi_0, r.lo_1, r.hi_1)
    want = {(x.key, y.key) for x in a.collect() for y in b.collect() if box(x).meets(box(y))}
    assert got == want and n == len(want)


def test_three_way_join(spark):
    t1 = table(spark, [("1", (1, 2, 1, 2), "")])
    t2 = table(spark, [("2", (2, 4, 2, 4), "")])
    t3 = table(spark, [("3", (4, 5.5, 4, 5.5), ""), ("4", (1, 1.5, 1, 1.5), ""), ("5", (9, 9, 9, 9), "")])
    got = joins.multi_join([t1, t2, t3]).collect()
    assert {(r.t3_key, r.hi_0) for r in got} == {("3", 5.5), ("4", 4.0)}
    with pytest.raises(ValueError):
        joins.multi_join([t1])


def test_partitioners(spark):
    assert len(partition.StaticGrid.parse("[[0.0,5.0]:[0.0,6.0]];0.5;0.5").regions()) == 120
    quads = partition.QuadTree(1).regions([], Box.of(0, 10, 0, 10))
    assert len(quads) == 4 and sum(q.box.meets(Box.of(5, 5, 5, 5)) for q in quads) == 1
    rng = random.Random(1)
    samples = [tuple(x for v in (rng.random(), rng.random()) for x in (v, v)) for _ in range(2000)]
    kd = partition.KDTree(8).regions(samples, Box.of(0, 1, 0, 1))
    inside = [sum(r.box.meets(Box.of(*s)) for s in samples) for r in kd]
    assert len(kd) == 8 and sum(inside) == 2000 and max(inside) < 2 * min(inside)
    points = spark.createDataFrame(samples, "lo_0 double, hi_0 double, lo_1 double, hi_1 double")
    assert partition.assign(points, kd).count() == 2000
    dynamic = partition.DynamicGrid(Box.of(0, 1, 0, 1), (0.5,), 3).regions(samples)
    assert len(dynamic) == 6 and partition.assign(points, dynamic).count() == 2000
    assert len(partition.merge_small(dynamic, {r.id: 1 for r in dynamic}, 10)) == 2
    assert partition.needs_merge([[1] * 5, [2] * 5], 4) and not partition.needs_merge([[1] * 4], 4)


def test_filters(spark):
    point = '{"type":"Feature","id":1,"geometry":{"type":"Point","coordinates":[1.0,1.0]},"properties":{"a":"b"}}'
    line = '{"type":"Feature","id":2,"geometry":{"type":"LineString","coordinates":[[0,0],[2,2]]},"properties":{}}'
    t = table(spark, [("1", (0, 1, 0, 1), point), ("2", (0, 1, 0, 1), line), ("3", (0, 1, 0, 1), "broken")])
    keys = lambda *f: sorted(r.key for r in apply_filters(t, list(f)).collect())
    assert keys(Filter("key", "2")) == ["2"] and keys(Filter("contains", "Line")) == ["2"]
    assert keys(Filter("geojson", "a:b")) == ["1"] and keys(Filter("geojson", point)) == ["1", "2"]
    register("long", lambda v, d, k: F.length(d) > int(v))
    assert keys(Filter("long", "20")) == ["1", "2"]
    pairs = joins.overlap_join(t, t, cell=[1.0, 1.0])
    got = apply_pair_filters(pairs, [Filter("geojson_strict")], "l_", "r_").count()
    assert got == 4
    with pytest.raises(NotImplementedError):
        Filter("geojson_simple").on_tuple(F.col("data"), F.col("key"))


def test_geometry():
    at = lambda x, y: geometry.Geometry("Point", ((x, y),))
    square = geometry.Geometry("Polygon", ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)))
    assert geometry.intersects(square, at(2, 2)) and geometry.intersects(square, at(4, 2)) and not geometry.intersects(square, at(5, 2))
    assert geometry.intersects(geometry.Geometry("LineString", ((-1, 2), (9, 2))), square)
    assert geometry.near(at(13.0, 52.0), at(13.00005, 52.0), 5) and not geometry.near(at(13.0, 52.0), at(13.0002, 52.0), 5)
    assert geometry.parse(geometry.to_text(square)).points == square.points
