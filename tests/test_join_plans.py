"""Joins do work in proportion to their rows and pairs; all pairs are there, whatever the geometries and keys."""

import datetime
import itertools
import json

from pyspark.sql import functions as F

from quadrille.functions import geometry
from quadrille.functions.boxes import Box
from quadrille.operators import joins
from quadrille.operators.filters import Filter
from quadrille.plans import format_queries, registry  # noqa: F401  the first adds its queries to the second

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def features(spark, texts):
    rows = [(str(i), 0.0, 1.0, 0.0, 1.0, t, 1, 1, "TUPLE") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "key string, lo_0 double, hi_0 double, lo_1 double, hi_1 double, data string, version_ts long, received_ts long, kind string")


def test_geometries_are_read_once_a_row(spark):
    for name in ("join_geojson_strict", "join_geojson_simple", "join_geojson_relaxed"):
        text = plan(registry.QUERIES[name](spark, SF))
        assert text.index("Join") < text.index("ArrowEvalPython")


def test_geometry_joins_equal_pairwise_tests(spark):
    shape = lambda kind, c, k: json.dumps({"type": "Feature", "id": "x", "geometry": {"type": kind, "coordinates": c}, "properties": {"k": k}})
    texts = [shape("Point", [x, y], x) for x in (0.0, 1.0, 1.00002, 2.0) for y in (0.0, -0.0, 1.0)]
    texts += [shape("Point", [float("nan"), 1.0], 1), shape("LineString", [[0, 0], [2, 2]], 2), shape("Polygon", [[[0, 0], [1.5, 0], [1.5, 1.5], [0, 0]]], 1), shape("Circle", [0, 0], 1), "broken", None]
    t = features(spark, texts)

    def near(a, b, metres):
        try:
            return geometry.near_text(a, b, metres)
        except Exception:
            return False

    for f, metres in ((Filter("geojson_strict"), 0.0), (Filter("geojson_simple"), 0.0), (Filter("geojson"), 5.0), (Filter("geojson", "k:1"), 5.0)):
        got = sorted((int(r.l_key), int(r.r_key)) for r in joins.spatial_join(t, t, Box(), [f]).collect())
        has = lambda s: not f.value or '"k": 1}' in s  # noqa: B023, E731
        want = [(i, j) for (i, a), (j, b) in itertools.product(enumerate(texts), repeat=2) if near(a, b, metres) and (has(a) or has(b))]
        assert got == want and want


def test_region_join_has_keys_of_any_size(spark, tmp_path):
    day = lambda n: datetime.datetime(1998, 1, 1) + datetime.timedelta(days=n)
    o = [(i, c, day(i), "1-URGENT") for i, c in enumerate((5, 99_990, 100_500, 7_000_000))]
    li = [(i, c + 1, 1, 1, 10.0, "R", day(i + 1)) for i, (_, c, _, _) in enumerate(o)] + [(9, 500_000, 1, 1, 10.0, "R", day(1))]
    spark.createDataFrame(o, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(li, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.QUERIES["region_join"](spark, str(tmp_path))
    assert sorted(r.l_key for r in got.collect()) == ["0", "1", "2", "3"]
    assert "_cell_0" in plan(got)  # regions are not joined all against all


def test_three_way_join_runs_each_join_once(spark):
    assert plan(registry.QUERIES["spatial_join_3way"](spark, SF)).count("Join Inner") == 2


def test_larger_side_is_not_repeated(spark):
    for name in ("spatial_join_2way", "join_dedup", "interval_join_orders_lineitem"):
        text = plan(registry.QUERIES[name](spark, SF))
        assert text.count("Join Inner") == 1 and "_cell_0" in text
        assert text.count("Generate explode") == (1 if name.startswith("interval") else 2)


def test_large_rows_and_full_spaces_meet_all(spark):
    rows = [(float(i), i + 1.0) for i in range(200)] + [(0.0, 190.0), (-1e38, 1e38), (float("inf"), float("inf")), (None, None)]
    t = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "key string, lo_0 double, hi_0 double")
    u = t.unionByName(t.where("key < '2'").withColumn("key", F.concat("key", F.lit("u"))))
    meet = lambda a, b: None in (a[0], b[0]) or a[0] <= b[1] and b[0] <= a[1]
    other = rows + [r for i, r in enumerate(rows) if str(i) < "2"]
    for x, y, p, q in ((t, u, rows, other), (u, t, other, rows)):
        assert joins.overlap_join(x, y).count() == sum(meet(a, b) for a in p for b in q)
        assert joins.overlap_join(x, y, cell=[0.001]).count() == sum(meet(a, b) for a in p for b in q)


def test_filters_reach_their_side(spark):
    lines = plan(registry.QUERIES["spatial_join_udf"](spark, SF)).splitlines()
    below = [x for x in lines if "Filter" in x and "Contains(" in x]
    assert len(below) == 2 and not any("Contains(" in x for x in lines if "Join" in x)


def test_cells_do_not_grow_with_the_table(spark):
    thin = lambda rows, span: joins.Extents(rows, 0, (0.5,), (0.5,), (0.0,), (span,))
    sizes = [joins._sizes(thin(rows, span), thin(rows, span), [0.5], None)[0] for rows, span in ((10_000, 1e3), (10**7, 1e6), (10**7, 5e5))]
    assert max(sizes) <= 8
