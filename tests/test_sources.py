"""Line formats, generators and the catalog."""

import pytest
from pyspark.sql import functions as F

from quadrille.operators.versions import TableConfig
from quadrille.sources import formats, generators
from quadrille.sources.tables import Catalog


def lines(spark, *text):
    return spark.createDataFrame(list(enumerate(text, 1)), "line_no long, value string")


def one(spark, name, *text, **options):
    return formats.read_tuples(lines(spark, *text), name, **options).orderBy("version_ts").collect()


def test_separated_formats(spark):
    assert one(spark, "synthetic", "1,2,3,4 payload here", "bad")[0][1:6] == (1.0, 2.0, 3.0, 4.0, "payload here")
    assert one(spark, "synthetic_stream", "k 1,2 x", dimensions=1)[0].key == "k"
    order = "1|36901|O|173665.47|1996-01-02|5-LOW|Clerk|0|c"
    assert one(spark, "tpch_order_point", order)[0].lo_0 == 820540800000.0
    item = "3|29380|1883|4|2|2618.76|0.01|0.06|A|F|1993-12-04|1994-01-07|1994-01-01|N|T|y"
    r = one(spark, "tpch_lineitem_range", item, padding=1.0)[0]
    assert (r.lo_0, r.hi_0) == (754963200000.0 - 1, 757382400000.0 + 1)
    taxi = "2,2016-01-01 00:00:00,2016-01-01 00:10:00,2,1.10,-73.99,40.73,1,N,-73.98,40.75,2,7.5,0.5,0.5,0,0,0.3,8.8"
    r = one(spark, "yellowtaxi_range", "VendorID,a,b", taxi)
    assert len(r) == 1 and (r[0].lo_0, r[0].hi_1, r[0].hi_2 - r[0].lo_2) == (-73.99, 40.75, 600_000.0)
    assert one(spark, "nari_dynamic", "245257000,0,0,0.1,13.1,36,-4.4657183,48.38249,1443650402")[0].lo_1 == -4.4657183
    assert one(spark, "nari_dynamic", "1,2") == []
    assert one(spark, "forex_2d", "20151201 000005,1.05,1.06,0")[0].lo_0 == 1448928005.0
    line = "20151201 010000000,1.057520,1.057560,0"
    assert [(r.lo_0, r.lo_1) for r in one(spark, "forex_2d", line)] == [(1448931600.0, 1.05752)] and one(spark, "forex_1d", line)[0].lo_0 == 1.05752
    assert len(one(spark, "forex_1d", "20151201 000005,1.05,1.06,0", "x,y,z,0")) == 1


def test_rome_ranges_need_a_fix_before(spark):
    text = ["1;2014-02-01 00:00:00.5+01;POINT(41.9 12.5)", "2;2014-02-01 00:00:01+01;POINT(1 1)", "1;2014-02-01 00:00:02.5+01;POINT(41.8 12.6)"]
    r = one(spark, "rome_taxi_range", *text)
    assert len(r) == 1 and (r[0].hi_0 - r[0].lo_0, r[0].lo_1, r[0].hi_2) == (2000.0, 41.8, 12.6)
    assert one(spark, "rome_taxi_point", text[0])[0].lo_0 == 1391209200500.0


def test_geojson_formats(spark):
    line = '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[1.0,2.0],[3.0,-4.0]]},"properties":{"RouteID":"R 1","Timestamp":"12"},"id":7}'
    r = one(spark, "geojson", line)[0]
    assert (r.key, r.lo_0, r.hi_0, r.lo_1, r.hi_1) == ("7", -4.0, 2.0, 1.0, 3.0)
    r = one(spark, "au_transport", line)[0]
    assert (r.key, r.version_ts) == ("R_1", 12_000_000)
    polygon = '{"type":"Feature","id":1,"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,0]]]},"properties":{}}'
    assert one(spark, "geojson", polygon)[0].hi_1 == 4.0 and one(spark, "geojson", "junk") == []


def test_berlinmod(spark):
    r = one(spark, "berlinmod_player", "28-05-2007 06:00:14,10,1313,13.2967,52.4502")[0]
    assert (r.key, r.version_ts, r.lo_0, r.lo_1) == ("10", 1180332014000, 52.4502, 13.2967)
    r = one(spark, "berlinmod", "Moid,Tripid,Tstart,Tend,Xstart,Ystart,Xend,Yend", "1,1,2007-05-28,2007-05-28 09:00:00,13.1,52.1,13.2,52.0")
    assert len(r) == 1 and (r[0].lo_0, r[0].hi_1, r[0].version_ts) == (52.0, 13.2, 1180310400000)


def test_aircraft_messages_merge(spark):
    at = "2019/02/09,00:00:0{0}.000,2019/02/09,00:00:0{0}.000"
    text = [
        f"MSG,1,1,1,A1B2C3,1,{at.format(1)},CALL1,,,,,,,,,,,", f"MSG,4,1,1,A1B2C3,1,{at.format(2)},,,400,90,,,64,,,,,", f"MSG,3,1,1,A1B2C3,1,{at.format(3)},,3000,,,52.5,13.4,,,,,,",
        f"MSG,4,1,1,A1B2C3,1,{at.format(4)},,,410,91,,,0,,,,,", "noise",
    ]
    r = one(spark, "adsb3d", *text)
    assert len(r) == 1 and (r[0].key, r[0].lo_0, r[0].lo_1, r[0].lo_2, r[0].version_ts) == ("CALL1", 52.5, 13.4, 3000.0, 1549670404000 * 1000)


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        formats.read_tuples(lines(spark, "x"), "nope")


def test_line_numbers(spark, tmp_path):
    spark.range(100).select(F.col("id").cast("string")).coalesce(1).write.text(str(tmp_path / "t"))
    got = formats.read_lines(spark, str(tmp_path / "t")).collect()
    assert sorted(r.line_no for r in got) == list(range(1, 101)) and all(r.line_no == int(r.value) + 1 for r in got)


def test_generators(spark):
    b = generators.boxes(spark, 50, 2).collect()
    assert len(b) == 50 and all(0 <= r.lo_0 < 100 and 0 <= r.hi_0 - r.lo_0 < 10 for r in b)
    s = generators.stream_boxes(spark, 5, 3, 2)
    assert s.select("key").distinct().count() == 5 and s.count() == 15
    e = spark.createDataFrame([(1, {"highway": "primary"}, [(1.0, 2.0), (3.0, 4.0)]), (2, {"natural": "tree"}, [(1.0, 2.0)])], "id long, tags map<string,string>, points array<struct<x:double,y:double>>")
    road = generators.map_features(e, "ROAD").collect()
    assert len(road) == 1 and '"LineString"' in road[0].value and generators.map_features(e, "TREE").count() == 1
    v = spark.createDataFrame([(2, 1.0, 1.0), (1, 1.0, 1.0), (3, 2.0, 1.0)], "id long, x double, y double")
    assert sorted(r.id for r in generators.without_colocated(v).collect()) == [1, 3]


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "db"))
    c.create_group("g", 2)
    c.create_table("g_t", TableConfig())
    assert c.groups() == ["g"] and c.tables("g") == ["g_t"] and c.table("g_t").count() == 0
    rows = generators.boxes(spark, 10, 2)
    c.put("g_t", rows)
    c.put("g_t", rows.limit(3).withColumn("version_ts", F.lit(99).cast("long")))
    c.delete("g_t", spark.createDataFrame([("9",)], "key string"))
    assert c.table("g_t").count() == 14 and c.resolved("g_t").count() == 9
    c.compact("g_t")
    assert c.table("g_t").count() == 9
    assert not c.put_if_newest("g_t", rows.where("key = '5'"), 4) and c.put_if_newest("g_t", rows.where("key = '5'"), 5)
    with pytest.raises(ValueError):
        c.put("g_t", generators.boxes(spark, 1, 3))
    c.delete_table("g_t")
    assert c.tables("g") == []


def test_command_line(spark, tmp_path):
    from quadrille.cli import run

    go = lambda *a: run(spark, [*a, "--root", str(tmp_path / "db")])
    go("create_dgroup", "--group", "g", "--dimensions", "2")
    go("create_table", "--table", "g_t")
    go("insert", "--table", "g_t", "--key", "k", "--box", "[[1,2]:[3,4]]", "--value", "some payload")
    go("insert", "--table", "g_t", "--key", "m", "--box", "[[8,9]:[3,4]]")
    assert [r.data for r in go("query_key", "--table", "g_t", "--key", "k").collect()] == ["some payload"]
    assert go("query_range", "--table", "g_t", "--box", "[[0,5]:[0,5]]", "--filter", "contains=pay").count() == 1
    assert go("query_join", "--table", "g_t,g_t").count() == 2
    go("delete", "--table", "g_t", "--key", "k")
    assert go("query_time", "--table", "g_t", "--time", "0").count() == 1 and go("show_dgroup") == ["g"]


def test_catalog_updates_and_streams(spark, tmp_path):
    from quadrille.streaming.continuous import run_available

    c = Catalog(spark, str(tmp_path / "db"))
    c.create_group("g", 1)
    c.create_table("g_t", TableConfig(duplicates=True))
    row = lambda key, x, v: spark.createDataFrame([(key, x, x, "", v, v, "TUPLE")], "key string, lo_0 double, hi_0 double, data string, version_ts long, received_ts long, kind string")
    c.put("g_t", row("a", 1.0, 10))
    c.update("g_t", row("a", 2.0, 20))
    c.update("g_t", row("b", 3.0, 5))
    assert sorted((r.key, r.version_ts, r.kind) for r in c.table("g_t").collect()) == [("a", 10, "TUPLE"), ("a", 19, "DELETE"), ("a", 20, "TUPLE"), ("b", 5, "TUPLE")]
    before = c._data("g_t")
    c.compact("g_t")
    assert c._data("g_t") != before and c.table("g_t").count() == 4
    c.put_streaming_only("g_t", row("live", 4.0, 30))
    assert c.table("g_t").where("key = 'live'").count() == 0
    assert [r.key for r in run_available(c.stream("g_t"), "live").collect()] == ["live"]


def test_routing_by_enlarged_boxes(spark):
    from quadrille.functions.boxes import Box
    from quadrille.operators import partition, tuples

    regions = partition.StaticGrid(Box.of(0, 30), (10.0,)).regions()
    t = tuples.to_tuples(spark.createDataFrame([(1, 9.5), (2, 15.0)], "id int, x double"), "id", ["x"], F.lit(0))
    got = {(r.key, r.region_id, r.lo_0) for r in partition.assign(t, regions, 1.0).collect()}
    assert got == {("1", 0, 9.5), ("1", 1, 9.5), ("2", 1, 15.0)}
    assert {(r.key, r.region_id) for r in partition.StaticGrid(Box.of(0, 30), (10.0,)).assign(t).collect()} == {("1", 0), ("2", 1)}


def test_fields_are_computed_once_a_row(spark):
    from quadrille.plans import format_queries, registry  # noqa: F401  the first adds its queries to the second

    for name, times in (("format_tpch_lineitem", 2), ("format_yellowtaxi_range", 2), ("format_berlinmod", 2)):
        text = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("split(") == 1 and text.count("gettimestamp(") == times


def test_taxi_lines_are_parsed_as_before(spark):
    good = "1,2020-01-01 00:00:10,2020-01-01 00:00:05,1,2.5,3.5,-1,1,N,2,4,2" + ",0" * 7
    lines = spark.createDataFrame([(1, good), (2, "VendorID,a,b"), (3, good.replace("3.5", "x")), (4, good.replace("2020-01-01 00:00:05", "?"))], "line_no long, value string")
    (r,) = formats.read_tuples(lines, "yellowtaxi_range").collect()
    assert (r.key, r.lo_0, r.hi_0, r.lo_1, r.hi_1, r.hi_2 - r.lo_2, r.data) == ("1", 2.0, 3.5, -1.0, 4.0, 5000.0, good)
