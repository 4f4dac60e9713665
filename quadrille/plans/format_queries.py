"""Registered queries of the line formats, continuous steps, GeoJSON filters and partitioners, with their SQL.

Importing this module adds them to the registry. Lines are made from the driver's tables and read by the format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.boxes import Box
from quadrille.operators import joins, partition, stats, tuples, versions
from quadrille.operators.filters import Filter
from quadrille.operators.versions import TableConfig
from quadrille.plans.continuous import QueryPlanBuilder
from quadrille.plans.registry import ODAY, UNIQUE, as_lines, events, orders, query, read, us
from quadrille.sources import formats
from quadrille.streaming import continuous

SECOND = "yyyy-MM-dd HH:mm:ss"
POINT = ["key", "lo_0", "hi_0", "lo_1", "hi_1"]


def text_of(ms: str, pattern: str = SECOND) -> Column:
    """A coordinate in milliseconds as local time, whatever the session's zone."""
    return F.date_format(F.timestamp_millis(F.col(ms).cast("long")), pattern)


def time(pattern: str = SECOND) -> Column:
    return F.date_format("ts", pattern)


def parsed(spark, d: str, name: str, value: Column, **options) -> DataFrame:
    return formats.read_tuples(as_lines(read(spark, d, "events"), value, "event_id"), name, **options)


def feature(id_: Column, x, y, properties: Column, kind: str = "Point") -> Column:
    at = F.concat(F.lit("["), F.col(x).cast("string") if isinstance(x, str) else x, F.lit(","), F.col(y).cast("string") if isinstance(y, str) else y, F.lit("]"))
    return F.concat(F.lit('{"type":"Feature","id":"'), id_, F.lit(f'","geometry":{{"type":"{kind}","coordinates":'), at, F.lit('},"properties":'), properties, F.lit("}"))


# Formats --------------------------------------------------------------------------------------------


@query("SELECT 'e' || event_id AS key, user_id::DOUBLE AS lo_0, user_id::DOUBLE AS hi_0, value AS lo_1, value AS hi_1, event_id * 10 AS version_ts FROM events")
def format_geojson(spark, d):
    """The second coordinate is the first axis."""
    value = feature(F.concat(F.lit("e"), F.col("event_id")), "value", "user_id", F.to_json(F.struct((F.col("event_id") * 10).cast("string").alias("UpdateTimestamp"))))
    return parsed(spark, d, "geojson", value).select(*POINT, "version_ts")


@query("SELECT 'T_' || user_id AS key, (user_id - 1)::DOUBLE AS lo_0, (user_id + 1)::DOUBLE AS hi_0, value AS lo_1, value + 1 AS hi_1, event_id * 1000000 AS version_ts FROM events")
def format_au_transport(spark, d):
    point = lambda x, y: F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]"))
    shape = F.concat(F.lit("["), point(F.col("value"), F.col("user_id") - 1), F.lit(","), point(F.col("value") + 1, F.col("user_id") + 1), F.lit("]"))
    properties = F.to_json(F.struct(F.concat(F.lit("T "), F.col("user_id")).alias("TripID"), F.col("event_id").cast("string").alias("Timestamp")))
    value = F.concat(F.lit('{"type":"Feature","geometry":{"type":"LineString","coordinates":'), shape, F.lit('},"properties":'), properties, F.lit("}"))
    return parsed(spark, d, "au_transport", value).select(*POINT, "version_ts")


TAXI = ["user_id", "event_id"]


def taxi() -> Column:
    end = F.date_format(F.col("ts") + F.expr("make_dt_interval(0, 0, 0, event_id % 60)"), SECOND)
    return F.concat_ws(",", F.lit("1"), time(), end, F.lit("1"), F.lit("2.5"), "value", "user_id", F.lit("1"), F.lit("N"), F.col("value") + 1, F.col("user_id") - 1, F.lit("2"), *[F.lit("0")] * 7)


@query("SELECT event_id::VARCHAR AS key, value AS lo_0, user_id::DOUBLE AS lo_1, strftime(ts, '%Y-%m-%d %H:%M:%S') AS picked_up FROM events")
def format_yellowtaxi_point(spark, d):
    return parsed(spark, d, "yellowtaxi_point", taxi()).select("key", "lo_0", "lo_1", text_of("lo_2").alias("picked_up"))


@query("SELECT event_id::VARCHAR AS key, value AS lo_0, value + 1 AS hi_0, (user_id - 1)::DOUBLE AS lo_1, user_id::DOUBLE AS hi_1, (1000 * (event_id % 60))::DOUBLE AS took FROM events")
def format_yellowtaxi_range(spark, d):
    out = parsed(spark, d, "yellowtaxi_range", taxi())
    return out.select("key", "lo_0", "hi_0", "lo_1", "hi_1", (F.col("hi_2") - F.col("lo_2")).alias("took"))


@query("SELECT l_orderkey::VARCHAR AS key, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS day FROM lineitem")
def format_tpch_lineitem_point(spark, d):
    ship = F.date_format("l_shipdate", "yyyy-MM-dd")
    value = F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", ship, ship, ship, F.lit("a"), F.lit("b"), F.lit("c"))
    out = formats.read_tuples(as_lines(read(spark, d, "lineitem"), value, "l_orderkey"), "tpch_lineitem_point")
    return out.select("key", F.round(F.col("lo_0") / 86_400_000).cast("long").alias("day"))


def rome() -> Column:
    at = F.concat(F.lit("POINT("), F.col("value").cast("string"), F.lit(" "), F.col("user_id").cast("string"), F.lit(")"))
    return F.concat_ws(";", "user_id", F.concat(time("yyyy-MM-dd HH:mm:ss.SSS"), F.lit("+01")), at)


@query("SELECT event_id::VARCHAR AS key, value AS lo_1, user_id::DOUBLE AS lo_2 FROM events")
def format_rome_point(spark, d):
    return parsed(spark, d, "rome_taxi_point", rome()).select("key", "lo_1", "lo_2")


@query("SELECT event_id::VARCHAR AS key, least(value, p) AS lo_1, greatest(value, p) AS hi_1, user_id::DOUBLE AS lo_2 FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NOT NULL")
def range_box_trajectory(spark, d):
    """A taxi's boxes from each fix to its next."""
    return parsed(spark, d, "rome_taxi_range", rome()).select("key", "lo_1", "hi_1", "lo_2")


@query("SELECT user_id::VARCHAR AS key, event_id::DOUBLE AS lo_0, value AS lo_1, (user_id + 0.5)::DOUBLE AS lo_2 FROM events")
def format_nari_dynamic(spark, d):
    value = F.concat_ws(",", "user_id", F.lit("0"), F.lit("0"), F.lit("0.1"), F.lit("13.1"), F.lit("36"), "value", F.col("user_id") + 0.5, "event_id")
    return parsed(spark, d, "nari_dynamic", value).select("key", "lo_0", "lo_1", "lo_2")


def forex() -> Column:
    """Quotes with milliseconds after the seconds, all 0."""
    return F.concat_ws(",", F.concat(time("yyyyMMdd HHmmss"), F.lit("000")), "value", F.col("value") + 1, F.lit("0"))


@query("SELECT event_id::VARCHAR AS key, value AS lo_0 FROM events")
def format_forex_1d(spark, d):
    return parsed(spark, d, "forex_1d", forex()).select("key", "lo_0")


@query("SELECT event_id::VARCHAR AS key, strftime(date_trunc('minute', ts) + to_seconds(1000 * second(ts)::BIGINT), '%Y-%m-%d %H:%M:%S') AS quoted, value AS lo_1 FROM events")
def format_forex_2d(spark, d):
    """All digits after the minutes count as seconds."""
    out = parsed(spark, d, "forex_2d", forex())
    return out.select("key", F.date_format(F.timestamp_seconds("lo_0"), SECOND).alias("quoted"), "lo_1")


@query("SELECT user_id::VARCHAR AS key, value + 1 AS lo_0, value AS lo_1, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def format_berlinmod_player(spark, d):
    value = F.concat_ws(",", time("dd-MM-yyyy HH:mm:ss"), "user_id", "event_id", "value", F.col("value") + 1)
    return parsed(spark, d, "berlinmod_player", value).select("key", "lo_0", "lo_1", text_of("version_ts").alias("at"))


@query("SELECT user_id::VARCHAR AS key, value + 1 AS lo_0, value + 3 AS hi_0, value AS lo_1, value + 2 AS hi_1, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def format_berlinmod(spark, d):
    value = F.concat_ws(",", "user_id", "event_id", time(), time(), "value", F.col("value") + 1, F.col("value") + 2, F.col("value") + 3)
    return parsed(spark, d, "berlinmod", value).select(*POINT, text_of("version_ts").alias("at"))


def aircraft() -> Column:
    """Clicks name an aircraft, views place it, purchases tell its speed; other events are noise."""
    blank = F.lit("")
    kind = F.when(F.col("event_type") == "click", "1").when(F.col("event_type") == "view", "3").when(F.col("event_type") == "purchase", "4").otherwise("8")
    on = lambda k, c: F.when(kind == k, c.cast("string")).otherwise(blank)
    day, hour = time("yyyy/MM/dd"), time("HH:mm:ss.SSS")
    known = [on("1", F.concat(F.lit("C"), F.col("event_id"))), on("3", F.col("event_id") + 0.5), on("4", F.col("value")), on("4", F.col("value")), on("3", F.col("value")), on("3", F.col("value") + 1), on("4", F.col("event_id"))]
    return F.concat_ws(",", F.lit("MSG"), kind, F.lit("1"), F.lit("1"), F.hex("user_id"), F.lit("1"), day, hour, day, hour, *known, *[blank] * 5)


KNOWN = """SELECT * FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN 'C' || event_id END IGNORE NULLS) OVER w AS key, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS lo_0,
last_value(CASE WHEN event_type = 'view' THEN event_id + 0.5 END IGNORE NULLS) OVER w AS altitude, strftime(ts, '%H:%M:%S') AS spoke FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
WHERE event_type = 'purchase' AND key IS NOT NULL AND lo_0 IS NOT NULL"""


@query(f"SELECT key, lo_0, lo_0 + 1 AS lo_1, spoke FROM ({KNOWN})")
def last_known_merge(spark, d):
    """An aircraft's messages merged: its last known values, at each message of its speed."""
    return parsed(spark, d, "adsb", aircraft()).select("key", "lo_0", "lo_1", F.date_format(F.timestamp_micros("version_ts"), "HH:mm:ss").alias("spoke"))


@query(f"SELECT key, lo_0, lo_0 + 1 AS lo_1, altitude::DOUBLE AS lo_2 FROM ({KNOWN})")
def format_adsb3d(spark, d):
    return parsed(spark, d, "adsb3d", aircraft()).select("key", "lo_0", "lo_1", "lo_2")


@query("SELECT event_id::VARCHAR AS key, value - 2.0 AS lo_0, value + 2.0 AS hi_0 FROM events")
def format_padding(spark, d):
    return parsed(spark, d, "forex_1d", forex(), padding=2.0).select("key", "lo_0", "hi_0")


@query("SELECT event_id FROM events WHERE event_id * 10 > 1000 AND event_id * 10 < 50000")
def offline_time_filter(spark, d):
    value = feature(F.concat(F.lit("e"), F.col("event_id")), "value", "user_id", F.to_json(F.struct((F.col("event_id") * 10).cast("string").alias("Timestamp"))))
    return formats.offline_time_filter(as_lines(read(spark, d, "events"), value, "event_id"), 1000, 50_000).select(F.col("line_no").alias("event_id"))


# Filters on geometries ------------------------------------------------------------------------------


def places(spark, d: str, kind: str) -> DataFrame:
    """Events of a kind as features on a coarse grid, in boxes that reach beyond their points."""
    x, y = F.floor(F.col("value") / 10).cast("double"), (F.col("user_id") % 10).cast("double")
    data = feature(F.col("event_id").cast("string"), x.cast("string"), y.cast("string"), F.col("props"))
    e = read(spark, d, "events").where(F.col("event_type") == kind)
    return tuples.to_tuples(e, "event_id", [(y - 0.6, y + 0.6), (x - 0.6, x + 0.6)], us("ts"), data=data, keep=("event_id",))


PLACES = "(SELECT event_id, floor(value / 10) AS x, user_id % 10 AS y, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = '{}')"
NEAR = f"SELECT a.event_id AS l_event_id, b.event_id AS r_event_id FROM {PLACES.format('click')} a JOIN {PLACES.format('view')} b ON "
SAME_POINT = "a.x = b.x AND a.y = b.y"


def near(spark, d: str, f: Filter) -> DataFrame:
    return joins.spatial_join(places(spark, d, "click"), places(spark, d, "view"), Box(), [f]).select("l_event_id", "r_event_id")


@query(NEAR + SAME_POINT)
def join_geojson_strict(spark, d):
    return near(spark, d, Filter("geojson_strict"))


@query(NEAR + SAME_POINT + " AND (a.k = '3' OR b.k = '3')")
def join_geojson_relaxed(spark, d):
    """Within five metres, and one of both has the property."""
    return near(spark, d, Filter("geojson", "k:3"))


@query(NEAR + SAME_POINT)
def join_geojson_simple(spark, d):
    return near(spark, d, Filter("geojson_simple"))


@query(f"SELECT event_id FROM {PLACES.format('click')} WHERE k = '3'")
def range_geojson_property(spark, d):
    from quadrille.operators import queries

    return queries.range_query(places(spark, d, "click"), Box(), [Filter("geojson", "k:3")], UNIQUE).select("event_id")


@query(f"SELECT event_id FROM {PLACES.format('click')} WHERE x BETWEEN 5 AND 20 AND y BETWEEN 2 AND 7")
def range_geojson_shape(spark, d):
    """Features in a polygon."""
    from quadrille.operators import queries

    square = '{"type":"Feature","id":"q","geometry":{"type":"Polygon","coordinates":[[[4.5,1.5],[20.5,1.5],[20.5,7.5],[4.5,7.5],[4.5,1.5]]]},"properties":{}}'
    return queries.range_query(places(spark, d, "click"), Box(), [Filter("geojson", square)], UNIQUE).select("event_id")


# Partitioners, statistics, versions -----------------------------------------------------------------


@query("""WITH s AS (SELECT s_acctbal AS b, row_number() OVER (ORDER BY s_acctbal) - 1 AS rn, count(*) OVER () AS n FROM supplier),
m AS (SELECT floor(b * 100000 + 0.5) / 100000 AS v FROM s WHERE rn = n // 2) SELECT (c_acctbal > v)::INT::BIGINT AS region_id, count(*) AS n FROM customer, m GROUP BY 1""")
def kd_assign(spark, d):
    """A k-d tree over the balances of all suppliers; customers are assigned to its regions."""
    some = [(r[0], r[0]) for r in read(spark, d, "supplier").select("s_acctbal").limit(partition.MOST_SAMPLES).collect()]
    regions = partition.KDTree(2).regions(some, Box.of(-1e9, 1e9))
    c = tuples.to_tuples(read(spark, d, "customer"), "c_custkey", ["c_acctbal"], F.lit(0))
    return partition.assign(c, regions).groupBy("region_id").agg(F.count("*").alias("n"))


@query("""SELECT region_id, count(*) AS n FROM (SELECT least(floor((event_id % 100) / 25), 3)::BIGINT * 2 + (value > 200)::INT AS region_id FROM events WHERE value BETWEEN 0 AND 500) GROUP BY 1""")
def dynamic_grid_assign(spark, d):
    """Slabs of 25 along the second axis, each split at the middle of the samples along the first."""
    grid = partition.DynamicGrid(Box.of(0, 500, 0, 100), (25.0,), 2)
    some = [(x, x, y, y) for x in (100.0, 200.0, 300.0) for y in (10.0, 35.0, 60.0, 85.0)]
    t = tuples.to_tuples(read(spark, d, "events").where("value between 0 and 500"), "user_id", ["value", F.col("event_id") % 100], us("ts"))
    return partition.assign(t, grid.regions(some)).groupBy("region_id").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM events WHERE value >= 100 AND value < 200.02 AND value <> 150.51")
def range_half_open(spark, d):
    """Two half-open boxes, without the point between them."""
    from quadrille.functions.boxes import Interval
    from quadrille.operators import queries

    e = events(spark, d)
    parts = [Box((Interval(100.0, 150.51, True, False),)), Box((Interval(150.51, 200.02, False, False),))]
    one, two = (queries.region_scan(e, b).select("event_id") for b in parts)
    return one.unionByName(two).agg(F.count("*").alias("n"))


@query("SELECT least(floor(value / 25), 19)::BIGINT AS region_id, count(*) AS tuples, min(value) AS lo_0, max(value) AS hi_0 FROM events WHERE value <= 500 GROUP BY 1")
def region_sizes(spark, d):
    t = tuples.to_tuples(read(spark, d, "events").where("value <= 500"), "user_id", ["value"], us("ts"))
    return stats.region_sizes(partition.assign(t, partition.StaticGrid.parse("[[0,500]];25").regions()))


@query("""SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def merge_runs(spark, d):
    """Two sorted runs as one table; the newest of each key stays."""
    t = events(spark, d)
    runs = [t.where(f"event_id % 2 = {k}").sortWithinPartitions("key", "version_ts") for k in (0, 1)]
    return versions.resolve(versions.merge_runs(*runs, config=TableConfig(duplicates=True)), ties=["event_id"]).select("event_id")


@query("""SELECT lk AS l_key, rk AS r_key FROM (SELECT o_orderkey::VARCHAR AS lk, o_custkey AS a0, o_custkey + 3 AS a1, {0} AS b0, {0} + 2 AS b1 FROM orders) o
JOIN (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS rk, l_partkey AS c0, l_partkey + 1 AS c1, {1} AS d0, {1} + 1 AS d1 FROM lineitem) l ON a0 <= c1 AND c0 <= a1 AND b0 <= d1 AND d0 <= b1""".format(ODAY, ODAY.replace("o_orderdate", "l_shipdate")))
def region_join(spark, d):
    """Both sides lie in the same regions, which cover all of both, and are joined region by region."""
    from quadrille.plans.registry import lines

    o, li = orders(spark, d), lines(spark, d)
    known = joins.measure(o, 2), joins.measure(li, 2)
    (x0, x1), (y0, y1) = ((min(k.low[d] for k in known), max(k.high[d] for k in known)) for d in (0, 1))
    grid = partition.StaticGrid(Box.of(x0, x1, y0, y1), (max(x1 - x0, 1.0), max(50.0, (y1 - y0) / 400)))
    return joins.region_join(grid.assign(o), grid.assign(li), grid.regions(), extents=known).select("l_key", "r_key")


# Continuous plans -----------------------------------------------------------------------------------


def reported(spark, d: str, build: QueryPlanBuilder, t: DataFrame | None = None) -> DataFrame:
    return continuous.continuous_range(events(spark, d) if t is None else t, build.build()).select("key", "version_ts")


def range_plan() -> QueryPlanBuilder:
    return QueryPlanBuilder("events").compare_with(Box.of(100, 200))


SEEN = "SELECT user_id::VARCHAR AS key, epoch_us(ts) AS version_ts FROM events WHERE "


@query(SEEN + "value BETWEEN 100 AND 200 AND user_id = 7")
def continuous_key_filter(spark, d):
    return reported(spark, d, range_plan().filter_stream_by_key("7"))


@query(SEEN + "value + 20.0 >= 100 AND value - 20.0 <= 200 AND value BETWEEN 90 AND 400")
def continuous_box_filter(spark, d):
    """The box is tested before the enlargement that follows it."""
    return reported(spark, d, range_plan().filter_stream_by_box(Box.of(90, 400)).enlarge_stream_by_amount(20.0))


@query(SEEN + "(value + 4) + 4.0 >= 100 AND value - 4.0 <= 200")
def continuous_factor(spark, d):
    t = events(spark, d, ("value", F.col("value") + 4))
    return reported(spark, d, range_plan().enlarge_stream_by_factor(3.0), t)


@query(SEEN + "value / 10 + 1000.0 * abs(360 / (cos(value / 10 * pi() / 180) * 6371000.0)) / 2.0 >= 10 AND value / 10 - 1000.0 * abs(360 / (cos(value / 10 * pi() / 180) * 6371000.0)) / 2.0 <= 20 AND user_id % 10 BETWEEN 2 AND 5")
def continuous_metres(spark, d):
    t = events(spark, d, F.col("value") / 10, F.col("user_id") % 10)
    return reported(spark, d, QueryPlanBuilder("events").compare_with(Box.of(10, 20, 2, 5)).enlarge_stream_by_metres(1000.0, 1.0), t)


@query(SEEN + "value BETWEEN 100 AND 200 AND json_extract_string(props, '$.k') = '3'")
def continuous_filter_step(spark, d):
    return reported(spark, d, range_plan().transform_stream_by_filter(Filter("property", "k:3")))


def with_watermarks(spark, d: str) -> DataFrame:
    """Events of which every fiftieth is followed by a watermark; its number counts those before."""
    e = events(spark, d).withColumn("generation", F.floor(F.col("event_id") / 50))
    marks = e.where("event_id % 50 = 49").withColumn("kind", F.lit(tuples.WATERMARK))
    return e.unionByName(marks)


@query("""SELECT 'TUPLE' AS kind, user_id::VARCHAR AS key, epoch_us(ts) AS version_ts FROM events WHERE value BETWEEN 100 AND 200
UNION ALL SELECT 'WATERMARK', user_id || '_events', epoch_us(ts) FROM events WHERE event_id % 50 = 49""")
def continuous_watermarks(spark, d):
    return continuous.continuous_range(with_watermarks(spark, d), range_plan().receive_watermarks().build()).select("kind", "key", "version_ts")


@query("""WITH e AS (SELECT user_id, ts, floor(event_id / 50)::BIGINT AS g, value BETWEEN 100 AND 200 AS m FROM events),
f AS (SELECT *, lag(m) OVER w AS before, lag(g) OVER w AS last, lead(g) OVER w AS next FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, g, m)),
top AS (SELECT count(*) AS marks FROM events WHERE event_id % 50 = 49)
SELECT user_id::VARCHAR AS key, sum((coalesce(before, false) AND g - coalesce(last, g) > 3)::INT + (m AND next IS NULL AND marks - g > 3)::INT)::BIGINT AS n
FROM f, top GROUP BY 1 HAVING n > 0""")
def idle_eviction(spark, d):
    """Keys that three watermarks passed in silence, those that never speak again among them."""
    plan = range_plan().receive_invalidations().invalidate_after_watermarks(3).build()
    out = continuous.continuous_range(with_watermarks(spark, d), plan)
    return out.where("kind = 'IDLE_REMOVED'").groupBy("key").agg(F.count("*").alias("n"))


@query(f"""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS v, (event_id % 40) * 5.0 AS x, 8036.0 + event_id % 2400 AS y FROM events),
p AS (SELECT DISTINCT user_id, v, o_orderkey::VARCHAR AS r FROM e JOIN (SELECT o_orderkey, o_custkey AS a0, o_custkey + 3 AS a1, {ODAY} AS b0, {ODAY} + 2 AS b1 FROM orders) o ON x + 9.0 >= a0 AND x - 9.0 <= a1 AND y + 9.0 >= b0 AND y - 9.0 <= b1),
s AS (SELECT user_id, v, list(r) FILTER (WHERE r IS NOT NULL) AS now FROM (SELECT user_id, v, NULL AS r FROM e UNION ALL SELECT * FROM p) GROUP BY ALL),
l AS (SELECT *, lag(now) OVER (PARTITION BY user_id ORDER BY v) AS before FROM s)
SELECT 'TUPLE' AS kind, user_id::VARCHAR AS key, unnest(now) AS partner, v AS version_ts FROM l
UNION ALL SELECT 'INVALIDATION', user_id::VARCHAR, unnest(list_filter(before, lambda q: NOT list_contains(coalesce(now, []), q))), v FROM l""")
def continuous_join_invalidation(spark, d):
    """Pairs of a stream and a table, and the partners that a key's next tuple no longer meets."""
    t = events(spark, d, (F.col("event_id") % 40) * 5, F.lit(8036) + F.col("event_id") % 2400)
    plan = QueryPlanBuilder("events").join_with("orders").enlarge_stream_by_amount(9.0).receive_invalidations().build()
    return continuous.continuous_join(t, orders(spark, d), plan, UNIQUE)
