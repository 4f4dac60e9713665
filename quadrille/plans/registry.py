"""The registered queries on the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import boxes as B
from quadrille.functions.boxes import Box
from quadrille.functions.scalars import isotone, parse_or, round_half_up
from quadrille.operators import joins, partition, queries, stats, tuples, versions
from quadrille.operators.filters import Filter
from quadrille.operators.versions import TableConfig
from quadrille.plans.continuous import QueryPlanBuilder
from quadrille.sources import formats
from quadrille.sources.tables import working_folder
from quadrille.streaming import continuous

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TIES = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def us(c: str) -> Column:
    """Microseconds of a timestamp without zone, whatever the session's zone."""
    t = F.col(c)
    days = F.datediff(F.to_date(t), F.lit("1970-01-01")).cast("long")
    return days * 86_400_000_000 + (F.hour(t) * 3600 + F.minute(t) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def days(c: str) -> Column:
    return F.datediff(F.to_date(F.col(c)), F.lit("1970-01-01"))


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lineitem(spark: SparkSession, d: str) -> DataFrame:
    """(quantity, discount, ship day) points, keyed by order, versioned by ship time."""
    return tuples.to_tuples(read(spark, d, "lineitem"), "l_orderkey", ["l_quantity", "l_discount", days("l_shipdate")], us("l_shipdate"), data="l_returnflag", received=us("l_shipdate") + F.col("l_linenumber"), keep=tuple(TIES))


def events(spark: SparkSession, d: str, *axes) -> DataFrame:
    """Value points, keyed by user, versioned by time; ``event_id`` breaks ties."""
    return tuples.to_tuples(read(spark, d, "events"), "user_id", list(axes) or ["value"], us("ts"), data=F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('","properties":'), F.col("props"), F.lit("}")), keep=("event_id", "ts", "value"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    day = days("o_orderdate")
    return tuples.to_tuples(read(spark, d, "orders"), "o_orderkey", [("o_custkey", F.col("o_custkey") + 3), (day, day + 2)], us("o_orderdate"), data="o_orderpriority")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """The 2-d boxes of line items that the orders are joined with."""
    day = days("l_shipdate")
    t = tuples.to_tuples(read(spark, d, "lineitem"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), [("l_partkey", F.col("l_partkey") + 1), (day, day + 1)], us("l_shipdate"), data="l_returnflag", keep=("l_extendedprice",))
    return t


DAY = "date_diff('day', DATE '1970-01-01', {}::DATE)"
US = "epoch_us({})"
LDAY, ODAY = DAY.format("l_shipdate"), DAY.format("o_orderdate")
NEWEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, {', '.join(f'{c} DESC' for c in TIES)}) AS rn FROM lineitem) WHERE rn"
KEYS = "l_orderkey::VARCHAR AS key, l_linenumber, l_partkey, l_suppkey, l_quantity"
SHOW = ["key", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
UNIQUE = TableConfig(unique_keys=True)
ALL = TableConfig(duplicates=True)


# Range, key and time queries ----------------------------------------------------------------------


@query(f"SELECT {KEYS} FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def range_lineitem_1d(spark, d):
    return queries.range_query(tuples.to_tuples(read(spark, d, "lineitem"), "l_orderkey", ["l_quantity"], us("l_shipdate"), keep=tuple(TIES)), Box.of(10, 20), config=UNIQUE).select(SHOW)


@query(f"SELECT {KEYS} FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.06")
def range_lineitem_2d(spark, d):
    return queries.range_query(tuples.to_tuples(read(spark, d, "lineitem"), "l_orderkey", ["l_quantity", "l_discount"], us("l_shipdate"), keep=tuple(TIES)), Box.of(10, 20, 0.02, 0.06), config=UNIQUE).select(SHOW)


@query(f"SELECT {KEYS} FROM lineitem WHERE l_quantity BETWEEN 10 AND 30 AND l_discount BETWEEN 0.02 AND 0.06 AND {LDAY} BETWEEN 8766 AND 9495")
def range_lineitem_3d(spark, d):
    return queries.range_query(lineitem(spark, d), Box.of(10, 30, 0.02, 0.06, 8766, 9495), config=UNIQUE).select(SHOW)


@query(f"SELECT {KEYS} FROM ({NEWEST} = 1) WHERE l_quantity BETWEEN 10 AND 20")
def range_after_resolution(spark, d):
    t = lineitem(spark, d)
    return versions.newest(t, 1, TIES).where(B.meets_box(Box.of(10, 20, -1, 2, -1e6, 1e6))).select(SHOW)


@query(f"SELECT {KEYS} FROM ({NEWEST} = 1) WHERE l_orderkey = 77")
def key_lookup(spark, d):
    return queries.key_query(lineitem(spark, d), "77", ties=TIES).select(SHOW)


@query(f"SELECT {KEYS} FROM ({NEWEST} = 1)")
def newest_per_key(spark, d):
    return versions.resolve(lineitem(spark, d), ties=TIES).select(SHOW)


@query(f"SELECT {KEYS} FROM ({NEWEST} <= 2)")
def newest_n_versions(spark, d):
    return versions.resolve(lineitem(spark, d), TableConfig(duplicates=True, versions=2), ties=TIES).select(SHOW)


BASE, TTL = 904_608_000_000_000, 31_536_000_000_000


@query(f"SELECT {KEYS} FROM lineitem WHERE {US.format('l_shipdate')} >= {BASE} - {TTL}")
def ttl_versions(spark, d):
    return versions.resolve(lineitem(spark, d), TableConfig(duplicates=True, ttl_us=TTL), now=BASE).select(SHOW)


@query(f"SELECT {KEYS} FROM ({NEWEST} <= 2) WHERE {US.format('l_shipdate')} >= {BASE} - {TTL}")
def ttl_then_versions(spark, d):
    return versions.resolve(lineitem(spark, d), TableConfig(duplicates=True, ttl_us=TTL, versions=2), now=BASE, ties=TIES).select(SHOW)


@query(f"SELECT {KEYS} FROM lineitem")
def keep_all_versions(spark, d):
    return versions.resolve(lineitem(spark, d), ALL).select(SHOW)


@query(f"SELECT {KEYS} FROM ({NEWEST} = 1) WHERE {US.format('l_shipdate')} > {BASE}")
def version_time(spark, d):
    return queries.version_time_query(lineitem(spark, d), BASE, ties=TIES).select(SHOW)


@query(f"SELECT {KEYS} FROM ({NEWEST} = 1) WHERE {US.format('l_shipdate')} + l_linenumber > {BASE}")
def insert_time(spark, d):
    return queries.insert_time_query(lineitem(spark, d), BASE, ties=TIES).select(SHOW)


@query(f"SELECT {KEYS} FROM ({NEWEST} = 1) WHERE l_quantity BETWEEN 10 AND 30 AND l_discount BETWEEN 0 AND 0.05 AND {US.format('l_shipdate')} + l_linenumber > {BASE}")
def range_and_time(spark, d):
    return queries.range_and_time_query(lineitem(spark, d), Box.of(10, 30, 0, 0.05, -1e6, 1e6), BASE, ties=TIES).select(SHOW)


@query("SELECT event_id, value FROM events WHERE value BETWEEN 50 AND 200 AND user_id = 7")
def range_key_udf(spark, d):
    return queries.range_query(events(spark, d), Box.of(50, 200), [Filter("key", "7")], ALL).select("event_id", "value")


@query("SELECT event_id, value FROM events WHERE value BETWEEN 50 AND 200 AND contains(event_type, 'c')")
def range_string_udf(spark, d):
    t = tuples.to_tuples(read(spark, d, "events"), "user_id", ["value"], us("ts"), data="event_type", keep=("event_id", "value"))
    return queries.range_query(t, Box.of(50, 200), [Filter("contains", "c")], ALL).select("event_id", "value")


@query("SELECT event_id, value FROM events WHERE value BETWEEN 50 AND 200 AND json_extract_string(props, '$.k') = '3'")
def range_property_udf(spark, d):
    return queries.range_query(events(spark, d), Box.of(50, 200), [Filter("property", "k:3")], ALL).select("event_id", "value")


# Joins ----------------------------------------------------------------------------------------------

JOIN_FROM = f"""
(SELECT o_orderkey::VARCHAR AS lk, o_custkey AS a0, o_custkey + 3 AS a1, {ODAY} AS b0, {ODAY} + 2 AS b1, o_orderpriority FROM orders) o
JOIN (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS rk, l_partkey AS c0, l_partkey + 1 AS c1, {LDAY} AS d0, {LDAY} + 1 AS d1, l_returnflag, l_extendedprice FROM lineitem) l
ON a0 <= c1 AND c0 <= a1 AND b0 <= d1 AND d0 <= b1"""
PAIR = ["l_key", "r_key", "r_l_extendedprice", "lo_0", "hi_0", "lo_1", "hi_1"]
PAIR_SQL = "lk AS l_key, rk AS r_key, l_extendedprice AS r_l_extendedprice, least(a0, c0)::DOUBLE AS lo_0, greatest(a1, c1)::DOUBLE AS hi_0, least(b0, d0)::DOUBLE AS lo_1, greatest(b1, d1)::DOUBLE AS hi_1"
QUERY_BOX = Box.of(50, 900, 8500, 10000)
IN_BOX = "a0 <= 900 AND a1 >= 50 AND b0 <= 10000 AND b1 >= 8500 AND c0 <= 900 AND c1 >= 50 AND d0 <= 10000 AND d1 >= 8500"


@query(f"SELECT {PAIR_SQL} FROM {JOIN_FROM}")
def spatial_join_2way(spark, d):
    return joins.spatial_join(orders(spark, d), lines(spark, d)).select(PAIR)


@query(f"SELECT {PAIR_SQL} FROM {JOIN_FROM} WHERE {IN_BOX}")
def spatial_join_with_query_box(spark, d):
    return joins.spatial_join(orders(spark, d), lines(spark, d), QUERY_BOX).select(PAIR)


@query(f"SELECT {PAIR_SQL} FROM {JOIN_FROM} WHERE contains(o_orderpriority, 'R') AND contains(l_returnflag, 'R')")
def spatial_join_udf(spark, d):
    return joins.spatial_join(orders(spark, d), lines(spark, d), Box(), [Filter("contains", "R")]).select(PAIR)


@query(f"""SELECT lk AS t1_key, rk AS t2_key, event_id AS t3_event_id, least(least(a0, c0), e0)::DOUBLE AS lo_0, greatest(greatest(a1, c1), e0 + 1)::DOUBLE AS hi_0
FROM {JOIN_FROM} JOIN (SELECT event_id, user_id * 5 AS e0, 8036 + event_id % 2400 AS e1 FROM events) e
ON least(a0, c0) <= e0 + 1 AND e0 <= greatest(a1, c1) AND least(b0, d0) <= e1 AND e1 <= greatest(b1, d1)""")
def spatial_join_3way(spark, d):
    day = F.lit(8036) + F.col("event_id") % 2400
    third = tuples.to_tuples(read(spark, d, "events"), "user_id", [(F.col("user_id") * 5, F.col("user_id") * 5 + 1), day], us("ts"), keep=("event_id",))
    return joins.multi_join([orders(spark, d), lines(spark, d), third]).select("t1_key", "t2_key", "t3_event_id", "lo_0", "hi_0")


@query(f"SELECT DISTINCT lk AS l_key, rk AS r_key FROM {JOIN_FROM}")
def join_dedup(spark, d):
    return joins.distinct_pairs(joins.spatial_join(orders(spark, d), lines(spark, d)), "keys").select("l_key", "r_key")


@query("""SELECT o_orderkey AS a, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS b FROM orders JOIN lineitem
ON o_totalprice <= l_extendedprice + 0.5 AND l_extendedprice <= o_totalprice + 0.5""")
def interval_join_orders_lineitem(spark, d):
    """Intervals of prices: each order with the line items that cost about as much."""
    o = tuples.to_tuples(read(spark, d, "orders"), "o_orderkey", [("o_totalprice", F.col("o_totalprice") + 0.5)], F.lit(0), keep=("o_orderkey",))
    li = tuples.to_tuples(read(spark, d, "lineitem"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), [("l_extendedprice", F.col("l_extendedprice") + 0.5)], F.lit(0))
    return joins.overlap_join(o, li).select(F.col("l_o_orderkey").alias("a"), F.col("r_key").alias("b"))


# Box algebra ----------------------------------------------------------------------------------------


@query("SELECT min(l_quantity) AS lo_0, max(l_quantity) AS hi_0, min(l_discount) AS lo_1, max(l_discount) AS hi_1, min({0})::DOUBLE AS lo_2, max({0})::DOUBLE AS hi_2 FROM lineitem".format(LDAY))
def covering_box(spark, d):
    return B.cover_of(lineitem(spark, d))


OBOX = f"(SELECT o_orderkey::VARCHAR AS key, o_custkey::DOUBLE AS a0, (o_custkey + 3)::DOUBLE AS a1, {ODAY}::DOUBLE AS b0, ({ODAY} + 2)::DOUBLE AS b1 FROM orders)"


def box_query(name: str, sql: str, make: Callable[[DataFrame], DataFrame]) -> None:
    f = lambda spark, d: make(orders(spark, d))
    f.__name__ = name
    query(sql)(f)


BOUNDS = ["key", "lo_0", "hi_0", "lo_1", "hi_1"]
box_query("box_volume", f"SELECT key, (a1 - a0) * (b1 - b0) AS volume FROM {OBOX}", lambda t: t.select("key", B.volume(2).alias("volume")))
FIXED = {"q_lo_0": 100.0, "q_hi_0": 400.0, "q_lo_1": 8500.0, "q_hi_1": 9500.0}


def with_fixed(t: DataFrame) -> DataFrame:
    return t.withColumns({k: F.lit(v) for k, v in FIXED.items()})


MEET = "a0 <= 400 AND a1 >= 100 AND b0 <= 9500 AND b1 >= 8500"
box_query("box_intersection", f"SELECT key, CASE WHEN {MEET} THEN greatest(a0, 100) END AS lo_0, CASE WHEN {MEET} THEN least(a1, 400) END AS hi_0, CASE WHEN {MEET} THEN greatest(b0, 8500) END AS lo_1, CASE WHEN {MEET} THEN least(b1, 9500) END AS hi_1 FROM {OBOX}", lambda t: with_fixed(t).select("key", *(c.alias(k) for k, c in B.intersection(2, "", "q_").items())))
box_query("box_covers", f"SELECT key, 100 <= a0 AND 400 >= a1 AND 8500 <= b0 AND 9500 >= b1 AS covered, (100 <= a0 AND 400 >= a1) OR (8500 <= b0 AND 9500 >= b1) AS in_some FROM {OBOX}", lambda t: with_fixed(t).select("key", B.covers(2, "q_", "").alias("covered"), B.covered_in_some_dimension(2, "q_", "").alias("in_some")))
box_query("box_enlargement", f"SELECT key, CASE WHEN a0 <= 100 AND a1 >= 400 AND b0 <= 8500 AND b1 >= 9500 THEN 0.0 ELSE (greatest(a1, 400) - least(a0, 100)) * (greatest(b1, 9500) - least(b0, 8500)) - (a1 - a0) * (b1 - b0) END AS growth FROM {OBOX}", lambda t: with_fixed(t).select("key", B.enlargement(2, "", "q_").alias("growth")))
box_query("enlarge_amount", f"SELECT key, a0 - 5.0 AS lo_0, a1 + 5.0 AS hi_0, b0 - 5.0 AS lo_1, b1 + 5.0 AS hi_1 FROM {OBOX}", lambda t: t.withColumns(B.padded(2, 5.0)).select(BOUNDS))
box_query("enlarge_padding", f"SELECT key, a0 - 1.0 AS lo_0, a1 + 1.0 AS hi_0, b0 - 2.0 AS lo_1, b1 + 2.0 AS hi_1 FROM {OBOX}", lambda t: t.withColumns(B.padded(2, 1.0, 2.0)).select(BOUNDS))
box_query("enlarge_factor", f"SELECT key, a0 - (a1 - a0) AS lo_0, a1 + (a1 - a0) AS hi_0, b0 - (b1 - b0) AS lo_1, b1 + (b1 - b0) AS hi_1 FROM {OBOX}", lambda t: t.withColumns(B.enlarged_by_factor(2, 3.0)).select(BOUNDS))
box_query("scale_volume", f"SELECT key, a0 - (a1 - a0) / 2 AS lo_0, a1 + (a1 - a0) / 2 AS hi_0, b0 - (b1 - b0) / 2 AS lo_1, b1 + (b1 - b0) / 2 AS hi_1 FROM {OBOX}", lambda t: t.withColumns(B.scaled(2, 4.0)).select(BOUNDS))
box_query("box_as_text", f"SELECT key, '[[' || a0 || ',' || a1 || ']:[' || b0 || ',' || b1 || ']]' AS box FROM {OBOX}", lambda t: t.select("key", B.box_text(2).alias("box")))


@query("""SELECT user_id, event_id, round(la - 100.0 * abs(360 / (cos(la * pi() / 180) * 6371000.0)) / 2.0, 9) AS lo_0, round(la + 100.0 * abs(360 / (cos(la * pi() / 180) * 6371000.0)) / 2.0, 9) AS hi_0,
round(lo - 60.0 * (360 / 6356800.0) / 2.0, 9) AS lo_1, round(lo + 60.0 * (360 / 6356800.0) / 2.0, 9) AS hi_1 FROM (SELECT *, value / 10 AS la, value / 5 AS lo FROM events)""")
def enlarge_metres(spark, d):
    t = tuples.to_tuples(read(spark, d, "events"), "user_id", [F.col("value") / 10, F.col("value") / 5], us("ts"), keep=("event_id", "user_id"))
    out = t.withColumns(B.enlarged_by_metres(100, 60))
    return out.select("user_id", "event_id", *(F.round(c, 9).alias(c) for c in ("lo_0", "hi_0", "lo_1", "hi_1")))


@query("""SELECT p_partkey, floor(p_retailprice * 10 + 0.5) / 10 AS rounded, coalesce(TRY_CAST(substr(p_brand, 7) AS BIGINT), -1) AS brand,
list_sum(list_transform(range(3), lambda i: (strpos('0123456789abcdefghijklmnopqrstuvwxyz', lower(substr(p_name, i::INT + 1, 1))) - 1) * (256 ** (2 - i))::BIGINT))::BIGINT AS isotone FROM part WHERE length(p_name) >= 3""")
def scalar_functions(spark, d):
    p = read(spark, d, "part").where(F.length("p_name") >= 3)
    return p.select("p_partkey", round_half_up(F.col("p_retailprice"), 1).alias("rounded"), parse_or(F.substring("p_brand", 7, 100), "long", -1).alias("brand"), isotone(F.col("p_name")).alias("isotone"))


# Cells, regions and statistics ----------------------------------------------------------------------

CELLS = f"SELECT cell_0, cell_1, count(*) AS n FROM (SELECT unnest(generate_series(floor(a0 / 50)::BIGINT, floor(a1 / 50)::BIGINT)) AS cell_0, b0, b1 FROM {OBOX}), LATERAL (SELECT unnest(generate_series(floor(b0 / 100)::BIGINT, floor(b1 / 100)::BIGINT)) AS cell_1) GROUP BY ALL"


@query(CELLS)
def cell_histogram(spark, d):
    return stats.cell_histogram(orders(spark, d), [50.0, 100.0])


@query(f"SELECT count(*) AS regions, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS deviation FROM ({CELLS})")
def cell_balance(spark, d):
    b = stats.balance(stats.cell_histogram(orders(spark, d), [50.0, 100.0]))
    return b.withColumns({c: F.round(c, 6) for c in ("mean", "deviation")})


@query("SELECT region_id, count(*) AS n FROM (SELECT least(floor(value / 25), 19)::BIGINT * 5 + floor((event_id % 100) / 20)::BIGINT AS region_id FROM events WHERE value <= 500) GROUP BY 1")
def static_grid_assign(spark, d):
    grid = partition.StaticGrid.parse("[[0,500]:[0,100]];25;20")
    t = tuples.to_tuples(read(spark, d, "events").where("value <= 500"), "user_id", ["value", F.col("event_id") % 100], us("ts"))
    return grid.assign(t).groupBy("region_id").agg(F.count("*").alias("n"))


@query("SELECT region_id, count(*) AS n FROM (SELECT (CASE WHEN value >= 256 THEN 8 ELSE 0 END + CASE WHEN y >= 64 THEN 4 ELSE 0 END + CASE WHEN value % 256 >= 128 THEN 2 ELSE 0 END + CASE WHEN y % 64 >= 32 THEN 1 ELSE 0 END)::BIGINT AS region_id FROM (SELECT value, event_id % 128 AS y FROM events WHERE value < 512)) GROUP BY 1")
def quad_assign(spark, d):
    t = tuples.to_tuples(read(spark, d, "events").where("value < 512"), "user_id", ["value", F.col("event_id") % 128], us("ts"))
    return partition.assign(t, partition.QuadTree(2).regions([], Box.of(0, 512, 0, 128))).groupBy("region_id").agg(F.count("*").alias("n"))


@query(None)
def kd_sampled_balance(spark, d):
    t = lineitem(spark, d)
    regions = partition.prepartition(t, 16, 0.2, 1, Box.of(-1, 60, -1, 1, 0, 20_000))
    return stats.balance(partition.assign(t, regions).groupBy("region_id").agg(F.count("*").alias("n")))


@query("SELECT max(n) AS most, max(n) / 5.0 AS rate FROM (SELECT floor(epoch_us(ts) / 5000000) AS b, count(*) AS n FROM events GROUP BY 1)")
def burst_rate(spark, d):
    return stats.burst_rate(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS moving_mean FROM events")
def moving_avg_5(spark, d):
    out = stats.moving_mean(read(spark, d, "events"), "value", ["ts", "event_id"], ["user_id"])
    return out.select("event_id", F.round("moving_mean", 6).alias("moving_mean"))


@query("SELECT count(*) AS n FROM events WHERE value BETWEEN 100 AND 200")
def range_count(spark, d):
    return queries.region_scan(events(spark, d), Box.of(100, 200)).agg(F.count("*").alias("n"))


# Formats --------------------------------------------------------------------------------------------


def as_lines(df: DataFrame, value: Column, no: str) -> DataFrame:
    return df.select(F.col(no).cast("long").alias("line_no"), value.alias("value"))


@query("SELECT event_id::VARCHAR AS key, value AS lo_0, value + 1 AS hi_0, user_id::DOUBLE AS lo_1, (user_id + 2)::DOUBLE AS hi_1, event_type AS data FROM events")
def format_synthetic(spark, d):
    e = read(spark, d, "events")
    text = F.concat(F.concat_ws(",", "value", F.col("value") + 1, "user_id", F.col("user_id") + 2), F.lit(" "), F.col("event_type"))
    return formats.read_tuples(as_lines(e, text, "event_id"), "synthetic").select("key", "lo_0", "hi_0", "lo_1", "hi_1", "data")


@query("SELECT 'u' || user_id AS key, value AS lo_0, value AS hi_0, event_type AS data FROM events")
def format_synthetic_stream(spark, d):
    e = read(spark, d, "events")
    text = F.concat(F.lit("u"), F.col("user_id"), F.lit(" "), F.concat_ws(",", "value", "value"), F.lit(" "), F.col("event_type"))
    return formats.read_tuples(as_lines(e, text, "event_id"), "synthetic_stream", dimensions=1).select("key", "lo_0", "hi_0", "data")


@query(f"SELECT o_orderkey::VARCHAR AS key, {ODAY} AS day FROM orders")
def format_tpch_order(spark, d):
    o = read(spark, d, "orders")
    text = F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority", F.lit("c"), F.lit("0"), F.lit("x"))
    out = formats.read_tuples(as_lines(o, text, "o_orderkey"), "tpch_order_point")
    return out.select("key", F.round(F.col("lo_0") / 86_400_000).cast("long").alias("day"))


@query(f"SELECT l_orderkey::VARCHAR AS key, {LDAY} AS first_day, {LDAY} + l_linenumber AS last_day FROM lineitem")
def format_tpch_lineitem(spark, d):
    li = read(spark, d, "lineitem")
    ship = F.date_format("l_shipdate", "yyyy-MM-dd")
    receipt = F.date_format(F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber")), "yyyy-MM-dd")
    text = F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", receipt, ship, ship, F.lit("a"), F.lit("b"), F.lit("c"))
    out = formats.read_tuples(as_lines(li, text, "l_orderkey"), "tpch_lineitem_range")
    day = lambda c: F.round(F.col(c) / 86_400_000).cast("long")
    return out.select("key", day("lo_0").alias("first_day"), day("hi_0").alias("last_day"))


@query(f"SELECT {KEYS} FROM ({NEWEST} = 1) WHERE l_orderkey % 10 <> 3")
def compact_table(spark, d):
    """Deletions of some keys, newer than all versions, hide them."""
    t = lineitem(spark, d)
    gone = tuples.tombstones(t.where("cast(key as long) % 10 = 3").select("key").distinct(), 3, F.lit(2**60))
    with_gone = t.unionByName(gone, allowMissingColumns=True)
    return versions.compact(spark, with_gone, working_folder(spark, "compact"), ties=TIES).select(SHOW)


# Continuous queries ---------------------------------------------------------------------------------

IN = "value BETWEEN 100 AND 200"
PLAN = QueryPlanBuilder("events").compare_with(Box.of(100, 200))


@query(f"SELECT user_id::VARCHAR AS key, epoch_us(ts) AS version_ts FROM events WHERE {IN}")
def continuous_range(spark, d):
    return continuous.continuous_range(events(spark, d), QueryPlanBuilder("events").compare_with(Box.of(100, 200)).build()).select("key", "version_ts")


@query(f"SELECT user_id::VARCHAR AS key, epoch_us(ts) AS version_ts FROM events WHERE NOT ({IN})")
def continuous_negative(spark, d):
    return continuous.continuous_range(events(spark, d), QueryPlanBuilder("events").compare_with(Box.of(100, 200)).report_negative().build()).select("key", "version_ts")


@query("SELECT user_id::VARCHAR AS key, epoch_us(ts) AS version_ts FROM events WHERE value + 10.0 >= 100 AND value - 10.0 <= 200 AND contains(event_type, 'c')")
def continuous_enlarged(spark, d):
    plan = QueryPlanBuilder("events").compare_with(Box.of(100, 200)).enlarge_stream_by_amount(10.0).add_stream_filter(Filter("contains", "c")).build()
    t = tuples.to_tuples(read(spark, d, "events"), "user_id", ["value"], us("ts"), data="event_type")
    return continuous.continuous_range(t, plan).select("key", "version_ts")


@query(f"""SELECT user_id::VARCHAR AS key, CASE WHEN m THEN 'TUPLE' ELSE 'INVALIDATION' END AS kind, count(*) AS n
FROM (SELECT user_id, {IN} AS m, lag({IN}) OVER (PARTITION BY user_id ORDER BY ts, {IN}) AS before FROM events) WHERE m OR before GROUP BY ALL""")
def continuous_range_invalidation(spark, d):
    plan = QueryPlanBuilder("events").compare_with(Box.of(100, 200)).receive_invalidations().build()
    return continuous.continuous_range(events(spark, d), plan).groupBy("key", "kind").agg(F.count("*").alias("n"))


@query(f"""SELECT event_id, o_orderkey::VARCHAR AS r_key FROM (SELECT event_id, user_id::DOUBLE * 5 AS x, 8036.0 + event_id % 2400 AS y FROM events) e
JOIN (SELECT o_orderkey, o_custkey AS a0, o_custkey + 3 AS a1, {ODAY} AS b0, {ODAY} + 2 AS b1 FROM orders) o ON x + 2.0 >= a0 AND x - 2.0 <= a1 AND y + 2.0 >= b0 AND y - 2.0 <= b1""")
def continuous_join(spark, d):
    t = events(spark, d, F.col("user_id") * 5, F.lit(8036) + F.col("event_id") % 2400)
    plan = QueryPlanBuilder("events").join_with("orders").enlarge_stream_by_amount(2.0).build()
    return continuous.continuous_join(t, orders(spark, d), plan, UNIQUE).select(F.col("l_event_id").alias("event_id"), "r_key")


def entry(spark: SparkSession, d: str) -> DataFrame:
    return range_lineitem_3d(spark, d)
