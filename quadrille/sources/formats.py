"""Line formats: text lines ``line_no, value`` to tuples.

Lines that a format cannot read are skipped, as are headers. ``FORMATS`` names them all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrille.operators.tuples import now_us

FEATURE = "id string, geometry struct<type:string, coordinates:string>, properties map<string,string>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their 1-based numbers: each partition's offset is the sum of those before."""
    raw = spark.read.text(path).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    counts = {r["_part"]: r["n"] for r in raw.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    offset, offsets = 0, {}
    for p in sorted(counts):
        offsets[p] = offset
        offset += counts[p]
    if not offsets:
        return raw.select(F.lit(0).cast("long").alias("line_no"), "value")
    start = F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv))[F.col("_part")]
    return raw.select((F.col("_at") + start + 1).cast("long").alias("line_no"), "value")


def _tuples(lines: DataFrame, axes: list, key: Column | None = None, data: Column | None = None, version: Column | None = None, ok: Column | None = None) -> DataFrame:
    bounds = []
    for d, axis in enumerate(axes):
        lo, hi = axis if isinstance(axis, tuple) else (axis, axis)
        bounds += [lo.cast("double").alias(f"lo_{d}"), hi.cast("double").alias(f"hi_{d}")]
    key = F.col("line_no").cast("string") if key is None else key
    version = now_us() if version is None else version
    names = ["key", *(f"{k}_{d}" for d in range(len(axes)) for k in ("lo", "hi")), "version_ts"]
    read = _once(lines, F.struct(key.alias("key"), *bounds, version.cast("long").alias("version_ts"), (F.lit(True) if ok is None else ok).alias("ok")), "_row")
    kept = read.where(F.col("_row")["ok"])
    for c in names[:-1]:
        kept = kept.where(F.col("_row")[c].isNotNull())
    of = {c: F.col("_row")[c].alias(c) for c in names}
    return kept.select(*(of[c] for c in names[:-1]), (F.col("value") if data is None else data).alias("data"), of["version_ts"], now_us().alias("received_ts"), F.lit("TUPLE").alias("kind"))


def _once(df: DataFrame, c: Column, name: str) -> DataFrame:
    """A column that is computed once a row, however often it is used: as a generator's output, neither
    filters nor projections above repeat its expression."""
    return df.select("*", F.explode(F.array(c)).alias(name))


def _split(lines: DataFrame, sep: str = ",") -> DataFrame:
    return _once(lines, F.split("value", sep), "_fields")


def _field(i: int) -> Column:
    return F.get("_fields", F.lit(i))


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _time(c: Column, pattern: str) -> Column:
    return F.try_to_timestamp(c, F.lit(pattern))


def _parsed(lines: DataFrame, **values: Column) -> DataFrame:
    """Values that are used several times, computed once a row."""
    out = _once(lines, F.struct(*(c.alias(k) for k, c in values.items())), "_values")
    return out.select("*", *(F.col("_values")[k].alias(k) for k in values))


def _ends(a: Column, b: Column) -> tuple[Column, Column]:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)), F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


# GeoJSON ------------------------------------------------------------------------------------------


def _points(coordinates: Column) -> Column:
    """Numbers of the coordinates text, as an array of points; of polygons, all rings."""
    pairs = F.regexp_extract_all(coordinates, F.lit(r"\[\s*(-?[0-9.eE+-]+\s*,\s*-?[0-9.eE+-]+)[^\[\]]*\]"), F.lit(1))
    return F.transform(pairs, lambda p: F.struct(F.split(p, ",")[0].try_cast("double").alias("x"), F.split(p, ",")[1].try_cast("double").alias("y")))


def _geo(lines: DataFrame) -> DataFrame:
    parsed = _once(lines, F.from_json("value", FEATURE), "g")
    return _once(parsed, _points(F.col("g.geometry.coordinates")), "points")


def _geo_axes() -> list:
    """Coordinates are swapped: the second of each point is the first axis."""
    of = lambda c: F.transform("points", lambda p: p[c])
    return [(F.array_min(of("y")), F.array_max(of("y"))), (F.array_min(of("x")), F.array_max(of("x")))]


def geojson(lines: DataFrame) -> DataFrame:
    update = F.col("g.properties")["UpdateTimestamp"].try_cast("long")
    return _tuples(_geo(lines), _geo_axes(), key=F.coalesce(F.col("g.id"), F.col("line_no").cast("string")), version=F.coalesce(update, now_us()), ok=F.size("points") > 0)


def au_transport(lines: DataFrame) -> DataFrame:
    """Keyed by trip, else route; seconds become microseconds."""
    p = F.col("g.properties")
    key = F.replace(F.coalesce(p["TripID"], p["RouteID"]), F.lit(" "), F.lit("_"))
    return _tuples(_geo(lines), _geo_axes(), key=key, version=F.coalesce(p["Timestamp"].try_cast("long") * 1_000_000, now_us()), ok=F.size("points") > 0)


def _line_feature(id_: Column, points: list[tuple[Column, Column]], props: dict[str, Column]) -> Column:
    pair = lambda p: F.concat(F.lit("["), p[0].cast("string"), F.lit(","), p[1].cast("string"), F.lit("]"))
    shape = pair(points[0]) if len(points) == 1 else F.concat(F.lit("["), F.concat_ws(",", *map(pair, points)), F.lit("]"))
    kind = "Point" if len(points) == 1 else "LineString"
    properties = F.to_json(F.create_map(*(x for k, v in props.items() for x in (F.lit(k), v))))
    return F.concat(F.lit('{"type":"Feature","id":'), id_, F.lit(f',"geometry":{{"type":"{kind}","coordinates":'), shape, F.lit('},"properties":'), properties, F.lit("}"))


# Separated values -----------------------------------------------------------------------------------


def _bounds(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: x.try_cast("double"))


def _synthetic(dimensions: int, at: int, keyed: bool):
    def read(lines: DataFrame) -> DataFrame:
        lines = _once(lines, F.split("value", " ", at + 2), "_fields")
        lines, b = _once(lines, _bounds(_field(at)), "_bounds"), F.col("_bounds")
        axes = [(F.get(b, F.lit(2 * d)), F.get(b, F.lit(2 * d + 1))) for d in range(dimensions)]
        return _tuples(lines, axes, key=_field(0) if keyed else None, data=_field(at + 1), ok=F.size(b) == 2 * dimensions)

    return read


def synthetic(lines: DataFrame, dimensions: int = 2) -> DataFrame:
    return _synthetic(dimensions, 0, False)(lines)


def synthetic_stream(lines: DataFrame, dimensions: int = 2) -> DataFrame:
    return _synthetic(dimensions, 1, True)(lines)


_TAXI_TIME = "yyyy-MM-dd HH:mm:ss"


def yellowtaxi_point(lines: DataFrame) -> DataFrame:
    at = F.unix_millis(_time(_field(1), _TAXI_TIME))
    return _tuples(_split(lines), [_number(_field(5)), _number(_field(6)), at], ok=_field(0) != "VendorID")


def yellowtaxi_range(lines: DataFrame) -> DataFrame:
    when = lambda i: F.unix_millis(_time(_field(i), _TAXI_TIME))
    values = {f"_n{i}": _number(_field(i)) for i in (5, 6, 9, 10)} | {f"_n{i}": when(i) for i in (1, 2)}
    n = lambda i: F.col(f"_n{i}")
    return _tuples(_parsed(_split(lines), **values), [_ends(n(5), n(9)), _ends(n(6), n(10)), _ends(n(1), n(2))], ok=_field(0) != "VendorID")


def _day(i: int) -> Column:
    return F.unix_millis(_time(_field(i), "yyyy-MM-dd"))


def tpch_lineitem_point(lines: DataFrame) -> DataFrame:
    return _tuples(_split(lines, r"\|"), [_day(10)])


def tpch_lineitem_range(lines: DataFrame) -> DataFrame:
    days = _parsed(_split(lines, r"\|"), _receipt=_day(10), _ship=_day(12))
    return _tuples(days, [_ends(F.col("_receipt"), F.col("_ship"))])


def tpch_order_point(lines: DataFrame) -> DataFrame:
    return _tuples(_split(lines, r"\|"), [_day(4)])


def _rome(lines: DataFrame) -> DataFrame:
    local = F.to_timestamp_ntz(F.replace(F.regexp_replace(_field(1), r"\+01", ""), F.lit(" "), F.lit("T")))
    at = F.unix_millis(F.convert_timezone(F.lit("Europe/Berlin"), F.lit("UTC"), local).cast("timestamp"))
    p = lambda i: _number(F.regexp_extract(_field(2), r"POINT\(([-0-9.eE]+) ([-0-9.eE]+)\)", i))
    return _parsed(_split(lines, ";"), taxi=_field(0), at=at, a=p(1), b=p(2))


def rome_taxi_point(lines: DataFrame) -> DataFrame:
    return _tuples(_rome(lines), [F.col("at"), F.col("a"), F.col("b")])


def rome_taxi_range(lines: DataFrame) -> DataFrame:
    """From each fix of a taxi to its next; the first fix gives nothing."""
    w = W.partitionBy("taxi").orderBy("line_no")
    moved = _rome(lines).withColumns({f"p_{c}": F.lag(c).over(w) for c in ("at", "a", "b")})
    return _tuples(moved, [_ends(F.col(f"p_{c}"), F.col(c)) for c in ("at", "a", "b")])


def nari_dynamic(lines: DataFrame) -> DataFrame:
    return _tuples(_split(lines), [_number(_field(8)), _number(_field(6)), _number(_field(7))], key=_field(0), ok=F.size("_fields") == 9)


def forex_1d(lines: DataFrame) -> DataFrame:
    return _tuples(_split(lines), [_number(_field(1))], ok=F.size("_fields") == 4)


def forex_2d(lines: DataFrame) -> DataFrame:
    """All digits after the minutes count as seconds, those of the milliseconds in real files too."""
    digits = F.regexp_extract(_field(0), r"^(\d{8} \d{4})\d+$", 1)
    at = _parsed(_split(lines), _at=F.unix_seconds(_time(digits, "yyyyMMdd HHmm")) + F.substring(_field(0), 14, 20).try_cast("long"))
    return _tuples(at, [F.col("_at"), _number(_field(1))], ok=F.size("_fields") == 4)


def berlinmod_player(lines: DataFrame) -> DataFrame:
    values = _parsed(_split(lines), _at=F.unix_millis(_time(_field(0), "dd-MM-yyyy HH:mm:ss")), _x=_number(_field(3)), _y=_number(_field(4)))
    at, x, y = (F.col(c) for c in ("_at", "_x", "_y"))
    data = _line_feature(_field(1), [(y, x)], {"MOID": _field(1), "TRIP": _field(2)})
    return _tuples(values, [y, x], key=_field(1), data=data, version=at, ok=(F.size("_fields") == 5) & at.isNotNull())


def berlinmod(lines: DataFrame) -> DataFrame:
    """Missing hours, minutes and seconds of a time are zero."""
    full = F.concat(F.rpad(_field(2), 10, " "), F.rpad(F.coalesce(F.nullif(F.substring(_field(2), 11, 9), F.lit("")), F.lit(" 00:00:00")), 9, ":00"))
    begin = F.unix_millis(F.coalesce(_time(_field(2), "yyyy-MM-dd HH:mm:ss"), _time(full, "yyyy-MM-dd HH:mm:ss")))
    values = _parsed(_split(lines), _begin=begin, **{f"_x{i}": _number(_field(i + 4)) for i in range(4)})
    x, begin = [F.col(f"_x{i}") for i in range(4)], F.col("_begin")
    data = _line_feature(_field(0), [(x[1], x[0]), (x[3], x[2])], {"TRIP": _field(1), "TSTART": _field(2), "TEND": _field(3)})
    return _tuples(values, [_ends(x[1], x[3]), _ends(x[0], x[2])], key=_field(0), data=data, version=begin, ok=(F.size("_fields") == 8) & begin.isNotNull())


#: Fields of the aircraft messages.
ADSB = {"callsign": 10, "altitude": 11, "speed": 12, "heading": 13, "latitude": 14, "longitude": 15, "vertical": 16}


def _aircraft(lines: DataFrame) -> DataFrame:
    """Each line with its aircraft's last known values up to it."""
    w = W.partitionBy("hex").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    value = lambda i: F.nullif(F.trim(_field(i)), F.lit(""))
    split = _parsed(_split(lines.where(F.startswith("value", F.lit("MSG,")))), **{"hex": _field(4), "type": _field(1), "at": F.unix_millis(_time(F.concat_ws(" ", _field(6), _field(7)), "yyyy/MM/dd HH:mm:ss.SSS")), **{f"v_{k}": value(i) for k, i in ADSB.items()}})
    return split.withColumns({k: F.last(f"v_{k}", ignorenulls=True).over(w) for k in ADSB})


def _adsb(lines: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    known = F.lit(True)
    for k in ADSB:
        known = known & F.col(k).isNotNull()
    data = _line_feature(F.conv("hex", 16, 10), [(F.col("longitude"), F.col("latitude"))], {k.capitalize(): F.col(k) for k in ADSB})
    return _tuples(_aircraft(lines), [_number(F.col(a)) for a in axes], key=F.col("callsign"), data=data, version=F.col("at") * 1000, ok=known & (F.col("type") == "4") & F.col("at").isNotNull())


def adsb(lines: DataFrame) -> DataFrame:
    """Values of an aircraft's messages are merged; its velocity messages give tuples once all are known."""
    return _adsb(lines, ("latitude", "longitude"))


def adsb3d(lines: DataFrame) -> DataFrame:
    return _adsb(lines, ("latitude", "longitude", "altitude"))


FORMATS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (geojson, synthetic, synthetic_stream, yellowtaxi_point, yellowtaxi_range, tpch_lineitem_point, tpch_lineitem_range, tpch_order_point, rome_taxi_point, rome_taxi_range, nari_dynamic, forex_1d, forex_2d, berlinmod_player, berlinmod, adsb, adsb3d, au_transport)}


def read_tuples(lines: DataFrame, name: str, padding: float = 0.0, **options) -> DataFrame:
    """Lines in a named format as tuples, their boxes padded except for the synthetic formats."""
    from quadrille.functions.boxes import dimensions_of, padded

    if name not in FORMATS:
        raise ValueError(f"unknown format: {name}")
    out = FORMATS[name](lines, **options)
    return out.withColumns(padded(dimensions_of(out), padding)) if padding and not name.startswith("synthetic") else out


def sample_lines(lines: DataFrame, percent: float, seed: int = 1) -> DataFrame:
    return lines.sample(percent / 100, seed)


def offline_time_filter(lines: DataFrame, begin: int, end: int) -> DataFrame:
    """GeoJSON lines whose ``Timestamp`` property lies between, both ends excluded."""
    ts = F.from_json("value", FEATURE)["properties"]["Timestamp"].try_cast("long")
    return lines.where((ts > begin) & (ts < end))
