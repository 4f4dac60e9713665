"""Continuous plans: builder, JSON, state machine, and streams against batches."""

import pytest
from pyspark.sql import functions as F

from quadrille.functions.boxes import Box
from quadrille.operators.filters import Filter
from quadrille.plans import registry
from quadrille.plans.continuous import ContinuousPlan, QueryPlanBuilder, enlargement_of
from quadrille.streaming import continuous as C

SF = "/root/testdata/sf0.001"


def test_builder_rules():
    q = lambda: QueryPlanBuilder("t")
    for bad in (q(), q().compare_with(Box.of(0, 1)).join_with("x"), q().join_with("x").report_negative()):
        with pytest.raises(ValueError):
            bad.build()


def test_json_round_trip():
    plans = [
        QueryPlanBuilder("t").compare_with(Box.of(0, 1, 0, 2)).in_space(Box.of(-1, 2, -1, 2)).filter_stream_by_box(Box.of(0, 9, 0, 9)).enlarge_stream_by_factor(2.0).build(),
        QueryPlanBuilder("t").join_with("s").enlarge_stream_by_metres(5.0, 6.0).filter_stored_by_key("k").add_join_filter(Filter("geojson", "a:b")).receive_invalidations().invalidate_after_watermarks(3).build(),
    ]
    for p in plans:
        assert ContinuousPlan.from_json(p.to_json()) == p
    for bad in ("", "{}", "[1]", '{"type": "other"}', plans[0].to_json().replace('"factor"', '"nothing"')):
        with pytest.raises(ValueError):
            ContinuousPlan.from_json(bad)
    assert enlargement_of(plans) == {"amount": 0.0, "factor": 2.0, "lat": 5.0, "lon": 6.0}


def test_idle_rule():
    assert not C.is_idle(1, 9, 0) and C.is_idle(1, 2, 1) and not C.is_idle(2, 3, 2) and C.is_idle(2, 4, 2)


def test_state_machine():
    state, out = C.advance((0, set()), [(1, 0, {"a", "b"}), (2, 0, {"b"}), (3, 0, set())], 0)
    assert out == [("TUPLE", "a", 1), ("TUPLE", "b", 1), ("TUPLE", "b", 2), ("INVALIDATION", "a", 2), ("INVALIDATION", "b", 3)] and state == (0, set())
    _, out = C.advance((0, {""}), [(5, 9, set())], 3)
    assert out == [("IDLE_REMOVED", "", None)]


MARKED = "key string, lo_0 double, hi_0 double, data string, version_ts long, received_ts long, kind string, generation long"


def marked(spark, rows):
    """``key, x, version, kind, generation`` as tuples with points."""
    return spark.createDataFrame([(k, x, x, "", v, v, kind, g) for k, x, v, kind, g in rows], MARKED)


ROWS = [
    ("silent", 1.0, 1, "TUPLE", 0), ("other", 1.0, 2, "TUPLE", 1), ("outside", 9.0, 3, "TUPLE", 1), ("told", 1.0, 4, "TUPLE", 1), ("told", 0.0, 5, "INVALIDATION", 1),
    *(("", 0.0, 100 + g, "WATERMARK", g) for g in range(9)), ("other", 9.0, 200, "TUPLE", 9), ("late", 1.0, 201, "TUPLE", 9), ("late", 1.0, 202, "TUPLE", 9), ("late", 9.0, 203, "TUPLE", 9),
]
#: Nine watermarks pass: silent and other fall idle after three, told and late are invalidated.
WANT = sorted([
    ("TUPLE", "silent", 1), ("IDLE_REMOVED", "silent", None), ("TUPLE", "other", 2), ("IDLE_REMOVED", "other", None), ("TUPLE", "told", 4), ("INVALIDATION", "told", 5),
    ("TUPLE", "late", 201), ("TUPLE", "late", 202), ("INVALIDATION", "late", 203),
], key=str)


def replayed(spark, tmp_path, rows):
    """The rows as a stream, one file and micro-batch for each generation."""
    for k, g in enumerate(sorted({r[4] for r in rows})):
        marked(spark, [r for r in rows if r[4] == g]).coalesce(1).write.parquet(f"{tmp_path}/{k:03d}")
    return spark.readStream.schema(MARKED).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))


def test_silent_keys_are_removed_by_watermarks(spark, tmp_path):
    plan = QueryPlanBuilder("e").compare_with(Box.of(0, 2)).receive_invalidations().invalidate_after_watermarks(3).build()
    got = C.continuous_range(marked(spark, ROWS), plan).select("kind", "key", "version_ts").collect()
    assert sorted(map(tuple, got), key=str) == WANT
    rows = [*ROWS, ("kept", 1.0, 300, "TUPLE", 9)]
    live = C.run_available(C.continuous_range(replayed(spark, tmp_path / "rows", rows), plan), "idle", str(tmp_path / "check")).select("kind", "key", "version_ts").collect()
    assert sorted(map(tuple, live), key=str) == sorted([*WANT, ("TUPLE", "kept", 300)], key=str)
    assert [(r.key, r["last"], r.partners) for r in C.state_of(spark, str(tmp_path / "check")).collect()] == [("kept", 9, [""])]
    # without invalidations there is no state
    stateless = QueryPlanBuilder("e").compare_with(Box.of(0, 2)).invalidate_after_watermarks(3).receive_watermarks().build()
    kinds = {(r.kind, r.n) for r in C.continuous_range(marked(spark, ROWS), stateless).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {("TUPLE", 5), ("WATERMARK", 9)}


def test_join_with_invalidations(spark, tmp_path):
    stored = marked(spark, [("a", 1.0, 1, "TUPLE", 0), ("b", 1.0, 1, "TUPLE", 0), ("c", 9.0, 1, "TUPLE", 0)]).drop("generation")
    plan = QueryPlanBuilder("e").join_with("s").receive_invalidations().invalidate_after_watermarks(3).build()
    want = []
    for kind, key, version in WANT:
        want += [(kind, key, p, version) for p in "ab"]
    want += [("TUPLE", "outside", "c", 3), ("IDLE_REMOVED", "outside", "c", None), ("TUPLE", "other", "c", 200), ("TUPLE", "late", "c", 203)]
    got = C.continuous_join(marked(spark, ROWS), stored, plan, cell=[5.0]).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    live = C.run_available(C.continuous_join(replayed(spark, tmp_path, ROWS), stored, plan, cell=[5.0]), "idle_join").collect()
    assert sorted(map(tuple, live), key=str) == sorted(want, key=str)


def stream_of(spark):
    raw = spark.read.parquet(f"{SF}/events.parquet")
    s = C.read_stream(spark, raw.schema, SF, "events.parquet")
    from quadrille.operators import tuples

    make = lambda e: tuples.to_tuples(e, "user_id", ["value"], registry.us("ts"), data="event_type")
    return make(s), make(raw)


def test_stream_equals_batch(spark):
    s, b = stream_of(spark)
    for k, build in enumerate((QueryPlanBuilder("e").compare_with(Box.of(100, 200)).enlarge_stream_by_amount(5.0), QueryPlanBuilder("e").compare_with(Box.of(100, 200)).receive_invalidations())):
        plan = build.build()
        live = C.run_available(C.continuous_range(s, plan), f"range{k}").groupBy("kind", "key").count()
        want = C.continuous_range(b, plan).groupBy("kind", "key").count()
        assert sorted(map(tuple, live.collect())) == sorted(map(tuple, want.collect())) and want.count() > 0


def test_stream_join_equals_batch(spark):
    s, b = stream_of(spark)
    stored = spark.range(50).select(F.col("id").cast("string").alias("key"), (F.col("id") * 10.0).alias("lo_0"), (F.col("id") * 10.0 + 3).alias("hi_0"), F.lit("").alias("data"), F.lit(1).cast("long").alias("version_ts"), F.lit(1).cast("long").alias("received_ts"), F.lit("TUPLE").alias("kind"))
    plan = QueryPlanBuilder("e").join_with("s").enlarge_stream_by_amount(1.0).build()
    live = C.run_available(C.continuous_join(s, stored, plan, cell=[5.0]).select("l_key", "l_version_ts", "r_key"), "joined")
    want = C.continuous_join(b, stored, plan, cell=[5.0]).select("l_key", "l_version_ts", "r_key")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, want.collect())) and want.count() > 0
    got = C.continuous_join(b, stored, QueryPlanBuilder("e").join_with("s").enlarge_stream_by_amount(1.0).receive_invalidations().build(), cell=[5.0])
    assert got.where("kind = 'TUPLE'").count() == want.distinct().count() and got.where("kind = 'INVALIDATION'").count() > 0
    with pytest.raises(ValueError):
        C.continuous_join(s, stored, plan)
