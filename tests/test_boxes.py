"""Box and interval algebra, on the driver and as columns."""

import random

import pytest
from pyspark.sql import functions as F

from quadrille.functions import boxes as B
from quadrille.functions.boxes import Box, Interval


def test_interval_ends():
    assert Interval(0, 5).meets(Interval(5, 6)) and not Interval(0, 5, True, False).meets(Interval(5, 6))
    assert Interval(1, 2, False, False).meets(Interval(1, 3, False, False))
    assert not Interval(0, 10).meets(Interval(10.1, 20.1))
    assert str(Interval.parse("(min, 3.5]")) == "(min,3.5]"
    for bad in ("[1,2", "1,2", "[a,b]", "[3,1]"):
        with pytest.raises(ValueError):
            Interval.parse(bad)


def test_box_values():
    a, b = Box.of(1, 5, 1, 5), Box.of(2, 6, 2, 6)
    assert a.intersection(b) == Box.of(2, 5, 2, 5)
    assert a.intersection(Box.of(7, 8, 7, 8)) is None and a.intersection(Box.of(7, 8, 7, 8), True).full
    assert Box.cover([a, Box(), b]) == Box.of(1, 6, 1, 6) and Box.cover([]).full
    assert Box.of(-5, 10).padded(5) == Box.of(-10, 15) and Box.of(-5, 10).enlarged_by_factor(2) == Box.of(-12.5, 17.5)
    assert Box.of(0, 4, 0, 4).scaled(0.25).volume == pytest.approx(4) and Box.unbounded(2).scaled(0.5) is None
    assert Box.parse("[[0,1]:[2,3]]").bounds == (0, 1, 2, 3) and Box.parse("[]").full and str(Box()) == "[]"
    assert a.enlargement(b) == 25 - 16 and a.enlargement(Box.of(2, 3, 2, 3)) == 0
    assert Box() .meets(a) and not a.meets(None) and not a.meets(Box.of(0, 10))
    with pytest.raises(ValueError):
        Box.of(1, 2, 3)
    with pytest.raises(ValueError):
        a.covers(Box.of(0, 1))


def test_metres_give_pinned_values():
    got = Box.of(13.4111173, 13.4111173, 52.5219814, 52.5219814).enlarged_by_metres(100, 100).bounds
    assert got == (13.4082127945806970, 13.4140218054193050, 52.5191497866096200, 52.5248130133903860)


def test_columns_agree_with_values(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        bounds = [x for _ in range(4) for lo in [rng.randint(-3, 3)] for x in (float(lo), float(lo + rng.randint(0, 3)))]
        rows.append(tuple(bounds))
    names = [f"{p}{k}_{d}" for p in ("a_", "b_") for d in (0, 1) for k in ("lo", "hi")]
    df = spark.createDataFrame(rows, names)
    i = B.intersection(2, "a_", "b_")
    got = df.select("*", B.meets(2, "a_", "b_").alias("m"), B.covers(2, "a_", "b_").alias("c"), B.enlargement(2, "a_", "b_").alias("e"), i["lo_0"].alias("i0"), B.volume(2, "a_").alias("v")).collect()
    for r in got:
        a, b = Box.of(*r[:4]), Box.of(*r[4:8])
        assert (r.m, r.c, r.e, r.v) == (a.meets(b), a.covers(b), a.enlargement(b), a.volume)
        both = a.intersection(b)
        assert r.i0 == (both.sides[0].lo if both else None)


def test_array_view_is_pushed_down(spark, tmp_path):
    spark.range(100).select(F.col("id").cast("double").alias("lo_0"), F.col("id").cast("double").alias("hi_0")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where(B.bbox(1)[0]["lo"] > 50)
    assert "GreaterThan(lo_0,50.0)" in df._jdf.queryExecution().executedPlan().toString()
