"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quadrille.functions.boxes import Box  # noqa: E402
from quadrille.operators import queries  # noqa: E402
from quadrille.plans import format_queries, registry  # noqa: E402, F401  the first adds its queries to the second
from quadrille.plans.continuous import QueryPlanBuilder  # noqa: E402
from quadrille.streaming import continuous  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
SMALL = os.path.join(os.path.dirname(SF.rstrip("/")), "sf0.001")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ["key_lookup", "newest_per_key", "range_lineitem_3d", "range_after_resolution", "spatial_join_2way", "spatial_join_3way", "cell_histogram", "kd_sampled_balance", "continuous_range_invalidation", "continuous_join", "compact_table"]


def ladder(share: float):
    """A range query whose box has this share of the quantities' range in each of two dimensions."""
    return lambda s, d: queries.range_query(registry.lineitem(s, d), Box.of(1, 1 + 49 * share, 0, 0.1 * share, 0, 1e6), config=registry.UNIQUE)


def streamed(s: SparkSession, d: str) -> DataFrame:
    raw = s.read.parquet(f"{d}/events.parquet")
    live = continuous.read_stream(s, raw.schema, d, "events.parquet")
    from quadrille.operators import tuples

    t = tuples.to_tuples(live, "user_id", ["value"], registry.us("ts"), data="event_type")
    plan = QueryPlanBuilder("events").compare_with(Box.of(100, 200)).build()
    return continuous.run_available(continuous.continuous_range(t, plan), f"bench{time.time_ns()}")


def nested(s: SparkSession, d: str) -> DataFrame:
    """The join without an index, every order against every line item: a baseline on the smallest tables."""
    from quadrille.functions import boxes

    one, two = (t.select(*(F.col(c).alias(p + c) for c in t.columns)) for t, p in ((registry.orders(s, SMALL), "l_"), (registry.lines(s, SMALL), "r_")))
    return one.crossJoin(F.broadcast(two)).where(boxes.meets(2, "l_", "r_"))


def gridded(s: SparkSession, d: str) -> DataFrame:
    return registry.QUERIES["spatial_join_2way"](s, SMALL)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo = {n: registry.QUERIES[n] for n in NAMES} | {f"range_share_{x:g}": ladder(x) for x in (0.001, 0.01, 0.1, 1.0)} | {"stream_range": streamed} | ({"small_join_nested": nested, "small_join_grid": gridded} if os.path.isdir(SMALL) else {})
    took = {}
    for name, q in todo.items():
        runs = []
        for _ in range(2):  # the second run is without compilation
            began = time.time()
            q(spark, SF).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(min(runs), 3)
    sf = os.path.basename(SF.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
