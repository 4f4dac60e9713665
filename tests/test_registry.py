"""Registered joins against brute force over whole tables."""

import numpy as np
import pyarrow.parquet as pq

from quadrille.operators import partition, tuples
from quadrille.plans import registry

SF = "/root/testdata/sf0.01"


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pandas()


def day(column):
    return column.to_numpy().astype("datetime64[D]").astype(np.int64)


def test_three_way_join_of_all_events(spark):
    o, li, e = table("orders"), table("lineitem"), table("events")
    a0, b0, c0, d0 = o.o_custkey.to_numpy(), day(o.o_orderdate), li.l_partkey.to_numpy(), day(li.l_shipdate)
    e0, e1 = e.user_id.to_numpy() * 5, 8036 + e.event_id.to_numpy() % 2400
    want = []
    for i in range(len(o)):
        for j in np.flatnonzero((a0[i] <= c0 + 1) & (c0 <= a0[i] + 3) & (b0[i] <= d0 + 1) & (d0 <= b0[i] + 2)):
            x0, x1, y0, y1 = min(a0[i], c0[j]), max(a0[i] + 3, c0[j] + 1), min(b0[i], d0[j]), max(b0[i] + 2, d0[j] + 1)
            want += [(str(o.o_orderkey[i]), int(k)) for k in e.event_id[(x0 <= e0 + 1) & (e0 <= x1) & (y0 <= e1) & (e1 <= y1)]]
    got = registry.spatial_join_3way(spark, SF).collect()
    assert any(k % 4 for _, k in want) and sorted((r.t1_key, r.t3_event_id) for r in got) == sorted(want)


def test_samples_over_the_bound_come_from_the_whole_table(spark):
    t = tuples.to_tuples(spark.range(0, 20_000, 1, 8), "id", ["id"], "id")
    got = [s[0] for s in partition.samples_of(t, 0.5, most=1000)]
    assert len(got) == 1000 and 9000 < sum(got) / 1000 < 11_000
