"""A thin command line over the catalog and the queries."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from quadrille.functions.boxes import Box
from quadrille.operators import joins, partition, queries
from quadrille.operators.filters import Filter
from quadrille.operators.versions import TableConfig
from quadrille.sources import formats
from quadrille.sources.tables import Catalog

ACTIONS = ("import", "query_key", "query_range", "query_range_and_time", "query_time", "query_join", "query_continuous", "insert", "delete", "create_dgroup", "delete_dgroup", "create_table", "delete_table", "show_dgroup", "show_instances", "prepartition")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quadrille")
    p.add_argument("action", choices=ACTIONS)
    for name in ("root", "table", "group", "key", "box", "value", "file", "format", "plan"):
        p.add_argument(f"--{name}")
    p.add_argument("--dimensions", type=int)
    p.add_argument("--time", type=int, help="microseconds")
    p.add_argument("--padding", type=float, default=0.0)
    p.add_argument("--partitions", type=int, default=16)
    p.add_argument("--versions", type=int, default=0)
    p.add_argument("--ttl", type=int, default=0, help="microseconds")
    p.add_argument("--filter", action="append", default=[], help="name=value")
    return p


def run(spark: SparkSession, argv: list[str]) -> DataFrame | list | None:
    a = parser().parse_args(argv)
    c = Catalog(spark, a.root)
    box = Box.parse(a.box) if a.box else Box()
    filters = [Filter(*f.split("=", 1)) for f in a.filter]
    read = lambda: (c.table(a.table), c.config(a.table))
    if a.action == "create_dgroup":
        return c.create_group(a.group, a.dimensions)
    if a.action == "delete_dgroup":
        return c.delete_group(a.group)
    if a.action == "create_table":
        return c.create_table(a.table, TableConfig(duplicates=bool(a.versions or a.ttl), versions=a.versions, ttl_us=a.ttl))
    if a.action == "delete_table":
        return c.delete_table(a.table)
    if a.action == "show_dgroup":
        return c.tables(a.group) if a.group else c.groups()
    if a.action == "show_instances":
        return [spark.sparkContext.applicationId, spark.sparkContext.master]
    if a.action == "import":
        return c.put(a.table, formats.read_tuples(formats.read_lines(spark, a.file), a.format, a.padding))
    if a.action == "insert":
        row = spark.createDataFrame([(1, f"{a.key} {','.join(map(str, box.bounds))} {a.value or ''}")], "line_no long, value string")
        return c.put(a.table, formats.read_tuples(row, "synthetic_stream", dimensions=box.dimensions))
    if a.action == "delete":
        return c.delete(a.table, spark.createDataFrame([(a.key,)], "key string"))
    if a.action == "query_key":
        return queries.key_query(read()[0], a.key, read()[1])
    if a.action == "query_range":
        return queries.range_query(read()[0], box, filters, read()[1])
    if a.action == "query_range_and_time":
        return queries.range_and_time_query(read()[0], box, a.time, read()[1])
    if a.action == "query_time":
        return queries.version_time_query(read()[0], a.time, read()[1])
    if a.action == "query_join":
        return joins.multi_join([c.resolved(t) for t in a.table.split(",")], box, filters)
    if a.action == "prepartition":
        return partition.prepartition(c.table(a.table), a.partitions, fraction=0.01, space=box if a.box else None)
    from quadrille.plans.continuous import ContinuousPlan
    from quadrille.streaming import continuous

    plan = ContinuousPlan.from_json(a.plan)
    stream = c.table(plan.stream_table)
    return continuous.continuous_range(stream, plan) if plan.join_table is None else continuous.continuous_join(stream, c.table(plan.join_table), plan)


if __name__ == "__main__":
    import sys

    out = run(SparkSession.builder.getOrCreate(), sys.argv[1:])
    if isinstance(out, DataFrame):
        out.show(100, False)
    elif out is not None:
        print(*out, sep="\n")
