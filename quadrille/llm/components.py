"""Connected components and links between neighbours of a sorted table, without gathering groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import Scratch, tasks


def connected_components(spark: SparkSession, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` for each id in the links ``a, b``; a component is named by its smallest id.

    Large-star and small-star steps alternate until nothing changes. Each step needs only the least
    neighbour of a node, which partial aggregation finds, so a node with very many links costs no
    task more than others; the joins are on the node, where adaptive execution splits hot keys.
    """
    lower, upper = F.least("a", "b"), F.greatest("a", "b")
    edges = scratch.cut(links.where("a <> b").select(upper.alias("a"), lower.alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = scratch.cut(small.where("a <> b").distinct(), "edges")
        scratch.drop(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return scratch.cut(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "components")
        state = now


def merged(spark: SparkSession, components: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The components after further links, which are followed among the components they join alone."""
    if components is None:
        return connected_components(spark, links, scratch)
    if links.isEmpty():
        return components
    at = lambda side: components.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
    between = links.join(at("a"), "a", "left").join(at("b"), "b", "left")
    between = between.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).where("a <> b").distinct()
    up = connected_components(spark, scratch.cut(between, "between"), scratch)
    scratch.release("between")
    moved = components.join(up.select(F.col("node").alias("component"), F.col("component").alias("after")), "component", "left")
    moved = moved.select("node", F.coalesce("after", "component").alias("component"))
    fresh = up.join(components.select("node"), "node", "left_anti")
    out = scratch.cut(moved.unionByName(fresh), "components")
    scratch.drop(components, up)
    return out


def neighbours(table: DataFrame, key: list[str], order: list[str], keep: list[str], scratch: Scratch) -> DataFrame:
    """Rows next to each other in the order of ``key`` and ``order``, where their keys are equal.

    The result has ``keep`` of both rows, as ``x_1`` for the earlier and ``x_2`` for the later. The
    table is sorted over range partitions of key and order together, so a key with very many rows
    spreads over as many partitions as its share; what meets at their borders, two rows for each
    partition, is joined afterwards. All columns must be numbers without nulls.
    """
    names = [*key, *(c for c in dict.fromkeys([*order, *keep]) if c not in key)]
    kinds = {c: t for c, t in table.dtypes}
    schema = ", ".join([f"{c}_{i} {kinds[c]}" for i in (1, 2) for c in names] + ["part int", "edge int"])
    ranged = table.select(*names).repartitionByRange(tasks(table.sparkSession), *key, *order).sortWithinPartitions(*key, *order)
    arrow = {"bigint": pa.int64(), "int": pa.int32()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out_names = [f"{c}_{i}" for i in (1, 2) for c in names] + ["part", "edge"]

        def emit(first: list[np.ndarray], second: list[np.ndarray], edge: int) -> pa.RecordBatch:
            n = len(first[0])
            columns = [pa.array(v, arrow[kinds[c]]) for side in (first, second) for c, v in zip(names, side, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, edge, np.int32))], out_names)

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(i).to_numpy() for i in range(len(names))]
            if last is None:
                head = [v[:1] for v in now]
                yield emit(head, head, 1)
            else:
                now = [np.concatenate([p, v]) for p, v in zip(last, now, strict=True)]
            same = np.ones(len(now[0]) - 1, bool)
            for v in now[: len(key)]:
                same &= v[1:] == v[:-1]
            at = np.flatnonzero(same)
            if len(at):
                yield emit([v[at] for v in now], [v[at + 1] for v in now], 0)
            last = [v[-1:] for v in now]
        if last is not None:
            yield emit(last, last, 2)

    found = scratch.cut(ranged.mapInArrow(scan, schema), "neighbours")
    # Two rows a partition: a partition's last row meets the first of the next that has rows.
    edges = found.where("edge > 0").orderBy("part", "edge").collect()
    crossing = []
    for one, two in zip(edges[1::2], edges[2::2], strict=False):
        if all(one[f"{c}_1"] == two[f"{c}_1"] for c in key):
            crossing.append([one[f"{c}_1"] for c in names] + [two[f"{c}_1"] for c in names] + [0, 0])
    met = table.sparkSession.createDataFrame(crossing, found.schema)
    return found.where("edge = 0").unionByName(met).select(*(f"{c}_{i}" for i in (1, 2) for c in keep))
