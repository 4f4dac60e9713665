"""Space partitioners: k-d, quad, static and dynamic grids, and the assignment of tuples to regions.

A partitioning is a list of regions on the driver, whose number the caller bounds. Splits come from
quantiles that Spark computes over all tuples, or from a sample of bounded size.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.functions.boxes import Box, Interval, dimensions_of, is_full, meets_box

MOST_SAMPLES = 100_000


@dataclass(frozen=True)
class Region:
    id: int
    box: Box
    level: int = 0


class Partitioner(Protocol):
    def regions(self, samples: list[tuple[float, ...]], space: Box) -> list[Region]: ...


def samples_of(df: DataFrame, fraction: float = 0.001, seed: int = 1, most: int = MOST_SAMPLES) -> list[tuple[float, ...]]:
    """Bounds of sampled boxes; full spaces are left out. At most ``most`` come to the driver,
    drawn from the whole sample."""
    n = dimensions_of(df)
    names = [f"{k}_{d}" for d in range(n) for k in ("lo", "hi")]
    rows = df.where(~is_full()).select(*names).sample(fraction, seed).orderBy(F.rand(seed + 1)).limit(most)
    return [tuple(r) for r in rows.collect()]


def every_kth(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """Each ``k``-th tuple by hash of its order columns: about one of ``k``, wherever it lies."""
    return df.where(~is_full()).where(F.pmod(F.xxhash64(*order), F.lit(k)) == 0)


def split_point(samples: list[tuple[float, ...]], box: Box, d: int) -> float | None:
    """The middle of the sampled begins and ends in the region, rounded to five decimals."""
    inside = sorted(x for s in samples for x in s[2 * d : 2 * d + 2] if box.sides[d].holds(x))
    if not inside:
        return None
    at = math.floor(inside[len(inside) // 2] * 1e5 + 0.5) / 1e5
    side = box.sides[d]
    return at if side.lo < at < side.hi else None


@dataclass(frozen=True)
class KDTree:
    """Split the region with most samples, by turns in each dimension, until there are ``count``."""

    count: int

    def regions(self, samples, space):
        leaves = [(space, 0, samples)]
        done = []
        while leaves and len(leaves) + len(done) < self.count:
            leaves.sort(key=lambda x: len(x[2]))
            box, level, some = leaves.pop()
            d = level % box.dimensions
            at = split_point(some, box, d)
            if at is None:
                done.append((box, level, some))
                continue
            left, right = box.split(at, d)
            leaves.append((left, level + 1, [s for s in some if s[2 * d] <= at]))
            leaves.append((right, level + 1, [s for s in some if s[2 * d + 1] > at]))
        out = sorted(leaves + done, key=lambda x: [s.lo for s in x[0].sides])
        return [Region(i, b, level) for i, (b, level, _) in enumerate(out)]


@dataclass(frozen=True)
class QuadTree:
    """Split regions in the middle of all dimensions, down to ``depth``."""

    depth: int

    def regions(self, samples, space):
        boxes = [space]
        for _ in range(self.depth):
            boxes = [Box(c) for b in boxes for c in itertools.product(*(s.split(s.midpoint, False) for s in b.sides))]
        return [Region(i, b, self.depth) for i, b in enumerate(boxes)]


def _slabs(side: Interval, step: float) -> list[Interval]:
    n = max(1, math.ceil(side.length / step - 1e-9))
    return [Interval(side.lo + i * step, side.hi if i == n - 1 else side.lo + (i + 1) * step, True, i == n - 1) for i in range(n)]


@dataclass(frozen=True)
class StaticGrid:
    """Disjoint cells of fixed steps. ``parse`` reads ``box;step;step...``."""

    box: Box
    steps: tuple[float, ...]

    @classmethod
    def parse(cls, text: str) -> StaticGrid:
        box, *steps = text.split(";")
        grid = cls(Box.parse(box), tuple(map(float, steps)))
        if len(grid.steps) != grid.box.dimensions:
            raise ValueError("a static grid needs a step for each dimension")
        return grid

    def regions(self, samples=(), space=None):
        slabs = [_slabs(s, step) for s, step in zip(self.box.sides, self.steps, strict=True)]
        return [Region(i, Box(c)) for i, c in enumerate(itertools.product(*slabs))]

    def assign(self, df: DataFrame) -> DataFrame:
        """Tuples with the id of each cell that their box meets, by arithmetic alone; a full space meets all."""
        out, number = df.where(meets_box(self.box)), F.lit(0).cast("long")
        for d, (side, step) in enumerate(zip(self.box.sides, self.steps, strict=True)):
            n = len(_slabs(side, step))
            at = lambda c, else_: F.coalesce(F.least(F.greatest(F.floor((F.col(c) - side.lo) / step), F.lit(0)), F.lit(n - 1)), F.lit(else_))  # noqa: B023, E731
            out = out.withColumn(f"_cell_{d}", F.explode(F.sequence(at(f"lo_{d}", 0), at(f"hi_{d}", n - 1))))
            number = number * n + F.col(f"_cell_{d}")
        return out.select(*df.columns, number.alias("region_id"))


@dataclass(frozen=True)
class DynamicGrid:
    """Fixed slabs in all dimensions but the first, and sampled splits of each along the first."""

    box: Box
    steps: tuple[float, ...]
    count: int

    def regions(self, samples, space=None):
        out = []
        for rest in itertools.product(*(_slabs(s, step) for s, step in zip(self.box.sides[1:], self.steps, strict=True))):
            slab = Box((self.box.sides[0], *rest))
            some = [s for s in samples if slab.meets(Box.of(*s))]
            parts = [(slab, some)]
            while len(parts) < self.count:
                parts.sort(key=lambda x: len(x[1]))
                box, inside = parts.pop()
                at = split_point(inside, box, 0)
                if at is None:
                    parts.append((box, inside))
                    break
                parts += [(b, [s for s in inside if b.meets(Box.of(*s))]) for b in box.split(at, 0)]
            out += sorted((b for b, _ in parts), key=lambda b: b.sides[0].lo)
        return [Region(i, b) for i, b in enumerate(out)]


def merge_small(regions: list[Region], counts: dict[int, int], least: int) -> list[Region]:
    """Neighbours along the first dimension joined while they hold fewer than ``least`` together."""
    out: list[tuple[Box, int]] = []
    for r in sorted(regions, key=lambda r: ([s.lo for s in r.box.sides[1:]], r.box.sides[0].lo)):
        n = counts.get(r.id, 0)
        if out and out[-1][1] + n < least and out[-1][0].sides[1:] == r.box.sides[1:]:
            a, m = out.pop()
            first = Interval(a.sides[0].lo, r.box.sides[0].hi, a.sides[0].lo_in, r.box.sides[0].hi_in)
            out.append((Box((first, *a.sides[1:])), m + n))
        else:
            out.append((r.box, n))
    return [Region(i, b) for i, (b, _) in enumerate(out)]


def needs_split(size: int, most: int) -> bool:
    return size > most


def needs_merge(history: list[list[int]], least: int, points: int = 5) -> bool:
    """Whether the mean sizes of sibling regions, over their last points, add up to less than ``least``."""
    if any(len(h) < points for h in history):
        return False
    return sum(sum(h[-points:]) / points for h in history) < least


def as_table(spark: SparkSession, regions: list[Region]) -> DataFrame:
    n = regions[0].box.dimensions
    schema = T.StructType([T.StructField("region_id", T.LongType()), T.StructField("level", T.IntegerType())] + [T.StructField(f"{k}_{d}", kind) for d in range(n) for k, kind in (("region_lo", T.DoubleType()), ("region_hi", T.DoubleType()), ("lo_in", T.BooleanType()), ("hi_in", T.BooleanType()))])
    rows = [(r.id, r.level, *(x for s in r.box.sides for x in (s.lo, s.hi, s.lo_in, s.hi_in))) for r in regions]
    return spark.createDataFrame(rows, schema)


def assign(df: DataFrame, regions: list[Region], enlargement: float = 0.0) -> DataFrame:
    """Tuples with each region that their box meets, as ``region_id``; a full space meets all.

    With ``enlargement`` a tuple also goes to the regions that its box meets when it is padded so much; the
    tuple keeps its box. The list of regions is on the driver already, so its broadcast has its size.
    """
    t = as_table(df.sparkSession, regions)
    n = regions[0].box.dimensions
    on = F.lit(True)
    for d in range(n):
        lo, hi = F.col(f"lo_{d}") - enlargement, F.col(f"hi_{d}") + enlargement
        low = (lo < F.col(f"region_hi_{d}")) | (F.col(f"hi_in_{d}") & (lo == F.col(f"region_hi_{d}")))
        high = (hi > F.col(f"region_lo_{d}")) | (F.col(f"lo_in_{d}") & (hi == F.col(f"region_lo_{d}")))
        on = on & low & high
    return df.join(F.broadcast(t), on | is_full(), "inner").select(*df.columns, "region_id")


def prune(regions: list[Region], box: Box) -> list[int]:
    """Ids of the regions that a query box meets, for a predicate on a partition column."""
    return [r.id for r in regions if r.box.meets(box)]


def prepartition(df: DataFrame, count: int, fraction: float = 0.001, seed: int = 1, space: Box | None = None) -> list[Region]:
    n = dimensions_of(df)
    return KDTree(count).regions(samples_of(df, fraction, seed), space or Box.unbounded(n))
