"""Axis-parallel boxes: values on the driver and column expressions on flat ``lo_d, hi_d`` columns.

A table's boxes are flat columns, so that predicates reach Parquet statistics. A box whose bounds
are all NULL is the full space: it meets and covers everything.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bounds that ``min`` and ``max`` stand for.
UNBOUNDED = 3.4028234663852886e38


@dataclass(frozen=True, order=True)
class Interval:
    """A numeric interval with open or closed ends."""

    lo: float
    hi: float
    lo_in: bool = True
    hi_in: bool = True

    def __post_init__(self):
        if self.lo > self.hi:
            raise ValueError(f"an interval cannot begin at {self.lo} and end at {self.hi}")
        if self.lo == self.hi and not (self.lo_in and self.hi_in):
            raise ValueError("an interval of one point must be closed")

    @property
    def length(self) -> float:
        return self.hi - self.lo

    @property
    def midpoint(self) -> float:
        return self.lo + (self.hi - self.lo) / 2

    def holds(self, x: float) -> bool:
        return (self.lo < x or (self.lo_in and x == self.lo)) and (x < self.hi or (self.hi_in and x == self.hi))

    def covers(self, other: Interval) -> bool:
        low = self.lo < other.lo or (self.lo == other.lo and (self.lo_in or not other.lo_in))
        high = self.hi > other.hi or (self.hi == other.hi and (self.hi_in or not other.hi_in))
        return low and high

    def intersection(self, other: Interval) -> Interval | None:
        lo, lo_in = max((self.lo, not self.lo_in), (other.lo, not other.lo_in))
        hi, hi_in = min((self.hi, self.hi_in), (other.hi, other.hi_in))
        if lo > hi or (lo == hi and (lo_in or not hi_in)):
            return None
        return Interval(lo, hi, not lo_in, hi_in)

    def meets(self, other: Interval) -> bool:
        return self.intersection(other) is not None

    def split(self, at: float, left_has_it: bool = True) -> tuple[Interval, Interval]:
        if not self.holds(at):
            raise ValueError(f"{at} is outside of the interval")
        return Interval(self.lo, at, self.lo_in, left_has_it), Interval(at, self.hi, not left_has_it, self.hi_in)

    @classmethod
    def parse(cls, text: str) -> Interval:
        m = re.fullmatch(r"\s*([\[(])\s*([^,]+?)\s*,\s*([^,]+?)\s*([\])])\s*", text)
        if not m:
            raise ValueError(f"not an interval: {text!r}")
        bound = lambda x: {"min": -UNBOUNDED, "max": UNBOUNDED}[x] if x in ("min", "max") else float(x)
        return cls(bound(m[2]), bound(m[3]), m[1] == "[", m[4] == "]")

    def __str__(self) -> str:
        show = lambda x: "min" if x == -UNBOUNDED else "max" if x == UNBOUNDED else repr(float(x))
        return f"{'[' if self.lo_in else '('}{show(self.lo)},{show(self.hi)}{']' if self.hi_in else ')'}"


@dataclass(frozen=True)
class Box:
    """A box; without sides it is the full space."""

    sides: tuple[Interval, ...] = ()

    @classmethod
    def of(cls, *bounds: float) -> Box:
        """From ``lo, hi`` of each dimension."""
        if len(bounds) % 2:
            raise ValueError("a box needs two bounds for each dimension")
        return cls(tuple(Interval(float(a), float(b)) for a, b in zip(bounds[::2], bounds[1::2], strict=True)))

    @classmethod
    def parse(cls, text: str) -> Box:
        body = text.strip()
        if not (body.startswith("[") and body.endswith("]")):
            raise ValueError(f"not a box: {text!r}")
        body = body[1:-1].strip()
        return cls(tuple(Interval.parse(x) for x in re.split(r"(?<=[\])])\s*:\s*(?=[\[(])", body))) if body else cls()

    @classmethod
    def unbounded(cls, dimensions: int) -> Box:
        return cls.of(*[-UNBOUNDED, UNBOUNDED] * dimensions)

    def __str__(self) -> str:
        return "[" + ":".join(map(str, self.sides)) + "]"

    def __lt__(self, other: Box) -> bool:
        return (len(self.sides), [s.lo for s in self.sides]) < (len(other.sides), [s.lo for s in other.sides])

    @property
    def dimensions(self) -> int:
        return len(self.sides)

    @property
    def full(self) -> bool:
        return not self.sides

    @property
    def bounds(self) -> tuple[float, ...]:
        return tuple(x for s in self.sides for x in (s.lo, s.hi))

    @property
    def volume(self) -> float:
        return math.prod(s.length for s in self.sides)

    def extent(self, d: int) -> float:
        return self.sides[d].length

    def meets(self, other: Box | None) -> bool:
        if other is None:
            return False
        if self.full or other.full:
            return True
        return self.dimensions == other.dimensions and all(a.meets(b) for a, b in zip(self.sides, other.sides, strict=True))

    def _same(self, other: Box) -> None:
        if self.dimensions != other.dimensions:
            raise ValueError("the boxes differ in dimension")

    def covers(self, other: Box) -> bool:
        if self.full or other.full:
            return True
        self._same(other)
        return all(a.covers(b) for a, b in zip(self.sides, other.sides, strict=True))

    def covers_in_some_dimension(self, other: Box) -> bool:
        if self.full or other.full:
            return True
        self._same(other)
        return any(a.covers(b) for a, b in zip(self.sides, other.sides, strict=True))

    def holds_in_dimension(self, x: float, d: int) -> bool:
        return self.sides[d].holds(x)

    def intersection(self, other: Box, disjoint_is_full: bool = False) -> Box | None:
        """None where the boxes are disjoint; with ``disjoint_is_full`` the full space, as is the
        intersection with the full space."""
        if self.full or other.full:
            return Box()
        parts = [a.intersection(b) for a, b in zip(self.sides, other.sides, strict=True)]
        if any(p is None for p in parts):
            return Box() if disjoint_is_full else None
        return Box(tuple(parts))

    @staticmethod
    def cover(boxes: list[Box]) -> Box:
        """The least box over all that are not the full space."""
        some = [b for b in boxes if not b.full]
        if not some:
            return Box()
        for b in some[1:]:
            some[0]._same(b)
        return Box.of(*(x for d in range(some[0].dimensions) for x in (min(b.sides[d].lo for b in some), max(b.sides[d].hi for b in some))))

    def enlargement(self, other: Box) -> float:
        """How much the volume grows by covering ``other``."""
        if self.full or other.full or self.covers(other):
            return 0.0
        return Box.cover([self, other]).volume - self.volume

    def padded(self, *by: float) -> Box:
        if self.full:
            return self
        by = by * self.dimensions if len(by) == 1 else by
        return Box.of(*(x for s, p in zip(self.sides, by, strict=True) for x in (s.lo - p, s.hi + p)))

    def enlarged_by_factor(self, f: float) -> Box:
        return self if self.full else Box.of(*(x for s in self.sides for p in [s.length * (f - 1) / 2] for x in (s.lo - p, s.hi + p)))

    def enlarged_by_metres(self, lat: float, lon: float) -> Box:
        if self.full:
            return self
        if self.dimensions != 2:
            raise ValueError("metres need a box of two dimensions")
        return Box.of(*(x for s, p in zip(self.sides, metres_to_degrees(self.sides[0].lo, lat, lon), strict=True) for x in (s.lo - p, s.hi + p)))

    def scaled(self, share: float) -> Box | None:
        """A box of ``share`` times the volume about the same centre; None if it is unbounded."""
        if self.full or any(abs(x) == UNBOUNDED for x in self.bounds):
            return None
        return self.enlarged_by_factor(share ** (1 / self.dimensions))

    def split(self, at: float, d: int, left_has_it: bool = True) -> tuple[Box, Box]:
        a, b = self.sides[d].split(at, left_has_it)
        put = lambda s: Box((*self.sides[:d], s, *self.sides[d + 1 :]))
        return put(a), put(b)


# Fixed values of the metre enlargement.
FIRST_METRES, SECOND_METRES = 6371000.0, 6356800.0


def metres_to_degrees(latitude: float, lat: float, lon: float) -> tuple[float, float]:
    """What a box gains on each side of its two axes, for distances in metres."""
    radians = latitude * math.pi / 180
    return lat * abs(360 / (math.cos(radians) * FIRST_METRES)) / 2.0, lon * (360 / SECOND_METRES) / 2.0


# Column expressions -------------------------------------------------------------------------------


def dimensions_of(df: DataFrame, prefix: str = "") -> int:
    return sum(c.startswith(f"{prefix}lo_") for c in df.columns)


def _c(name: str, prefix: str = "") -> Column:
    return F.col(prefix + name)


def bbox(n: int, prefix: str = "") -> Column:
    """The box as an array of structs; made inline, Catalyst reduces predicates on it to the flat columns."""
    return F.array(*(F.struct(_c(f"lo_{d}", prefix).alias("lo"), _c(f"hi_{d}", prefix).alias("hi")) for d in range(n)))


def is_full(prefix: str = "") -> Column:
    return _c("lo_0", prefix).isNull()


def _every(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def meets_box(box: Box, prefix: str = "") -> Column:
    """Whether the row's box, which is closed, meets a given one; a full space on either side does. An open
    end of the given box does not meet what only touches it."""
    if box.full:
        return F.lit(True)
    below = lambda d, s: _c(f"lo_{d}", prefix) <= s.hi if s.hi_in else _c(f"lo_{d}", prefix) < s.hi
    above = lambda d, s: _c(f"hi_{d}", prefix) >= s.lo if s.lo_in else _c(f"hi_{d}", prefix) > s.lo
    inside = _every([below(d, s) & above(d, s) for d, s in enumerate(box.sides)])
    return inside | is_full(prefix)


def meets(n: int, a: str, b: str) -> Column:
    """Whether two boxes of a joined row meet."""
    inside = _every([(_c(f"lo_{d}", a) <= _c(f"hi_{d}", b)) & (_c(f"lo_{d}", b) <= _c(f"hi_{d}", a)) for d in range(n)])
    return F.coalesce(inside, F.lit(True))


def covers(n: int, a: str, b: str) -> Column:
    inside = _every([(_c(f"lo_{d}", a) <= _c(f"lo_{d}", b)) & (_c(f"hi_{d}", a) >= _c(f"hi_{d}", b)) for d in range(n)])
    return F.coalesce(inside, F.lit(True))


def covered_in_some_dimension(n: int, a: str, b: str) -> Column:
    some = [(_c(f"lo_{d}", a) <= _c(f"lo_{d}", b)) & (_c(f"hi_{d}", a) >= _c(f"hi_{d}", b)) for d in range(n)]
    return F.coalesce(reduce(lambda x, y: x | y, some), F.lit(True))


def intersection(n: int, a: str, b: str) -> dict[str, Column]:
    """Bounds of the intersection; NULL where the boxes are disjoint."""
    met = meets(n, a, b)
    out = {}
    for d in range(n):
        out[f"lo_{d}"] = F.when(met, F.greatest(_c(f"lo_{d}", a), _c(f"lo_{d}", b)))
        out[f"hi_{d}"] = F.when(met, F.least(_c(f"hi_{d}", a), _c(f"hi_{d}", b)))
    return out


def cover(n: int, *prefixes: str) -> dict[str, Column]:
    """Bounds of the least box over several of a row; full spaces are left out."""
    if len(prefixes) == 1:
        return {f"{k}_{d}": _c(f"{k}_{d}", prefixes[0]) for d in range(n) for k in ("lo", "hi")}
    out = {}
    for d in range(n):
        out[f"lo_{d}"] = F.least(*(_c(f"lo_{d}", p) for p in prefixes))
        out[f"hi_{d}"] = F.greatest(*(_c(f"hi_{d}", p) for p in prefixes))
    return out


def volume(n: int, prefix: str = "") -> Column:
    return reduce(lambda a, b: a * b, [_c(f"hi_{d}", prefix) - _c(f"lo_{d}", prefix) for d in range(n)])


def enlargement(n: int, a: str, b: str) -> Column:
    c = cover(n, a, b)
    whole = reduce(lambda x, y: x * y, [c[f"hi_{d}"] - c[f"lo_{d}"] for d in range(n)])
    return F.when(covers(n, a, b), F.lit(0.0)).otherwise(whole - volume(n, a))


def padded(n: int, *by: float, prefix: str = "") -> dict[str, Column]:
    by = by * n if len(by) == 1 else by
    return {f"{k}_{d}": _c(f"{k}_{d}", prefix) + s * F.lit(float(by[d])) for d in range(n) for k, s in (("lo", -1), ("hi", 1))}


def enlarged_by_factor(n: int, f: float, prefix: str = "") -> dict[str, Column]:
    out = {}
    for d in range(n):
        pad = (_c(f"hi_{d}", prefix) - _c(f"lo_{d}", prefix)) * F.lit(float(f - 1)) / F.lit(2.0)
        out[f"lo_{d}"], out[f"hi_{d}"] = _c(f"lo_{d}", prefix) - pad, _c(f"hi_{d}", prefix) + pad
    return out


def enlarged_by_metres(lat: float, lon: float, prefix: str = "") -> dict[str, Column]:
    radians = _c("lo_0", prefix) * F.lit(math.pi) / F.lit(180.0)
    first = F.lit(float(lat)) * F.abs(F.lit(360.0) / (F.cos(radians) * F.lit(FIRST_METRES))) / F.lit(2.0)
    second = F.lit(lon * (360 / SECOND_METRES) / 2.0)
    return {f"{k}_{d}": _c(f"{k}_{d}", prefix) + s * pad for d, pad in ((0, first), (1, second)) for k, s in (("lo", -1), ("hi", 1))}


def scaled(n: int, share: float, prefix: str = "") -> dict[str, Column]:
    return enlarged_by_factor(n, share ** (1 / n), prefix)


def box_text(n: int, prefix: str = "") -> Column:
    sides = [F.concat(F.lit("["), _c(f"lo_{d}", prefix).cast("string"), F.lit(","), _c(f"hi_{d}", prefix).cast("string"), F.lit("]")) for d in range(n)]
    return F.coalesce(F.concat(F.lit("["), F.concat_ws(":", *sides), F.lit("]")), F.lit("[]"))


def cover_of(df: DataFrame, *keys: str) -> DataFrame:
    """The covering box of all rows, or of each group."""
    n = dimensions_of(df)
    return df.groupBy(*keys).agg(*(f(f"{k}_{d}").alias(f"{k}_{d}") for d in range(n) for k, f in (("lo", F.min), ("hi", F.max))))
