"""Plans of continuous queries: a fluent builder, and their JSON form."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from quadrille.functions.boxes import Box
from quadrille.operators.filters import Filter


@dataclass(frozen=True)
class Transformation:
    """One step on a tuple: ``key``, ``box``, ``amount``, ``factor``, ``metres`` or ``filter``."""

    kind: str
    values: tuple

    KINDS = ("key", "box", "amount", "factor", "metres", "filter")

    def __post_init__(self):
        if self.kind not in self.KINDS:
            raise ValueError(f"unknown transformation: {self.kind}")


@dataclass(frozen=True)
class ContinuousPlan:
    """A range plan compares stream tuples with a box; a join plan with a stored table."""

    stream_table: str
    range: Box = Box()
    compare: Box | None = None
    join_table: str | None = None
    positive: bool = True
    stream_steps: tuple[Transformation, ...] = ()
    stored_steps: tuple[Transformation, ...] = ()
    stream_filters: tuple[Filter, ...] = ()
    join_filters: tuple[Filter, ...] = ()
    watermarks: bool = False
    invalidations: bool = False
    idle_after: int = 0
    id: str = field(default_factory=lambda: str(uuid.uuid4()))

    def __post_init__(self):
        if (self.compare is None) == (self.join_table is None):
            raise ValueError("a plan needs either a box to compare with or a table to join")
        if self.join_table is not None and not self.positive:
            raise ValueError("a join cannot report negative matches")

    def to_json(self) -> str:
        steps = lambda ts: [{"type": t.kind, "values": [str(v) if isinstance(v, Box) else v for v in t.values]} for t in ts]
        filters = lambda fs: [{"name": f.name, "value": f.value} for f in fs]
        return json.dumps({
            "type": "range" if self.join_table is None else "join", "id": self.id, "stream_table": self.stream_table, "join_table": self.join_table,
            "range": str(self.range), "compare": None if self.compare is None else str(self.compare), "positive": self.positive,
            "stream_steps": steps(self.stream_steps), "stored_steps": steps(self.stored_steps), "stream_filters": filters(self.stream_filters),
            "join_filters": filters(self.join_filters), "watermarks": self.watermarks, "invalidations": self.invalidations, "idle_after": self.idle_after,
        })

    @classmethod
    def from_json(cls, text: str) -> ContinuousPlan:
        try:
            d = json.loads(text)
            if d["type"] not in ("range", "join"):
                raise ValueError(f"unknown plan: {d['type']}")
            steps = lambda ts: tuple(Transformation(t["type"], tuple(Box.parse(v) if t["type"] == "box" else v for v in t["values"])) for t in ts)
            filters = lambda fs: tuple(Filter(f["name"], f["value"]) for f in fs)
            return cls(
                d["stream_table"], Box.parse(d["range"]), None if d["compare"] is None else Box.parse(d["compare"]), d["join_table"], d["positive"],
                steps(d["stream_steps"]), steps(d["stored_steps"]), filters(d["stream_filters"]), filters(d["join_filters"]),
                d["watermarks"], d["invalidations"], d["idle_after"], d["id"],
            )
        except (KeyError, TypeError, AttributeError) as e:
            raise ValueError(f"not a plan: {e}") from e


class QueryPlanBuilder:
    """``QueryPlanBuilder("stream").in_space(box).compare_with(box).build()``."""

    def __init__(self, table: str):
        self.parts: dict = {"stream_table": table, "stream_steps": (), "stored_steps": (), "stream_filters": (), "join_filters": ()}

    def _with(self, **parts) -> QueryPlanBuilder:
        self.parts |= parts
        return self

    def _add(self, where: str, *what) -> QueryPlanBuilder:
        return self._with(**{where: self.parts[where] + what})

    def in_space(self, box: Box):
        return self._with(range=box)

    def compare_with(self, box: Box):
        return self._with(compare=box)

    def join_with(self, table: str):
        return self._with(join_table=table)

    def report_positive(self):
        return self._with(positive=True)

    def report_negative(self):
        return self._with(positive=False)

    def receive_watermarks(self, on: bool = True):
        return self._with(watermarks=on)

    def receive_invalidations(self, on: bool = True):
        return self._with(invalidations=on)

    def filter_stream_by_key(self, key: str):
        return self._add("stream_steps", Transformation("key", (key,)))

    def filter_stream_by_box(self, box: Box):
        return self._add("stream_steps", Transformation("box", (box,)))

    def enlarge_stream_by_amount(self, amount: float):
        return self._add("stream_steps", Transformation("amount", (amount,)))

    def enlarge_stream_by_factor(self, factor: float):
        return self._add("stream_steps", Transformation("factor", (factor,)))

    def enlarge_stream_by_metres(self, lat: float, lon: float):
        return self._add("stream_steps", Transformation("metres", (lat, lon)))

    def transform_stream_by_filter(self, f: Filter):
        return self._add("stream_steps", Transformation("filter", (f.name, f.value)))

    def filter_stored_by_key(self, key: str):
        return self._add("stored_steps", Transformation("key", (key,)))

    def filter_stored_by_box(self, box: Box):
        return self._add("stored_steps", Transformation("box", (box,)))

    def add_stream_filter(self, f: Filter):
        return self._add("stream_filters", f)

    def add_join_filter(self, f: Filter):
        return self._add("join_filters", f)

    def invalidate_after_watermarks(self, n: int):
        return self._with(idle_after=n)

    def build(self) -> ContinuousPlan:
        return ContinuousPlan(**self.parts)


def enlargement_of(plans: list[ContinuousPlan]) -> dict[str, float]:
    """How much a stream's tuples can grow under any of the plans: sums of amounts and metres, products of factors."""
    out = {"amount": 0.0, "factor": 1.0, "lat": 0.0, "lon": 0.0}
    for p in plans:
        amount, factor, lat, lon = 0.0, 1.0, 0.0, 0.0
        for t in p.stream_steps:
            if t.kind == "amount":
                amount += t.values[0]
            elif t.kind == "factor":
                factor *= t.values[0]
            elif t.kind == "metres":
                lat, lon = lat + t.values[0], lon + t.values[1]
        out = {"amount": max(out["amount"], amount), "factor": max(out["factor"], factor), "lat": max(out["lat"], lat), "lon": max(out["lon"], lon)}
    return out
