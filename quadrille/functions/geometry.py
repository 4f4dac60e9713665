"""GeoJSON geometries and the tests on them that Spark lacks: intersection and distance in metres.

Points, line strings and polygons (outer ring only) in coordinate order ``x, y``. Distances are
great-circle ones on a sphere of the Earth's mean radius, within 0.6 % of the ellipsoid's.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

Point = tuple[float, float]
RADIUS = 6_371_008.8


@dataclass(frozen=True)
class Geometry:
    kind: str
    points: tuple[Point, ...]
    properties: tuple[tuple[str, str], ...] = ()
    id: int | None = None

    @property
    def segments(self) -> list[tuple[Point, Point]]:
        return list(zip(self.points, self.points[1:], strict=False))


def parse(text: str | bytes) -> Geometry:
    """From a feature or a bare geometry."""
    data = json.loads(text)
    shape = data.get("geometry", data)
    kind, c = shape["type"], shape["coordinates"]
    if kind == "Point":
        points = [c]
    elif kind == "LineString":
        points = c
    elif kind == "Polygon":
        points = c[0]
    else:
        raise ValueError(f"unknown geometry: {kind}")
    props = data.get("properties") or {}
    return Geometry(kind, tuple((float(p[0]), float(p[1])) for p in points), tuple((k, str(v)) for k, v in props.items()), data.get("id"))


def to_text(g: Geometry) -> str:
    shape = {"Point": lambda: list(g.points[0]), "LineString": lambda: [list(p) for p in g.points], "Polygon": lambda: [[list(p) for p in g.points]]}[g.kind]()
    return json.dumps({"type": "Feature", "id": g.id, "geometry": {"type": g.kind, "coordinates": shape}, "properties": dict(g.properties)})


def _side(a: Point, b: Point, p: Point) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def on_segment(p: Point, a: Point, b: Point) -> bool:
    return _side(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def segments_meet(a: Point, b: Point, c: Point, d: Point) -> bool:
    one, two, three, four = _side(c, d, a), _side(c, d, b), _side(a, b, c), _side(a, b, d)
    if ((one > 0) != (two > 0)) and ((three > 0) != (four > 0)) and 0 not in (one, two, three, four):
        return True
    return on_segment(a, c, d) or on_segment(b, c, d) or on_segment(c, a, b) or on_segment(d, a, b)


def in_ring(p: Point, ring: tuple[Point, ...]) -> bool:
    """Inside or on the border."""
    inside = False
    for a, b in zip(ring, (*ring[1:], ring[0]), strict=True):
        if on_segment(p, a, b):
            return True
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            inside = not inside
    return inside


def intersects(a: Geometry, b: Geometry) -> bool:
    if a.kind == "Point" and b.kind == "Point":
        return a.points[0] == b.points[0]
    for one, two in ((a, b), (b, a)):
        if one.kind == "Polygon" and in_ring(two.points[0], one.points):
            return True
    if a.kind == "Point" or b.kind == "Point":
        p, other = (a.points[0], b) if a.kind == "Point" else (b.points[0], a)
        return any(on_segment(p, *s) for s in other.segments)
    return any(segments_meet(*s, *t) for s in a.segments for t in b.segments)


def metres(p: Point, q: Point) -> float:
    """Great-circle distance of ``longitude, latitude`` points."""
    lon, lat = math.radians(q[0] - p[0]), math.radians(q[1] - p[1])
    h = math.sin(lat / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(lon / 2) ** 2
    return 2 * RADIUS * math.asin(min(1.0, math.sqrt(h)))


def nearest(p: Point, a: Point, b: Point) -> Point:
    """The point of a segment that is nearest in the plane."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    if dx == dy == 0:
        return a
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
    return a[0] + t * dx, a[1] + t * dy


def near(a: Geometry, b: Geometry, within: float) -> bool:
    """Whether they intersect, or one is a point within so many metres of the other."""
    if intersects(a, b):
        return True
    if not within or "Point" not in (a.kind, b.kind):
        return False
    p, other = (a.points[0], b) if a.kind == "Point" else (b.points[0], a)
    ends = [nearest(p, *s) for s in other.segments] or list(other.points)
    return min(metres(p, q) for q in ends) < within


def intersect_text(a: str, b: str) -> bool:
    return intersects(parse(a), parse(b))


def near_text(a: str, b: str, within: float) -> bool:
    return near(parse(a), parse(b), within)
