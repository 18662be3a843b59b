"""Regions of interest as boolean Columns, with bounding boxes that only prune."""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom import storage

Box = tuple[tuple[float, float, float], tuple[float, float, float]]


class Region:
    """A predicate over (x, y, z) and a box that contains it."""

    def __init__(self, predicate, box: Box | None):
        self.predicate, self.box = predicate, box

    def contains(self, x: Column, y: Column, z: Column) -> Column:
        """The exact predicate, behind a test of the box that can be pushed to a scan."""
        exact = self.predicate(x, y, z)
        if self.box is None:
            return exact
        inside = reduce(lambda p, q: p & q, (c.between(a, b) for c, a, b in zip((x, y, z), *self.box, strict=True)))
        return inside & exact

    def __or__(self, other: Region) -> Region:
        return union([self, other])

    def __sub__(self, other: Region) -> Region:
        return subtract([self, other])

    def __and__(self, other: Region) -> Region:
        return Region(lambda x, y, z: self.predicate(x, y, z) & other.predicate(x, y, z), self.box)

    def __invert__(self) -> Region:
        return Region(lambda x, y, z: ~self.predicate(x, y, z), None)


def _around(center, half) -> Box:
    return tuple(c - h for c, h in zip(center, half, strict=True)), tuple(c + h for c, h in zip(center, half, strict=True))


def cube(center, half) -> Region:
    def test(x, y, z):
        return reduce(lambda p, q: p & q, (F.abs(c - a) <= h for c, a, h in zip((x, y, z), center, half, strict=True)))

    return Region(test, _around(center, half))


def sphere(center, radius: float) -> Region:
    def test(x, y, z):
        return sum(((c - a) * (c - a) for c, a in zip((x, y, z), center, strict=True)), F.lit(0.0)) <= radius * radius

    return Region(test, _around(center, (radius,) * 3))


def cylinder(center, radius: float, half_height: float) -> Region:
    """Axis along z."""

    def test(x, y, z):
        return ((x - center[0]) * (x - center[0]) + (y - center[1]) * (y - center[1]) <= radius * radius) & (F.abs(z - center[2]) <= half_height)

    return Region(test, _around(center, (radius, radius, half_height)))


def _hull(boxes: list[Box | None]) -> Box | None:
    if not boxes or any(b is None for b in boxes):
        return None
    return tuple(min(b[0][i] for b in boxes) for i in range(3)), tuple(max(b[1][i] for b in boxes) for i in range(3))


def union(children: list[Region]) -> Region:
    """False without children."""
    return Region(lambda x, y, z: reduce(lambda p, q: p | q, (c.predicate(x, y, z) for c in children), F.lit(False)), _hull([c.box for c in children]))


def subtract(children: list[Region]) -> Region:
    """The first child without the others; false without children. The box is that of all children, so too large."""
    if not children:
        return Region(lambda x, y, z: F.lit(False), None)
    return Region(lambda x, y, z: reduce(lambda p, q: p & ~q.predicate(x, y, z), children[1:], children[0].predicate(x, y, z)), _hull([c.box for c in children]))


def elongated(region: Region, factor: float, axis: int = 2) -> Region:
    """The region stretched along an axis about the origin."""

    def test(*xyz):
        return region.predicate(*[c / factor if i == axis else c for i, c in enumerate(xyz)])

    box = region.box and tuple(tuple(v * factor if i == axis else v for i, v in enumerate(corner)) for corner in region.box)
    return Region(test, box)


def clip_plane(depth: float, azimuth: float, elevation: float) -> Region:
    """The half space below a plane at ``depth`` along the direction of the two angles (radians)."""
    n = (math.cos(elevation) * math.cos(azimuth), math.cos(elevation) * math.sin(azimuth), math.sin(elevation))
    return Region(lambda x, y, z: x * n[0] + y * n[1] + z * n[2] <= depth, None)


#: Shapes and nodes by the names under which a stored collection knows them.
SHAPES = {"cube": cube, "sphere": sphere, "cylinder": cylinder, "clip_plane": clip_plane}
NODES = {"union": union, "subtract": subtract}


def build(record: dict) -> Region:
    """The region that a record describes: {"kind": shape, its parameters} or {"kind": node, "children": [records]}."""
    rest = {k: v for k, v in record.items() if k != "kind"}
    if record["kind"] in NODES:
        return NODES[record["kind"]]([build(child) for child in rest["children"]])
    if record["kind"] not in SHAPES:
        raise ValueError(f"no region of kind {record['kind']}")
    return SHAPES[record["kind"]](**rest)


def save_collection(records: list[dict], path: str) -> None:
    for record in records:
        build(record)  # a record that cannot be read again is not stored
    storage.write_bytes(path, json.dumps(records).encode())


def load_collection(path: str) -> list[Region]:
    return [build(record) for record in json.loads(storage.read_bytes(path))]
