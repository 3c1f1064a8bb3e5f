"""Plane geometry as expressions and small parsers: edges, centroids, WKT and WKB."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]


def box(x1: float, y1: float, x2: float, y2: float) -> Ring:
    return [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]


def edges(rings: list[Ring]) -> list[tuple[float, float, float, float]]:
    return [(*a, *b) for ring in rings for a, b in zip(ring, ring[1:], strict=False)]


def centroid(ring: Ring) -> tuple[float, float]:
    """Area-weighted centre of a closed ring; the mean of its corners if it has no area."""
    area = sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False)) / 2
    if not area:
        return sum(x for x, _ in ring[:-1]) / (len(ring) - 1), sum(y for _, y in ring[:-1]) / (len(ring) - 1)
    cx = sum((x1 + x2) * (x1 * y2 - x2 * y1) for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False))
    cy = sum((y1 + y2) * (x1 * y2 - x2 * y1) for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False))
    return cx / (6 * area), cy / (6 * area)


def read_wkb(data: bytes) -> list[Ring]:
    """Rings of a polygon or multipolygon."""

    def part(at: int) -> tuple[list[Ring], int]:
        order = "<" if data[at] else ">"
        (kind,) = struct.unpack_from(order + "I", data, at + 1)
        (n,) = struct.unpack_from(order + "I", data, at + 5)
        at += 9
        rings: list[Ring] = []
        for _ in range(n):
            if kind == 6:
                more, at = part(at)
                rings += more
            elif kind == 3:
                (k,) = struct.unpack_from(order + "I", data, at)
                xy = struct.unpack_from(order + f"{2 * k}d", data, at + 4)
                rings.append(list(zip(xy[::2], xy[1::2], strict=True)))
                at += 4 + 16 * k
            else:
                raise ValueError(f"not a polygon: type {kind}")
        return rings, at

    return part(0)[0]


def polygon_wkt(rings: list[Ring]) -> str:
    """Rings as WKT with all digits: a ring inside the last outer one is a hole of it, others begin a polygon of their own."""
    polygons: list[list[Ring]] = []
    for ring in rings:
        if polygons and within(ring[0], polygons[-1][0]):
            polygons[-1].append(ring)
        else:
            polygons.append([ring])
    line = lambda r: "(" + ", ".join(f"{x!r} {y!r}" for x, y in r) + ")"
    parts = ["(" + ", ".join(map(line, own)) + ")" for own in polygons]
    return f"POLYGON {parts[0]}" if len(parts) == 1 else f"MULTIPOLYGON ({', '.join(parts)})"


def within(point: tuple[float, float], ring: Ring) -> bool:
    """Whether a point lies strictly inside a closed ring: not on its boundary."""
    x, y = point
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return False
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def dissolved(areas: dict[str, list[Ring]], group: dict[str, str]) -> dict[str, list[Ring]]:
    """Rings of each group's areas without the edges that two of its areas share in opposite directions.

    Membership of points is that of the union, as crossings of a shared edge cancel out.
    """
    out: dict[str, list[Ring]] = {}
    by: dict[str, list[Ring]] = {}
    for area, rings in areas.items():
        by.setdefault(group[area], []).extend(rings)
    for name, rings in by.items():
        left: dict[tuple, int] = {}
        for e in (e for r in rings for e in edges([r])):
            back = (e[2], e[3], e[0], e[1])
            if left.get(back):
                left[back] -= 1
            else:
                left[e] = left.get(e, 0) + 1
        after: dict[tuple[float, float], list[tuple[float, float]]] = {}
        for (x1, y1, x2, y2), n in left.items():
            after.setdefault((x1, y1), []).extend([(x2, y2)] * n)
        out[name] = []
        while after:
            start = at = next(iter(after))
            ring = [start]
            while after.get(at):
                nxt = after[at].pop()
                if not after[at]:
                    del after[at]
                ring.append(nxt)
                at = nxt
                if at == start:
                    break
            out[name].append(ring)
    return out


def point_wkt(lon: Column, lat: Column) -> Column:
    return F.when(lon.isNotNull() & lat.isNotNull(), F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")")))


def wkt_x(c: Column) -> Column:
    return F.regexp_extract(c, r"POINT \((-?[0-9.Ee+-]+) ", 1).try_cast("double")


def wkt_y(c: Column) -> Column:
    return F.regexp_extract(c, r"POINT \(-?[0-9.Ee+-]+ (-?[0-9.Ee+-]+)\)", 1).try_cast("double")
