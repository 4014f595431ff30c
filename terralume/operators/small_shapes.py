"""The steps of `topology` for shapes of few edges, within their row.

The edges of a small shape are fewer than the rows a join would make of them, so all
of them are compared at once. The rules are those of `topology`, which keeps every larger shape.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TURN = 2 * math.pi
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])


def _edges(rings: list) -> list:
    """(part, ring, edges of the ring, number, ends) of every edge."""
    found = []
    for part, ring, points in rings:
        path = [p for i, p in enumerate(points) if i == 0 or p != points[i - 1]]
        path += path[:1] if path and path[0] != path[-1] else []
        found += [(part, ring, len(path) - 1, i, *path[i], *path[i + 1]) for i in range(len(path) - 1)]
    return found


def _meetings(edges: list) -> tuple[dict, set, dict]:
    """Points where edges are cut, what is wrong there, and the rings that touch in a point of a part."""
    cuts, wrong, touch = defaultdict(set), set(), defaultdict(set)
    boxes = [(min(e[4], e[6]), max(e[4], e[6]), min(e[5], e[7]), max(e[5], e[7])) for e in edges]
    for i, (pa_, ra, n, sa, ax, ay, cx, cy) in enumerate(edges):
        left, right, low, high = boxes[i]
        for j in range(i + 1, len(edges)):
            bl, br, bb, bt = boxes[j]
            if bl > right or br < left or bb > high or bt < low:
                continue
            pb, rb, _, sb, bx, by, dx, dy = edges[j]
            a1, a2 = ((dx - bx) * (y - by) - (dy - by) * (x - bx) for x, y in ((ax, ay), (cx, cy)))
            b1, b2 = ((cx - ax) * (y - ay) - (cy - ay) * (x - ax) for x, y in ((bx, by), (dx, dy)))
            if a1 * a2 > 0 or b1 * b2 > 0:
                continue
            proper = a1 * a2 < 0 and b1 * b2 < 0
            if proper:
                share = a1 / (a1 - a2)
                points = {(ax + share * (cx - ax), ay + share * (cy - ay))}
            else:
                points = {(x, y) for x, y, t in ((ax, ay, a1), (cx, cy, a2)) if t == 0 and bl <= x <= br and bb <= y <= bt}
                points |= {(x, y) for x, y, t in ((bx, by, b1), (dx, dy, b2)) if t == 0 and left <= x <= right and low <= y <= high}
            if not points:
                continue
            cuts[i] |= points
            cuts[j] |= points
            same = pa_ == pb and ra == rb
            if proper:
                wrong.add("CROSSING")
            elif len(points) > 1:
                wrong.add("SHARED")
            elif same and sb - sa not in (1, n - 1):
                wrong.add("TOUCHING")
            if pa_ == pb and ra != rb:
                for p in points:
                    touch[pa_, p] |= {ra, rb}
    return cuts, wrong, touch


def _circle(touch: dict) -> bool:
    """Rings of a part touch in a circle."""
    groups = defaultdict(list)
    for (part, _), rings in touch.items():
        hit = [g for g in groups[part] if g & rings]
        if any(len(g & rings) > 1 for g in hit):
            return True
        groups[part] = [g for g in groups[part] if not g & rings] + [rings.union(*hit)]
    return False


def _inside(rings: set) -> bool:
    return any(r == 0 and not any(h > 0 and q == p for q, h in rings) for p, r in rings)


def _sides(edges: list, cuts: dict, slant: float) -> list:
    """Pieces of edges as (p, q, copies, area to the left, area to the right)."""
    counts = defaultdict(Counter)
    for i, (part, ring, _, _, ax, ay, bx, by) in enumerate(edges):
        inner = sorted(((x - ax) * (bx - ax) + (y - ay) * (by - ay), (x, y)) for x, y in cuts.get(i, ()) if (x, y) not in ((ax, ay), (bx, by)))
        path = [(ax, ay), *(p for _, p in inner), (bx, by)]
        for ends in zip(path, path[1:]):
            p, q = sorted((y + slant * x, x, y) for x, y in ends)
            if p != q:
                counts[p, q][part, ring] += 1
    walls = [(p, q, own) for (p, q), per in counts.items() if (own := {r for r, n in per.items() if n % 2})]
    found = []
    for (p, q), per in counts.items():
        w, x, beside = (p[0] + q[0]) / 2, (p[1] + q[1]) / 2, set()
        for a, b, own in walls:
            if a[0] <= w < b[0] and a[1] + (w - a[0]) / (b[0] - a[0]) * (b[1] - a[1]) < x and (a, b) != (p, q):
                beside ^= own
        own = {r for r, n in per.items() if n % 2}
        found.append((p[1:], q[1:], sum(per.values()), _inside(beside), _inside(beside ^ own)))
    return found


def _rings(outline: list) -> list:
    """Closed rings from directed edges, from the smallest edge of each on, without straight vertices."""
    leave = defaultdict(list)
    for p, q in outline:
        leave[p].append((math.atan2(q[1] - p[1], q[0] - p[0]), q))
    after = {}
    for p, q in outline:
        back = math.atan2(p[1] - q[1], p[0] - q[0])
        turns = [(math.fmod(math.fmod(back - out, TURN) + TURN, TURN) or TURN, r) for out, r in leave[q]]
        if turns:
            after[p, q] = (q, min(turns)[1])
    found, seen = [], set()
    for edge in sorted(outline):
        path, at = [], edge
        while at not in seen:
            seen.add(at)
            path.append(at[0])
            at = after.get(at)
            if at is None:
                break
        if path and at == edge:
            path.append(path[0])
            last = len(path) - 1
            found.append([
                p for i, p in enumerate(path)
                if i in (0, last) or (path[i + 1][0] - path[i - 1][0]) * (p[1] - path[i - 1][1]) != (path[i + 1][1] - path[i - 1][1]) * (p[0] - path[i - 1][0])
            ])
    return found


def _area(path: list) -> float:
    total = 0.0
    for a, b in zip(path, path[1:]):
        total += a[0] * b[1] - b[0] * a[1]
    return total / 2


def _polygons(paths: list) -> list:
    """Parts: holes go to the smallest shell around them."""
    sized = [(a, p) for p in paths if (a := _area(p)) != 0]
    shells = [(a, p, []) for a, p in sized if a > 0]
    for _, hole in (s for s in sized if s[0] < 0):
        x, y = (hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2
        odd = lambda path: sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in zip(path, path[1:])) % 2
        if around := [s for s in shells if odd(s[1])]:
            min(around, key=lambda s: s[0])[2].append(hole)
    return sorted([path, *sorted(holes)] for _, path, holes in shells)


def arranged(parts: list, order: dict, slant: float) -> tuple[str | None, bool, list]:
    """The first fault of a shape in the given order, whether it has an outline, and the polygons it covers."""
    rings = [(p, r, points) for p, part in enumerate(parts) for r, points in enumerate(part)]
    edges = _edges(rings)
    cuts, wrong, touch = _meetings(edges)
    sides = _sides(edges, cuts, slant)
    if any(not r or r[0] != r[-1] or len(set(r)) < 3 for _, _, r in rings):
        wrong.add("RING")
    if any(s[2] > 1 for s in sides):
        wrong.add("SHARED")
    if any(s[3] == s[4] for s in sides):
        wrong.add("NESTED")
    if _circle(touch):
        wrong.add("SPLIT")
    outline = [(p, q) if left else (q, p) for p, q, _, left, right in sides if left != right]
    fault = next((text for name, text in order.items() if name in wrong), None)
    return fault, bool(outline), _polygons(_rings(outline))


def _listed(column: pa.Array) -> Iterator[list]:
    """Parts of each row as lists of rings of (x, y)."""
    rings = column.flatten().flatten()
    points = rings.flatten()
    flat = list(zip(points.field("x").to_pylist(), points.field("y").to_pylist()))

    def cut(values: list, lists: pa.Array) -> list:
        at = [0]
        for n in lists.value_lengths().to_pylist():
            at.append(at[-1] + (n or 0))
        return [values[a:b] for a, b in zip(at, at[1:])]

    yield from cut(cut(cut(flat, rings), column.flatten()), column)


def _nested(rows: list) -> pa.Array:
    def ends(lists: list) -> pa.Array:
        at = [0]
        for x in lists:
            at.append(at[-1] + len(x))
        return pa.array(at, pa.int32())

    parts = [p for r in rows for p in r]
    rings = [r for p in parts for r in p]
    points = [p for r in rings for p in r]
    xy = pa.StructArray.from_arrays([pa.array([p[k] for p in points], pa.float64()) for k in (0, 1)], fields=list(_POINT))
    return pa.ListArray.from_arrays(ends(rows), pa.ListArray.from_arrays(ends(parts), pa.ListArray.from_arrays(ends(rings), xy)))


def judged(df: DataFrame, order: dict, slant: float) -> DataFrame:
    """`df` (a key and ``parts``, none of it null) with ``fault``, ``left`` and ``made``, the parts of what it covers."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [arranged(parts, order, slant) for parts in _listed(batch.column(1))]
            made = [
                pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.bool_()), _nested([f[2] for f in found]),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=[*names, "fault", "left", "made"])

    key, kind = df.schema[0], df.schema["parts"].dataType.simpleString()
    names = [key.name]
    return df.mapInArrow(each, f"`{key.name}` {key.dataType.simpleString()}, fault string, left boolean, made {kind}")
