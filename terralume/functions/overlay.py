"""Polygon overlay inside one row, from built-in array functions only.

Two constructions are used. Areas of intersections are sums over edge pairs:
the indicator of a polygon is a signed sum of the regions below its edges, so
the area shared by two polygons is the signed sum of the areas shared by such
regions, each with a closed form. Shapes come from slabs: between two
neighbouring event heights no edges cross, so the kept region is a row of
trapezoids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import geometry as geo
from .geometry import bound

RINGS = 4096  # sides of a part; a part with more rings shares numbers with the next
RUN = "struct<x0:double,y0:double,x1:double,y1:double,s:int>"
RISE = "struct<side:int,w:int,x0:double,y0:double,x1:double,y1:double>"


# ---- area of an intersection ----------------------------------------------

def runs(geom: Column) -> Column:
    """Non-vertical edges left to right with their original direction."""

    def run(e: Column) -> Column:
        forward = e["x2"] > e["x1"]
        return F.struct(
            F.least(e["x1"], e["x2"]).alias("x0"),
            F.when(forward, e["y1"]).otherwise(e["y2"]).alias("y0"),
            F.greatest(e["x1"], e["x2"]).alias("x1"),
            F.when(forward, e["y2"]).otherwise(e["y1"]).alias("y1"),
            F.when(forward, 1).otherwise(-1).alias("s"),
        )

    return F.transform(F.filter(geo.edges(geom), lambda e: e["x1"] != e["x2"]), run)


def _at(e: Column, x: Column) -> Column:
    return e["y0"] + (x - e["x0"]) * (e["y1"] - e["y0"]) / (e["x1"] - e["x0"])


def shared_below(a: Column, b: Column) -> Column:
    """Signed area below both runs, over their common x range."""
    left, right = F.greatest(a["x0"], b["x0"]), F.least(a["x1"], b["x1"])
    ends = F.struct(
        left.alias("l"), right.alias("r"),
        _at(a, left).alias("al"), _at(a, right).alias("ar"),
        _at(b, left).alias("bl"), _at(b, right).alias("br"),
    )

    def piece(v: Column) -> Column:
        dl, dr = v["al"] - v["bl"], v["ar"] - v["br"]
        t = dl / (dl - dr)
        ym = v["al"] + t * (v["ar"] - v["al"])
        lower_l, lower_r = F.least(v["al"], v["bl"]), F.least(v["ar"], v["br"])
        crossing = t * (lower_l + ym) + (1 - t) * (ym + lower_r)
        doubled = F.when(dl * dr < 0, crossing).otherwise(lower_l + lower_r)
        return (v["r"] - v["l"]) * doubled / 2

    return F.when(right > left, a["s"] * b["s"] * bound(ends, piece)).otherwise(F.lit(0.0))


def overlap(runs_a: Column, runs_b: Column) -> Column:
    """Shared area of two polygons given as runs, in squared coordinate units."""
    return F.aggregate(
        runs_a,
        F.lit(0.0),
        lambda acc, a: acc
        + F.aggregate(runs_b, F.lit(0.0), lambda sub, b: sub + shared_below(a, b)),
    )


# ---- slabs ----------------------------------------------------------------

def rises(geom: Column, side: int = 0) -> Column:
    """Non-horizontal edges bottom to top; `w` is +1 on the left of the inside."""

    def rise(e: Column) -> Column:
        up = e["y2"] > e["y1"]
        return F.struct(
            F.lit(side).alias("side"),
            F.when(up, -1).otherwise(1).alias("w"),
            F.when(up, e["x1"]).otherwise(e["x2"]).alias("x0"),
            F.least(e["y1"], e["y2"]).alias("y0"),
            F.when(up, e["x2"]).otherwise(e["x1"]).alias("x1"),
            F.greatest(e["y1"], e["y2"]).alias("y1"),
        )

    return F.transform(F.filter(geo.edges(geom), lambda e: e["y1"] != e["y2"]), rise)


def as_side(rise_list: Column, side: int) -> Column:
    return F.transform(rise_list, lambda e: e.withField("side", F.lit(side)))


def _x_at(e: Column, y: Column) -> Column:
    return (
        F.when(y == e["y0"], e["x0"])
        .when(y == e["y1"], e["x1"])
        .otherwise(e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"]))
    )


def _crossing_heights(rise_list: Column) -> Column:
    """Heights at which two rises cross, neither touching at its end there."""

    def cross(e: Column, f: Column) -> Column:
        low, high = F.greatest(e["y0"], f["y0"]), F.least(e["y1"], f["y1"])
        dl, dh = _x_at(e, low) - _x_at(f, low), _x_at(e, high) - _x_at(f, high)
        return F.when((low < high) & (dl * dh < 0), low + (high - low) * dl / (dl - dh))

    def of_one(e: Column, i: Column) -> Column:
        later = F.slice(rise_list, i + 2, F.size(rise_list))
        near = F.filter(
            later,
            lambda f: (f["y0"] < e["y1"])
            & (e["y0"] < f["y1"])
            & (F.least(f["x0"], f["x1"]) < F.greatest(e["x0"], e["x1"]))
            & (F.least(e["x0"], e["x1"]) < F.greatest(f["x0"], f["x1"])),
        )
        return F.transform(near, lambda f: cross(e, f))

    return F.flatten(F.transform(rise_list, of_one))


def _heights(rise_list: Column, extra: Column | None = None) -> Column:
    ends = [
        F.transform(rise_list, lambda e: e["y0"]),
        F.transform(rise_list, lambda e: e["y1"]),
        _crossing_heights(rise_list),
    ]
    if extra is not None:
        ends.append(extra)
    found = F.filter(F.concat(*ends), lambda y: y.isNotNull())
    return F.array_sort(F.array_distinct(found))


def _active(rise_list: Column, low: Column, high: Column) -> Column:
    """Rises spanning a slab from left to right."""
    mid = (low + high) / 2
    spanning = F.filter(rise_list, lambda e: (e["y0"] <= low) & (e["y1"] >= high))
    return F.array_sort(
        F.transform(
            spanning,
            lambda e: F.struct(
                _x_at(e, mid).alias("xm"),
                _x_at(e, low).alias("xa"),
                _x_at(e, high).alias("xb"),
                e["side"].alias("side"),
                e["w"].alias("w"),
            ),
        )
    )


def _winding(active: Column, upto: Column, side: int) -> Column:
    return F.aggregate(
        F.slice(active, F.lit(1), upto + 1),
        F.lit(0),
        lambda acc, e: acc + F.when(e["side"] == side, e["w"]).otherwise(0),
    )


def _within_parts(active: Column, upto: Column) -> Column:
    """In the shell of a part and in none of its holes; sides number rings, `RINGS` to a part."""
    seen = F.transform(F.slice(active, F.lit(1), upto + 1), lambda e: e["side"])
    odd = F.filter(F.array_distinct(seen), lambda s: F.size(F.filter(seen, lambda t: t == s)) % 2 == 1)
    part = lambda s: F.floor(s / RINGS)
    return bound(
        odd,
        lambda held: F.exists(
            held, lambda s: (s % RINGS == 0) & ~F.exists(held, lambda h: (h % RINGS > 0) & (part(h) == part(s)))
        ),
    )


def _slab_strips(rise_list: Column, ys: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """Kept trapezoids as STRUCT<ya, yb, l, r> with l and r the bounding rises."""

    def one(low: Column, high: Column) -> Column:
        def strips(active: Column) -> Column:
            cells = F.transform(
                active,
                lambda e, i: F.struct(
                    low.alias("ya"),
                    high.alias("yb"),
                    e.alias("l"),
                    F.get(active, i + 1).alias("r"),
                    keep(active, i).alias("k"),
                ),
            )
            return F.filter(
                cells,
                lambda c: c["k"]
                & c["r"].isNotNull()
                & ((c["r"]["xa"] > c["l"]["xa"]) | (c["r"]["xb"] > c["l"]["xb"])),
            )

        return bound(_active(rise_list, low, high), strips)

    gaps = F.greatest(F.size(ys) - 1, F.lit(0))
    lows, highs = F.slice(ys, F.lit(1), gaps), F.slice(ys, F.lit(2), gaps)
    return F.flatten(F.zip_with(lows, highs, one))


def _strip_part(c: Column) -> Column:
    corners = F.array(
        geo.point(c["l"]["xa"], c["ya"]),
        geo.point(c["r"]["xa"], c["ya"]),
        geo.point(c["r"]["xb"], c["yb"]),
        geo.point(c["l"]["xb"], c["yb"]),
        geo.point(c["l"]["xa"], c["ya"]),
    )
    return F.array(geo.without_repeats(corners))


def _swept(rise_list: Column, keep: Callable[[Column, Column], Column]) -> Column:
    return bound(
        rise_list,
        lambda es: bound(
            _heights(es), lambda ys: F.transform(_slab_strips(es, ys, keep), _strip_part)
        ),
    )


def _inside(active: Column, i: Column, side: int) -> Column:
    return _winding(active, i, side) > 0


def intersection(rises_a: Column, rises_b: Column) -> Column:
    """Geometry shared by both sides; each argument is a column of rises."""
    both = F.concat(as_side(rises_a, 0), as_side(rises_b, 1))
    return geo.geometry(_swept(both, lambda act, i: _inside(act, i, 0) & _inside(act, i, 1)))


def difference(rises_a: Column, rises_b: Column) -> Column:
    both = F.concat(as_side(rises_a, 0), as_side(rises_b, 1))
    return geo.geometry(_swept(both, lambda act, i: _inside(act, i, 0) & ~_inside(act, i, 1)))


def union(rises_all: Column) -> Column:
    """Union of all polygons whose rises are in the array."""
    return geo.geometry(_swept(as_side(rises_all, 0), lambda act, i: _inside(act, i, 0)))


def _ring_rises(geom: Column) -> Column:
    """Rises with a side for each ring."""
    one = lambda ring, side: F.transform(
        rises(geo.geometry(F.array(F.array(ring)))), lambda e: e.withField("side", side.cast("int"))
    )
    return F.flatten(
        F.transform(geom["parts"], lambda part, p: F.flatten(F.transform(part, lambda ring, r: one(ring, p * RINGS + r))))
    )


def repaired(geom: Column) -> Column:
    """What lies in a shell and in none of its holes: a bow-tie becomes two triangles, a nested part goes.

    Strips of one row; `topology.repaired` rebuilds rings for tables of shapes.
    """
    parts = _swept(_ring_rises(geom), _within_parts)
    return geo.geometry(parts, srid=geom["srid"])


def _plainly_nested(geom: Column) -> Column:
    """Rings that don't cross are nested as they should be when their signed areas add up to the area covered."""
    covered = geo.planar_area(geo.geometry(_swept(_ring_rises(geom), _within_parts)))
    return F.abs(covered - geo.planar_area(geom)) <= 1e-9 * covered


def made_valid(geom: Column) -> Column:
    """The geometry as it is when valid, else repaired; NULL when nothing is left."""
    valid = geo.is_valid(geom) & ((F.size(geo.rings(geom)) <= 1) | _plainly_nested(geom))
    fixed = F.when(valid, geo.oriented(geom)).otherwise(repaired(geom))
    return bound(fixed, lambda g: F.when(F.size(g["parts"]) > 0, g))


# ---- union area within a tile ---------------------------------------------

def tile_union(rise_list: Column, tile: Column) -> Column:
    """Area covered within a tile STRUCT<x0, y0, x1, y1> by polygons given as rises.

    Heights where a rise leaves the tile sideways are events too, so within a
    slab every rise is either inside or beyond one side, and clamping its x to
    the tile keeps it straight.
    """

    def side_heights(x: Column, es: Column) -> Column:
        return F.transform(
            es,
            lambda e: F.when(
                (e["x0"] - x) * (e["x1"] - x) < 0,
                e["y0"] + (x - e["x0"]) * (e["y1"] - e["y0"]) / (e["x1"] - e["x0"]),
            ),
        )

    def clamp(x: Column) -> Column:
        return F.least(F.greatest(x, tile["x0"]), tile["x1"])

    def strip_area(c: Column) -> Column:
        low = clamp(c["r"]["xa"]) - clamp(c["l"]["xa"])
        high = clamp(c["r"]["xb"]) - clamp(c["l"]["xb"])
        return (c["yb"] - c["ya"]) * (low + high) / 2

    def within(es: Column) -> Column:
        bounds = F.array(tile["y0"], tile["y1"])
        extra = F.concat(bounds, side_heights(tile["x0"], es), side_heights(tile["x1"], es))
        ys = F.filter(_heights(es, extra), lambda y: y.between(tile["y0"], tile["y1"]))
        strips = bound(ys, lambda h: _slab_strips(es, h, lambda act, i: _inside(act, i, 0)))
        return F.aggregate(strips, F.lit(0.0), lambda acc, c: acc + strip_area(c))

    return bound(rise_list, within)
