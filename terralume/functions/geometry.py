"""Geometry as nested arrays and the measures that are plain expressions.

A geometry is STRUCT<srid, kind, parts>: parts are arrays of rings, a ring is a
closed array of STRUCT<x, y>, ring 0 is the outer one. Stored polygons have
their outer ring counter-clockwise and holes clockwise (`oriented`), so signed
sums over edges need no case distinction.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

POINT = "struct<x:double,y:double>"
PARTS = f"array<array<array<{POINT}>>>"
GEOMETRY = f"struct<srid:int,kind:string,parts:{PARTS}>"
EDGE = "struct<x1:double,y1:double,x2:double,y2:double>"

# WGS84 semi-major axis and flattening, accepted SRIDs, tolerance in m2.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
GEOGRAPHIC_SRIDS = (4326, 4674)
UTM_SRIDS = range(31978, 31986)
TOLERANCE_M2 = 1.0

_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)
# m2 per squared unit of the equal-area plane, and the longest sloped step in degrees.
AREA_SCALE = SEMI_MAJOR * SEMI_MAJOR / 2 * math.pi / 180
STEP = 0.01


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def geometry(parts: Column, kind: str = "MULTIPOLYGON", srid: int | Column = 4326) -> Column:
    code = srid if isinstance(srid, Column) else F.lit(srid)
    return F.struct(
        code.cast("int").alias("srid"), F.lit(kind).alias("kind"), parts.alias("parts")
    )


def box_geometry(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Counter-clockwise rectangle."""
    ring = F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))
    return geometry(F.array(F.array(ring)))


def rings(geom: Column) -> Column:
    return F.flatten(geom["parts"])


def vertices(geom: Column) -> Column:
    return F.flatten(rings(geom))


def ring_edges(ring: Column) -> Column:
    """Consecutive vertex pairs."""
    heads = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
    tails = F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.zip_with(
        heads,
        tails,
        lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
        ),
    )


def edges(geom: Column) -> Column:
    """All edges of all rings."""
    return F.flatten(F.transform(rings(geom), ring_edges))


def is_empty(geom: Column) -> Column:
    return geom.isNull() | (F.coalesce(F.size(vertices(geom)), F.lit(0)) <= 0)


def bbox(geom: Column) -> Column:
    """STRUCT<xmin, ymin, xmax, ymax>; NULL for an empty geometry."""

    def of(points: Column) -> Column:
        xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
        return F.when(
            F.size(points) > 0,
            F.struct(
                F.array_min(xs).alias("xmin"),
                F.array_min(ys).alias("ymin"),
                F.array_max(xs).alias("xmax"),
                F.array_max(ys).alias("ymax"),
            ),
        )

    return bound(vertices(geom), of)


def in_world(geom: Column) -> Column:
    """Every vertex within the geographic range."""
    return F.forall(
        vertices(geom), lambda p: p["x"].between(-180, 180) & p["y"].between(-90, 90)
    )


# ---- area -----------------------------------------------------------------

def authalic(lat: Column) -> Column:
    """q of the authalic latitude (Snyder 1987, eq. 3-12); area = a^2/2 * dq * dlon."""

    def q(s: Column) -> Column:
        return (1 - _E2) * (
            s / (1 - _E2 * s * s) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E)
        )

    return bound(F.sin(F.radians(lat)), q)


def equal_area(geom: Column) -> Column:
    """The geometry in the authalic cylindrical plane: x stays lon, y becomes q(lat).

    Areas there times `AREA_SCALE` are ellipsoidal m2, so overlays can be
    measured with plane geometry. Sloped edges are cut into steps of at most
    `STEP` degrees of latitude first; a straight step and its image then differ
    by less than 3e-7 of the area beside it. Horizontal and vertical edges stay
    straight and need no cut.
    """

    def steps(e: Column) -> Column:
        sloped = (e["x1"] != e["x2"]) & (e["y1"] != e["y2"])
        n = F.when(sloped, F.ceil(F.abs(e["y2"] - e["y1"]) / STEP)).otherwise(F.lit(1))
        return F.transform(
            F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1),
            lambda i: point(
                e["x1"] + (e["x2"] - e["x1"]) * i / n,
                authalic(e["y1"] + (e["y2"] - e["y1"]) * i / n),
            ),
        )

    def ring(r: Column) -> Column:
        last = F.transform(F.slice(r, -1, 1), lambda p: point(p["x"], authalic(p["y"])))
        return F.concat(F.flatten(F.transform(ring_edges(r), steps)), last)

    parts = F.transform(geom["parts"], lambda part: F.transform(part, ring))
    return geom.withField("parts", parts)


def planar_ring_area(ring: Column) -> Column:
    """Signed shoelace area in squared units of the coordinates."""
    return F.aggregate(
        ring_edges(ring),
        F.lit(0.0),
        lambda acc, e: acc + (e["x1"] * e["y2"] - e["x2"] * e["y1"]),
    ) / 2


def _part_area(part: Column, measure) -> Column:
    areas = F.transform(part, lambda ring: F.abs(measure(ring)))
    return F.aggregate(areas, F.lit(0.0), lambda acc, a: acc - a) + 2 * F.coalesce(
        F.get(areas, F.lit(0)), F.lit(0.0)
    )


def area_m2(geom: Column) -> Column:
    """Ellipsoidal area; holes subtract."""
    return planar_area(equal_area(geom)) * F.lit(AREA_SCALE)


def planar_area(geom: Column) -> Column:
    return F.aggregate(
        F.transform(geom["parts"], lambda part: _part_area(part, planar_ring_area)),
        F.lit(0.0),
        lambda acc, a: acc + a,
    )


def box_area_m2(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Closed form for a lon/lat rectangle; zero when it is empty."""
    wide, high = x1 - x0, authalic(y1) - authalic(y0)
    return F.when((x1 > x0) & (y1 > y0), wide * high * F.lit(AREA_SCALE)).otherwise(F.lit(0.0))


def spherical_ring_area(ring: Column, radius: float = 6378137.0) -> Column:
    """Ring area on a sphere by the sum over vertex triples, as map tools show it."""
    open_ring = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
    n = F.size(open_ring)
    lon = lambda i: F.radians(F.get(open_ring, i % n)["x"])
    total = F.aggregate(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        F.lit(0.0),
        lambda acc, i: acc
        + (lon(i + 2) - lon(i)) * F.sin(F.radians(F.get(open_ring, (i + 1) % n)["y"])),
    )
    return F.when(n > 2, F.abs(total) * radius * radius / 2).otherwise(F.lit(0.0))


def path_length(points: Column, radius: float = 6371000.0) -> Column:
    """Haversine length of a vertex path in metres."""

    def leg(e: Column) -> Column:
        dlat = F.radians(e["y2"] - e["y1"]) / 2
        dlon = F.radians(e["x2"] - e["x1"]) / 2
        h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(e["y1"])) * F.cos(F.radians(e["y2"])) * F.pow(
            F.sin(dlon), 2
        )
        return 2 * radius * F.atan2(F.sqrt(h), F.sqrt(1 - h))

    return F.aggregate(ring_edges(points), F.lit(0.0), lambda acc, e: acc + leg(e))


def oriented(geom: Column) -> Column:
    """Outer rings counter-clockwise, holes clockwise."""

    def turn(ring: Column, i: Column) -> Column:
        wrong = (planar_ring_area(ring) < 0) == (i == 0)
        return F.when(wrong, F.reverse(ring)).otherwise(ring)

    parts = F.transform(geom["parts"], lambda part: F.transform(part, turn))
    return geom.withField("parts", parts)


# ---- predicates -----------------------------------------------------------

def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def on_edge(x: Column, y: Column, e: Column) -> Column:
    turn = _cross(e["x2"] - e["x1"], e["y2"] - e["y1"], x - e["x1"], y - e["y1"])
    return (
        (turn == 0)
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def passes_right(e: Column, x: Column, y: Column) -> Column:
    """The edge crosses the level line through a point, to the right of it."""
    spans = (e["y1"] > y) != (e["y2"] > y)
    at = e["x1"] + (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) * (e["x2"] - e["x1"])
    return F.coalesce(spans & (x < at), F.lit(False))


def part_covers(part: Column, x: Column, y: Column) -> Column:
    """In or on the shell of a part and not inside one of its holes."""

    def strictly(ring: Column) -> Column:
        return bound(
            ring_edges(ring),
            lambda es: (F.size(F.filter(es, lambda e: passes_right(e, x, y))) % 2 == 1)
            & ~F.exists(es, lambda e: on_edge(x, y, e)),
        )

    shell = bound(ring_edges(F.get(part, F.lit(0))), lambda es: covers_point(es, x, y))
    return shell & ~F.exists(F.slice(part, F.lit(2), F.size(part)), strictly)


def covers_point(edge_list: Column, x: Column, y: Column) -> Column:
    """Even-odd test over the edges; the boundary counts as inside."""
    crossings = F.size(F.filter(edge_list, lambda e: passes_right(e, x, y)))
    return (crossings % 2 == 1) | F.exists(edge_list, lambda e: on_edge(x, y, e))


def edges_meet(a: Column, b: Column) -> Column:
    """Two segments share at least one point."""

    def side(e: Column, x: Column, y: Column) -> Column:
        return F.signum(_cross(e["x2"] - e["x1"], e["y2"] - e["y1"], x - e["x1"], y - e["y1"]))

    a1, a2 = side(b, a["x1"], a["y1"]), side(b, a["x2"], a["y2"])
    b1, b2 = side(a, b["x1"], b["y1"]), side(a, b["x2"], b["y2"])
    boxes = (
        (F.least(a["x1"], a["x2"]) <= F.greatest(b["x1"], b["x2"]))
        & (F.least(b["x1"], b["x2"]) <= F.greatest(a["x1"], a["x2"]))
        & (F.least(a["y1"], a["y2"]) <= F.greatest(b["y1"], b["y2"]))
        & (F.least(b["y1"], b["y2"]) <= F.greatest(a["y1"], a["y2"]))
    )
    return boxes & (a1 * a2 <= 0) & (b1 * b2 <= 0)


def ring_closed(ring: Column) -> Column:
    return F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1)


def self_crossing(geom: Column) -> Column:
    """Two edges cross in a point that is not an end of both."""
    es = edges(geom)

    def proper(a: Column, b: Column) -> Column:
        shared = (
            ((a["x1"] == b["x1"]) & (a["y1"] == b["y1"]))
            | ((a["x2"] == b["x2"]) & (a["y2"] == b["y2"]))
            | ((a["x1"] == b["x2"]) & (a["y1"] == b["y2"]))
            | ((a["x2"] == b["x1"]) & (a["y2"] == b["y1"]))
        )
        return ~shared & edges_meet(a, b)

    def any_pair(indexed: Column) -> Column:
        return F.exists(
            indexed,
            lambda a: F.exists(indexed, lambda b: (b["i"] > a["i"]) & proper(a["e"], b["e"])),
        )

    return bound(F.transform(es, lambda e, i: F.struct(i.alias("i"), e.alias("e"))), any_pair)


def is_valid(geom: Column) -> Column:
    """Rings closed with at least four vertices, some area, and no self-crossing."""
    shaped = F.forall(
        rings(geom), lambda r: (F.size(r) >= 4) & ring_closed(r) & (planar_ring_area(r) != 0)
    )
    return ~is_empty(geom) & F.coalesce(shaped, F.lit(False)) & ~self_crossing(geom)


def family(name: Column) -> Column:
    """polygon / line / point of a declared geometry type, else the name itself."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return (
        F.when(low.contains("polygon"), "polygon")
        .when(low.rlike("line|curve"), "line")
        .when(low.contains("point"), "point")
        .otherwise(low)
    )


# ---- text encodings -------------------------------------------------------

_NUMBERS = r"[-+0-9.E\s,]"
_Z = r"\s*+(?:ZM|Z|M)?+\s*+"
_POLYGON = rf"\((?:\s*+\({_NUMBERS}*+\)\s*+,?+)++\s*+\)"
_AREAS = rf"(?<![A-Z])(?:POLYGON{_Z}{_POLYGON}|MULTIPOLYGON{_Z}\((?:\s*+{_POLYGON}\s*+,?+)++\s*+\))"
_OTHERS = (
    rf"(?<![A-Z])(?:(?:(?:MULTI)?+(?:POINT|LINESTRING)|LINEARRING){_Z}\((?:{_NUMBERS}++|\({_NUMBERS}*+\))*+\)"
    rf"|(?:(?:MULTI)?+(?:POINT|LINESTRING|POLYGON)|LINEARRING|GEOMETRYCOLLECTION){_Z}EMPTY)"
)


def _wkt_parts(trimmed: Column) -> Column:
    """Parts of POLYGON / MULTIPOLYGON text in upper case; NULL when it is neither."""
    number = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
    kind = F.regexp_extract(trimmed, r"^(MULTIPOLYGON|POLYGON)\s*(?:ZM|Z|M)?\s*\(", 1)
    body = F.regexp_replace(trimmed, r"^(MULTIPOLYGON|POLYGON)\s*(?:ZM|Z|M)?\s*", "")
    shaped = body.rlike(r"^[-+0-9.E\s,()]+$")
    pairs = F.regexp_replace(
        body, rf"({number})\s+({number})(?:\s+{number}){{0,2}}", r'{"x":$1,"y":$2}'
    )
    nested = F.translate(pairs, "()", "[]")
    nested = F.regexp_replace(nested, r":\+", ":")
    nested = F.regexp_replace(nested, r":(-?)\.", ":$10.")
    nested = F.regexp_replace(nested, r"([0-9])\.(?=[,}E])", "$1.0")
    nested = F.when(kind == "POLYGON", F.concat(F.lit("["), nested, F.lit("]"))).otherwise(nested)
    parts = F.from_json(nested, PARTS)
    sound = F.forall(
        F.flatten(F.flatten(parts)), lambda p: p["x"].isNotNull() & p["y"].isNotNull()
    )
    ok = shaped & (kind != "") & parts.isNotNull() & F.coalesce(sound, F.lit(False))
    return F.when(ok, parts)


def wkt_members(text: Column) -> Column:
    """Parts of each polygonal member: one for POLYGON / MULTIPOLYGON text, and those of a GEOMETRYCOLLECTION at
    any depth; NULL when there is none or one is broken."""
    trimmed = F.regexp_replace(F.upper(F.trim(text)), r"^SRID=[0-9]+;", "")
    frame = F.regexp_replace(F.regexp_replace(trimmed, _AREAS, "@"), _OTHERS, "@")
    closed = F.regexp_count(frame, F.lit(r"\(")) == F.regexp_count(frame, F.lit(r"\)"))
    shaped = frame.rlike(rf"^(?:GEOMETRYCOLLECTION{_Z}\(|[@,)\s])++$") & closed
    found = F.transform(F.regexp_extract_all(trimmed, F.lit(_AREAS), F.lit(0)), _wkt_parts)
    members = F.when(trimmed.startswith("GEOMETRYCOLLECTION"), F.when(shaped, found)).otherwise(F.array(_wkt_parts(trimmed)))
    return bound(members, lambda ms: F.when((F.size(ms) > 0) & F.forall(ms, lambda m: m.isNotNull()), ms))


def from_wkt(text: Column, srid: int = 4326) -> Column:
    """POLYGON / MULTIPOLYGON text, or the polygons of a GEOMETRYCOLLECTION, Z and M dropped; NULL when it is neither."""
    return bound(wkt_members(text), lambda ms: F.when(ms.isNotNull(), geometry(F.flatten(ms), srid=srid)))


def from_geojson(text: Column, srid: int = 4326) -> Column:
    """Polygon / MultiPolygon geometry, bare or inside a Feature; NULL otherwise."""
    kind = F.coalesce(
        F.get_json_object(text, "$.geometry.type"), F.get_json_object(text, "$.type")
    )
    coords = F.coalesce(
        F.get_json_object(text, "$.geometry.coordinates"),
        F.get_json_object(text, "$.coordinates"),
    )
    nested = F.when(kind == "Polygon", F.concat(F.lit("["), coords, F.lit("]"))).otherwise(coords)
    raw = F.from_json(nested, "array<array<array<array<double>>>>")
    to_point = lambda c: point(F.get(c, F.lit(0)), F.get(c, F.lit(1)))
    parts = F.transform(
        raw, lambda part: F.transform(part, lambda ring: F.transform(ring, to_point))
    )
    return F.when(kind.isin("Polygon", "MultiPolygon") & raw.isNotNull(), geometry(parts, srid=srid))


def kml_ring(text: Column) -> Column:
    """`lon,lat[,alt]` tuples to vertices, consecutive repeats removed, ring closed."""
    tuples = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    raw = F.transform(
        tuples,
        lambda t: point(
            F.get(F.split(t, ","), F.lit(0)).try_cast("double"),
            F.get(F.split(t, ","), F.lit(1)).try_cast("double"),
        ),
    )

    def shut(path: Column) -> Column:
        closed = F.when(ring_closed(path), path).otherwise(F.concat(path, F.slice(path, F.lit(1), F.lit(1))))
        return F.when(F.size(path) >= 3, closed)

    return bound(without_repeats(raw), shut)


def without_repeats(path: Column) -> Column:
    """Drop each vertex equal to the one before it."""
    return bound(path, lambda ps: F.filter(ps, lambda p, i: (i == 0) | (p != F.get(ps, i - 1))))


def to_wkt(geom: Column) -> Column:
    """MULTIPOLYGON text."""
    pair = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, pair), ", "), F.lit(")"))
    part = lambda s: F.concat(F.lit("("), F.array_join(F.transform(s, ring), ", "), F.lit(")"))
    return F.concat(
        F.lit("MULTIPOLYGON ("), F.array_join(F.transform(geom["parts"], part), ", "), F.lit(")")
    )


def to_geojson(geom: Column, digits: int = 6) -> Column:
    """MultiPolygon object, 2D, rounded coordinates."""
    coords = F.transform(
        geom["parts"],
        lambda part: F.transform(
            part,
            lambda ring: F.transform(
                ring, lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits))
            ),
        ),
    )
    return F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates")))


def to_kml(geom: Column) -> Column:
    """MultiGeometry element."""
    pair = lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"), F.lit("0"))

    def ring(r: Column, i: Column) -> Column:
        tag = F.when(i == 0, "outerBoundaryIs").otherwise("innerBoundaryIs")
        return F.concat(
            F.lit("<"), tag, F.lit("><LinearRing><coordinates>"),
            F.array_join(F.transform(r, pair), " "),
            F.lit("</coordinates></LinearRing></"), tag, F.lit(">"),
        )

    part = lambda s: F.concat(
        F.lit("<Polygon>"), F.array_join(F.transform(s, ring), ""), F.lit("</Polygon>")
    )
    return F.concat(
        F.lit("<MultiGeometry>"),
        F.array_join(F.transform(geom["parts"], part), ""),
        F.lit("</MultiGeometry>"),
    )


# ---- reference systems ----------------------------------------------------

def _utm_inverse(x: Column, y: Column, zone: Column) -> Column:
    """Transverse Mercator back to lon/lat, southern zones (Snyder 1987, eq. 8-12 ff.)."""
    k0, e2 = 0.9996, _E2
    ep2 = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    m = (y - 10000000.0) / k0
    mu = m / (SEMI_MAJOR * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    phi = (
        mu
        + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu)
        + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
        + (151 * e1**3 / 96) * F.sin(6 * mu)
        + (1097 * e1**4 / 512) * F.sin(8 * mu)
    )
    s, c, t = F.sin(phi), F.cos(phi), F.pow(F.tan(phi), 2)
    c1 = ep2 * c * c
    n1 = SEMI_MAJOR / F.sqrt(1 - e2 * s * s)
    r1 = SEMI_MAJOR * (1 - e2) / F.pow(1 - e2 * s * s, 1.5)
    d = (x - 500000.0) / (n1 * k0)
    lat = phi - (n1 * F.tan(phi) / r1) * (
        d * d / 2
        - (5 + 3 * t + 10 * c1 - 4 * c1 * c1 - 9 * ep2) * F.pow(d, 4) / 24
        + (61 + 90 * t + 298 * c1 + 45 * t * t - 252 * ep2 - 3 * c1 * c1) * F.pow(d, 6) / 720
    )
    lon = (
        d
        - (1 + 2 * t + c1) * F.pow(d, 3) / 6
        + (5 - 2 * c1 + 28 * t - 3 * c1 * c1 + 8 * ep2 + 24 * t * t) * F.pow(d, 5) / 120
    ) / c
    return point(zone * 6 - 183 + F.degrees(lon), F.degrees(lat))


def to_geographic(geom: Column) -> Column:
    """Lon/lat in 4326; NULL for a reference system that is not handled.

    4674 differs from 4326 by a null datum shift. 31978..31985 are the southern
    zones 18..25.
    """
    srid = geom["srid"]
    moved = F.transform(
        geom["parts"],
        lambda part: F.transform(
            part,
            lambda ring: F.transform(
                ring, lambda p: _utm_inverse(p["x"], p["y"], srid - 31960)
            ),
        ),
    )
    return F.when(srid.isin(*GEOGRAPHIC_SRIDS), geometry(geom["parts"])).when(
        srid.between(UTM_SRIDS[0], UTM_SRIDS[-1]), geometry(moved)
    )
