"""Validity and repair of polygons from their edges, in joins over the edges of many shapes.

Edges are entered in grid cells of their shape and meet other edges cell by cell, so no row compares
all edges of a polygon. Where edges meet they are split. A piece of an edge lies between two sides;
how many edges of each ring lie to its left, counted within bands, tells which rings hold either side.
The area of a shape is what lies in a shell and in none of its holes, over all parts. Pieces with
that area on one side only are its outline, which stitching turns into rings again.

A shape is valid when its rings are closed and have an area, none meets itself, no two cross or share a
stretch, every edge is outline, and touching rings don't cut a part in two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as geo
from ..session import materialize, spread
from . import small_shapes

# Rings of up to so many edges are tested within their row.
SMALL = 24
# Shapes, and unions, of up to so many vertices are arranged within their row.
FEW = 64
# Sides of edges are told apart in slanted coordinates, in which edges along an axis are not level.
SLANT = 0.6180339887498949
# Reasons as reported.
CROSSING = "autointerseção"
TOUCHING = "anel toca a si mesmo"
SHARED = "trecho repetido"
NESTED = "partes ou anéis aninhados"
SPLIT = "interior desconexo"
RING = "anel aberto ou com menos de três vértices"

_POINT = "struct<x:double,y:double>"
# The first that holds is reported.
_ORDER = {"RING": RING, "CROSSING": CROSSING, "SHARED": SHARED, "TOUCHING": TOUCHING, "NESTED": NESTED, "SPLIT": SPLIT}


def surely_valid(geom: Column) -> Column:
    """A single small ring that meets itself nowhere. False says nothing."""
    ring = F.get(F.get(geom["parts"], F.lit(0)), F.lit(0))
    n = F.size(ring) - 1
    single = (F.size(geom["parts"]) == 1) & (F.size(F.get(geom["parts"], F.lit(0))) == 1)

    def simple(es: Column) -> Column:
        def apart(a: Column, i: Column) -> Column:
            def clear(b: Column, j: Column) -> Column:
                next_ = (j == i + 1) | ((i == 0) & (j == n - 1))
                folds = (_turn(a, b["x1"], b["y1"]) == 0) & (_turn(a, b["x2"], b["y2"]) == 0)
                return (j <= i) | F.when(next_, ~folds).otherwise(~geo.edges_meet(a, b))

            return ~F.exists(F.transform(es, clear), lambda c: ~c)

        return ~F.exists(F.transform(es, apart), lambda c: ~c)

    shaped = n.between(3, SMALL) & geo.ring_closed(ring) & (geo.planar_ring_area(ring) != 0)
    return F.coalesce(F.when(single & shaped, geo.bound(geo.ring_edges(ring), simple)), F.lit(False))


def _turn(e: Column, x: Column, y: Column) -> Column:
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])


def part_rows(df: DataFrame, key: str, geometry: str = "geometry") -> DataFrame:
    """``key``, ``part``, ``rings``: a row per part of each shape."""
    listed = df.select(key, F.col(geometry)["parts"].alias("_parts"))
    return listed.select(key, F.posexplode("_parts").alias("part", "rings")).withColumn("part", F.col("part").cast("long"))


def edge_rows(parts: DataFrame, key: str) -> DataFrame:
    """``key``, ``part``, ``ring``, ``n``, ``seq``, ``e``, ``id``: a row per edge.

    Repeated vertices are dropped and open rings are closed.
    """
    shut = lambda path: F.when(geo.ring_closed(path), path).otherwise(F.concat(path, F.slice(path, F.lit(1), F.lit(1))))
    whole = lambda path: geo.bound(geo.bound(geo.without_repeats(path), shut), geo.ring_edges)
    rings = parts.select(key, "part", F.posexplode("rings").alias("ring", "_path"))
    listed = rings.select(key, "part", "ring", geo.bound(F.col("_path"), whole).alias("_edges"))
    each = listed.select(key, "part", "ring", F.size("_edges").alias("n"), F.posexplode("_edges").alias("seq", "e"))
    return each.withColumn("id", F.struct("part", "ring", "seq"))


def _cells(edges: DataFrame, key: str) -> DataFrame:
    """Edges with the cells they run through, column by column.

    Cells are as wide as the mean edge of the shape, so all its edges together run through a few cells each.
    """
    e, side = F.col("e"), F.col("_side")
    wide, high = F.abs(e["x2"] - e["x1"]), F.abs(e["y2"] - e["y1"])
    sides = edges.groupBy(key).agg(F.avg(F.greatest(wide, high)).alias("_side"))
    lo, hi = F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])
    columns = F.sequence(F.floor(lo / side), F.floor(hi / side))

    def rows(cx: Column) -> Column:
        at = lambda x: F.when(
            e["x1"] != e["x2"], e["y1"] + (F.greatest(lo, F.least(hi, x)) - e["x1"]) * (e["y2"] - e["y1"]) / (e["x2"] - e["x1"])
        )
        a, b = at(cx * side), at((cx + 1) * side)
        low = F.coalesce(F.least(a, b), F.least(e["y1"], e["y2"])) - side * 1e-6
        high = F.coalesce(F.greatest(a, b), F.greatest(e["y1"], e["y2"])) + side * 1e-6
        return F.transform(F.sequence(F.floor(low / side), F.floor(high / side)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    sized = edges.join(sides.where("_side > 0"), key)
    return sized.select(key, "part", "ring", "n", "id", "seq", "e", F.explode(F.flatten(F.transform(columns, rows))).alias("_c"))


def meetings(edges: DataFrame, key: str) -> DataFrame:
    """Pairs of edges (``_a``, ``_b``) of a shape that meet: their ``points`` and what is wrong with it (``fault``)."""
    cells = _cells(edges, key)
    names = ("part", "ring", "n", "id", "seq", "e")
    one, two = (cells.select(key, "_c", F.struct(*names).alias(s)) for s in ("_a", "_b"))
    pairs = one.join(two, [key, "_c"]).where("_a.id < _b.id").drop("_c")
    a, b = F.col("_a.e"), F.col("_b.e")
    a1, a2 = _turn(b, a["x1"], a["y1"]), _turn(b, a["x2"], a["y2"])
    b1, b2 = _turn(a, b["x1"], b["y1"]), _turn(a, b["x2"], b["y2"])
    pairs = pairs.where(geo.edges_meet(a, b)).withColumns({"a1": a1, "a2": a2, "b1": b1, "b2": b2})
    proper = (F.col("a1") * F.col("a2") < 0) & (F.col("b1") * F.col("b2") < 0)
    share = F.col("a1") / (F.col("a1") - F.col("a2"))
    found = F.array(
        F.when(proper, geo.point(a["x1"] + share * (a["x2"] - a["x1"]), a["y1"] + share * (a["y2"] - a["y1"]))),
        *[F.when(~proper & geo.on_edge(e[f"x{k}"], e[f"y{k}"], o), geo.point(e[f"x{k}"], e[f"y{k}"])) for e, o in ((a, b), (b, a)) for k in (1, 2)],
    )
    met = pairs.withColumn("points", F.array_distinct(F.filter(found, lambda p: p.isNotNull()))).where(F.size("points") > 0)
    same = (F.col("_a.part") == F.col("_b.part")) & (F.col("_a.ring") == F.col("_b.ring"))
    apart = F.col("_b.seq") - F.col("_a.seq")
    neighbours = same & ((apart == 1) | (apart == F.col("_a.n") - 1))
    fault = (
        F.when(proper, CROSSING).when(F.size("points") > 1, SHARED).when(same & ~neighbours, TOUCHING)
    )
    return met.select(key, "_a", "_b", "points", fault.alias("fault"))


def pieces(edges: DataFrame, met: DataFrame, key: str) -> DataFrame:
    """Edges split where others meet them; one row per place, with the rings that run there.

    ``p`` and ``q`` are the ends, ``p`` the lower one in slanted coordinates; ``copies`` how many edges run there, ``own``
    the rings that do so an odd number of times.
    """
    ends = lambda e: (geo.point(e["x1"], e["y1"]), geo.point(e["x2"], e["y2"]))
    hits = met.select(key, F.explode(F.array("_a.id", "_b.id")).alias("id"), "points").withColumn("point", F.explode("points"))
    hits = hits.groupBy(key, "id").agg(F.collect_set("point").alias("cuts"))
    e = F.col("e")
    first, last = ends(e)
    along = lambda p: (p["x"] - e["x1"]) * (e["x2"] - e["x1"]) + (p["y"] - e["y1"]) * (e["y2"] - e["y1"])
    cuts = F.filter(F.coalesce("cuts", F.array().cast(f"array<{_POINT}>")), lambda p: (p != first) & (p != last))
    inner = F.transform(F.array_sort(F.transform(cuts, lambda p: F.struct(along(p).alias("t"), p.alias("p")))), lambda s: s["p"])
    path = F.concat(F.array(first), inner, F.array(last))
    split = edges.join(hits, [key, "id"], "left").select(key, "part", "ring", F.explode(geo.ring_edges(path)).alias("e"))
    low = lambda k: F.struct((e[f"y{k}"] + SLANT * e[f"x{k}"]).alias("w"), e[f"x{k}"].alias("x"), e[f"y{k}"].alias("y"))
    placed = split.select(key, "part", "ring", F.least(low(1), low(2)).alias("p"), F.greatest(low(1), low(2)).alias("q")).where("p <> q")
    per_ring = placed.groupBy(key, "p", "q", "part", "ring").agg(F.count(F.lit(1)).alias("n"))
    odd = F.when(F.col("n") % 2 == 1, F.struct("part", "ring"))
    return per_ring.groupBy(key, "p", "q").agg(F.sum("n").alias("copies"), F.collect_list(odd).alias("own"))


def sided(parts: DataFrame, key: str) -> DataFrame:
    """Pieces with whether the area of the shape lies to their left (smaller x) and to their right."""
    # Bands as high as the mean piece: the pieces of a shape together have twice as many entries as there are pieces.
    height = parts.groupBy(key).agg(F.min("p.w").alias("_low"), F.avg(F.col("q.w") - F.col("p.w")).alias("_height"))
    banded = parts.join(height, key)
    band = lambda w: F.floor((w - F.col("_low")) / F.col("_height"))
    middle = (F.col("p.w") + F.col("q.w")) / 2
    asked = banded.select(key, "p", "q", band(middle).alias("_band"), middle.alias("_w"), ((F.col("p.x") + F.col("q.x")) / 2).alias("_x"))
    walls = banded.where(F.size("own") > 0).select(
        key, F.explode(F.sequence(band(F.col("p.w")), band(F.col("q.w")))).alias("_band"), F.col("p").alias("_p"), F.col("q").alias("_q"), "own"
    )
    at = F.col("_p.x") + (F.col("_w") - F.col("_p.w")) / (F.col("_q.w") - F.col("_p.w")) * (F.col("_q.x") - F.col("_p.x"))
    left = (F.col("_p.w") <= F.col("_w")) & (F.col("_w") < F.col("_q.w")) & (at < F.col("_x")) & ~((F.col("_p") == F.col("p")) & (F.col("_q") == F.col("q")))
    crossed = asked.join(walls, [key, "_band"]).where(left).select(key, "p", "q", F.explode("own").alias("_ring"))
    odd = crossed.groupBy(key, "p", "q", "_ring").agg((F.count(F.lit(1)) % 2).alias("_odd")).where("_odd = 1")
    holders = odd.groupBy(key, "p", "q").agg(F.collect_list("_ring").alias("_left"))
    none = F.array().cast("array<struct<part:bigint,ring:int>>")
    inside = lambda rings: F.exists(
        rings, lambda s: (s["ring"] == 0) & ~F.exists(rings, lambda h: (h["part"] == s["part"]) & (h["ring"] > 0))
    )
    known = parts.join(holders, [key, "p", "q"], "left").withColumn("_left", F.coalesce("_left", none))
    right = F.concat(F.array_except("_left", "own"), F.array_except("own", "_left"))
    return known.select(key, "p", "q", "copies", "own", inside(F.col("_left")).alias("left"), inside(right).alias("right"))


def outline(sides: DataFrame, key: str) -> DataFrame:
    """Directed edges ``p`` to ``q`` with the area on their left."""
    kept = sides.where(F.col("left") != F.col("right"))
    ends = [F.when(F.col("left"), F.col(s)).otherwise(F.col(o)) for s, o in (("p", "q"), ("q", "p"))]
    return kept.select(key, *[F.struct(e["x"].alias("x"), e["y"].alias("y")).alias(n) for e, n in zip(ends, "pq", strict=True)])


def _split_interiors(met: DataFrame, key: str) -> DataFrame:
    """Parts whose rings touch in a circle: the points of contact link rings, and one links two that are linked already."""
    touch = met.where("_a.part = _b.part and _a.ring <> _b.ring").select(key, F.col("_a.part").alias("part"), F.explode("points").alias("p"), F.array("_a.ring", "_b.ring").alias("_r"))
    at = touch.groupBy(key, "part", "p").agg(F.array_distinct(F.flatten(F.collect_list("_r"))).alias("_r"))
    lists = at.groupBy(key, "part").agg(F.collect_list("_r").alias("_all"))
    start = F.struct(F.array().cast("array<array<int>>").alias("groups"), F.lit(False).alias("circle"))

    def link(acc: Column, rings: Column) -> Column:
        hit = F.filter(acc["groups"], lambda g: F.arrays_overlap(g, rings))
        again = F.exists(hit, lambda g: F.size(F.array_intersect(g, rings)) > 1)
        rest = F.filter(acc["groups"], lambda g: ~F.arrays_overlap(g, rings))
        return F.struct(
            F.concat(rest, F.array(F.array_distinct(F.concat(F.flatten(hit), rings)))).alias("groups"), (acc["circle"] | again).alias("circle")
        )

    return lists.where(F.aggregate("_all", start, link)["circle"]).select(key)


def _arranged(parts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Meetings and sided pieces of the shapes; tables of edges are written once to the shared folder."""
    edges = materialize(edge_rows(parts, key), "edges")
    met = materialize(meetings(edges, key), "meetings")
    return met, materialize(sided(materialize(pieces(edges, met, key), "pieces"), key), "sides")


def examined(df: DataFrame, key: str, geometry: str = "geometry") -> tuple[DataFrame, DataFrame]:
    """Faults (``key``, ``fault``: one row per invalid shape) and the outline edges of every shape.

    Empty geometries have neither.
    """
    met, sides = _arranged(part_rows(df, key, geometry), key)
    rings = F.flatten(F.col(geometry)["parts"])
    others = lambda r, known: F.filter(r, lambda p: p != known)
    three = lambda r: geo.bound(others(r, F.get(r, F.lit(0))), lambda o: F.size(others(o, F.get(o, F.lit(0)))) > 0)
    open_ = df.where(F.exists(rings, lambda r: ~F.coalesce(geo.ring_closed(r) & three(r), F.lit(False))))
    found = (
        met.where("fault is not null").select(key, "fault")
        .unionByName(sides.where("copies > 1").select(key, F.lit(SHARED).alias("fault")))
        .unionByName(sides.where("left = right").select(key, F.lit(NESTED).alias("fault")))
        .unionByName(open_.select(key, F.lit(RING).alias("fault")))
        .unionByName(_split_interiors(met, key).select(key, F.lit(SPLIT).alias("fault")))
    )
    order = F.array_position(F.array(*map(F.lit, _ORDER.values())), F.col("fault"))
    return found.groupBy(key).agg(F.min_by("fault", order).alias("fault")), outline(sides, key)


def _vertices(geom: Column) -> Column:
    """How many vertices a geometry has; NULL when a part of it is null or not finite."""
    finite = lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    return geo.bound(geo.vertices(geom), lambda ps: F.when(F.forall(ps, lambda p: finite(p["x"]) & finite(p["y"])), F.size(ps)))


def dissolved(df: DataFrame, key: str, geometry: str = "geometry", srid: int = 4326) -> DataFrame:
    """``key``, ``geometry``: the union of all shapes of a key, as polygons without inner borders.

    A key of few vertices is united within a row. The edges of any other lie in many rows until
    its rings are put together. Keys whose shapes have no area are missing.
    """
    # Written before anything else reads it: what makes the geometry would be repeated for each use.
    rows = materialize(df.select(key, F.col(geometry)["parts"].alias("parts")), "parts").where(F.col(key).isNotNull() & F.col("parts").isNotNull())
    rows = rows.withColumn("_n", _vertices(F.struct("parts")))
    few = (F.sum("_n") <= FEW) & (F.count("_n") == F.count(F.lit(1)))
    sizes = rows.groupBy(key).agg(F.coalesce(few, F.lit(False)).alias("_few"))
    sized = rows.join(sizes, key)
    lists = sized.where("_few").groupBy(key).agg(F.flatten(F.collect_list("parts")).alias("parts"))
    made = small_shapes.judged(spread(lists), _ORDER, SLANT).where(F.size("made") > 0)
    united = made.select(key, geo.geometry(F.col("made"), srid=srid).alias("geometry"))
    large = sized.where("not _few")
    if large.isEmpty():
        return united
    parts = large.select(key, F.explode("parts").alias("rings")).withColumn("part", F.monotonically_increasing_id())
    _, sides = _arranged(materialize(parts, "parts"), key)
    return united.unionByName(polygons(stitched(materialize(outline(sides, key), "outline"), key), key, srid))


def stitched(edges: DataFrame, key: str) -> DataFrame:
    """``key``, ``ring``, ``path``: closed rings from directed edges with the area on their left.

    Where several edges leave a point, the sharpest turn to the left is taken, so rings touch and never cross. Places
    within a ring come from pointer jumping: each round doubles how far an edge sees, so the longest ring
    takes the logarithm of its edges in rounds.
    """
    angle = lambda p, q: F.atan2(F.col(q)["y"] - F.col(p)["y"], F.col(q)["x"] - F.col(p)["x"])
    out = edges.select(key, F.col("p").alias("_v"), F.col("q").alias("_q"), angle("p", "q").alias("_out"))
    came = edges.select(key, "p", "q", F.col("q").alias("_v"), angle("q", "p").alias("_back"))
    turn = F.pmod(F.col("_back") - F.col("_out"), F.lit(2 * 3.141592653589793))
    # Clockwise from the way back: the first other edge has the area between.
    turn = F.when(turn <= 0, 2 * 3.141592653589793).otherwise(turn)
    best = came.join(out, [key, "_v"]).groupBy(key, "p", "q").agg(F.min_by(F.struct(F.col("_v").alias("p"), F.col("_q").alias("q")), turn).alias("next"))
    now = materialize(best.select(key, F.struct("p", "q").alias("e"), F.col("next"), F.least(F.struct("p", "q"), F.col("next")).alias("head")), "ring-links")
    links = now.select(key, "e", "next")
    reach = 1
    state = None
    while True:
        # The smallest edge in sight, twice as far each round.
        far = now.select(key, F.col("e").alias("next"), F.col("next").alias("_n"), F.col("head").alias("_h"))
        now = materialize(now.join(far, [key, "next"]).select(key, "e", F.col("_n").alias("next"), F.least("head", "_h").alias("head")), "ring-links")
        reach *= 2
        seen = now.select(F.sum(F.xxhash64("head").cast("decimal(38,0)"))).first()[0]
        if seen == state:
            break
        state = seen
    heads = now.select(key, "e", "head")
    # Distance from the head: the edge before the head ends the list.
    walk = links.join(heads, [key, "e"])
    last = F.col("next") == F.col("head")
    walk = materialize(walk.select(key, "head", "e", F.when(~last, F.col("next")).alias("next"), F.when(last, 0).otherwise(1).cast("long").alias("after")), "ring-walk")
    while not walk.where("next is not null").isEmpty():
        far = walk.select(key, F.col("e").alias("next"), F.col("next").alias("_n"), F.col("after").alias("_a"))
        walk = materialize(
            walk.join(far, [key, "next"], "left").select(key, "head", "e", F.col("_n").alias("next"), (F.col("after") + F.coalesce("_a", F.lit(0))).alias("after")), "ring-walk"
        )
    placed = walk.groupBy(key, F.col("head").alias("ring")).agg(F.array_sort(F.collect_list(F.struct((-F.col("after")).alias("at"), F.col("e.p").alias("v")))).alias("_list"))
    path = F.transform("_list", lambda s: s["v"])
    path = F.concat(path, F.slice(path, 1, 1))
    straight = lambda ps: F.filter(
        ps,
        lambda p, i: (i == 0) | (i == F.size(ps) - 1) | (
            (F.get(ps, i + 1)["x"] - F.get(ps, i - 1)["x"]) * (p["y"] - F.get(ps, i - 1)["y"])
            != (F.get(ps, i + 1)["y"] - F.get(ps, i - 1)["y"]) * (p["x"] - F.get(ps, i - 1)["x"])
        ),
    )
    return placed.select(key, "ring", geo.bound(path, straight).alias("path"))


def polygons(rings: DataFrame, key: str, srid: int = 4326) -> DataFrame:
    """``key``, ``geometry``: holes go to the smallest shell around them."""
    area = geo.planar_ring_area(F.col("path"))
    sized = materialize(rings.withColumn("_area", area).where("_area <> 0"), "rings")
    shells = sized.where("_area > 0")
    holes = sized.where("_area < 0").select(key, F.col("ring").alias("hole"), F.col("path").alias("inner"))
    middle = F.struct(((F.col("inner")[0]["x"] + F.col("inner")[1]["x"]) / 2).alias("x"), ((F.col("inner")[0]["y"] + F.col("inner")[1]["y"]) / 2).alias("y"))
    walls = shells.select(key, "ring", "_area", F.explode(geo.ring_edges(F.col("path"))).alias("e"))
    e, m = F.col("e"), F.col("_m")
    spans = (e["y1"] > m["y"]) != (e["y2"] > m["y"])
    crosses = spans & (m["x"] < e["x1"] + (m["y"] - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) * (e["x2"] - e["x1"]))
    around = holes.withColumn("_m", middle).join(walls, key).where(crosses).groupBy(key, "hole", "ring", "_area").agg((F.count(F.lit(1)) % 2).alias("_odd"))
    owner = around.where("_odd = 1").groupBy(key, "hole").agg(F.min_by("ring", "_area").alias("ring"))
    inner = holes.join(owner, [key, "hole"]).groupBy(key, "ring").agg(F.sort_array(F.collect_list("inner")).alias("_holes"))
    none = F.array().cast(f"array<array<{_POINT}>>")
    parts = shells.join(inner, [key, "ring"], "left").select(key, F.concat(F.array("path"), F.coalesce("_holes", none)).alias("part"))
    return parts.groupBy(key).agg(F.sort_array(F.collect_list("part")).alias("_parts")).select(key, geo.geometry(F.col("_parts"), srid=srid).alias("geometry"))


def _doubtful(df: DataFrame, key: str, geometry: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All shapes with coordinates, written once, those that are not valid at first sight, and the small ones of them judged.

    Small ones (``key``, ``fault``, ``left``, ``made``) are not among the second. Shapes whose key is null or repeats stay there.
    """
    rows = df.select(key, F.col(geometry).alias("geometry")).withColumn("_sure", surely_valid(F.col("geometry")))
    rows = materialize(rows.where(~geo.is_empty(F.col("geometry"))), "shapes")
    doubtful = rows.where("not _sure")
    alone = doubtful.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_times"), F.max(F.coalesce(_vertices(F.col("geometry")), F.lit(FEW + 1))).alias("_n"))
    small = alone.where((F.col("_times") == 1) & (F.col("_n") <= FEW)).select(key)
    asked = doubtful.join(small, key, "left_semi").select(key, F.col("geometry")["parts"].alias("parts"))
    judged = materialize(small_shapes.judged(spread(asked), _ORDER, SLANT), "judged")
    return rows, doubtful.join(judged.select(key), key, "left_anti"), judged


def faults(df: DataFrame, key: str, geometry: str = "geometry") -> DataFrame:
    """``key``, ``fault``, ``left`` of every invalid shape: the reason, and whether any area is left. No ring is rebuilt."""
    _, doubtful, judged = _doubtful(df, key, geometry)
    small = judged.where("fault is not null").select(key, "fault", "left")
    if doubtful.isEmpty():
        return small
    found, edges = examined(doubtful, key)
    lasting = edges.select(key).distinct().withColumn("left", F.lit(True))
    return small.unionByName(found.join(lasting, key, "left").select(key, "fault", F.coalesce("left", F.lit(False)).alias("left")))


def repaired(df: DataFrame, key: str, geometry: str = "geometry") -> DataFrame:
    """``key``, ``geometry``, ``fault`` (null when valid): valid shapes oriented, others rebuilt from their outline.

    Single small rings are told valid in their row, and other shapes of few vertices are judged and rebuilt in
    theirs; only the others have their edges joined. Shapes without area are missing from the result. Keys are distinct.
    """
    rows, doubtful, judged = _doubtful(df, key, geometry)
    fine = lambda d: d.select(key, geo.oriented(F.col("geometry")).alias("geometry"), F.lit(None).cast("string").alias("fault"))
    told = rows.where("not _sure").join(judged.drop("left"), key)
    made = F.when(F.col("fault").isNull(), geo.oriented(F.col("geometry"))).otherwise(geo.geometry(F.col("made"), srid=F.col("geometry")["srid"]))
    small = told.where("fault is null or size(made) > 0").select(key, made.alias("geometry"), "fault")
    if doubtful.isEmpty():
        return fine(rows.where("_sure")).unionByName(small)
    wrong, edges = examined(doubtful, key)
    wrong = materialize(wrong, "wrong")
    valid = fine(rows.where("_sure").drop("_sure").unionByName(doubtful.drop("_sure").join(wrong, key, "left_anti"))).unionByName(small)
    if wrong.isEmpty():
        return valid
    made = polygons(stitched(materialize(edges.join(wrong, key, "left_semi"), "outline"), key), key).withColumnRenamed("geometry", "_made")
    same = doubtful.select(key, F.col("geometry.srid").alias("_srid")).join(wrong, key).join(made, key)
    return valid.unionByName(same.select(key, F.col("_made").withField("srid", F.col("_srid")).alias("geometry"), "fault"))
