"""Set-at-a-time spatial joins on a grid whose cell size follows the object size.

Level n has cells of side 4^n / 1024 degrees. An object lives at the smallest
level whose cell is at least as wide as its box, so it touches at most four
cells there. Two objects meet at the coarser of their two levels: one joins by
its own cells, the other by the cells of that level above its own. Dense places
hold small objects and so get small cells, and a country-wide object is one
entry at a coarse level instead of millions of fine cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as geo, overlay
from ..session import materialize, spread
from . import topology

FINEST = 1 / 1024
LEVELS = 10
# From this level on a cell may collect a large share of all fine objects; its
# rows are spread over salts and the few coarse objects are repeated per salt.
SALTED_LEVEL = 5
SALTS = 16
# Deepest cut of a coarse object, in levels, and cell rows a fine object has in one level, about.
DEEPEST = 5
ENTERED = 1.5
# Edges of one slice of a shape.
CHUNK = 256
# Edges a band of a large shape has for each crossing, about.
BAND_EDGES = 8
# Side of a union tile in typical piece sizes.
TILE_PIECES = 4


def _cell_side(level: Column) -> Column:
    return F.pow(F.lit(4.0), level) * FINEST


def _own_level(box: Column) -> Column:
    extent = F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"])
    level = F.when(extent <= FINEST, 0)
    for n in range(1, LEVELS - 1):
        level = level.when(extent <= FINEST * 4**n, n)
    return level.otherwise(LEVELS - 1)


def _level_counts(df: DataFrame, box: str) -> dict[int, int]:
    """Objects of a side by the level they live at; at most LEVELS rows reach the driver."""
    return {r["l"]: r["n"] for r in df.groupBy(_own_level(F.col(box)).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}


def _levels(df: DataFrame, box: str) -> list[int]:
    """Levels that objects of a side live at."""
    return sorted(_level_counts(df, box))


def _homes(coarse: dict[int, int | None], fine: dict[int, int | None]) -> dict[int, int]:
    """The level at which coarse objects of each level await finer ones of the other side.

    That is their own level, or a finer one if both sides have fewer cell rows so: each fine
    object then enters the cells of one level instead of all coarser ones. An object is cut into
    at most 4^DEEPEST cells a side, and levels with salts are no home of coarser objects.
    """
    own = {j: j for j in coarse}
    if None in coarse.values() or None in fine.values():
        return own

    def rows(homes: dict[int, int]) -> float:
        kept = sum(n * (1 + 4.0 ** (j - homes[j])) ** 2 * (SALTS if homes[j] >= SALTED_LEVEL else 1) for j, n in coarse.items())
        asked = sum(n * len({h for h in homes.values() if h > i} | {j for j, h in homes.items() if h <= i < j}) for i, n in fine.items())
        return kept + ENTERED * asked

    cuts = [{j: s if s <= j <= s + DEEPEST else j for j in coarse} for s in coarse if s < SALTED_LEVEL]
    return min([own, *cuts], key=rows)


def _cell_rows(left: dict[int, int | None], right: dict[int, int | None]) -> tuple[dict, dict]:
    """(level, tag) of the cells that left and right objects of each level enter.

    Objects of tag 1 are left ones at their home with right ones as fine as that or finer, of tag 2
    right ones at their home with finer left ones. Where the finer object of a pair is coarser than
    that home, the pair meets at the coarser object's own level: tags 3 and 4.
    """
    lh, rh = _homes(left, right), _homes(right, left)
    a = {
        i: {(lh[i], 1) for j in right if j <= lh[i]} | {(i, 3) for j in right if lh[i] < j <= i}
        | {(rh[j], 2) for j in right if i < rh[j]} | {(j, 4) for j in right if rh[j] <= i < j}
        for i in left
    }
    b = {
        j: {(rh[j], 2) for i in left if i < rh[j]} | {(j, 4) for i in left if rh[j] <= i < j}
        | {(lh[i], 1) for i in left if j <= lh[i]} | {(i, 3) for i in left if lh[i] < j <= i}
        for j in right
    }
    return a, b


def _cells(
    df: DataFrame, key: str, box: str, own_tag: int, others: Sequence[int], keep: Sequence[str] = (), rows: dict[int, set] | None = None
) -> DataFrame:
    """Cell rows of one side, 1 or 2, as `_cell_rows` tells for each level.

    Without `rows` nothing is known of the number of objects; `others` are the levels of the other
    side's objects, and a level without any gets no rows.

    Only one side of a tag holds fine objects, so two large sets never meet in a coarse cell. At
    coarse levels the fine rows are spread over salts and the few coarse objects are repeated per
    salt.
    """
    if rows is None:
        mine, theirs = dict.fromkeys(range(LEVELS)), dict.fromkeys(others)
        rows = _cell_rows(mine, theirs)[0] if own_tag == 1 else _cell_rows(theirs, mine)[1]
    none = F.array().cast("array<struct<l:int,t:int>>")
    listed = none
    for level, entered in rows.items():
        these = F.array(*[F.struct(F.lit(n).alias("l"), F.lit(t).alias("t")) for n, t in sorted(entered)]) if entered else none
        listed = F.when(F.col("_own") == level, these).otherwise(listed)
    leveled = df.withColumn("_own", _own_level(F.col(box))).withColumn("_r", F.explode(listed))
    leveled = leveled.select(
        key, box, *keep, F.col("_r.l").alias("_level"), F.col("_r.t").alias("_tag"),
        _cell_side(F.col("_r.l")).alias("_side"),
    )
    span = lambda lo, hi: F.sequence(
        F.floor(F.col(f"{box}.{lo}") / F.col("_side")), F.floor(F.col(f"{box}.{hi}") / F.col("_side"))
    )
    hot = F.col("_level") >= SALTED_LEVEL
    spread = F.array(F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    repeat = F.sequence(F.lit(0), F.lit(SALTS - 1))
    salts = F.when(~hot, F.array(F.lit(0))).when(F.col("_tag") % 2 == own_tag % 2, repeat).otherwise(spread)
    return (
        leveled.withColumn("_cx", F.explode(span("xmin", "xmax")))
        .withColumn("_cy", F.explode(span("ymin", "ymax")))
        .withColumn("_salt", F.explode(salts))
        .drop("_side")
    )


def candidate_pairs(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_levels: list[int] | None = None,
    left_keep: Sequence[str] = (),
    right_keep: Sequence[str] = (),
) -> DataFrame:
    """Key pairs whose boxes touch, each pair once.

    `left_levels` saves the job that finds the levels of the left side where they are known.

    Both inputs need `bbox`. Only keys, boxes and the columns to keep travel through the
    join. A pair found in several cells is kept in the one that holds the lower-left
    corner of the common box, so no distinct is needed.
    """
    a = left.where("bbox is not null").select(F.col(left_key).alias("_a"), F.col("bbox").alias("_abox"), *left_keep)
    b = right.where("bbox is not null").select(F.col(right_key).alias("_b"), F.col("bbox").alias("_bbox"), *right_keep)
    in_a = _level_counts(a, "_abox") if left_levels is None else dict.fromkeys(left_levels)
    in_b = _level_counts(b, "_bbox")
    rows_a, rows_b = _cell_rows(in_a, in_b)
    # A small table can have many cells, which its size does not tell: none is broadcast for it.
    met = _cells(a, "_a", "_abox", 1, list(in_b), left_keep, rows_a).join(
        _cells(b, "_b", "_bbox", 2, list(in_a), right_keep, rows_b).hint("merge"), ["_tag", "_level", "_cx", "_cy", "_salt"]
    )
    side = _cell_side(F.col("_level"))
    x0 = F.greatest("_abox.xmin", "_bbox.xmin")
    y0 = F.greatest("_abox.ymin", "_bbox.ymin")
    return met.where(
        (x0 <= F.least("_abox.xmax", "_bbox.xmax"))
        & (y0 <= F.least("_abox.ymax", "_bbox.ymax"))
        & (F.floor(x0 / side) == F.col("_cx"))
        & (F.floor(y0 / side) == F.col("_cy"))
    ).select(F.col("_a").alias(left_key), F.col("_b").alias(right_key), *left_keep, *right_keep)


def with_shape(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Add `shape`, 128 hash bits as bytes: equal for geometries with equal coordinates."""
    parts = F.col(geometry)["parts"]
    both = F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(parts), F.xxhash64(F.lit("shape"), parts))]))
    # Generated: a join asks for its key not to be null, and such a test would be pushed down into the
    # geometry, whose expression it would repeat for each coordinate.
    return df.withColumn("shape", F.explode(F.array(F.when(parts.isNotNull(), both))))


def distinct_shapes(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """``shape``, ``geometry``, ``copies``: one row per distinct shape that has coordinates.

    Copies of a geometry collapse before any pair is built, so a layer that
    repeats one shape many times costs one overlay. Coordinates are lon/lat;
    other reference systems are moved at ingest and dropped here.
    """
    # Filtered after the aggregation: before it, the test would be pushed into
    # whatever expression built the geometry and repeat it.
    known = F.col("geometry")["srid"].isin(*geo.GEOGRAPHIC_SRIDS)
    return (
        df.groupBy("shape")
        .agg(F.first(geometry).alias("geometry"), F.count(F.lit(1)).alias("copies"))
        .where(known & ~geo.is_empty(F.col("geometry")))
    )


def _measured_shapes(distinct: DataFrame) -> DataFrame:
    return distinct.withColumns(
        {
            "bbox": geo.bbox(F.col("geometry")),
            "runs": overlay.runs(geo.equal_area(F.col("geometry"))),
        }
    )


def shapes(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One row per distinct shape with what joins and overlays need; shapes are taken to be valid."""
    return _measured_shapes(distinct_shapes(df, geometry).withColumn("geometry", geo.oriented(F.col("geometry"))))


def valid_shapes(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """`shapes` with invalid geometries repaired once each; what has no area left is dropped.

    Written once: edges of doubtful shapes are joined only if there are any.
    """
    distinct = distinct_shapes(df, geometry)
    sure = topology.surely_valid(F.col("geometry"))
    # What costs most is done once a shape, before the test splits the table.
    first = _measured_shapes(distinct.withColumn("_sure", sure).withColumn("geometry", geo.oriented(F.col("geometry"))))
    first = materialize(first, "shapes")
    doubtful = first.where("not _sure")
    if doubtful.isEmpty():
        return first.drop("_sure")
    fixed = topology.repaired(doubtful.select("shape", "geometry"), "shape").drop("fault")
    again = _measured_shapes(doubtful.select("shape", "copies").join(fixed, "shape"))
    names = ["shape", "geometry", "copies", "bbox", "runs"]
    return materialize(first.where("_sure").select(*names).unionByName(again.select(*names)), "shapes")


def with_valid_geometry(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """`df` with each geometry valid or repaired, and NULL where nothing with an area is left.

    Equal geometries are repaired once; large ones edge by edge over many rows. The rows are written once.
    """
    rows = materialize(with_shape(df, geometry).withColumn("_same", F.struct("shape", F.col(geometry)["srid"].alias("srid"))).drop("shape"), "shaped")
    distinct = rows.where(F.col("_same.shape").isNotNull()).groupBy("_same").agg(F.first(geometry).alias("geometry"))
    fixed = topology.repaired(distinct, "_same").select("_same", F.col("geometry").alias("_fixed"))
    return rows.join(fixed, "_same", "left").withColumn(geometry, F.col("_fixed")).drop("_same", "_fixed")


def _chunks(side: DataFrame, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """Runs of a shape in slices of at most CHUNK edges, ordered by x, with their x range."""
    runs = F.array_sort("runs")
    starts = F.sequence(F.lit(1), F.greatest(F.size("runs"), F.lit(1)), F.lit(CHUNK))
    slices = F.when(F.size("runs") <= CHUNK, F.array("runs")).otherwise(
        F.transform(starts, lambda i: F.slice(runs, i, F.lit(CHUNK)))
    )
    cut = side.select(F.col("shape").alias(name), F.explode(slices).alias(f"r{name}"), *keep)
    ends = lambda k: F.transform(f"r{name}", lambda e: e[k])
    return cut.withColumns(
        {f"{name}lo": F.array_min(ends("x0")), f"{name}hi": F.array_max(ends("x1"))}
    )


def shape_overlaps(
    left: DataFrame, right: DataFrame, tolerance: float = geo.TOLERANCE_M2, once: bool = False
) -> DataFrame:
    """Shape pairs with a shared area above the tolerance, from two `shapes` tables.

    The shared area is a sum over edge pairs. Shapes of at most CHUNK edges bring theirs into the
    grid, where a pair is measured as it is found. The edges of a larger polygon
    travel in slices and the slices of a pair are summed: no row ever works on
    more than CHUNK x CHUNK edge pairs, and only slices whose x ranges meet do
    any work. With `once` both sides
    are the same table and each unordered pair is measured once.
    """
    a = left.select(F.col("shape").alias("a"), "bbox", F.col("runs").alias("ra"))
    b = right.select(F.col("shape").alias("b"), "bbox", F.col("runs").alias("rb"))
    (a, wide_a), (b, wide_b) = _by_size(a, F.size("ra")), _by_size(b, F.size("rb"))
    one_way = (lambda df: df.where("a < b")) if once else (lambda df: df)
    pairs = one_way(candidate_pairs(a, b, "a", "b", left_keep=["ra"], right_keep=["rb"]))
    area = overlay.overlap(F.col("ra"), F.col("rb")) * geo.AREA_SCALE
    # Generated, so that the test on the area does not make it again.
    found = pairs.select("a", "b", F.explode(F.array(area)).alias("area_m2"))
    for x, y in _with_wide(a, wide_a, b, wide_b):
        found = found.unionByName(measured(one_way(candidate_pairs(x, y, "a", "b")), left, right))
    return found.where(F.col("area_m2") > tolerance)


def _by_size(side: DataFrame, edges: Column) -> tuple[DataFrame, DataFrame | None]:
    """Objects of at most CHUNK edges, and the others if there are any."""
    wide = side.where(edges > CHUNK)
    return side.where(edges <= CHUNK), None if wide.isEmpty() else wide


def _with_wide(a: DataFrame, wide_a: DataFrame | None, b: DataFrame, wide_b: DataFrame | None) -> list[tuple[DataFrame, DataFrame]]:
    """Sides whose pairs hold at least one object of many edges; each pair is in one of them."""
    return [(x, y) for x, y in ((wide_a, b), (a, wide_b), (wide_a, wide_b)) if x is not None and y is not None]


def measured(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Shared area of given shape pairs (a, b), slice by slice."""
    sliced = pairs.join(_chunks(left, "a"), "a").join(_chunks(right, "b"), "b")
    met = sliced.where("alo < bhi and blo < ahi")
    area = overlay.overlap(F.col("ra"), F.col("rb"))
    return met.groupBy("a", "b").agg((F.sum(area) * geo.AREA_SCALE).alias("area_m2"))


def row_contacts(left: DataFrame, right: DataFrame, left_keep: Sequence[str], right_keep: Sequence[str]) -> DataFrame:
    """Columns to keep of the pairs of rows that share at least one point.

    Both sides have `geometry` of at most CHUNK edges and `bbox`. Edges travel with the boxes, so a
    pair is tested in the cell that finds it, and no pair is written or joined to its shapes again.
    """
    first = lambda parts: F.transform(parts, lambda p: F.get(F.get(p, F.lit(0)), F.lit(0)))
    side = lambda df, n, keep: df.select(
        F.xxhash64(*keep).alias(f"_k{n}"), "bbox", geo.edges(F.col("geometry")).alias(f"e{n}"), first(F.col("geometry")["parts"]).alias(f"v{n}"), *keep
    )
    kept = [f"{c}{n}" for n in "ab" for c in "ev"]
    a, b = side(left, "a", left_keep), side(right, "b", right_keep)
    pairs = candidate_pairs(
        a, b, "_ka", "_kb",
        left_keep=[*kept[:2], *left_keep], right_keep=[*kept[2:], *right_keep],
    )
    holds = lambda es, vs: F.exists(vs, lambda v: F.size(F.filter(es, lambda e: geo.passes_right(e, v["x"], v["y"]))) % 2 == 1)
    meet = F.exists("ea", lambda x: F.exists("eb", lambda y: geo.edges_meet(x, y)))
    return pairs.where(holds("ea", "vb") | holds("eb", "va") | meet).select(*left_keep, *right_keep)


# Columns of a slice of a shape besides its key, as `with_edges` names them for a side.
EDGE_COLUMNS = ("r", "lo", "hi", "ylo", "yhi", "m2")


def with_edges(rows: DataFrame, side: DataFrame, name: str, keep: Sequence[str], how: str = "inner") -> DataFrame:
    """Distinct rows of a shape key and columns to keep, once for each slice of the shape, with its area.

    Sent to the shapes by their key first, so that telling rows apart needs no other shuffle.
    """
    n = name
    cut = _chunks(shape_areas(side, "runs", "bbox"), n, ["bbox", "m2"]).select(
        n, f"r{n}", F.col(f"{n}lo").alias(f"lo{n}"), F.col(f"{n}hi").alias(f"hi{n}"),
        F.col("bbox.ymin").alias(f"ylo{n}"), F.col("bbox.ymax").alias(f"yhi{n}"), "m2",
    )
    each = rows.select(n, *keep).repartition(n).dropDuplicates()
    return each.join(cut.withColumnRenamed("m2", f"m2{n}").hint("merge"), n, how)


def slices_meet() -> Column:
    """The ranges of two slices of `with_edges`, named a and b, meet.

    Coalesced, so that no test for null is drawn from it into one of two equal shuffles.
    """
    return F.coalesce(F.expr("loa < hib and lob < hia and yloa < yhib and ylob < yhia"), F.lit(False))


def shared_m2() -> Column:
    """Area shared by two shapes, summed over their slices a and b that meet."""
    area = F.when(slices_meet(), overlay.overlap(F.col("ra"), F.col("rb")))
    return F.sum(area) * geo.AREA_SCALE


def shape_contacts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Shape pairs that share at least one point, edge contact included.

    Two shapes meet where their edges do, or a part of one lies within the other; its first vertex
    tells that. Pairs of shapes of at most CHUNK edges are tested as the grid finds them, others slice by slice.
    """
    count = F.size(geo.vertices(F.col("geometry")))
    (a, wide_a), (b, wide_b) = _by_size(left, count), _by_size(right, count)
    name = lambda df, n: df.select(F.col("shape").alias(n), "geometry", "bbox")
    met = row_contacts(name(a, "a"), name(b, "b"), ["a"], ["b"])
    for x, y in _with_wide(a, wide_a, b, wide_b):
        met = met.unionByName(_sliced_contacts(x, y))
    return met


def member_contacts(
    left: DataFrame, right: DataFrame, left_shapes: DataFrame, right_shapes: DataFrame, left_keep: Sequence[str], right_keep: Sequence[str]
) -> DataFrame:
    """Columns to keep of feature pairs that share at least one point.

    Features enter the grid with their shape and what is asked of them, so the many pairs are not
    shuffled by shape; pairs that hold a shape of many edges are found shape by shape.
    """
    count = F.size(geo.vertices(F.col("geometry")))
    (a, wide_a), (b, wide_b) = _by_size(left_shapes, count), _by_size(right_shapes, count)
    outline = lambda df: df.select("shape", "geometry", "bbox")
    met = row_contacts(left.join(outline(a), "shape"), right.join(outline(b), "shape"), left_keep, right_keep)
    for x, y in _with_wide(a, wide_a, b, wide_b):
        mine = left.select(F.col("shape").alias("a"), *left_keep).join(_sliced_contacts(x, y), "a")
        met = met.unionByName(mine.join(right.select(F.col("shape").alias("b"), *right_keep), "b").drop("a", "b"))
    return met


def _sliced_contacts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Contacts of shapes of any size.

    Edges travel in slices of at most CHUNK, so a row compares two slices, and only those
    whose boxes meet; crossings beside a vertex are summed over slices.
    """
    sides = {"a": left, "b": right}
    pairs = materialize(candidate_pairs(*(d.select(F.col("shape").alias(n), "bbox") for n, d in sides.items()), "a", "b"), "pairs")
    slices = {n: _edge_slices(d, n) for n, d in sides.items()}
    boxes = "alo_x <= bhi_x and blo_x <= ahi_x and alo_y <= bhi_y and blo_y <= ahi_y"
    meet = F.exists("ea", lambda a: F.exists("eb", lambda b: geo.edges_meet(a, b)))
    touching = pairs.join(slices["a"], "a").join(slices["b"], "b").where(boxes).where(meet).select("a", "b")

    def holds(outer: str, inner: str) -> DataFrame:
        """Parts of one side whose first vertex lies within the other."""
        first = F.transform(F.col("geometry")["parts"], lambda p: F.get(F.get(p, F.lit(0)), F.lit(0)))
        starts = sides[inner].select(F.col("shape").alias(inner), F.posexplode(first).alias("_part", "_v"))
        x, y = F.col("_v")["x"], F.col("_v")["y"]
        beside = pairs.join(starts, inner).join(slices[outer], outer).where(y.between(F.col(f"{outer}lo_y"), F.col(f"{outer}hi_y")) & (x <= F.col(f"{outer}hi_x")))
        odd = F.sum(F.size(F.filter(f"e{outer}", lambda e: geo.passes_right(e, x, y)))) % 2 == 1
        return beside.groupBy("a", "b", "_part").agg(odd.alias("_in")).where("_in").select("a", "b")

    return touching.unionByName(holds("a", "b")).unionByName(holds("b", "a")).distinct()


def _edge_slices(side: DataFrame, name: str) -> DataFrame:
    """Edges of a shape in slices of at most CHUNK with the box of each."""
    listed = side.select(F.col("shape").alias(name), geo.edges(F.col("geometry")).alias("_e"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_e"), F.lit(1)), F.lit(CHUNK))
    slices = F.when(F.size("_e") <= CHUNK, F.array("_e")).otherwise(F.transform(starts, lambda i: F.slice("_e", i, F.lit(CHUNK))))
    cut = listed.select(name, F.explode(slices).alias(f"e{name}"))
    ends = lambda k: F.concat(*[F.transform(f"e{name}", lambda e: e[f"{k}{i}"]) for i in (1, 2)])
    return cut.withColumns({f"{name}{word}_{k}": of(ends(k)) for k in "xy" for word, of in (("lo", F.array_min), ("hi", F.array_max))})


def intersection_shapes(overlaps: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Add the clipped geometry to shape pairs."""
    ra = left.select(F.col("shape").alias("a"), overlay.rises(F.col("geometry")).alias("_ra"))
    rb = right.select(F.col("shape").alias("b"), overlay.rises(F.col("geometry")).alias("_rb"))
    both = overlaps.join(ra, "a").join(rb, "b")
    # Generated, so that a test on its parts does not clip the pair again.
    clipped = F.explode(F.array(overlay.intersection(F.col("_ra"), F.col("_rb"))))
    return both.withColumn("geometry", clipped).drop("_ra", "_rb")


def shape_areas(side: DataFrame, *keep: str) -> DataFrame:
    """Area per shape, from the same runs as the overlaps, and columns to keep."""
    below = F.aggregate(
        "runs", F.lit(0.0), lambda acc, e: acc - e["s"] * (e["x1"] - e["x0"]) * (e["y0"] + e["y1"]) / 2
    )
    return side.select("shape", (below * geo.AREA_SCALE).alias("m2"), *keep)


# Fixed value: rows kept per property before the truncation flag is set.
EXTERNAL_LIMIT = 2000


def member_overlaps(
    left: DataFrame,
    right: DataFrame,
    overlaps: DataFrame,
    left_key: str,
    right_key: str,
    limit: int = EXTERNAL_LIMIT,
    itself: bool = False,
) -> DataFrame:
    """Feature pairs from shape pairs, at most `limit` per left feature.

    The limit is the report's own top-k by shared area, key as tie-break. Of a
    shape on the right only its first limit + 1 members can appear in any such
    list, so no more are expanded; the rank filter is applied before and after
    the shuffle by Spark's window group limit.
    """
    first = Window.partitionBy("shape").orderBy(right_key)
    members = (
        right.select(F.col("shape").alias("b"), F.col("shape"), right_key)
        .withColumn("_m", F.row_number().over(first))
        .where(F.col("_m") <= limit + 1)
        .drop("shape", "_m")
    )
    mine = left.select(F.col("shape").alias("a"), left_key)
    expanded = mine.join(overlaps, "a").join(members, "b")
    if itself:
        expanded = expanded.where(F.col(left_key) != F.col(right_key))
    # Areas are compared to the square millimetre, so equal shapes tie exactly.
    rank = Window.partitionBy(left_key).orderBy(F.round("area_m2", 6).desc(), F.col(right_key))
    ranked = expanded.withColumn("ordem", F.row_number().over(rank))
    return ranked.where(F.col("ordem") <= limit)


def overlap_counts(
    left: DataFrame, overlaps: DataFrame, right: DataFrame, left_key: str, itself: bool = False
) -> DataFrame:
    """Per left feature: how many right features overlap and their summed area.

    Works on shapes and copies, so nothing is expanded to count it. With
    `itself` both sides are the same features and none counts for itself.
    """
    weights = right.select(F.col("shape").alias("b"), "copies")
    others = F.col("copies") - F.when(F.col("a") == F.col("b"), 1).otherwise(0) if itself else F.col("copies")
    per_shape = (
        overlaps.join(weights, "b")
        .withColumn("copies", others)
        .groupBy("a")
        .agg(F.sum("copies").alias("quantidade"), F.sum(F.col("area_m2") * F.col("copies")).alias("soma_m2"))
    )
    return left.select(F.col("shape").alias("a"), left_key).join(per_shape, "a").drop("a")


def overlap_groups(
    left: DataFrame, right: DataFrame, overlaps: DataFrame, left_key: str, values: Sequence[str]
) -> DataFrame:
    """Per left feature and values of right features: how many overlap and their summed area, all of them.

    `right` has `shape` and the values. Its rows of one shape and equal values are counted before
    they meet the pairs, and the pairs are summed per left shape before they meet its features, so
    copies are expanded on neither side.
    """
    members = right.groupBy(F.col("shape").alias("b"), *values).agg(F.count(F.lit(1)).alias("copies"))
    per_shape = (
        overlaps.join(members, "b")
        .groupBy("a", *values)
        .agg(F.sum("copies").alias("quantidade"), F.sum(F.col("area_m2") * F.col("copies")).alias("soma_m2"))
    )
    return left.select(F.col("shape").alias("a"), left_key).join(per_shape, "a").drop("a")


def union_areas(pieces: DataFrame, keys: Sequence[str], geometry: str = "geometry") -> DataFrame:
    """Covered area per key of many overlapping polygons, nothing counted twice.

    Pieces are cut into tiles of a few typical piece sizes per key, so a key
    with very many pieces becomes many small tiles; tile areas add up. Copies
    are dropped before the tiles are built. Tiles, not keys, are dealt over the
    tasks, in as many as the session names, so that neither a large key nor
    partitions joined for their few bytes meet in the memory of one task.

    `pieces` are read twice, for the sizes and for the tiles: written ones are made once.
    """
    made = overlay.rises(geo.equal_area(geo.oriented(geo.geometry(F.array("part")))))
    # Generated, so that the test on the box does not make the edges again.
    each = (
        pieces.select(*keys, F.explode(F.col(geometry)["parts"]).alias("part"))
        .select(*keys, F.explode(F.array(made)).alias("rises"))
        .distinct()
    )
    xs = F.flatten(F.transform("rises", lambda e: F.array(e["x0"], e["x1"])))
    ys = F.flatten(F.transform("rises", lambda e: F.array(e["y0"], e["y1"])))
    each = each.withColumns(
        {"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)}
    ).where("x0 is not null")
    sizes = each.groupBy(*keys).agg(
        (F.avg(F.col("x1") - F.col("x0")) * TILE_PIECES).alias("sx"),
        (F.avg(F.col("y1") - F.col("y0")) * TILE_PIECES).alias("sy"),
    )
    sized = each.join(sizes, list(keys)).where("sx > 0 and sy > 0")
    span = lambda lo, hi, side: F.sequence(
        F.floor(F.col(lo) / F.col(side)), F.floor(F.col(hi) / F.col(side))
    )
    tiled = sized.withColumn("tx", F.explode(span("x0", "x1", "sx"))).withColumn(
        "ty", F.explode(span("y0", "y1", "sy"))
    )
    tile = F.struct(
        (F.col("tx") * F.col("sx")).alias("x0"),
        (F.col("ty") * F.col("sy")).alias("y0"),
        ((F.col("tx") + 1) * F.col("sx")).alias("x1"),
        ((F.col("ty") + 1) * F.col("sy")).alias("y1"),
    )
    dealt = spread(tiled.select(*keys, "tx", "ty", "sx", "sy", "rises"), *keys, "tx", "ty")
    grouped = dealt.groupBy(*keys, "tx", "ty", "sx", "sy").agg(
        F.flatten(F.collect_list("rises")).alias("rises")
    )
    return (
        grouped.withColumn("m2", overlay.tile_union(F.col("rises"), tile) * geo.AREA_SCALE)
        .groupBy(*keys)
        .agg(F.sum("m2").alias("area_unica_m2"))
    )


def points_in_shapes(points: DataFrame, side: DataFrame, point_key: str) -> DataFrame:
    """Point keys and the shapes that contain them, boundary included.

    `points` has x and y; equal positions are looked up once. `side` has `shape`, `geometry` and `bbox`;
    shapes need no repair: a point counts as inside when it is in the shell of a part and in none of
    its holes. Shapes with many edges are entered in bands, and a point meets the edges of one band.
    """
    spots = points.select("x", "y").distinct().where("x is not null and y is not null")
    spots = spots.withColumns(
        {
            "spot": F.struct("x", "y"),
            "bbox": F.struct(
                F.col("x").alias("xmin"), F.col("y").alias("ymin"),
                F.col("x").alias("xmax"), F.col("y").alias("ymax"),
            ),
        }
    )
    # A spot has no extent, so it lives at the finest level.
    pairs = candidate_pairs(spots, side, "spot", "shape", left_levels=[0])
    known = side.withColumn("_n", F.size(geo.vertices(F.col("geometry"))))
    small = known.where(F.col("_n") <= CHUNK).select("shape", F.col("geometry")["parts"].alias("_parts"))
    x, y = F.col("spot.x"), F.col("spot.y")
    near = pairs.join(small, "shape").where(F.exists("_parts", lambda part: geo.part_covers(part, x, y))).select("spot", "shape")
    hits = near.unionByName(_in_bands(pairs, known.where(F.col("_n") > CHUNK)))
    hits = hits.select(F.col("spot.x").alias("x"), F.col("spot.y").alias("y"), "shape")
    return points.select(point_key, "x", "y").join(hits, ["x", "y"]).select(point_key, "shape")


def _in_bands(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """Spots in shapes with many edges: crossings beside a spot are counted by ring over the edges of its band."""
    heights = side.select(
        "shape", F.col("bbox.ymin").alias("_low"), F.col("bbox.xmin").alias("_left"),
        F.nullif((F.col("bbox.ymax") - F.col("bbox.ymin")) / F.ceil(F.col("_n") / BAND_EDGES), F.lit(0.0)).alias("_height"),
    )
    band = lambda y: F.floor((y - F.col("_low")) / F.col("_height"))
    edges = topology.edge_rows(topology.part_rows(side, "shape"), "shape").join(heights, "shape")
    e = F.col("e")
    spans = F.sequence(band(F.least(e["y1"], e["y2"])), band(F.greatest(e["y1"], e["y2"])))
    walls = edges.select("shape", "part", "ring", "e", F.explode(spans).alias("_band"))
    asked = pairs.join(heights, "shape").select("spot", "shape", band(F.col("spot.y")).alias("_band"))
    x, y = F.col("spot.x"), F.col("spot.y")
    rings = asked.join(walls, ["shape", "_band"]).groupBy("spot", "shape", "part", "ring").agg(
        (F.sum(geo.passes_right(e, x, y).cast("int")) % 2 == 1).alias("_odd"), F.max(geo.on_edge(x, y, e)).alias("_on")
    )
    shell = F.max(F.when(F.col("ring") == 0, F.col("_odd") | F.col("_on")))
    hole = F.max(F.when(F.col("ring") > 0, F.col("_odd") & ~F.col("_on")))
    parts = rings.groupBy("spot", "shape", "part").agg((F.coalesce(shell, F.lit(False)) & ~F.coalesce(hole, F.lit(False))).alias("_in"))
    return parts.where("_in").select("spot", "shape").distinct()


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, NULL when the whole is not positive."""
    return F.when(whole > 0, part / whole * 100)
