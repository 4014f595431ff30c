"""Overlap joins between properties and layers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry as geo, overlay
from ..operators import spatial
from ..operators.confront import Indexed, other_properties
from ..session import materialize
from . import roles
from .registry import query, table

_E2 = geo.FLATTENING * (2 - geo.FLATTENING)
_E = math.sqrt(_E2)
_K = geo.SEMI_MAJOR**2 / 2 * math.pi / 180


def q_sql(lat: str) -> str:
    s = f"sin(radians({lat}))"
    return (
        f"({1 - _E2!r}::double * ({s} / (1 - {_E2!r}::double * {s} * {s})"
        f" - ln((1 - {_E!r}::double * {s}) / (1 + {_E!r}::double * {s})) / {2 * _E!r}::double))"
    )


def box_m2(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"(({x1}) - ({x0})) * ({q_sql(y1)} - {q_sql(y0)}) * {_K!r}::double"


def overlap_sql(a: str, b: str) -> str:
    return f"""
      greatest({a}.x0, {b}.x0) as ix0, greatest({a}.y0, {b}.y0) as iy0,
      least({a}.x1, {b}.x1) as ix1, least({a}.y1, {b}.y1) as iy1"""


_PAIRS = """
pairs as (
  select p.cod_imovel, l.{key} as feature, greatest(p.x0, l.x0) as ix0, greatest(p.y0, l.y0) as iy0,
    least(p.x1, l.x1) as ix1, least(p.y1, l.y1) as iy1, p.x0 as px0, p.y0 as py0, p.x1 as px1, p.y1 as py1,
    l.x0 as lx0, l.y0 as ly0, l.x1 as lx1, l.y1 as ly1
  from properties p join {layer} l on p.x0 < l.x1 and l.x0 < p.x1 and p.y0 < l.y1 and l.y0 < p.y1),
areas as (
  select *, {inter} as m2, {prop} as prop_m2, {feat} as feat_m2 from pairs)
"""


def pairs_sql(layer: str, key: str) -> str:
    return _PAIRS.format(
        layer=layer,
        key=key,
        inter=box_m2("ix0", "iy0", "ix1", "iy1"),
        prop=box_m2("px0", "py0", "px1", "py1"),
        feat=box_m2("lx0", "ly0", "lx1", "ly1"),
    )


def sides(spark: SparkSession, sf: str, layer: DataFrame) -> tuple[DataFrame, ...]:
    props, feats = Indexed.of(roles.properties(spark, sf)), Indexed.of(layer)
    return props.features, feats.features, props.shapes, feats.shapes


@query(
    "G2 G5 G3",
    sql=f"""with {roles.PROPERTIES_SQL}
    select cod_imovel, x0 as xmin, y0 as ymin, x1 as xmax, y1 as ymax,
      round({box_m2("x0", "y0", "x1", "y1")} / 10000, 4) as area_ha, (x1 - x0) * (y1 - y0) as planar
    from properties""",
)
def property_boxes_and_areas(spark: SparkSession, sf: str) -> DataFrame:
    p = roles.properties(spark, sf)
    return p.select(
        "cod_imovel",
        geo.bbox(F.col("geometry")).alias("b"),
        F.round(geo.area_m2(F.col("geometry")) / 10000, 4).alias("area_ha"),
        geo.planar_area(F.col("geometry")).alias("planar"),
    ).select("cod_imovel", "b.*", "area_ha", "planar")


@query(
    "J1 G9 G10 G13 G15 O1",
    sql=f"""with {roles.PROPERTIES_SQL}, {roles.ALERTS_SQL}, {pairs_sql("alerts", "fid")}
    select cod_imovel, feature as fid, round(m2 / 10000, 4) as area_sobreposta_ha,
      round(m2 / prop_m2 * 100, 4) as percentual_car, round(m2 / feat_m2 * 100, 4) as percentual_fonte,
      round(feat_m2 / 10000, 4) as area_geometria_ha, ordem
    from (select *, row_number() over (partition by cod_imovel order by round(m2, 6) desc, feature) as ordem
          from areas where m2 > 1.0) where ordem <= 2000""",
    bench=True,
)
def overlap_external_layer(spark: SparkSession, sf: str) -> DataFrame:
    """Every property against the alert layer: area, percentages, top-k rank."""
    props, feats, ps, fs = sides(spark, sf, roles.alerts_layer(spark, sf))
    pairs = spatial.shape_overlaps(ps, fs)
    rows = spatial.member_overlaps(props, feats, pairs, "cod_imovel", "fid")
    pa = spatial.shape_areas(ps).select(F.col("shape").alias("a"), F.col("m2").alias("pm2"))
    fa = spatial.shape_areas(fs).select(F.col("shape").alias("b"), F.col("m2").alias("fm2"))
    full = rows.join(pa, "a").join(fa, "b")
    return full.select(
        "cod_imovel",
        "fid",
        F.round(F.col("area_m2") / 10000, 4).alias("area_sobreposta_ha"),
        F.round(spatial.percent(F.col("area_m2"), F.col("pm2")), 4).alias("percentual_car"),
        F.round(spatial.percent(F.col("area_m2"), F.col("fm2")), 4).alias("percentual_fonte"),
        F.round(F.col("fm2") / 10000, 4).alias("area_geometria_ha"),
        "ordem",
    )


@query(
    "J2 G17 O1",
    sql=f"""with {roles.PROPERTIES_SQL}, pairs as (
      select a.cod_imovel, b.cod_imovel as outro, greatest(a.x0, b.x0) as ix0, greatest(a.y0, b.y0) as iy0,
        least(a.x1, b.x1) as ix1, least(a.y1, b.y1) as iy1, a.x0 as ax0, a.y0 as ay0, a.x1 as ax1, a.y1 as ay1,
        b.x0 as bx0, b.y0 as by0, b.x1 as bx1, b.y1 as by1
      from properties a join properties b on a.cod_imovel <> b.cod_imovel
        and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1),
    areas as (select *, {box_m2("ix0", "iy0", "ix1", "iy1")} as m2, {box_m2("ax0", "ay0", "ax1", "ay1")} as am,
      {box_m2("bx0", "by0", "bx1", "by1")} as bm from pairs)
    select cod_imovel, outro, round(m2 / 10000, 4) as area_sobreposta_ha,
      round(m2 / am * 100, 4) as percentual_car_consultado, round(m2 / bm * 100, 4) as percentual_outro_car, ordem
    from (select *, row_number() over (partition by cod_imovel order by round(m2, 6) desc, outro) as ordem
          from areas where m2 > 1.0) where ordem <= 1000""",
    bench=True,
)
def overlap_other_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Property against property: unordered shape pairs once, then mirrored."""
    rows = other_properties(Indexed.of(roles.properties(spark, sf)))
    return rows.select(
        "cod_imovel",
        "outro",
        F.round("area_sobreposta_ha", 4).alias("area_sobreposta_ha"),
        F.round("percentual_car_consultado", 4).alias("percentual_car_consultado"),
        F.round("percentual_outro_car", 4).alias("percentual_outro_car"),
        "ordem",
    )


_UNION_SQL = f"""with {roles.PROPERTIES_SQL}, {roles.EMBARGO_SQL}, {pairs_sql("embargo", "seq_tad")},
    kept as (select distinct cod_imovel, ix0, iy0, ix1, iy1 from areas where m2 > 1.0),
    ys as (select cod_imovel, iy0 as y from kept union select cod_imovel, iy1 from kept),
    slabs as (select cod_imovel, y as ya, lead(y) over (partition by cod_imovel order by y) as yb from ys),
    spans as (select s.cod_imovel, ya, yb, ix0, ix1, max(ix1) over (partition by s.cod_imovel, ya order by ix0, ix1
        rows between unbounded preceding and 1 preceding) as seen
      from slabs s join kept k on s.cod_imovel = k.cod_imovel and k.iy0 <= ya and k.iy1 >= yb where yb is not null)
    select cod_imovel, round(sum(greatest(0, ix1 - greatest(ix0, coalesce(seen, ix0)))
      * ({q_sql("yb")} - {q_sql("ya")}) * {_K!r}::double) / 10000, 3) as area_unica_ha
    from spans group by 1"""


@query(
    "A9 U8",
    sql=_UNION_SQL,
    bench=True,
)
def union_area_per_property(spark: SparkSession, sf: str) -> DataFrame:
    """Area of each property covered by the embargo layer, overlaps counted once."""
    props, _, ps, fs = sides(spark, sf, roles.embargo_layer(spark, sf))
    pieces = spatial.intersection_shapes(spatial.shape_overlaps(ps, fs), ps, fs).select("a", "geometry")
    per_shape = spatial.union_areas(materialize(pieces, "pieces"), ["a"])
    mine = props.select(F.col("shape").alias("a"), "cod_imovel").join(per_shape, "a")
    return mine.select(
        "cod_imovel", F.round(F.col("area_unica_m2") / 10000, 3).alias("area_unica_ha")
    )


@query("A9 U8 G11", sql=_UNION_SQL)
def union_shape_per_property(spark: SparkSession, sf: str) -> DataFrame:
    """The covered part of each property as polygons, measured."""
    from ..operators import topology

    props, _, ps, fs = sides(spark, sf, roles.embargo_layer(spark, sf))
    pieces = spatial.intersection_shapes(spatial.shape_overlaps(ps, fs), ps, fs)
    united = topology.dissolved(pieces.select("a", "geometry"), "a")
    measured = united.select("a", F.round(geo.area_m2(F.col("geometry")) / 10000, 3).alias("area_unica_ha"))
    return props.select(F.col("shape").alias("a"), "cod_imovel").join(measured, "a").select("cod_imovel", "area_unica_ha")


def _point_table(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    lon = F.lit(-72.0) + (F.col("event_id") * 37 % 1024) / 32
    lat = F.lit(-32.0) + (F.col("event_id") * 91 % 1021) / 32
    return e.select("event_id", lon.alias("x"), lat.alias("y"))


@query(
    "J3 G12 O2 P26",
    sql=f"""with {roles.PROPERTIES_SQL}, pts as (
      select event_id, -72.0::double + (event_id * 37 % 1024) / 32 as x, -32.0::double + (event_id * 91 % 1021) / 32 as y from events),
    hits as (select event_id, cod_imovel, row_number() over (partition by event_id order by area_total_ha, cod_imovel) as ordem
      from pts join properties on x between x0 and x1 and y between y0 and y1)
    select *, (select count(*) from hits h2 where h2.event_id = hits.event_id) > 20 as truncada from hits where ordem <= 20""",
    bench=True,
)
def properties_at_points(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import locate

    pts = _point_table(spark, sf).where(locate.valid_position(F.col("y"), F.col("x")))
    found = locate.by_point(pts, roles.properties(spark, sf), "event_id")
    return found.select("event_id", "cod_imovel", "ordem", "truncada")


@query(
    "J4 F30 X5",
    sql=f"""with {roles.PROPERTIES_SQL}, {roles.EMBARGO_SQL}, views as (
      select seq_tad, x0 as west, y0 as south, x0 + 0.5 as east, y0 + 0.5 as north, 12 + seq_tad % 3 as zoom from embargo),
    ok as (select * from views where 0.5 <= 360.0 * 12 / pow(2, zoom)),
    hits as (select seq_tad, cod_imovel, row_number() over (partition by seq_tad order by cod_imovel) as ordem,
        count(*) over (partition by seq_tad) as n
      from ok join properties on west <= x1 and x0 <= east and south <= y1 and y0 <= north
      where uf <> 'PE' or cod_imovel is not null)
    select seq_tad, cod_imovel, ordem, n > 750 as truncada from hits where ordem <= 750""",
)
def properties_in_views(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import locate

    e = roles.embargo_layer(spark, sf)
    corners = e.select("seq_tad", F.inline(F.array(geo.bbox(F.col("geometry")))))
    views = corners.select(
        "seq_tad",
        F.col("xmin").alias("west"),
        F.col("ymin").alias("south"),
        (F.col("xmin") + 0.5).alias("east"),
        (F.col("ymin") + 0.5).alias("north"),
        (12 + F.col("seq_tad") % 3).alias("zoom"),
        F.lit("").alias("excluded"),
    )
    ok = views.where(
        locate.valid_view(*[F.col(c) for c in ("zoom", "west", "south", "east", "north")])
    )
    found = locate.by_view(ok, roles.properties(spark, sf), "seq_tad")
    return found.select("seq_tad", "cod_imovel", "ordem", "truncada")


@query(
    "J5 O3 X4",
    sql=f"""with {roles.PROPERTIES_SQL}, {roles.UNITS_SQL}, pairs as (
      select l.uc_id, p.cod_imovel, p.area_total_ha, greatest(p.x0, l.x0) as ix0, greatest(p.y0, l.y0) as iy0,
        least(p.x1, l.x1) as ix1, least(p.y1, l.y1) as iy1, p.x0 as px0, p.y0 as py0, p.x1 as px1, p.y1 as py1
      from properties p join units l on p.x0 < l.x1 and l.x0 < p.x1 and p.y0 < l.y1 and l.y0 < p.y1),
    areas as (select *, {box_m2("ix0", "iy0", "ix1", "iy1")} as m2, {box_m2("px0", "py0", "px1", "py1")} as pm from pairs)
    select uc_id, cod_imovel, round(m2 / 10000, 4) as area_sobreposta_ha, round(m2 / pm * 100, 4) as percentual_car, ordem
    from (select *, row_number() over (partition by uc_id order by round(m2, 6) desc, area_total_ha, cod_imovel) as ordem
          from areas where m2 > 1.0) where ordem <= 20""",
)
def properties_in_polygons(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import locate

    drawn = roles.units_layer(spark, sf).select("uc_id", "geometry")
    found = locate.by_polygon(drawn, roles.properties(spark, sf), "uc_id")
    return found.select(
        "uc_id",
        "cod_imovel",
        F.round("area_sobreposta_ha", 4).alias("area_sobreposta_ha"),
        F.round("percentual_car", 4).alias("percentual_car"),
        "ordem",
    )


@query(
    "J6 G10",
    sql=f"""with {roles.PROPERTIES_SQL}, {roles.UNITS_SQL}
    select cod_imovel, uc_id from properties p join units l
      on p.x0 <= l.x1 and l.x0 <= p.x1 and p.y0 <= l.y1 and l.y0 <= p.y1""",
)
def plots_touching_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Contact without tolerance: shared edges and corners count."""
    props, feats, ps, fs = sides(spark, sf, roles.units_layer(spark, sf))
    met = spatial.shape_contacts(ps, fs)
    mine = props.select(F.col("shape").alias("a"), "cod_imovel")
    theirs = feats.select(F.col("shape").alias("b"), "uc_id")
    return mine.join(met, "a").join(theirs, "b").select("cod_imovel", "uc_id")


@query(
    "A11 J12 O4 F3 P20",
    sql=f"""with {roles.PROPERTIES_SQL}, m as (
      select municipio as nome, uf, codigo_municipio as codigo_ibge, min(x0) as xmin, min(y0) as ymin, max(x1) as xmax, max(y1) as ymax
      from properties group by all),
    terms as (select distinct upper(left(o_orderpriority, 0)) || substr(c_mktsegment, 1 + length(c_mktsegment) % 2, 4) as termo
      from customer, (select min(o_orderpriority) as o_orderpriority from orders)),
    hits as (select termo, m.*, case when starts_with(nome, termo) then 0 else 1 end as prioridade
      from terms join m on contains(nome, termo))
    select * from (select *, row_number() over (partition by termo order by prioridade, nome, uf, codigo_ibge) as ordem from hits)
    where ordem <= 10""",
)
def municipality_search(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import locate

    c = table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    terms = c.select(F.substr(seg, 1 + F.length(seg) % 2, F.lit(4)).alias("termo"))
    return locate.search_municipalities(terms, roles.properties(spark, sf), "termo")


@query(
    "P19",
    sql=f"""with {roles.PROPERTIES_SQL}, req as (
      select distinct case when municipio = 'BUILDING' then ' ' || lower(cod_imovel) when municipio = 'MACHINERY' then 'XX' || cod_imovel
        else cod_imovel end as pedido from properties)
    select pedido, case when pedido like 'XX%' then 0 else 1 end as quantidade,
      case when pedido like 'XX%' then 'NAO_ENCONTRADO' else 'ENCONTRADO' end as situacao from req""",
)
def lookup_by_code(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import locate

    p = roles.properties(spark, sf)
    code = F.col("cod_imovel")
    asked = p.select(
        F.when(F.col("municipio") == "BUILDING", F.concat(F.lit(" "), F.lower(code)))
        .when(F.col("municipio") == "MACHINERY", F.concat(F.lit("XX"), code))
        .otherwise(code)
        .alias("pedido")
    )
    return locate.by_code(asked, p, "pedido")


# Triangles and L-shapes from parts; oracles use exact planar areas.
def _shaped(spark: SparkSession, sf: str) -> DataFrame:
    u = roles.units_layer(spark, sf).withColumn("b", geo.bbox(F.col("geometry")))
    x0, y0, x1, y1 = (F.col(f"b.{k}") for k in ("xmin", "ymin", "xmax", "ymax"))
    xm, ym = (x0 + x1) / 2, (y0 + y1) / 2
    p = geo.point
    triangle = F.array(p(x0, y0), p(x1, y0), p(x0, y1), p(x0, y0))
    ell = F.array(p(x0, y0), p(x1, y0), p(x1, ym), p(xm, ym), p(xm, y1), p(x0, y1), p(x0, y0))
    bow = F.array(p(x0, y0), p(x1, y1), p(x1, y0), p(x0, y1), p(x0, y0))
    ring = (
        F.when(F.col("categoria_manejo") == "ECONOMY", triangle)
        .when(F.col("categoria_manejo") == "STANDARD", ell)
        .otherwise(bow)
    )
    return u.withColumn("geometry", geo.geometry(F.array(F.array(ring)))).drop("b")


_SHAPE_AREA = """case categoria_manejo when 'ECONOMY' then (x1 - x0) * (y1 - y0) / 2
  when 'STANDARD' then (x1 - x0) * (y1 - y0) * 3 / 4 else (x1 - x0) * (y1 - y0) / 2 end"""


@query(
    "G7 G8 G11",
    sql=f"""with {roles.UNITS_SQL}
    select uc_id, categoria_manejo in ('ECONOMY', 'STANDARD') as valida, {_SHAPE_AREA} as area from units""",
    bench=True,
)
def validity_and_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Bow-ties become two triangles, valid shapes stay."""
    from ..operators import topology

    fixed = topology.repaired(_shaped(spark, sf).select("uc_id", "geometry"), "uc_id")
    return fixed.select("uc_id", F.col("fault").isNull().alias("valida"), geo.planar_area(F.col("geometry")).alias("area"))


def _inset(x0, y0, x1, y1, left: float, low: float, right: float, high: float):
    """Ring of a box given in shares of another."""
    w, h = x1 - x0, y1 - y0
    return F.get(F.get(geo.box_geometry(x0 + w * left, y0 + h * low, x0 + w * right, y0 + h * high)["parts"], F.lit(0)), F.lit(0))


# Parts and rings in shares of the unit's box: what is valid, and parts, rings and share of the area after repair.
_PART_CLASSES = [
    ([[(0, 0, 1, 1), (0.25, 0.25, 0.75, 0.75)]], (True, 1, 2, 0.75)),
    ([[(0, 0, 1, 1)], [(2, 0, 3, 1)]], (True, 2, 2, 2)),
    ([[(0, 0, 1, 1)], [(0.25, 0.25, 0.75, 0.75)]], (False, 1, 1, 1)),
    ([[(0, 0, 1, 1)], [(0, 0, 1, 1)]], (False, 1, 1, 1)),
    ([[(0, 0, 1, 1), (2, 2, 3, 3)]], (False, 1, 1, 1)),
    ([[(0, 0, 1, 1), (0.25, 0.25, 0.75, 0.75)], [(0.375, 0.375, 0.625, 0.625)]], (True, 2, 3, 0.8125)),
    ([[(0, 0, 1, 1), (0.5, 0.25, 1.5, 0.5)]], (False, 1, 1, 0.875)),
    ([[(0, 0, 1, 1)], [(1, 0, 2, 1)]], (False, 1, 1, 2)),
    ([[(0, 0, 1, 1)], [(1, 1, 2, 2)]], (True, 2, 2, 2)),
    ([[(0, 0, 1, 1)], [(0.5, 0.5, 1.5, 1.5)]], (False, 1, 1, 1.75)),
]
_PART_VALUES = ", ".join(f"({k}, {v}, {p}, {r}, {a}::double)" for k, (_, (v, p, r, a)) in enumerate(_PART_CLASSES))


def _of_parts(spark: SparkSession, sf: str, classes: list) -> DataFrame:
    """Units whose box is replaced by the class of shape that their number names."""
    u = roles.units_layer(spark, sf).withColumn("b", geo.bbox(F.col("geometry")))
    box = [F.col(f"b.{k}") for k in ("xmin", "ymin", "xmax", "ymax")]
    kinds = [geo.geometry(F.array(*[F.array(*[_inset(*box, *r) for r in part]) for part in parts])) for parts, *_ in classes]
    chosen = F.coalesce(*[F.when(F.col("uc_id") % len(classes) == k, g) for k, g in enumerate(kinds)])
    return materialize(u.select("uc_id", chosen.alias("geometry")), "parts")


@query(
    "G7 G8 G5",
    sql=f"""with {roles.UNITS_SQL}, c(k, valida, partes, aneis, share) as (values {_PART_VALUES})
    select uc_id, valida, partes, aneis, (x1 - x0) * (y1 - y0) * share as area from units join c on uc_id % {len(_PART_CLASSES)} = k""",
)
def validity_of_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Holes, nested, equal and touching parts: judged, and repaired to what they cover."""
    from ..operators import topology

    fixed, g = topology.repaired(_of_parts(spark, sf, _PART_CLASSES), "uc_id"), F.col("geometry")
    return fixed.select(
        "uc_id", F.col("fault").isNull().alias("valida"), F.size(g["parts"]).alias("partes"),
        F.size(geo.rings(g)).alias("aneis"), geo.planar_area(g).alias("area"),
    )


# A hole, a second part, and a repeated part; their boxes as SQL.
_JOINED_CLASSES = [([[(0, 0, 1, 1), (0.25, 0.25, 0.75, 0.75)]],), ([[(0, 0, 1, 1)], [(2, 0, 3, 1)]],), ([[(0, 0, 1, 1)], [(0, 0, 1, 1)]],)]
_JOINED_SQL = f"""{roles.UNITS_SQL}, boxed as (
  select uc_id, uc_id % 3 as k, x0 as sx0, y0 as sy0, x1 as sx1, y1 as sy1,
    case uc_id % 3 when 0 then x0 + (x1 - x0) * 0.25::double when 1 then x0 + (x1 - x0) * 2 end as tx0,
    case uc_id % 3 when 0 then x0 + (x1 - x0) * 0.75::double when 1 then x0 + (x1 - x0) * 3 end as tx1,
    case uc_id % 3 when 0 then y0 + (y1 - y0) * 0.25::double when 1 then y0 end as ty0,
    case uc_id % 3 when 0 then y0 + (y1 - y0) * 0.75::double when 1 then y1 end as ty1 from units)"""
_TOUCH = "p.x0 <= {0}x1 and {0}x0 <= p.x1 and p.y0 <= {0}y1 and {0}y0 <= p.y1"


@query(
    "G10 J4 J6",
    sql=f"""with {roles.PROPERTIES_SQL}, {_JOINED_SQL}
    select cod_imovel, uc_id from properties p join boxed on ({_TOUCH.format("s")}
        and not (k = 0 and p.x0 > tx0 and p.x1 < tx1 and p.y0 > ty0 and p.y1 < ty1)) or (k = 1 and {_TOUCH.format("t")})""",
)
def contacts_of_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Properties that touch any part of a unit; one within a hole does not."""
    props, feats, ps, fs = sides(spark, sf, _of_parts(spark, sf, _JOINED_CLASSES))
    met = spatial.shape_contacts(ps, fs)
    mine = props.select(F.col("shape").alias("a"), "cod_imovel")
    return mine.join(met, "a").join(feats.select(F.col("shape").alias("b"), "uc_id"), "b").select("cod_imovel", "uc_id")


def _common_m2(box: str) -> str:
    x0, y0, x1, y1 = f"greatest(p.x0, {box}x0)", f"greatest(p.y0, {box}y0)", f"least(p.x1, {box}x1)", f"least(p.y1, {box}y1)"
    return f"case when {x0} < {x1} and {y0} < {y1} then {box_m2(x0, y0, x1, y1)} else 0 end"


@query(
    "G10 G11 G15 J1",
    sql=f"""with {roles.PROPERTIES_SQL}, {_JOINED_SQL}, areas as (
      select cod_imovel, uc_id, {_common_m2("s")} + case k when 0 then -({_common_m2("t")}) when 1 then {_common_m2("t")} else 0 end as m2,
        {box_m2("sx0", "sy0", "sx1", "sy1")} + case k when 0 then -({box_m2("tx0", "ty0", "tx1", "ty1")}) when 1 then {box_m2("tx0", "ty0", "tx1", "ty1")} else 0 end as whole
      from properties p join boxed on ({_TOUCH.format("s")}) or (k = 1 and {_TOUCH.format("t")}))
    select cod_imovel, uc_id, round(m2 / 10000, 3) as area_sobreposta_ha, round(m2 / whole * 100, 4) as percentual_fonte from areas where m2 > 1.0""",
)
def overlaps_of_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Shared area with units of several rings: holes subtract, a repeated part counts once."""
    props, feats, ps, fs = sides(spark, sf, _of_parts(spark, sf, _JOINED_CLASSES))
    whole = spatial.shape_areas(fs).withColumnRenamed("shape", "b")
    rows = (
        props.select(F.col("shape").alias("a"), "cod_imovel").join(spatial.shape_overlaps(ps, fs), "a").join(whole, "b")
        .join(feats.select(F.col("shape").alias("b"), "uc_id"), "b")
    )
    return rows.select(
        "cod_imovel", "uc_id", F.round(F.col("area_m2") / 10000, 3).alias("area_sobreposta_ha"),
        F.round(spatial.percent(F.col("area_m2"), F.col("m2")), 4).alias("percentual_fonte"),
    )


@query(
    "G12 J3",
    sql=f"""with {_JOINED_SQL}, pts as (
      select event_id, -72.0::double + (event_id * 37 % 1024) / 32 as x, -32.0::double + (event_id * 91 % 1021) / 32 as y from events)
    select event_id, uc_id from pts join boxed on (x between sx0 and sx1 and y between sy0 and sy1
        and not (k = 0 and x > tx0 and x < tx1 and y > ty0 and y < ty1)) or (k = 1 and x between tx0 and tx1 and y between ty0 and ty1)""",
)
def points_in_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Units that hold a point in any part and in none of its holes."""
    feats = spatial.with_shape(_of_parts(spark, sf, _JOINED_CLASSES))
    side = spatial.distinct_shapes(feats).withColumn("bbox", geo.bbox(F.col("geometry")))
    hits = spatial.points_in_shapes(_point_table(spark, sf), materialize(side.select("shape", "geometry", "bbox"), "outlines"), "event_id")
    return hits.join(feats.select("shape", "uc_id"), "shape").select("event_id", "uc_id")


@query(
    "A1 A2",
    sql=f"""with {roles.UNITS_SQL}
    select count(*) as total, 0 as nulas, 0 as vazias,
      count(*) filter (categoria_manejo not in ('ECONOMY', 'STANDARD')) as invalidas,
      count(*) filter (categoria_manejo not in ('ECONOMY', 'STANDARD')) as reparaveis
    from units""",
)
def geometry_profile(spark: SparkSession, sf: str) -> DataFrame:
    """A bow-tie is invalid and is repaired to two triangles."""
    from ..operators import quality

    return quality.geometry_profile(_shaped(spark, sf), "geometry")


@query(
    "A2 O6",
    sql=f"""with {roles.UNITS_SQL}
    select uc_id, 'autointerseção' as motivo from units where categoria_manejo not in ('ECONOMY', 'STANDARD')
    order by uc_id limit 50""",
)
def invalid_geometry_samples(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import quality

    return quality.geometry_samples(_shaped(spark, sf), "uc_id", "geometry")


@query(
    "G11",
    sql=f"""with {roles.UNITS_SQL}, u as (
      select uc_id, (x1 - x0) as w, (y1 - y0) as h from units),
    c as (select uc_id, w, h, categoria_manejo from units join u using (uc_id))
    select uc_id,
      case categoria_manejo when 'ECONOMY' then w * h * 3 / 8 when 'STANDARD' then w * h / 2 else w * h / 4 end as inter,
      case categoria_manejo when 'ECONOMY' then w * h / 8 else w * h / 4 end as diff,
      case categoria_manejo when 'ECONOMY' then w * h * 5 / 8 else w * h * 3 / 4 end as uni
    from c""",
)
def overlay_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Triangles, L-shapes and repaired bow-ties against the left half of their box."""
    s = _shaped(spark, sf).withColumn("geometry", overlay.made_valid(F.col("geometry")))
    b = F.col("b")
    half = geo.box_geometry(b["xmin"], b["ymin"], (b["xmin"] + b["xmax"]) / 2, b["ymax"])
    s = s.withColumn("b", geo.bbox(F.col("geometry"))).withColumn("half", half)
    s = s.withColumns({"ra": overlay.rises(F.col("geometry")), "rb": overlay.rises(F.col("half"))})
    ra, rb = F.col("ra"), F.col("rb")
    return s.select(
        "uc_id",
        geo.planar_area(overlay.intersection(ra, rb)).alias("inter"),
        geo.planar_area(overlay.difference(ra, rb)).alias("diff"),
        geo.planar_area(overlay.union(F.concat(ra, rb))).alias("uni"),
    )
