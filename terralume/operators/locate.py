"""Lookups of properties by point, view box, drawn polygon, municipality or code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as geo, text as tx
from ..session import materialize
from . import spatial
from .confront import Indexed

# List sizes, zoom range of the view, extent allowed at zoom 12.
PLACE_LIMIT = 20
VIEW_LIMIT = 750
MUNICIPALITY_LIMIT = 10
ZOOM_RANGE = (12, 19)


def top_per(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """First rows per key and the flag that more existed.

    One row beyond the limit is ranked, so the flag needs no count of the whole
    group and Spark drops the rest before the shuffle.
    """
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("ordem", F.row_number().over(w.orderBy(*order))).where(
        F.col("ordem") <= limit + 1
    )
    flagged = ranked.withColumn("truncada", F.max("ordem").over(w) > limit)
    return flagged.where(F.col("ordem") <= limit)


def by_point(
    points: DataFrame, properties: DataFrame, point_key: str, limit: int = PLACE_LIMIT
) -> DataFrame:
    """Properties that contain a point, smallest first."""
    features = spatial.with_shape(properties)
    # Only outlines are needed: no runs, and no repair.
    shapes = spatial.distinct_shapes(features).withColumn("bbox", geo.bbox(F.col("geometry")))
    shapes = materialize(shapes.select("shape", "geometry", "bbox"), "outlines")
    hits = spatial.points_in_shapes(points, shapes, point_key)
    attributes = features.select("shape", "cod_imovel", "area_total_ha", "uf", "municipio")
    order = [F.col("area_total_ha").asc_nulls_last(), F.col("cod_imovel")]
    return top_per(hits.join(attributes, "shape"), [point_key], order, limit).drop("shape")


def valid_position(lat: Column, lon: Column) -> Column:
    """In range, finite and not the null island."""
    finite = ~F.isnan(lat) & ~F.isnan(lon)
    near_zero = (F.abs(lat) < 1e-12) & (F.abs(lon) < 1e-12)
    return F.coalesce(
        lat.between(-90, 90) & lon.between(-180, 180) & finite & ~near_zero, F.lit(False)
    )


def valid_view(zoom: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Zoom in range, bounds ordered and in the world, extent within the zoom's share."""
    allowed = 360.0 * 12 / F.pow(F.lit(2.0), zoom)
    ordered = (west < east) & (south < north)
    world = west.between(-180, 180) & east.between(-180, 180)
    world = world & south.between(-90, 90) & north.between(-90, 90)
    narrow = (east - west <= allowed) & (north - south <= allowed)
    return F.coalesce(zoom.between(*ZOOM_RANGE) & ordered & world & narrow, F.lit(False))


def by_view(
    views: DataFrame, properties: DataFrame, view_key: str, limit: int = VIEW_LIMIT
) -> DataFrame:
    """Properties touching each view box (west, south, east, north), by code."""
    box = geo.box_geometry(*[F.col(c) for c in ("west", "south", "east", "north")])
    asked, known = Indexed.of(views.withColumn("geometry", box)), Indexed.of(properties)
    columns = [c for c in known.features.columns if c != "shape"]
    rows = spatial.member_contacts(asked.features, known.features, asked.shapes, known.shapes, [view_key, "excluded"], columns).where(
        F.coalesce("excluded", F.lit("")).isin("")
        | (F.upper(F.trim("cod_imovel")) != F.upper(F.trim("excluded")))
    )
    return top_per(rows, [view_key], [F.col("cod_imovel")], limit)


def by_polygon(
    drawn: DataFrame, properties: DataFrame, drawn_key: str, limit: int = PLACE_LIMIT
) -> DataFrame:
    """Properties with real overlap of each drawn polygon, largest overlap first."""
    asked, known = Indexed.of(drawn), Indexed.of(properties)
    met = spatial.shape_overlaps(asked.shapes, known.shapes)
    areas = spatial.shape_areas(known.shapes).withColumnRenamed("shape", "b")
    p = known.features
    rows = (
        asked.features.select(drawn_key, F.col("shape").alias("a"))
        .join(met, "a")
        .join(areas, "b")
        .join(p.select(F.col("shape").alias("b"), "cod_imovel", "area_total_ha", "uf", "municipio"), "b")
    )
    order = [
        F.round("area_m2", 6).desc(),
        F.col("area_total_ha").asc_nulls_last(),
        F.col("cod_imovel"),
    ]
    return top_per(rows, [drawn_key], order, limit).select(
        drawn_key, "cod_imovel", "area_total_ha", "uf", "municipio", "ordem", "truncada",
        (F.col("area_m2") / 10000).alias("area_sobreposta_ha"),
        spatial.percent(F.col("area_m2"), F.col("m2")).alias("percentual_car"),
    )


def municipalities(properties: DataFrame) -> DataFrame:
    """One row per municipality, state and code with its extent."""
    box = geo.bbox(F.col("geometry"))
    named = properties.where(F.trim(F.coalesce("municipio", F.lit(""))) != "").select(
        F.trim("municipio").alias("nome"),
        F.upper(F.trim("uf")).alias("uf"),
        F.coalesce(F.trim("codigo_municipio"), F.lit("")).alias("codigo_ibge"),
        box.alias("b"),
    )
    return named.groupBy("nome", "uf", "codigo_ibge").agg(
        F.min("b.xmin").alias("xmin"),
        F.min("b.ymin").alias("ymin"),
        F.max("b.xmax").alias("xmax"),
        F.max("b.ymax").alias("ymax"),
    )


def search_municipalities(
    terms: DataFrame, properties: DataFrame, term: str, limit: int = MUNICIPALITY_LIMIT
) -> DataFrame:
    """Municipalities whose folded name contains a folded term, prefix hits first.

    `terms` are what users typed; they meet the distinct municipality list, not
    the properties, through the three-letter pieces both share.
    """
    folded = tx.municipality_fold(F.col(term))
    asked = terms.select(F.col(term), tx.fold_upper(F.col(term)).alias("t"))
    asked = asked.distinct().where(F.length("t") >= 2)
    grams = lambda c: F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2))
        )
    )
    places = municipalities(properties).withColumn("n", tx.municipality_fold(F.col("nome")))
    by_gram = places.withColumn("g", F.explode(grams(F.col("n"))))
    probe = asked.withColumn("g", F.substring("t", 1, 2))
    hits = probe.join(by_gram, "g").where(F.col("n").contains(F.col("t")))
    hits = hits.withColumn("prioridade", F.when(F.col("n").startswith(F.col("t")), 0).otherwise(1))
    order = [F.col("prioridade"), F.col("nome"), F.col("uf"), F.col("codigo_ibge")]
    return top_per(hits, [term], order, limit).drop("g", "t", "n", "truncada")


def by_code(requests: DataFrame, properties: DataFrame, code: str) -> DataFrame:
    """Exact code match, else trimmed upper-case match; status per request.

    0 rows is not found, more than one is a duplicate. The second join only sees
    requests the first left over.
    """
    req = requests.select(F.col(code).alias("pedido")).distinct()
    exact = properties.groupBy("cod_imovel").agg(F.count(F.lit(1)).alias("n"))
    first = req.join(exact, req.pedido == exact.cod_imovel, "left").drop("cod_imovel")
    loose = properties.groupBy(F.upper(F.trim("cod_imovel")).alias("k")).agg(
        F.count(F.lit(1)).alias("m")
    )
    missing = first.where("n is null").select("pedido", F.upper(F.trim("pedido")).alias("k"))
    second = missing.join(loose, "k", "left").select("pedido", F.col("m").alias("n"))
    found = first.where("n is not null").select("pedido", "n").unionByName(second)
    return found.select(
        "pedido",
        F.coalesce("n", F.lit(0)).alias("quantidade"),
        F.when(F.coalesce("n", F.lit(0)) == 0, "NAO_ENCONTRADO")
        .when(F.col("n") > 1, "DUPLICADO")
        .otherwise("ENCONTRADO")
        .alias("situacao"),
    )


def unit_geometry(units: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Full geometry of a unit by identifier, only when exactly one matches."""
    ident = F.trim(F.col(key).cast("string"))
    one = (
        units.where(F.col("geometry").isNotNull())
        .groupBy(ident.alias("identificador"))
        .agg(F.count(F.lit(1)).alias("n"), F.first("geometry").alias("geometry"))
        .where("n = 1")
    )
    asked = requests.select(F.trim("identificador").alias("identificador")).distinct()
    return asked.join(one.drop("n"), "identificador")
