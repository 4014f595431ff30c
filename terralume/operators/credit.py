"""Credit operations and plots: enrichment, source merge, state check, assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as geo, overlay, text as tx

# Vertices of a plot given by points.
MIN_POINTS, MAX_POINTS = 4, 100
OPERATION_KEY = ("ref_bacen", "nu_ordem", "ano")


def latest_operations(operations: DataFrame) -> DataFrame:
    """Last line per operation and year; lines without number come first.

    max_by aggregates map-side, so a hot operation is reduced before the shuffle.
    """
    rest = [c for c in operations.columns if c not in OPERATION_KEY]
    order = F.coalesce("_numero_linha", F.lit(-1))
    best = F.max_by(F.struct(*rest), order).alias("_o")
    return operations.groupBy(*OPERATION_KEY).agg(best).select(*OPERATION_KEY, "_o.*")


def with_operations(plots: DataFrame, operations: DataFrame) -> DataFrame:
    """Plots with the data of their operation; a plot without one stays."""
    return plots.join(latest_operations(operations), list(OPERATION_KEY), "left")


def with_names(rows: DataFrame, institutions: DataFrame, programmes: DataFrame) -> DataFrame:
    """Institution and programme names, falling back to their codes.

    The domains are published code lists; Catalyst broadcasts them while they
    are small and shuffles otherwise, so no hint is given.
    """
    i = institutions.select("cnpj_if", F.col("nome_if").alias("_nome"), "segmento_if")
    p = programmes.select("cd_programa", F.col("descricao").alias("_programa"))
    named = rows.join(i, "cnpj_if", "left").join(p, "cd_programa", "left")
    return named.withColumns(
        {
            "nome_instituicao": tx.first_filled(F.col("_nome"), F.col("cnpj_if")),
            "nome_programa": tx.first_filled(F.col("_programa"), F.col("cd_programa")),
        }
    ).drop("_nome", "_programa")


def merge_plot_sources(
    wkt: DataFrame, points: DataFrame, fields: Sequence[str], owner: str = "cod_imovel"
) -> DataFrame:
    """One plot list from the yearly WKT product and the yearless points snapshot.

    A point plot joins a WKT plot when operation and index name exactly one
    year; otherwise it stays on its own. Within a plot WKT values win and
    points fill what is empty. Plots without operation key are never merged.
    """
    clean = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    keys = {"_ref": F.upper(clean("ref_bacen")), "_ord": clean("nu_ordem"), "_idx": clean("indice")}
    spot = [owner, "_ref", "_ord", "_idx"]

    w = wkt.withColumns(keys).withColumns({"_rank": F.lit(0), "_year": clean("ano")})
    years = (
        w.where("_ref <> '' and _ord <> '' and _idx <> ''")
        .groupBy(*spot)
        .agg(F.min("_year").alias("_y0"), F.max("_year").alias("_y1"))
    )
    only = years.where("_y0 = _y1").select(*spot, F.col("_y0").alias("_year"))
    p = points.withColumns(keys).withColumn("_rank", F.lit(1)).join(only, spot, "left")
    p = p.withColumn("_year", F.coalesce("_year", F.lit("")))

    both = w.unionByName(p, allowMissingColumns=True)
    keyed = (F.col("_ref") != "") & (F.col("_ord") != "")
    plot = F.when(
        keyed,
        F.concat_ws(
            ":", "_ref", "_ord", "_year", F.when(F.col("_idx") == "", "SEM_INDICE").otherwise(F.col("_idx"))
        ),
    ).otherwise(F.concat(F.lit("?"), F.col("_rank").cast("string"), F.lit(":"), F.col("id").cast("string")))
    order = F.struct("_rank", "id")
    chosen = [
        F.min_by(F.col(f), F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", order)).alias(f)
        for f in fields
    ]
    source = F.when(F.min("_rank") == 0, "WKT").otherwise("COORDENADAS")
    return (
        both.withColumn("plot", plot)
        .groupBy(owner, "plot")
        .agg(*chosen, source.alias("origem"), F.count(F.lit(1)).alias("registros"))
    )


def check_state(rows: DataFrame, property_uf: Column, operation_uf: Column) -> DataFrame:
    """Drop plots whose operation is in another state; mark equal ones."""
    mine, theirs = (F.upper(F.trim(F.coalesce(c, F.lit("")))) for c in (property_uf, operation_uf))
    known = (mine != "") & (theirs != "")
    return rows.where(~known | (mine == theirs)).withColumn(
        "validacao_uf", F.when(known, "VALIDADA").otherwise("SEM_VALIDACAO")
    )


def single_source_area(merged: DataFrame, owner: str, wkt_area: Column, point_area: Column) -> DataFrame:
    """Union area per owner, only when all its plots come from one source."""
    return merged.groupBy(owner).agg(
        F.when(F.min("origem") != F.max("origem"), F.lit(None))
        .when(F.min("origem") == "WKT", F.max(wkt_area))
        .otherwise(F.max(point_area))
        .alias("area_unica_sobreposta_ha"),
        F.array_sort(F.collect_set("origem")).alias("fontes"),
    )


def assemble_plots(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Polygons from numbered points: 4 to 100, contiguous, distinct, closed.

    Counts and extremes are partial aggregates. Only plots that pass them get
    their vertices gathered, so the gathered arrays never exceed MAX_POINTS,
    however many points a broken key carries.
    """
    stats = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("qtd_pontos"),
        F.count_distinct("indice").alias("qtd_indices"),
        F.min("indice").alias("indice_min"),
        F.max("indice").alias("indice_max"),
        F.min("altitude").alias("altitude_min"),
        F.max("altitude").alias("altitude_max"),
    )
    n = F.col("qtd_pontos")
    numbered = (
        n.between(MIN_POINTS, MAX_POINTS)
        & (F.col("qtd_indices") == n)
        & (F.col("indice_max") - F.col("indice_min") + 1 == n)
    )
    sound = stats.where(numbered).select(*keys)
    vertex = F.struct("indice", geo.point(F.col("lon"), F.col("lat")).alias("p"))
    rings = (
        points.join(sound, list(keys), "left_semi")
        .groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(vertex)), lambda v: v["p"]).alias("ring"))
        .where(geo.ring_closed(F.col("ring")))
    )
    shaped = rings.select(*keys, geo.geometry(F.array(F.array("ring"))).alias("original"))
    shaped = shaped.withColumn("geometry", overlay.made_valid(F.col("original")))
    joined = stats.join(shaped, list(keys), "left")
    return joined.withColumns(
        {
            "estrutura_pendente": F.col("original").isNull(),
            "area_ha_calculada": F.round(geo.area_m2(F.col("geometry")) / 10000, 6),
        }
    )


def assemble_rings(points: DataFrame, key: str, polygon: str, order: Column) -> DataFrame:
    """Multi-polygons per key from coordinate rows: ordered, closed, three points or more.

    Vertices are gathered per polygon, polygons per key.
    """
    vertex = F.struct(order.alias("o"), geo.point(F.col("lon"), F.col("lat")).alias("p"))
    in_world = F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)
    gathered = (
        points.where(in_world)
        .groupBy(key, polygon)
        .agg(F.transform(F.array_sort(F.collect_list(vertex)), lambda v: v["p"]).alias("path"))
        .where(F.size("path") >= 3)
    )
    path = F.col("path")
    ring = F.when(geo.ring_closed(path), path).otherwise(
        F.concat(path, F.slice(path, F.lit(1), F.lit(1)))
    )
    rings = gathered.select(key, polygon, geo.geometry(F.array(F.array(ring))).alias("g"))
    fixed = rings.withColumn("g", overlay.made_valid(F.col("g"))).where("g is not null")
    parts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(polygon, "g"))), lambda s: s["g"]["parts"]))
    return fixed.groupBy(key).agg(geo.geometry(parts).alias("geometry"))


def with_fallbacks(terms: DataFrame, key: str, *sources: DataFrame) -> DataFrame:
    """Geometry of a term, else the first fallback source that has one."""
    out = terms
    columns = [F.col("geometry")]
    for i, source in enumerate(sources):
        out = out.join(source.select(key, F.col("geometry").alias(f"_g{i}")), key, "left")
        columns.append(F.col(f"_g{i}"))
    used = F.when(columns[0].isNotNull(), "WKT")
    for label, column in zip(("COORDENADAS", "API"), columns[1:]):
        used = used.when(column.isNotNull(), label)
    out = out.withColumns({"origem_geometria": used, "geometry": F.coalesce(*columns)})
    return out.drop(*[f"_g{i}" for i in range(len(sources))])


def recent_first(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank per key: newest year first, then operation and order."""
    w = Window.partitionBy(*keys).orderBy(F.col("ano").desc_nulls_last(), "ref_bacen", "nu_ordem", "id")
    return rows.withColumn("ordem", F.row_number().over(w))
