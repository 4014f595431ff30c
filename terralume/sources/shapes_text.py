"""Geometry and resource lists from text documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as geo, text as tx
from ..operators import spatial, topology

# Keys searched first in a JSON answer, accepted resource formats, limits.
WKT_KEYS = (
    "wkt", "geom", "geometry", "geometria", "geom_area_embargada", "resultado", "result", "data",
)
WKT_TEXT = r"(?is)\b((?:MULTIPOLYGON|POLYGON|GEOMETRYCOLLECTION)\s*(?:ZM|Z|M)?\s*\([^\"]+)"
RESOURCE_FORMATS = ("csv", "zip", "shp_zip")
MAX_PLACEMARK_POLYGONS = 100


def wkt_in_json(document: Column) -> Column:
    """First WKT under the preferred keys, else anywhere in the text; '' when none."""
    preferred = [
        F.nullif(F.regexp_extract(F.get_json_object(document, f"$.{k}"), WKT_TEXT, 1), F.lit(""))
        for k in WKT_KEYS
    ]
    anywhere = F.nullif(F.regexp_extract(document, WKT_TEXT, 1), F.lit(""))
    found = F.coalesce(*preferred, anywhere, F.lit(""))
    return F.trim(found, F.lit("\" \n\r\t}]"))


def read_wkt(df: DataFrame, column: str, srid: int = 4674) -> DataFrame:
    """Add `geometry` (valid multi-polygon or NULL) and `motivo` for rows without one."""
    parsed = df.withColumn("_m", geo.wkt_members(F.col(column)))
    parsed = parsed.withColumn("_g", F.when(F.col("_m").isNotNull(), geo.geometry(F.flatten("_m"), srid=srid)))
    # What members of a collection share counts once, as with the parts of any shape.
    fixed = spatial.with_valid_geometry(parsed.drop("_m").withColumn("geometry", F.col("_g")))
    empty = F.trim(F.coalesce(column, F.lit(""))) == ""
    reason = (
        F.when(empty, "WKT vazio")
        .when(F.col("_g").isNull(), "WKT inválido")
        .when(F.col("geometry").isNull(), "Geometria vazia")
        .when(~geo.in_world(F.col("geometry")), "Coordenadas fora dos limites")
    )
    judged = fixed.withColumn("motivo", reason)
    return judged.withColumn("geometry", F.when(F.col("motivo").isNull(), F.col("geometry"))).drop("_g")


_RINGS = r"(?is)<(?:\w+:)?coordinates[^>]*>(.*?)</(?:\w+:)?coordinates>"


def _tagged(xml: Column, tag: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"(?is)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}>"), F.lit(1))


def kml_polygons(xml: Column) -> Column:
    """All polygons of a KML text as parts; the first ring is the outer one."""
    part = lambda p: F.transform(
        F.regexp_extract_all(p, F.lit(_RINGS), F.lit(1)), geo.kml_ring
    )
    return F.transform(_tagged(xml, "Polygon"), lambda p: part(p))


def kml_unions(documents: DataFrame, key: str, xml: str) -> DataFrame:
    """``key``, ``geometry``: the union of all polygons of each KML text, without inner borders.

    Polygons of a document meet edge by edge over many rows. Documents without area are missing.
    """
    shapes = documents.select(key, geo.geometry(kml_polygons(F.col(xml))).alias("geometry"))
    return topology.dissolved(shapes, key)


def kml_plots(documents: DataFrame, key: str, xml: str) -> DataFrame:
    """One row per polygon and placemark, named after the placemark.

    The second polygon of a placemark is `name 2` and so on. Documents with
    more polygons than allowed are marked instead of cut.
    """
    marks = documents.select(key, F.posexplode(_tagged(F.col(xml), "Placemark")).alias("_i", "_m"))
    fallback = F.concat(F.lit("Gleba "), (F.col("_i") + 1).cast("string"))
    base = tx.short_name(F.regexp_extract("_m", r"(?is)<(?:\w+:)?name[^>]*>(.*?)</", 1), fallback)
    plots = marks.select(key, "_i", base.alias("_n"), F.posexplode(kml_polygons(F.col("_m"))).alias("_j", "part"))
    name = F.when(F.col("_j") == 0, F.col("_n")).otherwise(
        F.concat_ws(" ", "_n", (F.col("_j") + 1).cast("string"))
    )
    counted = F.count(F.lit(1)).over(Window.partitionBy(key))
    return plots.select(
        key,
        F.col("_i").alias("placemark"),
        F.col("_j").alias("poligono"),
        name.alias("nome"),
        geo.geometry(F.array("part")).alias("geometry"),
        (counted > MAX_PLACEMARK_POLYGONS).alias("excedido"),
    )


def vertex_rows(df: DataFrame, columns: Sequence[str], geometry: str = "geometry") -> DataFrame:
    """One row per polygon, ring and vertex, numbers with decimal comma."""
    g = F.col(geometry)
    number = lambda c, d: F.replace(F.format_string(f"%.{d}f", c), F.lit("."), F.lit(","))
    measured = df.withColumn("_a", geo.area_m2(g))
    parts = measured.select(*columns, "_a", F.posexplode(g["parts"]).alias("_p", "_part"))
    rings = parts.select(*columns, "_a", "_p", F.posexplode("_part").alias("_r", "_ring"))
    rows = rings.select(*columns, "_a", "_p", "_r", F.posexplode("_ring").alias("_v", "_xy"))
    return rows.select(
        *columns,
        number(F.col("_a") / 10000, 4).alias("area_ha"),
        (F.col("_p") + 1).alias("poligono"),
        (F.col("_r") + 1).alias("anel"),
        (F.col("_v") + 1).alias("vertice"),
        number(F.col("_xy.x"), 8).alias("longitude"),
        number(F.col("_xy.y"), 8).alias("latitude"),
    )


def write_vertices(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", ";").option("quoteAll", True).option("header", True).csv(path)


def placemark(name: Column, attributes: dict[str, Column], geometry: Column) -> Column:
    """KML placemark text with extended data; NULL attributes are left out."""
    escape = lambda c: F.replace(
        F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")
    )
    data = [
        F.coalesce(
            F.concat(F.lit(f'<Data name="{k}"><value>'), escape(v.cast("string")), F.lit("</value></Data>")),
            F.lit(""),
        )
        for k, v in attributes.items()
    ]
    return F.concat(
        F.lit("<Placemark><name>"), escape(name), F.lit("</name><ExtendedData>"), *data,
        F.lit("</ExtendedData>"), geo.to_kml(geometry), F.lit("</Placemark>"),
    )


def resource_candidates(catalogues: DataFrame, document: str, wanted: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """Download addresses per resource key: catalogue first, then override, then known ones.

    `wanted` maps a normalised name to a key; `fallbacks` has key, url and
    origem 1 or 2. Each address is kept once, at its best place.
    """
    schema = "result struct<resources:array<struct<name:string,description:string,format:string,url:string>>>"
    parsed = catalogues.select(F.from_json(document, schema)["result"]["resources"].alias("rs"))
    listed = parsed.select(F.posexplode("rs").alias("pos", "r")).select(
        tx.normal_name(F.coalesce(F.nullif("r.name", F.lit("")), F.col("r.description"))).alias("nome"),
        tx.normal_name(F.col("r.format")).alias("formato"),
        F.trim("r.url").alias("url"),
        "pos",
    )
    usable = (
        (F.col("url") != "")
        & (F.col("formato").isin("", *RESOURCE_FORMATS) | F.lower("url").rlike(r"\.(csv|zip)$"))
    )
    found = listed.where(usable).join(wanted, "nome").select("chave", "url", F.lit(0).alias("origem"), "pos")
    both = found.unionByName(fallbacks.select("chave", "url", "origem", "pos"))
    once = both.groupBy("chave", "url").agg(F.min(F.struct("origem", "pos")).alias("o"))
    order = Window.partitionBy("chave").orderBy("o", "url")
    return once.select("chave", "url", F.row_number().over(order).alias("ordem"), F.col("o.origem").alias("origem"))


def folder_manifest(files: DataFrame, folder: Column) -> DataFrame:
    """Hash per folder over its sorted paths and content hashes.

    Entries are folded per hash prefix of the path first, so a folder with very
    many files is not gathered at once; the last step sorts one digest per
    prefix.
    """
    size = F.octet_length("content").cast("long").alias("size")
    hashed = files.select(folder.alias("pasta"), "path", F.sha2("content", 256).alias("h"), size)
    entry = F.concat_ws(":", "path", "h")
    folded = hashed.groupBy("pasta", F.substring(F.md5("path"), 1, 3).alias("p")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("d"),
        F.count(F.lit(1)).alias("n"),
        F.sum("size").alias("size"),
    )
    digests = F.array_sort(F.collect_list(F.concat_ws(":", "p", "d")))
    return folded.groupBy("pasta").agg(
        F.sum("n").alias("arquivos"),
        F.sum("size").alias("bytes"),
        F.sha2(F.array_join(digests, "\n"), 256).alias("manifesto"),
    )


def content_hash(content: Column, name: Column) -> Column:
    """SHA-256 of a component; the date bytes 2-4 of a DBF header are blanked."""
    blanked = F.overlay(content, F.unhex(F.lit("000000")), F.lit(2), F.lit(3))
    return F.sha2(F.when(F.lower(name).endswith(".dbf"), blanked).otherwise(content), 256)
