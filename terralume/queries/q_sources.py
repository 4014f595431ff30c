"""Text sources and exports: files written from the driver tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry as geo, text as tx
from ..session import shared_folder
from ..sources import delimited, records, shapes_text
from . import roles
from .q_spatial import box_m2
from .registry import query, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "S1 S2 S4 S5 S7 S8 P3 P22 S3",
    sql="""select o_orderkey::varchar as ref_bacen, o_orderstatus as cd_estado, case when o_orderstatus = 'F' then '' else o_orderpriority end as obs,
      2000 + 15 as ano, case when o_orderstatus = 'P' then 'x;y' end as excesso from orders""",
)
def read_delimited_files(spark: SparkSession, sf: str) -> DataFrame:
    """Gzip text with `;`: short rows are padded, surplus fields reported."""
    o = table(spark, sf, "orders")
    line = F.concat_ws(";", F.col("o_orderkey").cast("string"), "o_orderstatus")
    line = F.when(F.col("o_orderstatus") == "F", line).otherwise(F.concat_ws(";", line, "o_orderpriority"))
    line = F.when(F.col("o_orderstatus") == "P", F.concat(line, F.lit(";x;y"))).otherwise(line)
    folder = _folder(spark, "csv")
    # One file per task: a header line first, then the rows of the task.
    rows = o.select(line.alias("value")).repartition(4).mapInPandas(_with_header, "value string")
    rows.write.option("compression", "gzip").text(f"{folder}/SICOR_2015")
    path = f"{folder}/SICOR_2015"
    fmt = delimited.detect_format(delimited.read_head(spark, path), ["ref_bacen", "cd_estado"])
    read = delimited.read_delimited(spark, path, fmt)
    year = delimited.year_of_name(F.element_at(F.split(F.lit(path), "/"), -1))
    return read.select("ref_bacen", "cd_estado", "obs", year.alias("ano"), F.col("_excesso").alias("excesso"))


def _with_header(batches):
    import pandas as pd

    first = True
    for batch in batches:
        if first:
            yield pd.DataFrame({"value": ["#REF_BACEN;CD_ESTADO;Obs."]})
            first = False
        yield batch


@query(
    "S7",
    sql="""select o_orderkey, array_to_string(list_resize(string_split(t, ';'), greatest(4, len(string_split(t, ';')))::bigint, ''), '|') as campos, len(string_split(t, ';')) > 4 as excesso
      from (select o_orderkey, o_orderstatus || ';' || case o_orderstatus when 'F' then o_custkey::varchar when 'O' then 'a;b;c;d' else ';;' end as t from orders)""",
)
def row_width_policy(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    rest = (
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey").cast("string"))
        .when(F.col("o_orderstatus") == "O", "a;b;c;d")
        .otherwise(";;")
    )
    lines = o.select("o_orderkey", F.concat_ws(";", "o_orderstatus", rest).alias("t"))
    out = delimited.split_rows(lines, "t", ";", 4)
    return out.select("o_orderkey", F.array_join("campos", "|").alias("campos"), "excesso")


@query(
    "S8",
    sql="select o_orderkey, row_number() over (order by o_orderkey) + 1 as _numero_linha from orders",
)
def line_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return delimited.numbered(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "S1 S7 S8",
    sql="""with r as (select doc_id, doc_id % 64 as arquivo, coalesce(source, '') as origem, coalesce(text, '') as t,
        case when doc_id % 7 = 0 then 'x;"y' || chr(10) || 'z"' end as excesso from documents),
      n as (select *, 1 + len(t) - len(replace(t, chr(10), '')) + (excesso is not null)::int as linhas from r)
    select doc_id::varchar as doc_id, origem, sha256(t) as sha256, excesso, arquivo::bigint as arquivo,
      1 + row_number() over (partition by arquivo order by doc_id) as _numero_linha,
      (2 + coalesce(sum(linhas) over (partition by arquivo order by doc_id rows between unbounded preceding and 1 preceding), 0))::bigint as _linha_arquivo
    from n""",
)
def quoted_records(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as quoted fields over many lines, in 64 files; record numbers and lines of the file."""
    d = table(spark, sf, "documents").select("doc_id", "source", "text", (F.col("doc_id") % 64).alias("arquivo"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    more = F.when(F.col("doc_id") % 7 == 0, ';x;"y\nz"').otherwise("")
    line = F.concat(F.col("doc_id").cast("string"), F.lit(";"), quoted(F.col("source")), F.lit(";"), quoted(F.col("text")), more)
    rows = d.select("arquivo", F.col("doc_id").alias("ordem"), line.alias("value"))
    heads = d.select("arquivo", F.lit(None).cast("long").alias("ordem"), F.lit("doc_id;origem;texto").alias("value")).distinct()
    folder = _folder(spark, "quoted")
    # Header first in each file, as such files are delivered.
    rows.unionByName(heads).repartition("arquivo").sortWithinPartitions("arquivo", "ordem").drop("ordem").write.partitionBy("arquivo").text(folder)
    # A text of any length is a record; the limit of the reader would tell it instead.
    read = records.read_quoted(spark, folder, delimited.detect_format(b"doc_id;origem;texto"), most_bytes=1 << 30)
    number = F.regexp_extract("_arquivo", r"arquivo=(\d+)", 1).cast("long")
    return read.select(
        "doc_id", "origem", F.sha2(F.col("texto").cast("binary"), 256).alias("sha256"), F.col("_excesso").alias("excesso"),
        number.alias("arquivo"), "_numero_linha", "_linha_arquivo",
    )


@query(
    "S9 F11",
    sql=f"""select o_orderkey, year(o_orderdate) + 18 as y1, case when year(o_orderdate) + 18 >= 2013 then year(o_orderdate) + 18 end as ano,
      case when o_orderstatus <> 'F' and year(o_orderdate) + 15 >= 2013 then year(o_orderdate) + 15 end as ano_operacao,
      year(o_orderdate) + 10 as dica, case when o_orderstatus = 'F' then '' else {roles.UF_LIST}[(o_custkey % 27 + 1)::int] end as uf from orders""",
)
def years_and_states_of_paths(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    y = F.year("o_orderdate")
    name = F.concat(F.lit("SICOR_123456_"), (y + 18).cast("string"), F.lit("_v2.csv"))
    tail = F.when(F.col("o_orderstatus") == "F", "_x.csv").otherwise(".gz")
    strict = F.concat(F.lit("lote/sicor_operacao_basica_estado_"), (y + 15).cast("string"), tail)
    hint = F.concat(F.lit("prodes_1988_"), (y + 10).cast("string"), F.lit(".zip"))
    uf = F.element_at(F.array(*map(F.lit, tx.UF_CODES)), (F.col("o_custkey") % 27 + 1).cast("int"))
    path = F.when(F.col("o_orderstatus") == "F", "entrada/bruto.zip").otherwise(
        F.concat(F.lit("entrada/AC/arquivo-"), F.lower(uf), F.lit(".zip"))
    )
    return o.select(
        "o_orderkey", (y + 18).alias("y1"), delimited.year_of_name(name).alias("ano"),
        delimited.operations_year(strict).alias("ano_operacao"),
        delimited.year_hint(hint).alias("dica"), tx.uf_of_path(path).alias("uf"),
    )


@query(
    "S10 G1 S13 S14 G4",
    sql=f"""with {roles.UNITS_SQL}
    select uc_id, case p when 0 then 'WKT inválido' when 1 then 'WKT vazio' end as motivo, case when p > 1 then round({box_m2("x0", "y0", "x1", "y1")} / 10000, 3) end as area_ha
    from (select *, uc_id % 10 as p from units)""",
)
def read_wkt_answers(spark: SparkSession, sf: str) -> DataFrame:
    """WKT found inside JSON answers, parsed, repaired and measured."""
    u = roles.units_layer(spark, sf)
    wkt = geo.to_wkt(F.col("geometry"))
    state = F.col("uc_id") % 10
    # Collections with the unit among other members, once nested and once with a copy.
    mixed = F.concat(F.lit("GEOMETRYCOLLECTION (POINT (0 0), "), wkt, F.lit(", LINESTRING (0 0, 1 1))"))
    twice = F.concat(F.lit("GEOMETRYCOLLECTION ("), wkt, F.lit(", GEOMETRYCOLLECTION (POLYGON EMPTY, "), wkt, F.lit("))"))
    text = (
        F.when(state == 0, F.lit("POLYGON ((broken))")).when(state == 1, F.lit(""))
        .when(state == 2, mixed).when(state == 3, twice).otherwise(wkt)
    )
    answer = F.to_json(F.struct(F.struct(text.alias("wkt")).alias("outro"), F.lit("x").alias("nome")))
    found = u.select("uc_id", shapes_text.wkt_in_json(answer).alias("wkt"))
    read = shapes_text.read_wkt(found, "wkt")
    return read.select(
        "uc_id", "motivo", F.round(geo.area_m2(F.col("geometry")) / 10000, 3).alias("area_ha")
    )


@query(
    "S11 K17 G1 J5",
    sql=f"""with {roles.UNITS_SQL} select uc_id, (round(x1, 6) - round(x0, 6)) * (round(y1, 6) - round(y0, 6)) > 0 as ok, round((x1 - x0) * (y1 - y0), 4) as planar from units""",
)
def geojson_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    u = roles.units_layer(spark, sf).select("uc_id", geo.to_geojson(F.col("geometry")).alias("t"))
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), "t", F.lit("}"))
    read = u.withColumn("g", geo.from_geojson(feature))
    return read.select(
        "uc_id", geo.is_valid(F.col("g")).alias("ok"), F.round(geo.planar_area(F.col("g")), 4).alias("planar")
    )


def _kml(spark: SparkSession, sf: str) -> DataFrame:
    """One KML document per brand and size, a placemark per part, two polygons each."""
    u = roles.units_layer(spark, sf).withColumn("b", geo.bbox(F.col("geometry")))
    b = F.col("b")
    xm = (b["xmin"] + b["xmax"]) / 2
    left = geo.box_geometry(b["xmin"], b["ymin"], xm, b["ymax"])
    both = geo.geometry(F.concat(left["parts"], F.col("geometry")["parts"]))
    return u.withColumn(
        "xml", shapes_text.placemark(F.concat(F.lit("  "), "nome_uc", F.lit("  &")), {"uf": F.lit("PE")}, both)
    )


@query(
    "S12 K15 S11",
    sql=f"""with {roles.UNITS_SQL}, j as (select *, unnest([0, 1]) as poligono from units)
    select uc_id, poligono, trim(nome_uc) || ' &amp;' || case when poligono = 1 then ' 2' else '' end as nome,
      (x1 - x0) * (y1 - y0) / case when poligono = 0 then 2 else 1 end as planar, false as excedido from j""",
)
def kml_plots(spark: SparkSession, sf: str) -> DataFrame:
    """Placemarks written as KML text and read back, one row per polygon."""
    plots = shapes_text.kml_plots(_kml(spark, sf), "uc_id", "xml")
    return plots.select("uc_id", "poligono", "nome", geo.planar_area(F.col("geometry")).alias("planar"), "excedido")


@query(
    "U8 S11 G11",
    sql=f"with {roles.UNITS_SQL} select uc_id, (x1 - x0) * (y1 - y0) as planar, 1 as partes, 1 as aneis, 5 as vertices from units",
)
def kml_union(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping polygons of one document become their union, one outline without inner borders."""
    union, g = shapes_text.kml_unions(_kml(spark, sf), "uc_id", "xml"), F.col("geometry")
    return union.select(
        "uc_id", geo.planar_area(g).alias("planar"), F.size(g["parts"]).alias("partes"),
        F.size(geo.rings(g)).alias("aneis"), F.size(geo.vertices(g)).alias("vertices"),
    )


@query(
    "K16 K17",
    sql=f"""with {roles.EMBARGO_SQL}, v as (select *, unnest([1, 2, 3, 4, 5]) as vertice from embargo),
    p as (select *, case when vertice in (2, 3) then x1 else x0 end as x, case when vertice in (3, 4) then y1 else y0 end as y from v)
    select seq_tad::varchar as seq_tad, 1 as poligono, 1 as anel, vertice, replace(printf('%.8f', x), '.', ',') as longitude, replace(printf('%.8f', y), '.', ',') as latitude from p""",
)
def vertex_export(spark: SparkSession, sf: str) -> DataFrame:
    """Vertex rows written as quoted `;` text and read back."""
    e = roles.embargo_layer(spark, sf).withColumn("seq_tad", F.col("seq_tad").cast("string"))
    folder = _folder(spark, "vertices")
    shapes_text.write_vertices(shapes_text.vertex_rows(e, ["seq_tad"]), folder)
    back = spark.read.option("sep", ";").option("header", True).csv(folder)
    whole = {c: F.col(c).cast("int") for c in ("poligono", "anel", "vertice")}
    return back.withColumns(whole).drop("area_ha")


@query(
    "S18 U7",
    sql="""with r as (select page_id, regexp_replace(url, '[?#].*$', '') as url from pages)
    select 'termos' as chave, url, row_number() over (order by min(case when ends_with(lower(url), '5') then 0 else 1 end), url) as ordem from r group by 2""",
)
def resource_discovery(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of a catalogue document per page, known ones last, each once."""
    p = table(spark, sf, "pages").withColumn("u", F.regexp_replace("url", "[?#].*$", ""))
    resource = F.struct(
        F.lit("Termos de Embargo").alias("name"), F.lit("").alias("description"), F.lit("CSV").alias("format"), F.col("u").alias("url")
    )
    document = F.to_json(F.struct(F.struct(F.array(resource).alias("resources")).alias("result")))
    listed = p.where(F.lower("u").endswith("5")).select(document.alias("doc"))
    wanted = p.select(F.lit("termos_de_embargo").alias("nome"), F.lit("termos").alias("chave")).distinct()
    known = p.select(F.lit("termos").alias("chave"), F.col("u").alias("url"), F.lit(2).alias("origem"), F.lit(0).alias("pos"))
    out = shapes_text.resource_candidates(listed, "doc", wanted, known)
    return out.select("chave", "url", "ordem")


@query(
    "D13 D19 D11",
    sql="""with f as (select left(md5(url), 1) as pasta, '/' || left(md5(url), 1) || '/' || page_id::varchar as path, sha256(html) as c from pages),
    d as (select pasta, left(md5(path), 3) as p, sha256(string_agg(path || ':' || c, chr(10) order by path || ':' || c)) as d, count(*) as n from f group by 1, 2)
    select pasta, sum(n)::bigint as arquivos, sha256(string_agg(p || ':' || d, chr(10) order by p || ':' || d)) as manifesto from d group by 1""",
)
def folder_manifests(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    h = F.substring(F.md5("url"), 1, 1)
    files = p.select(
        F.concat(F.lit("/"), h, F.lit("/"), F.col("page_id").cast("string")).alias("path"),
        F.encode("html", "UTF-8").alias("content"),
    )
    return shapes_text.folder_manifest(files, F.split_part("path", F.lit("/"), F.lit(2))).drop("bytes")


@query(
    "D13",
    sql="select page_id, sha256(html[1:1] || chr(0) || chr(0) || chr(0) || html[5:]) as h from pages",
)
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.select(
        "page_id", shapes_text.content_hash(F.encode("html", "UTF-8"), F.lit("camada.DBF")).alias("h")
    )


@query(
    "G6 W4",
    sql=f"""with {roles.EMBARGO_SQL}
    select seq_tad, round(abs((radians(x1 - x0)) * (sin(radians(y1)) - sin(radians(y0)))) * 6378137.0 * 6378137.0 / 10000, 2) as area_ha,
      round(radians(y1 - y0) * 6371000.0, 3) as lado_m from embargo""",
)
def display_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Map-style spherical area, and the length of the west side."""
    e = roles.embargo_layer(spark, sf)
    ring = F.get(geo.rings(F.col("geometry")), F.lit(0))
    side = geo.without_repeats(F.array(F.get(ring, F.lit(3)), F.get(ring, F.lit(3)), F.get(ring, F.lit(4))))
    return e.select(
        "seq_tad",
        F.round(geo.spherical_ring_area(ring) / 10000, 2).alias("area_ha"),
        F.round(geo.path_length(side), 3).alias("lado_m"),
    )
