"""Plots, operations, alerts and source merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geometry as geo
from ..operators import alerts, confront, credit
from . import roles
from .q_spatial import box_m2, pairs_sql
from .registry import query, table


def _uf(number) -> F.Column:
    return F.element_at(F.array(*map(F.lit, roles.tx.UF_CODES)), (number % 25 + 1).cast("int"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").cast("string").alias("ref_bacen"),
        F.col("l_linenumber").cast("string").alias("nu_ordem"),
        F.when(F.col("l_returnflag") == "N", "").otherwise((F.col("l_suppkey") % 3).cast("string")).alias("indice"),
        (F.year("l_shipdate") + 20).alias("ano"),
        F.concat_ws("-", _uf(F.col("l_orderkey")), F.col("l_orderkey").cast("string")).alias("cod_imovel"),
        (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("id"),
        F.when(F.col("l_returnflag") == "N", "")
        .when(F.col("l_returnflag") == "A", _uf(F.col("l_orderkey")))
        .otherwise(_uf(F.col("l_partkey")))
        .alias("cd_estado"),
        F.lpad(F.col("l_suppkey").cast("string"), 8, "0").alias("cnpj_if"),
        F.lpad(F.col("l_quantity").cast("int").cast("string"), 4, "0").alias("cd_programa"),
        F.col("l_extendedprice").alias("vl_parc_credito"),
        F.when(F.col("l_tax") > 0.04, F.col("l_returnflag")).otherwise("").alias("tipo"),
        "l_linestatus",
    )


_LINES_SQL = f"""
lines as (
  select l_orderkey::varchar as ref_bacen, l_linenumber::varchar as nu_ordem,
    case when l_returnflag = 'N' then '' else (l_suppkey % 3)::varchar end as indice, year(l_shipdate) + 20 as ano,
    {roles.UF_LIST}[(l_orderkey % 25 + 1)::int] || '-' || l_orderkey::varchar as cod_imovel, l_partkey * 1000 + l_suppkey as id,
    case l_returnflag when 'N' then '' when 'A' then {roles.UF_LIST}[(l_orderkey % 25 + 1)::int]
      else {roles.UF_LIST}[(l_partkey % 25 + 1)::int] end as cd_estado,
    lpad(l_suppkey::varchar, 8, '0') as cnpj_if, lpad(l_quantity::int::varchar, 4, '0') as cd_programa,
    l_extendedprice as vl_parc_credito, case when l_tax > 0.04 then l_returnflag else '' end as tipo, l_linestatus
  from lineitem),
latest as (select * from (select *, row_number() over (partition by ref_bacen, nu_ordem, ano order by id desc) as rn from lines) where rn = 1)
"""


def _operations(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["ref_bacen", "nu_ordem", "ano", "cd_estado", "cnpj_if", "cd_programa", "vl_parc_credito"]
    return _lines(spark, sf).select(*cols, F.col("id").alias("_numero_linha"))


def _domains(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    institutions = s.where("s_acctbal > 0").select(
        F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("cnpj_if"),
        F.col("s_name").alias("nome_if"),
        F.lit("BANCO").alias("segmento_if"),
    )
    programmes = n.select(
        F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("cd_programa"),
        F.col("n_name").alias("descricao"),
    )
    return institutions, programmes


@query(
    "J10 W1 J11 P24",
    sql=f"""with {_LINES_SQL}
    select l.ref_bacen, l.nu_ordem, l.ano, l.cnpj_if, coalesce(nullif(s.s_name, ''), l.cnpj_if) as nome_instituicao,
      coalesce(n.n_name, l.cd_programa) as nome_programa, l.vl_parc_credito
    from latest l left join supplier s on s.s_acctbal > 0 and lpad(s.s_suppkey::varchar, 8, '0') = l.cnpj_if
      left join nation n on lpad(n.n_nationkey::varchar, 4, '0') = l.cd_programa""",
    bench=True,
)
def latest_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Last line of every operation and year, with institution and programme names."""
    latest = credit.latest_operations(_operations(spark, sf))
    named = credit.with_names(latest, *_domains(spark, sf))
    return named.select(
        "ref_bacen", "nu_ordem", "ano", "cnpj_if", "nome_instituicao", "nome_programa", "vl_parc_credito"
    )


@query(
    "U4 F27 O5",
    sql=f"""with {_LINES_SQL}, wkt as (select * from lines where l_linestatus = 'F'), pts as (select * from lines where l_linestatus = 'O'),
    one_year as (select cod_imovel, ref_bacen, nu_ordem, indice, min(ano)::varchar as y from wkt where indice <> '' group by all having count(distinct ano) = 1),
    both_ as (
      select cod_imovel, ref_bacen, nu_ordem, indice, ano::varchar as y, 0 as rank, id, cd_programa, tipo, ano from wkt
      union all select p.cod_imovel, p.ref_bacen, p.nu_ordem, p.indice, coalesce(o.y, ''), 1, p.id, p.cd_programa, p.tipo, null
      from pts p left join one_year o using (cod_imovel, ref_bacen, nu_ordem, indice)),
    merged as (
      select cod_imovel, ref_bacen || ':' || nu_ordem || ':' || y || ':' || case when indice = '' then 'SEM_INDICE' else indice end as plot,
        min(ref_bacen) as ref_bacen, min(nu_ordem) as nu_ordem,
        first(cd_programa order by rank, id) as cd_programa, first(tipo order by rank, id) filter (tipo <> '') as tipo,
        first(ano order by rank, id) filter (ano is not null) as ano,
        case when min(rank) = 0 then 'WKT' else 'COORDENADAS' end as origem, count(*) as registros
      from both_ group by 1, 2),
    joined as (select m.*, l.cd_estado from merged m left join latest l on l.ref_bacen = m.ref_bacen and l.nu_ordem = m.nu_ordem and l.ano = m.ano)
    select cod_imovel, plot, cd_programa, tipo, origem, registros,
      case when coalesce(cd_estado, '') <> '' then 'VALIDADA' else 'SEM_VALIDACAO' end as validacao_uf
    from joined where coalesce(cd_estado, '') = '' or cd_estado = left(cod_imovel, 2)""",
    bench=True,
)
def merge_credit_plots(spark: SparkSession, sf: str) -> DataFrame:
    """Two plot sources merged, then checked against the operation's state."""
    li = _lines(spark, sf)
    wkt = li.where("l_linestatus = 'F'")
    pts = li.where("l_linestatus = 'O'").withColumn("ano", F.lit(None).cast("int"))
    fields = ["ref_bacen", "nu_ordem", "ano", "cd_programa", "tipo"]
    merged = credit.merge_plot_sources(wkt, pts, fields)
    ops = credit.latest_operations(_operations(spark, sf))
    state = ops.select("ref_bacen", "nu_ordem", "ano", "cd_estado")
    joined = merged.join(state, ["ref_bacen", "nu_ordem", "ano"], "left")
    checked = credit.check_state(joined, F.left("cod_imovel", F.lit(2)), F.col("cd_estado"))
    return checked.select(
        "cod_imovel", "plot", "cd_programa", "tipo", "origem", "registros", "validacao_uf"
    )


@query(
    "U3 U4",
    sql=f"""with {_LINES_SQL}
    select cod_imovel, case when count(distinct l_linestatus) > 1 then null else max(vl_parc_credito) end as area_unica_sobreposta_ha,
      case when count(distinct l_linestatus) > 1 then 'COORDENADAS,WKT' when min(l_linestatus) = 'F' then 'WKT' else 'COORDENADAS' end as fontes
    from lines group by 1""",
)
def single_source_area(spark: SparkSession, sf: str) -> DataFrame:
    li = _lines(spark, sf)
    origin = F.when(F.col("l_linestatus") == "F", "WKT").otherwise("COORDENADAS")
    area = F.col("vl_parc_credito")
    out = credit.single_source_area(li.withColumn("origem", origin), "cod_imovel", area, area)
    return out.withColumn("fontes", F.array_join("fontes", ","))


# Plot corners: each order line gives one numbered corner of the order's plot.
@query(
    "A7 G14 A21",
    sql=f"""with pts as (
      select l_orderkey as k, l_linenumber as i, count(*) over (partition by l_orderkey) as n, l_quantity as alt from lineitem),
    s as (select k, count(*) as qtd_pontos, count(distinct i) as qtd_indices, min(i) as indice_min, max(i) as indice_max,
        min(alt) as altitude_min, max(alt) as altitude_max from pts group by 1)
    select *, not (qtd_pontos between 5 and 100 and qtd_indices = qtd_pontos and indice_max - indice_min + 1 = qtd_pontos) as estrutura_pendente,
      case when qtd_pontos between 5 and 100 and qtd_indices = qtd_pontos and indice_max - indice_min + 1 = qtd_pontos then
        round({box_m2("-50.0::double", "-10.0::double", "-49.5::double", "-9.5::double")} / 10000, 2) end as area_ha
    from s""",
)
def assemble_plots(spark: SparkSession, sf: str) -> DataFrame:
    """Sound plots of five to seven corners close into one square; four corners stay open."""
    li = table(spark, sf, "lineitem")
    i, first = F.col("l_linenumber"), F.col("_first")
    li = li.join(
        li.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("_first"), F.count(F.lit(1)).alias("_n")),
        "l_orderkey",
    )
    corner = F.when(F.col("_n") == 5, (i - first) % 4).otherwise(i - first)
    lon = F.lit(-50.0) + F.when(corner.isin(1, 2), 0.5).otherwise(0.0)
    lat = F.lit(-10.0) + F.when(corner.isin(2, 3), 0.5).otherwise(0.0)
    pts = li.select(
        F.col("l_orderkey").alias("k"), i.alias("indice"), lon.alias("lon"), lat.alias("lat"),
        F.col("l_quantity").alias("altitude"), "_n",
    )
    plots = credit.assemble_plots(pts, ["k"])
    return plots.select(
        "k", "qtd_pontos", "qtd_indices", "indice_min", "indice_max", "altitude_min", "altitude_max",
        "estrutura_pendente",
        F.round("area_ha_calculada", 2).alias("area_ha"),
    )


@query(
    "A8 J15 J16",
    sql=f"""with {roles.EMBARGO_SQL}, t as (select *, case when area_ha > 5000 then 'WKT' when area_ha > 0 then 'COORDENADAS'
        when area_ha > -500 then 'API' end as origem_geometria from embargo)
    select seq_tad, origem_geometria, case when origem_geometria is not null then round({box_m2("x0", "y0", "x1", "y1")} / 10000, 3) end as area_ha from t""",
)
def geometry_fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    """Terms without WKT get their geometry from coordinate rows, then from a table of API answers."""
    e = roles.embargo_layer(spark, sf)
    terms = e.withColumn("geometry", F.when(F.col("area_ha") > 5000, F.col("geometry")))
    missing = terms.where("geometry is null").select("seq_tad")
    corners = e.where("area_ha between 0 and 5000").select(
        "seq_tad", F.posexplode(F.slice(geo.vertices(F.col("geometry")), 1, 4)).alias("o", "p")
    )
    rows = corners.select(
        "seq_tad", F.lit("1").alias("poligono"), "o", F.col("p.x").alias("lon"), F.col("p.y").alias("lat")
    ).join(missing, "seq_tad", "left_semi")
    rings = credit.assemble_rings(rows, "seq_tad", "poligono", F.col("o"))
    api = e.where("area_ha > -500").select("seq_tad", "geometry")
    full = credit.with_fallbacks(terms, "seq_tad", rings, api)
    return full.select(
        "seq_tad", "origem_geometria", F.round(geo.area_m2(F.col("geometry")) / 10000, 3).alias("area_ha")
    )


@query(
    "J9 A10 O8 O1",
    sql=f"""with {roles.PROPERTIES_SQL}, f as (
      select p.cod_imovel, o_orderpriority as camada, case when o_orderstatus = 'P' then null else o_totalprice::decimal(28,6) end as area_ha
      from orders join properties p on o_custkey = c_custkey)
    select cod_imovel, camada, count(*) as quantidade, sum(area_ha)::double as total_area_ha, false as truncada, true as exportar from f group by 1, 2""",
)
def own_thematic_layers(spark: SparkSession, sf: str) -> DataFrame:
    p = roles.properties(spark, sf)
    o = table(spark, sf, "orders")
    keyed = o.join(p.select("c_custkey", "cod_imovel"), o.o_custkey == p.c_custkey)
    feats = keyed.select(
        "cod_imovel",
        F.col("o_orderpriority").alias("camada"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("area_ha"),
    )
    return confront.export_allowed(confront.own_layers(p, feats))


@query(
    "U2 U3 F27",
    sql="""with a as (select s_suppkey::varchar as codigo_cnuc, s_suppkey as id, case when s_acctbal > 3000 then s_name end as nome_uc, null::varchar as esfera,
        s_nationkey::varchar as uf from supplier),
    b as (select p_partkey::varchar as codigo_cnuc, p_partkey as id, p_name as nome_uc, p_type as esfera, p_brand as uf from part)
    select 'COD:' || coalesce(a.codigo_cnuc, b.codigo_cnuc) as chave, coalesce(a.nome_uc, b.nome_uc) as nome_uc,
      b.esfera, coalesce(a.uf, b.uf) as uf, case when a.id is null then 'ICMBIO' when b.id is null then 'CNUC' else 'CNUC + ICMBIO' end as fonte_integrada
    from a full join b on a.codigo_cnuc = b.codigo_cnuc""",
)
def merge_protected_units(spark: SparkSession, sf: str) -> DataFrame:
    s, p = table(spark, sf, "supplier"), table(spark, sf, "part")
    a = s.select(
        F.col("s_suppkey").cast("string").alias("codigo_cnuc"),
        F.lit("").alias("uc_id"),
        F.col("s_suppkey").alias("id"),
        F.when(F.col("s_acctbal") > 3000, F.col("s_name")).otherwise("").alias("nome_uc"),
        F.lit(None).cast("string").alias("esfera"),
        F.col("s_nationkey").cast("string").alias("uf"),
    )
    b = p.select(
        F.lit(None).cast("string").alias("codigo_cnuc"),
        F.col("p_partkey").cast("string").alias("uc_id"),
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("nome_uc"),
        F.col("p_type").alias("esfera"),
        F.col("p_brand").alias("uf"),
    )
    return alerts.merge_units(a, b, ["nome_uc", "esfera", "uf"], ("CNUC", "ICMBIO"))


@query(
    "R3 A12 A13 P16 F6",
    sql=f"""with {roles.PROPERTIES_SQL}, {roles.ALERTS_SQL}, {pairs_sql("alerts", "fid")},
    r as (select a.cod_imovel, l.year, case class_name when '1-URGENT' then 'DESMATAMENTO' when '2-HIGH' then 'DESMATAMENTO'
        when '3-MEDIUM' then 'QUEIMADA' when '5-LOW' then '5-LOW' else 'HIDROGRAFIA' end as tipo, m2 / 10000 as ha
      from areas a join alerts l on l.fid = a.feature where m2 > 1.0 and l.year >= 2019),
    g as (select cod_imovel, count(*) as quantidade, string_agg(distinct year::varchar, ',' order by year::varchar) as anos,
      array_to_string(list_sort(list_distinct(list(case when tipo = '5-LOW' then '5-LOW' else tipo end))), ',') as tipos,
      round(sum(ha), 3) as area_soma_ocorrencias_ha, 'COM_OCORRENCIAS' as cobertura_status from r group by 1)
    select p.cod_imovel, coalesce(quantidade, 0) as quantidade, anos, tipos, area_soma_ocorrencias_ha,
      coalesce(cobertura_status, 'COBERTURA_NAO_CONFIRMADA') as cobertura_status from properties p left join g using (cod_imovel)""",
)
def alert_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Restricting alerts per property: years, classes, summed area, coverage."""
    p, layer = roles.properties(spark, sf), roles.alerts_layer(spark, sf)
    values = ["year", "main_class", "class_name"]
    result = confront.external_layer(confront.Indexed.of(p), layer, "fid", values=values)
    full = result.groups.withColumn("tipo_prodes", F.lit(""))
    found = alerts.alert_occurrences(full, restrict=True, copies="quantidade")
    found = found.withColumn("area_soma_ocorrencias_ha", F.round("area_soma_ocorrencias_ha", 3))
    return alerts.with_coverage(p, found)


@query(
    "J7 X1 F7",
    sql=f"""with {roles.PROPERTIES_SQL}, {roles.EMBARGO_SQL}, {pairs_sql("embargo", "seq_tad")}
    select cod_imovel, feature as seq_tad, e.numero_embargo, e.uf as uf_embargo, round(m2 / 10000, 4) as area_sobreposta_ha,
      round(m2 / prop_m2 * 100, 4) as percentual_sobreposto,
      case when e.uf in ('AC', 'AL') then 'CANCELADO' when e.area_ha < 0 then 'DESEMBARGADO' when e.uf = 'BA' then 'A_VERIFICAR' else 'ATIVO' end as status
    from areas a join embargo e on e.seq_tad = a.feature where m2 > 0""",
)
def embargo_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Contract table function: every embargo overlap of every property."""
    uf, area = F.col("uf"), F.col("area_ha")
    status = alerts.embargo_status(
        F.when(uf == "AC", "s"),
        F.when(area < 0, "S"),
        F.lit(""),
        F.when(uf == "AL", "Cancelado").when(uf == "BA", "").otherwise("vigente"),
        F.lit(None).cast("string"),
    )
    e = roles.embargo_layer(spark, sf).withColumn("status", status)
    rows = confront.contract_overlaps(
        confront.Indexed.of(roles.properties(spark, sf)), e.withColumnRenamed("uf", "uf_embargo"), "seq_tad"
    )
    return rows.drop("area_ha")


@query(
    "J8 U1 X3",
    sql=f"""with {roles.PROPERTIES_SQL}, {roles.EMBARGO_SQL}, {roles.UNITS_SQL}, both_layers as (
      select 'SIGEF' as base, seq_tad::varchar as codigo, x0, y0, x1, y1 from embargo
      union all select 'SNCI', uc_id::varchar, x0, y0, x1, y1 from units), feats as (select base || ':' || codigo as key, * from both_layers),
    {pairs_sql("feats", "key")}
    select cod_imovel, feature as chave, round(m2 / 10000, 4) as area_sobreposta_ha, round(m2 / prop_m2 * 100, 4) as percentual_sobreposto
    from areas where m2 > 0""",
)
def parcel_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Contract table function over two parcel registers in one schema."""
    a = roles.embargo_layer(spark, sf).select(
        F.concat(F.lit("SIGEF:"), F.col("seq_tad").cast("string")).alias("chave"), "geometry"
    )
    b = roles.units_layer(spark, sf).select(
        F.concat(F.lit("SNCI:"), F.col("uc_id").cast("string")).alias("chave"), "geometry"
    )
    return confront.contract_overlaps(
        confront.Indexed.of(roles.properties(spark, sf)), a.unionByName(b), "chave")


@query(
    "A23 X2",
    sql="""with c as (select o_custkey, list({'k': o_orderkey, 's': o_orderstatus} order by o_orderkey) as itens from orders group by 1)
    select c_custkey as seq_tad, md5('{' || coalesce('"itens":[' || array_to_string(list_transform(itens, lambda x: '{"k":' || x.k::varchar || ',"s":"' || x.s || '"}'), ',') || ']', '')
      || '}') as detalhes from customer left join c on o_custkey = c_custkey""",
)
def term_details(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    terms = table(spark, sf, "customer").select(F.col("c_custkey").alias("seq_tad"))
    items = o.select(
        F.col("o_custkey").alias("seq_tad"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")
    )
    return alerts.details_json(terms, "seq_tad", {"itens": items}).withColumn("detalhes", F.md5("detalhes"))


@query(
    "P15 P17",
    sql="""select p_partkey as uc_id, p_size = 7 or upper(p_name) like '%PROTE%AMBIENTAL%' as apa,
      '{"nome_uc":"' || p_name || '"' || case when p_size = 7 then ',"sigla":"APA"' else '' end || '}' as registro from part""",
)
def protected_units_public(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("uc_id"),
        F.col("p_name").alias("nome_uc"),
        F.when(F.col("p_size") == 7, " apa ").otherwise("").alias("code"),
        F.when(F.col("p_size") == 7, "APA").otherwise("").alias("sigla"),
        F.col("p_retailprice").alias("cpf"),
    )
    return p.select(
        "uc_id",
        alerts.protected_area(F.col("code"), F.col("nome_uc")).alias("apa"),
        alerts.public_record(p.columns, ["nome_uc", "sigla", "ausente"]).alias("registro"),
    )
