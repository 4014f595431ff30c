"""Warnings, replay rounds, outcomes, labels, strict headers and the inbox stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators import billing, identity, locate, status
from ..operators.confront import Indexed, plot_warnings
from ..session import shared_folder
from ..sources import delimited
from ..streaming import inbox
from . import roles
from .q_spatial import box_m2
from .registry import query, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _m2(a: str, b: str) -> str:
    return box_m2(f"greatest({a}.x0, {b}.x0)", f"greatest({a}.y0, {b}.y0)", f"least({a}.x1, {b}.x1)", f"least({a}.y1, {b}.y1)")


def _meet(a: str, b: str) -> str:
    return f"{a}.x0 < {b}.x1 and {b}.x0 < {a}.x1 and {a}.y0 < {b}.y1 and {b}.y0 < {a}.y1"


@query(
    "G16 G13",
    sql=f"""with {roles.PROPERTIES_SQL}, {roles.ALERTS_SQL}, {roles.EMBARGO_SQL},
    plots as (select a.*, p.cod_imovel, 'G' || fid::varchar as nome, p.x0 as px0, p.y0 as py0, p.x1 as px1, p.y1 as py1 from alerts a join orders on o_orderkey = fid join properties p on c_custkey = o_custkey),
    own as (select fid as plot, {box_m2("x0", "y0", "x1", "y1")} as m2, case when x0 < px1 and px0 < x1 and y0 < py1 and py0 < y1
        then {box_m2("greatest(x0, px0)", "greatest(y0, py0)", "least(x1, px1)", "least(y1, py1)")} else 0 end as i from plots),
    w as (select plot, 'Fora do limite do CAR' as rotulo from own where m2 - i > 0.01
      union select p.fid, 'Embargo ' || e.uf from plots p join embargo e on {_meet("p", "e")} where {_m2("p", "e")} > 0.01
      union select p.fid, 'Polígono: ' || q.nome from plots p join plots q on p.cod_imovel = q.cod_imovel and p.fid <> q.fid and {_meet("p", "q")} where {_m2("p", "q")} > 0.01)
    select plot, string_agg(rotulo, '|' order by rotulo) as avisos from w group by 1""",
)
def drawn_plot_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """Alert boxes as plots drawn on the property of the customer who ordered."""
    p = roles.properties(spark, sf)
    o = table(spark, sf, "orders").join(p.select("c_custkey", "cod_imovel"), F.col("o_custkey") == F.col("c_custkey"))
    a = roles.alerts_layer(spark, sf).select("fid", "geometry")
    plots = a.join(o.select(F.col("o_orderkey").alias("fid"), "cod_imovel"), "fid").select(
        F.col("fid").alias("plot"), "cod_imovel", F.concat(F.lit("G"), F.col("fid").cast("string")).alias("nome"), "geometry"
    )
    refs = roles.embargo_layer(spark, sf).select(F.concat(F.lit("Embargo "), "uf").alias("rotulo"), "geometry")
    out = plot_warnings(plots, Indexed.of(p.drop("area_total_ha")), refs)
    return out.withColumn("avisos", F.array_join("avisos", "|"))


@query(
    "T2",
    sql="""select event_id from (select *, event_id % 13 as tries, case event_type when 'purchase' then 'PROCESSED' when 'error' then 'ERROR' when 'view' then 'PENDING' else 'RECEIVED' end as s from events) e
      where event_id in (select event_id from events where event_type <> 'purchase' order by ts, event_id limit 100) and not (s = 'ERROR' and tries >= 10)""",
)
def replay_round(spark: SparkSession, sf: str) -> DataFrame:
    """The oldest open events of one worker round; the limit is the round's size."""
    e = table(spark, sf, "events")
    state = (
        F.when(F.col("event_type") == "purchase", "PROCESSED")
        .when(F.col("event_type") == "error", "ERROR")
        .when(F.col("event_type") == "view", "PENDING")
        .otherwise("RECEIVED")
    )
    rows = e.select("event_id", F.col("ts").alias("recebido_em"), state.alias("status"), (F.col("event_id") % 13).alias("tentativas"))
    return billing.replay_round(rows).select("event_id")


@query(
    "R9",
    sql="""select o_orderkey, case o_orderpriority when '1-URGENT' then 'CONCLUIDO' when '2-HIGH' then 'AGUARDANDO_CONFIRMACAO_SICOR' when '3-MEDIUM' then case when o_orderstatus = 'F' then 'SEM_ALTERACAO' else 'IGNORADO_DUPLICADO' end
      when '4-NOT SPECIFIED' then 'SEM_ALTERACAO' else 'FALHOU' end as situacao from orders""",
)
def item_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    p = F.col("o_orderpriority")
    outcome = (
        F.when(p == "1-URGENT", "CONCLUIDO")
        .when(p == "2-HIGH", "AGUARDANDO_CONFIRMACAO_REDUCAO")
        .when(p == "3-MEDIUM", "IGNORADO_DUPLICADO")
        .when(p == "4-NOT SPECIFIED", "SEM_ALTERACAO")
        .otherwise("REJEITADO")
    )
    source = F.when(F.col("o_orderstatus") == "F", "sicar").otherwise("prodes")
    return o.select("o_orderkey", status.item_outcome(source, outcome).alias("situacao"))


@query(
    "R7 X5",
    sql="""with n as (select p_size as k, count(*) as n from part group by 1), u as (select distinct s_suppkey as k from supplier)
    select k::varchar as identificador, true as ok from u join n using (k) where n = 1
    union all select 'u' || p_partkey::varchar, true from part where p_size = 7""",
)
def unit_by_identifier(spark: SparkSession, sf: str) -> DataFrame:
    """Geometry only for identifiers that name exactly one unit."""
    p = roles.units_layer(spark, sf).join(
        table(spark, sf, "part").select(F.col("p_partkey").alias("uc_id"), "p_size"), "uc_id"
    )
    by_size = p.select(F.col("p_size").cast("string").alias("ident"), "geometry")
    single = p.where("p_size = 7").select(F.concat(F.lit("u"), F.col("uc_id").cast("string")).alias("ident"), "geometry")
    units = by_size.unionByName(single)
    asked = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("identificador"))
    asked = asked.unionByName(single.select(F.col("ident").alias("identificador")))
    found = locate.unit_geometry(units, asked, "ident")
    return found.select("identificador", F.col("geometry").isNotNull().alias("ok"))


@query(
    "F19 F33",
    sql="""select p_partkey, case when p_name = 'red bolt' then 'Parafuso vermelho' else upper(left(p_name, 1)) || lower(substr(p_name, 2)) end as rotulo,
      case when p_size = 7 then 'Não informado' else replace(replace(replace(format('{:,.2f}', p_retailprice::decimal(12,2)::double * 1000), ',', 'X'), '.', ','), 'X', '.') end as valor from part""",
)
def display_labels(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    price = F.when(F.col("p_size") != 7, F.col("p_retailprice").cast("decimal(12,2)").cast("double") * 1000)
    return p.select(
        "p_partkey",
        tx.field_label(name, {"red_bolt": "Parafuso vermelho"}).alias("rotulo"),
        tx.display_number(price).alias("valor"),
    )


@query(
    "S6 S5 S8",
    sql="""select o_orderkey::varchar as ref_bacen, o_custkey::varchar as nu_ordem, o_orderstatus as cd_estado, 2021 as ano from orders""",
)
def read_operations_file(spark: SparkSession, sf: str) -> DataFrame:
    """Files with the exact 47-column header, written from orders and read strictly."""
    o = table(spark, sf, "orders")
    names = delimited.OPERATIONS_HEADER
    filled = {"#REF_BACEN": "o_orderkey", "NU_ORDEM": "o_custkey", "CD_ESTADO": "o_orderstatus"}
    columns = [
        (F.col(filled[n]).cast("string") if n in filled else F.lit("")).alias(n) for n in names
    ]
    path = f"{_folder(spark, 'ops')}/SICOR_OPERACAO_BASICA_ESTADO_2021.gz"
    o.select(*columns).write.option("sep", ";").option("header", True).option("compression", "gzip").option("emptyValue", "").csv(path)
    read = delimited.read_operations(spark, path)
    year = delimited.operations_year(F.lit(path))
    return read.select("ref_bacen", "nu_ordem", "cd_estado", year.alias("ano"))


# The writer puts a name that begins with # in quotes: two more characters.
_MONTHS = """select strftime(o_orderdate::date, '%Y%m') as mes, '{0}' as pasta, {1} + sum(length({2}) + 1)::bigint as expandido from orders group by 1"""


@query(
    "S3 S5 P3",
    sql=f"""with f as ({_MONTHS.format("gz", "strlen('#REF;ORDEM;ESTADO') + 3", "o_orderkey || ';' || o_custkey || ';' || o_orderstatus")}
      union all {_MONTHS.format("csv", "strlen('ref_bacen;ORDEM') + 1", "o_orderkey || ';' || o_custkey")})
    select mes, pasta, expandido, case when pasta = 'csv' then expandido end as bytes, case when pasta = 'csv' then 1.0::double end as taxa,
      case when pasta = 'csv' then 'ESTADO' else '' end as faltantes,
      concat_ws(',', case when pasta = 'csv' and expandido > 2000 then 'TAMANHO' end, case when expandido > 3000 then 'EXPANDIDO' end, case when pasta = 'csv' then 'COLUNAS' end) as motivos from f""",
)
def file_limits(spark: SparkSession, sf: str) -> DataFrame:
    """A compressed and a plain file per month against limits of size and required columns."""
    o = table(spark, sf, "orders")
    folder = _folder(spark, "limits")
    month = F.date_format("o_orderdate", "yyyyMM").alias("mes")
    key, order, state = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    for name, columns, kind in (
        ("gz", [key.alias("#REF"), order.alias("ORDEM"), state.alias("ESTADO")], "gzip"),
        ("csv", [key.alias("ref_bacen"), order.alias("ORDEM")], "none"),
    ):
        rows = o.select(month, *columns).repartition("mes")
        rows.write.partitionBy("mes").option("sep", ";").option("header", True).option("compression", kind).csv(f"{folder}/{name}")
    required = {"REF": ["ref_bacen"], "ORDEM": [], "ESTADO": ["cd_estado"]}
    found = [
        delimited.file_report(spark, f"{folder}/{name}", ";", required, limit, 3000).withColumn("pasta", F.lit(name))
        for name, limit in (("gz", None), ("csv", 2000))
    ]
    plain = F.col("pasta") == "csv"
    return found[0].unionByName(found[1]).select(
        F.regexp_extract("arquivo", "mes=([0-9]+)", 1).alias("mes"), "pasta", "expandido",
        F.when(plain, F.col("bytes")).alias("bytes"), F.when(plain, F.col("taxa")).alias("taxa"),
        F.array_join("faltantes", ",").alias("faltantes"), F.array_join("motivos", ",").alias("motivos"),
    )


@query(
    "D17 D6",
    sql="""select 'arq_' || lower(p_type) || '_' || p_partkey::varchar || '.zip' as arquivo, case when p_brand = 'Brand#1' then 'DIVERGENTE' else 'CONFERE' end as auditoria from part""",
)
def legacy_name_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Stored dataset of each file against the one its name tells."""
    p = table(spark, sf, "part")
    name = F.concat(F.lit("arq_"), F.lower("p_type"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".zip"))
    stored = p.select(name.alias("arquivo"), F.when(F.col("p_brand") == "Brand#1", "OUTRO").otherwise(F.col("p_type")).alias("dataset"))
    patterns = p.select(F.col("p_type").alias("dataset"), F.col("p_type").alias("padrao")).distinct()
    hits = identity.name_hits(stored.select("arquivo"), patterns)
    return status.legacy_audit(stored, hits).select("arquivo", "auditoria")


@query(
    "T10 D19",
    sql="""select left(md5(url), 1) as pasta, sum(strlen(concat_ws(' ', page_id::varchar, url, html)) + 1)::bigint as bytes from pages group by 1""",
)
def inbox_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Files dropped into source folders, claimed once by two runs of the stream."""
    p = table(spark, sf, "pages")
    folder = _folder(spark, "inbox")
    rows = p.select(F.substring(F.md5("url"), 1, 1).alias("fonte"), "page_id", F.concat_ws(" ", "page_id", "url", "html").alias("value"))
    # Several files per source folder, each with a share of its pages.
    rows.repartition("fonte", F.pmod(F.hash("page_id"), F.lit(8))).drop("page_id").write.partitionBy("fonte").text(f"{folder}/in")
    for _ in range(2):
        inbox.collect_batches(inbox.watch(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/cp")
    got = spark.read.parquet(f"{folder}/out").groupBy("pasta").agg(F.sum("bytes").alias("bytes"))
    return got.select(F.element_at(F.split("pasta", "="), -1).alias("pasta"), "bytes")
