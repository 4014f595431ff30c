"""Batch roll-ups, job decisions, unread counts and histories."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import hashing, text as tx
from ..operators import history, quality, status
from ..session import shared_folder
from . import roles
from .registry import query, table

_STATUS = "case when l_returnflag = 'R' and l_linestatus = 'F' then 'FALHOU' when l_returnflag = 'R' then 'PRONTO_IMPORTAR' when l_returnflag = 'N' and l_linestatus = 'O' and l_linenumber = 7 then 'PROCESSANDO' when l_returnflag = 'N' then 'SEM_ALTERACAO' else 'CONCLUIDO' end"
_ITEMS_SQL = f"""items as (select l_orderkey as lote_id, {roles.UF_LIST}[(l_orderkey % 27 + 1)::int] as uf, 'camada' || l_linenumber::varchar as dataset_slug, {_STATUS} as status,
    (l_quantity * 2)::bigint as progresso, l_shipdate as finalizado_em, case when l_tax > 0.07 then 1 else 0 end as nao_reparaveis, l_partkey * 1000 + l_suppkey as id from lineitem)"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as batch items: order is the batch, line number the layer."""
    li = table(spark, sf, "lineitem")
    r, s = F.col("l_returnflag"), F.col("l_linestatus")
    state = (
        F.when((r == "R") & (s == "F"), "FALHOU")
        .when(r == "R", "PRONTO_IMPORTAR")
        .when((r == "N") & (s == "O") & (F.col("l_linenumber") == 7), "PROCESSANDO")
        .when(r == "N", "SEM_ALTERACAO")
        .otherwise("CONCLUIDO")
    )
    uf = F.element_at(F.array(*map(F.lit, tx.UF_CODES)), (F.col("l_orderkey") % 27 + 1).cast("int"))
    return li.select(
        F.col("l_orderkey").alias("lote_id"), uf.alias("uf"),
        F.concat(F.lit("camada"), F.col("l_linenumber").cast("string")).alias("dataset_slug"),
        state.alias("status"), (F.col("l_quantity") * 2).cast("bigint").alias("progresso"),
        F.col("l_shipdate").alias("finalizado_em"),
        F.when(F.col("l_tax") > 0.07, 1).otherwise(0).alias("nao_reparaveis"),
        (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("id"),
    )


@query(
    "A14 R8 R14",
    sql=f"""with {_ITEMS_SQL}, c as (select lote_id, count(*) as itens, count(*) filter (status = 'PROCESSANDO') as pendentes, count(*) filter (status in ('CONCLUIDO', 'SEM_ALTERACAO')) as concluidos,
        count(*) filter (status = 'FALHOU') as falhas, count(*) filter (status = 'PRONTO_IMPORTAR') as prontos, sum(progresso)::bigint as total from items group by 1)
    select lote_id, itens, concluidos, round_even(total / itens, 0)::int as progresso,
      case when pendentes > 0 then case when lote_id % 2 = 0 then 'ANALISANDO' else 'PROCESSANDO' end
        when lote_id % 2 = 0 and prontos > 0 then 'AGUARDANDO_CONFIRMACAO' when falhas > 0 or prontos > 0 then 'CONCLUIDO_COM_PENDENCIAS' else 'CONCLUIDO' end as situacao,
      itens = 4 and pendentes = 0 as completo from c""",
    bench=True,
)
def batch_status(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf)
    counts = status.batch_counts(items)
    phase = F.when(F.col("lote_id") % 2 == 0, "ANALISE").otherwise("IMPORTACAO")
    rows = counts.select(
        "lote_id",
        "itens",
        "concluidos",
        status.batch_progress().alias("progresso"),
        status.batch_status(phase, F.lit(False), F.lit(False), F.lit(0)).alias("situacao"),
    )
    expected = items.select("lote_id", F.lit(4).alias("esperados")).distinct()
    return rows.join(status.sequence_complete(expected, items), "lote_id")


@query(
    "A15 A17",
    sql=f"""with {_ITEMS_SQL}, r as (select uf, case when bool_or(status = 'PROCESSANDO') then 'PROCESSANDO' when bool_or(status = 'FALHOU') then 'FALHOU'
        when sum(nao_reparaveis) > 0 then 'ATENCAO' when bool_or(status = 'PRONTO_IMPORTAR') then 'EM_FILA' when bool_or(status = 'CONCLUIDO') then 'ATUALIZADO' else 'SEM_ALTERACAO' end as s,
        max(finalizado_em) filter (status in ('CONCLUIDO', 'SEM_ALTERACAO'))::varchar as v, max(finalizado_em) filter (status = 'CONCLUIDO')::varchar as a, count(distinct dataset_slug) as n from items group by 1)
    select u.uf, coalesce(s, 'NUNCA_IMPORTADO') as status, coalesce(n, 0) as camadas_registradas, 9 as camadas_esperadas, left(v, 10) as verificada, left(a, 10) as atualizada
    from (select unnest({roles.UF_LIST}) as uf) u left join r on r.uf = u.uf""",
)
def state_rollup(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf)
    states = status.state_rollup(items)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    times = states.select(
        "uf", day("ultima_verificacao").alias("verificada"), day("ultima_atualizacao").alias("atualizada")
    )
    return status.state_coverage(states, items).join(times, "uf", "left")


@query(
    "A16",
    sql="""select o_custkey, sum(o_orderkey % 5)::bigint as pendencias_geometria, sum(o_orderkey % 3)::bigint as pendencias_temporais,
      sum(o_orderkey % 4 + case when o_orderstatus = 'F' then o_orderkey % 7 else 0 end)::bigint as pendencias_datas from orders group by 1""",
)
def warning_totals(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    profile = F.struct(
        (k % 4).alias("nao_reconhecidos"),
        (k % 7).alias("ambiguos"),
        F.when(F.col("o_orderstatus") != "F", "DMY").alias("preferencia_ambiguos"),
    )
    report = F.to_json(
        F.struct(
            F.struct((k % 5).alias("nao_reparaveis")).alias("reparo_geometrias"),
            F.struct((k % 3).alias("registros_ano_invalido")).alias("filtro_prodes"),
            F.create_map(F.lit("data"), profile).alias("normalizacao_datas"),
        )
    )
    return status.warning_totals(o.select("o_custkey", report.alias("resultado")), "o_custkey", "resultado")


@query(
    "A18",
    sql="""select area, count(*) as fontes, count(*) filter (p_size > 20) as implementadas, count(*) filter (p_size <= 20) as planejadas, count(*) filter (p_type = 'ECONOMY') as prioridade_alta
      from (select *, unnest(string_split(p_name, ' ')) as area from part) group by 1""",
)
def source_summary(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("slug"),
        F.when(F.col("p_type") == "ECONOMY", "ALTA").otherwise("MEDIA").alias("prioridade"),
        (F.col("p_size") > 20).alias("implementada"),
        F.split("p_name", " ").alias("areas"),
    )
    return status.source_summary(p)


@query(
    "A25 T14",
    sql="""select conv_id, count(*) filter (role = 'user' and turn % 3 <> 0) as nao_lidas, md5(arg_max(text, turn)) as ultima, max(turn) as ultima_ordem from conversations group by 1""",
)
def unread_messages(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(
        "conv_id",
        F.when(F.col("role") == "user", "cliente").otherwise("equipe").alias("autor"),
        (F.col("turn") % 3 == 0).alias("lida"),
        F.col("text").alias("texto"),
        F.col("turn").alias("ordem"),
    )
    out = status.unread(c, "conv_id")
    return out.select("conv_id", "nao_lidas", F.md5("ultima_mensagem").alias("ultima"), "ultima_ordem")


@query(
    "J17 T14",
    sql="""select n.n_nationkey as aviso, s.s_suppkey as usuario, exists (select 1 from customer c where c.c_nationkey = n.n_nationkey and c.c_custkey = s.s_suppkey) as lido
      from nation n join supplier s on s.s_nationkey = n.n_nationkey where n.n_regionkey <> 2""",
)
def notice_read_flags(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("aviso"), F.col("n_nationkey").alias("publico"), "n_regionkey"
    )
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("usuario"), F.col("s_nationkey").alias("publico"))
    reads = table(spark, sf, "customer").select(F.col("c_nationkey").alias("aviso"), F.col("c_custkey").alias("usuario"))
    shown = status.with_read_flag(n, s, reads, F.col("n_regionkey") != 2)
    return shown.select("aviso", "usuario", "lido")


@query(
    "T11 T12",
    sql="""with i as (select o_orderkey as id, o_orderpriority as fonte, o_custkey as dataset, o_orderstatus, case when o_orderstatus = 'P' and o_orderdate < timestamp '2000-01-01' - interval 120 minute then true else false end as rec from orders),
    q as (select *, row_number() over (partition by fonte, dataset order by id) as vez from i where o_orderstatus = 'O' or rec)
    select id, fonte, dataset, rec as recuperado from q where vez = 1""",
)
def claimable_items(spark: SparkSession, sf: str) -> DataFrame:
    """Stale items return to the queue, then one open item per source and dataset is next."""
    o = table(spark, sf, "orders")
    items = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("fonte"), F.col("o_custkey").alias("dataset"),
        F.lit("").alias("uf"), F.col("o_orderdate").alias("iniciado_em"),
        F.when(F.col("o_orderstatus") == "P", "PROCESSANDO").when(F.col("o_orderstatus") == "O", "PENDENTE").otherwise("CONCLUIDO").alias("status"),
    )
    back = status.recovered(items, F.lit("2000-01-01").cast("timestamp_ntz"))
    return status.claim_order(back).select("id", "fonte", "dataset", "recuperado")


@query(
    "T13",
    sql="""select c_custkey as agenda from customer where (c_custkey % 24) * 60 + c_custkey % 60 <= 630
      and not exists (select 1 from orders where o_custkey = c_custkey and o_orderdate::date = date '1998-10-03')""",
)
def due_schedules(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    k = F.col("c_custkey")
    agenda = c.select(k.alias("agenda"), (k % 24).alias("hora"), (k % 60).alias("minuto"))
    done = o.select(F.col("o_custkey").alias("agenda"), F.col("o_orderdate").alias("executado_em"))
    now = F.lit("1998-10-03 10:30:00").cast("timestamp")
    return status.due_schedules(agenda, done, now).select("agenda")


@query(
    "R13 D20",
    sql="""select c_custkey as dataset, case when exists (select 1 from orders where o_custkey = c_custkey and o_orderdate::date = date '1998-10-03') then 'IGNORADA_HOJE'
      when c_acctbal < 0 then 'SEM_FONTE_AUTOMATICA' when exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') then 'JA_ATIVA' else 'ENFILEIRADA' end as decisao from customer""",
)
def daily_sync_plan(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    layers = c.select(F.col("c_custkey").alias("dataset"), (F.col("c_acctbal") >= 0).alias("automatica"))
    checked = o.select(F.col("o_custkey").alias("dataset"), F.col("o_orderdate").alias("validado_em"), "o_orderstatus")
    today = F.lit("1998-10-03").cast("date")
    fresh = history.fresh_today(checked, today, F.lit(True)).where("pular")
    plan = status.sync_plan(layers, fresh, checked.where("o_orderstatus = 'P'"))
    return plan.select("dataset", "decisao")


@query(
    "R12",
    sql="""with j as (select o_orderkey as job_id, o_custkey % 1600 as lote_id, case when o_orderkey % 2 = 0 then 'ANALISE' else 'IMPORTACAO' end as fase from orders),
    b as (select c_custkey as lote_id, c_nationkey * 4 as progresso, case c_mktsegment when 'BUILDING' then 'CONCLUIDO' when 'MACHINERY' then 'AGUARDANDO_CONFIRMACAO' else 'PROCESSANDO' end as s,
        case when c_acctbal < 0 then 1 else 0 end as falhas, c_custkey % 2 as alterados from customer)
    select job_id, case when s is null then 'SEM_LOTE' when falhas > 0 then 'FALHOU' when s = 'AGUARDANDO_CONFIRMACAO' then 'ALTERACAO_DETECTADA'
        when s = 'CONCLUIDO' and alterados > 0 then 'ATUALIZADO' when s = 'CONCLUIDO' then 'SEM_ALTERACAO' else 'EM_ANDAMENTO' end as resultado,
      case when s = 'CONCLUIDO' then 100 when fase = 'ANALISE' then 80 + progresso * 10 // 100 else 90 + progresso * 9 // 100 end::int as progresso
    from j left join b using (lote_id)""",
)
def collection_jobs(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    jobs = o.select(
        F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 1600).alias("lote_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "ANALISE").otherwise("IMPORTACAO").alias("fase"),
    )
    batches = c.select(
        F.col("c_custkey").alias("lote_id"), (F.col("c_nationkey") * 4).alias("progresso"),
        F.when(F.col("c_mktsegment") == "BUILDING", "CONCLUIDO").when(F.col("c_mktsegment") == "MACHINERY", "AGUARDANDO_CONFIRMACAO").otherwise("PROCESSANDO").alias("lote_status"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("falhas"), (F.col("c_custkey") % 2).alias("alterados"),
    )
    return status.collection_status(jobs, batches)


@query(
    "R11",
    sql="""with live as (select o_custkey as perfil, o_orderpriority as plano, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as reutilizar from orders
        where o_orderstatus = 'O' and o_orderdate > timestamp '2000-06-01' group by 1, 2),
    p as (select c_custkey as perfil, case when c_acctbal < 0 then '1-URGENT' else '5-LOW' end as plano from customer)
    select p.perfil, p.plano, reutilizar, p.perfil not in (select perfil from live) as pode_criar from p left join live using (perfil, plano)""",
)
def checkout_permission(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    profiles = c.select(
        F.col("c_custkey").alias("perfil"), F.when(F.col("c_acctbal") < 0, "1-URGENT").otherwise("5-LOW").alias("plano")
    )
    opened = o.select(
        F.col("o_custkey").alias("perfil"), F.col("o_orderpriority").alias("plano"), F.col("o_orderkey").alias("checkout"),
        F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("PAID").alias("status"),
        F.col("o_orderdate").alias("expira_em"), F.struct("o_orderdate", "o_orderkey").alias("criado_em"),
    )
    return status.checkout_allowed(profiles, opened, F.lit("2000-06-01").cast("timestamp_ntz"))


@query(
    "W3 D12",
    sql="""select conv_id, turn, lag(turn) over (partition by conv_id, role order by turn) as turn_anterior from conversations""",
)
def earlier_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return quality.earlier_same(c, ["conv_id", "role"], "turn", "turn").drop("role")


@query(
    "D12 D11",
    sql="""with f as (select o_orderkey as id, o_orderpriority as uf, md5(o_custkey::varchar || o_orderstatus) as h from orders),
    n as (select h, count(distinct uf) as estados from f group by 1)
    select id, estados from f join n using (h)""",
)
def same_content_states(spark: SparkSession, sf: str) -> DataFrame:
    """How many states received the same content."""
    o = table(spark, sf, "orders")
    f = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("uf"),
        F.md5(F.concat(F.col("o_custkey").cast("string"), "o_orderstatus")).alias("h"),
    )
    per = f.groupBy("h").agg(F.count_distinct("uf").alias("estados"))
    return f.join(per, "h").select("id", "estados")


@query(
    "D22",
    sql="""select case when c_mktsegment = 'BUILDING' then c_custkey else c_custkey end as dataset, case when c_mktsegment = 'BUILDING' and c_acctbal >= 0 then '2024-02-01' else '2024-01-01' end as data_remota from customer""",
)
def confirmed_versions(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    old = c.select(F.col("c_custkey").alias("dataset"), F.lit("2024-01-01").alias("data_remota"))
    new = c.where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("dataset"), F.when(F.col("c_acctbal") >= 0, "2024-02-01").otherwise(" ").alias("data_remota")
    )
    return history.record_version(old, new)


@query(
    "D21",
    sql=f"""with files as (select 'sicar_app_' || {roles.UF_LIST}[(o_custkey % 27 + 1)::int] || '_' || o_orderkey::varchar || '.zip' as arquivo, {roles.UF_LIST}[(o_custkey % 27 + 1)::int] as uf, o_orderdate as m from orders)
    select 'app' as dataset, uf, arg_max(arquivo, (m, arquivo)) as arquivo from files group by 2""",
)
def newest_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Newest listed file per dataset and state."""
    o = table(spark, sf, "orders")
    uf = F.element_at(F.array(*map(F.lit, tx.UF_CODES)), (F.col("o_custkey") % 27 + 1).cast("int"))
    name = F.concat(F.lit("sicar_app_"), uf, F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".zip"))
    listing = o.select(name.alias("arquivo"), F.col("o_orderdate").alias("modificado"))
    wanted = o.select(F.lit("app").alias("dataset"), F.lit("SICAR_APP").alias("base_nome"), uf.alias("uf")).distinct()
    return history.newest_snapshot(listing, wanted)


@query(
    "K14 D16 K13",
    sql=f"""with {roles.MESSY_SQL}, k as (select regexp_full_match(trim(raw_key), '[0-9]+(\\.0+)?') as ok from messy)
    select count(*) as esperados, count(*) filter (ok) as gravados, count(*) = count(*) filter (ok) as completo from k""",
)
def quarantined_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed rows and quarantined rows written apart, then counted against the input."""
    m = roles.messy_orders(spark, sf)
    keyed = m.withColumn("seq_tad", tx.integer_key(F.col("raw_key")))
    folder = f"{shared_folder(spark)}/snap-{uuid.uuid4().hex}"
    keyed.where("seq_tad <> ''").write.mode("overwrite").parquet(f"{folder}/dados")
    bad = keyed.where("seq_tad = ''").withColumn("motivo", F.lit("SEM_CHAVE"))
    bad.write.mode("overwrite").parquet(f"{folder}/quarentena")
    return quality.completeness(m, spark.read.parquet(f"{folder}/dados"))


@query(
    "F26",
    sql="""with f as (select l_orderkey, list_sort(list_distinct(list('"campo' || l_linenumber::varchar || ':' || l_returnflag || '"'))) as f from lineitem group by 1)
    select l_orderkey, sha256('{"fields":[' || array_to_string(f, ',') || '],"geometry_type":"MultiPolygon","crs":"EPSG:4674"}') as assinatura from f""",
)
def structure_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Signature per order of its lines' fields and types."""
    li = table(spark, sf, "lineitem")
    per = li.groupBy("l_orderkey").agg(
        F.collect_set(F.concat_ws(":", F.concat(F.lit("campo"), F.col("l_linenumber").cast("string")), "l_returnflag")).alias("f")
    )
    sig = hashing.structure_signature(F.col("f"), F.lit("MultiPolygon"), F.lit("EPSG:4674"))
    return per.select("l_orderkey", sig.alias("assinatura"))
