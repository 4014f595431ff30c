"""Snapshots, merges, guards, diffs and fingerprints on two versions of orders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import hashing
from ..operators import publish
from ..session import shared_folder
from . import roles
from .registry import query, table


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Old: orders before 2000. New: orders not yet filled, urgent ones repriced."""
    o = table(spark, sf, "orders")
    uf = F.element_at(F.array(*map(F.lit, roles.tx.UF_CODES)), (F.col("o_custkey") % 25 + 1).cast("int"))
    price = F.col("o_totalprice").cast("decimal(12,2)")
    base = o.select(
        F.concat_ws("-", uf, F.col("o_orderkey").cast("string")).alias("cod"),
        "o_orderkey",
        uf.alias("uf"),
        price.alias("valor"),
        F.year("o_orderdate").alias("ano"),
        "o_orderstatus",
        "o_orderpriority",
        "o_orderdate",
    )
    raised = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("valor") + 10).otherwise(F.col("valor"))
    old = base.where("o_orderdate < '2000-01-01'").select("cod", "uf", "valor", "ano")
    new = base.where("o_orderstatus <> 'F'").select(
        "cod", "uf", raised.cast("decimal(12,2)").alias("valor"), "ano"
    )
    return old, new


VERSIONS_SQL = f"""
base as (
  select {roles.UF_LIST}[(o_custkey % 25 + 1)::int] || '-' || o_orderkey::varchar as cod, {roles.UF_LIST}[(o_custkey % 25 + 1)::int] as uf,
    o_totalprice::decimal(12,2) as v, year(o_orderdate) as ano, o_orderstatus, o_orderpriority, o_orderdate from orders),
old as (select cod, uf, v as valor, ano from base where o_orderdate < timestamp '2000-01-01'),
new as (select cod, uf, case when o_orderpriority = '1-URGENT' then v + 10 else v end as valor, ano from base where o_orderstatus <> 'F')
"""


def _show(df: DataFrame) -> DataFrame:
    return df.select("cod", "uf", F.col("valor").cast("double").alias("valor"), "ano")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "K4 J13",
    sql=f"""with {VERSIONS_SQL}, border as (select distinct cod from new where uf <> 'PE')
    select cod, uf, valor::double as valor, ano from old where uf <> 'PE' and cod not in (select cod from border)
    union all select cod, uf, valor::double, ano from new""",
    bench=True,
)
def publish_state_merge(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _versions(spark, sf)
    return _show(publish.merge_state(old, new, "cod", "PE"))


@query(
    "K5 J13",
    sql=f"""with {VERSIONS_SQL}
    select cod, uf, valor::double as valor, ano from old where cod not in (select cod from new)
    union all select cod, uf, valor::double, ano from new""",
)
def publish_key_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _versions(spark, sf)
    return _show(publish.upsert_by_key(old, new, "cod"))


@query(
    "K2 K6",
    sql=f"""with {VERSIONS_SQL}
    select cod, uf, valor::double as valor, ano from old where uf <> 'BA' and uf is not null
    union all select cod, 'BA', valor::double, ano from new where uf = 'BA'""",
)
def publish_partition(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _versions(spark, sf)
    legacy = old.withColumn("uf", F.when(F.col("ano") > 0, F.col("uf")))
    return _show(publish.replace_partition(legacy, new.where("uf = 'BA'"), {"uf": "BA"}))


@query(
    "K3",
    sql=f"""with {VERSIONS_SQL}, years as (select distinct ano from new where ano >= 1999)
    select cod, uf, valor::double as valor, ano from old where ano not in (select ano from years)
    union all select cod, uf, valor::double, ano from new where ano >= 1999""",
)
def publish_years(spark: SparkSession, sf: str) -> DataFrame:
    """Written table: the years of the new load replace theirs, others stay."""
    old, new = _versions(spark, sf)
    path = _folder(spark, "years")
    publish.write_partitions(old, path, ["ano"])
    publish.write_partitions(new.where("ano >= 1999"), path, ["ano"])
    return _show(spark.read.parquet(path))


@query(
    "K1 K7 K8 K10",
    sql=f"""with {VERSIONS_SQL}
    select cod, uf, valor::double as valor, ano, null::varchar as fonte from old where cod not in (select cod from new)
    union all select cod, uf, valor::double, ano, 'nova' from new""",
)
def publish_version(spark: SparkSession, sf: str) -> DataFrame:
    """Two commits; the second has one more column. Reads follow the manifest."""
    old, new = _versions(spark, sf)
    root = _folder(spark, "store")
    publish.publish_tables(spark, root, {"raw": old, "operacional": old}, 1)
    current = publish.read_table(spark, root, "operacional")
    merged = publish.upsert_by_key(current, new.withColumn("fonte", F.lit("nova")), "cod")
    publish.publish_tables(spark, root, {"raw": new, "operacional": merged}, 2)
    final = publish.read_table(spark, root, "operacional")
    return _show(final).join(final.select("cod", "fonte"), "cod")


@query(
    "K9 F28",
    sql=f"""with {VERSIONS_SQL}, b as (select count(*) as x from old), n as (select count(*) as y from new)
    select x as registros_base_atual, y as registros_nova_versao, y - x as diferenca_registros,
      round((y - x) / x * 100, 2) as diferenca_percentual, x > 0 and y < x as reducao_detectada from b, n""",
)
def reduction_guard(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _versions(spark, sf)
    return publish.compare_counts(old, new)


@query(
    "J14 U6 F22",
    sql=f"""with {VERSIONS_SQL}
    select coalesce(old.cod, new.cod) as cod, case when old.cod is null then 'NOVO' when new.cod is null then 'REMOVIDO'
      when old.valor <> new.valor then 'ALTERADO' else 'IGUAL' end as situacao
    from old full join new on old.cod = new.cod""",
    bench=True,
)
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _versions(spark, sf)
    return publish.diff(old, new, "cod", ["cod", "uf", "valor", "ano"])


@query(
    "F23 A22 F24 F22 D10",
    sql="""with h as (select md5(concat_ws(chr(31), l_orderkey::varchar, l_linenumber::varchar, l_returnflag, l_quantity::bigint::varchar)) as h, count(*) as n
      from lineitem group by 1),
    p as (select left(h, 4) as p, sha256(string_agg(h || ':' || n::varchar, chr(10) order by h || ':' || n::varchar)) as d, sum(n)::bigint as n from h group by 1)
    select sha256(concat_ws(chr(10), string_agg(p || ':' || d, chr(10) order by p || ':' || d), 'rows=' || sum(n)::bigint::varchar)) as sha256,
      sum(n)::bigint as registros from p""",
    bench=True,
)
def dataset_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").withColumn("q", F.col("l_quantity").cast("bigint"))
    return hashing.dataset_fingerprint(li, ["l_orderkey", "l_linenumber", "l_returnflag", "q"])


@query(
    "F25 D13 D19",
    sql="""with r as (select o_custkey, o_orderpriority as k, max(case when o_orderstatus <> 'P' then sha256(o_orderkey::varchar) end) as h
      from orders group by 1, 2)
    select o_custkey, sha256(string_agg(k || ':' || coalesce(h, 'MISSING'), '|' order by k || ':' || coalesce(h, 'MISSING'))) as assinatura
    from r group by 1""",
)
def resource_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """One signature per source from its few resources; a source has at most five."""
    o = table(spark, sf, "orders")
    h = F.when(F.col("o_orderstatus") != "P", F.sha2(F.col("o_orderkey").cast("string"), 256))
    r = o.groupBy("o_custkey", F.col("o_orderpriority").alias("k")).agg(F.max(h).alias("h"))
    per = r.groupBy("o_custkey").agg(F.collect_list(F.struct("k", "h")).alias("e"))
    sig = hashing.resource_signature(
        F.transform("e", lambda e: e["k"]), F.transform("e", lambda e: e["h"])
    )
    return per.select("o_custkey", sig.alias("assinatura"))


# The catalogue: each customer is a source card, its segment the source, the sign of its balance the status.
def _catalogue(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_mktsegment").alias("fonte"),
        F.col("c_name").alias("nome_tabela"),
        F.when(F.col("c_acctbal") < 0, "REMOVIDA").otherwise("ATIVA").alias("status"),
        F.md5("c_name").alias("fingerprint"),
    )


_CATALOGUE_SQL = """catalogue as (select c_mktsegment as fonte, c_name as nome_tabela,
  case when c_acctbal < 0 then 'REMOVIDA' else 'ATIVA' end as status, md5(c_name) as fingerprint from customer)"""


@query(
    "S15 S16",
    sql=f"""with {_CATALOGUE_SQL}, wanted as (select 'FURNITURE' as fonte, c_name as nome_tabela from customer)
    select w.*, exists (select 1 from catalogue c where c.fonte = w.fonte and c.nome_tabela = w.nome_tabela and c.status = 'ATIVA') as disponivel
    from wanted w""",
)
def layer_availability(spark: SparkSession, sf: str) -> DataFrame:
    c = _catalogue(spark, sf)
    wanted = c.select(F.lit("FURNITURE").alias("fonte"), "nome_tabela")
    marked = publish.active_layers(c, wanted)
    return publish.existing_columns(marked, ["fonte", "nome_tabela", "ausente", "disponivel"])


@query(
    "K11 K12 K18",
    sql=f"""with {_CATALOGUE_SQL}
    select 'sistema' as usuario, 'LIMPAR_FONTE' as acao, 'Camada' as entidade, nome_tabela as identificador,
      '{{"status":"' || case when fonte = 'BUILDING' then 'PENDENTE_REVISAO' else status end || '"' ||
      case when fonte = 'BUILDING' then '' else ',"fingerprint":"' || fingerprint || '"' end || '}}' as detalhes
    from catalogue""",
)
def clear_source_with_audit(spark: SparkSession, sf: str) -> DataFrame:
    cleared = publish.clear_source(_catalogue(spark, sf), "BUILDING")
    return publish.audit_entry(
        cleared, F.lit("sistema"), "LIMPAR_FONTE", "Camada", F.col("nome_tabela"), F.struct("status", "fingerprint")
    )


@query(
    "S17",
    sql="select 4326 as srid, true as unico",
)
def effective_srid(spark: SparkSession, sf: str) -> DataFrame:
    return publish.table_srid(roles.alerts_layer(spark, sf))


@query(
    "J20 D10 D11 W2",
    sql="""with imports as (select event_id, user_id, event_type, ts, md5(event_type || (event_id % 7)::varchar) as fp from events)
    select event_id, max(anterior) as anterior from (
      select a.event_id, first_value(b.event_id) over (partition by a.event_id order by b.ts desc) as anterior
      from imports a left join imports b on a.user_id = b.user_id and a.fp = b.fp and b.ts < a.ts) group by 1""",
)
def previous_same_content(spark: SparkSession, sf: str) -> DataFrame:
    """Newest earlier import of a dataset with the same content."""
    e = table(spark, sf, "events")
    fp = F.md5(F.concat("event_type", (F.col("event_id") % 7).cast("string")))
    imports = e.select("event_id", "user_id", fp.alias("fp"), "ts")
    from ..operators import history

    return history.previous_equal(imports, ["user_id", "fp"], "event_id", "ts").select(
        "event_id", "anterior"
    )
