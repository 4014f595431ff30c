"""Billing events, coupons, access and limits on the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import billing
from ..session import shared_folder
from ..streaming import billing as live
from .registry import query, table

_K = "json_extract(props, '$.k')::int"


def _events(events: DataFrame) -> DataFrame:
    """Events read as billing events: kind by type, payment by user and k."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = (
        F.when(F.col("event_type") == "signup", "CHECKOUT_PAID")
        .when(F.col("event_type") == "purchase", "PAYMENT_CONFIRMED")
        .when(F.col("event_type") == "view", "PAYMENT_OVERDUE")
        .when(F.col("event_type") == "click", "SUBSCRIPTION_UPDATED")
        .when(k < 20, "SUBSCRIPTION_INACTIVATED")
        .otherwise("PAYMENT_REFUNDED")
    )
    return events.select(
        "event_id",
        F.col("user_id").alias("perfil"),
        "ts",
        kind.alias("kind"),
        F.concat_ws("-", F.lit("pay"), F.col("user_id").cast("string"), k.cast("string")).alias("object_id"),
        F.to_date("ts").alias("day"),
        F.date_add(F.to_date("ts"), k % 30).alias("due"),
        F.when(k % 2 == 0, "ACTIVE").otherwise("expired").alias("remote"),
        F.when(k > 60, "YEARLY").otherwise("MONTHLY").alias("cycle"),
        F.when(k > 80, "YEARLY_INSTALLMENT").when(k > 60, "YEARLY_CASH").otherwise("MONTHLY").alias("mode"),
    )


@query("T3 T4 T9", bench=True)
def subscription_states(spark: SparkSession, sf: str) -> DataFrame:
    """Fold of all billing events per profile; tested against the stream and by hand."""
    return billing.fold_subscriptions(_events(table(spark, sf, "events")))


@query("T1 T3 T4")
def subscription_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same states from streams drained with availableNow: unique events first, then the fold.

    Every event comes twice; ids are remembered across micro-batches by the first stream.
    """
    raw = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    twice = raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    folder = f"{shared_folder(spark)}/sub-{uuid.uuid4().hex}"
    once = live.unique_stream(twice.drop("copy"), "60 days")
    live.drain(once, f"{folder}/unique", f"{folder}/cp-unique")
    unique = spark.readStream.schema(once.schema).parquet(f"{folder}/unique")
    states = live.subscription_stream(_events(unique))
    live.write_updates(states, f"{folder}/out", f"{folder}/cp")
    return live.latest_updates(spark, f"{folder}/out", "perfil")


@query(
    "T1",
    sql="select event_type, count(*) as n, count(distinct event_id) as ids from events group by 1",
)
def unique_event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Every event sent twice through the stream, kept once."""
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    raw = raw.withColumn("ts", F.col("ts").cast("timestamp"))
    twice = raw.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    folder = f"{shared_folder(spark)}/uniq-{uuid.uuid4().hex}"
    live.drain(live.unique_stream(twice, "60 days"), f"{folder}/out", f"{folder}/cp")
    kept = spark.read.parquet(f"{folder}/out")
    return kept.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids")
    )


@query(
    "T1 U7",
    sql="select event_id, user_id, event_type from events",
)
def unique_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    again = e.withColumn("ts", F.col("ts") + F.expr("interval 1 hour")).withColumn("event_type", F.lit("x"))
    return billing.unique_events(e.unionByName(again)).drop("ts")


@query(
    "T8",
    sql=f"""with p as (select 'pay-' || user_id::varchar || '-' || {_K}::varchar as payment_id, ts, event_type, value,
        (ts::date + ({_K} % 30)::int)::varchar as due from events where event_type in ('purchase', 'view'))
    select payment_id, arg_max(event_type, ts) as status, arg_max(value, ts) as valor, arg_max(due, ts) as vencimento,
      bool_or(event_type = 'purchase') as acesso_aplicado, count(*) as eventos from p group by 1""",
)
def latest_payments(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type in ('purchase', 'view')")
    b = _events(e).join(e.select("event_id", "event_type", "value"), "event_id")
    rows = b.select(
        F.col("object_id").alias("payment_id"), F.col("event_type").alias("status"), "value",
        F.col("due").cast("string").alias("due"), "ts", "kind",
    )
    return billing.latest_payments(rows)


@query(
    "F13 F14 F17",
    sql="""select o_orderkey, (o_orderdate::date + interval 1 month)::date::varchar as mensal, (o_orderdate::date + interval 1 year)::date::varchar as anual,
      (o_orderdate::date + 5)::varchar as carencia, case when o_custkey % 15 between 1 and 12 then o_custkey % 15 end as parcelas from orders""",
)
def billing_calendar(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    return o.select(
        "o_orderkey",
        billing.add_cycle(day, F.lit("MONTHLY")).cast("string").alias("mensal"),
        billing.add_cycle(day, F.lit("YEARLY")).cast("string").alias("anual"),
        billing.grace_until(day).cast("string").alias("carencia"),
        billing.valid_instalments(F.col("o_custkey") % 15, F.lit(12)).alias("parcelas"),
    )


@query(
    "F15 F16",
    sql="""with p as (select p_partkey, round(p_retailprice * 100)::bigint as cents, case when p_size % 2 = 0 then 'PERCENTUAL' else 'FIXO' end as kind,
        p_size * 250 as v from part),
    d as (select *, case when kind = 'PERCENTUAL' then case when v > 0 and v <= 10000 then (cents * v + 5000) // 10000 end
        else least(v, cents) end as off from p)
    select p_partkey, off / 100.0::double as desconto, greatest(0, cents - off) / 100.0::double as final,
      cents * case when p_partkey % 3 = 0 then 12 else 10 end / 100.0::double as valor_anual,
      cents * case when p_partkey % 3 = 0 then 0 else 2 end / 100.0::double as economia from d""",
)
def prices_and_coupons(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    price = F.col("p_retailprice").cast("decimal(10,2)")
    kind = F.when(F.col("p_size") % 2 == 0, "PERCENTUAL").otherwise("FIXO")
    value = (F.col("p_size") * F.lit(2.5).cast("decimal(3,1)")).cast("decimal(10,2)")
    off = billing.coupon_discount(price, kind, value)
    yearly = F.when(F.col("p_partkey") % 3 != 0, (price * 10).cast("decimal(12,2)"))
    plan = billing.plan_prices(price, yearly)
    return p.select(
        "p_partkey",
        off.cast("double").alias("desconto"),
        F.greatest(price - off, F.lit(0)).cast("double").alias("final"),
        plan["valor_anual"].cast("double").alias("valor_anual"),
        plan["economia"].cast("double").alias("economia"),
    )


_NOW = "timestamp '2024-01-20 00:00:00'"


@query(
    "A24 T6",
    sql=f"""with u as (select user_id % 40 as cupom, case event_type when 'purchase' then 'CONSUMED' when 'error' then 'RELEASED' else 'RESERVED' end as status,
        case when event_type <> 'view' then ts + interval 3 day end as expira_em from events)
    select cupom, count(*) filter (status = 'CONSUMED') as consumidos,
      count(*) filter (status = 'RESERVED' and (expira_em is null or expira_em > {_NOW})) as reservados,
      case when cupom % 10 = 0 then 'INATIVO' when cupom % 7 = 0 then 'NAO_MENSAL'
        when greatest(cupom, count(*) filter (status = 'CONSUMED')) + count(*) filter (status = 'RESERVED' and (expira_em is null or expira_em > {_NOW})) >= cupom * 10
        then 'ESGOTADO' else 'OK' end as situacao
    from u group by 1""",
)
def coupon_capacity(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    status = (
        F.when(F.col("event_type") == "purchase", "CONSUMED")
        .when(F.col("event_type") == "error", "RELEASED")
        .otherwise("RESERVED")
    )
    uses = e.select(
        (F.col("user_id") % 40).alias("cupom"),
        status.alias("status"),
        F.when(F.col("event_type") != "view", F.col("ts") + F.expr("interval 3 days")).alias("expira_em"),
    )
    used = billing.coupon_usage(uses, now).withColumns(
        {
            "ativo": F.col("cupom") % 10 != 0,
            "validade_inicio": F.lit(None).cast("timestamp"),
            "validade_fim": F.lit(None).cast("timestamp"),
            "aplica_mensal": F.col("cupom") % 7 != 0,
            "aplica_anual": F.lit(True),
            "quantidade_usos": F.col("cupom"),
            "limite_total_usos": F.col("cupom") * 10,
        }
    )
    return used.select(
        "cupom", "consumidos", "reservados", billing.coupon_state(now, F.lit("MONTHLY")).alias("situacao")
    )


@query(
    "T6",
    sql=f"""with c as (select user_id as checkout, event_type, ts, {_K} as k,
        case event_type when 'purchase' then 'CHECKOUT_PAID' when 'error' then 'CHECKOUT_CANCELED' else 'CHECKOUT_CREATED' end as evento from events)
    select checkout, arg_min(evento, ts) filter (evento <> 'CHECKOUT_CREATED') as decisao, count(*) filter (evento = 'CHECKOUT_PAID') as pagos,
      arg_max(k, ts) filter (k <= 12) as parcelas,
      case when arg_min(evento, ts) filter (evento <> 'CHECKOUT_CREATED') = 'CHECKOUT_PAID' then 'CONSUMED' else 'RELEASED' end as status
    from c group by 1""",
)
def coupon_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Paid, canceled or open reservations; a second payment consumes nothing."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    rows = e.select(
        F.col("user_id").alias("checkout"),
        F.when(F.col("event_type") == "purchase", "CHECKOUT_PAID")
        .when(F.col("event_type") == "error", "CHECKOUT_CANCELED")
        .otherwise("CHECKOUT_CREATED")
        .alias("evento"),
        "ts",
        (F.col("ts") + F.expr("interval 1 day")).alias("expira_em"),
        F.when(k <= 12, k).alias("parcelas"),
    )
    out = billing.coupon_outcomes(rows, F.lit("2024-03-01").cast("timestamp"))
    return out.drop("expira_em")


def _clients(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as clients; the access window ends on the last order's date."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    span = o.groupBy("o_custkey").agg(
        F.to_date(F.min("o_orderdate")).alias("inicio_acesso"), F.to_date(F.max("o_orderdate")).alias("fim_acesso")
    )
    return c.join(span, c.c_custkey == span.o_custkey, "left").select(
        "c_custkey", "c_name", "c_mktsegment", "inicio_acesso", "fim_acesso",
        (F.col("c_acctbal") >= 0).alias("ativo"),
        F.when(F.col("c_nationkey") % 3 == 0, "TOTAL").when(F.col("c_nationkey") % 3 == 1, "BASICO").otherwise("").alias("plano"),
    )


_CLIENTS_SQL = """clients as (select c_custkey, c_name, c_mktsegment, i as inicio_acesso, f as fim_acesso, c_acctbal >= 0 as ativo,
    case c_nationkey % 3 when 0 then 'TOTAL' when 1 then 'BASICO' else '' end as plano
  from customer left join (select o_custkey, min(o_orderdate)::date as i, max(o_orderdate)::date as f from orders group by 1) on o_custkey = c_custkey)"""
_FLAGS_SQL = """flags as (select *, coalesce(fim_acesso < date '2001-06-30', false) as acesso_expirado, coalesce(inicio_acesso > date '2001-06-30', false) as acesso_agendado,
    ativo and not coalesce(fim_acesso < date '2001-06-30', false) and not coalesce(inicio_acesso > date '2001-06-30', false) as acesso_vigente,
    (fim_acesso - date '2001-06-30')::int as dias_restantes from clients)"""


@query(
    "F18 R10",
    sql=f"""with {_CLIENTS_SQL}, {_FLAGS_SQL}
    select c_custkey, acesso_expirado, acesso_agendado, acesso_vigente, acesso_vigente and plano in ('BASICO', 'TOTAL') as possui_plano,
      acesso_vigente and plano = 'TOTAL' as pode_desenhar, dias_restantes,
      case when c_mktsegment = 'BUILDING' then 'ADMIN' when not acesso_vigente then 'SEM_ACESSO' when plano = '' then 'SEM_PLANO' else plano end as nivel from flags""",
)
def access_levels(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import status

    today = F.lit("2001-06-30").cast("date")
    flagged = _clients(spark, sf).withColumns(billing.access_flags(today))
    role = F.when(F.col("c_mktsegment") == "BUILDING", "ADMIN")
    return flagged.withColumn("nivel", status.access_level(role)).select(
        "c_custkey", "acesso_expirado", "acesso_agendado", "acesso_vigente", "possui_plano",
        "pode_desenhar", "dias_restantes", "nivel",
    )


@query(
    "P20 A19",
    sql=f"""with {_CLIENTS_SQL}, {_FLAGS_SQL}
    select c_mktsegment as busca, count(*) as total, count(*) filter (acesso_vigente) as ativos, count(*) filter (acesso_expirado) as expirados,
      count(*) filter (acesso_agendado) as agendados, count(*) filter (dias_restantes between 0 and 7) as expirando, count(*) filter (plano = '') as sem_plano
    from flags where contains(lower(c_name), '#0000') or contains(lower(c_mktsegment), 'build') group by 1""",
)
def client_search(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import status

    today = F.lit("2001-06-30").cast("date")
    flagged = _clients(spark, sf).withColumns(billing.access_flags(today))
    by_name = status.search(flagged, "#0000", ["c_name"])
    by_segment = status.search(flagged, "BUILD", ["c_mktsegment"])
    found = by_name.unionByName(by_segment).dropDuplicates(["c_custkey"])
    return status.client_counts(found.withColumnRenamed("c_mktsegment", "busca"), "busca")


@query(
    "T7",
    sql="""select o_orderkey, o_orderstatus = 'O' and o_orderpriority = '1-URGENT' and o_orderdate::date <= date '2000-01-16' as renovacao_pendente,
      case when o_orderstatus = 'O' and o_orderpriority = '1-URGENT' and o_orderdate::date <= date '2000-01-16' then 'PENDING_REAUTHORIZATION' else 'SCHEDULED' end as renovacao_status
    from orders""",
)
def renewal_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Marked twice; the second sweep changes nothing."""
    o = table(spark, sf, "orders")
    subs = o.select(
        "o_orderkey",
        F.lit(True).alias("atual"),
        F.when(F.col("o_orderstatus") == "O", "YEARLY").otherwise("MONTHLY").alias("ciclo"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "YEARLY_INSTALLMENT").otherwise("YEARLY_CASH").alias("modalidade"),
        F.lit("SCHEDULED").alias("renovacao_status"),
        F.to_date("o_orderdate").alias("acesso_ate"),
        F.lit(False).alias("renovacao_pendente"),
    )
    today = F.lit("2000-01-01").cast("date")
    twice = billing.renewals_due(billing.renewals_due(subs, today), today)
    return twice.select("o_orderkey", "renovacao_pendente", "renovacao_status")


@query(
    "J19 W2",
    sql="""with subs as (select o_orderkey as id, o_custkey as customer_id, 'sub' || o_orderkey::varchar as subscription_id, o_orderdate as criado_em from orders where o_orderstatus <> 'F'),
    ev as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'sub' || l_orderkey::varchar as subscription_id, l_partkey % 1500 as customer_id from lineitem),
    newest as (select customer_id, id from (select *, row_number() over (partition by customer_id order by criado_em desc, id desc) as r from subs) where r = 1)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(s.id, n.id) as assinatura from ev left join subs s using (subscription_id)
      left join newest n on n.customer_id = ev.customer_id""",
)
def match_subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    subs = o.where("o_orderstatus <> 'F'").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"),
        F.concat(F.lit("sub"), F.col("o_orderkey").cast("string")).alias("subscription_id"),
        F.struct("o_orderdate", "o_orderkey").alias("criado_em"), F.lit(True).alias("atual"),
    )
    ev = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.concat(F.lit("sub"), F.col("l_orderkey").cast("string")).alias("subscription_id"),
        (F.col("l_partkey") % 1500).alias("customer_id"),
    )
    return billing.match_subscription(ev, subs).drop("subscription_id", "customer_id")


@query("T5 W5")
def attempt_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed-window limiter per user: five attempts in a day block for two days."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("chave"), "ts", "event_id")
    return billing.limit_attempts(e, 5, 86400, 172800)


@query(
    "T15",
    sql="""with l as (select user_id, max(ts) as atualizado_em, max(ts) filter (event_type = 'error') + interval 2 day as bloqueado_ate from events group by 1)
    select user_id from l where atualizado_em < timestamp '2024-02-10' - interval 12 day and (bloqueado_ate is null or bloqueado_ate <= timestamp '2024-02-10')""",
)
def expired_limits(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    limits = e.groupBy("user_id").agg(
        F.max("ts").alias("atualizado_em"),
        (F.max(F.when(F.col("event_type") == "error", F.col("ts"))) + F.expr("interval 2 days")).alias("bloqueado_ate"),
    )
    return billing.expired_limits(limits, F.lit("2024-02-10").cast("timestamp"), 12).select("user_id")


@query(
    "P18",
    sql=f"""select event_id, '{{"id":"' || event_id::varchar || '","event":"PAYMENT_CONFIRMED","payment":{{"id":"p' || {_K}::varchar || '","status":"' || event_type || '"}}}}' as payload from events""",
)
def sanitized_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Payer data in the payload does not survive."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    raw = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("id"),
            F.lit("PAYMENT_CONFIRMED").alias("event"),
            F.lit("123.456.789-09").alias("cpf"),
            F.struct(
                F.concat(F.lit("p"), k).alias("id"),
                F.col("event_type").alias("status"),
                F.lit("Maria").alias("payerName"),
            ).alias("payment"),
        )
    )
    return e.select("event_id", billing.sanitized(raw).alias("payload"))


@query(
    "J18",
    sql="""select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')
      or exists (select 1 from events where user_id = c_custkey and event_type = 'purchase')""",
)
def clients_with_history(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import status

    c = table(spark, sf, "customer").select("c_custkey")
    orders = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    paid = table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("k"))
    return status.with_any(c, "c_custkey", [orders, paid])
