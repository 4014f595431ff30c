"""Billing rules: calendar, prices, access windows, coupons, payments, limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Days of grace, days before the end of access at which a renewal is marked,
# instalments of a yearly plan, events per replay round and tries before giving up, event kinds with an effect, allowed payload fields.
GRACE_DAYS = 5
RENEWAL_DAYS = 15
YEARLY_INSTALMENTS = 12
ROUND_LIMIT = 100
MAX_ATTEMPTS = 10
ACCESS_EVENTS = ("PAYMENT_CONFIRMED", "PAYMENT_RECEIVED")
OVERDUE_EVENTS = ("PAYMENT_OVERDUE", "PAYMENT_CREDIT_CARD_CAPTURE_REFUSED")
REVERSAL_EVENTS = (
    "PAYMENT_REFUNDED", "PAYMENT_CHARGEBACK_REQUESTED", "PAYMENT_REPROVED_BY_RISK_ANALYSIS",
)
EVENT_SCHEMA = """struct<id:string,event:string,dateCreated:string,
  checkout:struct<id:string,customer:string,status:string,subscription:string,payment:string,
    externalReference:string,installmentCount:bigint>,
  subscription:struct<id:string,customer:string,status:string,nextDueDate:string,cycle:string,value:double>,
  payment:struct<id:string,subscription:string,customer:string,status:string,billingType:string,value:double,
    netValue:double,dueDate:string,confirmedDate:string,paymentDate:string,invoiceUrl:string,
    installment:string,installmentId:string,installmentCount:bigint>>"""


def sanitized(payload: Column) -> Column:
    """Payload with the allowed fields only; payer data never gets through."""
    return F.to_json(F.from_json(payload, EVENT_SCHEMA))


def add_cycle(day: Column, cycle: Column) -> Column:
    """One month or year later, clamped to the month's end."""
    return F.add_months(day, F.when(cycle == "YEARLY", 12).otherwise(1))


def grace_until(due: Column) -> Column:
    return F.date_add(due, GRACE_DAYS)


def valid_instalments(count: Column, maximum: Column) -> Column:
    """The count when it is between one and the offered maximum."""
    return F.when(count.between(F.lit(1), F.coalesce(F.nullif(maximum, F.lit(0)), F.lit(1))), count)


def coupon_discount(price: Column, kind: Column, value: Column) -> Column:
    """Percent or fixed discount, half up to cents, never above the price."""
    percent = F.when((value > 0) & (value <= 100), F.round(price * value / 100, 2))
    return F.when(kind == "PERCENTUAL", percent).otherwise(F.round(F.least(value, price), 2))


def coupon_state(now: Column, cycle: Column) -> Column:
    """Why a coupon row cannot be used, or OK; capacity included."""
    used = F.greatest(F.col("quantidade_usos"), F.col("consumidos")) + F.col("reservados")
    return (
        F.when(~F.col("ativo"), "INATIVO")
        .when(F.col("validade_inicio") > now, "AINDA_NAO_VALIDO")
        .when(F.col("validade_fim") < now, "EXPIRADO")
        .when((cycle == "MONTHLY") & ~F.col("aplica_mensal"), "NAO_MENSAL")
        .when((cycle == "YEARLY") & ~F.col("aplica_anual"), "NAO_ANUAL")
        .when(F.col("limite_total_usos").isNotNull() & (used >= F.col("limite_total_usos")), "ESGOTADO")
        .otherwise("OK")
    )


def coupon_usage(uses: DataFrame, now: Column) -> DataFrame:
    """Consumed uses and live reservations per coupon, one partial aggregation."""
    live = (F.col("status") == "RESERVED") & (F.col("expira_em").isNull() | (F.col("expira_em") > now))
    return uses.groupBy("cupom").agg(
        F.count_if(F.col("status") == "CONSUMED").alias("consumidos"),
        F.count_if(live).alias("reservados"),
    )


def coupon_outcomes(events: DataFrame, now: Column) -> DataFrame:
    """Final state per reservation: consumed once if paid in time, else released or open.

    The first of paid, canceled or expired decides; later events change nothing.
    """
    rank = F.when(F.col("evento").isin("CHECKOUT_PAID", "CHECKOUT_CANCELED", "CHECKOUT_EXPIRED"), F.col("ts"))
    first = events.groupBy("checkout").agg(
        F.min_by("evento", rank).alias("decisao"),
        F.count_if(F.col("evento") == "CHECKOUT_PAID").alias("pagos"),
        F.max("expira_em").alias("expira_em"),
        F.max_by("parcelas", F.when(F.col("parcelas").isNotNull(), F.col("ts"))).alias("parcelas"),
    )
    status = (
        F.when(F.col("decisao") == "CHECKOUT_PAID", "CONSUMED")
        .when(F.col("decisao").isNotNull() | (F.col("expira_em") <= now), "RELEASED")
        .otherwise("RESERVED")
    )
    return first.withColumn("status", status)


def plan_prices(monthly: Column, yearly: Column) -> dict[str, Column]:
    """Monthly equivalent, shown yearly price, instalment and saving; half-even cents."""
    shown = F.coalesce(F.nullif(yearly, F.lit(0)), F.bround(monthly * 12, 2))
    cents = lambda c: F.bround(c, 2).cast("decimal(12,2)")
    return {
        "mensal_equivalente": F.when(F.coalesce(yearly, F.lit(0)) != 0, cents(yearly / 12)).otherwise(cents(monthly)),
        "valor_anual": cents(shown),
        "valor_parcela": cents(shown / YEARLY_INSTALMENTS),
        "economia": F.greatest(cents(F.bround(monthly * 12, 2) - shown), F.lit(0).cast("decimal(12,2)")),
    }


def access_flags(today: Column) -> dict[str, Column]:
    """Access state of a client row with inicio_acesso, fim_acesso, ativo and plano."""
    expired = F.coalesce(F.col("fim_acesso") < today, F.lit(False))
    scheduled = F.coalesce(F.col("inicio_acesso") > today, F.lit(False))
    current = F.col("ativo") & ~expired & ~scheduled
    return {
        "acesso_expirado": expired,
        "acesso_agendado": scheduled,
        "acesso_vigente": current,
        "possui_plano": current & F.col("plano").isin("BASICO", "TOTAL"),
        "pode_desenhar": current & (F.col("plano") == "TOTAL"),
        "dias_restantes": F.datediff("fim_acesso", today),
    }


def replay_round(events: DataFrame, limit: int = ROUND_LIMIT) -> DataFrame:
    """Oldest open events of a round; permanent errors are skipped."""
    open_events = events.where(F.col("status").isin("RECEIVED", "PENDING", "ERROR"))
    first = open_events.orderBy("recebido_em", "event_id").limit(limit)
    return first.where(~((F.col("status") == "ERROR") & (F.col("tentativas") >= MAX_ATTEMPTS)))


def unique_events(events: DataFrame, key: str = "event_id") -> DataFrame:
    """One row per event id, the first received."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.min_by(F.struct(*rest), "ts").alias("_e")).select(key, "_e.*")


def latest_payments(events: DataFrame) -> DataFrame:
    """Newest payload per payment, and whether access was ever granted by it."""
    return events.groupBy("payment_id").agg(
        F.max_by("status", "ts").alias("status"),
        F.max_by("value", "ts").alias("valor"),
        F.max_by("due", "ts").alias("vencimento"),
        F.max(F.col("kind").isin(*ACCESS_EVENTS)).alias("acesso_aplicado"),
        F.count(F.lit(1)).alias("eventos"),
    )


def renewals_due(subscriptions: DataFrame, today: Column) -> DataFrame:
    """Yearly instalment subscriptions close to their end, marked once."""
    due = (
        F.col("atual")
        & (F.col("ciclo") == "YEARLY")
        & (F.col("modalidade") == "YEARLY_INSTALLMENT")
        & F.col("renovacao_status").isin("NONE", "SCHEDULED")
        & (F.col("acesso_ate") <= F.date_add(today, RENEWAL_DAYS))
    )
    return subscriptions.withColumns(
        {
            "renovacao_pendente": F.coalesce(due, F.lit(False)) | F.col("renovacao_pendente"),
            "renovacao_status": F.when(due, "PENDING_REAUTHORIZATION").otherwise(F.col("renovacao_status")),
        }
    )


def match_subscription(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Current subscription by id, else the customer's newest current one."""
    current = subscriptions.where("atual")
    by_id = current.groupBy("subscription_id").agg(F.min("id").alias("_by_id"))
    by_customer = current.groupBy("customer_id").agg(F.max_by("id", "criado_em").alias("_by_customer"))
    joined = events.join(by_id, "subscription_id", "left").join(by_customer, "customer_id", "left")
    return joined.withColumn("assinatura", F.coalesce("_by_id", "_by_customer")).drop("_by_id", "_by_customer")


# ---- sequential folds -----------------------------------------------------

def fold_sorted(
    df: DataFrame, key: str, order: Sequence[str], new: Callable[[], dict],
    step: Callable[[dict, object], None], done: Callable[[object, dict], tuple], schema: str,
) -> DataFrame:
    """Fold each key's rows in order and emit one row per key.

    Rows are hash-partitioned by key and sorted by Spark; a task walks its
    sorted batches with the state of one key at a time, so memory does not grow
    with the size of a key.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, started = None, {}, False
        names = [part.split()[0] for part in schema.split(",")]
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                value = getattr(row, key)
                if not started or value != current:
                    if started:
                        out.append(done(current, state))
                    current, state, started = value, new(), True
                step(state, row)
            if out:
                yield pd.DataFrame(out, columns=names)
        if started:
            yield pd.DataFrame([done(current, state)], columns=names)

    ordered = df.repartition(key).sortWithinPartitions(key, *order)
    return ordered.mapInPandas(walk, schema)


def next_cycle(day: date, cycle: str) -> date:
    """`add_cycle` for one date inside a fold."""
    later = pd.Timestamp(day) + pd.DateOffset(months=12 if cycle == "YEARLY" else 1)
    return later.date()


SUBSCRIPTION_SCHEMA = (
    "perfil bigint, status string, acesso_ate date, fim_acesso date, cancelamento boolean, "
    "pendentes bigint, processados bigint, pagamentos bigint"
)


def new_subscription() -> dict:
    return {"sub": None, "pending": [], "seen": set(), "paid": set(), "processed": 0}


def _bind(state: dict, event: dict) -> None:
    cycle, today = event["cycle"], event["day"]
    until = next_cycle(today if cycle == "YEARLY" else event["due"] or today, cycle)
    state["sub"] = {
        "status": "ACTIVE", "cycle": cycle, "mode": event["mode"],
        "until": until, "end": until, "canceled": False,
    }


def _pay(sub: dict, paid: set, event: dict) -> None:
    kind, day = event["kind"], event["day"]
    due = event["due"] or day
    instalments = sub["cycle"] == "YEARLY" and sub["mode"] == "YEARLY_INSTALLMENT"
    if kind in ACCESS_EVENTS and event["object_id"] not in paid:
        paid.add(event["object_id"])
        if not sub["canceled"]:
            sub["status"] = "ACTIVE"
        extends = not instalments
        if sub["mode"] == "YEARLY_CASH":
            extends = due >= sub["until"]
            due = max(day, sub["until"])
        if extends:
            sub["until"] = sub["end"] = next_cycle(due, sub["cycle"])
    elif kind in OVERDUE_EVENTS and not instalments:
        sub["status"] = "PAST_DUE"
        sub["end"] = max(sub["end"], due + timedelta(days=GRACE_DAYS))
    elif kind in REVERSAL_EVENTS:
        sub["status"] = "SUSPENDED"
        sub["end"] = day - timedelta(days=1)


def apply_event(state: dict, event: dict) -> None:
    """One billing event; events that come before their checkout wait for it."""
    if event["event_id"] in state["seen"]:
        return
    state["seen"].add(event["event_id"])
    kind, sub = event["kind"], state["sub"]
    if kind == "CHECKOUT_PAID":
        _bind(state, event)
        state["processed"] += 1
        waiting, state["pending"] = state["pending"], []
        for earlier in waiting:
            state["seen"].discard(earlier["event_id"])
            apply_event(state, earlier)
        return
    if kind.startswith(("SUBSCRIPTION_", "PAYMENT_")) and sub is None:
        state["pending"].append(event)
        return
    if kind in ("SUBSCRIPTION_CREATED", "SUBSCRIPTION_UPDATED"):
        sub["status"] = "ACTIVE" if (event["remote"] or "").upper() == "ACTIVE" else "INACTIVE"
    elif kind in ("SUBSCRIPTION_INACTIVATED", "SUBSCRIPTION_DELETED"):
        sub["status"] = "INACTIVE" if kind.endswith("INACTIVATED") else "CANCELED"
        sub["canceled"] = True
    elif kind.startswith("PAYMENT_"):
        _pay(sub, state["paid"], event)
    state["processed"] += 1


def subscription_row(profile: object, state: dict) -> tuple:
    sub = state["sub"] or {}
    return (
        profile, sub.get("status", "PENDING"), sub.get("until"), sub.get("end"),
        sub.get("canceled", False), len(state["pending"]), state["processed"], len(state["paid"]),
    )


def fold_subscriptions(events: DataFrame) -> DataFrame:
    """Subscription state per profile from all its events, in event order."""
    return fold_sorted(
        events, "perfil", ["ts", "event_id"], new_subscription,
        lambda state, row: apply_event(state, row._asdict()), subscription_row, SUBSCRIPTION_SCHEMA,
    )


LIMIT_SCHEMA = "chave bigint, tentativas bigint, bloqueios bigint, recusadas bigint, bloqueado_ate timestamp"


def attempt_step(limit: int, window: int, block: int) -> Callable[[dict, object], None]:
    """Fixed window that starts with its first attempt; reaching the limit blocks."""

    def step(state: dict, row: object) -> None:
        now = row.ts
        if state["until"] is not None and state["until"] > now:
            state["refused"] += 1
            return
        if state["start"] is None or (now - state["start"]).total_seconds() >= window:
            state["start"], state["n"], state["until"] = now, 0, None
        state["n"] += 1
        if state["n"] >= limit:
            state["until"] = now + timedelta(seconds=block)
            state["blocks"] += 1

    return step


def new_attempts() -> dict:
    return {"start": None, "n": 0, "until": None, "blocks": 0, "refused": 0}


def attempts_row(key: object, state: dict) -> tuple:
    return key, state["n"], state["blocks"], state["refused"], state["until"]


def limit_attempts(attempts: DataFrame, limit: int, window: int, block: int) -> DataFrame:
    """Attempt counter, lockouts and refused attempts per key."""
    return fold_sorted(
        attempts, "chave", ["ts", "event_id"], new_attempts, attempt_step(limit, window, block),
        attempts_row, LIMIT_SCHEMA,
    )


def expired_limits(limits: DataFrame, now: Column, days: int) -> DataFrame:
    """Limiter rows to remove: old and not blocked any more."""
    old = F.col("atualizado_em") < now - F.expr(f"interval {int(days)} days")
    return limits.where(old & (F.col("bloqueado_ate").isNull() | (F.col("bloqueado_ate") <= now)))
