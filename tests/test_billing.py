from datetime import date, datetime, timedelta

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from terralume.operators import billing
from terralume.streaming import billing as live

COLUMNS = "event_id bigint, perfil bigint, ts timestamp, kind string, object_id string, day date, due date, remote string, cycle string, mode string"
START = datetime(2024, 1, 1, 12)


def event(i, kind, *, profile=1, obj="p1", due=None, remote=None, cycle="MONTHLY", mode="MONTHLY"):
    ts = START + timedelta(days=i)
    return (i, profile, ts, kind, obj, ts.date(), due, remote, cycle, mode)


def fold(spark, events):
    df = spark.createDataFrame(events, COLUMNS)
    return {r["perfil"]: r for r in billing.fold_subscriptions(df).collect()}


def test_payment_before_checkout_waits_and_binds(spark):
    rows = [
        event(0, "SUBSCRIPTION_CREATED", remote="ACTIVE"),
        event(1, "CHECKOUT_PAID", due=date(2024, 1, 31)),
        event(2, "PAYMENT_CREATED", profile=2),
    ]
    got = fold(spark, rows)
    assert (got[1]["status"], got[1]["pendentes"], got[1]["acesso_ate"]) == ("ACTIVE", 0, date(2024, 2, 29))
    assert (got[2]["status"], got[2]["pendentes"]) == ("PENDING", 1)


def test_overdue_then_confirmed(spark):
    rows = [
        event(0, "CHECKOUT_PAID", due=date(2024, 1, 1)),
        event(1, "PAYMENT_OVERDUE", due=date(2024, 2, 1)),
        event(2, "PAYMENT_CONFIRMED", due=date(2024, 2, 1)),
        event(3, "PAYMENT_RECEIVED", due=date(2024, 9, 1)),
    ]
    late = fold(spark, rows[:2])[1]
    assert (late["status"], late["fim_acesso"]) == ("PAST_DUE", date(2024, 2, 6))
    done = fold(spark, rows)[1]
    assert (done["status"], done["acesso_ate"], done["pagamentos"]) == ("ACTIVE", date(2024, 3, 1), 1)


def test_refund_suspends_and_cancel_is_kept(spark):
    rows = [
        event(0, "CHECKOUT_PAID"),
        event(1, "SUBSCRIPTION_DELETED"),
        event(2, "PAYMENT_CONFIRMED", due=date(2024, 5, 1)),
    ]
    assert fold(spark, rows)[1]["status"] == "CANCELED"
    rows.append(event(3, "PAYMENT_REFUNDED", obj="p2"))
    got = fold(spark, rows)[1]
    assert (got["status"], got["fim_acesso"]) == ("SUSPENDED", date(2024, 1, 3))


def test_yearly_instalments_do_not_extend(spark):
    rows = [
        event(0, "CHECKOUT_PAID", cycle="YEARLY", mode="YEARLY_INSTALLMENT"),
        event(1, "PAYMENT_CONFIRMED", due=date(2024, 6, 1)),
        event(2, "PAYMENT_OVERDUE", obj="p2", due=date(2024, 7, 1)),
    ]
    got = fold(spark, rows)[1]
    assert (got["status"], got["acesso_ate"]) == ("ACTIVE", date(2025, 1, 1))


KINDS = ["CHECKOUT_PAID", "PAYMENT_CONFIRMED", "PAYMENT_OVERDUE", "PAYMENT_REFUNDED", "SUBSCRIPTION_UPDATED", "SUBSCRIPTION_INACTIVATED"]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(KINDS), st.integers(1, 3)), min_size=1, max_size=25))
def test_fold_equals_plain_python_and_ignores_repeats(spark, steps):
    rows = [event(i, k, profile=p, obj=f"o{i % 4}", due=date(2024, 3, 1) + timedelta(days=i), remote="ACTIVE") for i, (k, p) in enumerate(steps)]
    want = {}
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    for row in rows:
        state = want.setdefault(row[1], billing.new_subscription())
        billing.apply_event(state, dict(zip(names, row)))
    plain = {p: billing.subscription_row(p, s) for p, s in want.items()}
    got = {p: tuple(r) for p, r in fold(spark, rows + rows).items()}
    assert got == plain


def test_stream_equals_batch(spark, tmp_path):
    rows = [event(i, KINDS[i * 7 % 6], profile=i % 3, obj=f"o{i % 5}", due=date(2024, 4, 1), remote="ACTIVE") for i in range(60)]
    df = spark.createDataFrame(rows, COLUMNS)
    df.where("event_id < 30").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("event_id >= 30").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.subscription_stream(live.read_events(spark, str(tmp_path / "in"), df.schema))
    live.write_updates(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["perfil"]: tuple(r) for r in live.latest_updates(spark, str(tmp_path / "out"), "perfil").collect()}
    want = {p: tuple(r) for p, r in fold(spark, rows).items()}
    assert got == want


def test_coupon_prices(spark):
    price = F.lit("598.80").cast("decimal(10,2)")
    off = billing.coupon_discount(price, F.lit("PERCENTUAL"), F.lit(20).cast("decimal(10,2)"))
    fixed = billing.coupon_discount(price, F.lit("FIXO"), F.lit(50).cast("decimal(10,2)"))
    row = spark.range(1).select(off.cast("string").alias("p"), (price - fixed).cast("string").alias("f")).first()
    assert float(row["p"]) == 119.76
    assert float(row["f"]) == 548.80


def test_limiter_against_brute_force(spark):
    times = [0, 10, 20, 30, 31, 400, 4000, 4001, 4002, 9000]
    df = spark.createDataFrame([(1, START + timedelta(seconds=s), i) for i, s in enumerate(times)], "chave bigint, ts timestamp, event_id int")
    row = billing.limit_attempts(df, 3, 60, 600).first()
    # Three attempts block until 620 s, which refuses three more; the next three block again until 4602 s.
    assert (row["tentativas"], row["bloqueios"], row["recusadas"]) == (1, 2, 3)


def test_payload_keeps_allowed_fields_only(spark):
    raw = '{"id":"e1","event":"X","cpf":"123","payment":{"id":"p","payer":"Ana","value":5.0}}'
    text = spark.range(1).select(billing.sanitized(F.lit(raw)).alias("t")).first()["t"]
    assert "cpf" not in text and "Ana" not in text and '"p"' in text
