"""Batch roll-ups, decisions on jobs, searches, unread counts and access levels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx

# Item states, layers per state, minutes until an item is stale.
PENDING_ITEMS = ("AGUARDANDO_FILA", "PENDENTE", "PROCESSANDO")
DONE_ITEMS = ("CONCLUIDO", "IGNORADO_DUPLICADO", "SEM_ALTERACAO")
STATE_LAYERS = 9
STALE_MINUTES = 120


def search(df: DataFrame, term: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the term in any of the columns, letter case ignored."""
    wanted = term.strip().lower()
    hits = [F.lower(F.col(c)).contains(wanted) for c in columns]
    return df.where(reduce(lambda a, b: a | b, hits))


def client_counts(flagged: DataFrame, by: str) -> DataFrame:
    """Counts per access state."""
    return flagged.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("acesso_vigente").alias("ativos"),
        F.count_if("acesso_expirado").alias("expirados"),
        F.count_if("acesso_agendado").alias("agendados"),
        F.count_if(F.col("dias_restantes").between(0, 7)).alias("expirando"),
        F.count_if(F.col("plano") == "").alias("sem_plano"),
    )


def access_level(role: Column) -> Column:
    """Role first, then the client's access and plan."""
    return F.coalesce(
        role,
        F.when(~F.col("acesso_vigente"), "SEM_ACESSO")
        .when(~F.col("possui_plano"), "SEM_PLANO")
        .otherwise(F.col("plano")),
    )


def with_any(df: DataFrame, key: str, sources: Sequence[DataFrame]) -> DataFrame:
    """Rows whose key occurs in any one-column source."""
    keys = reduce(DataFrame.union, [s.select(F.col(s.columns[0]).alias("_k")).distinct() for s in sources])
    return df.join(keys, df[key] == keys["_k"], "left_semi")


def batch_counts(items: DataFrame, batch: str = "lote_id") -> DataFrame:
    """Per batch: items per outcome group and mean progress."""
    s = F.col("status")
    return items.groupBy(batch).agg(
        F.count(F.lit(1)).alias("itens"),
        F.count_if(s.isin(*PENDING_ITEMS)).alias("pendentes"),
        F.count_if(s == "PROCESSANDO").alias("processando"),
        F.count_if(s == "AGUARDANDO_CONFIRMACAO").alias("aguardando_confirmacao"),
        F.count_if(s == "PRONTO_IMPORTAR").alias("prontos"),
        F.count_if(s.isin(*DONE_ITEMS)).alias("concluidos"),
        F.count_if(s.isin("FALHOU", "REQUER_REVISAO")).alias("falhas"),
        F.sum("progresso").alias("progresso_total"),
    )


def batch_progress(expected: Column | None = None) -> Column:
    """Half-even mean; files not yet sent count as zero when `expected` is given."""
    whole = F.greatest(expected, F.lit(1)) if expected is not None else F.col("itens")
    return F.bround(F.col("progresso_total") / whole).cast("int")


def batch_status(phase: Column, interrupted: Column, sequential_open: Column, warnings: Column) -> Column:
    """Final state of a batch from its counts, first rule that holds."""
    analysing = F.when(phase == "ANALISE", "ANALISANDO").otherwise("PROCESSANDO")
    problem = (F.col("falhas") > 0) | (F.col("prontos") > 0) | (warnings > 0)
    return (
        F.when(interrupted & (F.col("processando") > 0), "INTERROMPENDO")
        .when(interrupted, "INTERROMPIDO")
        .when(F.col("pendentes") > 0, analysing)
        .when(
            F.col("aguardando_confirmacao") > 0,
            F.when(sequential_open, "ANALISANDO").otherwise("AGUARDANDO_CONFIRMACAO"),
        )
        .when(sequential_open, analysing)
        .when((phase == "ANALISE") & (F.col("prontos") > 0), "AGUARDANDO_CONFIRMACAO")
        .when(problem, "CONCLUIDO_COM_PENDENCIAS")
        .otherwise("CONCLUIDO")
    )


def state_rollup(items: DataFrame) -> DataFrame:
    """Per state: priority status, newest check and newest update."""
    s = F.col("status")
    has = lambda *v: F.max(s.isin(*v))
    rolled = items.where("uf <> ''").groupBy("uf").agg(
        has(*PENDING_ITEMS).alias("_p"),
        has("FALHOU").alias("_f"),
        (has("REQUER_REVISAO") | (F.sum("nao_reparaveis") > 0)).alias("_r"),
        has("PRONTO_IMPORTAR").alias("_q"),
        has("CONCLUIDO").alias("_c"),
        F.min(s.isin("SEM_ALTERACAO", "IGNORADO_DUPLICADO")).alias("_s"),
        F.max(F.when(s.isin("CONCLUIDO", "SEM_ALTERACAO"), F.col("finalizado_em"))).alias("ultima_verificacao"),
        F.max(F.when(s == "CONCLUIDO", F.col("finalizado_em"))).alias("ultima_atualizacao"),
        F.count_distinct("dataset_slug").alias("datasets"),
    )
    status = (
        F.when(F.col("_p"), "PROCESSANDO")
        .when(F.col("_f"), "FALHOU")
        .when(F.col("_r"), "ATENCAO")
        .when(F.col("_q"), "EM_FILA")
        .when(F.col("_c"), "ATUALIZADO")
        .when(F.col("_s"), "SEM_ALTERACAO")
        .otherwise("NUNCA_IMPORTADO")
    )
    return rolled.select("uf", status.alias("status"), "ultima_verificacao", "ultima_atualizacao", "datasets")


def state_coverage(states: DataFrame, hashes: DataFrame) -> DataFrame:
    """All 27 states with registered and expected layers."""
    spark = states.sparkSession
    every = spark.createDataFrame([(uf,) for uf in tx.UF_CODES], "uf string")
    found = hashes.groupBy("uf").agg(F.count_distinct("dataset_slug").alias("camadas_registradas"))
    status = states.select("uf", "status")
    return every.join(status, "uf", "left").join(found, "uf", "left").select(
        "uf",
        F.coalesce("status", F.lit("NUNCA_IMPORTADO")).alias("status"),
        F.coalesce("camadas_registradas", F.lit(0)).alias("camadas_registradas"),
        F.lit(STATE_LAYERS).alias("camadas_esperadas"),
    )


def warning_totals(reports: DataFrame, key: str, report: str) -> DataFrame:
    """Geometry, temporal and date warnings per key from JSON reports."""
    r = F.from_json(
        F.col(report),
        "reparo_geometrias struct<nao_reparaveis bigint>, filtro_prodes struct<registros_ano_invalido bigint>,"
        "normalizacao_datas map<string,struct<nao_reconhecidos:bigint,ambiguos:bigint,preferencia_ambiguos:string>>",
    )
    per_date = F.aggregate(
        F.coalesce(F.map_values(r["normalizacao_datas"]), F.array()),
        F.lit(0).cast("bigint"),
        lambda acc, d: acc
        + F.coalesce(d["nao_reconhecidos"], F.lit(0))
        + F.when(F.coalesce(d["preferencia_ambiguos"], F.lit("")) == "", F.coalesce(d["ambiguos"], F.lit(0))).otherwise(0),
    )
    each = reports.select(
        key,
        F.coalesce(r["reparo_geometrias"]["nao_reparaveis"], F.lit(0)).alias("g"),
        F.coalesce(r["filtro_prodes"]["registros_ano_invalido"], F.lit(0)).alias("t"),
        per_date.alias("d"),
    )
    return each.groupBy(key).agg(
        F.sum("g").alias("pendencias_geometria"),
        F.sum("t").alias("pendencias_temporais"),
        F.sum("d").alias("pendencias_datas"),
    )


def source_summary(cards: DataFrame) -> DataFrame:
    """Cards per area with their implementation counts."""
    each = cards.select("slug", "prioridade", "implementada", F.explode("areas").alias("area"))
    return each.groupBy("area").agg(
        F.count(F.lit(1)).alias("fontes"),
        F.count_if("implementada").alias("implementadas"),
        F.count_if(~F.col("implementada")).alias("planejadas"),
        F.count_if(F.col("prioridade") == "ALTA").alias("prioridade_alta"),
    )


def unread(messages: DataFrame, thread: str) -> DataFrame:
    """Unread count and last message per thread by partial aggregation."""
    return messages.groupBy(thread).agg(
        F.count_if((F.col("autor") == "cliente") & ~F.col("lida")).alias("nao_lidas"),
        F.max_by("texto", "ordem").alias("ultima_mensagem"),
        F.max("ordem").alias("ultima_ordem"),
    )


def with_read_flag(notices: DataFrame, users: DataFrame, reads: DataFrame, visible: Column) -> DataFrame:
    """Active notices of each user with their read flag; pairs come from the notice's audience."""
    marked = reads.select("aviso", "usuario").distinct().withColumn("_lido", F.lit(True))
    shown = notices.where(visible).join(users, "publico")
    return shown.join(marked, ["aviso", "usuario"], "left").withColumn(
        "lido", F.coalesce("_lido", F.lit(False))
    ).drop("_lido")


def claim_order(items: DataFrame) -> DataFrame:
    """Open items in id order, one per (source, dataset, state) at a time."""
    w = Window.partitionBy("fonte", "dataset", "uf").orderBy("id")
    open_items = items.where(F.col("status").isin("AGUARDANDO_FILA", "PENDENTE"))
    return open_items.withColumn("vez", F.row_number().over(w)).where("vez = 1").drop("vez")


def recovered(items: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """Items stuck in processing go back to the queue."""
    stale = (F.col("status") == "PROCESSANDO") & (
        F.col("iniciado_em") < now - F.expr(f"interval {int(minutes)} minutes")
    )
    stale = F.coalesce(stale, F.lit(False))
    return items.withColumns(
        {"status": F.when(stale, "AGUARDANDO_FILA").otherwise(F.col("status")), "recuperado": stale}
    )


def due_schedules(schedules: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Schedules whose time has passed today and that did not run today."""
    today = F.to_date(now)
    ran = done.where(F.to_date("executado_em") == today).select("agenda").distinct()
    minute = F.hour(now) * 60 + F.minute(now)
    ready = schedules.where(minute >= F.col("hora") * 60 + F.col("minuto"))
    return ready.join(ran, "agenda", "left_anti")


def sync_plan(layers: DataFrame, fresh: DataFrame, active: DataFrame) -> DataFrame:
    """Per layer: skipped today, no automatic source, already active, or queued."""
    f = fresh.select("dataset").distinct().withColumn("_f", F.lit(True))
    a = active.select("dataset").distinct().withColumn("_a", F.lit(True))
    joined = layers.join(f, "dataset", "left").join(a, "dataset", "left")
    decision = (
        F.when(F.col("_f"), "IGNORADA_HOJE")
        .when(~F.col("automatica"), "SEM_FONTE_AUTOMATICA")
        .when(F.col("_a"), "JA_ATIVA")
        .otherwise("ENFILEIRADA")
    )
    return joined.withColumn("decisao", decision).drop("_f", "_a")


def collection_status(jobs: DataFrame, batches: DataFrame) -> DataFrame:
    """Collection jobs from their batch: phase-scaled progress and outcome."""
    b = F.col("progresso")
    joined = jobs.join(batches, "lote_id", "left")
    scaled = (
        F.when(F.col("fase") == "ANALISE", 80 + F.floor(b * 10 / 100)).otherwise(90 + F.floor(b * 9 / 100))
    )
    final = F.col("lote_status").isin("CONCLUIDO", "CONCLUIDO_COM_PENDENCIAS")
    outcome = (
        F.when(F.col("lote_status").isNull(), "SEM_LOTE")
        .when(F.col("falhas") > 0, "FALHOU")
        .when(F.col("lote_status") == "AGUARDANDO_CONFIRMACAO", "ALTERACAO_DETECTADA")
        .when(final & (F.col("alterados") > 0), "ATUALIZADO")
        .when(final, "SEM_ALTERACAO")
        .otherwise("EM_ANDAMENTO")
    )
    return joined.select(
        "job_id", outcome.alias("resultado"), F.when(final, 100).otherwise(scaled).cast("int").alias("progresso")
    )


def checkout_allowed(profiles: DataFrame, open_checkouts: DataFrame, now: Column) -> DataFrame:
    """Profiles without an open checkout, and the identical open one to reuse."""
    live = open_checkouts.where(F.col("status").isin("ACTIVE", "CREATING") & (F.col("expira_em") > now))
    newest = live.groupBy("perfil", "plano").agg(F.max_by("checkout", "criado_em").alias("reutilizar"))
    anyone = live.select("perfil").distinct().withColumn("_aberto", F.lit(True))
    joined = profiles.join(newest, ["perfil", "plano"], "left").join(anyone, "perfil", "left")
    return joined.withColumn("pode_criar", F.col("_aberto").isNull()).drop("_aberto")


def sequence_complete(batches: DataFrame, items: DataFrame) -> DataFrame:
    """Sequential batches: everything received and nothing pending."""
    n = items.groupBy("lote_id").agg(
        F.count(F.lit(1)).alias("recebidos"), F.count_if(F.col("status").isin(*PENDING_ITEMS)).alias("abertos")
    )
    return batches.join(n, "lote_id", "left").select(
        "lote_id",
        ((F.coalesce("recebidos", F.lit(0)) == F.col("esperados")) & (F.coalesce("abertos", F.lit(0)) == 0)).alias("completo"),
    )


def item_outcome(source: Column, outcome: Column) -> Column:
    """State of a batch item from the state of its import."""
    kept = F.when((source != "sicar") & (outcome == "IGNORADO_DUPLICADO"), "IGNORADO_DUPLICADO")
    return (
        F.when(outcome == "CONCLUIDO", "CONCLUIDO")
        .when(outcome == "INTERROMPIDO", "INTERROMPIDO")
        .when(outcome == "AGUARDANDO_CONFIRMACAO_REDUCAO", "AGUARDANDO_CONFIRMACAO_SICOR")
        .when(outcome.isin("IGNORADO_DUPLICADO", "SEM_ALTERACAO"), F.coalesce(kept, F.lit("SEM_ALTERACAO")))
        .otherwise("FALHOU")
    )


def legacy_audit(stored: DataFrame, named: DataFrame) -> DataFrame:
    """Stored dataset of old items against the one their file name tells."""
    joined = stored.join(named.select("arquivo", F.col("dataset").alias("esperado")), "arquivo", "left")
    verdict = (
        F.when(F.col("esperado").isNull(), "SEM_REGRA")
        .when(F.col("esperado") == F.col("dataset"), "CONFERE")
        .otherwise("DIVERGENTE")
    )
    return joined.withColumn("auditoria", verdict)
