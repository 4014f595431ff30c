"""Alert states, summaries, source merges and layer assembly per property."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx

# Layers in report order with their alert label, layers shown by
# default, and the first year that restricts credit.
ALERT_ORDER = (
    ("outros_cars", "Sobreposição com outro CAR"),
    ("apa", "Sobreposição com APA"),
    ("assentamentos", "Sobreposição com Assentamento"),
    ("quilombolas", "Sobreposição com Área Quilombola"),
    ("funai", "Sobreposição com Terra Indígena"),
    ("prodes", "Ocorrência PRODES"),
    ("ibama", "Embargo IBAMA"),
    ("icmbio_embargo", "Embargo ICMBio"),
)
VISIBLE_LAYERS = (
    "ibama", "icmbio_embargo", "funai", "quilombolas", "apa", "assentamentos", "sicor", "prodes",
)
RESTRICTION_YEAR = 2019


def alert_state(layer: Column, available: Column, count: Column) -> Column:
    """nao_verificado without the layer, then alerta (embargo: atencao) or ok."""
    found = F.when(layer == "ibama", "atencao").otherwise("alerta")
    return F.when(~available, "nao_verificado").when(count > 0, found).otherwise("ok")


def alert_status(layer: Column, state: Column) -> Column:
    none = F.when(layer == "ibama", "Sem indício espacial").otherwise("Não identificado")
    return (
        F.when(state == "nao_verificado", "Não verificado")
        .when(state == "ok", none)
        .otherwise("Identificado")
    )


def summary_columns() -> tuple[Column, Column]:
    """Aggregates over layer states: number of alert types, and their labels in report order.

    A property has one row per layer at most, so the list is bounded by the
    number of layers.
    """
    order = F.create_map(*[F.lit(v) for i, (k, _) in enumerate(ALERT_ORDER) for v in (k, i)])
    label = F.create_map(*[F.lit(v) for k, name in ALERT_ORDER for v in (k, name)])
    raised = F.col("estado").isin("alerta", "atencao")
    entry = F.when(
        raised & order[F.col("camada")].isNotNull(),
        F.struct(order[F.col("camada")].alias("i"), label[F.col("camada")].alias("l")),
    )
    listed = F.transform(F.array_sort(F.collect_set(entry)), lambda e: e["l"])
    return F.count(entry).alias("quantidade"), F.array_join(listed, " • ").alias("resumo")


def default_visible(layer: Column) -> Column:
    return layer.isin(*VISIBLE_LAYERS)


def restrictive_year(year: Column) -> Column:
    """An integer year from 2019 on; anything unreadable never restricts."""
    value = F.trim(year.cast("string"))
    read = F.when(value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("int"))
    return F.coalesce(read >= RESTRICTION_YEAR, F.lit(False))


def sorted_values(values: Column) -> Column:
    """Distinct texts: integers by value first, then the rest case-folded."""
    texts = F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""))
    keyed = F.transform(
        texts,
        lambda v: F.struct(
            v.try_cast("bigint").isNull().alias("t"),
            F.coalesce(v.try_cast("bigint"), F.lit(0)).alias("n"),
            F.lower(v).alias("f"),
            v.alias("v"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["v"])


def alert_occurrences(
    records: DataFrame, owner: str = "cod_imovel", restrict: bool = False, copies: str | None = None
) -> DataFrame:
    """Per property: count, years, types and summed area of alert records.

    Years and classes are reduced to distinct values by partial aggregation;
    with `restrict` only records of restricting years count. `copies` names the
    column that tells how many records a row stands for; its area is their sum.
    """
    kind = tx.alert_class(F.col("main_class"), F.col("tipo_prodes"), F.col("class_name"))
    rows = records.where(restrictive_year(F.col("year"))) if restrict else records
    area = F.coalesce(F.col("area_sobreposta_ha"), F.lit(0.0))
    return rows.groupBy(owner).agg(
        (F.count(F.lit(1)) if copies is None else F.sum(copies)).alias("quantidade"),
        F.array_join(sorted_values(F.collect_set(F.col("year").cast("string"))), ",").alias("anos"),
        F.array_join(sorted_values(F.collect_set(kind)), ",").alias("tipos"),
        F.round(F.sum(area), 6).alias("area_soma_ocorrencias_ha"),
        F.lit("COM_OCORRENCIAS").alias("cobertura_status"),
    )


def with_coverage(properties: DataFrame, occurrences: DataFrame, owner: str = "cod_imovel") -> DataFrame:
    """All properties; without an occurrence the coverage stays unconfirmed."""
    return properties.select(owner).join(occurrences, owner, "left").withColumns(
        {
            "quantidade": F.coalesce("quantidade", F.lit(0)),
            "cobertura_status": F.coalesce("cobertura_status", F.lit("COBERTURA_NAO_CONFIRMADA")),
        }
    )


def protected_area(code: Column, category: Column) -> Column:
    """Environmental protection area by code or by category text."""
    text = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return (text(code) == "APA") | text(category).like("%PROTE%AMBIENTAL%")


def embargo_status(
    cancelled: Column, lifted: Column, lift_kind: Column, original: Column, record: Column
) -> Column:
    """CANCELADO, DESEMBARGADO, A_VERIFICAR or ATIVO, first rule that holds."""
    up = lambda c: F.upper(F.coalesce(c, F.lit("")))
    blank = F.trim(F.concat_ws(" ", original, record)) == ""
    return (
        F.when((up(cancelled) == "S") | up(original).contains("CANCEL"), "CANCELADO")
        .when(
            (up(lifted) == "S")
            | up(lift_kind).contains("DESEMBARG")
            | up(original).contains("DESEMBARG"),
            "DESEMBARGADO",
        )
        .when(up(original).rlike("SUBSTITU|EXCLU") | up(record).contains("EXCLU") | blank, "A_VERIFICAR")
        .otherwise("ATIVO")
    )


def public_record(columns: Sequence[str], allowed: Sequence[str]) -> Column:
    """JSON of the allowed fields that exist and are filled."""
    fields = [F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in allowed if c in columns]
    return F.to_json(F.struct(*fields))


def merge_units(first: DataFrame, second: DataFrame, fields: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """Units of two registers, the first one's values and geometry preferred.

    Key is the code; else the name, which only merges within its register; a
    unit with neither stays alone.
    """

    def keyed(df: DataFrame, rank: int) -> DataFrame:
        code = F.upper(F.trim(tx.first_filled(F.col("codigo_cnuc"), F.col("uc_id"))))
        name = F.lower(F.trim(F.col("nome_uc")))
        key = F.coalesce(
            F.concat(F.lit("COD:"), F.nullif(code, F.lit(""))),
            F.concat(F.lit(f"{names[rank]}:NOME:"), F.nullif(name, F.lit(""))),
            F.concat(F.lit(f"{names[rank]}:SEM_CHAVE:"), F.col("id").cast("string")),
        )
        return df.withColumns({"chave": key, "_rank": F.lit(rank)})

    both = keyed(first, 0).unionByName(keyed(second, 1), allowMissingColumns=True)
    order = F.struct("_rank", "id")
    chosen = [
        F.min_by(F.col(f), F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", order)).alias(f)
        for f in fields
    ]
    sources = F.array_join(F.transform(F.array_sort(F.collect_set("_rank")), lambda r: F.get(F.array(*map(F.lit, names)), r)), " + ")
    return both.groupBy("chave").agg(*chosen, sources.alias("fonte_integrada"))


def single_register(merged: Column, names: tuple[str, str]) -> Column:
    """Which register's union area may be published: first, second or none."""
    primary = F.forall(merged, lambda s: s.isin(names[0], f"{names[0]} + {names[1]}"))
    secondary = F.forall(merged, lambda s: s == names[1])
    return F.when(F.size(merged) == 0, F.lit(None)).when(primary, names[0]).when(secondary, names[1])


def details_json(terms: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """One JSON object per term with one array per child table, each sorted."""
    out = terms.select(key)
    for name, child in children.items():
        rest = [c for c in child.columns if c != key]
        per = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
        out = out.join(per, key, "left")
    return out.select(key, F.to_json(F.struct(*children)).alias("detalhes"))
