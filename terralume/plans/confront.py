"""The full comparison: every property against every layer in one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..operators import alerts, confront


@dataclass(frozen=True)
class Layer:
    """An external layer; `table` is None when its source is not available."""

    name: str
    table: DataFrame | None
    feature: str
    where: Column | None = None


@dataclass(frozen=True)
class ConfrontResult:
    """Results per layer, layer states per property, and what describes a property."""

    results: dict[str, confront.LayerResult]
    others: DataFrame | None
    layers: DataFrame
    properties: DataFrame


def confront_all(properties: DataFrame, layers: Sequence[Layer], others: bool = True) -> ConfrontResult:
    """Overlaps, counts, areas and alert states.

    Each layer is joined as a set; the per-layer counts are then attached to
    the short list of layers of every property, so a property without any
    overlap still has one row per layer with its state.
    """
    indexed = confront.Indexed.of(properties)
    results, summaries, rows = {}, [], None
    for layer in layers:
        if layer.table is None:
            continue
        result = confront.external_layer(indexed, layer.table, layer.feature, layer.where)
        results[layer.name] = result
        summaries.append(result.counts.withColumn("camada", F.lit(layer.name)))
    if others:
        pairs = confront.other_pairs(indexed)
        rows = confront.other_properties(indexed, pairs=pairs)
        summaries.append(confront.other_counts(indexed, pairs).withColumn("camada", F.lit("outros_cars")))
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), summaries)
    offered = [(layer.name, layer.table is not None) for layer in layers]
    offered += [("outros_cars", True)] if others else []
    entries = F.array(
        *[F.struct(F.lit(n).alias("camada"), F.lit(ok).alias("disponivel")) for n, ok in offered]
    )
    grid = properties.select("cod_imovel", F.inline(entries))
    joined = grid.join(found, ["cod_imovel", "camada"], "left")
    count = F.coalesce("quantidade", F.lit(0))
    state = alerts.alert_state(F.col("camada"), F.col("disponivel"), count)
    states = joined.withColumns(
        {
            "quantidade": count,
            "truncada": F.coalesce("truncada", F.lit(False)),
            "estado": state,
            "visivel": alerts.default_visible(F.col("camada")),
        }
    ).withColumn("status", alerts.alert_status(F.col("camada"), F.col("estado")))
    described = properties.select(
        "cod_imovel",
        tx.property_status(F.col("situacao_car"), F.lit("")).alias("situacao"),
        "uf",
        "municipio",
    )
    return ConfrontResult(results, rows, states, described)


def resumed(result: ConfrontResult) -> DataFrame:
    """One row per property: alert types and text, and the layer counts as JSON.

    Everything comes from one aggregation over the short layer list of a
    property.
    """
    counts = F.to_json(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("camada", "quantidade"))))
    )
    summary = result.layers.groupBy("cod_imovel").agg(*alerts.summary_columns(), counts.alias("camadas"))
    return result.properties.join(summary, "cod_imovel")
