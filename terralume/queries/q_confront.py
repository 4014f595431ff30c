"""The flagship job on customers, orders, suppliers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import alerts
from ..plans.confront import ConfrontResult, Layer, confront_all, resumed
from . import roles
from .q_spatial import box_m2
from .registry import query


def _run(spark: SparkSession, sf: str) -> ConfrontResult:
    layers = [
        Layer("prodes", roles.alerts_layer(spark, sf), "fid", alerts.restrictive_year(F.col("year"))),
        Layer("ibama", roles.embargo_layer(spark, sf), "seq_tad"),
        Layer("apa", roles.units_layer(spark, sf), "uc_id", F.col("categoria_manejo") == "ECONOMY"),
        Layer("funai", None, "terrai_cod"),
    ]
    return confront_all(roles.properties(spark, sf), layers)


def _hits(layer: str, where: str = "true") -> str:
    m2 = box_m2("greatest(p.x0, l.x0)", "greatest(p.y0, l.y0)", "least(p.x1, l.x1)", "least(p.y1, l.y1)")
    return (
        f"select cod_imovel, count(*) as n from properties p join {layer} l on p.x0 < l.x1 and l.x0 < p.x1"
        f" and p.y0 < l.y1 and l.y0 < p.y1 where {where} and {m2} > 1.0 group by 1"
    )


_CTES = f"""{roles.PROPERTIES_SQL}, {roles.ALERTS_SQL}, {roles.EMBARGO_SQL}, {roles.UNITS_SQL},
  others as (select cod_imovel as outro, x0, y0, x1, y1 from properties),
  n_prodes as ({_hits("alerts", "l.year >= 2019")}), n_ibama as ({_hits("embargo")}),
  n_apa as ({_hits("units", "l.categoria_manejo = 'ECONOMY'")}), n_outros as ({_hits("others", "p.cod_imovel <> l.outro")}),
  counts as (select p.cod_imovel, p.situacao_car, p.uf, p.municipio, coalesce(a.n, 0) as prodes, coalesce(b.n, 0) as ibama, coalesce(c.n, 0) as apa, coalesce(d.n, 0) as outros
    from properties p left join n_prodes a using (cod_imovel) left join n_ibama b using (cod_imovel) left join n_apa c using (cod_imovel) left join n_outros d using (cod_imovel))"""


@query(
    "R5 R1 R2 R6 O1 X4",
    sql=f"""with {_CTES}
    select cod_imovel, uf, municipio, case situacao_car when 'AT' then 'Ativo' when 'Cancelado' then 'Inativo' when '' then 'Não informada' else situacao_car end as situacao,
      (outros > 0)::int + (apa > 0)::int + (prodes > 0)::int + (ibama > 0)::int as quantidade,
      concat_ws(' • ', case when outros > 0 then 'Sobreposição com outro CAR' end, case when apa > 0 then 'Sobreposição com APA' end,
        case when prodes > 0 then 'Ocorrência PRODES' end, case when ibama > 0 then 'Embargo IBAMA' end) as resumo,
      '{{"apa":' || apa::varchar || ',"funai":0,"ibama":' || ibama::varchar || ',"outros_cars":' || outros::varchar || ',"prodes":' || prodes::varchar || '}}' as camadas
    from counts""",
    bench=True,
)
def confront_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Summary of the whole comparison, one row per property."""
    return resumed(_run(spark, sf))


@query(
    "R1 R4 S15",
    sql=f"""with {_CTES}, l as (select cod_imovel, unnest([{{'c': 'prodes', 'n': prodes}}, {{'c': 'ibama', 'n': ibama}}, {{'c': 'apa', 'n': apa}}, {{'c': 'funai', 'n': 0}}, {{'c': 'outros_cars', 'n': outros}}]) as e from counts)
    select cod_imovel, e.c as camada, e.n as quantidade, case when e.c = 'funai' then 'nao_verificado' when e.n = 0 then 'ok' when e.c = 'ibama' then 'atencao' else 'alerta' end as estado,
      case when e.c = 'funai' then 'Não verificado' when e.n > 0 then 'Identificado' when e.c = 'ibama' then 'Sem indício espacial' else 'Não identificado' end as status, e.c <> 'outros_cars' as visivel from l""",
)
def confront_layers(spark: SparkSession, sf: str) -> DataFrame:
    """State, status and visibility of every layer of every property."""
    layers = _run(spark, sf).layers
    return layers.select("cod_imovel", "camada", "quantidade", "estado", "status", "visivel")
