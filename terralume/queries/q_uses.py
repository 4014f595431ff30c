"""Small rules over whole tables: display, ranges, recency, clearing, single registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators import alerts, credit, publish, quality
from .registry import query, table


@query(
    "F33",
    sql="""select o_orderkey, case o_orderstatus when 'F' then '' when 'O' then strftime(o_orderdate::date, '%d/%m/%Y') else o_orderpriority end as texto
      from orders""",
)
def display_values(spark: SparkSession, sf: str) -> DataFrame:
    """Null words become empty, ISO dates are shown day first, other text stays."""
    o = table(spark, sf, "orders")
    raw = (
        F.when(F.col("o_orderstatus") == "F", " None ")
        .when(F.col("o_orderstatus") == "O", F.col("o_orderdate").cast("date").cast("string"))
        .otherwise(F.col("o_orderpriority"))
    )
    return o.select("o_orderkey", tx.clean_display(raw).alias("texto"))


@query(
    "P12",
    sql="""select c_custkey from customer where -c_acctbal / 400 between -34 and 6 and -c_acctbal / 100 between -74 and -30
      and c_acctbal / 10 between -100 and 3000 and c_nationkey between 0 and 20""",
)
def points_in_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose coordinates, altitude and index are all within their ranges."""
    c = table(spark, sf, "customer")
    bal = F.col("c_acctbal")
    flags = quality.point_ranges(-bal / 400, -bal / 100, bal / 10, F.col("c_nationkey") * 5)
    return quality.in_ranges(c, flags).select("c_custkey")


@query(
    "O5",
    sql="""select o_orderkey as id, o_custkey, row_number() over (partition by o_custkey order by
        case when o_orderstatus <> 'P' then year(o_orderdate::date) end desc nulls last, o_orderpriority, o_orderstatus, o_orderkey) as ordem
      from orders""",
)
def recent_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of each operation: newest year first, unknown years last."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        "o_custkey",
        F.when(F.col("o_orderstatus") != "P", F.year(F.col("o_orderdate").cast("date"))).alias("ano"),
        F.col("o_orderpriority").alias("ref_bacen"),
        F.col("o_orderstatus").alias("nu_ordem"),
    )
    return credit.recent_first(o, ["o_custkey"]).select("id", "o_custkey", F.col("ordem").cast("long").alias("ordem"))


_CLEARED = "select o_orderkey, o_orderstatus from orders where o_orderstatus <> 'F'"


@query("K11", sql=_CLEARED)
def cleared_partition(spark: SparkSession, sf: str) -> DataFrame:
    """A table without one partition; the others stay as they are."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return publish.clear_table(o, _entries(spark, sf), "F", F.col("o_orderstatus") == "F")[0]


@query(
    "K11",
    sql="""select distinct o_orderstatus as nome_tabela, case o_orderstatus when 'F' then 'PENDENTE_REVISAO' else 'ATIVA' end as status,
      case when o_orderstatus <> 'F' then sha1(o_orderstatus) end as fingerprint from orders""",
)
def cleared_entry(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue after one table was cleared."""
    o = table(spark, sf, "orders")
    return publish.clear_table(o, _entries(spark, sf), "F", F.col("o_orderstatus") == "F")[1]


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("nome_tabela")).distinct()
    return names.select("nome_tabela", F.lit("ATIVA").alias("status"), F.sha1(F.col("nome_tabela").cast("binary")).alias("fingerprint"))


@query(
    "U3",
    sql="""with m as (select l_orderkey, case when l_linestatus = 'F' then 'ICMBIO' when l_quantity > 25 then 'CNUC' else 'CNUC + ICMBIO' end as f from lineitem)
      select l_orderkey, case when bool_and(f <> 'ICMBIO') then 'CNUC' when bool_and(f = 'ICMBIO') then 'ICMBIO' end as registro from m group by 1""",
)
def single_registers(spark: SparkSession, sf: str) -> DataFrame:
    """The register whose union area may be published, if all units come from one."""
    source = (
        F.when(F.col("l_linestatus") == "F", "ICMBIO").when(F.col("l_quantity") > 25, "CNUC").otherwise("CNUC + ICMBIO")
    )
    merged = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(source).alias("fontes"))
    return merged.select("l_orderkey", alerts.single_register(F.col("fontes"), ("CNUC", "ICMBIO")).alias("registro"))
