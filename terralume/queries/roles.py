"""Driver tables cast into the roles of the land data, in Spark and in SQL.

Every role reads its whole driver table. Boxes are placed so that the layout
keeps its shape at any scale: a key of n bits becomes a box of side 32/2^(n/2+2)
degrees, so small keys are huge boxes, large keys are small ones, and every
place is covered by a few boxes of each size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..functions.geometry import box_geometry
from ..session import spread
from .registry import table

UF_LIST = "[" + ",".join(f"'{uf}'" for uf in tx.UF_CODES) + "]"


# ---- messy text -----------------------------------------------------------

def messy_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their date and price written in mixed, partly broken formats."""
    o = table(spark, sf, "orders")
    day = lambda layout: F.date_format("o_orderdate", layout)
    price = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    low = (
        F.when(F.col("o_orderstatus") == "F", "--")
        .when(F.col("o_orderstatus") == "O", F.concat(day("yyyy.MM.dd"), F.lit(" 10:30")))
        .otherwise(F.concat(F.lit("31/02/"), day("yyyy")))
    )
    return o.select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        F.when(F.col("o_orderpriority") == "1-URGENT", day("yyyy-MM-dd"))
        .when(F.col("o_orderpriority") == "2-HIGH", day("dd/MM/yyyy"))
        .when(
            F.col("o_orderpriority") == "3-MEDIUM",
            F.when(F.col("o_orderstatus") == "P", day("MM-dd-yyyy")).otherwise(day("d.M.yyyy")),
        )
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", day("dd/MMyyyy"))
        .otherwise(low)
        .alias("raw_date"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" "), F.replace(price, F.lit("."), F.lit(","))))
        .when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("1."), price))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("+"), price))
        .otherwise(price)
        .alias("raw_price"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.col("o_custkey").cast("string"), F.lit(".0")))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("n/d"))
        .when(F.col("o_orderpriority") == "1-URGENT", F.lit("  "))
        .otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string")))
        .alias("raw_key"),
    )


MESSY_SQL = """
messy as (
  select o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
    case o_orderpriority
      when '1-URGENT' then strftime(o_orderdate, '%Y-%m-%d')
      when '2-HIGH' then strftime(o_orderdate, '%d/%m/%Y')
      when '3-MEDIUM' then case when o_orderstatus = 'P' then strftime(o_orderdate, '%m-%d-%Y')
        else day(o_orderdate)::varchar || '.' || month(o_orderdate)::varchar || '.' || year(o_orderdate)::varchar end
      when '4-NOT SPECIFIED' then strftime(o_orderdate, '%d/%m%Y')
      else case o_orderstatus when 'F' then '--'
        when 'O' then strftime(o_orderdate, '%Y.%m.%d') || ' 10:30'
        else '31/02/' || year(o_orderdate)::varchar end
    end as raw_date,
    case when o_orderstatus = 'F' then ' ' || replace(o_totalprice::decimal(12,2)::varchar, '.', ',')
      when o_orderpriority = '5-LOW' then '1.' || o_totalprice::decimal(12,2)::varchar
      when o_orderpriority = '2-HIGH' then '+' || o_totalprice::decimal(12,2)::varchar
      else o_totalprice::decimal(12,2)::varchar end as raw_price,
    case when o_orderstatus = 'F' then o_custkey::varchar || '.0'
      when o_orderpriority = '5-LOW' then 'n/d'
      when o_orderpriority = '1-URGENT' then '  '
      else ' ' || o_custkey::varchar end as raw_key
  from orders)
"""


# ---- placed boxes ---------------------------------------------------------

def _bits(key: Column) -> Column:
    return F.length(F.bin(key + 1))


def placed(df: DataFrame, key: str, a: str, b: str, factor: int, shift: int) -> DataFrame:
    """Add x0, y0, x1, y1 and the box geometry derived from an integer key."""
    n = F.call_function(
        "shiftleft", F.lit(4).cast("bigint"), ((_bits(F.col(key)) - 1) / 2).cast("int")
    )
    spot = (F.col(key) + 1) * factor
    side = F.lit(32.0) / n
    wide = side * (2 + F.col(a) % 3) / 4
    high = side * (2 + F.col(b) % 3) / 4
    x0 = F.lit(-72.0) + (spot % n) * side + side * (F.col(b) % 4) * shift / 4
    y0 = F.lit(-32.0) + (F.floor(spot / n) % n) * side + side * (F.col(a) % 4) * shift / 4
    boxed = df.withColumns({"x0": x0, "y0": y0, "w": wide, "h": high})
    boxed = boxed.withColumns({"x1": F.col("x0") + F.col("w"), "y1": F.col("y0") + F.col("h")})
    return boxed.drop("w", "h").withColumn("geometry", box_geometry(*map(F.col, ("x0", "y0", "x1", "y1"))))


def placed_sql(key: str, a: str, b: str, factor: int, shift: int) -> str:
    n = f"(4::bigint << ((length(bin({key} + 1)) - 1) // 2)::int)"
    side = f"(32.0::double / {n})"
    x0 = f"(-72.0::double + ((({key} + 1) * {factor}) % {n}) * {side} + {side} * ({b} % 4) * {shift} / 4)"
    y0 = (
        f"(-32.0::double + (((({key} + 1) * {factor}) // {n}) % {n}) * {side}"
        f" + {side} * ({a} % 4) * {shift} / 4)"
    )
    return (
        f"{x0} as x0, {y0} as y0, {x0} + {side} * (2 + {a} % 3) / 4 as x1,"
        f" {y0} + {side} * (2 + {b} % 3) / 4 as y1"
    )


def uf_column(nation: str) -> Column:
    return F.element_at(F.array(*map(F.lit, tx.UF_CODES)), F.col(nation) + 1)


def properties(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as rural properties with a code, a state and a box."""
    c = table(spark, sf, "customer").withColumn("k2", F.floor(F.col("c_custkey") / 7))
    boxed = placed(c, "c_custkey", "c_nationkey", "k2", 13, 0)
    uf = uf_column("c_nationkey")
    city = (1100000 + F.col("c_nationkey")).cast("string")
    return boxed.select(
        F.concat_ws("-", uf, city, F.upper(F.md5("c_name"))).alias("cod_imovel"),
        "c_custkey",
        F.col("c_acctbal").alias("area_total_ha"),
        uf.alias("uf"),
        F.col("c_mktsegment").alias("municipio"),
        city.alias("codigo_municipio"),
        F.when(F.col("c_mktsegment") == "BUILDING", "AT")
        .when(F.col("c_mktsegment") == "MACHINERY", "Cancelado")
        .when(F.col("c_mktsegment") == "FURNITURE", "")
        .otherwise("Pendente")
        .alias("situacao_car"),
        "geometry",
    )


PROPERTIES_SQL = f"""
properties as (
  select {UF_LIST}[c_nationkey + 1] || '-' || (1100000 + c_nationkey)::varchar || '-' || upper(md5(c_name)) as cod_imovel,
    c_custkey, c_acctbal as area_total_ha, {UF_LIST}[c_nationkey + 1] as uf, c_mktsegment as municipio,
    (1100000 + c_nationkey)::varchar as codigo_municipio,
    case c_mktsegment when 'BUILDING' then 'AT' when 'MACHINERY' then 'Cancelado'
      when 'FURNITURE' then '' else 'Pendente' end as situacao_car,
    {placed_sql("c_custkey", "c_nationkey", "(c_custkey // 7)", 13, 0)}
  from customer)
"""


def alerts_layer(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as deforestation alerts with class, date, year and box."""
    o = table(spark, sf, "orders").withColumn("k2", F.floor(F.col("o_orderkey") / 5))
    boxed = placed(o, "o_orderkey", "o_custkey", "k2", 17, 1)
    return boxed.select(
        F.col("o_orderkey").alias("fid"),
        (F.year("o_orderdate") + 20).alias("year"),
        F.col("o_orderpriority").alias("class_name"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "desmatamento")
        .when(F.col("o_orderpriority") == "2-HIGH", "Supressão de vegetação")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "QUEIMADA")
        .when(F.col("o_orderpriority") == "5-LOW", "")
        .otherwise("hidrografia")
        .alias("main_class"),
        "geometry",
    )


ALERTS_SQL = f"""
alerts as (
  select o_orderkey as fid, year(o_orderdate) + 20 as year, o_orderpriority as class_name,
    case o_orderpriority when '1-URGENT' then 'desmatamento' when '2-HIGH' then 'Supressão de vegetação'
      when '3-MEDIUM' then 'QUEIMADA' when '5-LOW' then '' else 'hidrografia' end as main_class,
    {placed_sql("o_orderkey", "o_custkey", "(o_orderkey // 5)", 17, 1)}
  from orders)
"""


def embargo_layer(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as embargo terms with a box."""
    s = table(spark, sf, "supplier").withColumn("k2", F.floor(F.col("s_suppkey") / 3))
    boxed = placed(s, "s_suppkey", "s_nationkey", "k2", 11, 1)
    return boxed.select(
        F.col("s_suppkey").alias("seq_tad"),
        F.col("s_name").alias("numero_embargo"),
        uf_column("s_nationkey").alias("uf"),
        F.col("s_acctbal").alias("area_ha"),
        "geometry",
    )


EMBARGO_SQL = f"""
embargo as (
  select s_suppkey as seq_tad, s_name as numero_embargo, {UF_LIST}[s_nationkey + 1] as uf, s_acctbal as area_ha,
    {placed_sql("s_suppkey", "s_nationkey", "(s_suppkey // 3)", 11, 1)}
  from supplier)
"""


def units_layer(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as protected units with a box."""
    p = spread(table(spark, sf, "part")).withColumn("k2", F.floor(F.col("p_partkey") / 4))
    boxed = placed(p, "p_partkey", "p_size", "k2", 19, 1)
    return boxed.select(
        F.col("p_partkey").alias("uc_id"),
        F.col("p_name").alias("nome_uc"),
        F.col("p_type").alias("categoria_manejo"),
        F.col("p_brand").alias("grupo_manejo"),
        "geometry",
    )


UNITS_SQL = f"""
units as (
  select p_partkey as uc_id, p_name as nome_uc, p_type as categoria_manejo, p_brand as grupo_manejo,
    {placed_sql("p_partkey", "p_size", "(p_partkey // 4)", 19, 1)}
  from part)
"""
