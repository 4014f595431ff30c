"""Typing and normalising text columns, and the profiles that go with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import casts, text as tx
from ..operators import quality
from . import roles
from .registry import query, table

# One calendar-checked date in SQL from three text pieces.
def _date(y: str, m: str, d: str) -> str:
    return f"case when {y}::int >= 1000 then try_cast(lpad({y},4,'0') || '-' || lpad({m},2,'0') || '-' || lpad({d},2,'0') as date) end"


_V = "regexp_replace(trim(raw_date), '[ T].*$', '')"
_P = f"string_split(translate({_V}, '.-', '//'), '/')"
_LAYOUT = f"""
layouts as (
  select *, {_V} as v, {_P} as p from messy),
kinds as (
  select *, case when trim(raw_date) = '' then null
    when v in ('-', '--', '0000/00/00', '00/00/0000', '0000-00-00') then 'empty_marker'
    when regexp_full_match(v, '\\d{{4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,2}}') then 'ymd'
    when regexp_full_match(v, '\\d{{1,2}}[-/.]\\d{{1,2}}[-/.]\\d{{4}}') then
      case when p[1]::int between 13 and 31 and p[2]::int between 1 and 12 then 'dmy'
        when p[2]::int between 13 and 31 and p[1]::int between 1 and 12 then 'mdy'
        when p[1]::int between 1 and 12 and p[2]::int between 1 and 12 then 'ambiguous'
        else 'unrecognized' end
    when regexp_full_match(v, '\\d{{1,2}}/\\d{{6}}') then 'compact_dmy'
    else 'unrecognized' end as kind
  from layouts),
prof as (
  select count(*) filter (kind = 'dmy') as dmy, count(*) filter (kind = 'mdy') as mdy,
    count(*) filter (kind = 'ambiguous') as ambiguous, count(*) filter (kind = 'ymd') as ymd,
    count(*) filter (kind = 'compact_dmy') as compact_dmy,
    count(*) filter (kind = 'empty_marker') as empty_marker,
    count(*) filter (kind = 'unrecognized') as unrecognized
  from kinds),
pref as (
  select *, case when dmy > 0 and mdy = 0 then 'DMY' when mdy > 0 and dmy = 0 then 'MDY'
    when dmy = 0 and mdy = 0 then null
    when greatest(dmy, mdy) >= greatest(3, least(dmy, mdy) * 3) then
      case when dmy > mdy then 'DMY' else 'MDY' end end as preferencia
  from prof),
flexible as (
  select o_orderkey, raw_date, case
    when kind = 'ymd' then {_date("p[1]", "p[2]", "p[3]")}
    when kind = 'dmy' or (kind = 'ambiguous' and preferencia = 'DMY') then {_date("p[3]", "p[2]", "p[1]")}
    when kind = 'mdy' or (kind = 'ambiguous' and preferencia = 'MDY') then {_date("p[3]", "p[1]", "p[2]")}
    when kind = 'compact_dmy' then {_date("right(string_split(v,'/')[2],4)", "left(string_split(v,'/')[2],2)", "p[1]")}
    end as d
  from kinds cross join pref)
"""


@query(
    "P4 P5 P6 P23 F12",
    sql=f"""with {roles.MESSY_SQL}
    select o_orderkey,
      case when regexp_full_match(replace(trim(raw_price), ',', '.'), '[-+]?[0-9]+([.][0-9]+)?')
        then replace(trim(raw_price), ',', '.')::decimal(38,10)::double end as price,
      case when regexp_full_match(trim(raw_key), '[-+]?[0-9]+') then trim(raw_key)::int end as key_int,
      case when regexp_full_match(trim(raw_date), '\\d{{2}}[-/]\\d{{2}}[-/]\\d{{4}}') then right(trim(raw_date), 4)::int
        when regexp_full_match(trim(raw_date), '\\d{{4}}-\\d{{2}}-\\d{{2}}') then left(trim(raw_date), 4)::int end as year,
      case when regexp_full_match(trim(raw_key), '[0-9]+(\\.0+)?')
        then split_part(trim(raw_key), '.', 1)::bigint::varchar else '' end as seq_key,
      case when regexp_full_match(trim(raw_key), '[0-9]+') and length(trim(raw_key)) < 4
        then lpad(trim(raw_key), 4, '0') else trim(raw_key) end as code4
    from messy""",
    bench=True,
)
def conform_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Text to numbers, integers, years and padded codes."""
    m = roles.messy_orders(spark, sf)
    return m.select(
        "o_orderkey",
        casts.to_numeric(F.col("raw_price")).cast("double").alias("price"),
        casts.to_integer(F.col("raw_key")).alias("key_int"),
        casts.to_year(F.col("raw_date")).alias("year"),
        tx.integer_key(F.col("raw_key")).alias("seq_key"),
        tx.padded_code(F.col("raw_key"), 4).alias("code4"),
    )


@query(
    "P9",
    sql=f"""with {roles.MESSY_SQL}, {_LAYOUT}
    select o_orderkey, case
      when kind = 'empty_marker' then null
      when kind = 'ymd' then {_date("p[1]", "p[2]", "p[3]")}
      when regexp_full_match(v, '\\d{{1,2}}[-/.]\\d{{1,2}}[-/.]\\d{{4}}') then {_date("p[3]", "p[2]", "p[1]")}
      end::varchar as d
    from kinds""",
)
def conform_strict_dates(spark: SparkSession, sf: str) -> DataFrame:
    m = roles.messy_orders(spark, sf)
    return m.select("o_orderkey", casts.to_strict_date(F.col("raw_date")).cast("string").alias("d"))


@query(
    "P10",
    sql=f"with {roles.MESSY_SQL}, {_LAYOUT} select o_orderkey, d::varchar as d from flexible",
    bench=True,
)
def conform_flexible_dates(spark: SparkSession, sf: str) -> DataFrame:
    dated = quality.with_flexible_dates(roles.messy_orders(spark, sf), ["raw_date"])
    return dated.select("o_orderkey", F.col("raw_date_date").cast("string").alias("d"))


@query(
    "A3",
    sql=f"""with {roles.MESSY_SQL}, {_LAYOUT}
    select 'raw_date' as campo, *, dmy > 0 and mdy > 0 as formatos_mistos from pref""",
)
def date_layout_profile(spark: SparkSession, sf: str) -> DataFrame:
    return quality.date_profile(roles.messy_orders(spark, sf), ["raw_date"])


@query(
    "A4 O6",
    sql=f"""with {roles.MESSY_SQL}, {_LAYOUT}, bad as (
      select trim(raw_date) as valor from flexible
      where d is null and trim(raw_date) <> ''
        and trim(raw_date) not in ('-', '--', '0000/00/00', '00/00/0000', '0000-00-00'))
    select (select count(*) from bad) as nao_convertidos,
      (select coalesce(string_agg(valor, '|' order by valor), '') from
        (select distinct valor from bad order by valor limit 20)) as amostras""",
)
def unconverted_dates(spark: SparkSession, sf: str) -> DataFrame:
    dated = quality.with_flexible_dates(roles.messy_orders(spark, sf), ["raw_date"])
    report = quality.unconverted(dated, "raw_date", F.col("raw_date_date"))
    return report.withColumn("amostras", F.array_join("amostras", "|"))


_CREDIT_SQL = f"""
credit as (
  select o_orderkey, o_orderstatus,
    case when regexp_full_match(replace(replace(trim(raw_key), ' ', ''), ',', '.'), '[0-9]+(\\.[0-9]*)?')
      then replace(trim(raw_key), ',', '.')::double::bigint end as key_int,
    trim(raw_key) <> '' as key_given,
    case when replace(raw_price, ' ', '') like '%,%' and replace(raw_price, ' ', '') not like '%.%'
      then replace(replace(raw_price, ' ', ''), ',', '.') else replace(raw_price, ' ', '') end as price_text,
    case when trim(raw_date) = '' then null else trim(raw_date) end as date_text
  from messy),
typed as (
  select o_orderkey, o_orderstatus, key_int, key_given,
    case when regexp_full_match(price_text, '[-+]?[0-9]+(\\.[0-9]*)?')
      then price_text::decimal(38,10)::double end as price, date_text,
    coalesce(
      case when regexp_full_match(left(date_text, 10), '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') then try_cast(left(date_text, 10) as date) end,
      case when regexp_full_match(left(date_text, 10), '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') then try_strptime(left(date_text, 10), '%d/%m/%Y')::date end,
      case when regexp_full_match(left(date_text, 10), '\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}') then try_strptime(left(date_text, 10), '%d-%m-%Y')::date end
    ) as d
  from credit)
"""


@query(
    "P7 P8 P13",
    sql=f"""with {roles.MESSY_SQL}, {_CREDIT_SQL}
    select o_orderkey, key_int as nu_ordem, price as vl_parc_credito, d::varchar as dt_emissao
    from typed where key_int is not null""",
)
def conform_credit_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Typed credit rows that have their required key."""
    m = roles.messy_orders(spark, sf).select(
        "o_orderkey",
        F.col("raw_key").alias("nu_ordem"),
        F.col("raw_price").alias("vl_parc_credito"),
        F.col("raw_date").alias("dt_emissao"),
    )
    kinds = {"nu_ordem": "integer", "vl_parc_credito": "numeric", "dt_emissao": "date"}
    rows = quality.required_rows(m, kinds, ["nu_ordem"])
    return rows.select(
        "o_orderkey",
        "nu_ordem",
        F.col("vl_parc_credito").cast("double").alias("vl_parc_credito"),
        F.col("dt_emissao").cast("string").alias("dt_emissao"),
    )


@query(
    "A21",
    sql=f"""with {roles.MESSY_SQL}, {_CREDIT_SQL}
    select 'nu_ordem' as campo, count(*) filter (key_given and key_int is null) as invalidos,
      count(*) filter (key_int is null) as obrigatorios_vazios from typed
    union all
    select 'vl_parc_credito', count(*) filter (price is null), 0 from typed
    union all
    select 'dt_emissao', count(*) filter (date_text is not null and d is null), 0 from typed""",
)
def field_error_counters(spark: SparkSession, sf: str) -> DataFrame:
    m = roles.messy_orders(spark, sf).select(
        F.col("raw_key").alias("nu_ordem"),
        F.col("raw_price").alias("vl_parc_credito"),
        F.col("raw_date").alias("dt_emissao"),
    )
    kinds = {"nu_ordem": "integer", "vl_parc_credito": "numeric", "dt_emissao": "date"}
    return quality.field_counters(m, kinds, ["nu_ordem"])


_ALERT_TEXT_SQL = """
alert_text as (
  select o_orderkey, case when o_orderpriority = '5-LOW' and o_orderstatus = 'P' then 'sem data'
      else strftime(o_orderdate + to_years(22), '%Y-%m-%d') || 'T00:00:00' end as image_date,
    case when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' then 's/d'
      else (year(o_orderdate) + 22)::varchar || '.0' end as year
  from orders),
alert_typed as (
  select *, try_cast(case when image_date like '____-__-__%' then left(image_date, 10) end as date) as d,
    case when regexp_full_match(year, '\\d{4}([.]0+)?') then left(year, 4)::int end as y
  from alert_text)
"""


def _alert_text(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    day = F.date_format(F.add_months("o_orderdate", 22 * 12), "yyyy-MM-dd")
    year = (F.year("o_orderdate") + 22).cast("string")
    lost = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")
    vague = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
    return o.select(
        "o_orderkey",
        F.when(lost, "sem data").otherwise(F.concat(day, F.lit("T00:00:00"))).alias("image_date"),
        F.when(vague, "s/d").otherwise(F.concat(year, F.lit(".0"))).alias("year"),
    )


@query(
    "P11",
    sql=f"""with {_ALERT_TEXT_SQL}
    select o_orderkey, y as year from alert_typed where d >= date '2019-08-01' and y is not null""",
)
def alerts_after_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    kept = quality.temporal_filter(_alert_text(spark, sf), "image_date", "year")
    return kept.select("o_orderkey", casts.loose_year(F.col("year")).alias("year"))


@query(
    "A5",
    sql=f"""with {_ALERT_TEXT_SQL}
    select count(*) as registros_originais, count(*) filter (d is null) as registros_data_invalida,
      count(*) filter (d < date '2019-08-01') as registros_descartados,
      count(*) filter (d >= date '2019-08-01' and y is not null) as registros_mantidos,
      count(*) filter (y is null) as registros_ano_invalido,
      min(d)::varchar as data_minima, max(d)::varchar as data_maxima, min(y) as ano_minimo, max(y) as ano_maximo
    from alert_typed""",
)
def temporal_profile(spark: SparkSession, sf: str) -> DataFrame:
    report = quality.temporal_profile(_alert_text(spark, sf), "image_date", "year")
    return report.withColumns(
        {c: F.col(c).cast("string") for c in ("data_minima", "data_maxima")}
    )


# Codes: most rows are proper, some segments carry broken prefixes.
def _codes(spark: SparkSession, sf: str) -> DataFrame:
    p = roles.properties(spark, sf)
    bad = (F.col("municipio") == "FURNITURE") & (F.col("area_total_ha") < 0)
    empty = (F.col("municipio") == "MACHINERY") & (F.col("area_total_ha") < 0)
    return p.select(
        "c_custkey",
        F.when(bad, F.concat(F.lit("XX-"), F.col("cod_imovel")))
        .when(empty, F.lit(" "))
        .otherwise(F.concat(F.lit(" "), F.lower("cod_imovel")))
        .alias("code"),
    )


_CODES_SQL = """
codes as (
  select c_custkey, case when municipio = 'FURNITURE' and area_total_ha < 0 then 'XX-' || cod_imovel
    when municipio = 'MACHINERY' and area_total_ha < 0 then ' ' else ' ' || lower(cod_imovel) end as code
  from properties)
"""
_UF_IN = "(" + ",".join(f"'{u}'" for u in tx.UF_CODES) + ")"


@query(
    "A6 P14 F11",
    sql=f"""with {roles.PROPERTIES_SQL}, {_CODES_SQL}
    select upper(left(trim(code), 2)) as prefixo, count(*) as total,
      count(*) filter (regexp_matches(trim(code), '(?i)^[A-Z]{{2}}-')) as formato_ok,
      upper(left(trim(code), 2)) in {_UF_IN} as uf_valida
    from codes where trim(code) <> '' group by 1""",
)
def state_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return quality.state_profile(_codes(spark, sf), "code")


@query(
    "D14",
    sql=f"""with {roles.PROPERTIES_SQL}, {_CODES_SQL}, x as (
      select trim(code) as code, upper(left(trim(code), 2)) as p,
        trim(code) <> '' and regexp_matches(trim(code), '(?i)^[A-Z]{{2}}-')
          and upper(left(trim(code), 2)) in {_UF_IN} as good from codes)
    select count(*) as registros_total, count(*) filter (code = '') as registros_sem_codigo,
      count(*) filter (good) as registros_reconheciveis,
      count(*) filter (not good) as registros_fora_padrao,
      (select string_agg(p, ',' order by p) from (select distinct p from x where good and p <> 'PE')) as ufs_extras,
      case when count(*) filter (not good) > 0 then 'CODIGO_FORA_PADRAO'
        when count(*) filter (good and p = 'PE') = 0 then 'UF_AUSENTE' else 'ACEITO' end as decisao
    from x""",
)
def state_gate(spark: SparkSession, sf: str) -> DataFrame:
    return quality.state_gate(_codes(spark, sf), "code", "PE")


@query(
    "F8 F10 F11 X4",
    sql=f"""with {roles.PROPERTIES_SQL}, {_CODES_SQL}, c as (
      select c_custkey, code, upper(regexp_replace(code, '[^A-Za-z0-9]', '', 'g')) as bare,
        lpad((c_custkey * 7919 + 12345678901)::varchar, 11, '0') as cpf from codes),
    d as (select *, list_transform(string_split(cpf, ''), lambda x: x::int) as n from c)
    select c_custkey,
      case when regexp_full_match(bare, '[A-Z]{{2}}[0-9]{{7}}[A-Z0-9]{{32}}')
        then bare[1:2] || '-' || bare[3:9] || '-' || bare[10:41] end as car,
      case when regexp_matches(code, '(?i)^\\s*[A-Z]{{2}}-') and upper(left(trim(code), 2)) in {_UF_IN}
        then upper(left(trim(code), 2)) else '' end as uf,
      not regexp_full_match(cpf, '0*|1*|2*|3*|4*|5*|6*|7*|8*|9*')
        and (n[1]*10+n[2]*9+n[3]*8+n[4]*7+n[5]*6+n[6]*5+n[7]*4+n[8]*3+n[9]*2)*10%11%10 = n[10]
        and (n[1]*11+n[2]*10+n[3]*9+n[4]*8+n[5]*7+n[6]*6+n[7]*5+n[8]*4+n[9]*3+n[10]*2)*10%11%10 = n[11] as cpf_ok
    from d""",
)
def validate_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised property code, its state, and check digits of a tax number."""
    c = _codes(spark, sf)
    cpf = F.lpad((F.col("c_custkey") * 7919 + 12345678901).cast("string"), 11, "0")
    return c.select(
        "c_custkey",
        tx.property_code(F.col("code")).alias("car"),
        tx.uf_of_code(F.col("code")).alias("uf"),
        tx.cpf_valid(cpf).alias("cpf_ok"),
    )


_FOLD = "regexp_replace(strip_accents({0}), '[^\\x00-\\x7F]', '', 'g')"


@query(
    "F1 F2 F4 F31",
    sql=f"""with n as (select doc_id, text,
      trim(regexp_replace(lower({_FOLD.format("text")}), '[^a-z0-9]+', '_', 'g'), '_') as norm from documents)
    select doc_id, md5(norm) as norm_md5,
      case when length(i) > 55 then left(i, 47) || '_' || left(sha1(text), 7) else i end as ident,
      left(case when trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) = '' then 'Gleba'
        else trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) end, 80) as name
    from (select *, case when norm = '' then 'camada' when norm[1] between '0' and '9' then 'camada_' || norm else norm end as i from n)""",
    bench=True,
)
def normal_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names, identifiers and display names from whole texts."""
    d = table(spark, sf, "documents")
    return d.select(
        "doc_id",
        F.md5(tx.normal_name(F.col("text"))).alias("norm_md5"),
        tx.identifier(F.col("text")).alias("ident"),
        tx.short_name(F.col("text"), F.lit("Gleba")).alias("name"),
    )


@query(
    "F5 F6",
    sql=f"""with {roles.ALERTS_SQL}, {roles.PROPERTIES_SQL}
    select 'imovel' as kind, c_custkey as id, case situacao_car when 'AT' then 'Ativo' when 'Cancelado' then 'Inativo'
      when '' then case when area_total_ha < 0 then 'Não informada' else 'Ativo' end else 'Pendente' end as label
    from properties
    union all
    select 'alerta', fid, case class_name when '1-URGENT' then 'DESMATAMENTO' when '2-HIGH' then 'DESMATAMENTO'
      when '3-MEDIUM' then 'QUEIMADA' when '5-LOW' then '5-LOW' else 'HIDROGRAFIA' end from alerts""",
)
def status_and_alert_classes(spark: SparkSession, sf: str) -> DataFrame:
    p = roles.properties(spark, sf)
    condition = F.when(F.col("area_total_ha") < 0, "").otherwise("Ativa")
    status = p.select(
        F.lit("imovel").alias("kind"),
        F.col("c_custkey").alias("id"),
        tx.property_status(F.col("situacao_car"), condition).alias("label"),
    )
    a = roles.alerts_layer(spark, sf)
    classes = a.select(
        F.lit("alerta").alias("kind"),
        F.col("fid").alias("id"),
        tx.alert_class(F.col("main_class"), F.col("class_name")).alias("label"),
    )
    return status.unionByName(classes)


@query(
    "F9",
    sql=f"""with {roles.PROPERTIES_SQL}, t as (
      select c_custkey, 'Imóvel ' || replace(cod_imovel, '-', '–') || ' e ' || lower(cod_imovel)
        || ' / ' || substr(cod_imovel, 1, 10) || ' - ' || substr(cod_imovel, 12) as txt from properties)
    select c_custkey, array_to_string(list_sort(list_distinct(regexp_extract_all(
        regexp_replace(replace(upper(txt), '–', '-'), '\\s+', '', 'g'),
        '[A-Z]{{2}}-[0-9]{{7}}-[A-F0-9]{{32}}'))), ',') as codes from t""",
)
def codes_in_free_text(spark: SparkSession, sf: str) -> DataFrame:
    p = roles.properties(spark, sf)
    code = F.col("cod_imovel")
    txt = F.concat(
        F.lit("Imóvel "), F.replace(code, F.lit("-"), F.lit("–")), F.lit(" e "), F.lower(code),
        F.lit(" / "), F.substring(code, 1, 10), F.lit(" - "), F.substr(code, F.lit(12)),
    )
    return p.select(
        "c_custkey", F.array_join(F.array_sort(tx.codes_in_text(txt)), ",").alias("codes")
    )


@query(
    "A20 D15 K13 K14",
    sql=f"""with {roles.MESSY_SQL}, k as (
      select raw_key, case when regexp_full_match(trim(raw_key), '[0-9]+(\\.0+)?')
        then split_part(trim(raw_key), '.', 1)::bigint::varchar else '' end as key from messy),
    g as (select key, count(*) as n from k where key <> '' group by 1)
    select count(*) as registros, count(*) filter (key <> '') as registros_validos,
      count(*) filter (key = '') as registros_sem_chave,
      (select count(*) from g where n > 1) as chaves_duplicadas,
      (select sum(n - 1)::bigint from g) as linhas_duplicadas,
      (select string_agg(v, '|' order by v) from (select distinct trim(raw_key) as v from k where key = '' order by v limit 5)) as exemplos,
      round(count(*) filter (key = '') / count(*), 6) as proporcao_sem_chave,
      count(*) filter (key = '') / count(*) <= 0.03 as publicar
    from k""",
)
def key_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.key_quality(roles.messy_orders(spark, sf), "raw_key")


@query(
    "P12",
    sql="""select campo, violacoes from (
      select count(*) filter (not (s_acctbal / 200 between -34 and 6)) as vl_latitude,
        count(*) filter (not (-s_acctbal / 100 between -74 and -30)) as vl_longitude,
        count(*) filter (not (s_acctbal between -100 and 3000)) as cgl_vl_altitude,
        count(*) filter (not (s_suppkey between 0 and 100)) as nu_indice_ponto from supplier)
      unpivot (violacoes for campo in (vl_latitude, vl_longitude, cgl_vl_altitude, nu_indice_ponto))""",
)
def coordinate_violations(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    bal = F.col("s_acctbal")
    flags = quality.point_ranges(bal / 200, -bal / 100, bal, F.col("s_suppkey"))
    return quality.violation_counts(s, flags)


@query(
    "F32 D18",
    sql="""select 'text' as campo, count(*) filter (lang in ('fr', 'de')) as valores,
      sum(case when lang in ('fr', 'de') then 1 else 0 end)::bigint as sequencias from documents
      union all select 'source', 0, 0 from documents limit 2""",
)
def encoding_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Bad UTF-8 in binary columns; French and German rows get one broken byte."""
    d = table(spark, sf, "documents")
    raw = F.encode("text", "UTF-8")
    broken = F.when(F.col("lang").isin("fr", "de"), F.concat(raw, F.unhex(F.lit("C3")))).otherwise(raw)
    both = d.select(broken.alias("text"), F.encode("source", "UTF-8").alias("source"))
    return quality.encoding_profile(both, ["text", "source"])


@query(
    "F29",
    sql=None,
)
def keyed_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts per hashed user; the secret is a test value."""
    from ..functions.hashing import keyed_hash

    e = table(spark, sf, "events")
    key = keyed_hash(F.lit("login"), F.col("user_id").cast("string"), "test-secret")
    return e.groupBy(key.alias("chave")).agg(F.count(F.lit(1)).alias("tentativas"))
