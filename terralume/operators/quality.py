"""Profiles, gates and counters over a whole table, each in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import casts, geometry as geo, text as tx
from . import spatial, topology

# Temporal cut-off of the alert layer, coordinate ranges of plot points,
# share of rows without key that is still accepted.
FIRST_ALERT_YEAR = 2019
FIRST_ALERT_DATE = "2019-08-01"
LATITUDE_RANGE = (-34, 6)
LONGITUDE_RANGE = (-74, -30)
ALTITUDE_RANGE = (-100, 3000)
POINT_INDEX_RANGE = (0, 100)
INVALID_KEY_RATIO = 0.03

LAYOUTS = ("dmy", "mdy", "ambiguous", "ymd", "compact_dmy", "empty_marker", "unrecognized")


def date_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: how often each date layout occurs and the order for ambiguous values.

    All columns are counted in one pass over the table; the wide row is then
    turned into one row per column.
    """
    counts = [
        F.count_if(F.col(f"_{c}")["layout"] == layout).alias(f"{c}|{layout}")
        for c in columns
        for layout in LAYOUTS
    ]
    wide = casts.with_date_pieces(df, columns).agg(*counts)
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("campo"), *[F.col(f"`{c}|{k}`").alias(k) for k in LAYOUTS])
            for c in columns
        ]
    )
    return wide.select(F.inline(rows)).withColumns(
        {
            "preferencia": casts.dominant_order(F.col("dmy"), F.col("mdy")),
            "formatos_mistos": (F.col("dmy") > 0) & (F.col("mdy") > 0),
        }
    )


def with_flexible_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add `<column>_date`, ambiguous values read in the column's dominant order.

    The profile (one short row per column) is read first, so the conversion is
    a projection with constants.
    """
    profile = date_profile(df, columns).select("campo", "preferencia")
    orders = {r["campo"]: r["preferencia"] for r in profile.collect()}
    dated = {
        f"{c}_date": casts.to_flexible_date(F.col(f"_{c}"), F.lit(orders[c]).cast("string"))
        for c in columns
    }
    split = casts.with_date_pieces(df, columns).withColumns(dated)
    return split.drop(*[f"_{c}" for c in columns])


def unconverted(df: DataFrame, raw: str, converted: Column, samples: int = 20) -> DataFrame:
    """How many meaningful values did not convert, and the first distinct ones.

    Values are counted per distinct text before they are ranked, and the top
    list is a sort with limit, so no task holds all of them. The test is part
    of the aggregate: as a filter it would be pushed into the cast and repeat it.
    """
    lost = casts.has_date_text(F.col(raw)) & converted.isNull()
    per_text = df.groupBy(F.trim(F.col(raw)).alias("valor")).agg(F.count_if(lost).alias("n"))
    failed = per_text.where("n > 0")
    first = failed.orderBy("valor").limit(samples)
    counts = failed.select("n", F.lit(None).cast("string").alias("valor"))
    shown = first.select(F.lit(0).cast("bigint").alias("n"), "valor")
    return counts.unionByName(shown).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("nao_convertidos"),
        F.array_sort(F.collect_list("valor")).alias("amostras"),
    )


def start_date(start_year: int | None = None) -> str:
    """Cut-off of a start year; years before the first one are refused."""
    year = FIRST_ALERT_YEAR if start_year is None else int(start_year)
    if year < FIRST_ALERT_YEAR:
        raise ValueError(f"start year must be {FIRST_ALERT_YEAR} or later")
    return FIRST_ALERT_DATE if year == FIRST_ALERT_YEAR else f"{year}-01-01"


def _temporal(date_text: str, year_text: str) -> tuple[Column, Column]:
    head = F.left(F.trim(F.col(date_text)), F.lit(10))
    iso = F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))
    return iso, casts.loose_year(F.col(year_text))


def temporal_filter(
    df: DataFrame, date_text: str, year_text: str, start_year: int | None = None
) -> DataFrame:
    """Rows with a valid date at or after the cut-off and a valid year."""
    day, year = _temporal(date_text, year_text)
    return df.where((day >= F.lit(start_date(start_year)).cast("date")) & year.isNotNull())


def temporal_profile(
    df: DataFrame, date_text: str, year_text: str, start_year: int | None = None
) -> DataFrame:
    """One row of statistics of the temporal filter, in one pass."""
    day, year = _temporal(date_text, year_text)
    cut = F.lit(start_date(start_year)).cast("date")
    return df.agg(
        F.count(F.lit(1)).alias("registros_originais"),
        F.count_if(day.isNull()).alias("registros_data_invalida"),
        F.count_if(day < cut).alias("registros_descartados"),
        F.count_if((day >= cut) & year.isNotNull()).alias("registros_mantidos"),
        F.count_if(year.isNull()).alias("registros_ano_invalido"),
        F.min(day).alias("data_minima"),
        F.max(day).alias("data_maxima"),
        F.min(year).alias("ano_minimo"),
        F.max(year).alias("ano_maximo"),
    )


def require_rows(profile: DataFrame, column: str) -> None:
    """Stop a load whose filter kept nothing; reads one summary row."""
    if not profile.first()[column]:
        raise ValueError("no row passes the filter; the active version stays")


def point_ranges(lat: Column, lon: Column, altitude: Column, index: Column) -> dict[str, Column]:
    """Violation flag per checked field of a plot point."""
    outside = lambda c, r: F.coalesce(~c.between(*r), F.lit(False))
    return {
        "vl_latitude": outside(lat, LATITUDE_RANGE),
        "vl_longitude": outside(lon, LONGITUDE_RANGE),
        "cgl_vl_altitude": outside(altitude, ALTITUDE_RANGE),
        "nu_indice_ponto": outside(index, POINT_INDEX_RANGE),
    }


def in_ranges(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    bad = F.lit(False)
    for flag in flags.values():
        bad = bad | flag
    return df.where(~bad)


def violation_counts(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row per field with its number of violations."""
    wide = df.agg(*[F.count_if(flag).alias(name) for name, flag in flags.items()])
    return wide.unpivot([], list(flags), "campo", "violacoes")


def field_counters(df: DataFrame, kinds: dict[str, str], required: Sequence[str]) -> DataFrame:
    """Invalid and required-but-empty values per field, one pass."""
    aggs = []
    for name, kind in kinds.items():
        value = F.col(name)
        aggs.append(F.count_if(casts.credit_invalid(value, kind)).alias(f"{name}|i"))
        empty = casts.credit_value(value, kind).isNull() if name in required else F.lit(False)
        aggs.append(F.count_if(empty).alias(f"{name}|e"))
    wide = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("campo"),
                F.col(f"`{name}|i`").alias("invalidos"),
                F.col(f"`{name}|e`").alias("obrigatorios_vazios"),
            )
            for name in kinds
        ]
    )
    return wide.select(F.inline(rows))


def required_rows(df: DataFrame, kinds: dict[str, str], required: Sequence[str]) -> DataFrame:
    """Typed rows whose required values all converted; the rest stays in the raw table."""
    typed = df.withColumns({n: casts.credit_value(F.col(n), k) for n, k in kinds.items()})
    return typed.dropna(subset=list(required))


def state_profile(df: DataFrame, code: str) -> DataFrame:
    """Rows per code prefix: all, well formed, and whether the prefix is a state."""
    trimmed = F.trim(F.col(code))
    prefix = F.upper(F.substring(trimmed, 1, 2))
    shaped = trimmed.rlike("(?i)^[A-Z]{2}-")
    return (
        df.where(F.coalesce(trimmed, F.lit("")) != "")
        .groupBy(prefix.alias("prefixo"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(shaped).alias("formato_ok"))
        .withColumn("uf_valida", F.col("prefixo").isin(*tx.UF_CODES))
    )


def state_gate(df: DataFrame, code: str, admin_uf: str) -> DataFrame:
    """Decision row: the administrative state must occur and no code may be malformed.

    The profile has at most one row per two-character prefix, so the final
    fold works on a bounded set.
    """
    blank = F.coalesce(F.trim(F.col(code)), F.lit("")) == ""
    empty = df.where(blank).agg(F.count(F.lit(1)).alias("n"))
    profile = state_profile(df, code)
    good = F.when(F.col("uf_valida"), F.col("formato_ok")).otherwise(F.lit(0))
    folded = profile.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("_coded"),
        F.coalesce(F.sum(good), F.lit(0)).alias("registros_reconheciveis"),
        F.coalesce(F.sum(F.col("total") - good), F.lit(0)).alias("_malformed"),
        F.coalesce(F.max((F.col("prefixo") == admin_uf) & (good > 0)), F.lit(False)).alias("_found"),
        F.array_join(
            F.array_sort(
                F.collect_list(F.when((good > 0) & (F.col("prefixo") != admin_uf), F.col("prefixo")))
            ),
            ",",
        ).alias("ufs_extras"),
    )
    fora = F.col("_malformed") + F.col("registros_sem_codigo")
    return folded.withColumn("registros_sem_codigo", empty.scalar()).select(
        (F.col("_coded") + F.col("registros_sem_codigo")).alias("registros_total"),
        "registros_sem_codigo",
        "registros_reconheciveis",
        fora.alias("registros_fora_padrao"),
        "ufs_extras",
        F.when(fora > 0, "CODIGO_FORA_PADRAO")
        .when(~F.col("_found"), "UF_AUSENTE")
        .otherwise("ACEITO")
        .alias("decisao"),
    )


def key_quality(df: DataFrame, raw_key: str, limit_ratio: float = INVALID_KEY_RATIO) -> DataFrame:
    """Records, valid and invalid keys, duplicates, invalid examples and the ratio gate.

    Keys are counted per distinct raw text first; a block of copies is one row
    by the time keys are compared.
    """
    raw = df.groupBy(F.col(raw_key).alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    keyed = raw.withColumn("key", tx.integer_key(F.col("raw")))
    valid = keyed.where("key <> ''").groupBy("key").agg(F.sum("n").alias("n"))
    good = valid.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("registros_validos"),
        F.count_if(F.col("n") > 1).alias("chaves_duplicadas"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("linhas_duplicadas"),
    )
    blank = keyed.where("key = ''")
    bad = blank.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    shown = (
        blank.select(F.trim(F.coalesce("raw", F.lit(""))).alias("v")).distinct().orderBy("v").limit(5)
    ).agg(F.array_join(F.array_sort(F.collect_list("v")), "|").alias("v"))
    row = good.withColumns({"registros_sem_chave": bad.scalar(), "exemplos": shown.scalar()})
    total = F.col("registros_validos") + F.col("registros_sem_chave")
    ratio = F.try_divide(F.col("registros_sem_chave"), total)
    return row.withColumns(
        {
            "registros": total,
            "proporcao_sem_chave": F.round(ratio, 6),
            "publicar": (F.col("registros_validos") > 0) & (ratio <= limit_ratio),
        }
    )


def _examined(df: DataFrame, column: str) -> DataFrame:
    """What is wrong with each distinct invalid geometry (``fault``) and whether a repair leaves an area (``left``)."""
    distinct = df.where(F.col("_same.shape").isNotNull()).groupBy("_same").agg(F.first(column).alias("geometry"))
    return topology.faults(distinct, "_same")


def _same(df: DataFrame, column: str) -> DataFrame:
    shaped = spatial.with_shape(df, column)
    return shaped.withColumn("_same", F.struct("shape", F.col(column)["srid"].alias("srid"))).drop("shape")


def geometry_profile(df: DataFrame, column: str) -> DataFrame:
    """Total, null, empty, invalid and repairable geometries; equal ones are examined once."""
    rows = _same(df.select(column), column)
    geom = F.col(column)
    flags = rows.join(_examined(rows, column), "_same", "left").select(
        geom.isNull().alias("null"),
        (geom.isNotNull() & geo.is_empty(geom)).alias("empty"),
        F.col("fault").isNotNull().alias("invalid"),
        (F.col("fault").isNotNull() & F.col("left")).alias("repairable"),
    )
    return flags.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("null").alias("nulas"),
        F.count_if("empty").alias("vazias"),
        F.count_if("invalid").alias("invalidas"),
        F.count_if("repairable").alias("reparaveis"),
    )


def geometry_samples(df: DataFrame, key: str, column: str, samples: int = 50) -> DataFrame:
    """First invalid geometries with a reason."""
    rows = _same(df.select(key, column), column)
    judged = rows.join(_examined(rows, column), "_same", "left")
    reason = F.when(geo.is_empty(F.col(column)), "vazia").otherwise(F.col("fault"))
    return judged.select(key, reason.alias("motivo")).where("motivo is not null").orderBy(key).limit(samples)


def encoding_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per binary column: values with bad UTF-8 and replaced sequences."""
    aggs = []
    for c in columns:
        fixed = tx.repair_utf8(F.col(c))
        aggs.append(F.count_if(fixed["replaced"] > 0).alias(f"{c}|v"))
        aggs.append(F.coalesce(F.sum(fixed["replaced"]), F.lit(0)).alias(f"{c}|s"))
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("campo"),
                F.col(f"`{c}|v`").alias("valores"),
                F.col(f"`{c}|s`").cast("bigint").alias("sequencias"),
            )
            for c in columns
        ]
    )
    return df.agg(*aggs).select(F.inline(rows))


def completeness(expected: DataFrame, written: DataFrame) -> DataFrame:
    """Expected and written row counts and whether they agree."""
    e = expected.agg(F.count(F.lit(1)).alias("esperados"))
    w = written.agg(F.count(F.lit(1)).alias("n"))
    both = e.withColumn("gravados", w.scalar())
    return both.withColumn("completo", F.col("esperados") == F.col("gravados"))


def earlier_same(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """The latest earlier row of the same key, as `<value>_anterior`."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(f"{value}_anterior", F.lag(value).over(w))
