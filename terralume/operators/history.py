"""Lookups in histories: previous equal import, earlier duplicates, newest versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import UF_CODES


def previous_equal(df: DataFrame, match: Sequence[str], key: str, order: str) -> DataFrame:
    """Add `anterior`: the key of the newest earlier row equal on `match`.

    A lag within the matching rows is enough, so histories are never joined
    with themselves.
    """
    w = Window.partitionBy(*match).orderBy(order)
    return df.withColumn("anterior", F.lag(key).over(w))


def latest(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """Newest row per key by partial aggregation, no sort."""
    best = F.max_by(F.struct(*columns), order).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, "_r.*")


def fresh_today(verified: DataFrame, today: Column, has_rows: Column) -> DataFrame:
    """Skip decision: validated today and the partition still has rows."""
    skip = (F.to_date("validado_em") == today) & has_rows
    return verified.withColumn("pular", F.coalesce(skip, F.lit(False)))


def record_version(versions: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Versions after confirmations; a blank remote date records nothing."""
    given = confirmed.where(F.trim(F.coalesce("data_remota", F.lit(""))) != "")
    old = versions.join(given.select("dataset"), "dataset", "left_anti")
    return old.unionByName(given)


def newest_snapshot(listing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Newest file per (dataset, UF): base name and state in the name, else base name only."""
    shape = rf"(?i)^(.*?)(?:[_-](?:{'|'.join(UF_CODES)}))?(?:[_-]?[0-9][^.]*)?[.][a-z0-9]+$"
    stem = listing.withColumn("base_nome", F.lower(F.regexp_extract("arquivo", shape, 1)))
    met = wanted.withColumn("base_nome", F.lower("base_nome")).join(stem, "base_nome")
    tokens = F.split(F.upper("arquivo"), "[^A-Z]+")
    has_uf = F.array_contains(tokens, F.col("uf")).cast("int")
    return met.groupBy("dataset", "uf").agg(
        F.max_by("arquivo", F.struct(has_uf, "modificado", "arquivo")).alias("arquivo")
    )
