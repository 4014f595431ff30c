"""Row, dataset and resource fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def row_fingerprint(columns: Sequence[Column]) -> Column:
    """MD5 over the values as text, joined by the unit separator."""
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("\u001f", *texts))


def dataset_fingerprint(df: DataFrame, columns: Sequence[str], prefix: int = 4) -> DataFrame:
    """One row: SHA-256 of the content, whatever the row order, and the row count.

    Equal rows are counted before anything is gathered, so a block of copies is
    one entry. The distinct row hashes are then folded per hash prefix; a prefix
    holds an even share because MD5 is uniform, and `prefix` hex digits bound
    that share. The last step gathers one short digest per prefix.
    """
    rows = (
        df.select(row_fingerprint([F.col(c) for c in columns]).alias("h"))
        .groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    entry = F.concat_ws(":", "h", F.col("n").cast("string"))
    folded = rows.groupBy(F.substring("h", 1, prefix).alias("p")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("d"),
        F.sum("n").alias("n"),
    )
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "p", "d")))
    return folded.agg(
        F.sha2(
            F.concat_ws(
                "\n",
                F.array_join(lines, "\n"),
                F.concat(F.lit("rows="), F.coalesce(F.sum("n"), F.lit(0)).cast("string")),
            ),
            256,
        ).alias("sha256"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("registros"),
    )


def resource_signature(keys: Column, hashes: Column) -> Column:
    """One signature for a short list of resources; an absent one counts as MISSING."""
    entries = F.zip_with(
        keys, hashes, lambda k, h: F.concat_ws(":", k, F.coalesce(h, F.lit("MISSING")))
    )
    return F.sha2(F.array_join(F.array_sort(entries), "|"), 256)


def structure_signature(fields: Column, geometry: Column, crs: Column) -> Column:
    """SHA-256 of the sorted field names and types, geometry type and CRS."""
    return F.sha2(
        F.to_json(
            F.struct(
                F.array_sort(fields).alias("fields"),
                geometry.alias("geometry_type"),
                crs.alias("crs"),
            )
        ),
        256,
    )


def keyed_hash(scope: Column, value: Column, secret: str) -> Column:
    """HMAC-SHA256 of `scope|value` in hex."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    message = F.encode(F.concat_ws("|", scope, value), "UTF-8")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def percent_change(base: Column, new: Column) -> Column:
    """Change in percent, two digits; NULL without a base."""
    return F.when(base != 0, F.round((new - base) / base * 100, 2))
