"""Canonical projection of a received table onto a registry entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import casts, geometry as geo
from ..sources.delimited import first_match
from ..specs import Dataset
from . import spatial
from .quality import with_flexible_dates


def map_columns(columns: list[str], dataset: Dataset) -> dict[str, str | None]:
    """Received column per canonical field; a required field without one is an error."""
    mapping = {f.name: first_match(columns, f.names) for f in dataset.fields}
    missing = [f.name for f in dataset.fields if f.required and mapping[f.name] is None]
    if missing:
        raise ValueError(f"required fields not found: {', '.join(missing)}")
    return mapping


def canonical(df: DataFrame, dataset: Dataset, source: str, geometry: str | None = "geometry") -> DataFrame:
    """Typed canonical columns, fixed values, source, slug and load time.

    Only the mapped columns are read. Flexible dates add one pass for their profile, and rows with a
    geometry are written once for its repair. Geometries that cannot be repaired drop out
    here and stay in the raw table.
    """
    mapping = map_columns(df.columns, dataset)
    flexible = [mapping[f.name] for f in dataset.fields if f.kind == "date_flexible" and mapping[f.name]]
    typed = with_flexible_dates(df, flexible) if flexible else df
    columns = []
    for f in dataset.fields:
        received = mapping[f.name]
        if received is None:
            columns.append(F.lit(None).cast(_empty_type(f.kind)).alias(f.name))
        elif f.kind == "date_flexible":
            columns.append(F.col(f"{received}_date").alias(f.name))
        else:
            columns.append(casts.cast_as(F.col(received).cast("string"), f.kind).alias(f.name))
    columns += [F.lit(v).alias(k) for k, v in dataset.fixed.items()]
    columns += [
        F.lit(source).alias("fonte"),
        F.lit(dataset.slug).alias("dataset_slug"),
        F.current_timestamp().alias("data_importacao"),
    ]
    if geometry is None or geometry not in df.columns:
        return typed.select(*columns)
    out = spatial.with_valid_geometry(typed.select(*columns, F.col(geometry).isNull().alias("_none"), F.col(geometry).alias("geometry")))
    out = out.withColumn("geometry", geo.to_geographic(F.col("geometry")))
    return out.where(F.col("_none") | F.col("geometry").isNotNull()).drop("_none")


def _empty_type(kind: str) -> str:
    return {
        "integer": "int", "year": "int", "numeric": casts.DECIMAL,
        "date": "date", "date_flexible": "date",
    }.get(kind, "string")
