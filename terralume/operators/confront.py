"""Per-property results: own layers, external layers, other properties."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from . import spatial

# List sizes of the reports.
OTHER_LIMIT = 1000
LAYER_LIMIT = 2500
EXPORT_LIMIT = 10000


@dataclass(frozen=True)
class Indexed:
    """A feature table with its shape ids, and the materialised table of its shapes."""

    features: DataFrame
    shapes: DataFrame

    @classmethod
    def of(cls, df: DataFrame) -> Indexed:
        """The shape table is read by the cell join, the overlay and the areas; `valid_shapes` writes it once."""
        features = spatial.with_shape(df)
        return cls(features.drop("geometry"), spatial.valid_shapes(features))


def other_pairs(properties: Indexed) -> DataFrame:
    """Shared area of all ordered pairs of shapes of properties, in the shared folder.

    Each unordered pair of shapes is measured once and mirrored. Properties
    that share one shape overlap each other completely; that pair is added per
    shape.
    """
    side = properties.shapes
    half = materialize(spatial.shape_overlaps(side, side, once=True), "pairs")
    mirrored = half.select(F.col("b").alias("a"), F.col("a").alias("b"), "area_m2")
    same = (
        side.where("copies > 1")
        .select("shape")
        .join(spatial.shape_areas(side), "shape")
        .select(F.col("shape").alias("a"), F.col("shape").alias("b"), F.col("m2").alias("area_m2"))
    )
    return half.unionByName(mirrored).unionByName(same)


def other_counts(properties: Indexed, pairs: DataFrame, limit: int = OTHER_LIMIT) -> DataFrame:
    """How many other properties overlap each one, their shared area, and whether the list is cut."""
    mine = properties.features.select("cod_imovel", "shape")
    return spatial.overlap_counts(mine, pairs, properties.shapes, "cod_imovel", itself=True).select(
        "cod_imovel",
        "quantidade",
        (F.col("quantidade") > limit).alias("truncada"),
        (F.col("soma_m2") / 10000).alias("area_soma_ha"),
    )


def other_properties(
    properties: Indexed, limit: int = OTHER_LIMIT, pairs: DataFrame | None = None
) -> DataFrame:
    """Overlaps with other properties, both percentages, largest first.

    A shape's members are cut to the first limit + 1 by code, which is all any
    list of this length can hold besides the property itself.
    """
    areas = spatial.shape_areas(properties.shapes)
    pairs = other_pairs(properties) if pairs is None else pairs
    mine = properties.features.select("cod_imovel", "shape")
    theirs = mine.withColumnRenamed("cod_imovel", "outro")
    rows = spatial.member_overlaps(mine, theirs, pairs, "cod_imovel", "outro", limit, itself=True)
    pa = areas.select(F.col("shape").alias("a"), F.col("m2").alias("am"))
    pb = areas.select(F.col("shape").alias("b"), F.col("m2").alias("bm"))
    full = rows.join(pa, "a").join(pb, "b")
    return full.select(
        "cod_imovel",
        "outro",
        "ordem",
        (F.col("area_m2") / 10000).alias("area_sobreposta_ha"),
        spatial.percent(F.col("area_m2"), F.col("am")).alias("percentual_car_consultado"),
        spatial.percent(F.col("area_m2"), F.col("bm")).alias("percentual_outro_car"),
    )


@dataclass(frozen=True)
class LayerResult:
    """One layer against all properties; `records` ranked, `counts` and `groups` whole, `union` on demand."""

    records: DataFrame
    counts: DataFrame
    groups: DataFrame
    pieces: DataFrame
    union: DataFrame


def external_layer(
    properties: Indexed,
    layer: DataFrame,
    feature: str,
    where: Column | None = None,
    limit: int = spatial.EXTERNAL_LIMIT,
    values: Sequence[str] = (),
) -> LayerResult:
    """Ranked overlaps, counts with truncation flag and sum, groups by values, clipped shapes and union area.

    `limit` is the length of the ranked list alone; counts, sums, groups and the union cover everything.
    `groups` counts the overlaps of a property by `values` of the layer, whose rows are looked up by
    `feature`; what is summed over records reads them, not the list.

    The pair table is written once; every result is a plan over it, so only
    what is used is computed.
    """
    kept = layer.where(where) if where is not None else layer
    feats = Indexed.of(kept)
    ps, fs = properties.shapes, feats.shapes
    pairs = materialize(spatial.shape_overlaps(ps, fs), "pairs")
    mine = properties.features.select("cod_imovel", "shape")
    rows = spatial.member_overlaps(mine, feats.features, pairs, "cod_imovel", feature, limit)
    pa = spatial.shape_areas(ps).select(F.col("shape").alias("a"), F.col("m2").alias("_pm"))
    fa = spatial.shape_areas(fs).select(F.col("shape").alias("b"), F.col("m2").alias("_fm"))
    records = rows.join(pa, "a").join(fa, "b").select(
        "cod_imovel",
        feature,
        "ordem",
        (F.col("_fm") / 10000).alias("area_geometria_ha"),
        (F.col("area_m2") / 10000).alias("area_sobreposta_ha"),
        spatial.percent(F.col("area_m2"), F.col("_pm")).alias("percentual_car"),
        spatial.percent(F.col("area_m2"), F.col("_fm")).alias("percentual_fonte"),
    )
    counts = spatial.overlap_counts(mine, pairs, fs, "cod_imovel").select(
        "cod_imovel",
        "quantidade",
        (F.col("quantidade") > limit).alias("truncada"),
        (F.col("soma_m2") / 10000).alias("area_soma_ha"),
    )
    described = feats.features.select("shape", feature).join(kept.select(feature, *values), feature)
    groups = spatial.overlap_groups(mine, described, pairs, "cod_imovel", values).select(
        "cod_imovel", *values, "quantidade", (F.col("soma_m2") / 10000).alias("area_sobreposta_ha")
    )
    pieces = spatial.intersection_shapes(pairs, ps, fs)
    covered = spatial.union_areas(pieces, ["a"])
    union = mine.select(F.col("shape").alias("a"), "cod_imovel").join(covered, "a").select(
        "cod_imovel", (F.col("area_unica_m2") / 10000).alias("area_unica_sobreposta_ha")
    )
    return LayerResult(records, counts, groups, pieces, union)


def own_layers(
    properties: DataFrame, features: DataFrame, limit: int = LAYER_LIMIT
) -> DataFrame:
    """Thematic layers of each property by code: count, total area, truncation.

    `features` has cod_imovel, camada and area_ha; the total is NULL when no
    feature has an area. Features are counted per key before the join.
    """
    per = features.groupBy("cod_imovel", "camada").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("area_ha").cast("decimal(28,6)")).alias("total")
    )
    return properties.select("cod_imovel").join(per, "cod_imovel").select(
        "cod_imovel",
        "camada",
        F.col("n").alias("quantidade"),
        F.col("total").cast("double").alias("total_area_ha"),
        (F.col("n") > limit).alias("truncada"),
    )


def export_allowed(counts: DataFrame, limit: int = EXPORT_LIMIT) -> DataFrame:
    """Refuse an export with more features than the limit."""
    return counts.withColumn("exportar", F.col("quantidade") <= limit)


def contract_overlaps(properties: Indexed, features: DataFrame, key: str) -> DataFrame:
    """Contract variant: any positive area, rounded to four digits; attributes of `features` kept."""
    feats = Indexed.of(features)
    ps = properties.shapes
    pairs = spatial.shape_overlaps(ps, feats.shapes, tolerance=0.0)
    areas = spatial.shape_areas(ps).select(F.col("shape").alias("a"), F.col("m2").alias("_pm"))
    mine = properties.features.select(F.col("shape").alias("a"), "cod_imovel").join(areas, "a")
    theirs = feats.features.withColumnRenamed("shape", "b")
    return (
        mine.join(pairs, "a")
        .join(theirs, "b")
        .withColumns(
            {
                "area_sobreposta_ha": F.round(F.col("area_m2") / 10000, 4),
                "percentual_sobreposto": F.round(spatial.percent(F.col("area_m2"), F.col("_pm")), 4),
            }
        )
        .drop("a", "b", "area_m2", "_pm")
    )


# Least area of a plot warning, and its label outside the property.
WARNING_M2 = 0.01
# Plots of one property that are paired without a grid.
SIBLINGS = 256
OUTSIDE_LABEL = "Fora do limite do CAR"


def plot_warnings(plots: DataFrame, properties: Indexed, references: DataFrame) -> DataFrame:
    """Warning labels per drawn plot: reference layers, outside its property, sibling plots.

    `plots` has plot, cod_imovel, nome; `references` has rotulo. The part of a
    plot outside its property is its area minus the shared area, so no
    difference geometry is built. The edges of plots are sent to their property once, where
    they meet its own and those of siblings; the plots of a property with very many are paired
    through the grid.
    """
    mine = Indexed.of(plots)
    layer = Indexed.of(references)
    feats = mine.features.select(F.col("shape").alias("a"), "plot", "cod_imovel", "nome")

    labels = layer.features.select(F.col("shape").alias("b"), "rotulo").distinct()
    near = spatial.shape_overlaps(mine.shapes, layer.shapes, WARNING_M2)
    by_layer = feats.join(near, "a").join(labels, "b").select("plot", "rotulo")

    # One shuffle serves the joins with the property and with the siblings, which read the same columns.
    drawn = spatial.with_edges(feats, mine.shapes, "a", ["plot", "cod_imovel", "nome"]).repartition("cod_imovel")
    owner = properties.features.select("cod_imovel", F.col("shape").alias("b"))
    owned = spatial.with_edges(owner, properties.shapes, "b", ["cod_imovel"], "left")
    inside = drawn.join(owned, "cod_imovel").groupBy("cod_imovel", "plot", "nome", "a", "m2a", "b").agg(spatial.shared_m2().alias("area_m2"))
    beyond = inside.where(F.col("m2a") - F.coalesce("area_m2", F.lit(0.0)) > WARNING_M2)
    outside = beyond.select("plot", F.lit(OUTSIDE_LABEL).alias("rotulo"))

    crowded = materialize(feats.groupBy("cod_imovel").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SIBLINGS).select("cod_imovel"), "crowded")
    label = F.concat(F.lit("Polígono: "), "nome").alias("rotulo")
    if crowded.isEmpty():
        siblings = _siblings(drawn, label)
    else:
        siblings = _siblings(drawn.join(crowded, "cod_imovel", "left_anti"), label)
        siblings = siblings.unionByName(_siblings_in_grid(feats.join(crowded, "cod_imovel", "left_semi"), mine.shapes, label))
    found = by_layer.unionByName(outside).unionByName(siblings)
    return found.groupBy("plot").agg(F.array_sort(F.collect_set("rotulo")).alias("avisos"))


def _siblings(drawn: DataFrame, label: Column) -> DataFrame:
    """Labels of the plots that overlap a plot of the same property."""
    other = drawn.select(
        "cod_imovel", F.col("plot").alias("_p"), F.col("nome").alias("_n"), F.col("a").alias("b"),
        *[F.col(f"{c}a").alias(f"{c}b") for c in spatial.EDGE_COLUMNS],
    )
    apart = F.coalesce(F.col("plot") != F.col("_p"), F.lit(False))
    pairs = drawn.join(other, "cod_imovel").where(apart & spatial.slices_meet())
    met = pairs.groupBy("cod_imovel", "plot", "nome", "a", "m2a", "_p", "_n", "b", "m2b").agg(spatial.shared_m2().alias("area_m2"))
    return met.where(F.col("area_m2") > WARNING_M2).select("plot", F.col("_n").alias("nome")).select("plot", label)


def _siblings_in_grid(feats: DataFrame, shapes: DataFrame, label: Column) -> DataFrame:
    """The same, of properties with so many plots that their pairs are found by place."""
    side = shapes.join(feats.select(F.col("a").alias("shape")), "shape", "left_semi")
    met = spatial.shape_overlaps(side, side, WARNING_M2).select("a", "b")
    other = feats.select(F.col("a").alias("b"), "cod_imovel", F.col("plot").alias("_p"), label)
    return feats.drop("nome").join(met, "a").join(other, ["b", "cod_imovel"]).where("plot <> _p").select("plot", "rotulo")
