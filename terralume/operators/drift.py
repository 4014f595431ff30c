"""Structure drift between two versions of a layer, from field tables.

A field table has layer, nome, tipo, largura, precisao and posicao.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from ..functions import geometry as geo, text as tx
from ..session import materialize

# Weight of name and position, least similarity, change labels in report order.
NAME_WEIGHT = 0.75
LEAST_SIMILARITY = 0.62
GOOD_SIMILARITY = 0.75
KNOWN_PAIRS = 100_000  # pairs of names a task remembers
SEVERITIES = ("NONE", "INFO", "WARNING", "CRITICAL")
INTERNAL_FIELDS = ("fid", "ogc_fid", "id")


def type_family(kind: Column) -> Column:
    """Family of a declared type; the first rule that holds."""
    text = tx.normal_name(kind)
    return (
        F.when(text.rlike("real|float|double|numeric|decimal"), "real")
        .when(text.rlike("integer|int8|int16|int32|int64|long"), "integer")
        .when(text.contains("bool"), "boolean")
        .when(text.rlike("datetime|timestamp"), "datetime")
        .when((text == "date") | text.startswith("date_"), "date")
        .when(text.contains("time"), "time")
        .when(text.rlike("string|text|object|char"), "text")
        .when(text == "", "unknown")
        .otherwise(text)
    )


@F.pandas_udf(DoubleType())
def similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Share of characters in the longest matching blocks of two names."""
    from difflib import SequenceMatcher

    met: dict[tuple[str, str], float] = {}  # names recur from layer to layer
    for a, b in pairs:
        found = []
        for pair in zip(a, b, strict=True):
            if pair not in met:
                met[pair] = SequenceMatcher(None, *pair).ratio()
            found.append(met[pair])
        if len(met) > KNOWN_PAIRS:
            met.clear()
        yield pd.Series(found, dtype="float64")


def _fields(df: DataFrame, mark: str) -> DataFrame:
    """Fields by normalised name; of fields with one normalised name the last counts."""
    names = ("nome", "tipo", "largura", "precisao", "posicao")
    named = df.withColumn("chave", tx.normal_name(F.col("nome"))).where("chave <> ''")
    last = named.groupBy("layer", "chave").agg(F.max_by(F.struct(*names), F.struct("posicao", "nome")).alias("f"))
    return last.select("layer", "chave", *[F.col(f"f.{c}").alias(f"{mark}_{c}") for c in names], type_family(F.col("f.tipo")).alias(f"{mark}_familia"))


def in_place_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Spelling, type and precision of the fields that both versions have."""
    return _in_place(_fields(old, "a").join(_fields(new, "b"), ["layer", "chave"]))


def _in_place(both: DataFrame) -> DataFrame:
    fa, fb = F.col("a_familia"), F.col("b_familia")
    numeric = fa.isin("integer", "real") | fb.isin("integer", "real")
    precise = ~(F.col("a_largura").eqNullSafe(F.col("b_largura")) & F.col("a_precisao").eqNullSafe(F.col("b_precisao")))
    kinds = F.array_compact(
        F.array(
            F.when(F.col("a_nome") != F.col("b_nome"), "FIELD_SPELLING_CHANGED"),
            F.when(fa != fb, "FIELD_TYPE_CHANGED").when(precise & numeric, "NUMERIC_PRECISION_CHANGED"),
        )
    )
    found = both.select("layer", F.explode(kinds).alias("tipo"), F.col("a_nome").alias("de"), F.col("b_nome").alias("para"))
    return found.withColumn("severidade", F.when(F.col("tipo") == "FIELD_SPELLING_CHANGED", "INFO").otherwise("WARNING"))


def field_changes(old: DataFrame, new: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """One row per change of a field: spelling, type, precision, rename, removal, addition.

    `aliases` (campo, nome, and ordem where names of a field have an order) marks
    names of one logical field; the first present in each version stand for the
    field, and two different ones are a rename. Each removed field that is left, in
    the order of names, may be the most similar added field of a compatible type that
    no earlier one took. A layer without old fields has no changes. A layer has a
    bounded number of fields, so the pairing stays small per layer. `confianca` is
    HIGH for renames by alias, MEDIUM or LOW for likely ones, else NULL.
    """
    # Both versions side by side are written once; what is left of either reads them.
    met = materialize(_fields(old, "a").join(_fields(new, "b"), ["layer", "chave"], "full_outer"), "fields")
    in_a, in_b = F.col("a_familia").isNotNull(), F.col("b_familia").isNotNull()
    side = lambda mark: [c for c in met.columns if c.startswith(f"{mark}_")]
    a, b = met.where(in_a).select("layer", "chave", *side("a")), met.where(in_b).select("layer", "chave", *side("b"))
    gone = met.where(in_a & ~in_b).select("layer", F.col("chave").alias("ka"), *side("a"))
    come = met.where(in_b & ~in_a).select("layer", F.col("chave").alias("kb"), *side("b"))
    come = come.join(a.select("layer").distinct(), "layer", "left_semi")
    renames = _alias_renames(a, b, aliases) if aliases is not None else None
    if renames is not None:
        gone = gone.join(renames.select("layer", "ka"), ["layer", "ka"], "left_anti")
        come = come.join(renames.select("layer", "kb"), ["layer", "kb"], "left_anti")
    likely = materialize(_similar_pairs(gone, come), "renames")
    removed = gone.join(likely.select("layer", "ka"), ["layer", "ka"], "left_anti")
    added = come.join(likely.select("layer", "kb"), ["layer", "kb"], "left_anti")
    none = F.lit(None).cast("string")

    def shape(df: DataFrame, tipo: str, de: Column, para: Column, level: str, sure: Column = none) -> DataFrame:
        return df.select("layer", F.lit(tipo).alias("tipo"), de.alias("de"), para.alias("para"), F.lit(level).alias("severidade"), sure.alias("confianca"))

    known = F.when(F.col("s") >= GOOD_SIMILARITY, "MEDIUM").otherwise("LOW")
    out = (
        _in_place(met.where(in_a & in_b)).withColumn("confianca", none)
        .unionByName(shape(likely, "POSSIBLE_FIELD_RENAMED", F.col("a_nome"), F.col("b_nome"), "WARNING", known))
        .unionByName(shape(removed, "FIELD_REMOVED", F.col("a_nome"), none, "WARNING"))
        .unionByName(shape(added, "FIELD_ADDED", none, F.col("b_nome"), "INFO"))
    )
    if renames is not None:
        out = out.unionByName(shape(renames, "FIELD_RENAMED", F.col("a_nome"), F.col("b_nome"), "WARNING", F.lit("HIGH")))
    return out


def _alias_renames(a: DataFrame, b: DataFrame, aliases: DataFrame) -> DataFrame:
    """Logical fields whose first known name differs between the versions."""
    order = F.col("ordem") if "ordem" in aliases.columns else F.lit(0)
    known = aliases.select("campo", tx.normal_name(F.col("nome")).alias("chave"), order.alias("_o")).groupBy("campo", "chave").agg(F.min("_o").alias("_o"))

    def first(fields: DataFrame, mark: str) -> DataFrame:
        met = fields.select("layer", "chave", f"{mark}_nome").join(known, "chave")
        best = met.groupBy("layer", "campo").agg(F.min(F.struct("_o", "chave", f"{mark}_nome")).alias("f"))
        return best.select("layer", "campo", F.col("f.chave").alias(f"k{mark}"), F.col(f"f.{mark}_nome").alias(f"{mark}_nome"))

    return first(a, "a").join(first(b, "b"), ["layer", "campo"]).where("ka <> kb")


def _similar_pairs(gone: DataFrame, come: DataFrame) -> DataFrame:
    """Removed fields, in the order of names, each with the best added field not yet taken."""
    gap = F.abs(F.coalesce("a_posicao", F.lit(0)) - F.coalesce("b_posicao", F.lit(0)))
    near = F.when(gap == 0, 1.0).when(gap == 1, 0.7).otherwise(0.0)
    fa, fb = F.col("a_familia"), F.col("b_familia")
    fits = (fa == fb) | (fa.isin("integer", "real") & fb.isin("integer", "real"))
    pairs = gone.join(come, "layer").where(fits).withColumn("s", similarity("ka", "kb") * NAME_WEIGHT + near * (1 - NAME_WEIGHT))
    choice = F.struct((-F.col("s")).alias("m"), "kb", "s", "a_nome", "b_nome")
    per_field = pairs.where(F.col("s") >= LEAST_SIMILARITY).groupBy("layer", "ka").agg(F.array_sort(F.collect_list(choice)).alias("c"))
    per_layer = per_field.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("ka", "c"))).alias("fields"))
    none = F.array().cast("array<struct<ka:string,kb:string,s:double,a_nome:string,b_nome:string>>")

    def take(taken: Column, field: Column) -> Column:
        free = F.filter(field["c"], lambda c: ~F.array_contains(F.transform(taken, lambda t: t["kb"]), c["kb"]))
        best = F.get(free, F.lit(0))
        row = F.struct(field["ka"].alias("ka"), *[best[n].alias(n) for n in ("kb", "s", "a_nome", "b_nome")])
        return F.when(F.size(free) > 0, F.concat(taken, F.array(row))).otherwise(taken)

    return per_layer.select("layer", F.inline(F.aggregate("fields", none, take)))


def _one_per_change(df: DataFrame, changes: list[tuple[str, str, Column, str, str]]) -> DataFrame:
    """Rows of layer, kind, old and new value and severity for every condition that holds."""
    rows = [
        F.when(
            F.coalesce(holds, F.lit(False)),
            F.struct(
                F.lit(kind).alias("tipo"), F.col(a).cast("string").alias("de"), F.col(b).cast("string").alias("para"),
                F.lit(level).alias("severidade"),
            ),
        )
        for kind, level, holds, a, b in changes
    ]
    return df.select("layer", F.inline(F.array_compact(F.array(*rows))))


def layer_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes of a layer as a whole: its name, its file, its geometry type, its reference system.

    Both tables have layer, nome_camada, arquivo, geometria, epsg and crs.
    Values unknown on either side don't count as changed. A geometry type of
    another family is critical. Codes decide about the reference system; its
    text does where the old version has no code.
    """
    names = ("nome_camada", "arquivo", "geometria", "epsg", "crs")
    side = lambda df, mark: df.select("layer", *[F.col(n).alias(f"{mark}_{n}") for n in names])
    both = side(old, "a").join(side(new, "b"), "layer")
    known = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")) != ""
    other = lambda n: known(f"a_{n}") & ~F.col(f"a_{n}").eqNullSafe(F.col(f"b_{n}"))
    a, b = F.col("a_geometria"), F.col("b_geometria")
    shape = known("a_geometria") & known("b_geometria") & (tx.normal_name(a) != tx.normal_name(b))
    alike = geo.family(a) == geo.family(b)
    code = other("epsg") & known("b_epsg")
    text = ~known("a_epsg") & other("crs") & known("b_crs")
    return _one_per_change(
        both,
        [
            ("LAYER_RENAMED", "WARNING", other("nome_camada"), "a_nome_camada", "b_nome_camada"),
            ("DATASET_FILE_RENAMED", "INFO", other("arquivo"), "a_arquivo", "b_arquivo"),
            ("GEOMETRY_TYPE_CHANGED", "WARNING", shape & alike, "a_geometria", "b_geometria"),
            ("GEOMETRY_TYPE_CHANGED", "CRITICAL", shape & ~alike, "a_geometria", "b_geometria"),
            ("CRS_CHANGED", "WARNING", code, "a_epsg", "b_epsg"),
            ("CRS_CHANGED", "WARNING", text, "a_crs", "b_crs"),
        ],
    )


def dictionary_notes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes of a dictionary's reference systems and character sets, and its conflict with the layer.

    Both tables have layer, srids, charsets (arrays) and epsg, the code of the
    layer itself; that code has priority where the dictionary names others.
    """
    side = lambda df, mark: df.select(
        "layer", F.col("epsg").alias(f"{mark}_epsg"),
        *[F.coalesce(n, F.array()).cast("array<string>").alias(f"{mark}_{n}") for n in ("srids", "charsets")],
    )
    both = side(new, "b").join(side(old, "a").withColumn("_old", F.lit(True)), "layer", "left")
    before = F.col("_old").isNotNull()
    conflict = (F.size("b_srids") > 0) & ~F.array_contains("b_srids", F.col("b_epsg").cast("string"))
    return _one_per_change(
        both,
        [
            ("DICTIONARY_SRID_CHANGED", "INFO", before & (F.col("a_srids") != F.col("b_srids")), "a_srids", "b_srids"),
            ("DICTIONARY_CHARSET_CHANGED", "INFO", before & (F.col("a_charsets") != F.col("b_charsets")), "a_charsets", "b_charsets"),
            ("DICTIONARY_CRS_DIVERGENCE", "WARNING", conflict, "b_epsg", "b_srids"),
        ],
    )


def drift_summary(changes: DataFrame) -> DataFrame:
    """Per layer: highest severity and the count per kind of change as text."""
    level = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severidade"))
    per = changes.groupBy("layer", "tipo").agg(F.count(F.lit(1)).alias("n"), F.max(level).alias("_l"))
    line = F.concat_ws(": ", "tipo", F.col("n").cast("string"))
    return per.groupBy("layer").agg(
        F.element_at(F.array(*map(F.lit, SEVERITIES)), F.max("_l").cast("int")).alias("severidade"),
        F.array_join(F.array_sort(F.collect_list(line)), "; ").alias("resumo"),
        F.sum("n").alias("mudancas"),
    )


def dictionary_differences(actual: DataFrame, documented: DataFrame) -> DataFrame:
    """Fields only documented, only present, or of another type, per layer."""
    a = actual.select("layer", tx.normal_name(F.col("nome")).alias("k"), type_family(F.col("tipo")).alias("fa"))
    d = documented.select("layer", tx.normal_name(F.col("nome")).alias("k"), type_family(F.col("tipo")).alias("fd"))
    met = a.join(d, ["layer", "k"], "full_outer")
    wide = F.col("fa").isin("integer", "real") & F.col("fd").isin("integer", "real")
    problem = (
        F.when(F.col("fa").isNull(), "AUSENTE_NA_CAMADA")
        .when(F.col("fd").isNull() & ~F.col("k").isin(*INTERNAL_FIELDS), "NAO_DOCUMENTADO")
        .when(
            (F.col("fa") != F.col("fd")) & ~wide & (F.col("fa") != "unknown") & (F.col("fd") != "unknown"),
            "TIPO_DIVERGENTE",
        )
    )
    return met.select("layer", F.col("k").alias("campo"), problem.alias("problema")).where("problema is not null")


def metadata_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documented fields removed, added, retyped or redescribed between two catalogues."""
    key = tx.normal_name(F.col("nome"))
    a = old.select("layer", key.alias("k"), F.col("tipo").alias("ta"), F.col("descricao").alias("da"))
    b = new.select("layer", key.alias("k"), F.col("tipo").alias("tb"), F.col("descricao").alias("db"))
    kind = (
        F.when(F.col("tb").isNull(), "DICTIONARY_FIELD_REMOVED")
        .when(F.col("ta").isNull(), "DICTIONARY_FIELD_ADDED")
        .when(tx.normal_name(F.col("ta")) != tx.normal_name(F.col("tb")), "DICTIONARY_TYPE_CHANGED")
        .when(~F.col("da").eqNullSafe(F.col("db")), "DICTIONARY_DESCRIPTION_CHANGED")
    )
    met = a.join(b, ["layer", "k"], "full_outer")
    return met.select("layer", F.col("k").alias("campo"), kind.alias("mudanca")).where("mudanca is not null")


def header_difference(old: Column, new: Column) -> tuple[Column, Column]:
    """Added and missing columns."""
    return F.array_except(new, old), F.array_except(old, new)
