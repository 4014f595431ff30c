"""Which dataset a received layer is: scores, selection, decision, classification.

Layers and datasets are tables: `layers` has layer, nome, geometria, campos
(array) and assinatura; `specs` has dataset, campo, alias, ordem, obrigatorio;
`profiles` has dataset, familias, tokens, sinais. They meet on normalised field
names, so nothing is compared with everything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as geo, text as tx
from ..session import materialize

# Points per kind of evidence, margins, history bonus, least structure.
GEOMETRY_POINTS = 3
REQUIRED_POINTS = 3
MAPPED_CAP = 4
SIGNAL_CAP = 3
TOKEN_POINTS = 3
HISTORY_BONUS = 5
LEAST_STRUCTURE = 6
STRONG_STRUCTURE = 9
MARGIN = 2
FIELD_OVERLAP = 0.8


def _names(column: Column) -> Column:
    return F.transform(column, tx.normal_name)


def _prefix_keys(name: Column) -> Column:
    """A name under its full form and, from eight letters on, its first eight."""
    return F.when(F.length(name) >= 8, F.array(name, F.concat(F.lit("8:"), F.left(name, F.lit(8))))).otherwise(
        F.array(name)
    )


def matched_fields(layers: DataFrame, specs: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """(layer, dataset, campo) wherever any alias matches any field of the layer.

    Equal names meet on the name, truncated ones on their first eight letters
    followed by the prefix test. A name that many layers have is a key of many
    rows, so the names asked for are written once: their size lets Spark send them
    to the layers where they are few. `carried` are columns of the specs that
    dataset and campo determine.
    """
    have = layers.select("layer", F.explode(F.array_distinct(_names(F.col("campos")))).alias("h"))
    want = specs.select("dataset", "campo", *carried, tx.normal_name(F.col("alias")).alias("w")).distinct()
    have = have.where("h <> ''").withColumn("k", F.explode(_prefix_keys(F.col("h"))))
    want = materialize(want.where("w <> ''").withColumn("k", F.explode(_prefix_keys(F.col("w")))), "names")
    # Equal names count under their full form alone, so long ones come once.
    met = have.join(want, "k").where(
        F.when(F.col("h") == F.col("w"), F.col("k") == F.col("h"))
        .otherwise(
            (F.least(F.length("h"), F.length("w")) >= 8)
            & (F.col("h").startswith(F.col("w")) | F.col("w").startswith(F.col("h")))
        )
    )
    return met.select("layer", "dataset", "campo", *carried).distinct()


def has_phrase(text: Column, token: Column) -> Column:
    """The token as whole segments of the normalised text."""
    hay = F.concat(F.lit("_"), tx.normal_name(text), F.lit("_"))
    needle = F.concat(F.lit("_"), tx.normal_name(token), F.lit("_"))
    return (tx.normal_name(token) != "") & hay.contains(needle)


def score_layers(layers: DataFrame, specs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Evidence of every (layer, dataset) that shares at least one field or signal.

    Geometry alone is below every threshold, so a pair that shares neither gets
    no row. Signals need not be fields of the dataset; they match by the same
    rule as fields, so cut names count.
    """
    sizes = specs.groupBy("dataset").agg(
        F.count_distinct("campo").alias("campos_total"),
        F.count_distinct(F.when(F.col("obrigatorio"), F.col("campo"))).alias("obrigatorios"),
    )
    needed = specs.where("obrigatorio").select("dataset", "campo").distinct().withColumn("_o", F.lit(1))
    asked = specs.select("dataset", "campo", "alias").join(needed, ["dataset", "campo"], "left")
    mapped = (
        matched_fields(layers, asked, ["_o"])
        .groupBy("layer", "dataset")
        .agg(F.count(F.lit(1)).alias("mapeados"), F.count("_o").alias("obrigatorios_ok"))
    )
    signal = profiles.select("dataset", F.explode("sinais").alias("campo")).withColumn("alias", F.col("campo"))
    signals = matched_fields(layers, signal).groupBy("layer", "dataset").agg(F.count(F.lit(1)).alias("sinais_ok"))
    evidence = mapped.join(signals, ["layer", "dataset"], "full").na.fill(
        0, ["mapeados", "obrigatorios_ok", "sinais_ok"]
    )
    # A row a dataset, met by all layers: written once, as the names are.
    datasets = materialize(sizes.join(profiles, "dataset"), "datasets")
    full = (
        evidence.join(datasets, "dataset")
        .join(layers.select("layer", "nome", "geometria", "assinatura"), "layer")
    )
    tokens = F.size(F.filter("tokens", lambda t: has_phrase(F.col("nome"), t)))
    scored = full.withColumns(
        {
            "geometria_ok": F.array_contains("familias", geo.family(F.col("geometria"))),
            "obrigatorio_ok": (F.col("obrigatorios") == F.col("obrigatorios_ok")),
            "sinais_ok": F.col("sinais_ok").cast("int"),
            "tokens_ok": tokens,
        }
    )
    structure = (
        F.when(F.col("geometria_ok"), GEOMETRY_POINTS).otherwise(0)
        + F.when(F.col("obrigatorio_ok") & (F.col("obrigatorios") > 0), REQUIRED_POINTS).otherwise(0)
        + F.least("mapeados", F.lit(MAPPED_CAP))
        + F.least("sinais_ok", F.lit(SIGNAL_CAP))
    )
    return scored.select(
        "layer", "dataset", "geometria_ok", "obrigatorio_ok", "mapeados", "sinais_ok", "tokens_ok",
        structure.cast("int").alias("estrutura"),
        (structure + F.when(F.col("tokens_ok") > 0, TOKEN_POINTS).otherwise(0)).cast("int").alias("pontos"),
        F.round(F.col("mapeados") / F.col("campos_total"), 4).alias("cobertura"),
    )


def select_layers(scores: DataFrame, package: DataFrame) -> DataFrame:
    """Main layer per (package, dataset), or the reason there is none.

    `package` maps layers to packages. Layers of another geometry family leave
    first; complete ones beat incomplete ones; the best must lead decisively.
    """
    fit = scores.join(package, "layer").where("geometria_ok")
    group = Window.partitionBy("pacote", "dataset")
    complete = F.max("obrigatorio_ok").over(group)
    fit = fit.withColumn("_any", complete).where(F.col("obrigatorio_ok") | ~F.col("_any"))
    order = group.orderBy(
        F.col("pontos").desc(), F.col("estrutura").desc(), F.col("tokens_ok").desc(),
        F.col("mapeados").desc(), F.col("cobertura").desc(), "layer",
    )
    after = {f"{c}_2": F.lead(c).over(order) for c in ("pontos", "estrutura", "tokens_ok", "mapeados")}
    ranked = fit.withColumns({"_rn": F.row_number().over(order), **after}).where("_rn = 1")
    alone = F.col("pontos_2").isNull()
    decisive = (
        (F.col("pontos") >= F.col("pontos_2") + MARGIN)
        | ((F.col("tokens_ok") > 0) & (F.col("tokens_ok_2") == 0))
        | (F.col("mapeados") >= F.col("mapeados_2") + MARGIN)
        | (F.col("estrutura") >= F.col("estrutura_2") + MARGIN)
    )
    return ranked.select(
        "pacote", "dataset", "layer", "pontos", "estrutura", "mapeados", "tokens_ok", "obrigatorio_ok",
        F.when(alone, "CAMADA_UNICA")
        .when(decisive, "MELHOR_ASSINATURA_ESTRUTURAL")
        .otherwise("AMBIGUO")
        .alias("criterio"),
    )


def compatible_structure(old_fields: Column, new_fields: Column, old_type: Column, new_type: Column) -> Column:
    """Same geometry family and at least 80 % common field names."""
    a, b = F.array_distinct(_names(old_fields)), F.array_distinct(_names(new_fields))
    shared = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))
    return (geo.family(old_type) == geo.family(new_type)) & (shared >= FIELD_OVERLAP)


def decide_identity(scores: DataFrame, wanted: DataFrame, history: DataFrame) -> DataFrame:
    """Confirm or refuse the chosen dataset of each layer.

    `wanted` has layer and dataset; `history` has layer, exato and compativel
    from the last confirmed snapshot. The strongest other dataset is found by
    one aggregation over the scores.
    """
    target = wanted.join(scores, ["layer", "dataset"], "left")
    rivals = scores.where(f"estrutura >= {LEAST_STRUCTURE} or pontos >= 9").join(
        wanted.select("layer", F.col("dataset").alias("_w")), "layer"
    ).where("dataset <> _w")
    strength = F.struct("pontos", "estrutura", "dataset", "mapeados")
    best = rivals.groupBy("layer").agg(
        F.max(strength).alias("r"),
        F.max(F.when(F.col("tokens_ok") > 0, strength)).alias("n"),
        F.max(F.when(F.col("estrutura") >= LEAST_STRUCTURE, strength)).alias("s"),
    )
    j = target.join(best, "layer", "left").join(history, "layer", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    named_rival = (
        (zero("tokens_ok") == 0)
        & (zero("n.estrutura") >= F.greatest(F.lit(LEAST_STRUCTURE), zero("estrutura") - 1))
        & (zero("n.pontos") >= zero("pontos") + MARGIN)
    )
    clearly_other = (zero("r.pontos") >= zero("pontos") + MARGIN) | (
        F.col("n").isNotNull() & (zero("n.estrutura") >= zero("estrutura"))
    )
    strong = (
        yes("obrigatorio_ok")
        & (zero("mapeados") >= 3)
        & (zero("estrutura") >= STRONG_STRUCTURE)
        & (
            (zero("estrutura") - zero("s.estrutura") >= MARGIN)
            | (zero("mapeados") - zero("s.mapeados") >= MARGIN)
        )
    )
    named = (zero("tokens_ok") > 0) & (zero("estrutura") >= LEAST_STRUCTURE)
    outcome = (
        F.when(~yes("geometria_ok"), "INCOMPATIVEL:GEOMETRIA")
        .when(yes("exato"), "CONFIRMADO:ASSINATURA_HISTORICA_CONFIRMADA")
        .when(yes("compativel") & yes("obrigatorio_ok"), "CONFIRMADO:ESTRUTURA_HISTORICA_COMPATIVEL")
        .when(named_rival, "INCOMPATIVEL:NOME_DE_OUTRO")
        .when(~yes("obrigatorio_ok") & clearly_other, "INCOMPATIVEL:CONTEUDO_DE_OUTRO")
        .when(~yes("obrigatorio_ok"), "NAO_CONFIRMADO:CAMPOS_MINIMOS")
        .when(named & (zero("r.pontos") >= zero("pontos") + 3), "INCOMPATIVEL:CONTEUDO_DE_OUTRO")
        .when(named, "CONFIRMADO:NOME_E_ESTRUTURA")
        .when(strong, "CONFIRMADO:ESTRUTURA_FORTE_APOS_RENOMEACAO")
        .otherwise("NAO_CONFIRMADO:PARCIAL")
    )
    both = F.split(outcome, ":")
    suggested = F.when(F.get(both, F.lit(1)) == "NOME_DE_OUTRO", F.col("n.dataset")).when(
        F.get(both, F.lit(1)) == "CONTEUDO_DE_OUTRO", F.col("r.dataset")
    )
    return j.select(
        "layer", "dataset", F.get(both, F.lit(0)).alias("status"), F.get(both, F.lit(1)).alias("criterio"),
        suggested.alias("dataset_sugerido"),
    )


def name_hits(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Per (file, dataset): longest pattern and how many patterns the name contains.

    `files` has arquivo; `patterns` has dataset and padrao. Names meet patterns
    on the pattern's leading word, then the whole pattern is checked.
    """
    name = tx.normal_name(F.col("arquivo"))
    words = files.select("arquivo", name.alias("n")).withColumn("w", F.explode(F.array_distinct(F.split("n", "_"))))
    clean = patterns.select("dataset", tx.normal_name(F.regexp_replace("padrao", "[*?]", "")).alias("p")).distinct()
    lead = clean.where("p <> ''").withColumn("w", F.get(F.split("p", "_"), F.lit(0)))
    # Words such as the common start of all names are keys of many rows; the patterns are written once for their size.
    hits = words.join(materialize(lead, "patterns"), "w").where(F.concat(F.lit("_"), "n", F.lit("_")).contains(F.concat(F.lit("_"), F.col("p"), F.lit("_"))))
    return hits.groupBy("arquivo", "dataset").agg(
        F.max(F.length("p")).alias("maior"), F.count_distinct("p").alias("padroes")
    )


def classify_files(hits: DataFrame, eligible: DataFrame, files: DataFrame) -> DataFrame:
    """Dataset of each file: by name confirmed by structure, else by structure alone.

    `eligible` has arquivo, dataset, historico, estrutura, mapeados for datasets
    whose geometry and required fields fit. A name that points elsewhere sends
    the file to review.
    """
    by_name = Window.partitionBy("arquivo").orderBy(F.col("maior").desc(), F.col("padroes").desc())
    leaders = hits.withColumn("_r", F.rank().over(by_name)).where("_r = 1").select("arquivo", "dataset")
    named = leaders.select("arquivo").distinct().withColumn("_named", F.lit(True))
    marked = leaders.withColumn("_lead", F.lit(True))
    pool = eligible.join(named, "arquivo", "left").join(marked, ["arquivo", "dataset"], "left")
    pool = pool.where(F.col("_named").isNull() | F.col("_lead"))
    order = Window.partitionBy("arquivo").orderBy(
        F.col("historico").desc(), F.col("estrutura").desc(), F.col("mapeados").desc(), "dataset"
    )
    top = pool.withColumns(
        {
            "_rn": F.row_number().over(order),
            "_h2": F.lead("historico").over(order),
            "_e2": F.lead("estrutura").over(order),
            "_m2": F.lead("mapeados").over(order),
        }
    ).where("_rn = 1")
    decisive = (
        F.col("_e2").isNull()
        | (F.col("historico") & ~F.col("_h2"))
        | (F.col("estrutura") >= F.col("_e2") + MARGIN)
        | (F.col("mapeados") >= F.col("_m2") + MARGIN)
    )
    best = top.select("arquivo", F.when(decisive, F.col("dataset")).alias("escolhido"), F.col("historico"))
    joined = files.select("arquivo").distinct().join(named, "arquivo", "left").join(
        best.withColumn("_any", F.lit(True)), "arquivo", "left"
    )
    status = (
        F.when(F.col("escolhido").isNotNull(), "CLASSIFICADO")
        .when(F.col("_any"), "AMBIGUO")
        .when(F.col("_named"), "NOME_NAO_CONFIRMADO")
        .otherwise("NAO_CLASSIFICADO")
    )
    criterion = F.when(
        F.col("escolhido").isNotNull(),
        F.when(F.col("_named"), "NOME_OFICIAL_E_ESTRUTURA")
        .when(F.col("historico"), "HISTORICO_CONFIAVEL_E_ESTRUTURA")
        .otherwise("ESTRUTURA_COM_MARGEM_FORTE"),
    )
    return joined.select("arquivo", F.col("escolhido").alias("dataset"), status.alias("status"), criterion.alias("criterio"))


def classify_headers(headers: DataFrame, specs: DataFrame) -> DataFrame:
    """Tabular files by header: all required fields present, unique best count.

    `headers` has arquivo and campos.
    """
    have = headers.select("arquivo", F.explode(F.array_distinct(_names(F.col("campos")))).alias("h"))
    want = specs.select("dataset", "campo", "obrigatorio", tx.normal_name(F.col("alias")).alias("h")).distinct()
    # A name that many files have is a key of many rows; the names asked for are written once for their size.
    want = materialize(want, "names")
    hits = have.join(want, "h").select("arquivo", "dataset", "campo", "obrigatorio").distinct()
    need = specs.where("obrigatorio").groupBy("dataset").agg(F.count_distinct("campo").alias("total"))
    per = hits.groupBy("arquivo", "dataset").agg(
        F.count_if("obrigatorio").alias("obrigatorios"), F.count(F.lit(1)).alias("campos")
    )
    full = per.join(need, "dataset").where(F.col("obrigatorios") == F.col("total"))
    order = Window.partitionBy("arquivo").orderBy(F.col("obrigatorios").desc(), F.col("campos").desc())
    leaders = full.withColumn("_r", F.rank().over(order)).where("_r = 1")
    best = leaders.groupBy("arquivo").agg(F.count(F.lit(1)).alias("n"), F.min("dataset").alias("dataset"))
    joined = headers.select("arquivo").join(best, "arquivo", "left")
    return joined.select(
        "arquivo",
        F.when(F.col("n") == 1, F.col("dataset")).alias("dataset"),
        F.when(F.col("n") == 1, "CLASSIFICADO").when(F.col("n") > 1, "AMBIGUO").otherwise("NAO_CLASSIFICADO").alias("status"),
    )


def group_identity(headers: Column, groups: Column) -> Column:
    """Required groups without any of their names in the header."""
    have = _names(headers)
    return F.filter(groups, lambda g: ~F.arrays_overlap(_names(g), have))


def extra_fields(headers: Column, known: Column) -> Column:
    return F.array_except(_names(headers), _names(known))
