"""Publication: snapshots, partitions, state merges, guards and version manifests."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.hashing import percent_change, row_fingerprint

MANIFEST = "versao int, tabela string, pasta string"


def _state(key: str) -> Column:
    trimmed = F.trim(F.col(key))
    return F.when(trimmed.rlike("(?i)^[A-Z]{2}-"), F.upper(F.substring(trimmed, 1, 2)))


def merge_state(old: DataFrame, new: DataFrame, key: str, uf: str) -> DataFrame:
    """Snapshot of one state: its old rows go, border rows of other states are updated.

    Only the new keys of other states are shuffled against the old table; the
    state's own old rows leave by a filter.
    """
    others = old.where(~F.coalesce(_state(key) == uf, F.lit(False)))
    border = new.where(F.coalesce(_state(key) != uf, F.lit(False)))
    keys = border.select(F.trim(F.col(key)).alias("_k")).distinct()
    kept = others.join(keys, F.trim(others[key]) == keys["_k"], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def upsert_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old rows of the same trimmed key."""
    keys = new.select(F.trim(F.col(key).cast("string")).alias("_k")).where("_k <> ''").distinct()
    kept = old.join(keys, F.trim(old[key].cast("string")) == keys["_k"], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def replace_partition(old: DataFrame, new: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Old rows of one logical partition, and legacy rows without one, give way."""
    match, known = F.lit(True), F.lit(True)
    for name, value in values.items():
        match = match & (F.col(name) == F.lit(value))
        known = known & F.col(name).isNotNull()
    kept = old.where(known & ~match)
    fixed = new.withColumns({n: F.lit(v).cast(old.schema[n].dataType) for n, v in values.items()})
    return kept.unionByName(fixed, allowMissingColumns=True)


def write_partitions(df: DataFrame, path: str, partition: Sequence[str]) -> None:
    """Overwrite only the partitions present in `df`.

    Rows of a partition are brought together, and one that is too large for a
    task is split over several, each with its own file.
    """
    (
        df.hint("rebalance", *partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition)
        .parquet(path)
    )


def read_evolved(spark: SparkSession, path: str) -> DataFrame:
    """Read a table whose later files have more columns."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def compare_counts(old: DataFrame, new: DataFrame, keep: Column | None = None) -> DataFrame:
    """Decision row of the reduction guard: counts, difference, percent, reduced or not."""
    counted = F.count(F.lit(1)) if keep is None else F.count_if(keep)
    base = old.agg(counted.alias("registros_base_atual"))
    fresh = new.agg(counted.alias("n"))
    b, n = F.col("registros_base_atual"), F.col("registros_nova_versao")
    return base.withColumn("registros_nova_versao", fresh.scalar()).withColumns(
        {
            "diferenca_registros": n - b,
            "diferenca_percentual": percent_change(b, n),
            "reducao_detectada": (b > 0) & (n < b),
        }
    )


def may_publish(decision: DataFrame, confirmed_base: int | None = None) -> bool:
    """A reduction needs a confirmation that names the same previous count."""
    row = decision.first()
    return not row["reducao_detectada"] or confirmed_base == row["registros_base_atual"]


class CommitRefused(RuntimeError):
    """Another writer has committed this version, or a later one."""


def publish_tables(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], version: int) -> None:
    """Write all tables of a version into folders of their own, then make it current by one manifest file.

    Nothing that exists is overwritten. The manifest is written under a free name and takes its place by a rename that fails
    where the place is taken: the second of two writers of a version gets `CommitRefused` and the first stays
    readable, as does the version before if a writer fails. A version must be above the current one. Folders of refused or failed
    writers are never read. Stores must rename a file to a free place in one step, as HDFS does; plain object stores don't.
    """
    _refuse_old(spark, root, version)
    folders = {name: f"{name}/version={version}-{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(f"{root}/{folders[name]}")
    rows = [(version, name, folder) for name, folder in folders.items()]
    trial = f"{root}/_trials/{uuid.uuid4().hex}"
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(trial)
    _refuse_old(spark, root, version)
    _take_place(spark, trial, f"{root}/_manifest/commit-{version:020d}.json")


def _refuse_old(spark: SparkSession, root: str, version: int) -> None:
    newest = _manifest(spark, root).agg(F.max("versao")).first()[0]
    if newest is not None and newest >= version:
        raise CommitRefused(f"version {version} is not above {newest}")


def _take_place(spark: SparkSession, folder: str, target: str) -> None:
    """Rename the one part file of a folder to a place that must be free."""
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    files = hadoop.fs.Path(target).getFileSystem(conf)
    to = files.makeQualified(hadoop.fs.Path(target))
    files.mkdirs(to.getParent())
    part = next(iter(files.globStatus(hadoop.fs.Path(f"{folder}/part-*"))))
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        hadoop.fs.FileContext.getFileContext(to.toUri(), conf).rename(part.getPath(), to, options)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in str(error.java_exception):
            raise CommitRefused(f"{target} was committed by another writer") from error
        raise


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row per table and commit; none before the first commit."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_manifest")
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(place):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{root}/_manifest")


def current_version(spark: SparkSession, root: str, name: str) -> int:
    """Newest committed version of a table."""
    return _current(spark, root, name)["versao"]


def _current(spark: SparkSession, root: str, name: str):
    row = _manifest(spark, root).where(F.col("tabela") == name).orderBy(F.col("versao").desc()).first()
    if row is None:
        raise ValueError(f"table {name} was never published")
    return row


def read_tables(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """All tables as of one commit (the newest, or the given one), so that they belong together; later commits don't change them."""
    manifest = _manifest(spark, root)
    upto = manifest if version is None else manifest.where(F.col("versao") <= version)
    newest = upto.groupBy("tabela").agg(F.max_by("pasta", "versao").alias("pasta")).collect()  # a row per table
    return {r["tabela"]: spark.read.parquet(f"{root}/{r['pasta']}") for r in newest}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table as of its newest commit."""
    return spark.read.parquet(f"{root}/{_current(spark, root, name)['pasta']}")


def diff(
    old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], delete: bool = True
) -> DataFrame:
    """Status per key: NOVO, ALTERADO, REMOVIDO or IGUAL, by row fingerprint."""
    mark = row_fingerprint([F.col(c) for c in columns])
    a = old.select(F.col(key), mark.alias("_old"))
    b = new.select(F.col(key), mark.alias("_new"))
    status = (
        F.when(F.col("_old").isNull(), "NOVO")
        .when(F.col("_new").isNull(), "REMOVIDO" if delete else "IGUAL")
        .when(F.col("_old") != F.col("_new"), "ALTERADO")
        .otherwise("IGUAL")
    )
    return a.join(b, key, "full_outer").select(key, status.alias("situacao"))


def clear_table(table: DataFrame, catalogue: DataFrame, name: str, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The table without a partition (or empty) and the catalogue entry under review."""
    left = table.where(~where) if where is not None else table.limit(0)
    hit = F.col("nome_tabela") == name
    status = F.when(hit, F.lit("PENDENTE_REVISAO")).otherwise(F.col("status"))
    mark = F.when(~hit, F.col("fingerprint"))
    return left, catalogue.withColumns({"status": status, "fingerprint": mark})


def clear_source(catalogue: DataFrame, source: str) -> DataFrame:
    """Catalogue after every table of a source was cleared."""
    hit = F.col("fonte") == source
    status = F.when(hit, F.lit("PENDENTE_REVISAO")).otherwise(F.col("status"))
    return catalogue.withColumns({"status": status, "fingerprint": F.when(~hit, F.col("fingerprint"))})


def audit_entry(df: DataFrame, user: Column, action: str, entity: str, ident: Column, details: Column) -> DataFrame:
    """Audit rows for a set of changes; details as JSON."""
    return df.select(
        user.alias("usuario"),
        F.lit(action).alias("acao"),
        F.lit(entity).alias("entidade"),
        ident.cast("string").alias("identificador"),
        F.to_json(details).alias("detalhes"),
    )


def active_layers(catalogue: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted layers with their availability; an absent one is unavailable, not an error."""
    active = catalogue.where("status = 'ATIVA'").select("fonte", "nome_tabela").distinct()
    marked = active.withColumn("_a", F.lit(True))
    return wanted.join(marked, ["fonte", "nome_tabela"], "left").select(
        wanted["*"], F.coalesce("_a", F.lit(False)).alias("disponivel")
    )


def existing_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def table_srid(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Smallest positive SRID of non-empty geometries and whether it is the only one."""
    code = F.col(geometry)["srid"]
    filled = df.where((code > 0) & (F.size(F.col(geometry)["parts"]) > 0))
    return filled.agg(F.min(code).alias("srid"), (F.min(code) == F.max(code)).alias("unico"))


def newest_match(
    history: DataFrame, current: DataFrame, match: Sequence[str], key: str, order: str
) -> DataFrame:
    """For each current row the newest earlier history row equal on `match`."""
    h = history.select(*match, F.col(key).alias("anterior"), F.col(order).alias("_ho"))
    joined = current.join(h, list(match), "left").where(
        F.col("_ho").isNull() | (F.col("_ho") < F.col(order))
    )
    best = joined.groupBy(key).agg(F.max_by("anterior", "_ho").alias("anterior"))
    return current.join(best, key, "left")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
