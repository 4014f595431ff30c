"""The queries of this subpackage, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql

QueryFn = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    return read_archives(write_archives(_table(spark, sf_dir, "pages"))).drop("url")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, formatted

    control = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(control).alias("text"),
    )
    return digests(formatted(rows.unionByName(added)))


def op4_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = mixed(docs)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judged

    rows = judged(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *[
        F.col(f"quality.{c}")
        for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left", "kept")
    ])


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import read_shards, write_shards

    shards = write_shards(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return read_shards(shards).select(
        F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, found_spans

    rows = found_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    in_order = F.array_sort(
        F.transform(
            F.concat("base", "added"),
            lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
        )
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(in_order).alias("spans"),
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import cut_pieces, pack

    pieces = cut_pieces(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), limit=2048)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .align import aligned

    rows = aligned(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return rows.withColumn("groups_sha256", digest).drop("groups")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"), support=10, longest=3, percent=50, most=2000)


def op13_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"), hash_unique=True).withColumnRenamed("text_hash", "text_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, QueryFn] = {
    f.__name__: f
    for f in (
        op1_minhash_components, op2_warc_archives, op3_chat_format, op4_embedding_links, op5_source_mix, op6_quality_rules,
        op7_token_shards, op8_pii_spans, op9_best_fit_packing, op10_token_counts,
        op11_token_alignment, op12_collocations, op13_exact_groups, pipeline,
    )
}
# The others have no SQL: their samples, tokens, trained spans and packings are tested against brute force.
SQL: dict[str, str] = {
    "op1_minhash_components": sql.OP1,
    "op2_warc_archives": sql.OP2,
    "op3_chat_format": sql.OP3,
    "op4_embedding_links": sql.OP4,
    "op6_quality_rules": sql.OP6,
    "op12_collocations": sql.OP12,
    "op13_exact_groups": sql.OP13,
}
