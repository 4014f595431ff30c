"""A corpus from raw documents: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes the documents that its predecessor kept; all but the last return the columns of
documents. ``run`` writes every stage as Parquet to the folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralume.llm.common import free_name
from terralume.llm.minhash import near_duplicates
from terralume.llm.mixing import sampled
from terralume.llm.packing import packed_documents
from terralume.llm.pii import masked
from terralume.llm.quality import kept_rows
from terralume.session import materialize

SIMILAR_PERCENT = 80
TOKENIZER = "byte_bpe_50k.json"


def _with_text(rows: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    """``columns`` of ``rows`` with a new text, and its length where the table has ``n_chars``."""
    made = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[(made[c] if c in made else F.col(f"`{c}`")).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that failed."""
    rows = kept_rows(docs)
    verdict = rows.columns[-1]
    return _with_text(rows, F.col(f"`{verdict}`.cleaned"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Rows are told apart by id and content, so two rows with one id are two documents unless all
    their columns are equal; of equal rows one stays. A null id comes after all others.
    """
    key = free_name(docs.columns, "row_key")
    number = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    content = F.lpad(F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])), 16, "0")
    rows = docs.withColumn(key, F.concat(F.coalesce(number, F.lit("n" * 16)), content))
    kept = near_duplicates(rows.select(key, "text"), key, percent=SIMILAR_PERCENT).where("kept").select(key).distinct()
    return rows.join(kept, key, "left_semi").dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    rows = masked(docs)
    return _with_text(rows, F.col("text"), docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return sampled(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids, sequence and offset.

    A document that the mix takes more than once gives a piece for each time.
    """
    import public_tokenizers

    return packed_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

# The field of the third stage and the tokenizer of the last have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
