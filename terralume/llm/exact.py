"""Exact duplicates by progressive refinement, with DataFrame functions only.

Documents of a length that no other has are unique; so are those whose first characters no other
document of that length has. Only what is left is read whole and hashed. The first two steps work
on a narrow table of keys, lengths and prefix hashes, written once; the whole texts move once, to
meet the keys that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralume.session import materialize

from .common import free_name

PREFIX = 256  # characters of the prefix hash


def normalised(text: Column) -> Column:
    """White space runs as single spaces; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _repeated(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Values of ``by`` that more than one row has."""
    return materialize(rows.groupBy(*by).agg(F.count("*").alias("_rows")).where("_rows > 1").select(*by), name)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", hash_unique: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``keep_id``, ``group_size``, ``kept``, ``text_hash``.

    Texts are equal when they are the same after every run of white space became one space; null is
    empty, and empty texts are equal. ``keep_id`` is the smallest key of the equal rows (null if all
    their keys are null), ``group_size`` their number. ``kept`` is true for the row with that key;
    rows that repeat both key and text are one document and share its verdict. ``text_hash`` is the SHA-256 of the
    normalised text, null for rows that length or prefix told apart unless ``hash_unique`` is set.
    Other columns don't matter; an empty table gives an empty result.
    """
    whole = docs.select(F.col(key).alias("_key"), normalised(F.col(text)).alias("_text"))
    marks = (F.length("_text").alias("_length"), F.xxhash64(F.substring("_text", 1, PREFIX)).alias("_prefix"))
    narrow = materialize(whole.select("_key", *marks), "lengths")
    by_length = narrow.join(_repeated(narrow, ["_length"], "repeated-lengths"), "_length", "left_semi")
    # Equal rows of one key need no second entry.
    left = materialize(
        by_length.join(_repeated(by_length, ["_length", "_prefix"], "repeated-prefixes"), ["_length", "_prefix"], "left_semi")
        .groupBy("_key", "_length", "_prefix").agg(F.lit(True).alias("_left")),
        "left",
    )
    read = whole.select("_key", "_text", *marks)
    same = read["_key"].eqNullSafe(left["_key"]) & (read["_length"] == left["_length"]) & (read["_prefix"] == left["_prefix"])
    # The same join at every size: texts are dealt by key, however few keys are left.
    met = read.join(left.hint("merge"), same, "left").select(
        read["_key"].alias("_key"),
        F.coalesce("_left", F.lit(False)).alias("_left"),
        F.when(F.lit(hash_unique) | F.col("_left"), F.sha2(F.col("_text").cast("binary"), 256)).alias("text_hash"),
    )
    hashed = materialize(met, "hashed")
    groups = materialize(
        hashed.where("_left").groupBy("text_hash").agg(F.min("_key").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"),
        "equal-texts",
    )
    unique = F.col("group_size").isNull()
    out = hashed.join(groups, "text_hash", "left").select(
        F.col("_key").alias(key),
        F.when(unique, F.col("_key")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (unique | F.col("_key").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_hash",
    )
    return out


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that an equal text with a smaller key makes superfluous; of equal keys and texts one stays.

    All columns stay. The verdict of a key is that of its text, so keys may repeat with different texts.
    """
    name = free_name(docs.columns, "text_hash")
    rows = docs.withColumn(name, F.sha2(normalised(F.col(text)).cast("binary"), 256))
    dropped = exact_groups(docs, key, text).where("not kept").select(F.col(key).alias("_dropped"), F.col("text_hash").alias("_hash")).distinct()
    same = rows[key].eqNullSafe(dropped["_dropped"]) & (rows[name] == dropped["_hash"])
    return rows.join(dropped, same, "left_anti").dropDuplicates([key, name]).drop(name)
