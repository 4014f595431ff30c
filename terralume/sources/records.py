"""Delimited text whose quoted fields run over line ends, read by many tasks.

A line alone does not tell whether it begins inside a quoted field. So every line is taken as a map
from "outside / inside before it" to "outside / inside behind it"; a split of a file is folded for both
beginnings at once, in one pass. One small row a split then gives, by windows, the true beginning and
the number of lines before it, and each line finds its record and its exact number. Only records that
have more than one line are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import materialize
from .delimited import Format, _decoded, _surplus, with_lineage_of

MOST_BYTES = 16 << 20  # a longer record is told with its line, not read: a quote that is never closed takes the rest of its file
_SAME = 2  # map of a line without quotes


def _line_map(line: Column, delimiter: str) -> Column:
    """Bit 0: inside behind the line if outside before it; bit 1: inside behind it if inside before it.

    A field is quoted if it begins with a quote, and is open while its quotes are odd in number.
    """
    parts = F.split(line, re.escape(delimiter), -1)
    odd = lambda p: (F.length(p) - F.length(F.replace(p, F.lit('"'), F.lit("")))) % 2 == 1
    behind = lambda before: F.aggregate(
        parts, F.lit(before), lambda inside, p: F.when(inside | p.startswith('"'), inside != odd(p)).otherwise(F.lit(False))
    ).cast("int")
    return F.when(line.contains('"'), behind(False) + 2 * behind(True)).otherwise(F.lit(_SAME)).cast("int")


def _states(maps, before: int):
    """State before each line and behind the last, if the state before the first is `before`."""
    import numpy as np

    n = len(maps)
    fixed = (maps == 0) | (maps == 3)
    flips = np.cumsum(maps == 1)
    last = np.maximum.accumulate(np.where(fixed, np.arange(n), -1))
    set_to = np.where(last >= 0, maps[last] & 1, before)
    behind = set_to ^ ((flips - np.where(last >= 0, flips[last], 0)) & 1)
    return np.concatenate([[before], behind[:-1]]).astype(np.int64), int(behind[-1])


def _fold(batches: Iterator) -> Iterator:
    """Number of each line in its split and, for both beginnings, the records begun so far and the states around it.

    `estado0`, `estado1`: 1 if inside before the line, and 2 if inside behind it.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    now, done, state, begun = None, 0, [0, 1], [0, 0]
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch.column(0), batch.column(1)
        changed = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(starts[1:], starts[:-1]))
        cuts = [0, *(np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        maps = batch.column(2).to_numpy()
        at = np.empty(len(maps), np.int64)
        records, around = np.empty((2, len(maps)), np.int64), np.empty((2, len(maps)), np.int32)
        for low, high in zip(cuts, cuts[1:], strict=False):
            here = (files[low].as_py(), starts[low].as_py())
            if here != now:
                now, done, state, begun = here, 0, [0, 1], [0, 0]
            at[low:high] = np.arange(done, done + high - low)
            done += high - low
            for h in (0, 1):
                before, state[h] = _states(maps[low:high], state[h])
                records[h, low:high] = begun[h] + np.cumsum(before == 0)
                around[h, low:high] = before + 2 * np.append(before[1:], state[h])
                begun[h] = int(records[h, high - 1])
        raw = batch.column(3)
        columns = [files, starts, raw, pc.cast(pc.binary_length(raw), pa.int64()), *map(pa.array, (at, *records, *around))]
        yield pa.RecordBatch.from_arrays(columns, names=["arquivo", "inicio", "bruto", "bytes", "em", "conta0", "conta1", "estado0", "estado1"])


def _split_places(lines: DataFrame) -> DataFrame:
    """One row a split: its true beginning, and the lines and records that begin before it in its file.

    The windows hold the splits of one file, of which the driver keeps a list anyway to start the tasks.
    """
    last = F.max_by(F.struct("conta0", "conta1", "estado0", "estado1"), "em")
    splits = lines.groupBy("arquivo", "inicio").agg(F.count(F.lit(1)).alias("n"), last.alias("fim")).select("arquivo", "inicio", "n", "fim.*")
    order = Window.partitionBy("arquivo").orderBy("inicio")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # Whether a split ends inside if it begins outside, and if it begins inside.
    outer, inner = F.col("estado0") >= 2, F.col("estado1") >= 2
    counted = splits.withColumn("viradas", F.sum(F.when(outer & ~inner, 1).otherwise(0)).over(upto))
    # The last split whose end is fixed, and the flips since.
    seen = F.last(F.when(outer == inner, F.struct(outer.cast("int").alias("valor"), "viradas")), ignorenulls=True).over(earlier)
    counted = counted.withColumns({"visto": seen, "virou": F.coalesce(F.lag("viradas").over(order), F.lit(0))})
    known = lambda name: F.coalesce(F.col(f"visto.{name}"), F.lit(0))
    placed = counted.withColumn("dentro", (known("valor") + F.col("virou") - known("viradas")) % 2 == 1)
    begun = F.when(F.col("dentro"), F.col("conta1")).otherwise(F.col("conta0"))
    sums = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    return placed.select("arquivo", "inicio", "dentro", sums(F.col("n")).alias("linhas_antes"), sums(begun).alias("registros_antes"))


def read_records(spark: SparkSession, path: str, delimiter: str = ";", most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per record of every file below `path`: `arquivo`, `numero`, `linha` (its first line), `linhas`, `bruto`.

    Numbers count from 1 in each file. `bruto` holds the bytes of the record without its last line end. Lines end with a line
    feed, with or without a carriage return; one inside quotes belongs to the field. A field is quoted if it begins with a
    quote, and open while its quotes are odd in number, so a quote within an unquoted field is plain text. A record of
    several lines with more than `most_bytes` bytes is kept with NULL in `bruto`; one that is open at the end of a file ends
    there. An empty line is a record; files without bytes give no rows.
    """
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    given = text.select(
        F.col("_metadata.file_path").alias("arquivo"),
        F.col("_metadata.file_block_start").alias("inicio"),
        _line_map(F.regexp_replace("value", "\r$", ""), delimiter).alias("mapa"),
        F.col("value").cast("binary").alias("bruto"),
    )
    schema = "arquivo string, inicio long, bruto binary, bytes long, em long, conta0 long, conta1 long, estado0 int, estado1 int"
    # Written once: splits may be cut in another way when executors come or go.
    lines = materialize(given.mapInArrow(_fold, schema), "lines")
    true = lambda name: F.when(F.col("dentro"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    # A table of its own, so that its size is known before the join and the lines are only moved if it is large.
    places = materialize(_split_places(lines), "splits")
    placed = lines.join(places, ["arquivo", "inicio"]).select(
        "arquivo",
        (F.col("registros_antes") + true("conta")).alias("numero"),
        (F.col("linhas_antes") + F.col("em") + 1).alias("linha"),
        (true("estado") == 0).alias("inteira"),
        "bruto",
        "bytes",
    )
    # Lines that are inside a field at either end are put together by the number of their record.
    key = ["arquivo", "numero"]
    parts = placed.where(~F.col("inteira"))
    place = [F.min("linha").alias("linha"), F.count(F.lit(1)).alias("linhas")]
    sized = parts.groupBy(*key).agg(*place, (F.sum(F.col("bytes") + 1) - 1).alias("bytes"))
    long = materialize(sized.where(F.col("bytes") > most_bytes).drop("bytes"), "long")
    # Bytes as Latin-1 characters, which can be joined; sorted and joined behind the shuffle.
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("linha", "bruto"))), lambda p: F.decode(p["bruto"], "ISO-8859-1"))
    joined = parts.join(long.select(*key), key, "left_anti").groupBy(*key).agg(*place, F.encode(F.array_join(pieces, "\n"), "ISO-8859-1").alias("bruto"))
    single = placed.where("inteira").select(*key, "linha", F.lit(1).cast("long").alias("linhas"), "bruto")
    out = single.unionByName(joined).unionByName(long.withColumn("bruto", F.lit(None).cast("binary")))
    size = F.octet_length("bruto")
    ended = F.substring("bruto", size, F.lit(1)) == F.lit(b"\r")
    return out.withColumn("bruto", F.when(ended, F.substring("bruto", F.lit(1), size - 1)).otherwise(F.col("bruto")))


def read_quoted(spark: SparkSession, path: str, fmt: Format, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Fields of all records as text with file and year; the first record of each file is its header.

    `_numero_linha` counts records from 1 at the header, as a reader of records does; `_linha_arquivo` is
    the line of the file `_arquivo`.

    Short records are padded with '', the whole surplus of a record that is too wide is in `_excesso`, and one that is too
    long to be read has NULL in every field. Each value is decoded by itself.
    """
    names = [f"c{i}" for i in range(len(fmt.headers))]
    schema = ", ".join([f"{n} string" for n in names] + ["_linha string"])
    options = {"sep": fmt.delimiter, "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_linha"}
    records = read_records(spark, path, fmt.delimiter, most_bytes).where("numero > 1")
    latin = records.withColumn("_texto", F.decode("bruto", "ISO-8859-1"))
    parsed = latin.withColumn("_c", F.from_csv("_texto", schema, options))
    fields = [F.when(F.col("_texto").isNotNull(), _decoded(F.coalesce(F.col("_c")[n], F.lit("")))).alias(h) for n, h in zip(names, fmt.headers, strict=True)]
    surplus = _decoded(_surplus(F.col("_texto"), fmt.delimiter, len(names)))
    return with_lineage_of(parsed, F.element_at(F.split("arquivo", "/"), -1)).select(
        *fields, surplus.alias("_excesso"), F.col("numero").alias("_numero_linha"), F.col("linha").alias("_linha_arquivo"), F.col("arquivo").alias("_arquivo"), "_arquivo_origem", "_ano_arquivo"
    )
