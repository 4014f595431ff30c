"""Delimited text: format detection from the head, reading, row-width policy, lineage."""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import identifier_text, normal_name, normal_name_text
from ..session import materialize

# Encodings and delimiters in trial order, reserved column names,
# the first year of the credit files, the operations file name.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
DELIMITERS = (";", ",", "\t", "|")
RESERVED = ("_id", "_numero_linha", "_ano_arquivo", "_arquivo_origem", "geom")
FIRST_YEAR = 2013
OPERATIONS_FILE = r"(?i)^SICOR_OPERACAO_BASICA_ESTADO_(\d{4})(?:\.(?:gz|csv))?$"
# Header of the operations file.
OPERATIONS_HEADER = (
    "#REF_BACEN", "NU_ORDEM", "CNPJ_IF", "DT_EMISSAO", "DT_VENCIMENTO", "CD_INST_CREDITO",
    "CD_CATEG_EMITENTE", "CD_FONTE_RECURSO", "CNPJ_AGENTE_INVEST", "CD_ESTADO",
    "CD_REF_BACEN_INVESTIMENTO", "CD_TIPO_SEGURO", "CD_EMPREENDIMENTO", "CD_PROGRAMA",
    "CD_TIPO_ENCARG_FINANC", "CD_TIPO_IRRIGACAO", "CD_TIPO_AGRICULTURA", "CD_FASE_CICLO_PRODUCAO",
    "CD_TIPO_CULTIVO", "CD_TIPO_INTGR_CONSOR", "CD_TIPO_GRAO_SEMENTE", "VL_ALIQ_PROAGRO", "VL_JUROS",
    "VL_PRESTACAO_INVESTIMENTO", "VL_PREV_PROD", "VL_QUANTIDADE", "VL_RECEITA_BRUTA_ESPERADA",
    "VL_PARC_CREDITO", "VL_REC_PROPRIO", "VL_PERC_RISCO_STN", "VL_PERC_RISCO_FUNDO_CONST",
    "VL_REC_PROPRIO_SRV", "VL_AREA_FINANC", "CD_SUBPROGRAMA", "VL_PRODUTIV_OBTIDA",
    "DT_FIM_COLHEITA", "DT_FIM_PLANTIO", "DT_INIC_COLHEITA", "DT_INIC_PLANTIO",
    "VL_JUROS_ENC_FINAN_POSFIX", "VL_PERC_CUSTO_EFET_TOTAL", "CD_CONTRATO_STN",
    "CD_CNPJ_CADASTRANTE", "VL_AREA_INFORMADA", "CD_CICLO_CULTIVAR", "CD_TIPO_SOLO", "PC_BONUS_CAR",
)

@dataclass(frozen=True)
class Format:
    encoding: str
    delimiter: str
    original: tuple[str, ...]
    headers: tuple[str, ...]


def unique_headers(names: Iterable[str]) -> tuple[str, ...]:
    """Identifiers in order; repeats and reserved names get `_2`, `_3` and so on."""
    stripped = [str(name or "").strip() for name in names]
    wanted = [identifier_text(n, prefix="campo") if n else f"campo_{i}" for i, n in enumerate(stripped, 1)]
    taken, uses = set(RESERVED), Counter(RESERVED)

    def free(base: str) -> str:
        """The base or its next numbered form; numbers go on where the last use of the base ended."""
        name = base
        while name in taken:
            uses[base] += 1
            tail = f"_{max(uses[base], 2)}"
            name = base[: 63 - len(tail)] + tail
        taken.add(name)
        uses[base] = max(uses[base], 1)
        return name

    return tuple(free(base) for base in wanted)


def decode_head(head: bytes) -> tuple[str, str]:
    """Text of a header line and its encoding: UTF-8 where it is valid, else Windows-1252 or Latin-1."""
    if b"\x81" not in head and b"\x8d" not in head and b"\x8f" not in head and b"\x90" not in head and b"\x9d" not in head:
        single = "cp1252"
    else:
        single = "latin-1"  # bytes that Windows-1252 leaves undefined
    encoding = "utf-8-sig" if head.decode("utf-8", "ignore").encode() == head else single
    return head.decode(encoding), encoding


def detect_format(head: bytes, known: Iterable[str] = ()) -> Format:
    """Delimiter whose header has the most known names, then the most columns, then stands first in the list."""
    text, encoding = decode_head(head)
    expected = {identifier_text(name, prefix="campo") for name in known}
    lines = text.splitlines()
    split = {d: next(csv.reader(lines, delimiter=d), []) for d in DELIMITERS}
    hits = {d: len(expected.intersection(unique_headers(row))) for d, row in split.items()}
    chosen = max(DELIMITERS, key=lambda d: 100 * hits[d] + len(split[d]))
    if len(split[chosen]) < 2:
        raise ValueError("no header with two or more columns")
    return Format(encoding, chosen, tuple(str(v).strip() for v in split[chosen]), unique_headers(split[chosen]))


def read_head(spark: SparkSession, path: str) -> bytes:
    """Header line of one file as bytes; only the start of the file is read, gzip included."""
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary"))
    row = raw.first()
    if row is None:
        raise ValueError(f"no text at {path}")
    return bytes(row["value"])


def file_report(
    spark: SparkSession,
    path: str,
    delimiter: str,
    required: Mapping[str, Sequence[str]],
    max_bytes: int | None = None,
    max_expanded: int | None = None,
    max_ratio: float | None = None,
) -> DataFrame:
    """One row per file below a folder: sizes, expansion ratio, missing columns and reasons to refuse it.

    `bytes` is the stored size, `expandido` that of its lines with one line feed each and without a
    byte order mark, `taxa` their ratio. `required` has the accepted names of each required field; headers are compared after
    normalisation, without a byte order mark or a leading `#`. Files are only listed for their
    size and scanned once, by lines, for the rest. A compressed file without lines is VAZIO; files of no bytes are left out by Spark's readers.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    sizes = listed.select(F.col("_metadata.file_path").alias("arquivo"), F.col("length").alias("bytes"))
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    placed = lines.select(
        F.col("_metadata.file_path").alias("arquivo"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at"),
        F.col("value").cast("binary").alias("_line"),
    )
    read = placed.groupBy("arquivo").agg(
        F.sum(F.octet_length("_line").cast("long") + 1).alias("expandido"), F.min_by("_line", "_at").alias("_head")
    )
    names = F.transform(F.split(F.decode("_head", "UTF-8"), re.escape(delimiter), -1), domain_header)
    accepted = lambda *names: F.array(*[F.lit(normal_name_text(n)) for n in (names[0], *names[1])])
    absent = F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(F.arrays_overlap("_names", accepted(field, aliases)), F.lit(False)), F.lit(field))
                for field, aliases in required.items()
            ]
        )
    )
    above = lambda c, limit: F.col(c) > F.lit(limit) if limit is not None else F.lit(False)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("expandido") == 0, "VAZIO"),
            F.when(above("bytes", max_bytes), "TAMANHO"),
            F.when(above("expandido", max_expanded), "EXPANDIDO"),
            F.when(above("taxa", max_ratio), "TAXA"),
            F.when(F.size("faltantes") > 0, "COLUNAS"),
        )
    )
    met = sizes.join(read, "arquivo", "left").withColumn("_names", F.transform(names, normal_name))
    return (
        met.withColumn("expandido", F.coalesce("expandido", F.lit(0).cast("long")))
        .withColumn("taxa", F.round(F.col("expandido") / F.greatest("bytes", F.lit(1)), 2))
        .withColumn("faltantes", absent.cast("array<string>"))
        .select("arquivo", "bytes", "expandido", "taxa", "faltantes", reasons.alias("motivos"))
    )


def domain_header(name: Column) -> Column:
    """Domain headers without quotes, byte order mark and leading `#`, upper case."""
    return F.upper(F.trim(F.regexp_replace(F.trim(name), "^\ufeff*\"?#?|[\"\r]+$", "")))


def _windows_text(text: Column) -> Column:
    """Characters Windows-1252 has where Latin-1 has control codes."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    known = [(a, b) for a, b in pairs if b]
    return F.translate(text, "".join(a for a, _ in known), "".join(b for _, b in known))


def _decoded(value: Column, strict: bool = False) -> Column:
    """A value read byte by byte: UTF-8 where its bytes are valid, else Windows-1252, or an error if strict."""
    utf8 = F.encode(value, "ISO-8859-1").cast("string")
    other = F.raise_error(F.lit("text is not UTF-8")).cast("string") if strict else _windows_text(value)
    return F.when(value.isNull() | F.is_valid_utf8(utf8), utf8).otherwise(other)


def _surplus(line: Column, delimiter: str, width: int) -> Column:
    """What follows the first `width` fields of a line, else NULL."""
    sep = re.escape(delimiter)
    pattern = rf'^(?>(?:"[^"]*+(?:""[^"]*+)*+(?:"[^{sep}]*+|\z)|(?!")[^{sep}]*+){sep}){{{width}}}([\s\S]*)$'
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1))


def read_delimited(
    spark: SparkSession, path: str, fmt: Format, multiline: bool = False, strict: bool = False
) -> DataFrame:
    """All fields as text, with file and year lineage; gzip is read as it is.

    Bytes are read as they are and each value is decoded by itself, so no part
    of a file decides for the rest. Short rows are padded with '', and the
    whole surplus of rows that are too wide is kept in `_excesso`, which
    `too_wide` reports. With `strict` every file's header must equal the
    format's names and every value must be UTF-8, else the job fails.
    """
    names = fmt.original if strict else fmt.headers
    schema = ", ".join([f"`{h}` string" for h in names] + ["`_linha` string"])
    raw = (
        spark.read.schema(schema)
        .option("sep", fmt.delimiter)
        .option("encoding", "ISO-8859-1")
        .option("header", True)
        .option("enforceSchema", not strict)
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_linha")
        .option("columnPruning", False)
        .csv(path)
    )
    fields = [
        _decoded(F.coalesce(F.col(f"`{n}`"), F.lit("")), strict).alias(h)
        for n, h in zip(names, fmt.headers, strict=True)
    ]
    # Always true; Spark refuses plans that read nothing but the raw line.
    read = F.coalesce(F.col(f"`{names[0]}`"), F.lit("")) >= ""
    surplus = F.when(read, _decoded(_surplus(F.col("_linha"), fmt.delimiter, len(names)), strict)).alias("_excesso")
    return with_lineage(raw.select(*fields, surplus, "_metadata")).drop("_metadata")


def with_lineage(df: DataFrame) -> DataFrame:
    return with_lineage_of(df, F.col("_metadata.file_name"))


def with_lineage_of(df: DataFrame, name: Column) -> DataFrame:
    return df.withColumns({"_arquivo_origem": name, "_ano_arquivo": year_of_name(name)})


def too_wide(df: DataFrame) -> DataFrame:
    """Rows with more fields than the header."""
    return df.where(F.col("_excesso").isNotNull())


def split_rows(lines: DataFrame, text: str, delimiter: str, width: int) -> DataFrame:
    """Lines of text as padded arrays, with `excesso` for those that are too wide."""
    parts = F.split(F.col(text), re.escape(delimiter), -1)
    pad = F.array_repeat(F.lit(""), F.greatest(F.lit(width) - F.size(parts), F.lit(0)))
    return lines.withColumns({"campos": F.concat(parts, pad), "excesso": F.size(parts) > width})


def numbered(df: DataFrame, order: str, name: str = "_numero_linha", first: int = 2) -> DataFrame:
    """Consecutive line numbers in the order of a column, without one global sort task.

    Rows are range-partitioned and written with their partition number, ranked
    within it, and shifted by the sizes of the partitions before; only those
    sizes are put in one task.
    """
    ranged = df.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id())
    parts = materialize(ranged, "ranged")
    within = Window.partitionBy("_p").orderBy(order)
    ranked = parts.withColumn("_r", F.row_number().over(within))
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    joined = ranked.join(F.broadcast(shifts), "_p")
    return joined.withColumn(name, F.col("_r") + F.col("_s") + first - 1).drop("_p", "_r", "_s")


def year_of_name(name: Column, first: int = FIRST_YEAR) -> Column:
    """Last run of exactly four digits from the first credit year on, else NULL."""
    runs = F.transform(
        F.regexp_extract_all(name, F.lit(r"(?<!\d)(\d{4})(?!\d)"), F.lit(1)), lambda y: y.cast("int")
    )
    return F.try_element_at(F.filter(runs, lambda y: y >= first), F.lit(-1))


def operations_year(name: Column, first: int = FIRST_YEAR) -> Column:
    """Year of a strictly named operations file, else NULL."""
    base = F.regexp_extract(name, r"([^/\\]+)$", 1)
    year = F.regexp_extract(base, OPERATIONS_FILE, 1).try_cast("int")
    return F.when(year >= first, year)


def year_hint(name: Column) -> Column:
    """Any four digits for credit files, a year 20xx for other files; the last one."""
    any_year = F.regexp_extract_all(name, F.lit(r"(?<!\d)(\d{4})(?!\d)"), F.lit(1))
    this_age = F.regexp_extract_all(name, F.lit(r"(?<!\d)(20\d{2})(?!\d)"), F.lit(1))
    chosen = F.when(F.lower(name).contains("sicor"), any_year).otherwise(this_age)
    return F.try_element_at(chosen, F.lit(-1)).try_cast("int")


def read_operations(spark: SparkSession, path: str, names: Sequence[str] = OPERATIONS_HEADER) -> DataFrame:
    """Operations files with exactly the given header, `;` and UTF-8, each of them; anything else fails."""
    first = next(csv.reader([read_head(spark, path).decode("utf-8", "replace")], delimiter=";"))
    if tuple(first) != tuple(names):
        raise ValueError("header differs from the expected one")
    fmt = Format("utf-8", ";", tuple(names), unique_headers(names))
    return read_delimited(spark, path, fmt, strict=True)


def alias_matches(column: str, alias: str) -> bool:
    """Equal after normalisation, or one a prefix of the other from eight letters on."""
    left, right = normal_name_text(column), normal_name_text(alias)
    if not left or not right:
        return False
    short, long = sorted((left, right), key=len)
    return left == right or (len(short) >= 8 and long.startswith(short))


def first_match(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    """First alias that matches any column; columns in table order."""
    return next((c for a in aliases for c in columns if alias_matches(c, a)), None)
