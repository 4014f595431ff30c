"""Text normalisers as Column expressions, with driver-side twins for headers."""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import Column, functions as F

# State codes, and the accent map of the municipality search.
UF_CODES = (
    "AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA",
    "PB", "PR", "PE", "PI", "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO",
)
MUNICIPALITY_ACCENTS = ("ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇ", "AAAAAEEEEIIIIOOOOOUUUUC")
NULL_TOKENS = ("null", "none", "undefined", "nan")


def _latin_folds() -> tuple[str, str]:
    """Letters of the Latin blocks whose decomposition has one ASCII letter."""
    source, target = [], []
    for code in range(0xA0, 0x250):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


_FOLD_FROM, _FOLD_TO = _latin_folds()


def fold_ascii(text: Column) -> Column:
    """Accents folded to their letter, every other non-ASCII character dropped."""
    return F.regexp_replace(F.translate(text, _FOLD_FROM, _FOLD_TO), r"[^\x00-\x7F]", "")


def fold_upper(text: Column) -> Column:
    """Trimmed upper-case text without accents; other scripts stay."""
    return F.translate(F.upper(F.trim(F.coalesce(text, F.lit("")))), _FOLD_FROM, _FOLD_TO)


def normal_name(text: Column) -> Column:
    """Accent-folded lower-case name, other runs become one underscore."""
    folded = F.lower(fold_ascii(F.coalesce(text, F.lit(""))))
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", "_"), F.lit("_"))


def normal_name_text(value: object) -> str:
    """`normal_name` for one header on the driver."""
    plain = unicodedata.normalize("NFKD", str(value or "")).encode("ascii", "ignore").decode()
    return re.sub("[^a-z0-9]+", "_", plain.lower()).strip("_")


def identifier_text(value: str, prefix: str = "camada") -> str:
    """A column or table name; long names are cut and end in a hash of the original."""
    name = normal_name_text(value) or prefix
    if name[0].isdigit():
        name = f"{prefix}_{name}"
    if len(name) > 55:
        name = f"{name[:47]}_{hashlib.sha1(value.encode()).hexdigest()[:7]}"
    return name


def identifier(text: Column, prefix: str = "camada") -> Column:
    """`identifier_text` over a column of names."""
    plain = normal_name(text)
    plain = F.when(plain == "", F.lit(prefix)).otherwise(plain)
    plain = F.when(plain.rlike("^[0-9]"), F.concat(F.lit(f"{prefix}_"), plain)).otherwise(plain)
    short = F.concat_ws("_", F.substring(plain, 1, 47), F.substring(F.sha1(text), 1, 7))
    return F.when(F.length(plain) > 55, short).otherwise(plain)


def municipality_fold(text: Column) -> Column:
    return F.translate(F.upper(F.trim(text)), *MUNICIPALITY_ACCENTS)


def property_status(status: Column, condition: Column) -> Column:
    """Display status of a property; unknown states stay as published."""
    raw = F.trim(F.coalesce(F.nullif(status, F.lit("")), condition, F.lit("")))
    folded = fold_upper(raw)
    return (
        F.when(folded.isin("AT", "ATIVO", "ATIVA") | folded.startswith("ATIV"), "Ativo")
        .when(folded.rlike("INATIV|CANCEL|BAIXAD"), "Inativo")
        .when(raw == "", "Não informada")
        .otherwise(raw)
    )


def alert_class(*names: Column) -> Column:
    """Alert class from the first non-empty class name."""
    folded = fold_upper(F.coalesce(*[F.nullif(n, F.lit("")) for n in names], F.lit("")))
    return (
        F.when(folded.contains("QUEIM"), "QUEIMADA")
        .when(folded.rlike("DESMAT|SUPRESS"), "DESMATAMENTO")
        .when(folded.contains("RESERVATOR"), "RESERVATORIO")
        .when(folded == "", "OCORRENCIA_PRODES")
        .otherwise(folded)
    )


def property_code(text: Column) -> Column:
    """UF-9999999-<32 alnum> from any punctuation, else NULL."""
    bare = F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]", ""))
    shaped = F.regexp_replace(bare, "^([A-Z]{2})([0-9]{7})([A-Z0-9]{32})$", "$1-$2-$3")
    return F.when(bare.rlike("^[A-Z]{2}[0-9]{7}[A-Z0-9]{32}$"), shaped)


def codes_in_text(text: Column) -> Column:
    """Distinct property codes in free text, dashes unified and spaces dropped."""
    flat = F.regexp_replace(F.upper(text), "[‐-―−﹘﹣－]", "-")
    flat = F.regexp_replace(flat, r"[\s ]+", "")
    return F.array_distinct(
        F.regexp_extract_all(flat, F.lit("([A-Z]{2}-[0-9]{7}-[A-F0-9]{32})"), F.lit(1))
    )


def uf_of_code(code: Column) -> Column:
    """State prefix of a property code, or '' when it is not a known state."""
    uf = F.upper(F.substring(F.trim(code), 1, 2))
    return F.when(code.rlike(r"(?i)^\s*[A-Z]{2}-") & uf.isin(*UF_CODES), uf).otherwise("")


def uf_of_path(path: Column) -> Column:
    """Last state code among the tokens of a path, or ''."""
    tokens = F.split(F.upper(path), "[^A-Z0-9]+")
    hits = F.filter(tokens, lambda t: t.isin(*UF_CODES))
    return F.coalesce(F.try_element_at(hits, F.lit(-1)), F.lit(""))


def cpf_digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")


def cpf_valid(text: Column) -> Column:
    """Both check digits agree and the digits are not all the same."""
    digits = cpf_digits(text)

    def digit(i: int) -> Column:
        return F.try_to_number(F.substring(digits, i, 1), F.lit("9")).cast("int")

    def check(upto: int) -> Column:
        total = sum((digit(i) * (upto + 2 - i) for i in range(2, upto + 1)), digit(1) * (upto + 1))
        return (total * 10) % 11 % 10

    return (
        digits.rlike("^[0-9]{11}$")
        & ~digits.rlike(r"^([0-9])\1{10}$")
        & (check(9) == digit(10))
        & (check(10) == digit(11))
    )


def integer_key(text: Column) -> Column:
    """`123.0` and ` +0123 ` become `123`; blanks and anything else become ''."""
    bare = F.trim(F.replace(F.coalesce(text, F.lit("")), F.lit("\ufeff"), F.lit("")))
    shape = r"^([+-]?)0*([0-9]+)(?:\.0+)?$"
    sign, digits = F.regexp_extract(bare, shape, 1), F.regexp_extract(bare, shape, 2)
    return F.when((sign == "-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)


def clean_display(text: Column) -> Column:
    """Null tokens become '', an ISO date is shown day first."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    return (
        F.when(F.lower(trimmed).isin(*NULL_TOKENS), "")
        .when(
            trimmed.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"),
            F.regexp_replace(trimmed, r"^(\d{4})-(\d{2})-(\d{2}).*$", "$3/$2/$1"),
        )
        .otherwise(trimmed)
    )


def short_name(text: Column, fallback: Column) -> Column:
    """Spaces collapsed, 80 characters at most, fallback when empty."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.substring(F.when(flat == "", fallback).otherwise(flat), 1, 80)


def padded_code(text: Column, width: int) -> Column:
    """Digits padded with zeros to the width; longer or other text unchanged."""
    trimmed = F.trim(text)
    fits = trimmed.rlike("^[0-9]+$") & (F.length(trimmed) < width)
    return F.when(fits, F.lpad(trimmed, width, "0")).otherwise(trimmed)


def first_filled(*values: Column) -> Column:
    """First value that is neither NULL nor ''."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def decimal_comma(value: Column, digits: int) -> Column:
    """Brazilian display: points between thousands, comma before decimals."""
    return F.translate(F.format_number(value, digits), ",.", ".,")


def field_label(name: Column, labels: dict[str, str]) -> Column:
    """Label of a field, else its name with spaces and a capital."""
    plain = F.trim(F.replace(F.coalesce(name, F.lit("")), F.lit("_"), F.lit(" ")))
    spoken = F.concat(F.upper(F.left(plain, F.lit(1))), F.lower(F.substr(plain, F.lit(2))))
    chosen = F.lit(None).cast("string")
    for key, label in labels.items():
        chosen = F.when(name == key, label).otherwise(chosen)
    return F.coalesce(chosen, spoken)


def display_number(value: Column) -> Column:
    """Two digits in Brazilian notation, or a note when there is none."""
    return F.coalesce(decimal_comma(value, 2), F.lit("Não informado"))


def repair_utf8(raw: Column) -> Column:
    """Decoded text with each bad byte sequence replaced, and how many there were."""
    text = F.make_valid_utf8(raw)
    bad = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    good = F.coalesce(F.length(F.try_validate_utf8(raw)), F.lit(0))
    return F.struct(
        F.replace(text, F.lit("�"), F.lit("?")).alias("text"),
        F.when(good > 0, 0).otherwise(bad).alias("replaced"),
    )
