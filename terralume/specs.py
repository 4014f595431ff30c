"""Dataset registry: fields with logical type, aliases and required flag.

The registry is a parameter, not code: a text in the one-line notation
`name:type! ← alias, alias; name:type; ...` per dataset (`!` marks required
fields). `parse_fields` reads one line, `load_registry` a file of
`slug = line` entries.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

KINDS = ("text", "integer", "numeric", "year", "date", "date_flexible")


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    required: bool = False
    aliases: tuple[str, ...] = ()

    @property
    def names(self) -> tuple[str, ...]:
        """Canonical name first, then the aliases in order."""
        return (self.name, *self.aliases)


@dataclass(frozen=True)
class Dataset:
    slug: str
    fields: tuple[Field, ...]
    source: str = ""
    mode: str = "replace_table"
    families: tuple[str, ...] = ("polygon",)
    tokens: tuple[str, ...] = ()
    signals: tuple[str, ...] = ()
    groups: tuple[tuple[str, ...], ...] = ()
    fixed: dict[str, str] = field(default_factory=dict)


def parse_field(text: str) -> Field:
    head, _, tail = text.partition("←")
    name, _, kind = head.strip().partition(":")
    kind = kind.strip()
    aliases = tuple(a.strip() for a in tail.split(",") if a.strip())
    plain = kind.rstrip("!")
    if plain not in KINDS:
        raise ValueError(f"unknown type {plain} of {name}")
    return Field(name.strip(), plain, kind.endswith("!"), aliases)


def parse_fields(line: str) -> tuple[Field, ...]:
    return tuple(parse_field(part) for part in line.rstrip(". \n").split(";") if part.strip())


def load_registry(path: str) -> dict[str, Dataset]:
    """Datasets of a registry file with one `slug = fields` line each; `#` starts a comment."""
    registry = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        if "=" not in line or line.lstrip().startswith("#"):
            continue
        slug, _, fields = line.partition("=")
        registry[slug.strip()] = Dataset(slug.strip(), parse_fields(fields))
    return registry


def spec_table(spark: SparkSession, datasets: list[Dataset]) -> DataFrame:
    """Registry as rows (dataset, field, alias, rank, required); as long as the registry."""
    rows = [
        (d.slug, f.name, alias, rank, f.required)
        for d in datasets
        for f in d.fields
        for rank, alias in enumerate(f.names)
    ]
    return spark.createDataFrame(rows, "dataset string, campo string, alias string, ordem int, obrigatorio boolean")
