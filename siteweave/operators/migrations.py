"""Migrations of the store's tables: steps up and down, and what tables look like after so many of them.

A step only changes how tables are seen. Rows keep the columns that they were written with, under physical names that no
step changes; columns that came later read as their default, columns that were renamed read under the new name, and what a
step down hides is there again after the step up. So no step rewrites data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteweave.schema import TABLES


@dataclass(frozen=True)
class Field:
    """A column: its name now, its name in files, its type and what it is where files lack it."""

    name: str
    stored: str
    kind: str
    default: object = None

    def read(self) -> Column:
        return F.coalesce(F.col(f"`{self.stored}`"), F.lit(self.default).cast(self.kind)).alias(self.name) if self.default is not None else F.col(f"`{self.stored}`").alias(self.name)


@dataclass(frozen=True)
class Migration:
    """``create``: tables with their fields; ``add``: (table, field); ``rename``: (table, old name, new name)."""

    name: str
    create: dict[str, T.StructType] = field(default_factory=dict)
    add: tuple[tuple[str, Field], ...] = ()
    rename: tuple[tuple[str, str, str], ...] = ()

    def up(self, tables: dict[str, list[Field]]) -> dict[str, list[Field]]:
        out = {t: list(fields) for t, fields in tables.items()}
        for t, schema in self.create.items():
            if t in out:
                raise ValueError(f"{self.name}: there is a table {t} already")
            out[t] = [Field(f.name, f.name, f.dataType.simpleString()) for f in schema]
        for t, new in self.add:
            if any(f.name == new.name or f.stored == new.stored for f in out[t]):
                raise ValueError(f"{self.name}: {t} has a column {new.name} already")
            out[t].append(new)
        for t, old, new in self.rename:
            if old not in {f.name for f in out[t]} or new in {f.name for f in out[t]}:
                raise ValueError(f"{self.name}: {t}.{old} can't become {new}")
            out[t] = [Field(new, f.stored, f.kind, f.default) if f.name == old else f for f in out[t]]
        return out


#: The store's own tables, one step each in the order of their references.
MIGRATIONS = [Migration(f"create_{t}", {t: TABLES[t]}) for t in ("site", "site_run", "plugin_rule", "site_page", "page_rule_result")] + [
    Migration("create_reports", {t: TABLES[t] for t in ("category_count", "link_count", "run_progress")})
]


def tables_after(migrations: list[Migration], count: int) -> dict[str, list[Field]]:
    """The tables after the first ``count`` steps. ``ValueError`` if a step can't be made."""
    out: dict[str, list[Field]] = {}
    for step in migrations[:count]:
        out = step.up(out)
    return out


def stored_schema(fields: list[Field]) -> T.StructType:
    return T.StructType([T.StructField(f.stored, T._parse_datatype_string(f.kind)) for f in fields])


def to_stored(rows: DataFrame, fields: list[Field]) -> DataFrame:
    """Rows as they are written: columns that ``rows`` lacks take their default."""
    held = set(rows.columns)
    return rows.select(*[(F.col(f"`{f.name}`") if f.name in held else F.lit(f.default)).cast(f.kind).alias(f.stored) for f in fields])


def from_stored(rows: DataFrame, fields: list[Field]) -> list[Column]:
    return [f.read() for f in fields]
