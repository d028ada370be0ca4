"""Reading a CSV bundle back: one typed, numbered level per entity."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bough.functions.parse import DECIMAL, parse
from bough.names import PARENT_ROW, ROW, col, quoted
from bough.sinks.csv import KEY, LINE_END, PARENT_KEY
from bough.sources.records import csv_records
from bough.spec import Entity, Export


def read_bundle(
    spark: SparkSession,
    path: str,
    export: Export,
    decimal: tuple[int, int] = DECIMAL,
    strict: bool = True,
    decimals: Mapping[tuple[str, str], tuple[int, int]] | None = None,
) -> dict[str, DataFrame]:
    """``(RowNumber, ParentRowNumber, fields...)`` per entity of a bundle at ``path``.

    Fields come back as their declared types; a looked-up field holds codes and stays text. A text
    that does not fit its type stops a strict read and is null in a lenient one; a decimal fits if all
    its digits do. ``decimal`` is the precision and scale of decimals, ``decimals`` of those of single
    fields by (entity, field). Empty means null.
    A file of any size is read by many tasks, also where values hold line breaks.
    """
    return {
        e.name: _read_level(spark, f"{path.rstrip('/')}/{e.name}.csv", e, e is export.root, decimal, strict, decimals or {})
        for e in export.entities()
    }


def _read_level(
    spark: SparkSession, folder: str, entity: Entity, is_root: bool, decimal, strict: bool, decimals
) -> DataFrame:
    names = [KEY, *([PARENT_KEY] if entity.parent_key_columns else [])]
    names += [f.name for f in entity.fields]
    schema = ", ".join(f"{quoted(n)} string" for n in names)
    # The parser sees a record at a time; line breaks inside its quotes are part of the value.
    options = {"multiLine": "true", "quote": '"', "escape": '"', "mode": "FAILFAST"}
    raw = csv_records(spark, folder, LINE_END).select(F.from_csv("record", schema, options).alias("row:")).select("row:.*")
    rows = raw.where(col(KEY) != KEY)

    def typed(name: str, declared: str) -> Column:
        value = parse(col(name), declared, decimals.get((entity.name, name), decimal))
        if not strict:
            return value
        wrong = F.concat(
            F.lit(f"entity '{entity.name}', field '{name}': not a valid {declared}: "), col(name)
        )
        return F.coalesce(value, F.when(col(name).isNotNull(), F.raise_error(wrong)))

    parent = F.lit(0).cast("long") if is_root else typed(PARENT_KEY, "Int64")
    return rows.select(
        typed(KEY, "Int64").alias(ROW),
        parent.alias(PARENT_ROW),
        *[typed(f.name, "String" if f.lookup else f.type).alias(f.name) for f in entity.fields],
    )
